import hashlib
import math
import random

import numpy as np
import public_tokenizers  # noqa: F401
from pyspark.sql import functions as F

from keyloom.llm import blockann, warc
from keyloom.llm.shared import as_table

PAGES = "page_id long, url string, html string, path string, digest string, offset long"


def test_warc(spark):
    big, other = "<p>" + "é" * 700, "x" * 2000
    data = [(1, "http://b.org/a", big), (2, "http://a.b.org/", big), (9, "http://b.org/a", big), (3, None, other), (4, "bad url\n", other), (4, "bad url\n", other), (5, "http://c.org", None), (6, "http://c.org", ""), (7, "http://c.org", "small"), (8, "http://c.org", "small"), (None, "http://d.org", big), (None, None, "y" * 1500), (None, None, "y" * 1500)]
    pages = spark.createDataFrame([(*r, "p", "d", 1) for r in data], PAGES)
    index = as_table(warc.merge_runs(warc.write_archives(pages, file_bytes=1500)), "index")
    found = sorted(tuple(r) for r in warc.read_records(index).select(F.coalesce("page_id", F.lit(-1)), "payload_bytes", "payload_digest", "record_type", F.coalesce("refers_to", F.lit(-1))).collect())
    want = []
    for i, _, html in data:
        payload = (html or "").encode()
        ids = [j for j, _, h in data if (h or "").encode() == payload and j is not None]
        revisit = len(payload) >= 1000 and ids and len([1 for _, _, h in data if (h or "") == (html or "")]) > 1 and i != max(ids)
        want.append((-1 if i is None else i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else -1))
    assert found == sorted(want)
    rows = index.collect()
    rows.sort(key=lambda r: r.part)
    keys = [(r.urlkey, r.timestamp, r.page_id is not None, r.page_id or 0) for r in rows]
    assert keys == sorted(keys)
    assert warc.read_records(warc.merge_runs(warc.write_archives(pages.limit(0)))).count() == 0


def test_merge_in_many_runs(spark):
    """Small ranges, and runs that go to files: the order is the same."""
    random.seed(8)
    pages = spark.createDataFrame([(i, f"http://h{random.randrange(40)}.org/{random.randrange(9)}", "x", "p", "d", 1) for i in range(2000)], PAGES).repartition(8)
    runs = warc.write_archives(pages, file_bytes=20_000)
    assert runs.select("path").distinct().count() > 8
    want = sorted((r.urlkey, r.timestamp, r.page_id) for r in runs.collect())
    for per_range, most_rows in ((300, 50), (1 << 18, 64), (1 << 18, 1 << 17)):
        index = as_table(warc.merge_runs(runs, per_range, most_rows), "index").collect()
        by_part = {}
        for r in index:
            by_part.setdefault(r.part, []).append((r.urlkey, r.timestamp, r.page_id))
        assert len(by_part) > 1 or per_range > 2000
        assert [x for p in sorted(by_part) for x in by_part[p]] == want


def test_url_keys():
    assert warc.url_key("https://www.Example.com:443/A?b=C") == "com,example)/a?b=c"
    assert warc.url_key("http://a.b:8080") == "b,a:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("no scheme") == "no scheme"


def test_loser_tree():
    random.seed(1)
    for k in range(0, 9):
        runs = [sorted((random.randrange(20),) for _ in range(random.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


def dot(v, w):
    out = 0.0  # sum() would add up more exactly than doubles do
    for a, b in zip(v, w):
        out += a * b
    return out


def by_force(rows, asked, k):
    def good(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    out = []
    for q, v in asked:
        if q is None or not good(v):
            continue
        scores = [(-dot(v, w), i) for i, w in rows if i is not None and i != q and good(w) and len(w) == len(v)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_nearest(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(400 + i, vectors[7][1]) for i in range(60)]  # many copies of one vector
    vectors += [(None, vectors[3][1]), (500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] + [1.0] * 15), (504, [1.0, 2.0]), (520, [3.0, 4.0]), (505, []), (506, [float("inf")] * 16), (9, vectors[9][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, ids string, n int")
    asked = df.where("vec_id % 20 = 0")
    for block, stripes in ((50, 3), (50, 1), (4096, None)):
        found = sorted(map(tuple, blockann.nearest(df, asked, 5, block, stripes=stripes).collect()))
        assert found == by_force(vectors, [(i, v) for i, v in vectors if i is not None and i % 20 == 0], 5)
    assert blockann.nearest(df.limit(0), df.limit(0), 5).count() == 0
    assert len(found) > 5 and blockann.nearest(df.limit(3), df.limit(3), 20).count() == 6


def test_bounds_hold():
    rng = np.random.default_rng(7)
    q, c = rng.normal(size=(20, 64)) * 1e3, rng.normal(size=(50, 64))
    near, bound = blockann.tile(blockann.Quantised(q), blockann.Quantised(c))
    assert (np.abs(near - q @ c.T) <= bound).all()


def test_pipeline(spark):
    import corpus_pipeline
    from keyloom.llm import bagminhash, quality, toxicity

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{d}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = as_table(stage(spark, docs, d), name)
        assert docs.columns == columns
        if name == "quality":
            want = {r.doc_id for r in quality.classify(before, quality.fitted(before, labels)).collect() if r.predicted}
        elif name == "toxicity":
            want = {r.doc_id for r in toxicity.grade_documents(before, toxicity.fitted(before, labels)).collect() if not r.toxic}
        else:
            want = {r.class_id for r in bagminhash.classes(before).collect()}
        assert {r.doc_id for r in docs.collect()} == want
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, clashing names, very long texts and an empty table go through every stage and ``run``."""
    import corpus_pipeline
    from keyloom.llm import bagminhash

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = base.join(labels.where("quality = 1 and toxic = 0"), "doc_id", "left_semi").orderBy("doc_id").limit(12).collect()
    texts = [r.text for r in good]
    data = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[4] + " end"), (None, texts[5]), (None, texts[6] + " and more"), (None, None), (50, None), (51, ""), (52, " ".join(texts) * 30)]
    odd = spark.createDataFrame([(i, t, None, None, None, 1, "x", None, 2, "l", {"m": 1}) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long, r long, h string, fp string, id int, label string, doc map<string,int>")
    (tmp_path / "sf").mkdir()
    odd.select("doc_id", "text", "lang", "source", "n_chars").union(base.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id > 100")).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "sf" / "labels.parquet"))
    d = str(tmp_path / "sf")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, d)
        assert out.columns == odd.columns
        rows = out.collect()
        assert stage(spark, odd.limit(0), d).count() == 0
        if name == "dedup":
            classes = {}
            for i, t in data:
                words = tuple(bagminhash.words_of(t or "").tolist())
                near = next((k for k in classes if words == k or bagminhash.similarity(bagminhash.overlap_set(t or ""), classes[k][0]) >= 0.8), words)
                classes.setdefault(near, [bagminhash.overlap_set(t or ""), []])[1].append((i is None, i or 0))
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted(min(ids) for _, ids in classes.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, d)
    assert packed.groupBy("doc_id").agg(F.sum("length").alias("n")).count() == odd.select("doc_id").distinct().count()
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), d).count() == 0
    assert corpus_pipeline.run(spark, d).count() > 0


def test_queries_over_their_tables(spark):
    """Every ``op`` query over the small tables: its columns and a row for each row of its table where the contract says so."""
    from keyloom.llm import queries

    d, found = "/root/testdata/sf0.001", {}
    for name, f in queries.queries().items():
        found[name] = f(spark, d)
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    for name, columns in {"op4_quality_classifier": "doc_id held_out score predicted", "op5_toxicity": "doc_id severity p_toxic toxic", "op6_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256", "op7_token_files": "doc_id start n_tokens ids_crc32", "op8_bagminhash": "doc_id class_id", "op10_audio_features": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature"}.items():
        assert found[name].columns == columns.split() and found[name].count() == n
    assert found["op2_best_fit_packing"].select("doc_id").distinct().count() == n
    assert found["op3_warc_index"].count() == spark.read.parquet(f"{d}/pages.parquet").count()
    assert found["op1_license_scan"].count() > 0 and found["op9_block_matrix_join"].where("rank = 1").count() > 0
