import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from keyloom.llm import audio, bagminhash, idfile, license, packing, piece, quality, toxicity
from keyloom.llm.bpe import ChunkedBpe
from keyloom.llm.shared import among, numbered, salted_join

BPE = P.path("byte_bpe_50k.json")
ODD = ["", " ", "a", " a", "a ", "\n", "a\nb", "a \n b", "  a  b\t c\n\nd  ", "it's we'll 'S", "x y z", "a\x1cb c \x1d d", "▁a ▁▁b▁", "日本 語テキスト 123 ４５", "<|endoftext|> a", "\x00 a\x00b", "🙂 🙂🙂 x", "a" * 3000 + " " + "b c " * 500, "a\r\nb\r c"]
# extra columns, some with names that operators use themselves; nulls, ties and repeated rows
SCHEMA = "doc_id long, text string, length int, label string, size double, key string, bands string"


def rows(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "x", 0.5, None, "y") for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(BPE)


def test_chunked_bpe_equals_library(bpe):
    random.seed(1)
    texts = ODD + ["".join(random.choice(" \n\tab'sé1!. ▁　日<") for _ in range(random.randint(0, 60))) for _ in range(3000)]
    own = ChunkedBpe(BPE, table_limit=500, segment_chars=20)
    got = [np.frombuffer(x, own.dtype).tolist() for i in range(0, len(texts), 100) for x in own.encode(texts[i : i + 100])]
    assert got == [e.ids for e in bpe.encode_batch(texts, add_special_tokens=False)]


def test_id_files(spark, bpe):
    texts = [*ODD, None, "same", "same"]
    ids = [5, 3, -7, None, *range(100, 100 + len(texts) - 6), 2**62, 2**62]
    manifest = idfile.write_id_files(rows(spark, texts, ids), BPE, 2, shard_ids=700)
    assert manifest.count() > 1
    found = idfile.read_id_files(manifest).collect()
    want, start = [], 0
    order = sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0] or 0))
    for i, t in order:
        x = np.array(bpe.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want
    assert idfile.read_id_files(idfile.write_id_files(rows(spark, []), BPE, 2)).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n in (1, 2, 255, 256, 257, 3000):
        for top in (0, 1, 50, 10**6):
            v = np.cumsum(rng.integers(0, top + 1, n))
            ef, _ = idfile.EliasFano.read(idfile.EliasFano.of(v).to_bytes(), 0)
            assert [ef.select(i) for i in range(n)] == v.tolist()
            assert ef.block(n // 3, n).tolist() == v[n // 3 :].tolist()
    assert len(idfile.EliasFano.of(np.arange(0, 10**6, 100)).to_bytes()) * 8 < 10**4 * 10


def test_packing(spark, bpe):
    texts = [*ODD, None, "word " * 4000, "tie", "tie"]
    found = packing.pack_documents(rows(spark, texts), BPE, capacity=64).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by[r.doc_id].append(r), seq[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        x = np.array(bpe.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(x)
        assert all(r.length == 64 for r in own[1:]) and all(r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes()) for r in own)
    for places in seq.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 64
    total = sum(r.length for r in found)
    assert len(seq) <= total / 64 * 1.05 + 2
    assert packing.pack_documents(rows(spark, []), BPE).count() == 0


def test_best_fit_bounded():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    fit = packing.BestFit(10, 2)
    # the fullest bin closes for the third one
    assert [fit.place(n)[0] for n in (6, 7, 8, 4)] == [0, 1, 2, 0]


def test_sentencepiece(spark):
    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    random.seed(2)
    texts = ODD + ["".join(random.choice("  \nab▁é日.\x01") for _ in range(random.randint(0, 30))) for _ in range(2000)]
    own = piece.ChunkedPiece(model, table_limit=300)
    assert own.chunked
    assert [np.frombuffer(x, own.dtype).tolist() for i in range(0, len(texts), 50) for x in own.encode(texts[i : i + 50])] == sp.encode(texts)
    found = {r.doc_id: r for r in piece.encode_decode(rows(spark, [*ODD, None]), model).collect()}
    for i, t in enumerate([*ODD, None]):
        x = sp.encode(t or "", add_bos=True, add_eos=True)
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(x).encode()).hexdigest())


def test_audio(spark):
    texts = [*ODD, None, "same text " * 50, "same text " * 50, "x" * 100_000]
    stored = audio.tensor_table(audio.store(rows(spark, texts)))
    found = {r.doc_id: r for r in audio.features(stored).collect()}
    kept = {r.doc_id: r.tensors for r in stored.collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        wav = audio.to_wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        table = audio.from_ipc(kept[i])
        assert str(table.schema.field("patch").type).startswith("extension<arrow.fixed_shape_tensor")
        assert all(a < b for a, b in zip(table.column("start_s").to_pylist(), table.column("end_s").to_pylist()))
        assert audio.digest(table) == r.feature
    assert found[len(ODD) + 1].feature == found[len(ODD) + 2].feature
    assert audio.features(audio.tensor_table(audio.store(rows(spark, [])))).count() == 0


def test_audio_parts():
    assert audio.segments(np.array([0, 0, 9, 5, 5, 0, 0, 9.0])) == [(2, 5), (7, 8)]
    tone = np.sin(np.arange(8000) / 8000 * 2 * np.pi * 500).astype(np.float32)
    y = audio.resample(tone)
    assert abs(len(y) - 6000) <= 3
    assert np.abs(y[100:5900] - np.sin(np.arange(100, 5900) / 6000 * 2 * np.pi * 500)).max() < 0.05
    assert np.allclose(audio.log_mel(y, block=7), audio.log_mel(y), atol=1e-3)


def test_log_mel_by_force():
    """Against sums written out: a direct transform of windowed frames, and triangles on the mel scale."""
    y = np.random.default_rng(9).normal(size=700)
    n, bands, rate = 256, 24, 6000
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(40), mel(rate / 2), bands + 2)]
    want = []
    for start in range(0, 4 * 128 + 1, 128):
        frame = [(y[start + t] if start + t < len(y) else 0.0) * (0.5 - 0.5 * np.cos(2 * np.pi * t / (n - 1))) for t in range(n)]
        power = [abs(sum(x * np.exp(-2j * np.pi * k * t / n) for t, x in enumerate(frame))) ** 2 for k in range(n // 2 + 1)]
        row = []
        for b in range(bands):
            low, mid, high = edges[b : b + 3]
            row.append(10 * np.log10(sum(p * max(0.0, min((k * rate / n - low) / (mid - low), (high - k * rate / n) / (high - mid))) for k, p in enumerate(power)) + 1e-6))
        want.append(row)
    got = audio.log_mel(y.astype(np.float32))
    assert got.shape == (5, 24) and np.allclose(got, want, atol=0.02)


def test_scoring_equals_full_softmax(spark):
    """One number a bucket gives what the mean vector and the softmax layer give."""
    texts, good, _ = labelled(120)
    model = quality.train(texts, good, buckets=1 << 12)
    docs = rows(spark, texts + ["", None])
    found = {r.doc_id: r.score for r in quality.classify(docs, model).collect()}
    for i, t in enumerate(texts + ["", None]):
        parts = list(quality.hashed(t or "", 1 << 12))
        mean = model.vectors[np.concatenate(parts)].astype(np.float64).mean(axis=0) if parts else np.zeros(model.vectors.shape[1])
        z = mean @ model.output + model.bias
        assert abs(found[i] - np.exp(z[1]) / np.exp(z).sum()) < 1e-5


def test_scores_follow_all_labels():
    """A sample with its classes evened out gives about the scores of the whole set."""
    texts, good, toxic = labelled(400)
    even = sorted([i for i in range(400) if not good[i]] + [i for i in range(400) if good[i]][:100])
    a = quality.train(texts, good, buckets=1 << 12)
    b = quality.train([texts[i] for i in even], [good[i] for i in even], buckets=1 << 12, totals=(100, 300))
    share = [quality.train([texts[i] for i in even], [good[i] for i in even], buckets=1 << 12).collapsed()[1], b.collapsed()[1]]
    assert share[1] - share[0] == pytest.approx(np.log(3), abs=1e-6) and a.collapsed()[1] > share[0]
    x = toxicity.train([texts[i] for i in even], [toxic[i] for i in even], buckets=1 << 12)
    n = sum(toxic[i] for i in even)
    y = toxicity.train([texts[i] for i in even], [toxic[i] for i in even], buckets=1 << 12, totals=(3 * (200 - n), n))
    assert np.allclose(y.thresholds - x.thresholds, np.log(3))


def test_ordinal_loss():
    """Probabilities add up, and derivatives agree with differences."""
    theta = np.array([-0.5, 0.4, 2.0])
    for z in (-2.0, 0.3, 1.7):
        at_least = [1.0, *(1 / (1 + np.exp(t - z)) for t in theta), 0.0]
        for g in range(4):
            value, by_z, by_theta = toxicity.loss(theta, z, g)
            assert value == pytest.approx(-np.log(at_least[g] - at_least[g + 1]))
            d = 1e-6
            assert by_z == pytest.approx((toxicity.loss(theta, z + d, g)[0] - toxicity.loss(theta, z - d, g)[0]) / (2 * d), abs=1e-5)
            for k in range(3):
                e = np.eye(3)[k] * d
                assert by_theta[k] == pytest.approx((toxicity.loss(theta + e, z, g)[0] - toxicity.loss(theta - e, z, g)[0]) / (2 * d), abs=1e-5)
        model = toxicity.OrdinalModel(np.zeros(4), theta)
        assert model.severity(z) == pytest.approx(sum(g * (at_least[g] - at_least[g + 1]) for g in range(4)))


def test_licenses(spark):
    texts = [None, "", "one", "Released under the MIT License.", "some text of its own\nreleased under the mit LICENSE!\nmore\n\nLicensed under CC BY-NC 4.0.", "Released under the MIT License. " * 2, license.TEMPLATES[3][1].replace(" ", "\n"), "word " * 20000]
    found = {(r.doc_id, r.license): (r.units, r.dice) for r in license.scan(rows(spark, texts)).collect()}
    assert found[(3, "MIT")] == (1, 1.0) and found[(4, "MIT")] == (1, 1.0) and found[(4, "CC-BY-NC-4.0")] == (1, 1.0) and found[(6, "MIT")] == (1, 1.0)
    assert {i for i, _ in found} == {3, 4, 5, 6}
    low, high = license.size_bounds(10, 0.8)
    assert [2 * min(10, n) / (10 + n) >= 0.8 - 1e-12 for n in (low - 1, low, high, high + 1)] == [False, True, True, False]
    assert license.scan(rows(spark, [])).count() == 0
    assert "Python" not in license.scan(rows(spark, texts))._jdf.queryExecution().toString()


def labelled(n=400):
    random.seed(3)
    vocabulary = ["".join(random.choice("aeioustnr") for _ in range(random.randint(2, 8))) for _ in range(300)]
    texts, quality_, toxic = [], [], []
    for i in range(n):
        words = [random.choice(vocabulary) for _ in range(80)]
        bad, mean = i % 4 == 0, i % 5 == 0
        if bad:
            words = [w.upper() + "!!" for w in words]
        if mean:
            for _ in range(4):
                words[random.randrange(80)] = random.choice(["nastyword", "vileterm", "rudething"])
        texts.append(" ".join(words)), quality_.append(int(not bad)), toxic.append(int(mean))
    return texts, quality_, toxic


def test_classifiers(spark):
    texts, good, toxic = labelled()
    extra = ["", None, "word " * 30000]
    docs = rows(spark, texts + extra)
    labels = spark.createDataFrame([(i, q, t, "z") for i, (q, t) in enumerate(zip(good, toxic))] + [(None, 1, 1, "z"), (5, None, None, "z")], "doc_id long, quality int, toxic int, text string")
    model = quality.fitted(docs, labels, per_class=200)
    found = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    assert len(found) == len(texts) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [i for i in range(len(texts)) if found[i].held_out]
    assert np.mean([found[i].predicted == good[i] for i in held]) > 0.95
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns
    ordinal = toxicity.fitted(docs, labels, per_class=200)
    assert (np.diff(ordinal.thresholds) > 0).all()
    marks = {r.doc_id: r for r in toxicity.grade_documents(docs, ordinal).collect()}
    assert np.mean([marks[i].toxic == toxic[i] for i in held]) > 0.9 and all(0 <= r.severity <= 3 for r in marks.values())
    assert marks[len(texts)].toxic == 0 and toxicity.keep(docs, ordinal).columns == docs.columns
    for fitted in (quality.fitted(docs, labels.limit(0)), toxicity.fitted(docs, labels.limit(0))):
        assert fitted is not None
    assert quality.classify(docs.limit(0), model).count() == 0


def classes_by_force(pairs):
    sets = {i: bagminhash.shingles(bagminhash.words_of(t or "")) for i, t in pairs}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            (x, cx), (y, cy) = sets[a], sets[b]
            _, i, j = np.intersect1d(x, y, return_indices=True)
            both = np.minimum(cx[i], cy[j]).sum()
            total = cx.sum() + cy.sum() - both
            if (total and both / total >= 0.8) or (not total and (dict(pairs)[a] or "") == (dict(pairs)[b] or "")):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicates(spark):
    random.seed(4)
    base = [f"w{i}" for i in range(120)]

    def changed(words, n):
        words = list(words)
        for _ in range(n):
            words[random.randrange(len(words))] = f"new{random.randrange(10**6)}"
        return " ".join(words)

    texts = [changed(base, n % 9) for n in range(70)] + [" ".join(random.choice("abcdefgh") for _ in range(random.randint(0, 60))) for _ in range(60)]
    texts += ["", "", None, "!!", "!!", "few words", "Few, words", "x y z " * 200, "x y z " * 230, " ".join(base)]
    docs = rows(spark, texts)
    found = {r.doc_id: r.class_id for r in bagminhash.classes(docs).collect()}
    assert found == classes_by_force(list(enumerate(texts)))
    kept = bagminhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(found.values()))


def test_near_duplicates_odd(spark):
    """Repeated and missing doc_ids: rows of one doc_id are one document for classes, but keep their texts when duplicates go."""
    alone, near = "other text of its own", "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3
    data = [(7, "a b c d e f"), (7, "A b, c d e f!"), (None, "a b c d e f"), (None, alone), (None, alone), (8, near), (8, "quite another thing"), (3, near + "more"), (None, near + "words"), (9, None), (4, "")]
    docs = rows(spark, [t for _, t in data], [i for i, _ in data])
    found = collections.Counter((r.doc_id, r.class_id) for r in bagminhash.classes(docs).collect())
    assert found == {(7, 7): 2, (None, 7): 1, (None, None): 2, (8, 3): 2, (3, 3): 1, (None, 3): 1, (9, 4): 1, (4, 4): 1}
    kept = [(r.doc_id, r.text) for r in bagminhash.deduplicate(docs).collect()]
    assert len(kept) == 5 and set(kept) >= {(None, alone), (8, "quite another thing"), (3, near + "more"), (4, "")} and 7 in [i for i, _ in kept]
    assert bagminhash.classes(rows(spark, [])).count() == 0


def test_hot_keys_are_dealt_further(spark):
    left = spark.range(1000).selectExpr("if(id < 900, 1, id) as k", "id as v", "'x' as parts")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(0, 1000, 2)] + [(1, "one")], "k long, w string")
    want = sorted((r.k, r.v, r.w or "") for r in left.join(right, "k", "left").collect())
    found = salted_join(left, right, "k", F.col("v"), "left", least=10)
    assert sorted((r.k, r.v, r.w or "") for r in found.collect()) == want
    assert "__salt" in found._jdf.queryExecution().toString()


def test_rows_by_number(spark):
    table = numbered(spark.range(1000).repartition(7), "t")
    wanted = table.where("id % 3 = 0").select("r")
    assert {x.id for x in among(table, wanted, "w").collect()} == set(range(0, 1000, 3))
    assert among(table, wanted.limit(0), "w").count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 6, 400) for _ in range(2))
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    elements = bagminhash.mix(np.arange(400, dtype=np.uint64))
    s = bagminhash.signatures(np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), np.concatenate([elements[a > 0], elements[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (5, 5), (200, 100)], "a long, b long")
    found = {r.id: r.label for r in bagminhash.components(links).collect()}
    assert all(found[i] == 0 for i in range(41)) and {found[i] for i in (100, 101, 102, 200)} == {100}
    assert bagminhash.components(spark.createDataFrame([], T.StructType.fromDDL("a long, b long"))).count() == 0
