import collections
import itertools

import pytest
from pyspark.sql import functions as F

from keyloom.functions import hashing as H
from keyloom.operators import filters as X
from keyloom.operators import other as O
from keyloom.operators import recsplit as R
from keyloom.plans import planner as P
from keyloom.sources import keys as K


def bijective(df, n):
    r = R.check(df).first()
    return tuple(r) == ((n, n, 0, n - 1) if n else (0, 0, None, None))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500])
def test_sizes(spark, n):
    keys = spark.range(n).select((F.col("id") * 7 - 11).alias("k"))
    model = R.build(keys, "k", R.Options(average_bucket_size=20))
    assert bijective(R.lookup(model, keys, "k"), n)
    assert model.n == n


@pytest.mark.parametrize("options", [R.Options(leaf_size=2, average_bucket_size=4), R.Options(leaf_size=5), R.Options(leaf_size=9, average_bucket_size=300), R.Options(overflow=1, average_bucket_size=30)])
def test_options(spark, options):
    keys = spark.range(2000).select(F.col("id").alias("k"))
    assert bijective(R.lookup(R.build(keys, "k", options), keys, "k"), 2000)


def test_partitioning_changes_nothing(spark):
    keys = spark.range(1500).select(F.concat(F.lit("Hello "), F.col("id")).alias("k"))
    tables = [sorted((r.bucket, r.nodes) for r in R.build(keys.repartition(p), "k", R.Options("string")).table.collect()) for p in (1, 5)]
    assert tables[0] == tables[1]


def test_errors(spark):
    with pytest.raises(Exception, match="keys repeat"):
        R.build(spark.createDataFrame([(1,), (1,)], "k long"), "k")
    with pytest.raises(Exception, match="null"):
        R.build(spark.createDataFrame([(1,), (None,)], "k long"), "k")
    with pytest.raises(ValueError):
        R.Options(leaf_size=30)


def test_absent_null_and_saved(spark, tmp_path):
    keys = spark.range(300).select(F.col("id").alias("k"))
    model = R.build(keys, "k")
    found = R.lookup(model, spark.createDataFrame([(10**12,), (None,), (5,)], "k long"), "k").collect()
    assert {r.k: r.idx for r in found}[None] is None and len(found) == 3
    model.save(str(tmp_path / "m"))
    loaded = R.Model.load(spark, str(tmp_path / "m"), model.options)
    assert sorted(map(tuple, R.lookup(loaded, keys, "k").collect())) == sorted(map(tuple, R.lookup(model, keys, "k").collect()))
    with pytest.raises(ValueError):
        R.Model.load(spark, str(tmp_path / "m"), R.Options(leaf_size=9))
    again = R.Model.from_bytes(spark, model.to_bytes(), model.options)
    assert sorted(map(tuple, R.lookup(again, keys, "k").collect())) == sorted(map(tuple, R.lookup(model, keys, "k").collect()))
    sizes = model.nodes().groupBy("bucket").agg(F.count("*").alias("c")).join(model.table.select("bucket", F.size("nodes").alias("s")), "bucket")
    assert sizes.where("c <> s").isEmpty()


def test_fast(spark):
    keys = H.with_wrapped(spark.range(3000), k=H.mix64(F.col("id"))).select("k")
    model = R.build(keys, "k", R.Options(mode="fast", leaf_size=5, average_bucket_size=16))
    assert bijective(R.lookup(model, keys, "k"), 3000)
    with pytest.raises(Exception, match="null"):
        R.build(spark.createDataFrame([(1 << 40,), (None,)], "k long"), "k", R.Options(mode="fast"))
    with pytest.raises(Exception, match="64 keys"):
        R.build(spark.range(500).select(F.col("id").alias("k")), "k", R.Options(mode="fast"))


def test_other(spark):
    keys = spark.range(1500).select(F.col("id").alias("k"))
    assert bijective(O.lookup_bdz(O.build_bdz(keys, "k"), keys, "k"), 1500)
    for factor in (1.0, 1.1):
        assert bijective(O.lookup_chd(O.build_chd(keys, "k", factor=factor), keys, "k"), 1500)
    assert O.lookup_k_chd(O.build_k_chd(keys, "k", k=3), keys, "k").groupBy("slot").count().agg(F.max("count")).first()[0] <= 3
    levels = O.bbhash_levels(keys, "k")
    assert levels.count() == levels.select("key").distinct().count() == 1500 and levels.where("slot is null").isEmpty()
    absent = spark.createDataFrame([(-5,), (3,), (None,)], "k long")
    values = keys.withColumn("v", F.concat(F.lit("v"), "k"))
    assert {r.k: r.value for r in O.cuckoo_lookup(values, absent, "k", "v").collect()} == {-5: None, 3: "v3", None: None}


def test_filters(spark):
    keys = spark.range(2000).select(F.col("id").alias("k"))
    far = keys.select((F.col("k") + 10**9).alias("k"))
    xor = X.build_xor(keys, "k")
    assert X.xor_contains(xor, keys, "k").where("member").count() == 2000
    assert X.xor_contains(xor, far, "k").where("member").count() < 40
    model = R.build(keys, "k")
    marks = X.mark(model, keys.where("k % 10 <> 0"), "k")
    assert sorted(r.k for r in X.unmarked(model, marks, keys, "k").collect()) == list(range(0, 2000, 10))


def test_planner():
    for leaf in (5, 8, 12):
        split, k = P.split_rules(leaf, 300)
        assert all(sum(P.parts_of(n, int(split[n]))) == n for n in range(2, 301))
    assert P.p_even(4, 2) == pytest.approx(6 / 16) and P.p_leaf(3) == pytest.approx(6 / 27) and P.p_parts([2, 2]) == pytest.approx(6 / 16)
    assert float(P.p_uneven(4, 2)) == pytest.approx(6 / 16)
    assert abs(P.poisson(20, 100).sum() - 1) < 1e-9
    bits = [P.estimate(8, a)["bits"] for a in (20, 100, 400)]
    assert bits == sorted(bits, reverse=True)


def test_sources(spark, tmp_path):
    import numpy as np

    data = np.array([1, -5, 2**62], np.int64)
    (tmp_path / "r.bin").write_bytes(K.write_records(data) + b"xyz")
    assert sorted(r.key for r in K.records(spark, str(tmp_path / "r.bin"), mix=False).collect()) == sorted(data.tolist())
    (tmp_path / "t.txt").write_text("a\nb\na\n")
    assert tuple(K.duplicate_report(K.text_lines(spark, str(tmp_path / "t.txt")), "key").first()) == (3, 2, 1)
    df = spark.createDataFrame([("bb",), ("a",), ("é",), ("ab",)], "s string")
    assert [r.s for r in df.orderBy(*K.length_first("s")).collect()] == ["a", "ab", "bb", "é"]
    keys = K.generated(spark, 500, 3)
    for code in ("varint", "rice"):
        assert sorted(r.key for r in K.read_deltas(K.write_deltas(keys, code), code).collect()) == sorted(r.key for r in keys.collect())


ODD_COLUMNS = "k long, h long, bucket string, part int, bitmap string, idx2 map<string,int>, __n int, offset int, value2 string"


def test_columns_of_any_name(spark):
    """Lookups keep the caller's columns, whatever they are named, maps among them; null keys and repeated rows stay."""
    keys = spark.range(1000).select(F.col("id").alias("k"))
    rows = spark.createDataFrame([(k, 7, "b", 3, "m", {"a": 1}, 5, 6, "v") for k in [*range(50), 5, 5, 5, None]], ODD_COLUMNS)
    lookups = [
        lambda df: R.lookup(R.build(keys, "k"), df, "k"),
        lambda df: O.lookup_bdz(O.build_bdz(keys, "k"), df, "k"),
        lambda df: O.lookup_chd(O.build_chd(keys, "k"), df, "k"),
        lambda df: X.xor_contains(X.build_xor(keys, "k"), df, "k", "idx"),
        lambda df: O.cuckoo_lookup(keys.withColumn("v", F.concat(F.lit("v"), "k")), df, "k", "v", "idx"),
    ]
    for f in lookups:
        found = f(rows)
        assert found.columns == [*rows.columns, "idx"]
        got = found.collect()
        assert len(got) == 54 and all((r.h, r.bucket, r.part, r.bitmap, r.idx2, r["__n"], r.offset) == (7, "b", 3, "m", {"a": 1}, 5, 6) for r in got)
        assert [r.idx for r in got if r.k is None] in ([None], [False])
        assert f(rows.limit(0)).count() == 0
        with pytest.raises(ValueError, match="a column"):
            f(rows.withColumn("idx", F.lit(1)))
    model = R.build(keys, "k")
    marks = X.mark(model, rows.where("k < 40"), "k")
    assert sorted(r.k for r in X.unmarked(model, marks, rows.where("k is not null"), "k").collect()) == list(range(40, 50))
    assert X.unmarked(model, marks, rows, "k").columns == rows.columns


def test_hot_keys_stay_where_they_are(spark):
    """Functions of many files have rows dealt by file in partitions that may be split; smaller ones move no rows, so a hot key is as many tasks as its rows were."""
    keys = spark.range(3000).select(F.col("id").alias("k"))
    hot = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id") % 3000).alias("k"))
    model = O.build_bdz(keys, "k")
    want = {r.k: r.idx for r in O.lookup_bdz(model, keys, "k").collect()}
    before = O.FEW_PARTS, R.FEW_PARTS
    found = O.lookup_bdz(model, hot, "k")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.select(F.spark_partition_id().alias("p")).distinct().count() == 8
    try:
        O.FEW_PARTS = R.FEW_PARTS = -1
        dealt = O.lookup_bdz(model, hot, "k")
        assert "REBALANCE" in dealt._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, found.collect())) and all(r.idx == want[r.k] for r in found.collect())
        small = R.build(keys, "k")
        assert bijective(R.lookup(small, keys, "k"), 3000)
    finally:
        O.FEW_PARTS, R.FEW_PARTS = before


def test_overflown_buckets_are_saved(spark, tmp_path):
    keys = spark.range(2000).select(F.col("id").alias("k"))
    model = R.build(keys, "k", R.Options(overflow=1, average_bucket_size=30))
    assert model.fallback is not None
    model.save(str(tmp_path / "m"))
    want = sorted(map(tuple, R.lookup(model, keys, "k").collect()))
    data = model.to_bytes()
    for again in (R.Model.load(spark, str(tmp_path / "m")), R.Model.from_bytes(spark, data, model.options)):
        assert sorted(map(tuple, R.lookup(again, keys, "k").collect())) == want
    said = R.describe_bytes(data, model.options)
    assert said["fallback"] and said["n"] == 2000 and said["keys_in_trees"] == model.fallback_offset and said["tree_bits"] <= 8 * said["tree_bytes"] < said["tree_bits"] + 8


@pytest.mark.parametrize("options", [R.Options(lists="multi_stage"), R.Options(split_mode="legacy"), R.Options(leaf_size=5, split_mode="legacy", lists="multi_stage", average_bucket_size=40)])
def test_lists_and_older_rules(spark, options):
    keys = spark.range(1200).select(F.col("id").alias("k"))
    model = R.build(keys, "k", options)
    want = sorted(map(tuple, R.lookup(model, keys, "k").collect()))
    assert sorted(i for _, i in want) == list(range(1200))
    again = R.Model.from_bytes(spark, model.to_bytes(), options)
    assert sorted(map(tuple, R.lookup(again, keys, "k").collect())) == want


def test_blocks(spark):
    keys = H.with_wrapped(spark.range(4000), k=H.mix64(F.col("id"))).select("k")
    store = R.build_blocks(keys, "k", per_block=600)
    assert store.blocks == 8 and {r.block: r.n for r in store.header().collect()}[None] == 4000
    whole = {r.k: r.idx for r in R.lookup(store.model, keys, "k").collect()}
    assert sorted(whole.values()) == list(range(4000))
    own = keys.where(F.shiftrightunsigned("k", 61) == 6)
    part = R.lookup(store.block(6), own, "k").collect()
    assert part and all(whole[r.k] == r.idx for r in part)


def test_long_set():
    import numpy as np

    keys = np.array([*range(1, 3000), -5, 2**62, -(2**63)])
    s = O.LongSet(keys)
    assert s.contains(keys).all() and not s.contains(np.array([0, 3000, -6])).any()
    at = s.index(keys)
    assert len(set(at.tolist())) == len(keys) and (s.slots[at] == keys).all()
    for bad in ([0, 1], [3, 3]):
        with pytest.raises(ValueError):
            O.LongSet(bad)


def test_filter_bytes():
    import numpy as np

    h = H.np_mix64(np.arange(2000, dtype=np.uint64))
    data = X.xor_to_bytes(h)
    assert X.xor_test_bytes(data, h).all() and X.xor_test_bytes(data, H.np_mix64(np.arange(10**6, 10**6 + 2000, dtype=np.uint64))).mean() < 0.02
    with pytest.raises(ValueError):
        X.xor_test_bytes(data[:-1], h)


def test_peeling_in_rounds():
    import numpy as np

    assert O.peel(np.array([[0, 1, 2], [0, 1, 2]]), 3) is None
    edges = np.array([[0, 3, 6], [1, 3, 6], [1, 4, 7], [2, 4, 8]])
    seen = []
    for e, v in O.peel(edges, 9):
        assert all(v[i] in edges[e[i]] for i in range(len(e)))
        assert not set(v.tolist()) & {u for f in range(4) if f not in [*seen, *e] for u in edges[f].tolist()}
        seen += e.tolist()
    assert sorted(seen) == [0, 1, 2, 3]


def test_ways_to_split(spark):
    rows = {r.strategy: r for r in P.strategies(spark, 8, 96).collect()}
    assert set(rows) == {"optimised", "legacy", "halves", "beam", "even parts"}
    assert rows["beam"].bits <= rows["halves"].bits + 1e-9 and min(r.bits for r in rows.values()) > 1.44
    assert all(P.legacy_split(n, 8) != 0 and sum(P.parts_of(n, P.legacy_split(n, 8))) == n for n in range(9, 500))
    assert P.binomial(5, 2) == pytest.approx(10) and P.tail(20, 0) == pytest.approx(1) and P.size_biased(20, 200).sum() == pytest.approx(1)


def test_more_sources(spark, tmp_path):
    from keyloom.streaming.lookup import windowed_counts

    K.save_manifest(spark, str(tmp_path / "man"), {"a": "1", "b": "x"})
    assert K.load_manifest(spark, str(tmp_path / "man")) == {"a": "1", "b": "x"}
    import numpy as np

    (tmp_path / "big.bin").write_bytes(K.write_records(np.arange(10_000)))
    assert sorted(r.key for r in K.records(spark, str(tmp_path / "big.bin"), False, slice_bytes=4096).collect()) == list(range(10_000))
    blocks = K.block_sorted(spark, 1000, 3, 8).withColumn("p", F.spark_partition_id())
    assert blocks.groupBy("block").agg(F.countDistinct("p").alias("c")).where("c > 1").isEmpty() and blocks.select("key").distinct().count() == 1000
    values = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "s string")
    assert K.signatures(values, "s").count() == K.signatures128(values, "s").count() == 2
    keys = spark.range(20).select(F.col("id").alias("k"))
    model = R.build(keys, "k")
    spark.createDataFrame([(i % 20, f"2024-01-01 0{i // 20}:30:00") for i in range(60)], "k long, ts string").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("k long, ts string").parquet(str(tmp_path / "ev"))
    q = windowed_counts(model, stream, "k", "ts").writeStream.format("memory").outputMode("complete").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("counts").collect()
    assert len(got) == 60 and all(r.cnt == 1 for r in got)


def test_stream(spark, tmp_path):
    from keyloom.streaming.lookup import lookup_stream

    keys = spark.range(100).select(F.col("id").alias("k"))
    model = R.build(keys, "k")
    keys.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(keys.schema).parquet(str(tmp_path / "in"))
    q = lookup_stream(model, stream, "k").writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert bijective(spark.table("found"), 100)


@pytest.mark.parametrize("options", [R.Options(slots=1.125, overflow=1, average_bucket_size=50), R.Options(keys_each=3, leaf_size=7), R.Options(mode="fast", leaf_size=8, average_bucket_size=16, slots=1.25), R.Options(mode="fast", leaf_size=8, average_bucket_size=16, keys_each=2, slots=1.5)])
def test_gaps_and_shared_places(spark, tmp_path, options):
    keys = H.with_wrapped(spark.range(3000), k=H.mix64(F.col("id")))
    model = R.build(keys, "k", options)
    model.save(str(tmp_path / "m"))
    rows = R.lookup(model, keys, "k")
    for name, again in (("a", R.Model.load(spark, str(tmp_path / "m"), options)), ("b", R.Model.from_bytes(spark, model.to_bytes(), options))):
        rows = R.lookup(again, rows, "k", name)
    got = rows.collect()
    shared = collections.Counter(r.idx for r in got)
    assert all(r.idx == r.a == r.b for r in got) and max(shared.values()) <= options.keys_each and min(shared) >= 0
    if options.overflow == 1:
        assert model.fallback is not None
    if options.keys_each == 1:
        assert max(shared) < options.slots * len(got)
    else:
        assert max(shared) < 0.9 * len(got)


def test_probability_of_places():
    for size, places, most in ((4, 4, 1), (4, 5, 1), (5, 3, 2), (6, 2, 3), (5, 2, 2), (3, 1, 4)):
        fits = [max(collections.Counter(x).values()) <= most for x in itertools.product(range(places), repeat=size)]
        assert abs(P.p_places(size, places, most) - sum(fits) / len(fits)) < 1e-12
