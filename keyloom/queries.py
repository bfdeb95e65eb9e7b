"""The catalogue of queries over the given tables, and their SQL."""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codes, succinct
from .functions import hashing as H
from .operators import filters, other
from .operators import recsplit as R
from .plans import planner as P
from .plans.tables import as_table, shared_dir
from .sources import keys as K

QUERIES: dict = {}
SQL: dict = {}  # strings, or functions that make them


def query(sql=None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bijection_sql(keys: str, table: str) -> str:
    return f"select count({keys}) as n, count(distinct {keys}) as distinct_idx, 0::bigint as min_idx, (count({keys}) - 1)::bigint as max_idx from {table}"


WIDE = "18446744073709551616::uhugeint"


def sql_u64(x: str) -> str:
    return f"(({x}) % {WIDE})"


def sql_mix64(x: str) -> str:
    a = sql_u64(f"xor({x}, ({x}) >> 30) * {H.M1}::uhugeint")
    b = sql_u64(f"xor({a}, {a} >> 27) * {H.M2}::uhugeint")
    return f"xor({b}, {b} >> 31)"


def sql_signed(x: str) -> str:
    return f"(case when {x} >= 9223372036854775808::uhugeint then ({x})::hugeint - 18446744073709551616::hugeint else ({x})::hugeint end)::bigint"


def sql_int32(x: str) -> str:
    """Low 32 bits as a signed number, of an unsigned one."""
    return f"(case when (({x}) & 4294967295::uhugeint) >= 2147483648 then (({x}) & 4294967295::uhugeint)::bigint - 4294967296 else (({x}) & 4294967295::uhugeint)::bigint end)"


ORDERS = bijection_sql("o_orderkey", "orders")


# ---- A, B: building and evaluating ----


def _orders_model(spark, d, **options):
    orders = _t(spark, d, "orders").select("o_orderkey")
    return orders, R.build(orders, "o_orderkey", R.Options(**options))


@query(ORDERS)
def mphf_orders_bijection(spark, d):
    orders, model = _orders_model(spark, d)
    return R.check(R.lookup(model, orders, "o_orderkey"))


@query(bijection_sql("c_name", "customer"))
def mphf_string_keys(spark, d):
    rows = _t(spark, d, "customer").select("c_name")
    return R.check(R.lookup(R.build(rows, "c_name"), rows, "c_name"))


@query(bijection_sql("url", "(select distinct url from pages where url is not null)"))
def mphf_urls(spark, d):
    rows = K.distinct_keys(_t(spark, d, "pages"), "url")
    return R.check(R.lookup(R.build(rows, "key"), rows, "key"))


@query("select l_orderkey as o_orderkey, count(*) as lines from lineitem group by 1")
def mphf_index_lossless(spark, d):
    orders, model = _orders_model(spark, d)
    counted = R.lookup(model, _t(spark, d, "lineitem").select("l_orderkey"), "l_orderkey").groupBy("idx").agg(F.count("*").alias("lines"))
    return R.lookup(model, orders, "o_orderkey").join(counted, "idx").select("o_orderkey", "lines")


@query("select leaf_size::int as leaf_size, n, distinct_idx, min_idx, max_idx from (" + ORDERS + ") b, (values (7), (8), (9), (10)) v(leaf_size)")
def mphf_leaf_sweep(spark, d):
    found = []
    for leaf in (7, 8, 9, 10):
        orders, model = _orders_model(spark, d, leaf_size=leaf, average_bucket_size=50)
        found.append(R.check(R.lookup(model, orders, "o_orderkey")).select(F.lit(leaf).alias("leaf_size"), "*"))
    return functools.reduce(DataFrame.unionByName, found)


@query("select count(*) as n, 0::bigint as differences from orders")
def mphf_save_load_equal(spark, d):
    orders, model = _orders_model(spark, d)
    path = shared_dir(spark, "saved")
    model.save(path)
    loaded = R.Model.load(spark, path, model.options)
    both = R.lookup(loaded, R.lookup(model, orders, "o_orderkey", "a"), "o_orderkey", "b")
    return both.agg(F.count("*").alias("n"), F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("long")).alias("differences"))


@query("select count(*) as n, 0::bigint as differences from customer")
def mphf_bytes_round_trip(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey")
    model = R.build(rows, "c_custkey")
    again = R.Model.from_bytes(spark, model.to_bytes(), model.options)
    both = R.lookup(again, R.lookup(model, rows, "c_custkey", "a"), "c_custkey", "b")
    return both.agg(F.count("*").alias("n"), F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("long")).alias("differences"))


@query("select count(*) as n, true as above_bound, true as below_four, true as as_stored from orders")
def mphf_space_report(spark, d):
    """The figures against theory, and against the string that a function is stored as, which has headers and one more list of 32-bit steps."""
    _, model = _orders_model(spark, d)
    stored = 8 * len(model.to_bytes())
    bits = F.col("bits_per_key")
    return model.space().select("n", (bits > 1.44).alias("above_bound"), (bits < 4).alias("below_four"), (F.abs(F.col("tree_bits") + F.col("list_bits") - stored) < 0.03 * stored + 4000).alias("as_stored"))


@query("select count(*) as n, count(*) as distinct_idx, true as in_range, true as shorter, 0::bigint as differences from orders")
def mphf_with_gaps(spark, d):
    """Leaves of nine places for eight keys: no two keys share a place, and the function takes fewer bits than the minimal one; saved as one string and back."""
    orders, model = _orders_model(spark, d, slots=1.125)
    found = R.lookup(R.Model.from_bytes(spark, model.to_bytes(), model.options), R.lookup(model, orders, "o_orderkey"), "o_orderkey", "again")
    shorter = model.space().first().bits_per_key < _orders_model(spark, d)[1].space().first().bits_per_key
    in_range = (F.max("idx") < 1.125 * F.count("*")) & (F.min("idx") >= 0)
    return found.agg(F.count("*").alias("n"), F.countDistinct("idx").alias("distinct_idx"), in_range.alias("in_range"), F.lit(shorter).alias("shorter"), F.sum((~F.col("idx").eqNullSafe(F.col("again"))).cast("long")).alias("differences"))


@query("select count(*) as n, 4::bigint as most, true as few_places, 0::bigint as differences from orders")
def mphf_k_perfect(spark, d):
    """Leaves whose places take up to four keys, so a leaf of eight has two; saved as one string and back."""
    orders, model = _orders_model(spark, d, keys_each=4)
    found = R.lookup(R.Model.from_bytes(spark, model.to_bytes(), model.options), R.lookup(model, orders, "o_orderkey"), "o_orderkey", "again")
    places = found.groupBy("idx").agg(F.count("*").alias("c"), F.sum((~F.col("idx").eqNullSafe(F.col("again"))).cast("long")).alias("differences"))
    return places.agg(F.sum("c").alias("n"), F.max("c").alias("most"), (F.max("idx") < 0.5 * F.sum("c")).alias("few_places"), F.sum("differences").alias("differences"))


@query("select count(*) as n, true as some_over, 0::bigint as differences from orders")
def hybrid_save_load_equal(spark, d):
    """A function with overflown buckets, saved as files and as one string, and loaded again."""
    orders, model = _orders_model(spark, d, overflow=1, average_bucket_size=100)
    path = shared_dir(spark, "saved")
    model.save(path)
    rows = R.lookup(model, orders, "o_orderkey", "a")
    for out, again in (("b", R.Model.load(spark, path, model.options)), ("c", R.Model.from_bytes(spark, model.to_bytes(), model.options))):
        rows = R.lookup(again, rows, "o_orderkey", out)
    return rows.agg(F.count("*").alias("n"), F.lit(model.fallback is not None).alias("some_over"), F.sum((~F.col("a").eqNullSafe(F.col("b")) | ~F.col("a").eqNullSafe(F.col("c"))).cast("long")).alias("differences"))


@query("select count(*) as n, count(*) as distinct_idx, 0::bigint as min_idx, count(*) - 1 as max_idx, 8::bigint as blocks, true as same_in_block from orders")
def block_build_bijection(spark, d):
    """Signatures built and stored by block, and a block looked up from its own files alone."""
    rows = as_table(H.with_wrapped(_t(spark, d, "orders").select("o_orderkey"), k=H.mix64(F.col("o_orderkey"))), "mixed")
    n = rows.count()
    store = R.build_blocks(rows, "k", max(1, -(-n // 8)))
    found = as_table(R.lookup(store.model, rows, "k"), "found")
    own = R.lookup(store.block(3), rows.where(F.shiftrightunsigned("k", 61) == 3), "k", "own").join(found.select("o_orderkey", "idx"), "o_orderkey")
    same = own.agg(F.min(F.col("own") == F.col("idx"))).first()[0]
    return R.check(found).select("*", F.lit(store.blocks).cast("long").alias("blocks"), F.lit(same).alias("same_in_block"))


@query("select count(*) as buckets, 0::bigint as differences from range((select ceil(count(*) / 100.0) from orders)::bigint)")
def mphf_list_round_trip(spark, d):
    """Plain descriptions as Elias-Fano lists and back."""
    _, model = _orders_model(spark, d)
    back = R.unlisted(R.listed(model)).select("bucket", F.col("first_key").alias("k"), F.col("first_node").alias("f"), F.col("nodes").alias("back"))
    both = R.description(model).join(back, "bucket")
    return both.agg(F.count("*").alias("buckets"), F.sum(((F.col("nodes") != F.col("back")) | (F.col("first_key") != F.col("k")) | (F.col("first_node") != F.col("f"))).cast("long")).alias("differences"))


@query("select count(*) as keys, true as sizes_add_up from orders")
def mphf_tree_roots(spark, d):
    """Roots hold all keys but those alone in their bucket, and a node's parts have its size."""
    _, model = _orders_model(spark, d)
    nodes = model.nodes().where("pos = 0").agg(F.sum("size").alias("s"))
    alone = model.table.where("n = 1").count()
    depth = model.nodes().where("depth = 1").groupBy("bucket").agg(F.sum("size").alias("parts")).join(model.table.select("bucket", "n"), "bucket").agg(F.coalesce(F.min(F.col("parts") <= F.col("n")), F.lit(True))).first()[0]
    return nodes.select((F.col("s") + alone).alias("keys"), F.lit(depth).alias("sizes_add_up"))


@query("select count(*) as buckets, 0::bigint as differences from range((select ceil(count(*) / 100.0) from orders)::bigint)")
def mphf_compressed_round_trip(spark, d):
    """Uncompressed descriptions against those packed and expanded again."""
    _, model = _orders_model(spark, d)
    back = R.expanded(R.compressed(model), model.options).select("bucket", F.col("nodes").alias("back"))
    both = R.description(model).join(back, "bucket")
    return both.agg(F.count("*").alias("buckets"), F.sum((F.col("nodes") != F.col("back")).cast("long")).alias("differences"))


@query()
def mphf_tree_nodes(spark, d):
    _, model = _orders_model(spark, d)
    return model.nodes().groupBy("size").agg(F.count("*").alias("nodes"), F.avg("gap").alias("mean_gap"), F.max("depth").alias("depth"))


@query(f"select count(*) as buckets, min(c) as fewest, avg(c) as mean, max(c) as most from (select (({sql_mix64('o_orderkey::uhugeint')} & 4294967295::uhugeint) * 100::uhugeint) >> 32 as b, count(*) as c from orders group by 1)")
def bucket_skew(spark, d):
    return other.bucket_skew(_t(spark, d, "orders"), "o_orderkey", 100)


@query(ORDERS)
def fast_mphf_bijection(spark, d):
    rows = as_table(H.with_wrapped(_t(spark, d, "orders").select("o_orderkey"), k=H.mix64(F.col("o_orderkey"))), "mixed")
    model = R.build(rows, "k", R.Options(mode="fast", leaf_size=5, average_bucket_size=16))
    return R.check(R.lookup(model, rows, "k"))


def _monotone_sql() -> str:
    u = f"(select {sql_mix64('o_orderkey::uhugeint')} as u from orders)"
    bits = "(select ceil(log2(ceil(count(*) / 16.0)))::int from orders)"
    return f"select count(*) as n, count(distinct u // pow(2, 64 - {bits})::uhugeint) as used_buckets, true as monotone from {u}"


@query(_monotone_sql())
def fast_bucket_monotone(spark, d):
    """A bucket's indexes begin behind all keys of the buckets before it: prefix sums by blocks, no window spans the table."""
    rows = as_table(H.with_wrapped(_t(spark, d, "orders").select("o_orderkey"), k=H.mix64(F.col("o_orderkey"))), "mixed")
    model = R.build(rows, "k", R.Options(mode="fast", leaf_size=5, average_bucket_size=16))
    bits = model.buckets.bit_length() - 1
    ranges = R.lookup(model, rows, "k").withColumn("b", F.shiftrightunsigned("k", 64 - bits) if bits else F.lit(0).cast("long")).groupBy("b").agg(F.min("idx").alias("low"), F.max("idx").alias("high"), F.count("*").alias("c"))
    placed = succinct.prefix_sum(ranges, "b", "c", "before")
    good = (F.col("low") == F.col("before")) & (F.col("high") == F.col("before") + F.col("c") - 1)
    return placed.agg(F.sum("c").alias("n"), F.count("*").alias("used_buckets"), F.min(good).alias("monotone"))


@query(ORDERS)
def hybrid_bijection(spark, d):
    orders, model = _orders_model(spark, d, overflow=1, average_bucket_size=100)
    return R.check(R.lookup(model, orders, "o_orderkey"))


# ---- E: other constructions ----


@query(ORDERS)
def bdz_bijection(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey")
    return R.check(other.lookup_bdz(other.build_bdz(orders, "o_orderkey"), orders, "o_orderkey"))


@query(f"select factor, n, distinct_idx, min_idx, max_idx from ({ORDERS}) b, (values (1.0::double), (1.05::double)) v(factor)")
def chd_bijection(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey")
    found = [R.check(other.lookup_chd(other.build_chd(orders, "o_orderkey", factor=f), orders, "o_orderkey")).select(F.lit(f).alias("factor"), "*") for f in (1.0, 1.05)]
    return found[0].unionByName(found[1])


@query("select count(*) as n, true as within_k from orders")
def chd_k_perfect(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey")
    slots = other.lookup_k_chd(other.build_k_chd(orders, "o_orderkey", k=4), orders, "o_orderkey").groupBy("slot").agg(F.count("*").alias("c"))
    return slots.agg(F.sum("c").alias("n"), (F.max("c") <= 4).alias("within_k"))


@query("select level::int as level, placed from (" + other.bbhash_level_sql("o_orderkey", "orders", 2.0) + ")")
def bbhash_level_counts(spark, d):
    """Keys placed on every level; the row without a level counts those left unplaced."""
    return other.bbhash_counts(other.bbhash_levels(_t(spark, d, "orders"), "o_orderkey", 2.0))


@query("select e.event_id, c.c_name as value from events e left join customer c on e.user_id = c.c_custkey")
def cuckoo_lookup(spark, d):
    events = _t(spark, d, "events").select("event_id", "user_id")
    entries = _t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return other.cuckoo_lookup(entries, events, "user_id", "c_name").select("event_id", "value")


# ---- H: membership ----


@query("select count(*) as n, count(*) as members from orders")
def fingerprint_filter_no_false_negatives(spark, d):
    orders, model = _orders_model(spark, d)
    prints = filters.fingerprint_table(model, orders, "o_orderkey")
    return filters.might_contain(model, prints, orders, "o_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("member").cast("long")).alias("members"))


@query("select count(*) as n, true as few_false from orders")
def fingerprint_filter_absent_keys(spark, d):
    orders, model = _orders_model(spark, d)
    prints = filters.fingerprint_table(model, orders, "o_orderkey")
    absent = orders.select((F.col("o_orderkey") + 10**9).alias("o_orderkey"))
    return filters.might_contain(model, prints, absent, "o_orderkey").agg(F.count("*").alias("n"), (F.avg(F.col("member").cast("int")) < 0.02).alias("few_false"))


@query("select count(*) as n, count(*) as members from orders")
def xor_filter_members(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey")
    found = filters.xor_contains(filters.build_xor(orders, "o_orderkey"), orders, "o_orderkey")
    return found.agg(F.count("*").alias("n"), F.sum(F.col("member").cast("long")).alias("members"))


@query("select o_orderkey from orders o where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def orders_without_lines(spark, d):
    orders, model = _orders_model(spark, d)
    marks = filters.mark(model, _t(spark, d, "lineitem").select("l_orderkey"), "l_orderkey")
    return filters.unmarked(model, marks, orders, "o_orderkey")


@query("select user_id, count(*) as cnt from events group by 1")
def dense_counter_events(spark, d):
    events = _t(spark, d, "events").select("user_id")
    users = events.distinct()
    model = R.build(users, "user_id", R.Options(average_bucket_size=20))
    return R.lookup(model, users, "user_id").join(filters.dense_counts(model, events, "user_id"), "idx").select("user_id", "cnt")


# ---- I: hashes ----


@query(f"select o_orderkey, {sql_signed(sql_mix64('o_orderkey::uhugeint'))} as h from orders")
def mix64_orders(spark, d):
    return H.with_wrapped(_t(spark, d, "orders").select("o_orderkey"), h=H.mix64(F.col("o_orderkey")))


@query("select o_orderkey, o_orderkey as back from orders")
def unmix64_round_trip(spark, d):
    rows = H.with_wrapped(_t(spark, d, "orders").select("o_orderkey"), h=H.mix64(F.col("o_orderkey")))
    return H.with_wrapped(rows, back=H.unmix64(F.col("h"))).drop("h")


@query("select c_custkey, c_custkey as back from customer")
def mix32_round_trip(spark, d):
    return _t(spark, d, "customer").select("c_custkey", H.unmix32(H.mix32(F.col("c_custkey"))).alias("back"))


@query(f"select (({sql_mix64('o_orderkey::uhugeint')} & 4294967295::uhugeint) * 64::uhugeint >> 32)::bigint as bucket, count(*) as n from orders group by 1")
def reduce_bucket_histogram(spark, d):
    rows = H.with_wrapped(_t(spark, d, "orders"), bucket=H.reduce_range(H.mix64(F.col("o_orderkey")), 64))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"))


def _weyl_sql() -> str:
    x = sql_u64(f"o_orderkey::uhugeint + i::uhugeint * {H.M1}::uhugeint")
    y = sql_u64(f"xor({x}, {x} >> 32) * {H.M1}::uhugeint")
    return f"select o_orderkey, i::bigint as i, {sql_int32(f'xor({y}, {y} >> 32)')} as h from orders, range(4) r(i)"


@query(_weyl_sql())
def weyl_hash(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", F.explode(F.array(*(F.lit(i).cast("long") for i in range(4)))).alias("i"))
    return H.with_wrapped(rows, h=H.weyl(F.col("o_orderkey"), F.col("i")))


@query(f"select o_orderkey, {sql_int32(sql_mix64('(o_orderkey + 7)::uhugeint'))} as h from orders")
def supplemental_hash(spark, d):
    return H.with_wrapped(_t(spark, d, "orders").select("o_orderkey"), h=H.supplemental(F.col("o_orderkey"), F.lit(7).cast("long")))


def _variants_sql(i: int = 7) -> str:
    low = "4294967295::uhugeint"
    x = sql_u64(f"u + {i}::uhugeint * {H.M1}::uhugeint")
    rotated = f"({sql_u64(f'u * {2**i}::uhugeint')} + (u >> {64 - i}))"
    mixed = f"(xor({rotated}, {i}::uhugeint) & {low})"
    steps = f"select *, {x} as sx, {mixed} as m0 from (select o_orderkey, o_custkey, {sql_mix64('o_orderkey::uhugeint')} as u from orders)"
    steps = f"select *, xor(sx, {sql_u64('sx * 8192::uhugeint')}) as s1, (xor(m0, m0 >> 16) * {H.MIX32}::uhugeint) & {low} as m1 from ({steps})"
    steps = f"select *, xor(s1, s1 >> 17) as s2, (xor(m1, m1 >> 16) * {H.MIX32}::uhugeint) & {low} as m2 from ({steps})"
    steps = f"select *, xor(s2, {sql_u64('s2 * 32::uhugeint')}) as s3, xor(m2, m2 >> 16) as m3, {sql_u64(f'u * {i + 1}::uhugeint + o_custkey::uhugeint')} as w from ({steps})"
    return f"select o_orderkey, {sql_int32('s3')} as shifted, {sql_int32('m3')} as short, ((m3 & 2147483647::uhugeint) % 1000::uhugeint)::bigint as slot, {sql_signed(sql_mix64('w'))} as wide, {sql_signed(f'xor({rotated}, u >> 16)')} as rotated from ({steps})"


@query(_variants_sql())
def supplemental_variants(spark, d):
    """The other supplemental hashes: by shifts, of 32 bits, scaled to a slot, of 128-bit keys, and the two-step one."""
    rows = H.with_wrapped(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), u=H.mix64(F.col("o_orderkey")))
    u, i = F.col("u"), F.lit(7).cast("long")
    made = {"shifted": H.supplemental_shift(u, i), "short": H.supplemental_int(u, i), "slot": H.cuckoo_slot(u, i, 1000), "wide": H.supplemental128(u, F.col("o_custkey"), i), "rotated": H.rotate_xor(u, i)}
    return H.with_wrapped(rows, **made).drop("o_custkey", "u")


def _bijection_sql() -> str:
    x = "c_custkey::uhugeint"
    a = f"((xor({x}, {x} >> 20) * {H.M1}::uhugeint) & 17592186044415::uhugeint)"
    b = f"((xor({a}, {a} >> 17) * {H.M2}::uhugeint) & 17592186044415::uhugeint)"
    return f"select c_custkey, xor({b}, {b} >> 21)::bigint as h from customer"


@query(_bijection_sql())
def bijection44(spark, d):
    return H.with_wrapped(_t(spark, d, "customer").select("c_custkey"), h=H.bijection(F.col("c_custkey"), 44))


@query("select " + ", ".join(f"count(distinct props) as {name}" for name in sorted(H.KERNELS)) + " from events")
def hash_library(spark, d):
    """Every byte-string hash of the events' properties, eight times over (one hash reads whole blocks only), as distinct counts: as many as there are distinct properties."""
    rows = _t(spark, d, "events").select("props")
    names = sorted(H.KERNELS)
    hashed = rows.select(*(H.hash_bytes(n, F.repeat("props", 8), 42).alias(n) for n in names))
    return hashed.agg(*(F.countDistinct(n).alias(n) for n in names))


@query("select count(*) as n, count(*) as equal from events")
def xxhash_seed42(spark, d):
    rows = _t(spark, d, "events").select("props")
    return rows.select((H.hash_bytes("xxhash64", F.col("props"), 42) == F.xxhash64("props")).alias("e")).agg(F.count("*").alias("n"), F.sum(F.col("e").cast("long")).alias("equal"))


def _search_sql() -> str:
    keys = f"select n_regionkey, {sql_mix64('n_nationkey::uhugeint')} as k from nation"
    slot = lambda i: f"(({sql_mix64(f'((k + ({i})::uhugeint) % {WIDE})')} & 4294967295::uhugeint) * 5::uhugeint) >> 32"
    return f"with recursive k as ({keys}), t as (select n_regionkey, 0::bigint as i, count(distinct {slot('0')}) as c from k group by 1 union all select n_regionkey, i + 1, count(distinct {slot('i + 1')}) from t join k using (n_regionkey) where c < 5 group by n_regionkey, i) select n_regionkey, i as idx from t where c = 5"


@query(_search_sql())
def leaf_bijection_search(spark, d):
    """The smallest index that sends a region's five nations to distinct places: tried natively, range after range until every region has one."""
    keys = as_table(H.with_wrapped(_t(spark, d, "nation").select("n_regionkey", "n_nationkey"), k=H.mix64(F.col("n_nationkey"))), "nations")
    found, first, step = None, 0, 256
    while not keys.isEmpty():
        if first > 1 << 20:
            raise ValueError("a region's nations have no bijection")
        tried = keys.withColumn("i", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + step - 1).cast("long"))))
        tried = H.with_wrapped(tried, slot=H.reduce_range(H.supplemental(F.col("k"), F.col("i")), 5))
        good = tried.groupBy("n_regionkey", "i").agg(F.countDistinct("slot").alias("c")).where("c = 5")
        here = as_table(good.groupBy("n_regionkey").agg(F.min("i").alias("idx")), "found")
        found = here if found is None else found.unionByName(here)
        keys = as_table(keys.join(here, "n_regionkey", "left_anti"), "nations")
        first, step = first + step, 2 * step
    return found if found is not None else spark.createDataFrame([], "n_regionkey long, idx long")


# ---- C, L: rules and estimates ----


@query("select leaf_size::int as leaf_size, size::int as size, true as valid from (values (8), (10)) l(leaf_size), range(2, 201) r(size)")
def split_rules_valid(spark, d):
    rows = [(leaf, n, sum(P.parts_of(n, int(P.split_rules(leaf, 200)[0][n]))) == n) for leaf in (8, 10) for n in range(2, 201)]
    return spark.createDataFrame(rows, "leaf_size int, size int, valid boolean")


def _plain_rice(p: float) -> int:
    """The smallest parameter whose upper part is at most the golden ratio's share away from a fair bit, by trying."""
    k = 0
    while (1 - p) ** 2.0**k > (5**0.5 - 1) / 2:
        k += 1
    return k


def _plain_bits(p: float) -> float:
    k = _plain_rice(p)
    return k + 1 / -math.expm1(2.0**k * math.log1p(-min(p, 1 - 1e-15)))


def _plain_p(n: int, parts: list[int]) -> float:
    """n keys fall into parts of just these sizes, each with its share of the range."""
    return math.exp(math.lgamma(n + 1) + sum(m * math.log(m / n) - math.lgamma(m + 1) for m in parts))


def _plain_rules(leaf: int, most: int) -> dict[int, list[int]]:
    """Parts of each size by the written rule: the fewest bits among all splits whose hash calls stay within twice a leaf's, or 16 a key."""
    rules, bits, work = {}, [0.0, 0.0], [0.0, 0.0]
    for n in range(2, most + 1):
        if n <= leaf:
            ways = [[1] * n]
        else:
            ways = [[m, n - m] for m in range(-(-n // 2), n)] + [[n // f] * f for f in range(3, 9) if n % f == 0 and n // f > 1]
        found = [(_plain_bits(p := _plain_p(n, way)) + sum(bits[m] for m in way), n / p + sum(work[m] for m in way), way) for way in ways]
        budget = 2 * max(work[leaf] / leaf, 8.0) * n if n > leaf else math.inf
        b, w, way = min([x for x in found if x[1] <= budget] or [min(found, key=lambda x: x[1])], key=lambda x: x[0])
        rules[n] = way
        bits.append(b), work.append(w)
    return rules


def _plain_costs(leaf: int, rules: dict[int, list[int]]) -> tuple[list, list, list]:
    bits, work, calls = [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]
    for n, way in rules.items():
        p, below = _plain_p(n, way), [] if n <= leaf else way
        bits.append(_plain_bits(p) + sum(bits[m] for m in below))
        work.append(n / p + sum(work[m] for m in below))
        calls.append(1 + sum(m * calls[m] for m in below) / n)
    return bits, work, calls


def _split_rules_sql() -> str:
    """Rows by the plain rule above, which shares no code with the planner."""
    rows = ", ".join(f"({n}, {way[0]}, {len(way)}, {_plain_rice(_plain_p(n, way))})" for n, way in _plain_rules(8, 200).items())
    return f"select size::int as size, first::int as first, parts::int as parts, rice_k::int as rice_k from (values {rows}) t(size, first, parts, rice_k)"


@query(_split_rules_sql)
def split_rules(spark, d):
    """Size of the first part and number of parts; two halves are named alike whichever rule they came from."""
    rules, split = P.rule_frame(spark, 8, 200), F.col("split")
    return rules.select("size", F.when(split > 0, F.floor(F.col("size") / split)).otherwise(-split).cast("int").alias("first"), F.when(split > 0, split).otherwise(2).alias("parts"), "rice_k")


def _pareto_sql() -> str:
    rows = []
    for leaf in (5, 6, 8, 10):
        bits, work, calls = _plain_costs(leaf, _plain_rules(leaf, 280))
        for average in (20, 50):
            p = [math.exp(n * math.log(average) - average - math.lgamma(n + 1)) for n in range(200 + average * 15 // 10 + 1)]
            total = lambda x: sum(a * b for a, b in zip(p, x)) / average  # noqa: E731, B023
            rows.append((leaf, average, total(bits) + (2 * math.log2(max(2.0, math.sqrt(average))) + 4) / average, total(work), total([n * c for n, c in enumerate(calls)]) + 1))
    values = ", ".join(f"({a}, {b}, {x!r}::double, {y!r}::double, {z!r}::double)" for a, b, x, y, z in rows)
    grid = f"(select leaf_size::int as leaf_size, average::int as average, round(bits, 4) as bits, round(build, 2) as build, round(evaluate, 4) as evaluate from (values {values}) t(leaf_size, average, bits, build, evaluate))"
    return f"with g as {grid} select * from g where not exists (select 1 from g o where o.bits <= g.bits and o.build <= g.build and o.evaluate <= g.evaluate and (o.bits < g.bits or o.build < g.build or o.evaluate < g.evaluate))"


def _strategies_sql() -> str:
    ways = {"optimised": _plain_rules(8, 128), "halves": {n: [1] * n if n <= 8 else [-(-n // 2), n // 2] for n in range(2, 129)}, "legacy": {}}
    for n in range(2, 129):
        f = x = 8
        while n > x:
            f = max(2, int(1.5 + 0.35 * f))
            x *= f
        ways["legacy"][n] = [1] * n if n <= 8 else [n // f] * f if n == x else [x // f, n - x // f]
    values = []
    for name, rules in ways.items():
        bits, work, calls = _plain_costs(8, rules)
        values.append(f"('{name}', {bits[128] / 128!r}::double, {work[128] / 128!r}::double, {calls[128]!r}::double)")
    return f"select strategy, round(bits, 4) as bits, round(build, 2) as build, round(evaluate, 4) as evaluate from (values {', '.join(values)}) t(strategy, bits, build, evaluate)"


@query(_strategies_sql)
def split_strategies(spark, d):
    """What a bucket of 128 keys takes under the optimised, the plain and the older rule; the searches with several plans are in ``planner.strategies``."""
    rows = P.strategies(spark).where("strategy in ('optimised', 'halves', 'legacy')")
    return rows.select("strategy", F.round("bits", 4).alias("bits"), F.round("build", 2).alias("build"), F.round("evaluate", 4).alias("evaluate"))


@query("select x::int as size, round(exp(x * ln(100) - 100 - lgamma(x + 1)), 9) as p from range(50, 151) r(x)")
def poisson_bucket_pmf(spark, d):
    p = P.poisson(100, 150)
    return spark.createDataFrame([(n, float(p[n])) for n in range(50, 151)], "size int, p double").withColumn("p", F.round("p", 9))


@query("select n::int as size, round(exp(lgamma(n + 1) - 2 * lgamma(n / 2 + 1) - n * ln(2)), 9) as p_even, round(exp(lgamma(n + 1) - n * ln(n)), 9) as p_leaf from range(2, 41, 2) r(n)")
def split_probability(spark, d):
    rows = [(n, P.p_even(n, 2), P.p_leaf(n)) for n in range(2, 41, 2)]
    return spark.createDataFrame(rows, "size int, p_even double, p_leaf double").withColumns({c: F.round(c, 9) for c in ("p_even", "p_leaf")})


_GOLD = (math.sqrt(5) - 1) / 2


@query(f"select n::int as n, greatest(0, 1 + floor(log2(ln({_GOLD!r}) / ln(1 - 1.0 / n))))::int as k, round(greatest(0, 1 + floor(log2(ln({_GOLD!r}) / ln(1 - 1.0 / n)))) + 1 / (1 - pow(1 - 1.0 / n, pow(2, greatest(0, 1 + floor(log2(ln({_GOLD!r}) / ln(1 - 1.0 / n))))))), 6) as bits from range(2, 65) r(n)")
def rice_parameter_table(spark, d):
    rows = spark.range(2, 65).select(F.col("id").cast("int").alias("n"), (1.0 / F.col("id")).alias("p")).withColumn("k", codes.rice_parameter(F.col("p")))
    return rows.select("n", "k", F.round(codes.rice_mean_bits(F.col("k"), F.col("p")), 6).alias("bits"))


@query(_pareto_sql)
def space_time_pareto(spark, d):
    grid = P.grid(spark, (5, 6, 8, 10), (20, 50))
    grid = grid.select("leaf_size", "average", F.round("bits", 4).alias("bits"), F.round("build", 2).alias("build"), F.round("evaluate", 4).alias("evaluate"))
    return P.pareto(grid, "bits", "build", "evaluate")


_PMF = "exp(x * ln(100) - 100 - lgamma(x + 1))"


@query(f"select s::int as size, round((select sum({_PMF}) from range(s, 500) r(x)), 12) as tail, round(s * exp(s * ln(100) - 100 - lgamma(s + 1)) / 100, 12) as biased, round(exp(s - 100 - s * ln(s / 100.0)), 12) as bound from range(100, 201, 10) q(s)")
def bucket_tail(spark, d):
    """Probability of a bucket of a size or more, of a key in one of just that size, and the bound of the former."""
    biased = P.size_biased(100, 200)
    rows = spark.createDataFrame([(n, P.tail(100, n), float(biased[n])) for n in range(100, 201, 10)], "size int, tail double, biased double")
    return rows.select("size", F.round("tail", 12).alias("tail"), F.round("biased", 12).alias("biased"), F.round(P.large_bucket_bound(F.lit(100.0), F.col("size").cast("double")), 12).alias("bound"))


@query("select n::int as n, k::int as k, round(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)))::bigint as ways, round(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(k / n) + (n - k) * ln(1 - k / n)), 9) as p from range(2, 25) a(n), range(1, 24) b(k) where k < n")
def uneven_split_probability(spark, d):
    rows = [(n, k, round(P.binomial(n, k)), float(P.p_uneven(n, k))) for n in range(2, 25) for k in range(1, n)]
    return spark.createDataFrame(rows, "n int, k int, ways long, p double").withColumn("p", F.round("p", 9))


@query("select n, min(b)::int as bits from (select n::bigint as n, b from (values (1000000), (1000000000), (1000000000000)) v(n), range(20, 128) r(b) where 1 - exp(-n::double * (n - 1) / 2 / pow(2.0, b)) < 0.01) group by 1")
def signature_bits_needed(spark, d):
    rows = spark.sql("select n, b from values (1000000L), (1000000000L), (1000000000000L) as v(n) lateral view explode(sequence(20, 127)) as b")
    return rows.where(P.probability_of_duplicates(F.col("n").cast("double"), F.col("b")) < 0.01).groupBy("n").agg(F.min("b").alias("bits"))


def _sql_rice(p: str) -> str:
    """Of small probabilities the logarithm's first terms, as 1 - p would lose digits."""
    return f"greatest(0, 1 + floor(log2(ln({_GOLD!r}) / (case when {p} < 1e-4 then -{p} - {p} * {p} / 2 - {p} * {p} * {p} / 3 else ln(1 - {p}) end))))"


_LEAF_P, _HALF_P = "exp(lgamma(n + 1) - n * ln(n))", "exp(lgamma(n + 1) - 2 * lgamma(n / 2 + 1) - n * ln(2))"


@query(f"select n::int as size, {_sql_rice(_LEAF_P)}::int as leaf_k, case when n % 2 = 0 then {_sql_rice(_HALF_P)} end::int as half_k from range(2, 33) r(n)")
def rice_leaf_table(spark, d):
    return P.rice_leaf_table(spark)


def _break_even_sql() -> str:
    bits = lambda p: f"({_sql_rice(p)} + 1 / (1 - pow(1 - {p}, pow(2.0, {_sql_rice(p)}))))"
    part = "exp(lgamma(m + 1) - m * ln(m))"
    return f"select n::int as size, round({bits('pl')}, 6) as leaf_bits, round({bits('ph')} + 2 * {bits('pm')}, 6) as split_bits, round(n / pl, 2) as leaf_calls, round(n / ph + n / pm, 2) as split_calls from (select n, {_LEAF_P} as pl, {_HALF_P} as ph, {part} as pm from (select n, n / 2 as m from range(4, 17, 2) r(n)))"


@query(_break_even_sql())
def leaf_break_even(spark, d):
    """Leaves and halved leaves up to 16 keys; larger ones are in ``planner.break_even``."""
    rows = P.break_even(spark, 16)
    return rows.select("size", *(F.round(c, 6).alias(c) for c in ("leaf_bits", "split_bits")), *(F.round(c, 2).alias(c) for c in ("leaf_calls", "split_calls")))


@query("select 2000000000::bigint as n, 15::bigint as segments, 133333334::bigint as keys_each")
def segment_plan(spark, d):
    return P.segments_plan(spark, 2 * 10**9, 1 << 30).select("n", "segments", "keys_each")


def _plan_sql() -> str:
    base = "select n::bigint as n, ceil(2 * log2(n::double))::int as signature_bits from (values (1000000), (2000000000), (1000000000000)) v(n)"
    more = f"select *, n::double * ceil(signature_bits / 8) as signature_bytes from ({base})"
    more = f"select *, ceil(signature_bytes / 8589934592)::bigint as chunks, n::double * 64 / 2e8 as scan_seconds, n::double * 3000 / 1e9 / 8 as build_seconds, n * 1.8::double as bits from ({more})"
    more = f"select *, signature_bytes * chunks / 2e8 as chunk_seconds, signature_bytes * 4 / 2e8 as stripe_seconds from ({more})"
    return f"select n, signature_bits, chunks, round(scan_seconds, 3) as scan_seconds, round(chunk_seconds, 3) as chunk_seconds, round(stripe_seconds, 3) as stripe_seconds, round(build_seconds, 3) as build_seconds from ({more})"


@query(_plan_sql())
def huge_set_plan(spark, d):
    rows = P.huge_set_plan(spark, [10**6, 2 * 10**9, 10**12])
    return rows.select("n", "signature_bits", "chunks", *(F.round(c, 3).alias(c) for c in ("scan_seconds", "chunk_seconds", "stripe_seconds", "build_seconds")))


@query("select b::bigint as bits, printf('%.1f ', b / 8.0 / pow(1024.0, s)) || (['B', 'KB', 'MB', 'GB', 'TB'])[s + 1] as text from (select b, least(4, floor(log2(greatest(b / 8.0, 1.0)) / 10))::int as s from (values (8), (9000), (123456789), (99999999999), (1234567890123456)) t(b))")
def format_bits(spark, d):
    rows = spark.createDataFrame([(b,) for b in (8, 9000, 123456789, 99999999999, 1234567890123456)], "bits long")
    return rows.select("bits", P.format_bits(F.col("bits")).alias("text"))


@query("select s::bigint as s, (s // 3600) || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') as text from range(0, 100000, 1777) r(s)")
def format_seconds(spark, d):
    return spark.range(0, 100000, 1777).select(F.col("id").alias("s"), P.format_seconds(F.col("id")).alias("text"))


_GENERATED = f"(select {sql_mix64('i::uhugeint')} as k from range(100000) r(i))"


@query(f"select size, count(*) / 1000.0::double as measured, round(any_value(exp(size * ln(100) - 100 - lgamma(size + 1))), 9) as p from (select count(*) as size from {_GENERATED} group by (k & 4294967295::uhugeint) * 1000::uhugeint >> 32) group by size")
def bucket_size_simulation(spark, d):
    """Sizes of buckets by generated keys beside the model's probability."""
    sizes = K.generated(spark, 100_000).groupBy(H.reduce_range(F.col("key"), 1000).alias("b")).agg(F.count("*").alias("size"))
    p = P.poisson(100, 200)
    model = spark.createDataFrame([(n, float(p[n])) for n in range(201)], "size long, p double")
    return sizes.groupBy("size").agg((F.count("*") / 1000).alias("measured")).join(model, "size").withColumn("p", F.round("p", 9))


@query(f"select first::int as first, avg((below = first)::int) as measured, round(any_value(exp(lgamma(11) - lgamma(first + 1) - lgamma(11 - first) + first * ln(first / 10) + (10 - first) * ln(1 - first / 10))), 9) as p from (select g, count(*) filter (where s < first) as below, first from (select i // 10 as g, {sql_mix64('i::uhugeint')} & 4294967295::uhugeint as low, ({sql_mix64('i::uhugeint')} & 4294967295::uhugeint) * 10::uhugeint >> 32 as s from range(100000) r(i)), range(1, 10) f(first) group by g, first) group by first")
def split_simulation(spark, d):
    """Of 10,000 groups of ten generated keys, the share that a split with each first part fits, beside its probability."""
    slots = H.with_wrapped(spark.range(100_000), s=H.reduce_range(H.mix64(F.col("id")), 10)).select(F.floor(F.col("id") / 10).alias("g"), "s")
    tried = slots.withColumn("first", F.explode(F.sequence(F.lit(1), F.lit(9))))
    fits = tried.groupBy("g", "first").agg(F.count_if(F.col("s") < F.col("first")).alias("below"))
    p = spark.createDataFrame([(m, float(P.p_uneven(10, m))) for m in range(1, 10)], "first int, p double")
    return fits.groupBy("first").agg(F.avg((F.col("below") == F.col("first")).cast("int")).alias("measured")).join(p, "first").withColumn("p", F.round("p", 9))


@query(f"select s::int as size, (select avg((c >= s)::int) from (select count(*) as c from {_GENERATED} group by (k & 4294967295::uhugeint) * 1000::uhugeint >> 32)) as measured, round((select sum({_PMF}) from range(s, 500) r(x)), 9) as p from range(100, 141, 10) q(s)")
def overflow_simulation(spark, d):
    """Share of 1,000 buckets of generated keys that hold a size or more, beside the tail's probability."""
    sizes = K.generated(spark, 100_000).groupBy(H.reduce_range(F.col("key"), 1000).alias("b")).agg(F.count("*").alias("c"))
    tried = sizes.withColumn("size", F.explode(F.array(*(F.lit(x) for x in range(100, 141, 10)))))
    p = spark.createDataFrame([(n, P.tail(100, n)) for n in range(100, 141, 10)], "size int, p double")
    return tried.groupBy("size").agg(F.avg((F.col("c") >= F.col("size")).cast("int")).alias("measured")).join(p, "size").withColumn("p", F.round("p", 9))


def _calls_sql() -> str:
    slots = f"select n, t, j, ({sql_mix64('(t * n + j)::uhugeint')} & 4294967295::uhugeint) * n::uhugeint >> 32 as slot from range(3, 7) s(n), range(20000) r(t), range(6) p(j) where j < n"
    tries = f"select n, t, coalesce(min(j) filter (again > 1), n - 1) + 1 as calls, count(*) filter (again > 1) = 0 as hit from (select *, row_number() over (partition by n, t, slot order by j) as again from ({slots})) group by n, t"
    expected = "select n, sum(exp(lgamma(n + 1) - lgamma(n - j + 1) - j * ln(n))) / any_value(exp(lgamma(n + 1) - n * ln(n))) as calls from range(3, 7) s(n), range(6) p(j) where j < n group by n"
    return f"select n::int as size, round(sum(m.calls) / sum(hit::int), 6) as measured, round(any_value(e.calls), 6) as expected from ({tries}) m join ({expected}) e using (n) group by n"


@query(_calls_sql())
def hash_calls_simulation(spark, d):
    """Hash calls for one leaf that fits, by 20,000 tries with generated keys each of which ends at its first collision, beside their expectation."""
    found = []
    for n in range(3, 7):
        slot = lambda j, n=n: H.reduce_range(H.mix64(F.col("id") * n + j), n)
        rows = H.with_wrapped(spark.range(20_000), slots=F.array(*(slot(j) for j in range(n))))
        clear = [F.size(F.array_distinct(F.slice("slots", 1, j))) == j for j in range(1, n + 1)]  # the first j keys don't collide
        calls = sum((c.cast("long") for c in clear[:-1]), F.lit(1))
        expected = P.leaf_calls(n)
        found.append(rows.agg(F.lit(n).alias("size"), F.round(F.sum(calls) / F.count_if(clear[-1]), 6).alias("measured"), F.lit(round(expected, 6)).alias("expected")))
    return functools.reduce(DataFrame.unionByName, found)


# ---- F: codes ----


@query("select p_partkey, k::int as k, repeat('1', (p_size >> k)::int) || '0' || case when k = 0 then '' else lpad(bin(p_size % (1 << k)), k::int, '0') end as word, ((p_size >> k) + 1 + k)::bigint as size from part, range(4) r(k)")
def rice_code_words(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_size")
    found = [part.select("p_partkey", F.lit(k).alias("k"), codes.rice_word(F.col("p_size"), k).alias("word"), codes.rice_size(F.col("p_size").cast("long"), k).alias("size")) for k in range(4)]
    return functools.reduce(DataFrame.unionByName, found)


@query("select o_orderkey, (length(bin(o_orderkey + 1)) - 1 + 2 * length(bin(length(bin(o_orderkey + 1)))) - 1)::int as size from orders")
def elias_delta_size(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", codes.elias_delta_size(F.col("o_orderkey") + 1).alias("size"))


@query("select o_orderkey, case when o_orderkey % 2 = 0 then o_orderkey else -o_orderkey end as x, case when o_orderkey % 2 = 0 and o_orderkey > 0 then 2 * o_orderkey - 1 else 2 * o_orderkey end as folded from orders")
def fold_unfold(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey")).alias("v"))
    rows = rows.withColumn("folded", codes.fold(F.col("v")))
    return rows.select("o_orderkey", codes.unfold(F.col("folded")).alias("x"), "folded")


@query("select o_orderkey, greatest(1, ceil(length(bin(o_orderkey)) / 7.0))::int as size from orders")
def var_long_size(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", codes.var_long_size(F.col("o_orderkey")).alias("size"))


@query("select c_custkey, i::int as i, ((c_custkey // pow(3, i)::bigint) % 3)::int as digit from customer, range(5) r(i)")
def base3_digits(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    return rows.withColumn("digit", codes.base3_digit(F.col("c_custkey"), F.col("i")))


@query("select c_custkey, i::int as i, digit as division, digit as loop, digit as product, digit as fraction from (select c_custkey, i, ((c_custkey // pow(3, i)::bigint) % 3)::int as digit from customer, range(5) r(i))")
def base3_variants(spark, d):
    """Digits by one division, by several, by one product and by two."""
    rows, value = _t(spark, d, "customer").select("c_custkey"), F.col("c_custkey")
    ways = lambda i: {"division": codes.base3_digit(value, F.lit(i)), "loop": codes.base3_digit_loop(value, i), "product": codes.base3_digit_product(value, i), "fraction": codes.base3_digit_fraction(value, i)}
    return functools.reduce(DataFrame.unionByName, (H.with_wrapped(rows, i=F.lit(i), **ways(i)) for i in range(5)))


@query("select c / 100.0::double as p, round(sum(-x * log2(x)), 6) as bits from (select c, c / 100.0::double * pow(1 - c / 100.0::double, k) as x from range(2, 100) p(c), range(3000) r(k)) where x > 0 group by c")
def geometric_entropy(spark, d):
    """Entropy of geometric distributions in closed form, against the sum over their values."""
    rows = spark.range(2, 100).select((F.col("id") / 100.0).alias("p"))
    return rows.select("p", F.round(codes.geometric_entropy(F.col("p")), 6).alias("bits"))


@query("select url, lower(hex(url)) as h from pages")
def hex_round_trip(spark, d):
    return _t(spark, d, "pages").select("url", codes.to_hex(codes.from_hex(codes.to_hex(F.col("url")))).alias("h"))


@query("select count(*) as n, 0::bigint as differences from orders")
def code_round_trip(spark, d):
    """Rice, Elias-delta and variable-length codes of every key, packed and read back in Arrow batches."""

    def back(column):
        values = column.to_pylist()
        buffer = codes.BitBuffer()
        for v in values:
            buffer.write_rice(8, v), buffer.write_elias_delta(v + 1), buffer.write_var_long(v)
        return pa.array([buffer.read_rice(8) == v and buffer.read_elias_delta() == v + 1 and buffer.read_var_long() == v for v in values])

    back.__annotations__ = {"column": pa.Array, "return": pa.Array}
    good = F.arrow_udf(back, "boolean")(F.col("o_orderkey"))
    return _t(spark, d, "orders").select(good.alias("g")).agg(F.count("*").alias("n"), F.sum((~F.col("g")).cast("long")).alias("differences"))


# ---- G: rank, select, lists ----

_BITS = "(select o_orderkey as pos, (o_orderstatus = 'F')::int as bit from orders)"


def _bits(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_orderstatus") == "F").cast("int").alias("bit"))


@query(f"select pos, coalesce(sum(bit) over (order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as rank, (2 * coalesce(sum(bit) over (order by pos rows between unbounded preceding and 1 preceding), 0) + bit)::bigint as rank_and_get from {_BITS}")
def rank_bits(spark, d):
    return succinct.rank(_bits(spark, d)).select("pos", "rank", "rank_and_get")


@query(f"select row_number() over (order by pos) - 1 as n, pos, lead(pos) over (order by pos) as next_pos from {_BITS} where bit = 1")
def select_bits(spark, d):
    return succinct.select(_bits(spark, d))


@query("select c_custkey, coalesce(list_filter(range(64), lambda i: (c_custkey >> i::int) & 1 = 1)[2], -1)::int as second_one from customer")
def select_in_word(spark, d):
    return _t(spark, d, "customer").select("c_custkey", succinct.select_in_word(F.col("c_custkey"), F.lit(1)).alias("second_one"))


_PREFIX = "(select row_number() over (order by l_orderkey) - 1 as i, (sum(count(*)) over (order by l_orderkey))::bigint as value from lineitem group by l_orderkey)"


def _prefix(spark, d):
    counts = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("c"), F.lit(1).alias("one"))
    counts = succinct.prefix_sum(succinct.prefix_sum(counts, "l_orderkey", "c", "before"), "l_orderkey", "one", "i")
    return as_table(counts.select(F.col("i").cast("long").alias("i"), (F.col("before") + F.col("c")).cast("long").alias("value")), "prefix")


@query(f"with v as {_PREFIX}, m as (select case when max(value) // count(*) > 0 then length(bin((max(value) // count(*))::bigint)) else 0 end as width from v) select i, (value % (1 << width))::bigint as low, (value >> width)::bigint as high, (i + (value >> width))::bigint as bit_pos from v, m")
def elias_fano_parts(spark, d):
    return succinct.elias_fano_parts(_prefix(spark, d)).select("i", "low", "high", "bit_pos")


@query(f"select i, value from {_PREFIX}")
def elias_fano_round_trip(spark, d):
    return succinct.elias_fano_values(as_table(succinct.elias_fano_parts(_prefix(spark, d)), "parts"))


@query(f"select i, value from {_PREFIX}")
def multistage_round_trip(spark, d):
    return succinct.multi_stage_values(succinct.multi_stage(_prefix(spark, d)))


# ---- J, K: sources, orders, signatures ----


@query("select count(*) as n, count(distinct text) as n_distinct, count(*) - count(distinct text) as duplicates from documents where text is not null")
def documents_dedupe(spark, d):
    return K.duplicate_report(_t(spark, d, "documents"), "text")


@query("select c_name, row_number() over (order by strlen(c_name), c_name)::int as position from customer")
def length_first_order(spark, d):
    """Rows dealt by ranges of the order, numbered within each; the ranges' sizes are summed over a row for each: no window spans the table."""
    names = _t(spark, d, "customer").select("c_name").withColumns({"len": F.octet_length("c_name"), "raw": F.col("c_name").cast("binary")})
    rows = names.repartitionByRange("len", "raw").sortWithinPartitions("len", "raw").withColumn("r", F.monotonically_increasing_id())
    rows = as_table(rows.select("c_name", F.shiftright("r", 33).alias("range"), F.col("r").bitwiseAND(F.lit((1 << 33) - 1)).alias("own")), "ordered")
    before = succinct.prefix_sum(rows.groupBy("range").agg(F.count("*").alias("c")), "range", "c", "before").select("range", "before")
    return rows.join(before, "range").select("c_name", (F.col("own") + F.col("before") + 1).cast("int").alias("position"))


@query("select count(*) as n, count(*) as distinct_keys, count(*) as distinct_pairs, count(*) - 1 as max_idx from (select distinct t from (select unnest(regexp_split_to_array(html, '\\s+')) as t from pages) where t <> '')")
def signature_mode(spark, d):
    """Tokens to 64-bit signatures to a function over them, and 128-bit ones that tell values apart."""
    tokens = as_table(K.tokens(_t(spark, d, "pages"), "html").distinct(), "tokens")
    keys = as_table(K.signatures(tokens, "key"), "signatures")
    model = R.build(keys, "key", R.Options(mode="fast", leaf_size=5, average_bucket_size=16))
    pairs = K.signatures128(tokens, "key").agg(F.countDistinct("high", "low").alias("distinct_pairs"))
    found = R.lookup(model, keys, "key").agg(F.count("*").alias("n"), F.countDistinct("key").alias("distinct_keys"), F.max("idx").alias("max_idx"))
    return found.crossJoin(F.broadcast(pairs)).select("n", "distinct_keys", "distinct_pairs", "max_idx")  # one row each


@query("select count(*) as n, count(*) as distinct_idx, 0::bigint as min_idx, count(*) - 1 as max_idx from (select distinct t from (select unnest(regexp_split_to_array(html, '\\s+')) as t from pages) where t <> '')")
def page_tokens_keys(spark, d):
    tokens = as_table(K.tokens(_t(spark, d, "pages"), "html").distinct(), "tokens")
    return R.check(R.lookup(R.build(tokens, "key"), tokens, "key"))


_MIXED = f"(select {sql_mix64('o_orderkey::uhugeint')} as u from orders)"


@query(f"select {sql_signed('u')} as key from {_MIXED}")
def signature_delta_round_trip(spark, d):
    keys = H.with_wrapped(_t(spark, d, "orders"), key=H.mix64(F.col("o_orderkey"))).select("key")
    return K.read_deltas(K.write_deltas(keys)).select("key")


@query(f"select {sql_signed('u')} as key from {_MIXED}")
def signature_rice_round_trip(spark, d):
    keys = H.with_wrapped(_t(spark, d, "orders"), key=H.mix64(F.col("o_orderkey"))).select("key")
    return K.read_deltas(K.write_deltas(keys, "rice"), "rice").select("key")


@query(f"select {sql_signed('u')} as key, (u - lag(u) over (order by u))::varchar as delta from {_MIXED}")
def signature_deltas(spark, d):
    keys = H.with_wrapped(_t(spark, d, "orders"), key=H.mix64(F.col("o_orderkey"))).select("key")
    return K.deltas(keys, "key").select("key", F.col("delta").cast("string").alias("delta"))


@query(f"select (u >> 61)::bigint as block, count(*) as n from {_MIXED} group by 1")
def signature_block_sizes(spark, d):
    keys = H.with_wrapped(_t(spark, d, "orders"), key=H.mix64(F.col("o_orderkey"))).select("key")
    n = keys.count()
    return K.signature_blocks(keys, "key", -(-n // 8)).groupBy("block").agg(F.count("*").alias("n"))


@query("select count(*) as n, count(*) as n_distinct from range(100000)")
def generated_keys(spark, d):
    return K.generated(spark, 100_000, 7).agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_distinct"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql() if callable(sql) else sql for name, sql in SQL.items()}
