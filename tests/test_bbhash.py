import collections

import __spark_entry__
from keyloom.functions import hashing as H
from keyloom.operators import other as O

SF = "/root/testdata/sf0.001"
WIDE = (1 << 64) - 1


def mix64(x):
    x = (x ^ x >> 30) * int(H.M1) & WIDE
    x = (x ^ x >> 27) * int(H.M2) & WIDE
    return x ^ x >> 31


def by_force(keys, most=None):
    """Keys placed on each level by plain loops, until none is left or for ``most`` levels; None counts those left."""
    out, rest, level = {}, set(keys), 0
    while rest and level != most:
        size = max(1, int(len(rest) * 2.0))
        slot = {k: (mix64(k + level & WIDE) & 0xFFFFFFFF) * size >> 32 for k in rest}
        taken = collections.Counter(slot.values())
        alone = {k for k in rest if taken[slot[k]] == 1}
        if alone:
            out[level] = len(alone)
        rest -= alone
        level += 1
    return out | {None: len(rest)}


def test_every_level_is_counted(spark):
    keys = [r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()]
    found = {r.level: r.placed for r in __spark_entry__.queries()["bbhash_level_counts"](spark, SF).collect()}
    assert found == by_force(keys) and max(k for k in found if k is not None) >= 4 and sum(found.values()) == len(keys)


def test_keys_left_are_counted(spark):
    levels = O.bbhash_levels(spark.range(500).withColumnRenamed("id", "k"), "k", most=2)
    found = {r.level: r.placed for r in O.bbhash_counts(levels).collect()}
    assert found == by_force(range(500), 2) and found[None] > 0
