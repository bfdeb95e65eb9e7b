import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions import codes as C
from keyloom.functions import succinct as S


def test_words(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 7, 15)], "v long")
    words = {r.v: r for r in df.select("v", *(C.rice_word(F.col("v"), k).alias(f"k{k}") for k in range(4)), C.elias_delta_word(F.col("v")).alias("d"), C.elias_delta_size(F.col("v")).alias("s")).collect()}
    assert [words[v].k0 for v in (0, 1, 2)] == ["0", "10", "110"]
    assert [words[v].k1 for v in (0, 1, 2)] == ["00", "01", "100"]
    assert words[15].k2 == "111011" and words[15].k3 == "10111"
    assert [words[v].d for v in (1, 2, 3, 4, 7)] == ["1", "0100", "0101", "01100", "01111"]
    assert words[0].d is None and all(words[v].s == len(words[v].d) for v in (1, 2, 3, 4, 7))


@given(st.lists(st.integers(0, 5000), max_size=50), st.integers(0, 6))
@settings(max_examples=50, deadline=None)
def test_round_trips(values, k):
    b = C.BitBuffer()
    for v in values:
        b.write_rice(k, v), b.write_elias_delta(v + 1), b.write_var_long(v), b.write_number(v, 13)
    b = C.BitBuffer(b.to_bytes())
    for v in values:
        assert (b.read_rice(k), b.read_elias_delta(), b.read_var_long(), b.read_number(13)) == (v, v + 1, v, v)


def test_fold():
    assert [C.py_fold(x) for x in (0, 1, -1)] == [0, 1, 2]
    assert all(C.py_unfold(C.py_fold(x)) == x for x in range(-50, 50))
    with pytest.raises(ValueError):
        C.BitBuffer().write_elias_delta(0)


def test_rank_select_exhaustive():
    rng = np.random.default_rng(1)
    for n in [*range(0, 140), 511, 512, 513, 2000]:
        for share in (0.0, 0.1, 0.5, 1.0):
            bits = rng.random(n) < share
            r = S.RankBits(bits)
            ones = np.flatnonzero(bits)
            assert [r.select(i) for i in range(len(ones))] == ones.tolist() and r.select(len(ones)) == -1
            assert all(r.rank(x) == bits[:x].sum() and r.get(x) == bits[x] for x in range(n))
            assert not r.get(n + 5) and r.read_bits() == 144
            for kind in (S.InventorySelect, S.BlockSelect):
                assert [kind(bits).select(i) for i in range(-1, len(ones) + 1)] == [-1, *ones.tolist(), -1]
            again, _ = S.BlockSelect.read(S.BlockSelect(bits).to_bytes(), 0)
            assert [again.select(i) for i in range(len(ones))] == again.all().tolist() == ones.tolist()


def test_select_of_sparse_bits():
    bits = np.zeros(400_000, bool)
    bits[[3, 70_000, 70_001, 399_999]] = True
    dense = np.concatenate([np.ones(5000, bool), bits, np.ones(3000, bool)])
    ones = np.flatnonzero(dense)
    for kind in (S.InventorySelect, S.BlockSelect):
        s = kind(dense)
        assert [s.select(i) for i in range(0, len(ones), 7)] == ones[::7].tolist() and s.select_pair(4999) == (4999, 5003)
    assert S.InventorySelect(dense).far


def test_packed_sizes():
    v = np.cumsum(np.random.default_rng(5).integers(90, 110, 10_000))
    fano, stages = S.EliasFanoList(v), S.MultiStageList(v)
    assert len(fano.to_bytes()) * 8 < fano.size_bits() + 1000 and len(stages.to_bytes()) * 8 < stages.size_bits() + 1000
    assert fano.size_bits() < 10_000 * 11 and stages.size_bits() < 10_000 * 12
    assert (fano.all() == v).all() and (stages.all() == v).all() and (S.Packed.of(v).all() == v).all()
    assert len(S.EliasFanoList([]).all()) == len(S.MultiStageList([]).all()) == 0


def test_array_codes():
    rng = np.random.default_rng(6)
    streams = [(rng.integers(0, 3000, n), rng.integers(0, 9, n)) for n in (0, 1, 5, 300)]
    packed = [C.pack_rice(v, k) for v, k in streams]
    starts = 8 * np.cumsum([0, *(len(b) for b, _ in packed)])[:-1]
    for found, (v, _) in zip(C.unpack_rice(b"".join(b for b, _ in packed), [k for _, k in streams], starts), streams):
        assert found.tolist() == v.tolist()
    b = C.BitBuffer(packed[3][0])
    assert [b.read_rice(int(k)) for k in streams[3][1]] == streams[3][0].tolist()
    u = np.concatenate([rng.integers(0, 1 << 63, 500).astype(np.uint64), np.array([0, 127, 128, (1 << 64) - 1], np.uint64)])
    assert (C.unpack_var_longs(C.pack_var_longs(u)) == u).all() and len(C.unpack_var_longs(b"")) == 0
    assert (C.unpack_rice_apart(C.pack_rice_apart(u, 59), 59, len(u)) == u).all() and len(C.unpack_rice_apart(b"", 4, 0)) == 0


def test_bit_buffer():
    b = C.BitBuffer()
    b.write_number(0b1011, 4)
    assert b.to_bytes() == b"\xb0"
    b.write_bit(1), b.write_number(3, 7)
    other = C.BitBuffer()
    other.write_rice(2, 9), other.write_elias_delta(5)
    b.write(other)
    assert (b.read_number(4), b.read_bit(), b.read_number(7), b.read_rice(2), b.read_elias_delta()) == (0b1011, 1, 3, 9, 5) and len(b) == b.pos
    b.seek(0), b.clear_bits(4)
    assert b.read_number(5) == 1
    b.clear()
    assert len(b) == 0 and b.to_bytes() == b""


def test_lists():
    rng = np.random.default_rng(2)
    for n in (1, 2, 10, 1000):
        v = np.cumsum(rng.integers(0, 50, n))
        lists = [S.EliasFanoList(v), S.MultiStageList(v)]
        for lst in (*lists, *(type(x).from_bytes(x.to_bytes()) for x in lists), S.FenwickList(v)):
            assert [lst.get(i) for i in range(n)] == v.tolist()
            assert n < 2 or lst.get_pair(0) == (v[0], v[1])
    w = rng.integers(0, 1000, 100)
    assert [S.ValueList(w).get(i) for i in range(100)] == w.tolist()


def test_frames(spark):
    rng = np.random.default_rng(3)
    v = np.cumsum(rng.integers(0, 9, 300)).tolist()
    df = spark.createDataFrame(list(enumerate(v)), "i long, value long")
    assert sorted(map(tuple, S.elias_fano_values(S.elias_fano_parts(df)).collect())) == list(enumerate(v))
    assert sorted(map(tuple, S.multi_stage_values(S.multi_stage(df)).collect())) == list(enumerate(v))
    bits = spark.createDataFrame([(i, int(x % 3 == 0)) for i, x in enumerate(v)], "pos long, bit int")
    want = np.concatenate([[0], np.cumsum([x % 3 == 0 for x in v])])[:-1].tolist()
    got = {r.pos: r.rank for r in S.prefix_sum(bits, "pos", "bit", "rank", block=16).collect()}
    assert [got[i] for i in range(300)] == want


def test_select_in_word(spark):
    df = spark.createDataFrame([(0b10110,), (0,), (-1,)], "w long")
    assert [r[0] for r in df.select(S.select_in_word(F.col("w"), F.lit(1))).collect()] == [2, -1, 1]
    assert [r[0] for r in df.select(S.select_in_word_msb(F.col("w"), F.lit(0))).collect()] == [59, -1, 0]


def test_base3_of_long_values(spark):
    values = [0, 3**39 - 1, 2**63 - 1, 2**62 + 12345]
    rows = spark.createDataFrame([(v, i) for v in values for i in range(39)], "v long, i int").select("v", "i", C.base3_digit(F.col("v"), F.col("i")).alias("d"))
    assert all(r.d == r.v // 3**r.i % 3 for r in rows.collect())
