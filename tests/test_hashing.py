import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.functions import hashing as H

MASK = (1 << 64) - 1


def py_mix64(x):
    x = (x ^ x >> 30) * H.M1 & MASK
    x = (x ^ x >> 27) * H.M2 & MASK
    return x ^ x >> 31


def rows(data: bytes):
    return np.frombuffer(data, np.uint8).reshape(1, -1)


def test_mix_and_inverse(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901234567]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    df = H.with_wrapped(df, h=H.mix64(F.col("x")))
    df = H.with_wrapped(df, back=H.unmix64(F.col("h")), low=H.mix32(F.col("x")))
    got = df.collect()
    assert [r.back for r in got] == values
    assert [r.h & MASK for r in got] == [py_mix64(v & MASK) for v in values]
    assert H.np_mix64(np.array(values).view(np.uint64)).tolist() == [py_mix64(v & MASK) for v in values]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_mix32_inverse(spark):
    values = [0, 1, -1, 2**31 - 1, -(2**31), 77]
    df = spark.createDataFrame([(v,) for v in values], "x long").select("x", H.unmix32(H.mix32(F.col("x"))).alias("b"))
    assert all(r.x == r.b for r in df.collect())


def test_published_vectors():
    # SipHash-2-4's reference key and messages, MurmurHash3's and xxHash's well-known values
    key = bytes(range(16))
    k0, k1 = (int.from_bytes(key[i : i + 8], "little") for i in (0, 8))
    assert int(H.siphash24(rows(bytes(range(15))), k0, k1)[0]) == 0xA129CA6149BE45E5
    assert int(H.murmur3_32(rows(b"test"), 0)[0]) == 0xBA6BD213
    assert int(H.murmur3_32(rows(b"Hello, world!"), 0)[0]) == 0xC0363E43
    h1, h2 = H.murmur3_128(rows(b"The quick brown fox jumps over the lazy dog"))
    assert (int(h1[0]), int(h2[0])) == (0xE34BBC7BBC071B6C, 0x7A433CA9C49A9347)


@pytest.mark.parametrize(
    ("kernel", "size", "published"),
    [
        (H.murmur2_32, 4, 0x27864C1E),
        (H.murmur2_64, 8, 0x1F0D3804),
        (H.murmur3_32, 4, 0xB0F57EE3),
        (lambda r, seed: np.concatenate(H.murmur3_128(r, seed)), 16, 0x6384BA69),
    ],
)
def test_published_verification_codes(kernel, size, published):
    """The published code of a hash: of the texts 0, 1, ... of every length below 256 under falling seeds, and of those hashes together."""
    words = size if size < 8 else 8
    hashed = lambda data, seed: b"".join(int(h).to_bytes(words, "little") for h in kernel(rows(data) if data else np.zeros((1, 0), np.uint8), seed))
    whole = b"".join(hashed(bytes(range(n)), 256 - n) for n in range(256))
    assert int.from_bytes(hashed(whole, 0)[:4], "little") == published


def test_siphash_halves():
    data = np.arange(150, dtype=np.uint8).reshape(10, 15)
    high, low = H.siphash24_pair(data, 3, 5)
    assert ((high ^ low) == H.siphash24(data, 3, 5)).all() and len(set(high.tolist())) == 10


def test_counted(spark):
    count = spark.sparkContext.accumulator(0)
    kernel = H.counted(lambda r: H.siphash24(r, 1, 1), count)

    def run(batches):
        for b in batches:
            kernel(np.zeros((b.num_rows, 4), np.uint8))
            yield b

    assert spark.range(1000).mapInArrow(run, "id long").count() == 1000 and count.value == 1000


@pytest.mark.parametrize("name", sorted(H.KERNELS))
def test_kernels_by_length(spark, name):
    values = ["", "a", "abcdefg", "abcdefgh", "x" * 31, "y" * 32, "z" * 100, "é", None]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", H.hash_bytes(name, F.col("v"), 3).alias("h"))
    got = {r.v: r.h for r in df.collect()}
    assert got[None] is None
    one = {v: int(H.by_length([v.encode()], H.KERNELS[name](3)).view(np.int64)[0]) for v in values if v is not None}
    assert {k: v for k, v in got.items() if k is not None} == one
    if name == "xxhash64":
        assert got["a"] & MASK == xxhash.xxh64_intdigest(b"a", 3)


def test_inverse64():
    for x in (1, 3, H.M1, H.M2):
        assert x * H.inverse64(x) & MASK == 1
    assert H.inverse64(H.M1) == H.M1_INVERSE and H.inverse64(H.M2) == H.M2_INVERSE


@pytest.mark.parametrize("bits", [16, 32, 44])
def test_bijections(spark, bits):
    n = 1 << 16
    df = H.with_wrapped(spark.range(n), h=H.bijection(F.col("id"), bits))
    r = df.agg(F.countDistinct("h").alias("n"), F.max("h").alias("m"), F.min("h").alias("l")).first()
    assert r.n == n and r.l >= 0 and r.m < 1 << bits


def test_long_hash_differs_by_index():
    x = np.arange(1000, dtype=np.uint64)
    assert len({*H.long_hash(x, 0).tolist(), *H.long_hash(x, 1).tolist()}) == 2000
