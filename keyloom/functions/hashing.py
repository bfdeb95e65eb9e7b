"""Hash and mixing functions: native columns where the arithmetic allows, numpy kernels behind Arrow functions elsewhere.

Columns wrap modulo 2**64, which ANSI mode forbids; ``wrapping(spark)`` switches it off while a plan is built, and
``with_wrapped`` adds columns under it. Kernels take matrices of equally long byte strings, a row for each value.
"""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64

# Multipliers of the published finalisers and mixers, and the inverses of two of them.
M1, M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
M1_INVERSE, M2_INVERSE = 0x96DE1B173F119089, 0x319642B2D24D8EC3
MIX32, MIX32_INVERSE = 0x45D9F3B, 0x119DE1F3
SIP = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)
MURMUR2_32, MURMUR2_64 = 0x5BD1E995, 0xC6A4A7935BD1E995
MURMUR3_32 = (0xCC9E2D51, 0x1B873593)
MURMUR3_128 = (0x87C37B91114253D5, 0x4CF5AD432745937F)
SPOOKY = 0xDEADBEEFDEADBEEF


# ---- native columns ----

_MODE = threading.RLock()


@contextlib.contextmanager
def wrapping(spark: SparkSession):
    """ANSI mode off while columns are resolved; expressions keep the mode that they were made under. One thread at a time, so that the mode before comes back."""
    with _MODE:
        before = spark.conf.get("spark.sql.ansi.enabled")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        try:
            yield
        finally:
            spark.conf.set("spark.sql.ansi.enabled", before)


def with_wrapped(df: DataFrame, **columns: Column) -> DataFrame:
    with wrapping(df.sparkSession):
        return df.withColumns(columns)


def signed(x: int, bits: int = 64) -> int:
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> (bits - 1) else x


def _c(x: int) -> Column:
    return F.lit(signed(x)).cast("long")


def _xs(x: Column, *shifts: int) -> Column:
    out = x
    for s in shifts:
        out = out.bitwiseXOR(F.shiftrightunsigned(x, s))
    return out


def low32(x: Column) -> Column:
    return x.bitwiseAND(_c(0xFFFFFFFF))


def int32(x: Column) -> Column:
    """The low 32 bits as a signed number."""
    low = low32(x)
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def mix64(x: Column) -> Column:
    x = _xs(x.cast("long"), 30) * _c(M1)
    return _xs(_xs(x, 27) * _c(M2), 31)


def unmix64(x: Column) -> Column:
    x = _xs(x, 31, 62) * _c(M2_INVERSE)
    return _xs(_xs(x, 27, 54) * _c(M1_INVERSE), 30, 60)


def _mix32(x: Column, factor: int) -> Column:
    x = low32(_xs(low32(x), 16) * factor)
    return _xs(low32(_xs(x, 16) * factor), 16)


def mix32(x: Column) -> Column:
    """On the low 32 bits; products stay below 2**63, so it needs no wrapping."""
    return int32(_mix32(x.cast("long"), MIX32))


def unmix32(x: Column) -> Column:
    return int32(_mix32(x.cast("long"), MIX32_INVERSE))


def weyl(x: Column, index: Column) -> Column:
    """A cheap supplemental hash: low 32 bits, signed."""
    x = x + index * _c(M1)
    return int32(_xs(_xs(x, 32) * _c(M1), 32))


def supplemental(x: Column, index: Column) -> Column:
    return int32(mix64(x + index))


def supplemental_shift(x: Column, index: Column) -> Column:
    x = x + index * _c(M1)
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = _xs(x, 17)
    return int32(x.bitwiseXOR(F.shiftleft(x, 5)))


def _rotated(x: Column, index: Column) -> Column:
    by = index.bitwiseAND(_c(63)).cast("int")
    left, right = F.call_function("shiftleft", x, by), F.call_function("shiftrightunsigned", x, (64 - by).cast("int"))
    return F.when(by == 0, x).otherwise(left.bitwiseOR(right))


def supplemental_int(x: Column, index: Column) -> Column:
    return int32(_mix32(_rotated(x, index).bitwiseXOR(index), MIX32))


def cuckoo_slot(x: Column, index: Column, size: int) -> Column:
    """A scaled 32-bit mix."""
    return supplemental_int(x, index).bitwiseAND(_c(0x7FFFFFFF)) % size


def supplemental128(high: Column, low: Column, index: Column) -> Column:
    return mix64(high * (index + 1) + low)


def rotate_xor(x: Column, index: Column) -> Column:
    """A hash of two steps, to measure what a cheaper one would gain; not for real use."""
    return _rotated(x, index).bitwiseXOR(F.shiftrightunsigned(x, 16))


def reduce_range(x: Column, n: int | Column) -> Column:
    """The low 32 bits scaled to 0..n-1 by a product and a shift; n < 2**31."""
    return F.shiftrightunsigned(low32(x) * n, 32)


def bijection(x: Column, bits: int) -> Column:
    """Bijective mixers of 16, 32, 44 and 64 bits; the first three need wrapping as well."""
    if bits == 64:
        return mix64(x)
    a, b, c = {16: (7, 5, 9), 32: (16, 16, 16), 44: (20, 17, 21)}[bits]
    mask = _c((1 << bits) - 1)
    x = (_xs(x.cast("long"), a) * _c(M1)).bitwiseAND(mask)
    return _xs((_xs(x, b) * _c(M2)).bitwiseAND(mask), c).bitwiseAND(mask)


def unsigned_order(x: Column) -> Column:
    """Sorts 64-bit values as unsigned ones."""
    return x.bitwiseXOR(_c(1 << 63))


def inverse64(x: int) -> int:
    """The multiplicative inverse of an odd number modulo 2**64, by Newton's steps: each doubles the right bits."""
    y = x
    for _ in range(5):
        y = y * (2 - x * y) & (1 << 64) - 1
    return y


# ---- kernels ----


def np_mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(M1)
    x = (x ^ (x >> U(27))) * U(M2)
    return x ^ (x >> U(31))


def np_supplemental(x: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Low 32 bits of the mixed sum, as in ``supplemental``, unsigned; in place, as searching spends its time here."""
    x = x + index
    for shift, factor in ((30, M1), (27, M2)):
        x ^= x >> U(shift)
        x *= U(factor)
    x ^= x >> U(31)
    x &= U(0xFFFFFFFF)
    return x


def np_reduce(low: np.ndarray, n) -> np.ndarray:
    out = low & U(0xFFFFFFFF)
    out *= U(n)
    out >>= U(32)
    return out


def rotl(x: np.ndarray, r: int, bits: int = 64) -> np.ndarray:
    if bits == 64:
        return (x << U(r)) | (x >> U(64 - r))
    return ((x << U(r)) | (x >> U(bits - r))) & U((1 << bits) - 1)


def _sip_rounds(v: list[np.ndarray], rounds: int) -> None:
    for _ in range(rounds):
        v[0], v[2] = v[0] + v[1], v[2] + v[3]
        v[1], v[3] = rotl(v[1], 13) ^ v[0], rotl(v[3], 16) ^ v[2]
        v[0] = rotl(v[0], 32)
        v[2], v[0] = v[2] + v[1], v[0] + v[3]
        v[1], v[3] = rotl(v[1], 17) ^ v[2], rotl(v[3], 21) ^ v[0]
        v[2] = rotl(v[2], 32)


def long_hash(x: np.ndarray, index: int) -> np.ndarray:
    """The universal hash of 64-bit keys: one block of four rounds, without a length."""
    v = [np.full(len(x), U((index ^ s) & (1 << 64) - 1)) for s in SIP]
    v[3] ^= x
    _sip_rounds(v, 4)
    return v[0] ^ x ^ v[1] ^ v[2] ^ v[3]


def _words(rows: np.ndarray, size: int) -> np.ndarray:
    """Whole little-endian words of each row, as 64-bit numbers."""
    n = rows.shape[1] // size
    return np.ascontiguousarray(rows[:, : n * size]).view(f"<u{size}").reshape(len(rows), n).astype(U)


def _tail(rows: np.ndarray, done: int) -> np.ndarray:
    out = np.zeros(len(rows), U)
    for i in range(done, rows.shape[1]):
        out |= rows[:, i].astype(U) << U(8 * (i - done))
    return out


def _siphash24(rows: np.ndarray, k0: int, k1: int) -> list[np.ndarray]:
    n = rows.shape[1]
    v = [np.full(len(rows), U((k ^ s) & (1 << 64) - 1)) for k, s in zip((k0, k1, k0, k1), SIP)]
    last = _tail(rows, n // 8 * 8) | U((n & 255) << 56)
    for m in [*_words(rows, 8).T, last]:
        v[3] ^= m
        _sip_rounds(v, 2)
        v[0] ^= m
    v[2] ^= U(0xFF)
    _sip_rounds(v, 4)
    return v


def siphash24(rows: np.ndarray, k0: int, k1: int) -> np.ndarray:
    v = _siphash24(rows, k0, k1)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def siphash24_pair(rows: np.ndarray, k0: int, k1: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the same rounds: both halves of the last state, whose sum is the 64-bit hash."""
    v = _siphash24(rows, k0, k1)
    return v[0] ^ v[1], v[2] ^ v[3]


def murmur2_32(rows: np.ndarray, seed: int = 0) -> np.ndarray:
    mask, n = U(0xFFFFFFFF), rows.shape[1]
    h = np.full(len(rows), U((seed ^ n) & 0xFFFFFFFF))
    for k in _words(rows, 4).T:
        k = k * U(MURMUR2_32) & mask
        k = (k ^ (k >> U(24))) * U(MURMUR2_32) & mask
        h = h * U(MURMUR2_32) & mask ^ k
    if n % 4:
        h = (h ^ _tail(rows, n // 4 * 4)) * U(MURMUR2_32) & mask
    h = (h ^ (h >> U(13))) * U(MURMUR2_32) & mask
    return h ^ (h >> U(15))


def murmur2_64(rows: np.ndarray, seed: int = 0) -> np.ndarray:
    m, n = U(MURMUR2_64), rows.shape[1]
    h = np.full(len(rows), U((seed ^ n * MURMUR2_64) & (1 << 64) - 1))
    for k in _words(rows, 8).T:
        k = k * m
        h = (h ^ (k ^ (k >> U(47))) * m) * m
    if n % 8:
        h = (h ^ _tail(rows, n // 8 * 8)) * m
    h = (h ^ (h >> U(47))) * m
    return h ^ (h >> U(47))


def fmix32(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(16))) * U(0x85EBCA6B) & U(0xFFFFFFFF)
    h = (h ^ (h >> U(13))) * U(0xC2B2AE35) & U(0xFFFFFFFF)
    return h ^ (h >> U(16))


def murmur3_32(rows: np.ndarray, seed: int = 0) -> np.ndarray:
    c1, c2, mask = U(MURMUR3_32[0]), U(MURMUR3_32[1]), U(0xFFFFFFFF)
    scrambled = lambda k: rotl(k * c1 & mask, 15, 32) * c2 & mask
    h = np.full(len(rows), U(seed & 0xFFFFFFFF))
    for k in _words(rows, 4).T:
        h = (rotl(h ^ scrambled(k), 13, 32) * U(5) + U(0xE6546B64)) & mask
    if rows.shape[1] % 4:
        h = h ^ scrambled(_tail(rows, rows.shape[1] // 4 * 4))
    return fmix32(h ^ U(rows.shape[1]))


def _fmix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def murmur3_128(rows: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    c1, c2, n = U(MURMUR3_128[0]), U(MURMUR3_128[1]), rows.shape[1]
    h1 = h2 = np.full(len(rows), U(seed))
    done = n // 16 * 16
    words = _words(rows[:, :done], 8).T
    for k1, k2 in zip(words[::2], words[1::2]):
        h1 = (rotl(h1 ^ rotl(k1 * c1, 31) * c2, 27) + h2) * U(5) + U(0x52DCE729)
        h2 = (rotl(h2 ^ rotl(k2 * c2, 33) * c1, 31) + h1) * U(5) + U(0x38495AB5)
    if n > done + 8:
        h2 = h2 ^ rotl(_tail(rows, done + 8) * c2, 33) * c1
    if n > done:
        h1 = h1 ^ rotl(_tail(rows[:, : done + 8], done) * c1, 31) * c2
    h1, h2 = h1 ^ U(n), h2 ^ U(n)
    h1 = h1 + h2
    h2 = h2 + h1
    h1, h2 = _fmix64(h1), _fmix64(h2)
    h1 = h1 + h2
    return h1, h2 + h1


# Rotations of the short form's mixing and end.
_SPOOKY_MIX = (50, 52, 30, 41, 54, 48, 38, 37, 62, 34, 5, 36)
_SPOOKY_END = (15, 52, 26, 51, 28, 9, 47, 54, 32, 25, 63)


def spooky128(rows: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The short form over whole blocks of 32 bytes; a shorter rest counts in the length only."""
    n = rows.shape[1]
    s = [np.full(len(rows), U(x)) for x in (seed, seed, SPOOKY, SPOOKY)]
    words = _words(rows[:, : n // 32 * 32], 8).T
    for i in range(0, len(words), 4):
        s[2], s[3] = s[2] + words[i], s[3] + words[i + 1]
        for j, r in enumerate(_SPOOKY_MIX):
            x, y, z = (j + 2) % 4, (j + 3) % 4, j % 4
            s[x] = rotl(s[x], r) + s[y]
            s[z] = s[z] ^ s[x]
        s[0], s[1] = s[0] + words[i + 2], s[1] + words[i + 3]
    # the length is shifted as a 32-bit number, whose shifts count modulo 32
    length = signed(n << 24, 32) & (1 << 64) - 1
    s[2], s[3] = s[2] + U(SPOOKY), s[3] + U(length) + U(SPOOKY)
    for j, r in enumerate(_SPOOKY_END):
        x, y = (j + 3) % 4, (j + 2) % 4
        s[x] = s[x] ^ s[y]
        s[y] = rotl(s[y], r)
        s[x] = s[x] + s[y]
    return s[0], s[1]


def by_length(values: list[bytes], kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A kernel over byte strings of any lengths: those of one length at a time."""
    out = np.zeros(len(values), U)
    lengths = np.array([len(v) for v in values])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        rows = np.frombuffer(b"".join(values[i] for i in at), np.uint8).reshape(len(at), n)
        out[at] = kernel(rows)
    return out


def _xxhash64(seed: int):
    def kernel(rows):
        import xxhash

        return np.array([xxhash.xxh64_intdigest(r.tobytes(), seed) for r in rows], U)

    return kernel


def text_hash(rows: np.ndarray, index: int) -> np.ndarray:
    """The universal hash of text slices: the second key is 0, unlike that of strings."""
    return siphash24(rows, index, 0)


KERNELS: dict[str, Callable] = {
    "siphash": lambda seed: lambda rows: siphash24(rows, seed, seed),
    "siphash_high": lambda seed: lambda rows: siphash24_pair(rows, seed, seed)[0],
    "siphash_low": lambda seed: lambda rows: siphash24_pair(rows, seed, seed)[1],
    "siphash_text": lambda seed: lambda rows: text_hash(rows, seed),
    "murmur2_32": lambda seed: lambda rows: murmur2_32(rows, seed),
    "murmur2_64": lambda seed: lambda rows: murmur2_64(rows, seed),
    "murmur3_64": lambda seed: lambda rows: murmur2_64(rows, seed),
    "murmur3_32": lambda seed: lambda rows: murmur3_32(rows, seed),
    "murmur3_128_high": lambda seed: lambda rows: murmur3_128(rows, seed)[0],
    "murmur3_128_low": lambda seed: lambda rows: murmur3_128(rows, seed)[1],
    "spooky_high": lambda seed: lambda rows: spooky128(rows, seed)[0],
    "spooky_low": lambda seed: lambda rows: spooky128(rows, seed)[1],
    "xxhash64": _xxhash64,
}


def hash_bytes(name: str, value: Column, seed: int = 0) -> Column:
    """A hash of a string or binary column as a signed 64-bit number, in Arrow batches; nulls stay."""
    import pyarrow as pa

    def run(column: pa.Array) -> pa.Array:
        values = column.to_pylist()
        known = [v for v in values if v is not None]
        found = iter(by_length(known, KERNELS[name](seed)).view(np.int64).tolist())
        return pa.array([None if v is None else next(found) for v in values], pa.int64())

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "long")(value.cast("string").cast("binary"))


def counted(kernel: Callable[[np.ndarray], np.ndarray], count) -> Callable[[np.ndarray], np.ndarray]:
    """A kernel that adds the values it hashes to an accumulator, to measure how many calls a plan makes."""

    def run(rows):
        count.add(len(rows))
        return kernel(rows)

    return run


def key_hashes(column, index: int, kind: str) -> np.ndarray:
    """Universal hashes of an Arrow array of keys: kind is long, string or text."""
    if kind == "long":
        return long_hash(column.to_numpy(zero_copy_only=False).astype(np.int64).view(U), index)
    second = 0 if kind == "text" else index  # text slices have a second key of 0
    return by_length([v if isinstance(v, bytes) else v.encode() for v in column.to_pylist()], lambda rows: siphash24(rows, index, second))
