"""Bit codes: native columns for code words and sizes, and a bit buffer for whole descriptions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- native columns ----


def rice_word(value: Column, k: int) -> Column:
    """Golomb-Rice: the quotient in ones, a zero, k low bits."""
    low = F.lpad(F.bin(value.cast("long") % (1 << k)), k, "0") if k else F.lit("")
    return F.concat(F.repeat(F.lit("1"), F.shiftright(value.cast("long"), k).cast("int")), F.lit("0"), low)


def rice_size(value: Column, k: int) -> Column:
    return F.shiftright(value.cast("long"), k) + 1 + k


def elias_delta_size(value: Column) -> Column:
    """Of values from 1 on; null below."""
    length = F.length(F.bin(value))
    return F.when(value >= 1, (length - 1) + 2 * F.length(F.bin(length.cast("long"))) - 1)


def elias_delta_word(value: Column) -> Column:
    binary = F.bin(value)
    length = F.bin(F.length(binary).cast("long"))
    zeros = F.repeat(F.lit("0"), F.length(length) - 1)
    return F.when(value >= 1, F.concat(zeros, length, F.substring(binary, 2, 64)))


def fold(value: Column) -> Column:
    """Signed to unsigned: positive numbers become odd, others even."""
    return F.when(value > 0, value * 2 - 1).otherwise(value * -2)


def unfold(value: Column) -> Column:
    return F.when(value % 2 == 1, (value + 1) / 2).otherwise(value / -2).cast("long")


def var_long_size(value: Column) -> Column:
    """Bytes of seven bits that an unsigned 64-bit number takes."""
    return F.when(value < 0, 10).otherwise(F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7))).cast("int")


def base3_digit(value: Column, i: Column) -> Column:
    """Digit ``i`` from below, by whole-number division, so exact for every value >= 0."""
    powers = F.array(*(F.lit(3**j).cast("long") for j in range(40)))
    return (F.call_function("div", value, F.get(powers, i)) % 3).cast("int")


def base3_digit_loop(value: Column, i: int) -> Column:
    """The same by ``i`` divisions, one after another."""
    for _ in range(i):
        value = ((value - value % 3) / 3).cast("long")
    return (value % 3).cast("int")


def base3_digit_product(value: Column, i: int) -> Column:
    """The same by a product and a shift instead of the division; 0 <= value < 2**31, i < 20."""
    power = 3**i
    bits = 31 + power.bit_length()
    quotient = F.shiftrightunsigned(value.cast("long") * F.lit((1 << bits) // power + 1), bits) if i else value
    return (quotient % 3).cast("int")


def base3_digit_fraction(value: Column, i: int) -> Column:
    """The same by two products: the fraction that is left of value / 3**(i + 1), in 62 bits, times 3. value * 3**(i + 1) < 2**62; needs wrapping."""
    left = (value.cast("long") * F.lit((1 << 62) // 3 ** (i + 1) + 1)).bitwiseAND(F.lit((1 << 62) - 1))
    return F.shiftrightunsigned(left * 3, 62).cast("int")


def rice_parameter(p: Column) -> Column:
    """The best number of low bits for a geometric distribution, by the golden-ratio rule."""
    golden = (5**0.5 + 1) / 2
    return F.greatest(F.lit(0), 1 + F.floor(F.log2(F.log(F.lit(golden - 1)) / F.log1p(-p)))).cast("int")


def rice_parameter_of_mean(mean: Column) -> Column:
    golden = (5**0.5 + 1) / 2
    return F.greatest(F.lit(0), 1 + F.floor(F.log2(F.log(F.lit(golden - 1)) / F.log(mean / (mean + 1))))).cast("int")


def rice_mean_bits(k: Column, p: Column) -> Column:
    return k + 1 / (1 - F.pow(1 - p, F.pow(F.lit(2.0), k)))


def geometric_entropy(p: Column) -> Column:
    return (-(1 - p) * F.log2(1 - p) - p * F.log2(p)) / p


def to_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def from_hex(value: Column) -> Column:
    return F.unhex(value)


# ---- bytes ----


class BitBuffer:
    """Bits in order, first one highest, held as bytes; ``pos`` is where the next one is read."""

    def __init__(self, data: bytes = b"", bits: int | None = None):
        self.data, self.held, self.held_bits = bytearray(data), 0, 0
        self.size, self.pos = 8 * len(data) if bits is None else bits, 0

    def __len__(self) -> int:
        return self.size

    def to_bytes(self) -> bytes:
        self._flush()
        return bytes(self.data)

    def _flush(self) -> None:
        """Held bits to the bytes; the last byte is filled with zeros and taken up again by the next bits."""
        if self.held_bits:
            fill = -self.held_bits % 8
            self.data += (self.held << fill).to_bytes((self.held_bits + fill) // 8, "big")
            self.held = self.held_bits = 0

    def write_number(self, value: int, width: int) -> None:
        if not self.held_bits and self.size % 8:
            self.held, self.held_bits = self.data.pop() >> -self.size % 8, self.size % 8
        self.held, self.held_bits = self.held << width | value & ((1 << width) - 1), self.held_bits + width
        self.size += width
        if self.held_bits > 4096:
            self._flush_whole()

    def _flush_whole(self) -> None:
        rest = self.held_bits % 8
        self.data += (self.held >> rest).to_bytes(self.held_bits // 8, "big")
        self.held, self.held_bits = self.held & ((1 << rest) - 1), rest

    def write_bit(self, bit: int) -> None:
        self.write_number(bit & 1, 1)

    def write(self, other: BitBuffer) -> None:
        data = other.to_bytes()
        self.write_number(int.from_bytes(data, "big") >> 8 * len(data) - other.size, other.size)

    def write_rice(self, k: int, value: int) -> None:
        high = value >> k
        self.write_number((1 << high + 1) - 2, high + 1)
        self.write_number(value, k)

    def write_elias_delta(self, value: int) -> None:
        if value < 1:
            raise ValueError("Elias-delta codes begin at 1")
        length = value.bit_length()
        self.write_number(length, 2 * length.bit_length() - 1)
        self.write_number(value, length - 1)

    def write_var_long(self, value: int) -> None:
        value &= (1 << 64) - 1
        while value > 127:
            self.write_number(value & 127 | 128, 8)
            value >>= 7
        self.write_number(value, 8)

    def seek(self, pos: int) -> None:
        self.pos = pos

    def clear(self) -> None:
        self.data, self.held, self.held_bits, self.size, self.pos = bytearray(), 0, 0, 0, 0

    def clear_bits(self, count: int) -> None:
        """Zeros in place of the next ``count`` bits; the position stays."""
        self._flush()
        for at in range(self.pos, min(self.pos + count, self.size)):
            self.data[at >> 3] &= ~(128 >> (at & 7)) & 255

    def read_bit(self) -> int:
        return self.read_number(1)

    def read_number(self, width: int) -> int:
        self._flush()
        end = self.pos + width
        if end > self.size:
            raise IndexError("read past the end")
        word = int.from_bytes(self.data[self.pos >> 3 : end + 7 >> 3], "big")
        self.pos = end
        return word >> -end % 8 & ((1 << width) - 1)

    def until_zero(self) -> int:
        """Length of the run of ones from here on; reads the zero as well."""
        return self._run(1)

    def _run(self, bit: int) -> int:
        n = 0
        while True:
            width = min(64, self.size - self.pos)
            word = self.read_number(width) ^ (((1 << width) - 1) * bit)
            if word or not width:
                ahead = width - word.bit_length()
                self.pos += ahead + 1 - width
                if not width:
                    raise IndexError("read past the end")
                return n + ahead
            n += width

    def read_rice(self, k: int) -> int:
        high = self.until_zero()
        return high << k | self.read_number(k)

    def skip_rice(self, k: int) -> None:
        self.until_zero()
        self.pos += k

    def read_elias_delta(self) -> int:
        zeros = self._run(0)
        length = 1 << zeros | self.read_number(zeros)
        return 1 << (length - 1) | self.read_number(length - 1)

    def read_var_long(self) -> int:
        out = shift = 0
        while True:
            byte = self.read_number(8)
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out


def py_fold(x: int) -> int:
    return 2 * x - 1 if x > 0 else -2 * x


def py_unfold(x: int) -> int:
    return (x + 1) // 2 if x & 1 else -(x // 2)


# ---- arrays ----


def pack_rice(values: np.ndarray, ks: np.ndarray) -> tuple[bytes, int]:
    """Values with a parameter each, packed; the bytes and the exact number of bits."""
    values, ks = np.asarray(values, np.int64), np.asarray(ks, np.int64)
    high = values >> ks
    ends = np.cumsum(high + 1 + ks)
    total = int(ends[-1]) if len(ends) else 0
    bits = np.zeros(total, np.uint8)
    starts = ends - ks - 1 - high
    bits[np.repeat(starts - np.concatenate([[0], np.cumsum(high)[:-1]]), high) + np.arange(high.sum()) if total else []] = 1
    for j in range(int(ks.max(initial=0))):
        at = ks > j
        bits[ends[at] - 1 - j] = values[at] >> j & 1
    return np.packbits(bits).tobytes(), total


def unpack_rice(data: bytes, ks: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
    """Codes of several streams that begin at the bits ``starts``, with their parameters; a step reads one code of every stream."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    zeros = np.where(bits == 0, np.arange(len(bits)), len(bits))
    following = np.minimum.accumulate(zeros[::-1])[::-1]  # the next zero from each bit on
    counts = np.array([len(k) for k in ks], np.int64)
    flat, first = np.concatenate([np.zeros(0, np.int64), *ks]).astype(np.int64), np.cumsum(counts) - counts
    out, pos = np.zeros(len(flat), np.int64), np.asarray(starts, np.int64).copy()
    for step in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > step)
        at, k = pos[live], flat[first[live] + step]
        zero = following[at]
        value = zero - at
        for j in range(int(k.max(initial=0))):
            use = k > j
            value[use] = value[use] << 1 | bits[zero[use] + 1 + j]
        out[first[live] + step] = value
        pos[live] = zero + 1 + k
    return np.split(out, first[1:]) if len(ks) else []


def pack_var_longs(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers in bytes of seven bits, lowest first; a set top bit tells that more follow."""
    values = np.asarray(values, np.uint64)
    sizes = np.ones(len(values), np.int64)
    for j in range(1, 10):
        sizes += values >> np.uint64(7 * j) != 0
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for j in range(int(sizes.max(initial=0))):
        at = sizes > j
        out[starts[at] + j] = (values[at] >> np.uint64(7 * j) & np.uint64(127)).astype(np.uint8) | np.where(sizes[at] > j + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def unpack_var_longs(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    out = np.zeros(len(ends), np.uint64)
    for j in range(int((ends - starts).max(initial=-1)) + 1):
        at = starts + j <= ends
        out[at] |= (raw[starts[at] + j] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * j)
    return out


def pack_rice_apart(values: np.ndarray, k: int) -> bytes:
    """Unsigned numbers with one parameter: all quotients in unary, then all low bits; so they are read without a loop over values."""
    values = np.asarray(values, np.uint64)
    ends = np.cumsum((values >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.ones(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 0
    low = np.zeros((len(values), k), np.uint8)
    for j in range(k):
        low[:, k - 1 - j] = (values >> np.uint64(j) & np.uint64(1)).astype(np.uint8)
    return np.packbits(np.concatenate([unary, low.ravel()])).tobytes()


def unpack_rice_apart(data: bytes, k: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    zeros = np.flatnonzero(bits == 0)[:n]
    high = np.diff(zeros, prepend=-1) - 1
    low = bits[int(zeros[-1]) + 1 :][: n * k].reshape(n, k) if n else np.zeros((0, k), np.uint8)
    out = high.astype(np.uint64) << np.uint64(k)
    for j in range(k):
        out |= low[:, k - 1 - j].astype(np.uint64) << np.uint64(j)
    return out
