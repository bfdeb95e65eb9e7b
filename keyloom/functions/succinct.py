"""Rank, select and monotone lists: native columns over tables of bits or values, and coded forms as bytes.

Positions are dealt into blocks, so that no window spans a whole table: sums within blocks come from a window
partitioned by block, and the sums before each block from a table of one row a block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_sum(df: DataFrame, order: str, value: str, out: str, block: int = 1 << 16) -> DataFrame:
    """Exclusive running sum of ``value`` by the unique whole number ``order``.

    Two levels: blocks of the order's range run side by side, and only the blocks' totals, a row for each, are summed in
    one place.
    """
    df = df.withColumn("__block", F.floor(F.col(order) / block))
    totals = df.groupBy("__block").agg(F.sum(value).alias("__total"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__block", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inner = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("__own", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return own.join(totals, "__block").withColumn(out, F.col("__before") + F.col("__own")).drop("__block", "__before", "__own")


def rank(bits: DataFrame, pos: str = "pos", bit: str = "bit") -> DataFrame:
    """Adds ``rank``, the ones before a position, and ``rank_and_get``, twice that plus the bit."""
    out = prefix_sum(bits, pos, bit, "rank")
    return out.withColumn("rank", F.col("rank").cast("long")).withColumn("rank_and_get", (F.col("rank") * 2 + F.col(bit)).cast("long"))


def select(bits: DataFrame, pos: str = "pos", bit: str = "bit") -> DataFrame:
    """A row for each one: ``n`` (from 0), its position and that of the next one (null for the last)."""
    ones = rank(bits, pos, bit).where(F.col(bit) == 1).select(F.col("rank").alias("n"), F.col(pos).alias("pos"))
    after = ones.select((F.col("n") - 1).alias("n"), F.col("pos").alias("next_pos"))
    return ones.join(after, "n", "left")


def select_in_word(word: Column, n: Column, bits: int = 64) -> Column:
    """Position of the n-th one (from 0) of the low 64 (or 32) bits, lowest first, or highest in the form below; -1 where there are fewer."""
    ones = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit(word, i) == 1)
    return F.coalesce(F.get(ones, n.cast("int")), F.lit(-1))


def select_in_word_msb(word: Column, n: Column, bits: int = 64) -> Column:
    ones = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit(word, F.lit(bits - 1) - i) == 1)
    return F.coalesce(F.get(ones, n.cast("int")), F.lit(-1))


def elias_fano_parts(values: DataFrame, i: str = "i", value: str = "value") -> DataFrame:
    """``low``, ``high`` and ``bit_pos`` of a monotone list (i from 0, value); ``width`` is the length of max / count in bits."""
    stats = values.agg(F.max(value).alias("__max"), F.count("*").alias("__n"))
    # one row
    out = values.crossJoin(F.broadcast(stats)).withColumn("width", F.when(F.floor(F.col("__max") / F.col("__n")) > 0, F.length(F.bin(F.floor(F.col("__max") / F.col("__n"))))).otherwise(0).cast("int"))
    power = F.pow(F.lit(2.0), "width").cast("long")
    return out.withColumn("low", F.col(value) % power).withColumn("high", F.floor(F.col(value) / power)).withColumn("bit_pos", F.col(i) + F.col("high")).drop("__max", "__n")


def elias_fano_values(parts: DataFrame) -> DataFrame:
    """The list back from the positions of the ones (by select) and the low bits."""
    ones = parts.select(F.col("bit_pos").alias("pos"), F.lit(1).alias("bit"))
    found = select(ones).select(F.col("n").alias("i"), "pos")
    power = F.pow(F.lit(2.0), "width").cast("long")
    return found.join(parts.select("i", "low", "width"), "i").select("i", ((F.col("pos") - F.col("i")) * power + F.col("low")).alias("value"))


def multi_stage(values: DataFrame, i: str = "i", value: str = "value") -> DataFrame:
    """Regression and three levels: the line, then what groups of 64, of 8 and single entries lie above it, in units of 32, 16 and 1."""
    stats = values.agg(F.max(value).alias("__max"), F.min(value).alias("__min"), F.count("*").alias("__n"))
    rows = values.crossJoin(F.broadcast(stats))
    factor = F.floor((F.col("__max") - F.col("__min")) * F.lit(4294967296.0) / F.col("__n")) + 1
    rows = rows.withColumn("line", F.shiftright(F.col(i) * factor.cast("long"), 32) + F.col("__min")).withColumn("rest", F.col(value) - F.col("line"))
    base = rows.agg(F.min("rest").alias("base"))
    rows = rows.crossJoin(F.broadcast(base)).withColumn("rest", F.col("rest") - F.col("base"))
    for name, size, unit in (("level1", 64, 32), ("level2", 8, 16)):
        rows = rows.withColumn(name, F.floor(F.min("rest").over(Window.partitionBy(F.floor(F.col(i) / size))) / unit)).withColumn("rest", F.col("rest") - F.col(name) * unit)
    return rows.withColumn("level3", F.col("rest")).drop("__max", "__min", "__n", "rest")


def multi_stage_values(rows: DataFrame, i: str = "i") -> DataFrame:
    return rows.select(F.col(i).alias("i"), (F.col("line") + F.col("base") + F.col("level1") * 32 + F.col("level2") * 16 + F.col("level3")).cast("long").alias("value"))


# ---- coded forms ----


class RankBits:
    """Bits with counts in two levels: one 64-bit sum for 512 bits and a 16-bit one for 64."""

    def __init__(self, bits: np.ndarray):
        bits = np.asarray(bits, bool)
        self.n = len(bits)
        padded = np.zeros(-(-max(1, self.n) // 512) * 512, bool)
        padded[: self.n] = bits
        self.words = np.packbits(padded.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
        counts = np.bitwise_count(self.words).reshape(-1, 8).astype(np.int64)
        self.large = np.concatenate([[0], counts.sum(1).cumsum()])[:-1]
        self.small = (counts.cumsum(1) - counts).astype(np.uint16).ravel()
        self.ones = int(counts.sum())

    def get(self, x: int) -> bool:
        return 0 <= x < self.n and bool(int(self.words[x >> 6]) >> (x & 63) & 1)

    def rank(self, x: int) -> int:
        """Ones before x; positions past the end count as the last one."""
        x = min(x, max(0, self.n - 1))
        below = int(self.words[x >> 6]) & ((1 << (x & 63)) - 1)
        return int(self.large[x >> 9]) + int(self.small[x >> 6]) + below.bit_count()

    def rank_and_get(self, x: int) -> int:
        return 2 * self.rank(x) + self.get(x)

    def select(self, n: int) -> int:
        """Position of the n-th one from 0, or -1: binary search over the sums, then in the word."""
        if not 0 <= n < self.ones:
            return -1
        big = int(np.searchsorted(self.large, n, side="right")) - 1
        left = n - int(self.large[big])
        word = 8 * big + int(np.searchsorted(self.small[8 * big : 8 * big + 8], left, side="right")) - 1
        left -= int(self.small[word])
        w = int(self.words[word])
        for _ in range(left):
            w &= w - 1
        return 64 * word + (w & -w).bit_length() - 1

    def select_pair(self, n: int) -> tuple[int, int]:
        return self.select(n), self.select(n + 1)

    def overhead_bits(self) -> int:
        return 64 * len(self.large) + 16 * len(self.small)

    def read_bits(self) -> int:
        """Bits that a rank looks at: two counts and a word."""
        return 64 + 16 + 64


class Packed:
    """Unsigned whole numbers of one width, side by side in 64-bit words."""

    def __init__(self, words: np.ndarray, n: int, width: int):
        self.words, self.n, self.width = words, n, width

    @classmethod
    def of(cls, values) -> Packed:
        values = np.asarray(values, np.int64).astype(np.uint64)
        width = int(values.max(initial=0)).bit_length()
        words = np.zeros(-(-len(values) * width // 64) + 1, np.uint64)
        at = np.arange(len(values)) * width
        low, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(words, low, values << shift)
        over = shift.astype(np.int64) + width > 64
        np.bitwise_or.at(words, low[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
        return cls(words, len(values), width)

    def take(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(np.shape(i), np.int64)
        at = np.asarray(i, np.int64) * self.width
        shift = (at & 63).astype(np.uint64)
        low = self.words[at >> 6] >> shift
        high = np.where(shift, self.words[np.minimum((at >> 6) + 1, len(self.words) - 1)] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return ((low | high) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def get(self, i: int) -> int:
        return int(self.take(np.array([i]))[0])

    def all(self) -> np.ndarray:
        return self.take(np.arange(self.n))

    def size_bits(self) -> int:
        return self.n * self.width

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.width], "<i8").tobytes() + self.words.astype("<u8").tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[Packed, int]:
        n, width = np.frombuffer(data, "<i8", 2, at).tolist()
        count = -(-n * width // 64) + 1
        return cls(np.frombuffer(data, "<u8", count, at + 16).astype(np.uint64), n, width), at + 16 + 8 * count


def _pick(word: int, n: int) -> int:
    """Position of the n-th one of a word that has it."""
    for _ in range(n):
        word &= word - 1
    return (word & -word).bit_length() - 1


class InventorySelect:
    """Select in a bounded number of steps: every 1,024th position; between two of them every 32nd, in 16 bits as steps
    from the first, where they lie close, and else all positions.

    From the nearest kept position on, words are counted; what lies between has at most 31 ones.
    """

    BIG, SMALL = 1024, 32

    def __init__(self, bits: np.ndarray):
        bits = np.asarray(bits, bool)
        ones = np.flatnonzero(bits)
        self.ones, self.n = len(ones), len(bits)
        padded = np.zeros(-(-max(1, self.n) // 64) * 64, bool)
        padded[: self.n] = bits
        self.words = np.packbits(padded.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
        self.inventory = ones[:: self.BIG]
        ends = np.append(self.inventory[1:], self.n)
        self.far = {i: ones[i * self.BIG : (i + 1) * self.BIG] for i in np.flatnonzero(ends - self.inventory >= 1 << 16).tolist()}
        steps = ones[:: self.SMALL] - np.repeat(self.inventory, self.BIG // self.SMALL)[: len(ones[:: self.SMALL])]
        self.steps = np.minimum(steps, (1 << 16) - 1).astype(np.uint16)

    def select(self, n: int) -> int:
        if not 0 <= n < self.ones:
            return -1
        group = n // self.BIG
        if group in self.far:
            return int(self.far[group][n % self.BIG])
        at = int(self.inventory[group]) + int(self.steps[n // self.SMALL])
        return scan(self.words, at, n % self.SMALL)

    def select_pair(self, n: int) -> tuple[int, int]:
        return self.select(n), self.select(n + 1)

    def overhead_bits(self) -> int:
        return 64 * len(self.inventory) + 16 * len(self.steps) + 64 * sum(map(len, self.far.values()))


def scan(words: np.ndarray, at: int, left: int) -> int:
    """Position of the ``left``-th one from the one at ``at`` on."""
    i = at >> 6
    word = int(words[i]) >> (at & 63) << (at & 63)
    while (count := word.bit_count()) <= left:
        left -= count
        i += 1
        word = int(words[i])
    return 64 * i + _pick(word, left)


class BlockSelect:
    """Select by blocks of 32 ones: a block's first position is a line over the block's number plus a packed difference, then words are counted."""

    BLOCK = 32

    def __init__(self, bits: np.ndarray | None = None, *, words=None, n=0, ones=0, line=None, rest=None):
        if bits is None:
            self.words, self.n, self.ones, (self.base, self.slope), self.rest = words, n, ones, line, rest
            return
        bits = np.asarray(bits, bool)
        places = np.flatnonzero(bits)
        self.n, self.ones = len(bits), len(places)
        padded = np.zeros(-(-max(1, self.n) // 64) * 64, bool)
        padded[: self.n] = bits
        self.words = np.packbits(padded.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
        firsts = places[:: self.BLOCK]
        self.slope = int(firsts[-1]) * 65536 // max(1, len(firsts) - 1) if len(firsts) else 0
        rest = firsts - (np.arange(len(firsts)) * self.slope >> 16)
        self.base = int(rest.min(initial=0)) if len(rest) else 0
        self.rest = Packed.of(rest - self.base)

    def select(self, n: int) -> int:
        if not 0 <= n < self.ones:
            return -1
        block = n // self.BLOCK
        return scan(self.words, (block * self.slope >> 16) + self.base + self.rest.get(block), n % self.BLOCK)

    def select_pair(self, n: int) -> tuple[int, int]:
        return self.select(n), self.select(n + 1)

    def all(self) -> np.ndarray:
        """Every position of a one."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def overhead_bits(self) -> int:
        return 128 + self.rest.size_bits()

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.ones, self.base, self.slope, len(self.words)], "<i8").tobytes() + self.words.astype("<u8").tobytes() + self.rest.to_bytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[BlockSelect, int]:
        n, ones, base, slope, count = np.frombuffer(data, "<i8", 5, at).tolist()
        words = np.frombuffer(data, "<u8", count, at + 40).astype(np.uint64)
        rest, at = Packed.read(data, at + 40 + 8 * count)
        return cls(words=words, n=n, ones=ones, line=(base, slope), rest=rest), at


class EliasFanoList:
    """A monotone list of whole numbers from 0 on: packed low bits of a fixed width, high ones by select."""

    def __init__(self, values=None, *, low: Packed | None = None, high: BlockSelect | None = None, width: int = 0):
        if values is None:
            self.n, self.width, self.low, self.high = high.ones, width, low, high
            return
        values = np.asarray(values, np.int64)
        self.n = len(values)
        self.width = (int(values[-1]) // self.n).bit_length() if self.n else 0
        self.low = Packed.of(values & ((1 << self.width) - 1))
        ones = np.arange(self.n) + (values >> self.width)
        bits = np.zeros(int(ones[-1]) + 1 if self.n else 0, bool)
        bits[ones] = True
        self.high = BlockSelect(bits)

    def get(self, i: int) -> int:
        return (self.high.select(i) - i << self.width) + self.low.get(i)

    def get_pair(self, i: int) -> tuple[int, int]:
        return self.get(i), self.get(i + 1)

    def all(self) -> np.ndarray:
        return (self.high.all() - np.arange(self.n) << self.width) + self.low.all()

    def size_bits(self) -> int:
        """What the coded form keeps, but for its header of fixed size."""
        return self.low.size_bits() + self.high.n + self.high.overhead_bits()

    def to_bytes(self) -> bytes:
        return np.array([self.width], "<i8").tobytes() + self.low.to_bytes() + self.high.to_bytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFanoList:
        (width,) = np.frombuffer(data, "<i8", 1).tolist()
        low, at = Packed.read(data, 8)
        return cls(low=low, high=BlockSelect.read(data, at)[0], width=width)


class MultiStageList:
    """A list close to a line: a value is the line's, plus the least rest of its group of 64, of 8, and its own, each packed in the width that its level needs."""

    GROUPS = (64, 8, 1)

    def __init__(self, values=None, *, n: int = 0, base: int = 0, slope: int = 0, levels: list[Packed] | None = None):
        if values is None:
            self.n, self.base, self.slope, self.levels = n, base, slope, levels
            return
        values = np.asarray(values, np.int64)
        self.n = len(values)
        self.slope = (int(values[-1]) - int(values[0])) * (1 << 32) // max(1, self.n) if self.n else 0
        rest = values - self._line(np.arange(self.n))
        self.base = int(rest.min(initial=0)) if not self.n else int(rest.min())
        rest, self.levels = rest - self.base, []
        for size in self.GROUPS:
            least = np.minimum.reduceat(rest, np.arange(0, self.n, size)) if self.n else rest
            self.levels.append(Packed.of(least))
            rest = rest - np.repeat(least, size)[: self.n]

    def _line(self, i: np.ndarray) -> np.ndarray:
        """In two halves, so that products stay below 2**63."""
        high, low = self.slope >> 32, self.slope & 0xFFFFFFFF
        return i * high + (i * low >> 32)

    def take(self, i: np.ndarray) -> np.ndarray:
        return self._line(i) + self.base + sum(level.take(i // size) for level, size in zip(self.levels, self.GROUPS))

    def get(self, i: int) -> int:
        return int(self.take(np.array([i]))[0])

    def get_pair(self, i: int) -> tuple[int, int]:
        return self.get(i), self.get(i + 1)

    def all(self) -> np.ndarray:
        return self.take(np.arange(self.n))

    def size_bits(self) -> int:
        return sum(level.size_bits() for level in self.levels)

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.base, self.slope], "<i8").tobytes() + b"".join(x.to_bytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> MultiStageList:
        n, base, slope = np.frombuffer(data, "<i8", 3).tolist()
        levels, at = [], 24
        for _ in cls.GROUPS:
            level, at = Packed.read(data, at)
            levels.append(level)
        return cls(n=n, base=base, slope=slope, levels=levels)


class ValueList:
    """Whole numbers in any order: the leading one of value + 1 is dropped, and the borders between values are a monotone list."""

    def __init__(self, values):
        widths = [int(v + 1).bit_length() - 1 for v in values]
        self.borders = EliasFanoList(np.concatenate([[0], np.cumsum(widths)]).astype(np.int64))
        self.bits = "".join(f"{v + 1:b}"[1:] for v in values)

    def get(self, i: int) -> int:
        a, b = self.borders.get_pair(i)
        return int("1" + self.bits[a:b], 2) - 1


class FenwickList:
    """A monotone list by its differences in a binary indexed tree."""

    def __init__(self, values):
        self.n = len(values)
        self.tree = np.diff(np.asarray(values, np.int64), prepend=0).tolist()
        for i in range(1, self.n + 1):
            up = i + (i & -i)
            if up <= self.n:
                self.tree[up - 1] += self.tree[i - 1]

    def get(self, i: int) -> int:
        out, i = 0, i + 1
        while i > 0:
            out += self.tree[i - 1]
            i &= i - 1
        return out

    def get_pair(self, i: int) -> tuple[int, int]:
        return self.get(i), self.get(i + 1)


def monotone_list(values, elias_fano: bool = True):
    return EliasFanoList(values) if elias_fano else MultiStageList(values)
