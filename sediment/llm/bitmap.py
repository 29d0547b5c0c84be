"""A bitmap of hashes as one value inside an expression: a cheap test before an exact join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The size of the bitmap in bits, as powers of two: 16 bits a key between these bounds.
LEAST_BITS, MOST_BITS = 16, 22


@dataclass
class Bitmap:
    """Says of a hash whether it may be one of the keys; it always says so of a key."""

    words: Column
    bits: int

    def may_hold(self, h: Column) -> Column:
        word = F.shiftright(h, 6).bitwiseAND(F.lit((1 << (self.bits - 6)) - 1)).cast("int")
        return F.getbit(F.get(self.words, word), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def bitmap_of(keys: DataFrame, column: str) -> Bitmap | None:
    """From a column of longs; None without a key.

    The driver gets at most ``2**MOST_BITS / 64`` numbers however many keys there are. More keys
    make the test let more rows through, never fewer, so an exact join has to follow.
    """
    n = keys.count()
    if not n:
        return None
    bits = min(max((16 * n).bit_length(), LEAST_BITS), MOST_BITS)
    h = F.col(column)
    word = F.shiftright(h, 6).bitwiseAND(F.lit((1 << (bits - 6)) - 1)).alias("word")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))
    rows = keys.where(h.isNotNull()).groupBy(word).agg(F.bit_or(one).alias("set")).collect()
    words = ["0"] * (1 << (bits - 6))
    for row in rows:
        words[row["word"]] = str(row["set"])
    return Bitmap(F.split(F.lit(",".join(words)), ",").cast("array<bigint>"), bits)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` needs it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
