"""Bloom filter of a list as a small relation: drops non-members in the scan's stage.

The filter has a number of 64-bit words.  A key belongs to one word and sets
HASHES bits of it; a key is let through if its word has all its bits.  Words
are built by a partial ``bit_or`` (map side first) and probed by a broadcast
semi-join on the word's number, so neither the list nor the filter passes
through the driver as rows, and the probed table isn't exchanged.  At 16 bits
a key about one non-member in fifty gets through; what follows must be exact.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, HASHES = 16, 4
#: Words of a filter, at most (a row of 16 bytes each): the broadcast stays within some 32 MB.
MOST_WORDS = 1 << 20
#: A filter with fewer bits per key than this lets too much through and isn't used.
LEAST_BITS = 6


def words_for(keys: int) -> int:
    """Words of a filter for so many keys; 0 if none of the allowed size is of use."""
    words = 1
    while words * 64 < keys * BITS_PER_KEY and words < MOST_WORDS:
        words *= 2
    return words if words * 64 >= keys * LEAST_BITS else 0


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words).cast("bigint"))


def _bits(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    out = None
    for i in range(HASHES):
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(h, 6 * i), F.lit(64).cast("bigint")).cast("int"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


class Bloom:
    """Filter of the distinct values of ``relation[column]``, about ``keys`` of them."""

    def __init__(self, relation: DataFrame, column: str, keys: int):
        self.words = words_for(keys)
        key = F.col(column)
        self.filter = (relation.select(_word(key, self.words).alias("_f_word"), _bits(key).alias("_f_bits"))
                       .groupBy("_f_word").agg(F.bit_or("_f_bits").alias("_f_bits"))) if self.words else None

    def keep(self, df: DataFrame, *columns: str) -> DataFrame:
        """Rows of ``df`` whose ``columns`` may all be in the list (every member is, a few others too)."""
        if self.filter is None:
            return df
        for c in columns:
            key = F.col(c).outer()
            mask = _bits(key)
            side = F.broadcast(self.filter)  # at most MOST_WORDS rows
            # a predicate (planned as a semi-join), so that it moves below projections and joins
            df = df.where(side.where((_word(key, self.words) == F.col("_f_word"))
                                     & (F.col("_f_bits").bitwiseAND(mask) == mask)).exists())
        return df
