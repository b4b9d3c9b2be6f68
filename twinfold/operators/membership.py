"""Membership filters: a blocked Bloom filter as a table of 64-bit words, looked up beside rows that should not move.

A key's hash picks one word and ``BITS_SET`` bits in it. The words are joined by a broadcast, so what stands beside the key, as a file's content, stays where it is and expressions on it can be
left out for the rows that the filter does not hold. The filter never misses a member; about one other key in a hundred passes too, so an exact check follows on narrow rows. A
filter of more than ``MOST_WORDS`` words is not made: ``words_for`` gives None, and callers fall back to a way that needs none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each member, bits that a member sets, most words that are broadcast (32 MB of filter), most rows of narrow keys that are broadcast themselves.
BITS, BITS_SET, MOST_WORDS, MOST_KEYS = 16, 4, 4_000_000, 200_000


def words_for(n: int, bits: int = BITS) -> int | None:
    """Words of a filter for n members; None where it would be too large to broadcast."""
    words = max(1, -(-n * bits // 64))
    return words if words <= MOST_WORDS else None


def _place(words: int, *columns: str) -> tuple[Column, Column]:
    """The word of a key and its mask."""
    h = F.xxhash64(*columns)
    more = F.xxhash64(F.lit(7), h)
    mask = F.lit(0).cast("long")
    for k in range(BITS_SET):
        mask = mask.bitwiseOR(_bit(more, k))
    return F.pmod(h, F.lit(words)), mask


def _bit(h: Column, k: int) -> Column:
    """A word with the bit that six bits of a hash name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int"))


def bloom(keys: DataFrame, words: int, *columns: str) -> DataFrame:
    """``word, mask`` rows of the filter of some keys."""
    word, mask = _place(words, *columns)
    return keys.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def marked(rows: DataFrame, filter_: DataFrame, words: int, *columns: str, name: str = "maybe") -> DataFrame:
    """``rows`` with a column that is false only where the key is no member; rows do not move."""
    word, mask = _place(words, *columns)
    return rows.join(F.broadcast(filter_.select(F.col("word").alias("_word"), F.col("mask").alias("_mask"))), word == F.col("_word"), "left").withColumn(name, F.coalesce(F.col("_mask").bitwiseAND(mask) == mask, F.lit(False))).drop("_word", "_mask")


def kept(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows whose key may be among ``keys`` (staged): exactly those where keys are few, those of the filter where they are more, all beyond. Rows do not move."""
    n = keys.count()
    if n <= MOST_KEYS:
        return rows.join(F.broadcast(keys.select(*columns).distinct()), list(columns), "left_semi")
    if (words := words_for(n)) is None:
        return rows
    return marked(rows, bloom(keys, words, *columns), words, *columns).filter("maybe").drop("maybe")
