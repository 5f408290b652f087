"""Leave out rows of listed keys, most of them without a shuffle.

The listed keys set bits of a map whose size is fixed. A row whose bit is not set is surely not
listed and stays where it is; the few others go through an exact anti join. So a large table loses a
few keys for the price of a broadcast of known size, and never by an approximate answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .skew import MIN_HOT_ROWS, hot_keys, key_hash, spread_join

#: The map is so many words of 64 bits: 8 million bits, one row of two numbers a word.
WORDS = 1 << 17


def _place(on: Sequence[str], words: int) -> tuple[Column, Column]:
    """Word and bit of a key; both from one hash, from different parts of it."""
    h = F.xxhash64(*on, F.lit(23))
    return F.pmod(h, F.lit(words)), F.shiftrightunsigned(h, 58).cast("int")


def bit_map(keys: DataFrame, on: Sequence[str], words: int = WORDS) -> DataFrame:
    """``word, bits``: the map of the keys, ``words`` rows at most whatever their number."""
    word, bit = _place(on, words)
    # A bit is looked up: shifts take a number of bits that is no column.
    one = F.get(F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)]), bit)
    return keys.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits"))


def without_members(
    rows: DataFrame,
    members: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    min_hot_rows: int = MIN_HOT_ROWS,
    words: int = WORDS,
) -> DataFrame:
    """``rows`` whose key ``on`` is not among ``members``. Rows with a null in the key stay.

    ``members`` holds every key once. ``rows`` is read several times, so hand in a stored table.
    """
    word, bit = _place(on, words)
    columns = rows.columns
    marked = rows.withColumn("word", word).join(F.broadcast(bit_map(members, on, words)), "word", "left")
    maybe = F.coalesce(F.getbit("bits", bit) == 1, F.lit(False))
    unsure = marked.filter(maybe).select(*columns)
    hot = hot_keys(unsure.select(key_hash(*on).alias("hash")), min_hot_rows)
    checked = spread_join(unsure, members, on, "left_anti", spread_by, hot)
    return marked.filter(~maybe).select(*columns).unionByName(checked.select(*columns))
