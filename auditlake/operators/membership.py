"""Filters that tell, where a row lies, whether its key can be in a set: blocked Bloom filters as bitmaps.

Spark aggregates the keys to bitmaps of ``BITS`` bits; a key sets ``HASHES`` bits of the one bitmap
that its hash names, so a row is tested by a single lookup. ``BITS_A_KEY`` bits for each key let
about one in a hundred strangers pass; no key of the set is ever turned away. The bitmaps are
broadcast and never exceed ``MOST`` of them (16 MB): a larger set only lets more strangers pass, for
the exact step that follows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What bitmap_construct_agg makes: 4 KB.
BITS = 32768
HASHES, BITS_A_KEY, MOST = 3, 12, 4096


def bitmaps(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """((bitmap, bits), number of bitmaps) of the keys. keys is read twice and should be small or written."""
    n = keys.count()
    many = min(MOST, max(1, -(-n * BITS_A_KEY // BITS)))
    each = keys.select(_bitmap(F.col(key), many).alias("bitmap"), F.explode(F.array(*_places(F.col(key)))).alias("__at"))
    return each.groupBy("bitmap").agg(F.bitmap_construct_agg("__at").alias("bits")), many


def among(rows: DataFrame, key: str, filters: tuple[DataFrame, int]) -> DataFrame:
    """The rows whose key can be in the set of ``bitmaps``, and some others; no row is exchanged."""
    x = rows.join(_found(filters), _bitmap(F.col(key), filters[1]) == F.col("__bitmap"))
    for place in _places(F.col(key)):
        x = x.filter(_is_set(place))
    return x.drop("__bitmap", "__bits")


def apart(rows: DataFrame, key: str, filters: tuple[DataFrame, int]) -> DataFrame:
    """The rows that ``among`` leaves out. No row is exchanged."""
    x = rows.join(_found(filters), _bitmap(F.col(key), filters[1]) == F.col("__bitmap"), "left")
    every = reduce(Column.__and__, map(_is_set, _places(F.col(key))))
    return x.filter(~F.coalesce(every, F.lit(False))).drop("__bitmap", "__bits")


def _found(filters: tuple[DataFrame, int]) -> DataFrame:
    return F.broadcast(filters[0].select(F.col("bitmap").alias("__bitmap"), F.col("bits").alias("__bits")))


def _is_set(place: Column) -> Column:
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def _bitmap(key: Column, many: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("bitmap"), key), F.lit(many))


def _places(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), key), F.lit(BITS)) for k in range(HASHES)]
