"""Bitmaps of a fixed number of bits that stand for a set of 64-bit hashes.

A bitmap answers "surely not in the set" or "perhaps": it spares work and never decides a
result. Its size is set by BITS, not by the set, so it may be broadcast however many rows
there are; a set that outgrows it lets more rows pass, no fewer.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 27  # 2**27 bits are 16 MB

_PART_BITS = 1 << 15  # what bitmap_construct_agg holds in a row


def _place(hashed: Column | str, bits: int) -> Column:
    """1 to 2**bits, by the upper bits of a hash."""
    return F.shiftrightunsigned(hashed, 64 - bits) + F.lit(1).cast("long")


def parts(hashes: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(part, bitmap): at most 2**bits / 32768 rows of 4 KB that hold the bits of all hashes in `column`."""
    place = hashes.select(_place(column, bits).alias("place")).distinct()
    return place.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")
    )


def perhaps_in(rows: DataFrame, hashed: str, bitmap: DataFrame, out: str, bits: int = BITS) -> DataFrame:
    """`rows` with the flag `out`: whether the bit of the hash column `hashed` is set in `parts` of a set."""
    place = _place(hashed, bits)
    at = F.bitmap_bit_position(place)
    named = F.broadcast(bitmap.select(F.col("part").alias("__part"), F.col("bitmap").alias("__bitmap")))
    byte = F.conv(F.hex(F.substring("__bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    flag = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.join(named, F.bitmap_bucket_number(place) == F.col("__part"), "left").withColumn(out, flag).drop("__part", "__bitmap")


def _word(place: Column) -> Column:
    """The position, in a row of the bitmap of `marked`, of the number that holds a place's bit."""
    return F.shiftright(place, 6).bitwiseAND(F.lit(_PART_BITS // 64 - 1)).cast("int")


def marked(rows: DataFrame, column: str, hashes: DataFrame) -> DataFrame:
    """Those of `rows` whose hash in `column` is perhaps among the distinct ones of `hashes`, by a bitmap of long integers.

    The bitmap has 16 bits for each hash, but no more than 2**BITS. Looking up a bit is plain
    arithmetic, for rows that are very many.
    """
    bits = min(BITS, max(15, (16 * hashes.count()).bit_length()))
    place = F.shiftrightunsigned(column, 64 - bits)
    part = lambda at: F.shiftright(at, 15)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))")
    set_bits = hashes.select(part(place).alias("__part"), _word(place).alias("__word"), one.alias("__bits"))
    first = F.col("id") * 64
    none = hashes.sparkSession.range(1 << (bits - 6)).select(part(first), _word(first), F.lit(0).cast("long"))
    numbers = set_bits.union(none).groupBy("__part", "__word").agg(F.bit_or("__bits").alias("__bits"))
    held = numbers.groupBy("__part").agg(F.sort_array(F.collect_list(F.struct("__word", "__bits"))).getField("__bits").alias("__marks"))
    number = F.get("__marks", _word(place))
    bit = F.call_function("shiftright", number, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    return rows.join(F.broadcast(held), part(place) == F.col("__part")).filter(bit == 1).drop("__part", "__marks")


def collected(hashes: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The whole bitmap as bytes on the driver: 2**bits / 8 of them, whatever the number of hashes."""
    size = max(1 << bits, _PART_BITS)
    whole = np.zeros(size // 8, np.uint8)
    for row in parts(hashes, column, bits).collect():  # as many rows as the bitmap has parts, at most
        start = (row["part"] - 1) * (_PART_BITS // 8)
        whole[start : start + _PART_BITS // 8] = np.frombuffer(row["bitmap"], np.uint8)
    return whole


def held(bitmap: np.ndarray, hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which of the unsigned hashes may be in the set."""
    place = hashes >> np.uint64(64 - bits)
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
