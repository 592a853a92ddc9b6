"""A filter before a shuffle: a bitmap of fixed size of the hashed keys that the other side holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrgrid.session import stable

BITMAP = 24  # 2**24 bits, in at most 2**18 rows


def _slot(entry) -> tuple:
    """The row of the bitmap for an entry, and its bit there."""
    place = F.shiftrightunsigned(entry, 64 - BITMAP)
    return F.shiftright(place, 6), F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))


def in_bitmap(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``entries`` whose entry may be in ``wanted``: a filter before the shuffle, by a map of fixed size."""
    slot, bit = _slot(F.col("entry"))
    bits = wanted.select(slot.alias("_slot"), bit.alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    joined = entries.withColumns({"_slot": slot, "_bit": bit}).join(F.broadcast(stable(bits)), "_slot")
    return joined.filter(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).drop("_slot", "_bit", "_bits")
