"""A filter of keys that is small whatever it is made of, to keep rows without a partner out of a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Bits of the filter, in words of 64: at most a million rows of two longs are broadcast, some 16 MB.
BITS = 1 << 26


def maybe_in(rows: DataFrame, key: str, keys: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows whose key may be among the keys (a table with a column of that name): all that are, and few others.

    Every key sets one bit. With many more keys than bits nearly all rows stay, so work is lost but no row."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    bit = F.pmod(at, F.lit(64)).cast("int")
    filled = keys.groupBy(F.shiftright(at, 6).alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__bits"))
    found = rows.withColumn("__word", F.shiftright(at, 6)).join(F.broadcast(filled), "__word")
    return found.where(F.getbit("__bits", bit) == 1).drop("__word", "__bits")
