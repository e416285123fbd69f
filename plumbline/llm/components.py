"""Connected components of an edge table by alternating large-star and small-star rounds, in joins only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import saved


def stars(edges: DataFrame, keep: Callable = saved) -> DataFrame:
    """edges (a, b: long) to (node, root): every node that is not the least of its component, with that least one.

    Each round is written to the shared folder by keep, so that the lineage does not grow. Hubs are no problem: minima are
    combined before the shuffle, and what is joined to a hub is one row."""
    directed = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, state = keep(directed, "components"), None
    while True:
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        now = keep(small.where("u <> v").distinct(), "components")
        counted = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if counted == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = counted
