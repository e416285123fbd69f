"""Exact quantiles by selection: a sketch brackets each wanted place, and only what lies between brackets is put in order.

A first aggregate gives each group its size and, for each share, values of an approximate percentile on either side of the
wanted one, some close and some far. A second counts the rows below and up to each of them, and so shows between which two
the place is; a third counts the values there: a few ten thousandths of a group. So no task ever sorts a column or a group.

What the sketch says decides how much is put in order, never the result: each value rides along with the counts that were
made for it, as another run of the same sketch may give others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: The sketch's error is one part in ACCURACY; brackets lie so many parts to either side.
ACCURACY, SIDES = 10_000, (-20, -2, 2, 20)

#: Groups whose brackets are broadcast at most.
BROADCAST_GROUPS = 50_000

Position = Callable[[Column, float], Column]


def floor_position(n: Column, share: float) -> Column:
    return F.floor((n - 1) * share)


def nearest_position(n: Column, share: float) -> Column:
    return F.floor((n - 1) * share + 0.5)


def ceiling_position(n: Column, share: float) -> Column:
    return F.ceil((n - 1) * share)


def selected(df: DataFrame, by: Sequence[str], x: str, wanted: Sequence[tuple[str, float, Position]]) -> DataFrame:
    """by, n and, for each (name, share, position), the value at that place (from 0) of the group's sorted values.

    Null values are left out, and groups of nulls alone with them."""
    key = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by))) if by else F.lit(0)  # structs join where nulls meet
    rows = df.where(F.col(x).isNotNull()).select(key.alias("__g"), F.col(x).alias("__x"))
    ends = [min(1.0, max(0.0, share + side / ACCURACY)) for _, share, _ in wanted for side in SIDES]
    bounds = rows.groupBy("__g").agg(F.count("*").alias("n"), F.percentile_approx("__x", ends, ACCURACY).alias("ends"))
    small = bounds.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    met = rows.join(F.broadcast(bounds) if small else bounds, "__g")
    end = lambda j: F.get("ends", F.lit(j))
    counts = met.groupBy("__g", "n", "ends").agg(*(f(j) for j in range(len(ends)) for f in (lambda j: F.count_if(F.col("__x") < end(j)).alias(f"below{j}"), lambda j: F.count_if(F.col("__x") <= end(j)).alias(f"upto{j}"))))
    each = [_between(i, place(F.col("n"), share).cast("long"), end) for i, (_, share, place) in enumerate(wanted)]
    picks = counts.select("__g", "n", F.array(*each).alias("each"))
    here = lambda e: F.coalesce(F.col("__x") == e["same"], (e["lo"].isNull() | (e["lo"] < F.col("__x"))) & (e["hi"].isNull() | (F.col("__x") < e["hi"])))
    within = rows.join(F.broadcast(picks) if small else picks, "__g").select("__g", "n", "__x", F.explode(F.filter("each", here)).alias("e"))
    within = within.groupBy("__g", "n", F.col("e.i").alias("i"), F.col("e.nth").alias("nth"), F.col("__x").alias("v")).agg(F.count("*").alias("c"))
    within = within.withColumn("upto", F.sum("c").over(W.partitionBy("__g", "i").orderBy("v"))).where((F.col("upto") > F.col("nth")) & (F.col("upto") - F.col("c") <= F.col("nth")))
    found = within.groupBy("__g", "n").agg(*(F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"v{i}") for i in range(len(wanted))))
    return found.select(*(F.col(f"__g.k{i}").alias(c) for i, c in enumerate(by)), "n", *(F.col(f"v{i}").alias(name) for i, (name, _, _) in enumerate(wanted)))


def _between(i: int, at: Column, end: Callable[[int], Column]) -> Column:
    """Where the i-th place is: at the end `same`, or else between the ends lo and hi (null: none); nth of the values there."""
    mine = range(i * len(SIDES), (i + 1) * len(SIDES))
    below, upto = (lambda j: F.col(f"below{j}")), (lambda j: F.col(f"upto{j}"))
    last = lambda value: F.coalesce(*(F.when(upto(j) <= at, value(j)) for j in reversed(mine)))
    same = lambda value: F.coalesce(*(F.when((below(j) <= at) & (at < upto(j)), value(j)) for j in mine))
    hi = F.coalesce(*(F.when(below(j) > at, end(j)) for j in mine))
    return F.struct(F.lit(i).alias("i"), same(end).alias("same"), last(end).alias("lo"), hi.alias("hi"), (at - F.coalesce(same(below), last(upto), F.lit(0))).alias("nth"))
