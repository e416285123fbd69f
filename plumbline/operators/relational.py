"""Store queries: lookups, keyed joins, counts and upserts over DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.operators import quantiles


def optional_filter(df: DataFrame, given: Mapping[str, object]) -> DataFrame:
    """Equality on each column whose value is given; None leaves the column free."""
    for c, value in given.items():
        if value is not None:
            df = df.where(F.col(c) == value)
    return df


def of_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is in a table of ids."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)), id_col, "left_semi")


def missing_from(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key other lacks: work still to be done, or orphans."""
    return df.join(other.select(*keys), list(keys), "left_anti")


def in_rank_order(df: DataFrame, id_col: str, ranked: DataFrame) -> DataFrame:
    """The rows of ranked's ids with rank (ranked: id_col, rank), in that order."""
    return df.join(ranked, id_col).orderBy("rank")


def fresh(df: DataFrame, now: int) -> DataFrame:
    """Cache rows that live on: created_at + ttl_seconds > now."""
    return df.where(F.col("created_at") + F.col("ttl_seconds") > now)


def without_stale(df: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """What stays of a cache, and one row n with how many went."""
    stale = F.col("created_at") + F.col("ttl_seconds") <= now
    return df.where(~stale), df.agg(F.count_if(stale).alias("n"))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """old with new's rows in place of those of the same keys; the latest by time counts, new over old at a tie."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    values = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(time, "__new")).alias("row")).select(*keys, "row.*").select(*old.columns)


def newest(df: DataFrame, n: int, time: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """The newest n rows, of each group if by is given."""
    order = (F.desc(time), F.desc(tie))
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def id_changes(old: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """id_col and change: added or removed."""
    sides = old.select(id_col, F.lit(True).alias("o")).distinct().join(new.select(id_col, F.lit(True).alias("n")).distinct(), id_col, "full")
    return sides.where(F.col("o").isNull() | F.col("n").isNull()).select(id_col, F.when(F.col("o").isNull(), "added").otherwise("removed").alias("change"))


def with_outcome(log: DataFrame, outcomes: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """An append-only log with outcomes (id_col, outcome) attached; and the outcomes whose id the log lacks."""
    rest = log.drop("outcome")
    return rest.join(outcomes, id_col, "left"), missing_from(outcomes, log, [id_col])


def tally(df: DataFrame, by: Sequence[str], **counted: Column) -> DataFrame:
    """Per group n and one count for each named condition."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in counted.items()))


def gated_verdicts(sent: DataFrame, answered: DataFrame) -> DataFrame:
    """Each sent (id, evidence array) with its verdict from answered (id, verdict, confidence, refs), or unknown: no
    answer, no evidence, or a reference that was never sent."""
    rows = sent.join(answered, "id", "left")
    strange = F.size(F.array_except("refs", "evidence")) > 0
    reason = F.when(F.col("verdict").isNull(), "missing_from_response").when(strange, "potential_hallucination").when(F.size("evidence") == 0, "no_evidence")
    return rows.select(
        "id", F.when(reason.isNull(), F.col("verdict")).otherwise("unknown").alias("verdict"), F.when(reason.isNull(), F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(reason.isNull(), F.col("refs")).otherwise(F.array().cast("array<string>")).alias("refs"), reason.alias("reason"),
    )


def precision_recall(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, precision and recall; null where there is nothing to divide by."""
    out = df.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"))
    return out.select("tp", "fp", "fn", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def stratified_share(population: DataFrame, sample: DataFrame, stratum: str, hit: Column) -> DataFrame:
    """The share of hits weighed by the strata's sizes in the population; null if one of them has no sample."""
    sizes = population.groupBy(stratum).agg(F.count("*").alias("size"))
    seen = sample.groupBy(stratum).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    rows = sizes.join(seen, stratum, "left")
    share = F.sum(F.col("size") * F.col("hits") / F.col("n")) / F.sum("size")
    return rows.agg(F.sum("size").alias("population"), F.sum("n").alias("sampled"), F.when(~F.bool_or(F.col("n").isNull()), share).alias("share"))


def gate(deltas: DataFrame, drop: str = "delta", deterministic: str = "deterministic", margin: float = 0.01) -> DataFrame:
    """A verdict for each family's change: a lost determinism blocks, a fall rolls back, a rise promotes, else hold."""
    verdict = F.when(~F.col(deterministic), "BLOCKED").when(F.col(drop) < -margin, "ROLLBACK").when(F.col(drop) > margin, "PROMOTE").otherwise("HOLD")
    return deltas.withColumn("verdict", verdict)


def floor_percentile(df: DataFrame, by: Sequence[str], x: str, shares: Sequence[float], nearest: bool = False) -> DataFrame:
    """Per group and share p the value at index floor((n - 1) * p) of the sorted values, or round() of it with nearest.

    By selection: only values near the wanted places are put in order."""
    position = quantiles.nearest_position if nearest else quantiles.floor_position
    return quantiles.selected(df, by, x, [(f"p{round(p * 100)}", p, position) for p in shares])


def quota_consumed(events: DataFrame, keys: Sequence[str], time: str, tie: str, limit: int) -> DataFrame:
    """events with period (month), nth and granted: the first `limit` of a key and month go through."""
    rows = events.withColumn("period", F.trunc(time, "month"))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy(*keys, "period").orderBy(time, tie)))
    return rows.withColumn("granted", F.col("nth") <= limit)


def owned_by(df: DataFrame, owner: str, user: str) -> DataFrame:
    """The rows that a user may see."""
    return df.where(F.col(owner) == user)


def changed_protected(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose new row changes a column that must stay, with those columns' names."""
    rows = old.alias("o").join(new.alias("n"), key)
    names = F.filter(F.array(*(F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    return rows.select(key, names.alias("changed")).where(F.size("changed") > 0)


def touching(edges: DataFrame, seeds: DataFrame, source: str = "source", target: str = "target", key: str = "id") -> DataFrame:
    """The edges with a seed at either end, each once."""
    asked = seeds.select(F.col(key).alias("__k")).distinct()
    ends = edges.select(source, F.explode(F.array_distinct(F.array(source, target))).alias("__k"), F.struct(*edges.columns).alias("__e"))
    hit = ends.join(asked, "__k", "left_semi").groupBy("__e").agg(F.count("*").alias("__n"))
    return edges.join(hit.select(*(F.col(f"__e.{c}").alias(c) for c in edges.columns)), edges.columns, "left_semi")
