"""Descriptive and inferential statistics of a table's columns as grouped aggregations.

Second moments are taken about a shift known beforehand (a minimum or a mean), so that large offsets do not cancel.
What cannot be computed is null with a reason code beside it, never 0."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions import dist
from plumbline.functions.checks import exclusion
from plumbline.operators import quantiles

SUMMARY = ("n", "missing", "mean", "sd", "min", "q1", "median", "q3", "max")


#: Ranges that ranks are counted in, at least; the smallest double of full precision.
RANGES, TINY = 64, 2.2250738585072014e-308


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each column: SUMMARY and reason. sd has n - 1 and is null below two values; quartiles are type 7.

    One wide aggregate gives all but sd and the quartiles, and brackets for these; a second counts what lies below each
    bracket and squares about the minimum, a third puts in order what lies within. The driver sees one row of each, and two values a quartile and column."""
    shares = (0.25, 0.5, 0.75)
    eps = 2 / quantiles.ACCURACY
    rows = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)))
    each = {"n": F.count, "missing": lambda x: F.count_if(F.col(x).isNull()), "mean": F.avg, "min": F.min, "max": F.max, "ends": lambda x: F.percentile_approx(x, [s + side * eps for s in shares for side in (-1, 1)], quantiles.ACCURACY)}
    first = rows.agg(*(f(f"x{i}").alias(f"{name}{i}") for i in range(len(columns)) for name, f in each.items())).first()
    known = [i for i in range(len(columns)) if first[f"n{i}"]]
    bracket = {(i, k): (first[f"ends{i}"][2 * k], first[f"ends{i}"][2 * k + 1]) for i in known for k in range(len(shares))}
    beyond = [F.stddev_samp(F.col(f"x{i}") - first[f"min{i}"]).alias(f"sd{i}") for i in known]  # about a shift, so that large offsets do not cancel
    for (i, k), (lo, hi) in bracket.items():
        x = F.col(f"x{i}")
        beyond += [F.count_if(x < lo).alias(f"below{i}_{k}"), F.max(F.when(x < lo, x)).alias(f"down{i}_{k}"), F.min(F.when(x > hi, x)).alias(f"up{i}_{k}")]
    second = rows.agg(*beyond).first() if beyond else None
    places = {key: (first[f"n{key[0]}"] - 1) * shares[key[1]] for key in bracket}
    wanted = [(i, k, int(at), math.ceil(places[i, k])) for (i, k), at in places.items()]
    values: dict[tuple[int, int, int], float] = {}
    if bracket:
        cells = F.array(*(F.when(F.col(f"x{i}").between(lo, hi), F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.col(f"x{i}").alias("x"))) for (i, k), (lo, hi) in bracket.items()))
        near = reduce(Column.__or__, (F.col(f"x{i}").between(lo, hi) for (i, _), (lo, hi) in bracket.items()))
        within = rows.where(near).select(F.inline(F.filter(cells, lambda c: c.isNotNull()))).groupBy("i", "k", "x").agg(F.count("*").alias("c"))
        within = within.withColumn("upto", F.sum("c").over(W.partitionBy("i", "k").orderBy("x")))
        asked = df.sparkSession.createDataFrame([(i, k, at, at - second[f"below{i}_{k}"]) for i, k, low, high in wanted for at in {low, high}], "i int, k int, at long, nth long")
        found = within.join(F.broadcast(asked), ["i", "k"]).where((F.col("upto") > F.col("nth")) & (F.col("upto") - F.col("c") <= F.col("nth")))  # two rows a quartile and column
        values = {(r.i, r.k, r["at"]): r.x for r in found.select("i", "k", "at", "x").collect()}

    def quartile(i: int, k: int) -> float:
        def at(place: int) -> float:
            outside = second[f"down{i}_{k}"] if place < second[f"below{i}_{k}"] else second[f"up{i}_{k}"]
            return values.get((i, k, place), outside)

        place = places[i, k]
        low, high = at(int(place)), at(math.ceil(place))
        return low + (high - low) * (place - int(place)) if low != high else low

    out = []
    for i, c in enumerate(columns):
        n, mean = first[f"n{i}"], first[f"mean{i}"]
        reason = "stats.desc.no_values" if not n else "stats.desc.single_value" if n == 1 else None if math.isfinite(mean) else "stats.desc.overflow"
        out.append((c, n, first[f"missing{i}"], mean, second[f"sd{i}"] if n > 1 else None, first[f"min{i}"], *(quartile(i, k) if n else None for k in range(len(shares))), first[f"max{i}"], reason))
    return df.sparkSession.createDataFrame(out, "column string, n long, missing long, mean double, sd double, min double, q1 double, median double, q3 double, max double, reason string")


def categorical_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, level and n for each level, in code-point order; the level of missing values is null."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns))))
    return long.groupBy("column", "level").agg(F.count("*").alias("n")).orderBy("column", "level")


def profile(df: DataFrame) -> DataFrame:
    """alias (C1, C2, ...), header, kind (numeric, categorical or empty), n, missing and n_distinct of each column of
    strings; numeric if every value that is there is a number."""
    cells = [F.struct(F.lit(f"C{i}").alias("alias"), F.lit(c).alias("header"), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("x")) for i, c in enumerate(df.columns, 1)]
    out = df.select(F.inline(F.array(*cells))).groupBy("alias", "header").agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.count_distinct("x").alias("n_distinct"), F.count(F.col("x").try_cast("double")).alias("numbers"))
    kind = F.when(F.col("n") == 0, "empty").when(F.col("n") == F.col("numbers"), "numeric").otherwise("categorical")
    return out.select("alias", "header", kind.alias("kind"), "n", "missing", "n_distinct")


def exclusion_counts(df: DataFrame, group: str, outcome: str, levels: Sequence[str], missing_codes: Sequence[float] = ()) -> DataFrame:
    """How many rows each reason takes out, the first that applies counting; "used" is the rest."""
    return df.groupBy(exclusion(F.col(group), F.col(outcome), levels, missing_codes).alias("reason")).agg(F.count("*").alias("n"))


def two_groups(df: DataFrame, group: str, outcome: str, levels: tuple[str, str]) -> DataFrame:
    """One row: n, mean and var (n - 1) of each of two levels; squares are about the groups' own means."""
    used = df.where(F.col(group).isin(*levels) & F.col(outcome).isNotNull()).select(F.col(group).alias("g"), F.col(outcome).cast("double").alias("y"))
    means = used.groupBy("g").agg(F.count("*").alias("n"), F.avg("y").alias("mean"))
    spread = used.join(F.broadcast(means), "g").groupBy("g").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.sum((F.col("y") - F.col("mean")) ** 2).alias("ss"))  # two rows
    of = lambda level, c: F.max(F.when(F.col("g") == level, F.col(c)))
    return spread.agg(*(of(level, c).alias(f"{c}{i}") for i, level in enumerate(levels, 1) for c in ("n", "mean", "ss"))).select("n1", "mean1", "n2", "mean2", *(F.try_divide(F.col(f"ss{i}"), F.col(f"n{i}") - 1).alias(f"var{i}") for i in (1, 2)))


def t_test(df: DataFrame, group: str, outcome: str, levels: tuple[str, str], welch: bool, inference: bool = True) -> DataFrame:
    """One row: t, df, diff, se, d, sd_ratio and reason; with inference, p and the 95 % interval too."""
    g = two_groups(df, group, outcome, levels)
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "var1", "var2"))
    if welch:
        a, b = v1 / n1, v2 / n2
        se, dof, unit = F.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)), F.sqrt((v1 + v2) / 2)
    else:
        pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
        se, dof, unit = F.sqrt(pooled * (1 / n1 + 1 / n2)), (n1 + n2 - 2).cast("double"), F.sqrt(pooled)
    diff = F.col("mean1") - F.col("mean2")
    reason = (
        F.when(F.lit(levels[0] == levels[1]), "stats.ttest.levels_equal").when(F.coalesce(n1, F.lit(0)) < 2, "stats.ttest.group_too_small").when(F.coalesce(n2, F.lit(0)) < 2, "stats.ttest.group_too_small")
        .when((v1 == 0) & (v2 == 0), "stats.ttest.both_groups_constant")
    )
    ok = lambda c: F.when(reason.isNull(), c)
    out = g.select(
        "n1", "n2", "mean1", "mean2", ok(diff).alias("diff"), ok(se).alias("se"), ok(diff / se).alias("t"), ok(dof).alias("df"), ok(diff / unit).alias("d"),
        ok(F.when(F.least(v1, v2) > 0, F.sqrt(F.greatest(v1, v2)) / F.sqrt(F.least(v1, v2)))).alias("sd_ratio"), reason.alias("reason"),
    )
    if inference:
        q = dist.t_quantile_975("df")
        out = out.withColumn("p", dist.t_two_tailed("t", "df")).withColumn("q", q)
        out = out.withColumn("ci_low", F.col("diff") - F.col("q") * F.col("se")).withColumn("ci_high", F.col("diff") + F.col("q") * F.col("se"))
        out = out.withColumn("reason", F.coalesce("reason", F.when(F.col("q").isNull(), "stats.ttest.quantile_out_of_range"))).drop("q")
    return out


def paired_t(df: DataFrame, a: str, b: str, inference: bool = True) -> DataFrame:
    """n, mean_diff, sd_diff, t and df of a - b over complete pairs; with inference, p."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select((F.col(a).cast("double") - F.col(b).cast("double")).alias("d"))
    out = pairs.agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff"))
    out = out.select("n", "mean_diff", "sd_diff", F.try_divide(F.col("mean_diff"), F.col("sd_diff") / F.sqrt("n")).alias("t"), (F.col("n") - 1).alias("df"))
    return out.withColumn("p", dist.t_two_tailed("t", F.col("df").cast("double"))) if inference else out


def anova(df: DataFrame, group: str, outcome: str, inference: bool = True) -> DataFrame:
    """n, groups, ss_between, ss_within, df1, df2 and f over complete cases, squares about the groups' means; with
    inference, p.

    Group sums are aggregated first and joined back, so that a group with most rows is in no task whole."""
    used = df.where(F.col(group).isNotNull() & F.col(outcome).isNotNull()).select(F.col(group).alias("g"), F.col(outcome).cast("double").alias("y"))
    means = used.groupBy("g").agg(F.count("*").alias("n"), F.avg("y").alias("mean"))
    within = used.join(means, "g").agg(F.sum((F.col("y") - F.col("mean")) ** 2).alias("ss_within"))
    grand = means.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    between = means.crossJoin(grand).agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ss_between"))  # one row each
    out = between.crossJoin(within).withColumn("df1", F.col("groups") - 1).withColumn("df2", F.col("n") - F.col("groups"))
    out = out.withColumn("f", F.try_divide(F.try_divide("ss_between", "df1"), F.try_divide("ss_within", "df2")))
    return out.withColumn("p", dist.f_upper("f", F.col("df1").cast("double"), F.col("df2").cast("double"))) if inference else out


def ranked_values(counts: DataFrame, out: str) -> DataFrame:
    """The distinct values of counts (value, n) with their average rank over all n.

    Counts are summed up over ranges, so that the order of the values as a whole is never needed."""
    ranges = max(RANGES, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = counts.agg(F.approx_percentile("value", [i / ranges for i in range(1, ranges)]).alias("q")).first()["q"] or []
    known = F.array(*(F.lit(x) for x in sorted({float(x) for x in edges if x == x})) or [F.lit(0.0)])
    parts = counts.withColumn("part", F.size(F.filter(known, lambda e: e < F.col("value"))))  # by fixed edges, whatever the partitions
    before = parts.groupBy("part").agg(F.sum("n").alias("total")).select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))  # one row a range
    within = F.sum("n").over(W.partitionBy("part").orderBy("value"))
    return parts.withColumn("upto", within).join(F.broadcast(before), "part").select("value", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias(out))


def correlation(df: DataFrame, x: str, y: str, ranks: bool = False, inference: bool = True) -> DataFrame:
    """n, r and df of Pearson's r, or of Spearman's with ranks, over complete cases; with inference, p (of t).

    Ranks are given to distinct values, and pairs of values are counted before they meet their ranks, whose mean is known
    beforehand."""
    used = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if ranks:
        pairs = used.groupBy("x", "y").agg(F.count("*").alias("n"))
        rx, ry = (ranked_values(used.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")), f"r{c}").withColumnRenamed("value", c) for c in ("x", "y"))
        total = used.agg(F.count("*").alias("all"))
        met = pairs.join(rx, "x").join(ry, "y").crossJoin(F.broadcast(total))  # one row
        a, b = F.col("rx") - (F.col("all") + 1) / 2, F.col("ry") - (F.col("all") + 1) / 2
        sums = met.agg(F.sum("n").alias("n"), F.sum(F.col("n") * a * b).alias("ab"), F.sum(F.col("n") * a * a).alias("aa"), F.sum(F.col("n") * b * b).alias("bb"))
        out = sums.select(F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")).alias("r"))
    else:
        out = used.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    out = out.withColumn("df", F.col("n") - 2)
    return out.withColumn("p", dist.r_two_tailed("r", F.col("df").cast("double"))) if inference else out


def chi_square(df: DataFrame, a: str, b: str, inference: bool = True) -> DataFrame:
    """n, chi2, df and, with inference, p of independence, uncorrected: n * (sum of o * o / (row total * column total) - 1), for which
    empty cells need not be made."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("cb"))
    o = F.col("o").cast("double")
    out = cells.join(rows, "a").join(cols, "b").agg(F.sum("o").alias("n"), F.sum(o * o / (F.col("ra") * F.col("cb"))).alias("share"), F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"))
    out = out.select("n", (F.col("n") * (F.col("share") - 1)).alias("chi2"), ((F.col("na") - 1) * (F.col("nb") - 1)).alias("df"))
    return with_chi_square_p(out) if inference else out


def with_chi_square_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", dist.chi_square_upper("chi2", F.col("df").cast("double")))


def chi_square_yates(df: DataFrame, a: str, b: str, levels_a: tuple, levels_b: tuple, inference: bool = True) -> DataFrame:
    """n, chi2, df and, with inference, p of a two by two table, each |O - E| less the smaller of itself and 1/2."""
    cell = {(i, j): F.count_if((F.col(a) == x) & (F.col(b) == y)).cast("double").alias(f"o{i}{j}") for i, x in enumerate(levels_a) for j, y in enumerate(levels_b)}
    o = {k: F.col(f"o{k[0]}{k[1]}") for k in cell}
    n = o[0, 0] + o[0, 1] + o[1, 0] + o[1, 1]
    total = F.lit(0.0)
    for i, j in o:
        e = (o[i, 0] + o[i, 1]) * (o[0, j] + o[1, j]) / n
        gap = F.abs(o[i, j] - e)
        total += (gap - F.least(F.lit(0.5), gap)) ** 2 / e
    out = df.agg(*cell.values()).select(n.cast("long").alias("n"), total.alias("chi2"), F.lit(1).alias("df"))
    return with_chi_square_p(out) if inference else out


def least_squares(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """A row for each term: coefficient, se and t; with r2, f, df1, df2 and reason of the whole. Complete cases.
    with_p adds p of each t and of F.

    One pass for means, one for centred cross-products; the system of len(xs) equations, however many rows there are,
    is solved on the driver."""
    import numpy as np

    names = [*xs, y]
    used = df.select(*(F.col(c).cast("double").alias(c) for c in names)).dropna()
    means = used.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in names)).first()
    n, k = means["n"], len(xs)
    schema = "term string, coefficient double, se double, t double, r2 double, f double, df1 long, df2 long, reason string"
    if n <= k + 1:
        return df.sparkSession.createDataFrame([(None, None, None, None, None, None, k, n - k - 1, "stats.ols.too_few_cases")], schema)
    centred = {c: F.col(c) - F.lit(means[c]) for c in names}
    products = used.agg(*(F.sum(centred[a] * centred[b]).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)).first()
    s = np.array([[products[f"{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    scale = np.sqrt(np.maximum(np.diag(s)[:k], 1e-300))
    scaled = s[:k, :k] / np.outer(scale, scale)
    if np.linalg.matrix_rank(scaled, tol=1e-10) < k:
        return df.sparkSession.createDataFrame([(None, None, None, None, None, None, k, n - k - 1, "stats.ols.singular_design")], schema)
    inverse = np.linalg.inv(scaled) / np.outer(scale, scale)
    beta = inverse @ s[:k, k]
    explained = float(beta @ s[:k, k])
    rest = float(s[k, k]) - explained
    df2 = n - k - 1
    m = np.array([means[c] for c in xs])
    var = rest / df2 * np.concatenate([[1 / n + m @ inverse @ m], np.diag(inverse)])
    coefficients = [means[y] - float(m @ beta), *map(float, beta)]
    f, r2 = explained / k / (rest / df2) if rest > 0 else None, explained / float(s[k, k]) if s[k, k] > 0 else None
    rows = [(term, c, float(np.sqrt(v)), c / float(np.sqrt(v)) if v > 0 else None, r2, f, k, df2, None) for term, c, v in zip(["(intercept)", *xs], coefficients, var, strict=True)]
    return df.sparkSession.createDataFrame(rows, schema)


def with_p(ols: DataFrame) -> DataFrame:
    """least_squares with p of each coefficient (two-tailed, on df2) and f_p of the whole (upper tail)."""
    df1, df2 = F.col("df1").cast("double"), F.col("df2").cast("double")
    return ols.withColumn("p", dist.t_two_tailed("t", df2)).withColumn("f_p", dist.f_upper("f", df1, df2))


def range_refusals(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, column, n and reason: whether squares of the cells leave the range of doubles. overflow: a mean or sum of
    squares is infinite, though no cell is; underflow: cells differ, and yet their squares sum to 0 or below the smallest
    number of full precision; non_finite_input: a cell is no finite number. Null where nothing is wrong.

    One aggregate; what is infinite only between two steps of a test is found here, not in its plausible result."""
    cells = df.select(*by, F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))))
    x = F.col("x")
    sums = cells.groupBy(*by, "column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(x * x).alias("squares"), F.max(F.abs("x")).alias("far"), F.bool_or(F.isnan("x") | (F.abs("x") == float("inf"))).alias("bad"))
    infinite = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    reason = (
        F.when(F.coalesce("bad", F.lit(False)), "non_finite_input").when(infinite("mean") | infinite("var") | infinite("squares"), "overflow")
        .when(((F.col("lo") < F.col("hi")) & (F.col("var") < TINY)) | ((F.col("far") > 0) & (F.col("squares") < TINY)), "underflow")
    )
    return sums.select(*by, "column", "n", reason.alias("reason"))
