"""Reproducing reported results from data: claims bound to columns, computed from one read, compared with the print.

A claim names a method, its columns, the levels it compares, filters on rows and the printed statistic; a token opens
the gate for exactly one claim revision, data fingerprint and binding. Data is only read when a gate is open, and then
once: the moments that all claims need are one aggregate, in which claims that share rows share moments, and each row's
part in a claim is a condition of its own. Statistics of ranks need an order, so each of these is a read of its own.

Stored cells are roundings. A cell with d decimals may have been anything within half a unit of its last place, and what
that could make of a statistic is an interval, computed from the same moments:

* a mean moves by half a unit h at most;
* the root of a sum of squares about means moves by h times the root of n at most (a projection shortens no less);
* the angle between two centred columns moves by the sum of the angles by which either can turn.

A printed number that misses the computed one but meets this interval is could_not_check (data_precision and the
decimals). Decimals are counted in columns of text, known in columns of decimals and whole numbers, and unknown in
columns of doubles, which are taken as they are unless the claim states their decimals. Whole numbers count as rounded
to whole numbers unless the claim says that its column is exact; counts of levels are exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions import numbers
from plumbline.functions.checks import first_reason
from plumbline.operators import stats

SCHEMA = (
    "claim_id string, method string, variant string, printed string, computed double, precision_lo double, precision_hi double, rows_read long, "
    "filtered_out long, missing_in_bound_column long, level_not_selected long, n long, status string, reason string"
)

#: The variants that a method may stand for.
VARIANTS = {
    "independent_t": ("student", "welch"), "paired_t": ("paired",), "one_way": ("one_way",), "pearson": ("pearson",), "spearman": ("spearman",),
    "chi_square": ("uncorrected", "yates"),
}

INFINITY = float("inf")


@dataclass(frozen=True)
class Claim:
    """columns: group and outcome, two outcomes, or two groups. levels: of the group; of both, a tuple each, for two
    groups. filters: (column, levels) that rows must have. variant: the one that is stated, else all are computed.
    exact: columns whose whole numbers are exact. decimals: (column, decimals) where they are known."""

    claim_id: str
    revision: int
    method: str
    columns: tuple[str, ...]
    printed: str
    levels: tuple = ()
    filters: tuple[tuple[str, tuple[str, ...]], ...] = ()
    variant: str | None = None
    exact: tuple[str, ...] = ()
    decimals: tuple[tuple[str, int], ...] = ()

    def token(self, fingerprint: str) -> str:
        """What a person confirms: this revision of the claim, this binding, this data."""
        binding = [self.method, *self.columns, "|", *map(str, self.levels), "|", *map(str, self.filters), "|", str(self.variant), *self.exact, *map(str, self.decimals)]
        return hashlib.sha256("\n".join((fingerprint, self.claim_id, str(self.revision), *binding)).encode()).hexdigest()

    @property
    def variants(self) -> tuple[str, ...]:
        known = VARIANTS.get(self.method, ())
        return known if self.variant is None else tuple(v for v in known if v == self.variant)

    @property
    def groups(self) -> dict[str, tuple[str, ...]]:
        """The columns of levels, with the levels selected."""
        match self.method:
            case "independent_t" | "one_way":
                return {self.columns[0]: tuple(map(str, self.levels))}
            case "chi_square":
                return {c: tuple(map(str, some)) for c, some in zip(self.columns, self.levels, strict=True)}
        return {}

    @property
    def outcomes(self) -> tuple[str, ...]:
        return tuple(c for c in self.columns if c not in self.groups)


def name_of(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def text_of(v: object) -> str:
    """A string as a SQL literal."""
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


class Moments:
    """Aggregates asked for so far, and the values of a row that they need, as SQL text; the same one is computed once."""

    def __init__(self, data: DataFrame):
        self.data, self.known, self.inputs, self.basics = data, {}, {}, {}
        self.kinds = dict(data.dtypes)

    def basic(self, value: str) -> str:
        """The name of a value that others are made of."""
        return self.basics.setdefault(value, f"b{len(self.basics)}")

    def of(self, f: str, *values: str) -> str:
        """The name of an aggregate of values of a row."""
        inputs = [self.inputs.setdefault(v, f"x{len(self.inputs)}") for v in values]
        return self.known.setdefault(f.format(*inputs), f"m{len(self.known)}")

    def frame(self) -> DataFrame:
        rows = self.data.select(*(F.expr(v).alias(n) for v, n in self.basics.items())).select(*(F.expr(v).alias(n) for v, n in self.inputs.items()))
        return rows.agg(*(F.expr(v).alias(n) for v, n in self.known.items()))


class Rows:
    """The rows of a claim: those left by its filters, complete, and of its levels; moments over them as SQL text."""

    def __init__(self, moments: Moments, claim: Claim):
        self.m, self.claim = moments, claim
        one_of = lambda c, levels: moments.basic(f"coalesce(cast({name_of(c)} as string) in ({', '.join(map(text_of, levels))}), false)")
        every = lambda conditions: " and ".join(conditions) or "true"
        kept = every([one_of(c, levels) for c, levels in claim.filters])
        complete = every([moments.basic(f"nullif(trim(cast({name_of(c)} as string)), '') is not null") for c in claim.columns])
        selected = every([one_of(c, levels) for c, levels in claim.groups.items()])
        self.used = f"({kept}) and ({complete}) and ({selected})"
        bad = " or ".join(f"coalesce(isnan({x}) or abs({x}) = double('Infinity'), true)" for x in map(self.number, claim.outcomes)) or "false"
        self.read, self.n = moments.of("count(1)"), moments.of("count_if({})", self.used)
        self.filtered_out, self.missing = moments.of("count_if({})", f"not ({kept})"), moments.of("count_if({})", f"({kept}) and not ({complete})")
        self.other_level = moments.of("count_if({})", f"({kept}) and ({complete}) and not ({selected})")
        self.not_numbers = moments.of("count_if({})", f"({self.used}) and ({bad})")

    def number(self, c: str) -> str:
        return self.m.basic(f"try_cast({name_of(c)} as double)")

    def level(self, c: str, level: object) -> str:
        return self.m.basic(f"coalesce(cast({name_of(c)} as string) = {text_of(level)}, false)")

    def value(self, c: str, level: tuple[str, object] | None = None) -> str:
        of_level = f" and {self.level(*level)}" if level else ""
        return f"if({self.used}{of_level}, {self.number(c)}, null)"

    def squares(self, *columns: str, level: tuple[str, object] | None = None) -> str:
        """named_struct(n, mean, ss): of a column, or of the difference of two; ss is the sum of squares about the mean."""
        values = [self.value(c, level) for c in columns]
        of = lambda f: self.m.of(f"{f}({' - '.join(['{}'] * len(values))})", *values)
        n, mean, var = of("count"), of("avg"), of("var_pop")
        return f"named_struct('n', double({n}), 'mean', {mean}, 'ss', {var} * {n})"

    def decimals(self, c: str) -> str:
        """The most decimals of the used cells of a column; null where that is not known."""
        stated, kind = dict(self.claim.decimals).get(c), self.m.kinds[c]
        if stated is not None:
            return str(int(stated))
        if kind == "string":
            places = self.m.basic(f"length(regexp_extract(trim({name_of(c)}), '[.]([0-9]*)$', 1))")
            return self.m.of("max({})", f"if({self.used}, {places}, null)")
        if kind.startswith("decimal"):
            return kind[:-1].split(",")[1]
        return "cast(null as int)" if kind in ("double", "float") else "0"

    def half(self, c: str) -> str:
        """Half a unit of the last place of the column; 0 where that is not known, and for whole numbers said to be exact."""
        d = self.decimals(c)
        return f"coalesce(if({str(c in self.claim.exact).lower()} and {d} = 0, 0D, 0.5D * pow(10D, -{d})), 0D)"

    def of_variant(self, variant: str) -> str:
        """The struct MOMENTS of the claim and a variant."""
        claim, parts, cov, cells = self.claim, [], "null", "null"
        match claim.method:
            case "independent_t" | "one_way":
                parts = [self.squares(claim.columns[1], level=(claim.columns[0], x)) for x in claim.levels]
            case "paired_t":
                parts = [self.squares(*claim.columns)]
            case "pearson":
                parts = [self.squares(c) for c in claim.columns]
                cov = self.m.of("covar_pop({}, {})", *map(self.value, claim.columns))
            case "chi_square":
                a, b = claim.columns
                of = lambda i, j: f"double({self.m.of('count_if({})', f'({self.used}) and {self.level(a, i)} and {self.level(b, j)}')})"
                cells = f"array({', '.join('array(' + ', '.join(of(i, j) for j in claim.levels[1]) + ')' for i in claim.levels[0])})"
        halves = [self.half(c) for c in claim.outcomes]
        decimals = [self.decimals(c) for c in claim.outcomes]
        values = (
            text_of(claim.claim_id), text_of(claim.method), text_of(variant), text_of(claim.printed), self.read, self.filtered_out, self.missing, self.other_level, self.n,
            f"greatest({', '.join(decimals)})" if len(decimals) > 1 else (*decimals, "0")[0], self.not_numbers, (*halves, "0D")[0], (*halves, "0D", "0D")[1], cov, f"array({', '.join(parts)})" if parts else "null", cells,
        )
        kinds = (c.split(" ", 1) for c in re.split(r", (?=\w+ \w)", MOMENTS))
        return f"named_struct({', '.join(f'{text_of(name)}, cast({v} as {kind})' for v, (name, kind) in zip(values, kinds, strict=True))})"


#: A claim and variant with the moments that its statistic is made of: parts are its groups, columns or differences.
MOMENTS = (
    "claim_id string, method string, variant string, printed string, rows_read long, filtered_out long, missing_in_bound_column long, level_not_selected long, n long, "
    "decimals int, not_numbers long, half double, other_half double, cov double, parts array<struct<n:double,mean:double,ss:double>>, cells array<array<double>>"
)


def spread(ss: Column, n: Column, half: Column) -> tuple[Column, Column]:
    """The least and greatest root of a sum of squares about means, of n cells within half of their values."""
    root, move = F.sqrt(F.greatest(ss, F.lit(0.0))), half * F.sqrt(n)
    return F.greatest(root - move, F.lit(0.0)), root + move


def case(cases: dict[str, Column]) -> Column:
    out = F.lit(None).cast("double")
    for variant, value in cases.items():
        out = F.when(F.col("variant") == variant, value).otherwise(out)
    return out


def statistics(moments: DataFrame) -> DataFrame:
    """Rows of MOMENTS with computed, precision_lo, precision_hi and reason, in place of the moments.

    All but r are quotients: their upper and lower part, and what rounding can make of each, come first."""
    total = lambda value: F.aggregate("parts", F.lit(0.0), lambda s, p: s + F.coalesce(value(p), F.lit(0.0)))
    part = lambda i, c: F.get("parts", F.lit(i))[c]
    rows = moments.select("*", *(part(i, c).alias(f"{c}{i + 1}") for i in (0, 1) for c in ("n", "mean", "ss")), total(lambda p: p["n"]).alias("total"), total(lambda p: p["ss"]).alias("within"), total(lambda p: (p["n"] > 0).cast("double")).alias("full"))
    rows = rows.withColumn("grand", F.try_divide(total(lambda p: p["n"] * p["mean"]), F.col("total")))
    rows = rows.withColumn("between", total(lambda p: p["n"] * (p["mean"] - F.col("grand")) ** 2))
    row_sums, all_sums = F.transform("cells", lambda r: F.aggregate(r, F.lit(0.0), lambda s, x: s + x)), F.aggregate("cells", F.lit(0.0), lambda s, r: s + F.aggregate(r, F.lit(0.0), lambda t, x: t + x))
    column_sums = F.transform(F.get("cells", F.lit(0)), lambda _, j: F.aggregate("cells", F.lit(0.0), lambda s, r: s + F.get(r, j)))
    rows = rows.withColumns({"row_sums": row_sums, "column_sums": column_sums, "all_sums": all_sums})
    n1, n2, s1, s2, h, h2, n = (F.col(c) for c in ("n1", "n2", "ss1", "ss2", "half", "other_half", "total"))

    def gap(i: Column, j: Column, x: Column) -> Column:
        expected = F.try_divide(F.get("row_sums", i) * F.get("column_sums", j), F.col("all_sums"))
        off = F.abs(x - expected)
        return F.try_divide(F.when(F.col("variant") == "yates", off - F.least(F.lit(0.5), off)).otherwise(off) ** 2, expected)

    chi2 = F.aggregate(F.flatten(F.transform("cells", lambda r, i: F.transform(r, lambda x, j: gap(i, j, x)))), F.lit(0.0), lambda s, x: s + x)
    per = F.try_divide  # by zero: null
    pooled, unit, both = F.sqrt(per(per(F.lit(1.0), n1) + per(F.lit(1.0), n2), n1 + n2 - 2)), per(n - F.col("full"), F.col("full") - 1), F.sqrt(n1 * (n1 - 1))
    welch = lambda x, y: F.sqrt(per(x * x, n1 * (n1 - 1)) + per(y * y, n2 * (n2 - 1)))
    diff, (a1, b1), (a2, b2), (a, b) = F.col("mean1") - F.col("mean2"), spread(s1, n1, h), spread(s2, n2, h), spread(s1 + s2, n1 + n2, h)
    (p0, p1), (f0, f1), (w0, w1) = spread(s1, n1, h + h2), spread(F.col("between"), n, h), spread(F.col("within"), n, h)
    one = F.lit(1.0)
    rows = rows.withColumns({
        "upper": case({"student": diff, "welch": diff, "paired": F.col("mean1"), "one_way": F.col("between") * unit, "uncorrected": chi2, "yates": chi2}),
        "lower": case({"student": F.sqrt(s1 + s2) * pooled, "welch": welch(F.sqrt(s1), F.sqrt(s2)), "paired": per(F.sqrt(s1), both), "one_way": F.col("within"), "uncorrected": one, "yates": one}),
        "upper0": case({"student": diff - 2 * h, "welch": diff - 2 * h, "paired": F.col("mean1") - h - h2, "one_way": f0 * f0 * unit, "uncorrected": chi2, "yates": chi2}),
        "upper1": case({"student": diff + 2 * h, "welch": diff + 2 * h, "paired": F.col("mean1") + h + h2, "one_way": f1 * f1 * unit, "uncorrected": chi2, "yates": chi2}),
        "lower0": case({"student": a * pooled, "welch": welch(a1, a2), "paired": per(p0, both), "one_way": w0 * w0, "uncorrected": one, "yates": one}),
        "lower1": case({"student": b * pooled, "welch": welch(b1, b2), "paired": per(p1, both), "one_way": w1 * w1, "uncorrected": one, "yates": one}),
        "turn": angle_of_rounding((h, s1), (h2, s2), n1), "r": F.try_divide(F.col("cov") * n1, F.sqrt(s1) * F.sqrt(s2)),
    })
    over = lambda x, y: F.when(y > 0, x / y).when(x == 0, 0.0).otherwise(F.signum(x) * INFINITY)
    upper0, upper1, lower0, lower1, r, turn = (F.col(c) for c in ("upper0", "upper1", "lower0", "lower1", "r", "turn"))
    angle, is_r = F.acos(F.greatest(F.lit(-1.0), F.least(one, r))), F.col("variant") == "pearson"
    refused = first_reason(
        (F.col("not_numbers") > 0, "not_numeric"),
        (F.col("variant").isin("student", "welch") & ((n1 < 2) | (n2 < 2)) | ((F.col("variant") == "paired") & (n1 < 2)) | (is_r & (n1 < 3)), "too_few_complete_cases"),
        ((F.col("variant") == "one_way") & (F.col("full") < 2), "single_group"), ((F.col("variant") == "one_way") & (n <= F.col("full")), "too_few_complete_cases"),
        (F.coalesce(F.least(F.array_min("row_sums"), F.array_min("column_sums")) == 0, F.lit(False)), "empty_row_or_column"),
        ((F.col("lower") == 0) | (is_r & ((s1 == 0) | (s2 == 0))), "zero_variance"),
    )
    rows = rows.withColumn("reason", refused)
    ok = lambda c: F.when(F.col("reason").isNull(), c)
    return rows.select(
        *(c.split()[0] for c in FOUND.split(", ") if c.split()[0] in moments.columns), ok(F.when(is_r, r).otherwise(F.try_divide("upper", "lower"))).alias("computed"),
        ok(F.when(is_r, F.when(turn == 0, r).otherwise(F.cos(F.least(F.pi(), angle + turn)))).otherwise(over(upper0, F.when(upper0 <= 0, lower0).otherwise(lower1)))).alias("precision_lo"),
        ok(F.when(is_r, F.when(turn == 0, r).otherwise(F.cos(F.greatest(F.lit(0.0), angle - turn)))).otherwise(over(upper1, F.when(upper1 >= 0, lower0).otherwise(lower1)))).alias("precision_hi"),
        "reason",
    )


def angle_of_rounding(x: tuple[Column, Column], y: tuple[Column, Column], n: Column) -> Column:
    """By how much the angle between two centred columns (half a unit and sum of squares each) of n cells can change."""
    one = lambda half, ss: F.coalesce(F.asin(F.least(F.lit(1.0), F.try_divide(half * F.sqrt(n), F.sqrt(ss)))), F.pi()) + F.when(half * F.sqrt(n) >= F.sqrt(ss), F.pi()).otherwise(F.lit(0.0))
    return one(*x) + one(*y)


def compared(found: DataFrame) -> DataFrame:
    """Rows of FOUND with status and reason of the printed number against the computed one and the interval."""
    printed, computed, lo, hi, refused = (F.col(c) for c in ("printed", "computed", "precision_lo", "precision_hi", "reason"))
    rows = found.withColumn("outcome", numbers.printed_matches(printed, computed)).withColumn("shown", numbers.measured(printed))
    a, b = F.col("shown.lo").cast("double"), F.col("shown.hi").cast("double")
    meets = ((a <= hi) & (b >= lo)) | ((-b <= hi) & (-a >= lo))
    rows = rows.withColumn("unsure", F.coalesce((F.col("outcome") == "mismatch") & (lo < hi) & meets, F.lit(False)))
    unknown = refused.isNotNull() | computed.isNull() | F.col("unsure") | (F.col("outcome") == "not_checked")
    status = F.when(unknown, "could_not_check").when(F.col("outcome") == "match", "matched").when(F.col("outcome") == "mismatch", "not_matched").otherwise(F.col("outcome"))
    precise = F.concat(F.lit("data_precision:"), F.col("decimals").cast("string"))
    why = F.coalesce(refused, F.when(F.col("unsure"), precise), F.when(F.col("shown").isNull(), "printed_not_a_number"), F.when(computed.isNull(), "not_computable"))
    return rows.withColumn("status", status).withColumn("reason", why).select(*(c.split()[0] for c in SCHEMA.split(", ")))


#: What is computed for a claim and variant before it is compared.
FOUND = SCHEMA.replace("status string", "decimals int")


def of_ranks(data: DataFrame, claim: Claim) -> DataFrame:
    """A claim of ranks, from a read of its own. Rounding may make or part ties, so an interval is not given."""
    moments = Moments(data)
    rows = Rows(moments, claim)
    named = {f"n{i}": rows.number(c) for i, c in enumerate(claim.columns)}
    used = data.select(*(F.expr(v).alias(n) for v, n in moments.basics.items())).where(rows.used).select(*(F.col(v).alias(c) for c, v in named.items()))
    counts = rows.of_variant("spearman")
    found = moments.frame().select(F.expr(f"inline(array({counts}))")).crossJoin(stats.correlation(used, *named, ranks=True, inference=False).select(F.col("r").alias("computed")))  # one row each
    reason = first_reason((F.col("not_numbers") > 0, "not_numeric"), (F.col("n") < 3, "too_few_complete_cases"), (F.col("computed").isNull(), "zero_variance"))
    none = F.lit(None).cast("double")
    return found.withColumns({"precision_lo": none, "precision_hi": none, "reason": reason})


def reproduced(spark: SparkSession, claims: Sequence[tuple[Claim, str]], fingerprint: str, read: Callable[[], DataFrame]) -> DataFrame:
    """A row for each claim and variant: matched (or truncated and the like), not_matched, or could_not_check; with the
    rows read, dropped for each reason, and used. Null, blank and absent cells are missing; an empty table gives
    could_not_check."""
    refused, opened = [], []
    data: DataFrame | None = None
    for claim, token in claims:
        refusal = "gate_stale" if token != claim.token(fingerprint) else None
        if refusal is None and data is None:
            data = read()
        if refusal is None and (missing := [c for c in (*claim.columns, *(c for c, _ in claim.filters)) if c not in data.columns]):
            refusal = f"unknown_column:{missing[0]}"
        if refusal is None and not claim.variants:
            refusal = "variant_not_available" if claim.method in VARIANTS else "method_not_available"
        if refusal is None and any(len(x) < 2 for x in claim.groups.values()):
            refusal = "levels_not_selected"
        if refusal is None and claim.method == "independent_t" and len(claim.levels) != 2:
            refusal = "levels_not_selected"
        if refusal is None:
            opened.append(claim)
        else:
            refused.append((claim.claim_id, claim.method, None, claim.printed, *[None] * 8, "could_not_check", refusal))
    out = spark.createDataFrame(refused, SCHEMA)
    if one_read := [c for c in opened if c.method != "spearman"]:
        moments = Moments(data)
        rows = [of.of_variant(v) for of in (Rows(moments, c) for c in one_read) for v in of.claim.variants if v != "yates" or [len(x) for x in of.claim.levels] == [2, 2]]
        out = compared(statistics(moments.frame().select(F.expr(f"inline(array({', '.join(rows)}))")))).unionByName(out)
    for claim in opened:
        if claim.method == "spearman":
            out = out.unionByName(compared(of_ranks(data, claim)))
    return out
