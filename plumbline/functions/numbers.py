"""Printed numbers as exact decimal intervals, and checks of reported results against them.

An interval is a struct(lo, hi) of DECIMAL(38, 12); an undefined one is null. Numbers are read from their printed form,
never through a double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KIND = "decimal(38,12)"


def interval(lo: Column, hi: Column) -> Column:
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.cast(KIND).alias("lo"), hi.cast(KIND).alias("hi")))


def literal(printed: Column) -> Column:
    """A count: the point that is printed."""
    value = F.trim(printed).try_cast(KIND)
    return interval(value, value)


def decimals(printed: Column) -> Column:
    return F.length(F.regexp_extract(F.trim(printed), r"\.(\d*)$", 1))


def measured(printed: Column) -> Column:
    """A measured value: half a unit of its last printed place either way."""
    value = F.trim(printed).try_cast(KIND)
    half = F.element_at(F.array(*(F.lit(f"{5 * 10.0 ** -(d + 1):.12f}").cast(KIND) for d in range(11))), F.least(decimals(printed), F.lit(10)) + 1)
    return interval((value - half), (value + half))


def overlaps(a: Column, b: Column) -> Column:
    return (a["lo"] <= b["hi"]) & (b["lo"] <= a["hi"])


def contains_zero(a: Column) -> Column:
    return (a["lo"] <= 0) & (a["hi"] >= 0)


def plus(a: Column, b: Column) -> Column:
    return interval(a["lo"] + b["lo"], a["hi"] + b["hi"])


def minus(a: Column, b: Column) -> Column:
    return interval(a["lo"] - b["hi"], a["hi"] - b["lo"])


def negated(a: Column) -> Column:
    return interval(-a["hi"], -a["lo"])


def times(a: Column, b: Column) -> Column:
    ends = [F.try_multiply(x, y) for x in (a["lo"], a["hi"]) for y in (b["lo"], b["hi"])]
    ok = ends[0].isNotNull() & ends[1].isNotNull() & ends[2].isNotNull() & ends[3].isNotNull()
    return F.when(ok, interval(F.least(*ends), F.greatest(*ends)))


def over(a: Column, b: Column) -> Column:
    """Null where b straddles or touches zero."""
    ends = [F.try_divide(x, y) for x in (a["lo"], a["hi"]) for y in (b["lo"], b["hi"])]
    return F.when(~contains_zero(b), interval(F.least(*ends), F.greatest(*ends)))


def to_power(a: Column, n: int) -> Column:
    """A whole power from 0 to 8, by repeated multiplication of the ends (even powers straddling zero start at 0)."""
    if n == 0:
        return interval(F.lit(1), F.lit(1))
    lo, hi = a["lo"], a["hi"]
    for _ in range(n - 1):
        lo, hi = F.try_multiply(lo, a["lo"]).cast(KIND), F.try_multiply(hi, a["hi"]).cast(KIND)
    least = F.when(contains_zero(a) & F.lit(n % 2 == 0), F.lit(0).cast(KIND)).otherwise(F.least(lo, hi))
    return F.when(lo.isNotNull() & hi.isNotNull(), interval(least, F.greatest(lo, hi)))


def df_matches_n(family: Column, n: Column, df: Column, partial: Column) -> Column:
    """r with n in its unit: n - 2 must lie in the printed df. struct(verdict, reason)."""
    reason = F.when(family != "r", "not_applicable").when(n.isNull() | df.isNull(), "not_reported").when(partial, "partial_correlation")
    d = measured(df)
    verdict = F.when(reason.isNotNull(), "could_not_check").when(((n - 2) >= d["lo"]) & ((n - 2) <= d["hi"]), "consistent").otherwise("inconsistent")
    return F.struct(verdict.alias("verdict"), reason.alias("reason"))


def percent_matches_count(count: Column, total: Column, percent: Column) -> Column:
    """100 * count / total within the printed percentage, by cross-multiplication. struct(verdict, reason)."""
    p, c, d = measured(percent), count.cast("decimal(18,0)"), total.cast("decimal(18,0)")
    reason = F.when(count.isNull() | total.isNull() | p.isNull(), "invalid_input").when(total <= 0, "invalid_input")
    inside = (p["lo"].cast("decimal(20,8)") * d <= 100 * c) & (100 * c <= p["hi"].cast("decimal(20,8)") * d)
    return F.struct(F.when(reason.isNotNull(), "could_not_check").when(inside, "consistent").otherwise("inconsistent").alias("verdict"), reason.alias("reason"))


def grim(mean: Column, n: Column, items: Column, whole: Column) -> Column:
    """Can a mean of n * items whole numbers print as this? struct(verdict, reason); uninformative where every print can.

    whole: the scores are whole numbers, without which there is nothing to check."""
    m, parts = measured(mean), (n * items).cast("decimal(18,0)")
    lo, hi = F.ceil(m["lo"].cast("decimal(20,8)") * parts), F.floor(m["hi"].cast("decimal(20,8)") * parts)
    unit = F.pow(F.lit(10.0), decimals(mean).cast("double"))
    reason = F.when(m.isNull() | n.isNull() | (n <= 0), "invalid_input").when(~whole, "not_whole_numbers").when(parts >= unit, "uninformative")
    return F.struct(F.when(reason.isNotNull(), "could_not_check").when(lo <= hi, "consistent").otherwise("inconsistent").alias("verdict"), reason.alias("reason"))


def grim_percent(percent: Column, n: Column) -> Column:
    """Can a share of n whole cases print as this percentage? struct(verdict, reason); uninformative where every print
    can, that is from as many cases as there are prints."""
    p, parts = measured(percent), n.cast("decimal(18,0)")
    lo, hi = F.ceil(p["lo"].cast("decimal(20,8)") * parts / 100), F.floor(p["hi"].cast("decimal(20,8)") * parts / 100)
    unit = F.pow(F.lit(10.0), decimals(percent).cast("double") + 2)
    reason = F.when(p.isNull() | n.isNull() | (n <= 0) | (p["hi"] < 0) | (p["lo"] > 100), "invalid_input").when(parts >= unit, "uninformative")
    possible = F.greatest(lo, F.lit(0)) <= F.least(hi, parts)
    return F.struct(F.when(reason.isNotNull(), "could_not_check").when(possible, "consistent").otherwise("inconsistent").alias("verdict"), reason.alias("reason"))


def estimate_in_interval(estimate: Column, low: Column, high: Column) -> Column:
    """The estimate against its interval: consistent, concern where its negation or reciprocal is inside, else not."""
    e, lo, hi = measured(estimate), measured(low)["lo"], measured(high)["hi"]
    point = F.trim(estimate).try_cast(KIND)
    inside = (e["hi"] >= lo) & (e["lo"] <= hi)
    turned = ((-point >= lo) & (-point <= hi)) | ((F.try_divide(F.lit(1).cast(KIND), point) >= lo) & (F.try_divide(F.lit(1).cast(KIND), point) <= hi))
    reason = F.when(e.isNull() | lo.isNull() | hi.isNull() | (lo > hi), "invalid_input")
    return F.struct(F.when(reason.isNotNull(), "could_not_check").when(inside, "consistent").when(turned, "concern").otherwise("inconsistent").alias("verdict"), F.when(reason.isNotNull(), reason).when(~inside & turned, "estimate_direction").alias("reason"))


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts in their canonical text, one a line; a null is the word null."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)), 256)


def printed_matches(printed: Column, computed: Column) -> Column:
    """How a printed number agrees with a computed one: match, truncated, double_rounded, sign_dropped or mismatch."""
    d, p = decimals(printed), F.trim(printed).try_cast("double")
    scale = F.pow(F.lit(10.0), d.cast("double"))
    tol = 0.5 / scale * (1 + 1e-9)
    cut = F.when(computed >= 0, F.floor(computed * scale)).otherwise(F.ceil(computed * scale)) / scale
    twice = F.round(F.floor(F.abs(computed) * scale * 10 + 0.5) / 10) / scale
    return (
        F.when(p.isNull() | computed.isNull() | F.isnan(computed), "not_checked").when(F.abs(p - computed) <= tol, "match").when(F.abs(p - cut) < tol / 1000, "truncated")
        .when(F.abs(F.abs(p) - twice) < tol / 1000, "double_rounded").when(F.abs(-p - computed) <= tol, "sign_dropped").otherwise("mismatch")
    )
