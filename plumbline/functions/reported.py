"""Reported test results against their own p: recomputed over the interval that the printed statistic stands for.

A result has family (t, F, chi_square, r, z), statistic (printed), df1, df2, relation (=, <, >), p (printed), alpha, and
what its document says of it: one_tailed, adjusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import dist, numbers

#: A recomputed p is widened by this share before it is compared.
MARGIN = 1e-8


def p_of(family: Column, x: Column, df1: Column, df2: Column) -> Column:
    """The p of a statistic, two-tailed for t, r and z, upper for F and chi-square."""
    one = F.lit(1.0)
    return (
        F.when(family == "t", dist.t_two_tailed(x, df1)).when(family == "F", dist.f_upper(F.abs(x), df1, F.coalesce(df2, one))).when(family == "chi_square", dist.chi_square_upper(F.abs(x), df1))
        .when(family == "r", dist.r_two_tailed(x, df1)).when(family == "z", dist.z_two_tailed(x))
    )


def p_consistency(results: DataFrame) -> DataFrame:
    """results with p_low, p_high (over the statistic's interval), verdict, reason and conclusion_changes.

    consistent; concern: the print fits only one-tailed (unstated) or as a two-tailed F; inconsistent; could_not_check,
    with the reason. conclusion_changes: printed and recomputed p lie on different sides of alpha."""
    x = numbers.measured(F.col("statistic"))
    rows = results.withColumn("__x", x).withColumn("__p", numbers.measured(F.col("p")))
    rows = rows.withColumn("__lo", F.col("__x.lo").cast("double")).withColumn("__hi", F.col("__x.hi").cast("double"))
    near = F.when((F.col("__lo") <= 0) & (F.col("__hi") >= 0), F.lit(0.0)).otherwise(F.least(F.abs("__lo"), F.abs("__hi")))
    far = F.greatest(F.abs("__lo"), F.abs("__hi"))
    df1, df2 = F.col("df1").cast("double"), F.col("df2").cast("double")
    rows = rows.withColumn("__near", near).withColumn("__far", far)
    rows = rows.withColumn("p_high", p_of(F.col("family"), F.col("__near"), df1, df2) * (1 + MARGIN)).withColumn("p_low", p_of(F.col("family"), F.col("__far"), df1, df2) * (1 - MARGIN))
    printed = F.trim("p").try_cast("double")
    alpha = F.coalesce(F.col("alpha").cast("double"), F.lit(0.05))
    floor = F.when(printed == 0, F.col("__p.hi").cast("double"))

    def fits(lo: Column, hi: Column) -> Column:
        equal = (F.col("__p.lo").cast("double") <= hi) & (F.col("__p.hi").cast("double") >= lo)
        return F.when(floor.isNotNull(), lo < floor).when(F.col("relation") == "<", lo < printed).when(F.col("relation") == ">", hi > printed).otherwise(equal)

    scale = F.when(F.coalesce("one_tailed", F.lit(False)), 0.5).otherwise(1.0)
    lo, hi = F.col("p_low") * scale, F.col("p_high") * scale
    least = (F.col("relation") == "=") & (printed > 0) & (F.log10(printed) == F.floor(F.log10(printed))) & (printed <= 0.001) & (hi < printed)
    reason = (
        F.when(F.col("__x").isNull() | F.col("__p").isNull(), "not_readable").when(F.coalesce("adjusted", F.lit(False)), "adjusted_p")
        .when(F.col("family").isin("t", "r") & (df1 > dist.VERDICT_DF), "df_beyond_measured_range").when(hi.isNull() | lo.isNull(), "not_computable")
    )
    concern = F.when(~F.coalesce("one_tailed", F.lit(False)) & F.col("family").isin("t", "r", "z") & fits(lo / 2, hi / 2), "one_tailed_unstated").when((F.col("family") == "F") & fits(F.least(2 * lo, F.lit(1.0)), F.least(2 * hi, F.lit(1.0))), "f_two_tailed")
    verdict = F.when(reason.isNotNull(), "could_not_check").when(fits(lo, hi) | least, "consistent").when(concern.isNotNull(), "concern").otherwise("inconsistent")
    out = rows.withColumn("verdict", verdict)
    note = F.coalesce(reason, F.when(~fits(lo, hi) & least, "floor_printed_as_equality"), F.when(F.col("verdict") == "concern", concern))
    below = F.when(F.col("relation") == "<", printed <= alpha).when(F.col("relation") == ">", F.lit(False)).otherwise(printed < alpha)
    changes = (F.col("verdict") == "inconsistent") & ((below & (lo >= alpha)) | (~below & (hi < alpha)))
    return out.select(*results.columns, "p_low", "p_high", "verdict", note.alias("reason"), changes.alias("conclusion_changes"))


def manuscript_rules(results: DataFrame) -> DataFrame:
    """Findings on reported results (doc_id, family, effect_size, interval, groups): no effect size, no interval, a t test
    over more than two groups."""
    cases = [(F.col("effect_size").isNull(), "missing_effect_size"), (F.col("interval").isNull(), "missing_interval"), ((F.col("family") == "t") & (F.col("groups") > 2), "test_group_mismatch")]
    found = F.filter(F.array(*(F.when(c, F.lit(code)) for c, code in cases)), lambda x: x.isNotNull())
    return results.select("doc_id", "family", F.explode(found).alias("finding"))


#: Words that claim more than a p value can show, and words that take it back.
OVERCLAIM, HEDGED = r"\b(prov(e|es|ed|en|ing)|proof|definitive(ly)?|conclusive(ly)?|confirm(s|ed)? (that|the hypothesis)|demonstrat(es|ed) (beyond|that)|establish(es|ed) that|undeniabl[ey]|without (a )?doubt)\b", r"\b(not|cannot|no|never|neither|nor|rather than)\b[^.;]*$"


def overclaims(text: Column, p: Column) -> Column:
    """Whether a paragraph draws from a p value what none can show: it has one, and says proven or the like without a
    negation ahead of it in the clause. False for a null text or without a p."""
    before = F.regexp_extract(F.lower(text), rf"^(.*?){OVERCLAIM}", 1)
    said = F.lower(text).rlike(OVERCLAIM)
    return F.coalesce(p.isNotNull() & said & ~before.rlike(HEDGED), F.lit(False))


def rule_outcomes(paragraphs: DataFrame, by: str) -> DataFrame:
    """by, rule, flags and passed of each document's paragraphs (p, effect_size, interval, family, groups, text): a row for
    every rule that ran, passed without a flag. A rule on small samples is declined, so there is no row for it."""
    p = F.col("p")
    rules = {
        "missing_effect_size": p.isNotNull() & F.col("effect_size").isNull(), "missing_confidence_interval": p.isNotNull() & F.col("interval").isNull(),
        "test_group_mismatch": (F.col("family") == "t") & (F.col("groups") > 2), "p_value_overclaim": overclaims(F.col("text"), p),
    }
    counts = paragraphs.groupBy(by).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()))
    return counts.select(by, F.inline(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("flags"), (F.col(k) == 0).alias("passed")) for k in rules))))
