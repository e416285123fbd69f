"""A description of a table from a specification: checked first, then one plan for all of its columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import stats


@dataclass(frozen=True)
class Describe:
    """numeric and categorical columns by name; missing_codes count as missing in the numeric ones."""

    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    missing_codes: tuple[float, ...] = ()

    def problems(self, df: DataFrame) -> list[str]:
        """Codes of what is wrong with it for df; empty if it can run."""
        kinds = dict(df.dtypes)
        out = [f"unknown_column:{c}" for c in (*self.numeric, *self.categorical) if c not in kinds]
        out += [f"numeric_on_text:{c}" for c in self.numeric if kinds.get(c) == "string"]
        return out + ["no_columns"] * (not self.numeric and not self.categorical)


def described(df: DataFrame, spec: Describe) -> DataFrame:
    """column, statistic, level and value, long: the summary of each numeric column, and the counts of each level."""
    if problems := spec.problems(df):
        raise ValueError(", ".join(problems))
    parts = []
    if spec.numeric:
        codes = [F.when(~F.col(c).isin(*spec.missing_codes), F.col(c)).alias(c) if spec.missing_codes else F.col(c) for c in spec.numeric]
        summary = stats.numeric_summary(df.select(*codes), spec.numeric)
        parts.append(summary.select("column", F.inline(F.array(*(F.struct(F.lit(s).alias("statistic"), F.lit(None).cast("string").alias("level"), F.col(s).cast("double").alias("value")) for s in stats.SUMMARY)))))
    if spec.categorical:
        counts = stats.categorical_summary(df, spec.categorical)
        parts.append(counts.select("column", F.lit("count").alias("statistic"), "level", F.col("n").cast("double").alias("value")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
