"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Trees are grown on labelled documents; every path from a root to a node is a conjunction of bounds on statistics. A
logistic model with a lasso penalty weighs these rules and leaves most of them out; what is left is compiled into one
Spark column expression. The only inputs are statistics of the text.

Null texts count as empty; an empty text has all statistics 0 and gets the score that the model gives those. At most
TRAIN_ROWS labelled rows are fitted, those of least hash; rows with a null label are not used. Without labels, or with
one class only, the score is the share of label 1 (0.5 without any). Repeated rows get equal scores; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.llm.common import saved
from plumbline.llm.quality_rules import TextStats

#: Labelled rows that are fitted at most; trees, their depth, and the lasso penalty.
TRAIN_ROWS, TREES, DEPTH, PENALTY = 20_000, 16, 4, 0.001

STATISTICS = ("log_words", "word_length", "symbols", "exclaims", "duplicate_lines", "repeats", "capitals", "digits", "distinct", "stops", "line_words", "other_signs")


def statistics(text: str | None) -> tuple[float, ...]:
    """The values of STATISTICS: all but the first two are shares or means, and all are 0 for an empty text."""
    t = TextStats(text)
    n = t.n_words
    if not n:
        return (0.0,) * len(STATISTICS)
    signs = np.bincount(np.frombuffer(t.text.encode(), np.uint8), minlength=256)
    capital, small = int(signs[65:91].sum()), int(signs[97:123].sum())
    other = int(signs[33:127].sum() - signs[48:58].sum()) - capital - small
    stops = int(signs[[44, 46, 59, 63]].sum())
    return (
        math.log2(1 + n), t.word_chars / n, t.n_symbols / n, t.n_exclaim / n, t.n_dup_lines / t.n_lines, t.n_repeat_words / n,
        capital / max(1, capital + small), int(signs[48:58].sum()) / n, len(set(t.words)) / n, stops / n, n / t.n_lines, other / n,
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id with STATISTICS, for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.DoubleType()) for c in STATISTICS)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(x) for x in batch.column(1).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, values.T)], names=["doc_id", *STATISTICS])

    return docs.mapInArrow(measure, schema)


class Rule(NamedTuple):
    """True where low < statistic <= high for each of bounds, (statistic, low, high) in the order of STATISTICS."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low > -math.inf:
                out &= F.col(name) > low
            if high < math.inf:
                out &= F.col(name) <= high
        return out


STEP = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def rules_of(tree_text: str) -> list[Rule]:
    """The paths to all nodes of a tree, from its toDebugString."""
    path: list[tuple[int, int, str, float]] = []
    out = []
    for line in tree_text.splitlines():
        if not (m := STEP.match(line)):
            continue
        while path and path[-1][0] >= len(m[1]):
            path.pop()
        path.append((len(m[1]), int(m[2]), m[3], float(m[4])))
        low, high = {}, {}
        for _, f, sign, value in path:
            if sign == ">":
                low[f] = max(value, low.get(f, -math.inf))
            else:
                high[f] = min(value, high.get(f, math.inf))
        out.append(Rule(tuple((STATISTICS[f], low.get(f, -math.inf), high.get(f, math.inf)) for f in sorted(low | high))))
    return out


class Model(NamedTuple):
    """score() is logistic(intercept + the weights of the rules that hold)."""

    intercept: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total += F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(rows: DataFrame, label_col: str = "label", seed: int = 5) -> Model:
    """A model from rows with STATISTICS and label_col (0 or 1); rows is small (TRAIN_ROWS) and read many times."""
    counts = dict(rows.groupBy(label_col).agg(F.count("*")).collect())
    ones, total = counts.get(1, 0), sum(counts.values())
    if not 0 < ones < total:
        share = 0.5 if not total else min(max(ones / total, 1e-6), 1 - 1e-6)
        return Model(math.log(share / (1 - share)), {})
    rows = rows.select(F.col(label_col).cast("double").alias("label"), *STATISTICS).withColumn("features", array_to_vector(F.array(*STATISTICS)))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=10, featureSubsetStrategy="onethird", seed=seed).fit(rows)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in rules_of(tree.toDebugString)))
    rows = rows.select("label", array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60).fit(rows)
    return Model(float(lasso.intercept), {r: float(w) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w})


def train(stats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """fit() on stats joined to labels (doc_id, label), or on the `rows` of least hash if there are more."""
    usable = stats.join(labels.where("doc_id is not null and label in (0, 1)").select("doc_id", "label"), "doc_id")
    chosen = usable.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "label").limit(rows)
    return fit(saved(chosen.select("label", *STATISTICS), "quality-train"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score, label 1's estimated probability, for each row of docs; labels: (doc_id, label)."""
    stats = saved(with_statistics(docs), "quality-statistics")
    return stats.select("doc_id", train(stats, labels).score().alias("score"))
