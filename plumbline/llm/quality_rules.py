"""Quality rules as a short-circuit cascade.

Each rule reads a few statistics of one text. On a sample, every rule is timed and counted, and the
cascade then runs the rules in the order of rejections per second, stopping at the first rejection.
A document is kept when no rule rejects it, so the order changes the cost and never the verdict.

Null texts count as empty, and an empty text is rejected (too few words). Repeated rows, ties and extra
columns pass through unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Rows that the sample aims at; it only sets the order of the rules.
SAMPLE_ROWS = 2000


def count_in_repeats(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of `width` words found twice or more in the text, first included."""
    n = len(words)
    if n <= width:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) > n - 2:  # a repeated window needs more equal words than that
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    rank = ids
    for step in range(1, width):  # number the windows of each width exactly, from those one shorter
        pair = rank[: n - step] * len(number) + ids[step:]
        _, rank = np.unique(pair, return_inverse=True)
    repeated = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:n])))


class TextStats:
    """Statistics of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()  # of bytes: splits at \x20 and \x09-\x0D only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_exclaim(self) -> int:
        return self.text.count("!")

    @cached_property
    def full_lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]

    @cached_property
    def n_lines(self) -> int:
        return len(self.full_lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.full_lines) - len(set(self.full_lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return count_in_repeats(self.words)


class Rule(NamedTuple):
    """rejects() is true for a document that goes."""

    name: str
    rejects: Callable[[TextStats], bool]


#: The first two are the base rules; all thresholds leave ordinary prose far inside.
RULES = (
    Rule("few_words", lambda t: t.n_words < 10),
    Rule("repeated_passages", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
    Rule("symbols_per_word", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("exclamations_per_word", lambda t: 2 * t.n_exclaim > t.n_words),
    Rule("duplicate_lines", lambda t: 10 * t.n_dup_lines > 7 * t.n_lines),
    Rule("word_length", lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 20 * t.n_words),
)
BASE = ("few_words", "repeated_passages")
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Seconds per document and share rejected of each rule, on a random sample of about sample_rows.

    Each rule is timed on its own, with no statistics computed before it."""
    total = docs.count()
    if not total:
        return {r.name: (1.0, 0.0) for r in rules}

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, spent, gone = 0, [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += 1
                for k, rule in enumerate(rules):
                    t0 = time.perf_counter()
                    gone[k] += rule.rejects(TextStats(text))
                    spent[k] += time.perf_counter() - t0
        yield pa.RecordBatch.from_pydict({"k": list(range(len(rules))), "seen": [seen] * len(rules), "spent": spent, "gone": gone}, schema=pa.schema([("k", pa.int32()), ("seen", pa.int64()), ("spent", pa.float64()), ("gone", pa.int64())]))

    sample = docs.select(text_col).sample(min(1.0, sample_rows / total), seed=8)
    rows = sample.mapInArrow(profile, "k int, seen long, spent double, gone long").groupBy("k").agg(F.sum("seen").alias("seen"), F.sum("spent").alias("spent"), F.sum("gone").alias("gone")).collect()
    return {rules[r.k].name: (r.spent / max(1, r.seen), r.gone / max(1, r.seen)) for r in rows}


def ordered(rules: tuple[Rule, ...], measured: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """The rules by rejection per cost, highest first; ties by name."""
    return tuple(sorted(rules, key=lambda r: (-measured[r.name][1] / max(measured[r.name][0], 1e-9), r.name)))


def cascade(text: str | None, rules: tuple[Rule, ...]) -> str | None:
    """The name of the first rule that rejects the text, or None."""
    stats = TextStats(text)
    return next((r.name for r in rules if r.rejects(stats)), None)


def with_verdict(docs: DataFrame, rules: tuple[Rule, ...] | None = None, text_col: str = "text", statistics: bool = False) -> DataFrame:
    """docs with rejected_by (a rule's name or null); with statistics, also those of STATISTICS and base_failed.

    Without statistics only what the cascade reaches is computed. New columns replace columns of their names."""
    chosen = rules or ordered(RULES, measure(docs, RULES, text_col))
    base = tuple(r for r in chosen if r.name in BASE)
    new = ["rejected_by", *((*STATISTICS, "base_failed") if statistics else ())]
    kept_fields = [f for f in docs.schema.fields if f.name not in new]
    kinds = {"rejected_by": T.StringType(), "base_failed": T.BooleanType()}
    schema = T.StructType([*kept_fields, *(T.StructField(c, kinds.get(c, T.LongType())) for c in new)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = {"rejected_by": pa.string(), "base_failed": pa.bool_()}
        for batch in batches:
            out: dict[str, list] = {c: [] for c in new}
            for text in batch.column(text_col).to_pylist():
                stats = TextStats(text)
                if statistics:
                    for c in STATISTICS:
                        out[c].append(getattr(stats, c))
                    out["base_failed"].append(any(r.rejects(stats) for r in base))
                out["rejected_by"].append(next((r.name for r in chosen if r.rejects(stats)), None))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept_fields), *(pa.array(out[c], arrow.get(c, pa.int64())) for c in new)], names=[f.name for f in schema.fields])

    return docs.select(*(f.name for f in kept_fields)).mapInArrow(judge, schema)


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the cascade keeps, with their own columns."""
    return with_verdict(docs, text_col=text_col).where("rejected_by is null").select(*docs.columns)
