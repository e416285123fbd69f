"""Features of a document's style, ten of them, from its words, sentences and references."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from plumbline.functions.text import in_slices

#: The type-token ratio at which a factor of MTLD ends, and the words that it needs.
MTLD_RATIO, MTLD_WORDS = 0.72, 100

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
SENTENCE_END = re.compile(r"[.!?]+")

#: Forms of citations in text (a number in brackets; name and year) and of an identifier.
NUMBERED, NAMED, IDENTIFIER = re.compile(r"\[\d+(?:\s*[,–-]\s*\d+)*\]"), re.compile(r"\([^()]*?\b(?:1[89]|20)\d\d[a-z]?\)"), re.compile(r"10\.\d{4,9}/\S+")


def factors(words: Sequence[str], ratio: float = MTLD_RATIO) -> float:
    """Stretches of words until their distinct share falls to the ratio; what is left over counts in part."""
    count, seen, n = 0.0, set(), 0
    for w in words:
        seen.add(w)
        n += 1
        if len(seen) <= ratio * n:
            count, n = count + 1, 0
            seen.clear()
    return count + (1 - len(seen) / n) / (1 - ratio) if n else count


def mtld(words: Sequence[str], least: int = MTLD_WORDS, ratio: float = MTLD_RATIO) -> float | None:
    """Words a factor, forwards and backwards in the mean; null for fewer than `least` words."""
    if len(words) < least:
        return None
    sides = [factors(x, ratio) for x in (words, words[::-1])]
    return float(np.mean([len(words) / f if f else len(words) for f in sides]))


RESULT = T.StructType([
    T.StructField(c, T.DoubleType())
    for c in ("sentence_length_cv", "function_word_ratio", "em_dash_per100", "mtld", "mtld_deviation", "ngram_repetition", "template_density", "citation_density", "citation_style_consistency", "doi_syntax_validity")
])


def features_of(text: str | None, references: Sequence[str] | None, function_words: frozenset[str], templates: Sequence[str], norm: float, spread: float) -> tuple[float | None, ...]:
    """The ten features in their order. null text: no features."""
    if text is None:
        return (None,) * len(RESULT)
    low = text.lower()
    words = WORD.findall(low)
    n = len(words)
    lengths = [k for k in (len(WORD.findall(s)) for s in SENTENCE_END.split(low)) if k]
    cv = float(np.std(lengths) / np.mean(lengths)) if len(lengths) > 1 else None
    diversity = mtld(words)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    hits = [low.count(t) for t in templates]
    numbered, named = len(NUMBERED.findall(text)), len(NAMED.findall(text))
    cited = numbered + named
    refs = [r for r in references or () if r is not None]
    with_id = [r for r in refs if "doi" in r.lower() or IDENTIFIER.search(r)]
    per = lambda a, b: float(a / b) if b else None
    return (
        cv, per(sum(w in function_words for w in words), n), per(100 * text.count("—"), n), diversity, None if diversity is None else abs(diversity - norm) / spread,
        1 - per(len(set(grams)), len(grams)) if grams else None, per(100 * sum(hits), n) if sum(h > 0 for h in hits) >= 2 else per(0, n),
        None if refs and not cited else per(1000 * cited, n), per(max(numbered, named), cited), per(sum(bool(IDENTIFIER.search(r)) for r in with_id), len(with_id)),
    )


def document_features(text: Column, references: Column, function_words: Sequence[str], templates: Sequence[str], norm: float = 80.0, spread: float = 20.0) -> Column:
    """struct of ten features of a text and its array of references.

    Spread of sentence lengths (null below two sentences); share of function words; em dashes per 100 words; MTLD and its
    deviation from `norm` in units of `spread` (null below 100 words); share of repeated three-word runs (null below
    three words); phrases of `templates` per 100 words, if two different ones are there; citations per 1000 words (null
    if references were read and no citation was, which is a failure to parse); share of the commoner style of citation;
    share of the references with an identifier in which it is well-formed. A null text gives nulls, one without words
    nulls for all shares; texts of any length are read whole, one at a time."""
    listed, phrases = frozenset(function_words), [t.lower() for t in templates]

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = [features_of(t, r, listed, phrases, norm, spread) for some, refs in zip(in_slices(texts), in_slices(lists), strict=True) for t, r in zip(some, refs, strict=True)]
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(RESULT))], names=RESULT.names)

    return run(text, references)
