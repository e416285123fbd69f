"""Text measures and cleaning as Column expressions; all but char_perplexity, winnow_text and word_measures run inside the JVM.

Every function takes and returns Columns. A null text gives null unless said otherwise."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from xxhash import xxh64_intdigest

# Phrases that mark formulaic prose, as the badge rules list them.
CLICHES = (
    "in conclusion", "furthermore", "moreover", "it is important to note", "it is worth noting", "delve into", "delving into", "tapestry", "leverage",
    "navigating the", "in the realm of", "plays a crucial role", "a testament to", "ever-evolving", "in today", "firstly", "additionally",
)

# Labels of a table's totals row.
TOTAL_LABELS = ("total", "totals", "sum", "overall", "grand total", "all")

#: Words after which a hyphen at a line break stays.
HYPHEN_STAYS = ("and", "or", "to", "nor", "but", "versus", "vs")

#: Each byte of a lower-case text, all that is in no word of normal_words() as a space; seed of Spark's xxhash64.
IN_NORMAL_WORDS = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))
SPARK_SEED = 42

HYPHEN_BREAK = rf"(?<=\p{{L}}{{2}})-[ \t]+(?!(?:{'|'.join(HYPHEN_STAYS)})(?!\p{{L}}))(?=\p{{Ll}}{{2,}}(?!\p{{L}}))"


#: Rows that an Arrow function takes out of a batch together, so that its memory does not grow with the batch.
TOGETHER = 128


def in_slices(column: pa.Array) -> Iterator[list]:
    """The column's values as Python objects, some rows at a time."""
    for i in range(0, len(column), TOGETHER):
        yield column.slice(i, TOGETHER).to_pylist()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: inside a lambda function, an expression is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def folded_chars(text: Column) -> Column:
    """The text's characters in lower case, white space runs as one space."""
    return F.split(F.regexp_replace(F.lower(text), r"\s+", " "), "")


@F.pandas_udf(T.DoubleType())
def char_perplexity(folded: pd.Series) -> pd.Series:
    """2 to the entropy of the characters of a folded text, 1 for fewer than two; a document is never taken apart into
    rows."""

    def one(s: str | None) -> float | None:
        if s is None or len(s) < 2:
            return None if s is None else 1.0
        n = np.fromiter(Counter(s).values(), float)
        return float(2 ** -(n / len(s) * np.log2(n / len(s))).sum())

    return folded.map(one)


def normal_text(text: Column) -> Column:
    """Lower case; all but a-z, 0-9 and white space as spaces."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " ")


def normal_words(text: Column) -> Column:
    """Lower-case words of a-z and 0-9, all else as white space."""
    return F.filter(F.split(normal_text(text), r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Sorted distinct letter-digit runs of two characters or more that are not all digits."""
    found = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$"))))


def overlap(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct runs of n words, joined by one space; empty for shorter texts."""
    def runs(words: Column) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " ")))

    return let(normal_words(text), runs)


def containment(a: Column, b: Column) -> Column:
    """The share of a's elements that b has; 0 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def sentences(text: Column) -> Column:
    """Trimmed stretches between runs of .!? that hold more than one word."""
    parts = F.transform(F.split(text, r"[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: F.size(F.split(s, r"\s+")) > 1)


def burstiness(text: Column) -> Column:
    """Population standard deviation of words a sentence over their mean; 1 for fewer than two sentences."""
    def spread(lens: Column, mean: Column) -> Column:
        return F.sqrt(F.aggregate(lens, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(lens)) / mean

    def of(lens: Column) -> Column:
        mean = F.aggregate(lens, F.lit(0.0), lambda a, x: a + x) / F.size(lens)
        return F.when(F.size(lens) < 2, F.lit(1.0)).otherwise(let(mean, lambda m: spread(lens, m)))

    return let(F.transform(sentences(text), lambda s: F.size(F.split(s, r"\s+")).cast("double")), of)


def cliche_count(text: Column, phrases: Sequence[str] = CLICHES) -> Column:
    low = F.lower(text)
    return sum((low.contains(p).cast("int") for p in phrases), F.lit(0))


def ai_score(markers: Column, cv: Column) -> Column:
    uniform = F.when(cv < 0.2, 1.0).when(cv < 0.35, 0.6).otherwise(0.15)
    return 0.5 * F.least(F.lit(1.0), markers / 3) + 0.5 * uniform


def ai_badge(score: Column) -> Column:
    return F.when(score >= 0.7, "ai_generated").when(score >= 0.4, "ai_assisted").otherwise("human_written")


def rejoin_hyphens(text: Column) -> Column:
    """Words split by a hyphen and blanks are joined, unless what follows is a conjunction or not a small-letter word."""
    return F.regexp_replace(text, HYPHEN_BREAK, "")


def header_elision(text: Column, reach: int = 90) -> Column:
    """Running headers that end in a DOI become "[...] ": up to `reach` characters back, not past a sentence end."""
    return F.regexp_replace(text, rf"(?:(?<=\. )|^|(?<=\s))(?:(?!\. ).){{0,{reach}}}?(?:https?://(?:dx\.)?doi\.org/|doi:\s*)10\.\S+\s*", "[...] ")


def clean_quote(text: Column) -> Column:
    """struct(text, cut): headers elided, hyphens joined, white space collapsed; cut says that a header went."""
    cut = header_elision(text)
    return F.struct(collapse(rejoin_hyphens(cut)).alias("text"), (cut != text).alias("cut"))


def fold_typography(text: Column, ligatures: bool = False) -> Column:
    """Soft hyphens dropped, dashes to -, quotes to ' and ", no-break and thin spaces to spaces, runs collapsed."""
    out = F.translate(text, "‐‑‒–—―−‘’‚‛“”„   ­", "-------''''\"\"\"   ")
    if ligatures:
        out = F.replace(F.replace(out, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return collapse(out)


def quantity(text: Column) -> Column:
    """A cell as a number, % and thousands commas dropped; null if it is none."""
    return F.regexp_replace(F.trim(text), "[%,]", "").try_cast("double")


def numbers_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))


def is_total_label(text: Column) -> Column:
    """A label of a table's totals row, colons at its end aside."""
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), ":+$", "")).isin(*TOTAL_LABELS)


def chunks(words: Column, size: int = 512, step: int = 448) -> Column:
    """Windows of `size` words every `step`; the window that reaches the end is the last."""
    def cut(w: Column) -> Column:
        n = F.size(w)
        last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(w, i * step + 1, size))).otherwise(F.array())

    return let(words, cut)


def winnow(words: Column, shingle: int, window: int) -> Column:
    """Winnowing fingerprints: the least shingle hash of each window of `window` shingles, distinct."""
    def hashed(w: Column) -> Column:
        n = F.size(w) - shingle + 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice(w, i, shingle), " ")))).otherwise(F.array().cast("array<bigint>"))

    def least(h: Column) -> Column:
        m = F.size(h) - window + 1
        few = F.filter(F.array(F.array_min(h)), lambda x: x.isNotNull())
        return F.array_distinct(F.when(m > 0, F.transform(F.sequence(F.lit(1), m), lambda i: F.array_min(F.slice(h, i, window)))).otherwise(few))

    return let(let(words, hashed), least)


def prints_of(low: bytes, shingle: int, window: int) -> list[int]:
    """winnow() of the normal words of a lower-case text."""
    words = b" ".join(low.translate(IN_NORMAL_WORDS).split())
    spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(words)]
    if not words or len(starts) < shingle:
        return []
    hashes = np.array([xxh64_intdigest(words[a:b], SPARK_SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64).view(np.int64)
    size = min(window, len(hashes))
    least = hashes[: len(hashes) - size + 1]
    for i in range(1, size):
        least = np.minimum(least, hashes[i : len(hashes) - size + 1 + i])
    return list(dict.fromkeys(least.tolist()))


def winnow_text(text: Column, shingle: int, window: int) -> Column:
    """winnow() of the text's normal_words(), a text at a time in Arrow batches; a null text has none."""

    @F.arrow_udf("array<long>")
    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([prints_of(low or b"", shingle, window) for low in some], pa.list_(pa.int64())) for some in in_slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return run(F.lower(text).cast("binary"))


def word_measures(text: Column, stopwords: Sequence[str], listed: Sequence[str], terms: int, n: int = 3) -> Column:
    """struct of measures of the text's normal_words(), a text at a time in Arrow batches: stopword_share() (stopwords),
    distinct_ngram_share() (distinct), distinctive_terms() (terms) and how many of listed are among them (shared)."""
    few, wanted = frozenset(stopwords), frozenset(listed)
    kind = pa.struct([("stopwords", pa.float64()), ("distinct", pa.float64()), ("terms", pa.list_(pa.string())), ("shared", pa.int64())])

    def measured(normal: str) -> tuple[float | None, float | None, list[str], int]:
        w = normal.split()
        grams = max(0, len(w) - n + 1)
        return (
            sum(x in few for x in w) / len(w) if w else None, len(set(zip(*(w[i:] for i in range(n)), strict=False))) / grams if grams else None,
            sorted(w, key=len, reverse=True)[:terms], len(wanted.intersection(w)),
        )

    @F.arrow_udf("stopwords double, distinct double, terms array<string>, shared long")
    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([None if t is None else dict(zip(kind.names, measured(t), strict=True)) for t in some], kind) for some in in_slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run(normal_text(text))


def stopword_share(words: Column, stopwords: Sequence[str]) -> Column:
    """The share of words that are in the list; null without words."""
    listed = F.array(*map(F.lit, stopwords))
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.array_contains(listed, w))) / F.size(words))


def distinct_ngram_share(words: Column, n: int = 3) -> Column:
    """Distinct n-grams over all n-grams; null for fewer than n words."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.size(F.array_distinct(grams)) / F.size(grams))


def one_tailed(text: Column) -> Column:
    """Says that a test is one-tailed: not negated ("not one-tailed"), and not of an interval within three words."""
    low = F.lower(text)
    said = r"\b(?:one|1|single)[ -](?:tailed|sided)\b"
    bare = F.regexp_replace(low, rf"\b(?:not|no|never|nor|rather than|instead of)\s+(?:a\s+)?{said}", " ")
    bare = F.regexp_replace(bare, rf"{said}(?:\W+\w+){{0,2}}\W+(?:confidence|credible|intervals?|bounds?)\b", " ")
    return bare.rlike(said)


def names_correction(text: Column) -> Column:
    """Names a correction for multiple tests, from a closed list."""
    return F.lower(text).rlike(r"\b(bonferroni|holm|hochberg|hommel|sidak|šidák|benjamini|fdr|false discovery rate|tukey|scheff[eé]|dunnett|games-howell|familywise|family-wise|multiple comparisons?|multiplicity)\b")


def expectation_sentences(text: Column) -> Column:
    """Sentences of 40 to 399 characters that say what authors must do, sorted and distinct, cut to 240 characters."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"([^.!?]+[.!?]?)"), 1), lambda s: F.trim(s))
    told = F.filter(parts, lambda s: (F.length(s) >= 40) & (F.length(s) < 400) & F.lower(s).rlike(r"\b(authors?|manuscripts?|submissions?|papers?|articles?)\b") & F.lower(s).rlike(r"\b(must|should|required?|need|shall|expected)\b"))
    return F.array_sort(F.array_distinct(F.transform(told, lambda s: F.substring(s, 1, 240))))


def image_refs(text: Column, scheme: str = "plumbline-image") -> Column:
    """References scheme://..., the first of each, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"({scheme}://[A-Za-z0-9._-]+)"), 1))


def model_id(path: Column) -> Column:
    """File name of a path, without .gguf, in lower case."""
    return F.regexp_replace(F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1)), r"\.gguf$", "")


def distinctive_terms(words: Column, k: int = 4) -> Column:
    """The k longest words, ties by place, in that order."""
    keyed = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["w"])


def html_markers(html: Column) -> Column:
    """Italics as *, bold as **, other tags dropped, common references decoded, white space collapsed."""
    out = F.regexp_replace(html, r"(?i)</?i>", "*")
    out = F.regexp_replace(out, r"(?i)</?(?:b|strong)>", "**")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for pattern, sign in ((r"&amp;", "&"), (r"&lt;", "<"), (r"&gt;", ">"), (r"(?i)&#0?38;|&#x0?26;", "&"), (r"&nbsp;|&#0?160;", " ")):
        out = F.regexp_replace(out, pattern, sign)
    return collapse(out)


def recovered_grid(cells: Column) -> Column:
    """struct(columns, rows, reason) of a table given as its cells in reading order. The first number follows a header
    and one row label, which gives the number of columns; reason says why there is no grid."""
    first = F.array_position(F.transform(cells, lambda c: quantity(c).isNotNull()), True).cast("int") - 1
    width = first - 1
    safe = F.greatest(width, F.lit(1))
    reason = (
        F.when(F.size(cells) < 6, "too_few_cells").when(first < 0, "no_number").when(first < 2, "no_header").when(width < 2, "one_column")
        .when(width > 12, "header_too_long").when(F.size(cells) == width, "no_body").when(F.size(cells) % safe != 0, "ragged")
    )
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size(cells) / safe).cast("int") - 1), lambda i: F.slice(cells, i * safe + 1, safe))
    return F.struct(F.when(reason.isNull(), width).alias("columns"), F.when(reason.isNull(), rows).alias("rows"), reason.alias("reason"))


def match_label(similarity: Column, is_self: Column) -> Column:
    return F.when(is_self, "internal duplication").when(similarity >= 0.98, "near-identical").when(similarity >= 0.85, "high overlap").otherwise("partial overlap")


def perplexity_place(value: Column, p10: Column, median: Column) -> Column:
    return F.when(value < p10, "below_p10").when(value < median, "below_median").otherwise("typical")


def signal_risk(level: Column) -> Column:
    return F.when(level == "high", 0.7).when(level == "medium", 0.45).when(level == "low", 0.2)


def tier_weight(tier: Column) -> Column:
    return F.when(tier == "factual", 1.0).when(tier == "structural", 0.8).when(tier == "stylometric", 0.6)
