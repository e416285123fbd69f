"""What a sentence says of its method: phrases found by an automaton over words, with the scope of each negation.

One pass over a sentence finds the longest phrases of a closed list and the words that negate. A negation reaches
forward over an article, an adverb or a listed verb to the phrase that follows at once (`no Welch correction`, `did not
use one-tailed tests`, `rather than a Student's t-test`), and back from a listed participle to the phrase before it
(`a correction, as planned, was not applied`); `with and without` negates nothing. Any negation ahead of one-tailed
takes it back, as two-tailed is what holds in doubt. A negated phrase says nothing, or the
opposite where it has one (variances `not assumed` equal). Names followed by a year are citations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The phrases by what they say. | parts alternatives, a word in ? may be absent.
PHRASES = {
    "student": ("student's|students'|student t", "pooled t", "pooled variance t"),
    "welch": ("welch|welch's", "unequal variances"),
    "equal_variances": ("assume|assumes|assumed|assuming equal variances", "equal variances ?were|was|are|is|been ?not assumed"),
    "yates": ("yates'|yates|yates's ?continuity correction", "yates'|yates|yates's corrected", "continuity correction", "continuity corrected"),
    "uncorrected": ("uncorrected chi square", "uncorrected chi squared", "uncorrected χ2"),
    "one_tailed": ("one|1|single tailed|sided",),
    "interval": ("one|1|single tailed|sided ?95 ?% confidence|credible|ci|interval|intervals|bound|bounds", "one|1|single tailed|sided 90|95|99 confidence|credible|ci|interval|intervals"),
    "adjusted": (
        "bonferroni", "holm", "hochberg|hochberg's", "hommel|hommel's", "sidak|šidák", "benjamini", "yekutieli", "fdr", "false discovery rate", "tukey|tukey's", "scheffe|scheffé|scheffe's|scheffé's",
        "dunnett|dunnett's", "dunn's", "games howell", "familywise", "family wise", "q values", "padj", "p adj", "adjusted p", "multiplicity",
        "corrected|adjusted|correction|corrections|adjustment for multiple comparisons|comparison|testing|tests", "multiple comparison|comparisons|testing correction|corrections|adjustment|procedure",
    ),
    "paired_t": ("paired", "within subject|subjects|participants", "repeated measures", "dependent samples|t", "matched pairs"),
    "independent_t": ("independent", "unpaired", "between subject|subjects|groups", "two sample"),
    "ols": ("regression", "regressed", "least squares", "linear model"),
    "one_way": ("anova", "analysis of variance"),
    "spearman": ("spearman|spearman's", "rank correlation", "rank order correlation"),
    "pearson": ("pearson|pearson's", "product moment"),
}

# Words that negate what follows, words that may stand between, and what a negation of before ends in.
BEFORE = ("no", "not", "never", "nor", "neither", "without", "cannot")
BEFORE_PAIRS = (("rather", "than"), ("instead", "of"))
BETWEEN = ("a", "an", "the", "any", "use", "used", "using", "apply", "applied", "applying", "perform", "performed", "report", "reported", "require", "adopt", "employ", "need", "make", "all", "be", "been")
AFTER = ("applied", "used", "performed", "made", "conducted", "employed", "adopted", "carried", "assumed", "reported", "needed", "required")

#: A phrase that a negation turns into another, by any negation or by "without" alone.
OPPOSITE = {"equal_variances": ("welch", BEFORE + ("rather", "instead")), "yates": ("uncorrected", ("without",))}

#: The methods that a family's result can be of, the default first.
METHODS = {"t": ("independent_t", "paired_t"), "f": ("one_way", "ols"), "chi_square": ("chi_square",), "r": ("pearson", "spearman"), "z": ()}

WORD = re.compile(r"[^\W_]+(?:'[^\W\d_]*)?|[,;:()%]")
YEAR = re.compile(r"(1[89]|20)\d\d[a-z]?")


def words_of(sentence: str) -> list[str]:
    plain = re.sub("[\u2018\u2019\u02bc]", "'", sentence.lower())
    return WORD.findall(re.sub("[-\u2010-\u2015\u2212]", " ", plain))


@lru_cache(1)
def automaton() -> dict:
    """A tree of words: a node has its next words, and under None what it says there."""
    root: dict = {}

    def add(node: dict, steps: list[str], label: str) -> None:
        if not steps:
            node[None] = label
            return
        head, *rest = steps
        if head.startswith("?"):
            add(node, rest, label)
        for word in head.removeprefix("?").split("|"):
            add(node.setdefault(word, {}), rest, label)

    for label, phrases in PHRASES.items():
        for phrase in phrases:
            add(root, phrase.split(), label)
    return root


@dataclass
class Said:
    label: str
    start: int
    end: int
    negated_by: str | None = None


def phrases(words: list[str]) -> Iterator[Said]:
    """The longest phrase at each place, from left to right, without overlaps."""
    i = 0
    while i < len(words):
        node, best = automaton(), None
        for j in range(i, len(words)):
            node = node.get(words[j])
            if node is None:
                break
            if None in node:
                best = Said(node[None], i, j + 1)
        if best:
            yield best
        i = best.end if best else i + 1


def cited(words: list[str], said: Said) -> bool:
    """A name and perhaps others, then a year."""
    for w in words[said.end : said.end + 7]:
        if YEAR.fullmatch(w):
            return True
        if w not in ("(", ",", "and", "et", "al") and not any(w == p for p in ("hochberg", "yekutieli", "holm", "tukey", "benjamini", "howell")):
            return False
    return False


def negations(words: list[str], found: list[Said]) -> None:
    """Marks the phrases that are negated."""
    by_start = {s.start: s for s in found}
    for i, w in enumerate(words):
        pair = tuple(words[i : i + 2]) in BEFORE_PAIRS
        if w not in BEFORE and not pair:
            continue
        if w == "without" and i >= 2 and words[i - 1] in ("and", "or") and words[i - 2] == "with":
            continue
        at = i + (2 if pair else 1)
        for _ in range(4):  # a verb, an article and an adverb at most
            if at in by_start or at >= len(words) or words[at] not in BETWEEN:
                break
            at += 1
        if at in by_start and not (w == "no" and at > i + 1):
            by_start[at].negated_by = w
        for s in found:
            if s.label == "one_tailed" and s.start > i:
                s.negated_by = w  # in doubt, tests are two-tailed
        inside = next((s for s in found if s.start < i < s.end), None)
        if inside:
            inside.negated_by = w
        elif w in ("not", "never") and any(x in AFTER for x in words[i + 1 : i + 3]):
            before = [s for s in found if s.end <= i]
            if before:
                before[-1].negated_by = w


def said_by(sentence: str) -> set[str]:
    """What the sentence says, negations taken into account."""
    words = words_of(sentence)
    found = [s for s in phrases(words) if not (s.label == "adjusted" and cited(words, s))]
    negations(words, found)
    out = set()
    for s in found:
        if s.negated_by is None:
            out.add("student" if s.label == "equal_variances" else s.label)
        elif s.label in OPPOSITE and s.negated_by in OPPOSITE[s.label][1]:
            out.add(OPPOSITE[s.label][0])
    return out


def only(said: set[str], *labels: str) -> str | None:
    """The one of the labels that is said; none if several are."""
    here = [x for x in labels if x in said]
    return here[0] if len(here) == 1 else None


def methods(family: str | None, said: set[str]) -> list[str]:
    """The methods of a family's claim, best first: the second of two if the sentence says it and not the first."""
    known = METHODS.get(family or "", ())
    return list(reversed(known)) if len(known) == 2 and known[1] in said and known[0] not in said else list(known)


RESULT = T.StructType([
    T.StructField("t_variant", T.StringType()), T.StructField("continuity", T.StringType()), T.StructField("one_tailed", T.BooleanType()), T.StructField("adjusted", T.BooleanType()),
    T.StructField("methods", T.ArrayType(T.StringType())),
])


@F.pandas_udf(RESULT)
def method_words(sentence: pd.Series, family: pd.Series) -> pd.DataFrame:
    """struct(t_variant, continuity, one_tailed, adjusted, methods) of a sentence and the family of its result (t, f,
    chi_square, r, z); a null sentence says nothing, an unknown family has no methods."""
    rows = []
    for text, kind in zip(sentence, family, strict=True):
        said = said_by(text or "")
        rows.append((only(said, "student", "welch"), only(said, "yates", "uncorrected"), "one_tailed" in said, "adjusted" in said, methods(kind, said)))
    return pd.DataFrame(rows, columns=RESULT.names)


def sentence_methods(sentence: Column, family: Column) -> Column:
    return method_words(sentence, family)
