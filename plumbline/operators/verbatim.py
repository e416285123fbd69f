"""Passages that two texts share word for word: winnowed prints find candidates, and the words themselves decide.

Any run of shingle + window - 1 equal words holds a print that both sides choose, so no shared run of that length is
missed; every span is extended on the source texts from a seed, a word at a time in both directions, so no span is
reported that is not equal. Words are runs between white space, compared as they are, or with A-Z lower-cased.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from plumbline.operators.filters import maybe_in

#: Fixed value: words are what stands between these white-space characters.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

#: Parts into which the postings of each print are dealt; spans of a text that are sent on together.
WAYS, SPANS_TOGETHER = 8, 10_000

SPANS = "doc long, ref long, start long, end long, ref_start long, ref_end long, words long, start_char long, end_char long, ref_start_char long, ref_end_char long"

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of texts whose words are found and hashed together; a longer text goes alone, its words some at a time.
BYTES_TOGETHER = 1 << 17

#: Of each byte: whether it is part of a word, and a number, A-Z having those of a-z.
IN_WORD = np.array([WORD.match(bytes([b])) is not None for b in range(256)])
NUMBERS = np.array([xxh64_intdigest(bytes([b]).lower()) for b in range(256)], np.uint64)

#: Powers that the number of a byte is multiplied with by its place, and their inverses.
STEP = 0xD6E8FEB86659FD93
POWERS, INVERSES = (np.cumprod(np.full(BYTES_TOGETHER, base, np.uint64)) for base in (STEP, pow(STEP, -1, 1 << 64)))


def lowered(text: str) -> bytes:
    return (text or "").encode().lower()  # bytes.lower() changes A-Z alone


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def chosen(hashes: np.ndarray, shingle: int, window: int, texts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Prints and places of the winnowed shingles: the last least one of each window; of all, if they fill none. Words of
    several texts, one after the other, are winnowed by themselves if `texts` numbers the text of each word."""
    n = len(hashes) - shingle + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    prints = np.zeros(n, np.uint64)
    for i in range(shingle):
        prints = (prints + hashes[i : i + n]) * MULTIPLIER
        prints ^= prints >> np.uint64(29)
    texts = np.zeros(len(hashes), np.int64) if texts is None else texts
    at = np.flatnonzero(texts[:n] == texts[shingle - 1 :])
    prints, of = prints[at], texts[at]
    best, last_least, opens = prints.copy(), np.arange(len(at)), np.ones(len(at), bool)
    opens[1:] = of[1:] != of[:-1]  # a text's first shingle has a window, filled or not
    for j in range(1, window):
        less = (prints[j:] <= best[:-j]) & (of[j:] == of[:-j])
        best[:-j] = np.where(less, prints[j:], best[:-j])
        last_least[:-j] = np.where(less, np.arange(j, len(at)), last_least[:-j])
    last = of[window - 1 :]
    opens[: len(last)] |= last == of[: len(last)]
    places = last_least[opens]  # in order
    new = np.ones(len(places), bool)
    new[1:] = places[1:] != places[:-1]
    places = places[new]
    return prints[places], at[places]


def together(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A column of texts, BYTES_TOGETHER at a time: the number of the first text, bytes, and where each text begins and
    the last one ends. A null text is empty."""
    held = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(held):
        return
    _, offsets, data = held.buffers()
    edges = np.frombuffer(offsets, np.int64)[held.offset : held.offset + len(held) + 1]
    held_bytes = np.frombuffer(data or b"", np.uint8)
    i = 0
    while i < len(held):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + BYTES_TOGETHER, "right")) - 1)
        yield i, held_bytes[edges[i] : edges[j]], edges[i : j + 1] - edges[i]
        i = j


def word_edges(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends in texts that stand one after the other; a word ends with its text."""
    inside = IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin, end = edges[edges < len(data)], edges[edges > 0] - 1
    first[begin], last[end] = inside[begin], inside[end]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes_between(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, wherever it stands: sums of its bytes' numbers, each times a power for its place."""
    out = [np.empty(0, np.uint64)]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BYTES_TOGETHER, "right")))
        some = data[starts[i] : ends[j - 1]]
        powers = POWERS[: len(some)] if len(some) <= len(POWERS) else np.cumprod(np.full(len(some), STEP, np.uint64))  # one long word
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(NUMBERS[some] * powers, out=sums[1:])
        begin = starts[i:j] - starts[i]
        found = (sums[ends[i:j] - starts[i]] - sums[begin]) * INVERSES[begin]
        out.append((found ^ (found >> np.uint64(32))) * MULTIPLIER)
        i = j
    return np.concatenate(out)


def postings(texts: DataFrame, shingle: int, window: int) -> DataFrame:
    """id, print, at (a word's number) of texts (id, text)."""

    def winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, edges in together(batch.column(1)):
                starts, ends = word_edges(data, edges)
                first = np.searchsorted(starts, edges)  # word of each text
                of = np.repeat(np.arange(len(edges) - 1), np.diff(first))
                prints, at = chosen(hashes_between(data, starts, ends), shingle, window, of)
                of = of[at]
                yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(pa.array(i + of)), "print": prints.view(np.int64), "at": at - first[of]})

    return texts.select(F.col("id").cast("long"), "text").mapInArrow(winnow, "id long, print long, at long")


def word_count(text: Column) -> Column:
    """How many words a text has; null has none."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        found = (np.diff(np.searchsorted(word_edges(data, edges)[0], edges)) for _, data, edges in together(texts))
        return pa.array(np.concatenate([np.empty(0, np.int64), *found]), pa.int64())

    return count(text)


def characters(text: bytes) -> np.ndarray:
    """Code points ahead of each byte of a text, and of its end."""
    return np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])


def extended(mine: list[bytes], theirs: list[bytes], seeds: list[tuple[int, int]], same: bool) -> list[tuple[int, int, int, int]]:
    """The longest equal runs through the seeds, each once: start, end, and start and end in the other text."""
    reached: dict[int, int] = {}
    out = []
    for a, b in sorted(seeds):
        if (same and a >= b) or a < reached.get(a - b, 0):
            continue
        if mine[a] != theirs[b]:
            continue  # prints that are equal by chance
        i, j = a, b
        while i > 0 and j > 0 and mine[i - 1] == theirs[j - 1]:
            i, j = i - 1, j - 1
        end, other = a, b
        while end < len(mine) and other < len(theirs) and mine[end] == theirs[other]:
            end, other = end + 1, other + 1
        reached[a - b] = end
        out.append((i, end, j, other))
    return out


def found_once(rows: DataFrame) -> DataFrame:
    """The rows as a table that is used twice and computed now: in the session's checkpoint folder, or held by the
    executors where it has none."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.localCheckpoint()


def shared_spans(docs: DataFrame, references: DataFrame | None = None, shingle: int = 5, window: int = 4, least: int | None = None) -> DataFrame:
    """Spans of docs (id, text) that stand in references (id, text) as well, of `least` words or more (what winnowing
    guarantees, unless more is asked for): words (ends exclusive) and characters on both sides. Without references,
    what each document repeats within itself, the earlier place first.

    What a document repeats is found where the document is read. Prints of documents that no reference has are dropped before anything is shuffled, and the postings of a print are
    dealt out over WAYS tasks. Documents are read twice: for prints, when this is called, and for the texts of those with seeds. A run of words that stands n times in one text and m times in the other makes n times m
    seeds, as each pair of places is a span of its own. Null and shorter texts share nothing. Ids must be distinct on
    either side; null ids take no part."""
    least = max(least or 0, shingle + window - 1)
    same = references is None
    known = docs.where("id is not null").select("id", "text")
    if same:
        return repeated_spans(known, shingle, window, least)
    others = references.where("id is not null").select("id", "text")
    mine, theirs = postings(known, shingle, window), postings(others, shingle, window)
    mine = maybe_in(mine, "print", theirs.select("print")).withColumn("way", F.pmod(F.xxhash64("id", "at"), F.lit(WAYS)))
    right = theirs.select(F.col("id").alias("ref"), "print", F.col("at").alias("ref_at")).withColumn("way", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WAYS - 1).cast("long"))))
    pairs = mine.join(right, ["print", "way"])
    seeds = pairs.groupBy("id", "ref").agg(F.collect_list(F.struct("at", "ref_at")).alias("seeds"))
    seeds = found_once(seeds)
    found = maybe_in(known, "id", seeds.select("id"))  # texts without a seed are not shuffled
    seeds = seeds.join(found, "id").join(others.select(F.col("id").alias("ref"), F.col("text").alias("other")), "ref")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SPANS.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for doc, ref, places, text, other in zip(*(batch.column(c).to_pylist() for c in ("id", "ref", "seeds", "text", "other")), strict=True):
                a, b = (list(WORD.finditer(lowered(x))) for x in (text, other))
                at, there = characters(lowered(text)), characters(lowered(other))
                for i, end, j, stop in extended([m[0] for m in a], [m[0] for m in b], [(p["at"], p["ref_at"]) for p in places], False):
                    if end - i >= least:
                        rows.append((doc, ref, i, end, j, stop, end - i, int(at[a[i].start()]), int(at[a[end - 1].end()]), int(there[b[j].start()]), int(there[b[stop - 1].end()])))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)

    return seeds.select("id", "ref", "seeds", "text", "other").mapInArrow(verify, SPANS)


def repeats(words: list[bytes], shingle: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """What a text repeats: start, end, and start and end of the later place, each once.

    Later places of a print are taken all at once, and those in a run that is known already are left out."""
    prints, at = chosen(word_hashes(words), shingle, window)
    order = np.lexsort((at, prints))
    sorted_prints = prints[order]
    if not (sorted_prints[1:] == sorted_prints[:-1]).any():
        return
    groups = [g for g in np.split(at[order], np.flatnonzero(np.diff(sorted_prints)) + 1) if len(g) > 1]
    reached = np.zeros(len(words), np.int64)  # by distance
    for a, later in sorted(((int(a), g[k + 1 :]) for g in groups for k, a in enumerate(g[:-1])), key=lambda x: x[0]):
        for b in later[reached[later - a] <= a].tolist():
            for found in extended(words, words, [(a, b)], True):
                reached[b - a] = found[1]
                yield found


def repeated_spans(texts: DataFrame, shingle: int, window: int, least: int) -> DataFrame:
    """Spans that each text (id, text) repeats within itself: a text at a time, where it is read, and nothing is shuffled."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SPANS.split(", ")]
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = lowered(text)
                found = (x for x in repeats(WORD.findall(low), shingle, window) if x[1] - x[0] >= least)
                at = edges = None
                while block := list(islice(found, SPANS_TOGETHER)):
                    if at is None:
                        at, edges = characters(low), np.array([m.span() for m in WORD.finditer(low)], np.int64)
                    i, end, j, stop = np.array(block, np.int64).T
                    columns = [np.full(len(block), doc, np.int64)] * 2 + [i, end, j, stop, end - i, at[edges[i, 0]], at[edges[end - 1, 1]], at[edges[j, 0]], at[edges[stop - 1, 1]]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return texts.select(F.col("id").cast("long"), "text").mapInArrow(find, SPANS)


def duplication(spans: DataFrame, totals: DataFrame) -> DataFrame:
    """doc, words, covered and ratio of totals (doc, words): the share of words that any span covers; 0 without words."""
    from plumbline.operators.locate import merged_spans

    covered = merged_spans(spans.select("doc", "start", "end"), ("doc",)).groupBy("doc").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    rows = totals.join(covered, "doc", "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))
    return rows.select("doc", "words", "covered", F.when(F.col("words") > 0, F.col("covered") / F.col("words")).otherwise(F.lit(0.0)).alias("ratio"))
