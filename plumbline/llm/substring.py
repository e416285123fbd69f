"""Substring dedup: repeated passages by compaction of a word de Bruijn graph.

Windows of `width` words are the graph's edges; two documents that share a passage walk the same path. As in graph
builders for genomes, an edge is filed under its anchor, the least hash among the short word runs within it, so that
consecutive edges mostly share an anchor:

1. Anchors that occur in one document only are set aside; no window under them can repeat.
2. The other windows travel as stretches of consecutive edges to their anchor, where each edge's smallest document is
   its source. Consecutive edges of a document whose sources are consecutive too are compacted into one path, so what
   comes back are spans with source coordinates, which only a walk along the source can give.
3. Spans are joined to their documents, glued where they go on across anchors, and their words are removed.

A word goes when a window over it also starts in a document with a smaller doc_id; windows are judged on the input. What
a task finds repeated among its own rows is settled there, and one row stands for it: a passage that a third of the
documents share reaches its anchor once a batch, not once a document.

Null texts count as empty, texts shorter than a window stay whole, texts of any length are read whole, and other
columns are not read. A null doc_id is the largest. Rows that share a
doc_id do not remove words of each other; repeated rows get equal results. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.common import NO_ID, WordHashes, mix, partitions_for, shingle_hashes
from plumbline.llm.texts import grouped, runs, signed

#: Words in a window, and in the runs of which the least hash is a window's anchor.
WIDTH, RUN = 13, 5

SPAN = "key long, doc_id long, row long, start long, hashes array<long>, n long, source_doc long, source_start long"
FLAGGED = "row long, nth int"


def anchors_of(words: np.ndarray, width: int, run: int) -> np.ndarray:
    """The anchor of each window of the words."""
    least = mix(shingle_hashes(words, run))
    size, count = 1, width - run + 1
    while 2 * size <= count:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    return np.minimum(least[: len(least) - (count - size)], least[count - size :]) if count > size else least


def windows_of(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window: a sum of multiples of its words' hashes, mixed."""
    n = len(words) - width + 1
    out, factor = np.zeros(n, np.uint64), 1
    for i in range(width):
        factor = factor * 0x9E3779B97F4A7C15 % 2**64
        out += words[i : i + n] * np.uint64(factor)
    return mix(out)


def anchor_rows(width: int, run: int) -> Callable:
    """(row, text) to (key, row, nth): the nth anchor of the row's document; nth < 0 says that it is known to be
    repeated, of -1 - nth, and then the key only spreads the rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in grouped(batches, 1):
            found, rows = [], batch.column(0).to_numpy()
            for text in batch.column(1).to_pylist():
                words = (text or "").encode().split()
                found.append(np.unique(anchors_of(hashes.of(words), width, run)) if len(words) >= width else np.empty(0, np.uint64))
            sizes = np.array([len(x) for x in found])
            anchor, row = np.concatenate(found), np.repeat(rows, sizes)
            nth = np.arange(len(anchor)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            _, first, which, counts = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
            again = counts[which] > 1  # repeated right here: settled, and the first stands for all
            out = np.ones(len(anchor), bool)
            out[again] = False
            stands = first[counts > 1]
            key = np.concatenate([anchor[out].view(np.int64), anchor[stands].view(np.int64), row[again]])
            flag = np.concatenate([nth[out], np.full(len(stands), 2**30), -1 - nth[again]])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate([row[out], row[stands], row[again]])), pa.array(flag.astype(np.int32))], names=["key", "row", "nth"])

    return read


def repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchor rows in the order of their keys, those that share a key with another, or are known to."""
    held = None  # the last row of the batch before, (key, row, nth, written)
    for batch in batches:
        if not batch.num_rows:
            continue
        key, row, nth = (batch.column(i).to_numpy() for i in range(3))
        own = nth >= 0  # the others only pass
        passing = pa.RecordBatch.from_arrays([pa.array(row[~own]), pa.array(-1 - nth[~own])], names=["row", "nth"])
        key, row, nth = key[own], row[own], nth[own]
        if held is not None and len(key):
            key, row, nth = np.append(held[0], key), np.append(held[1], row), np.append(held[2], nth)
        yield passing
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        with_other = np.append(same, False) | np.append(False, same)
        emit = with_other & (nth < 2**30)
        if held is not None and held[3]:
            emit[0] = False
        yield pa.RecordBatch.from_arrays([pa.array(row[emit]), pa.array(nth[emit])], names=["row", "nth"])
        held = (key[-1], row[-1], nth[-1], bool(with_other[-1]))


def first_and_later(edge: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each edge occurrence: is there one in a smaller document, and which is the first."""
    order = np.lexsort((doc, edge))
    start = runs(edge[order][1:] != edge[order][:-1])
    source = np.empty(len(edge), np.int64)
    source[order] = np.repeat(order[start], np.diff(np.append(start, len(edge))))
    return doc > doc[source], source


def paths(later: np.ndarray, source: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> dict[str, pa.Array]:
    """The later edges, in document order, compacted: consecutive ones with consecutive sources are one span."""
    x = np.flatnonzero(later)
    x = x[np.lexsort((at[x], row[x]))]
    s = source[x]
    start = runs(row[x][1:] != row[x][:-1], at[x][1:] != at[x][:-1] + 1, row[s][1:] != row[s][:-1], at[s][1:] != at[s][:-1] + 1) if len(x) else x
    n = np.diff(np.append(start, len(x)))
    head, tail = x[start], s[start]
    return {"key": row[head], "doc_id": doc[head], "row": row[head], "start": at[head], "n": n, "source_doc": doc[tail], "source_start": at[tail]}


def span_batch(columns: dict[str, np.ndarray], hashes: pa.Array | None = None) -> pa.RecordBatch:
    size = len(columns["key"])
    nulls = pa.nulls(size, pa.int64())
    hashes = pa.nulls(size, pa.list_(pa.int64())) if hashes is None else hashes
    arrays = [hashes if c == "hashes" else signed(columns[c]) if c in columns else nulls for c in ("key", "doc_id", "row", "start", "hashes", "n", "source_doc", "source_start")]
    return pa.RecordBatch.from_arrays(arrays, names=["key", "doc_id", "row", "start", "hashes", "n", "source_doc", "source_start"])


def stretches(width: int, run: int) -> Callable:
    """(row, doc_id, text, flags) to stretches of edges under repeated anchors, and spans that are settled here."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in grouped(batches, 2):
            parts: list[tuple] = []
            for row, doc_id, text, flags in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = hashes.of((text or "").encode().split())
                anchor = anchors_of(words, width, run)
                names, which = np.unique(anchor, return_inverse=True)
                marked = np.zeros(len(names), bool)
                marked[flags] = True
                at = np.flatnonzero(marked[which])
                parts.append((windows_of(words, width)[at], anchor[at], at, np.full(len(at), doc_id), np.full(len(at), row)))
            edge, anchor, at, doc, row = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(edge):
                continue
            later, source = first_and_later(edge, doc)
            yield span_batch(paths(later, source, doc, row, at))
            x = np.flatnonzero(~later)
            start = runs(row[x][1:] != row[x][:-1], at[x][1:] != at[x][:-1] + 1, anchor[x][1:] != anchor[x][:-1])
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(x)), pa.int32()), signed(edge[x]))
            head = x[start]
            yield span_batch({"key": anchor[head], "doc_id": doc[head], "row": row[head], "start": at[head]}, lists)

    return read


def sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches in the order of (key, doc_id) to spans of edges with a smaller source; spans pass through.

    Between batches only the first occurrences under the last key are held."""
    held = [np.empty(0, np.int64)] * 4
    last = None
    for batch in batches:
        settled = pa.compute.is_valid(batch.column("source_doc"))
        passing = batch.filter(settled)
        if passing.num_rows:
            yield passing
        batch = batch.filter(pa.compute.invert(settled))
        if not batch.num_rows:
            continue
        lists = batch.column("hashes")
        sizes = pa.compute.list_value_length(lists).to_numpy()
        key, doc, row, start = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("key", "doc_id", "row", "start"))
        at = start + np.arange(len(start)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if last != key[0]:
            held = [np.empty(0, np.int64)] * 4
        edge, doc, row, at = (np.concatenate(x) for x in zip(held, (lists.flatten().to_numpy(), doc, row, at), strict=True))
        key = np.concatenate([np.full(len(held[0]), key[0]), key])
        later, source = first_and_later(edge, doc)
        yield span_batch(paths(later, source, doc, row, at))
        last = key[-1]
        mine = (key == last) & ~later & (source == np.arange(len(source)))
        held = [x[mine] for x in (edge, doc, row, at)]


def keyed(docs: DataFrame) -> DataFrame:
    """Both joins to texts start from this same projection, so that Spark shuffles the texts once."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.coalesce("text", F.lit("")))
    return docs.select(key.alias("row"), "doc_id", "text")


def repeated_spans(docs: DataFrame, width: int = WIDTH, run: int = RUN) -> DataFrame:
    """row (a 64-bit key of the document), doc_id, start (a word), n (windows), source_doc and source_start: what each
    document shares with a smaller one. Spans may overlap or go on into each other; a null doc_id shows as NO_ID."""
    n = partitions_for(docs.sparkSession)
    rows = keyed(docs)
    anchors = rows.select("row", "text").mapInArrow(anchor_rows(width, run), "key long, row long, nth int")
    flags = anchors.repartition(n, "key").sortWithinPartitions("key").mapInArrow(repeated_anchors, FLAGGED)
    flags = flags.groupBy("row").agg(F.array_distinct(F.collect_list("nth")).alias("flags"))
    marked = rows.join(flags, "row").select("row", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "text", "flags")
    spans = marked.mapInArrow(stretches(width, run), SPAN).repartition(n, "key").sortWithinPartitions("key", "doc_id").mapInArrow(sources, SPAN)
    return spans.select("row", "doc_id", "start", "n", "source_doc", "source_start")


def kept_words(text: str | None, spans: list[dict] | None, width: int) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = (text or "").encode().split()
    if not spans:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        edge[s["start"]] += 1
        edge[s["start"] + s["n"] + width - 1] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()], len(words)


def without_repeats(docs: DataFrame, width: int = WIDTH, run: int = RUN, digest: bool = False) -> DataFrame:
    """docs with doc_id, text (kept words joined by one space where any went), n_words and n_removed; with digest,
    kept_sha256 (of the kept words joined by one space) instead of the text."""
    spans = repeated_spans(docs, width, run).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    rows = keyed(docs).join(spans, "row", "left").select("doc_id", "text", "spans")
    result = "kept_sha256" if digest else "text"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_words": [], "n_removed": [], result: []}
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, n = kept_words(text, found, width)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out[result].append(hashlib.sha256(b" ".join(words)).hexdigest() if digest else b" ".join(words).decode() if found else text)
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])

    return rows.mapInArrow(remove, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(f"n_words long, n_removed long, {result} string").fields]))
