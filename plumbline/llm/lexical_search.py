"""Ranked lexical search: the k best documents of each query by an integer BM25, found with MaxScore in each shard.

A first pass counts, for the queries' terms only, in how many documents each stands, the documents with a term and their
lengths. The second pass is the search: a task gathers documents to shards of bounded size, lists each query term's
postings there with their exact contributions, and takes a query's lists from the highest upper bound down. While the
bounds of the lists not yet taken could still lift an unseen document to the k-th best score, a list is essential and
read whole; from then on the rest is non-essential, and is only probed for the documents whose score and remaining
bounds together still reach that score. The k-th best is carried from shard to shard within a task, so later shards stop
earlier. A task sends k rows a query at most, and the global ranks are taken from those.

Queries are a stated set and are read in blocks of at most BLOCK_TERMS terms (one query with more is a block by itself),
so what is sent to tasks is bounded whatever the number of queries; documents are read twice for each block.

Null and empty texts have no terms and are never found; texts of any length are read whole, one at a time. Equal scores
go by ascending doc_id, null ids last. Each row of the documents is a document, so repeated rows are found each. Query
rows equal in id and terms are one query; rows of one id with different terms are ranked apart. Other columns are not
read. Without documents or queries the result is empty.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.llm.common import NO_ID, saved
from plumbline.llm.texts import grouped, terms, utf8

#: Terms of the queries in a block; words of a shard, unless one text is longer.
BLOCK_TERMS, SHARD_WORDS = 200_000, 1_500_000

#: Fixed values of the score: scale, saturation, and the two parts of length normalisation in hundredths.
SCALE, SATURATION, LENGTH_BASE, LENGTH_SHARE = 1_000_000_000, 20, 50, 50


class Block(NamedTuple):
    """ids: of the queries; terms: distinct terms of all, numbered; queries: term numbers of each."""

    ids: list[int | None]
    terms: dict[bytes, int]
    queries: list[np.ndarray]


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """The distinct queries, streamed to the driver a partition at a time and cut into blocks."""

    def distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "terms": pa.array([sorted({t.decode() for t in terms(x)}) for x in utf8(batch.column(1))], pa.list_(pa.string()))})

    rows = items.select(F.col(id_col).cast("long"), text_col).mapInArrow(distinct_terms, "id long, terms array<string>").distinct().orderBy("id", "terms")
    block = Block([], {}, [])
    for row in rows.toLocalIterator():
        own = [t.encode() for t in row.terms]
        if block.ids and len(block.terms) + len(own) > BLOCK_TERMS:
            yield block
            block = Block([], {}, [])
        block.ids.append(row.id)
        block.queries.append(np.array([block.terms.setdefault(t, len(block.terms)) for t in own], np.int64))
    if block.ids:
        yield block


class Totals(NamedTuple):
    """documents: with a term; length: terms in all; weight: of each query term."""

    documents: int
    length: int
    weight: np.ndarray


def totals(docs: DataFrame, numbers: dict[bytes, int], text_col: str = "text") -> Totals:
    """Counts over all documents; a task sends one row a query term at most, and two more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            for text in utf8(batch.column(0)):
                if found := terms(text):
                    seen[-1] += 1
                    seen[-2] += len(found)
                    seen.update(n for t in set(found) if (n := numbers.get(t)) is not None)
        yield pa.RecordBatch.from_pydict({"term": pa.array(seen.keys(), pa.int64()), "n": pa.array(seen.values(), pa.int64())})

    held = dict(map(tuple, docs.select(text_col).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect()))
    documents = held.get(-1, 0)
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(numbers))]
    return Totals(documents, held.get(-2, 0), np.array(weight, np.int64))


class Shard(NamedTuple):
    """ids: of the documents. A term's postings: docs[first[t]:first[t+1]] with the scores they add, at most bound[t]."""

    ids: np.ndarray
    first: np.ndarray
    docs: np.ndarray
    adds: np.ndarray
    bound: np.ndarray


def shard(ids: np.ndarray, found: list[np.ndarray], lengths: list[int], total: Totals) -> Shard:
    """The postings of the documents, whose query terms (with repeats) are given as numbers."""
    count = len(total.weight)
    doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
    pairs, tf = np.unique(np.concatenate([np.empty(0, np.int64), *found]) * len(found) + doc, return_counts=True)
    term, doc = pairs // max(1, len(found)), pairs % max(1, len(found))
    norm = np.array([100 - LENGTH_BASE + LENGTH_SHARE * n * total.documents // total.length for n in lengths], np.int64)
    adds = total.weight[term] * ((SCALE * tf) // (1000 * tf + SATURATION * norm[doc]))
    first = np.searchsorted(term, np.arange(count + 1))
    bound = np.zeros(count, np.int64)
    np.maximum.at(bound, term, adds)
    return Shard(ids, first, doc, adds, bound)


def best_of(part: Shard, query: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the shard (by number) and their scores: all that may be among the k best, none below floor (>= 1)."""
    lists = query[part.bound[query] > 0]
    lists = lists[np.argsort(-part.bound[lists], kind="stable")]
    rest = part.bound[lists].sum() - np.cumsum(part.bound[lists])  # what the lists behind each can add at most
    scores = np.zeros(len(part.ids), np.int64)
    at = 0
    for at, t in enumerate(lists, 1):  # essential lists
        s = slice(part.first[t], part.first[t + 1])
        scores[part.docs[s]] += part.adds[s]
        if len(scores) > k and rest[at - 1] >= floor:
            floor = max(floor, int(np.partition(scores, -k)[-k]))
        if rest[at - 1] < floor:
            break
    left = rest[at - 1] if len(lists) else 0
    docs = np.flatnonzero((scores > 0) & (scores + left >= floor))
    for j, t in enumerate(lists[at:], at):  # non-essential lists: probed for documents that can qualify
        if not len(docs):
            break
        own = part.docs[part.first[t] : part.first[t + 1]]
        where = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        hit = own[where] == docs
        scores[docs[hit]] += part.adds[part.first[t] : part.first[t + 1]][where[hit]]
        if len(docs) > k:
            floor = max(floor, int(np.partition(scores[docs], -k)[-k]))
        docs = docs[scores[docs] + rest[j] >= floor]
    order = np.lexsort((part.ids[docs], -scores[docs]))[:k]
    return docs[order], scores[docs[order]]


def found_in(docs: DataFrame, block: Block, total: Totals, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query (number in the block), id, score: for each task and query the k best of the task's documents."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.empty(0, np.int64)
        best = [(empty, empty)] * len(block.queries)  # ids and scores, highest first
        ids, found, lengths, words = [], [], [], 0

        def finish() -> None:
            part = shard(np.array(ids, np.int64), found, lengths, total)
            for q, query in enumerate(block.queries):
                old_ids, old_scores = best[q]
                new, scores = best_of(part, query, k, int(old_scores[-1]) if len(old_scores) == k else 1)
                if len(new):
                    all_ids, all_scores = np.concatenate([old_ids, part.ids[new]]), np.concatenate([old_scores, scores])
                    order = np.lexsort((all_ids, -all_scores))[:k]
                    best[q] = all_ids[order], all_scores[order]

        for batch in grouped(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                own = terms(text)
                if not own:
                    continue
                ids.append(doc_id)
                lengths.append(len(own))
                found.append(np.array([n for t in own if (n := block.terms.get(t)) is not None], np.int64))
                words += len(own)
                if words >= SHARD_WORDS:
                    finish()
                    ids, found, lengths, words = [], [], [], 0
        if ids:
            finish()
        sizes = [len(x) for x, _ in best]
        yield pa.RecordBatch.from_pydict({"query": np.repeat(np.arange(len(best)), sizes), "id": np.concatenate([empty, *(x for x, _ in best)]), "score": np.concatenate([empty, *(x for _, x in best)])})

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_col)
    return rows.mapInArrow(search, "query long, id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each query's k best documents with a score above 0."""
    spark, out = docs.sparkSession, []
    for block in blocks(items, item_col):
        total = totals(docs, block.terms, text_col)
        if not total.documents:
            break
        names = spark.createDataFrame(list(enumerate(block.ids)), "query long, item long")
        best = W.partitionBy("query").orderBy(F.desc("score"), "id")
        top = found_in(docs, block, total, k, id_col, text_col).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        top = top.join(F.broadcast(names), "query").select(F.col("item").alias(item_col), "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "score")
        out.append(saved(top, "search"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], f"{item_col} long, rank int, {id_col} long, score long")
