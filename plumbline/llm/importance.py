"""Importance resampling: documents drawn towards the word distribution of a target text collection.

Words of the documents and of the target are counted in hashed buckets; each bucket has a gain, the scaled logarithm of
its share in the target over its share in the documents, and the array of gains scores a document by the sum over its
features. Gumbel noise, fixed by doc_id and seed, makes the highest scores a draw without replacement. The scores are
integers, so the cutoff is exact: a histogram of scores is cut into ranges, suffix sums of its counts give each score
the number of rows ahead of it, and only within a score that survives are rows numbered, by doc_id.

Ids are cut into bands, so that rows of one score (a third of all, without noise) are numbered by many tasks. The driver
sees the gains (a number a bucket) and one total for each range.

Null and empty texts have no features and weight 0; texts of any length are read whole, one at a time. A null doc_id is
the largest, and its noise is that of the text `null`. Rows of one doc_id are rows of their own with the same noise;
where their scores tie as well, n_features and weight order them. An empty table gives an empty table; an empty target
is one in which all buckets are equally likely. Other columns are kept, and columns of the new names replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from plumbline.llm.common import NO_ID, WORD_MEMORY, Scratch, free_name, partitions_for, saved
from plumbline.llm.texts import grouped, terms, utf8

#: Bands of ids within a score, each numbered by itself.
ID_BANDS = 64

NEW = ("n_words", "n_features", "weight", "score")


class Buckets(dict):
    """The bucket of each feature, remembered for a bounded number of distinct ones."""

    def __init__(self, count: int):
        super().__init__()
        self.count = count

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= WORD_MEMORY:
            self.clear()
        value = self[feature] = zlib.crc32(feature) % self.count
        return value

    def of(self, words: list[bytes], longest: int) -> np.ndarray:
        """Buckets of all runs of 1 to `longest` consecutive words."""
        found = [np.fromiter(map(self.__getitem__, words), np.int64, len(words))]
        for k in range(2, longest + 1):
            found.append(np.array([self[b" ".join(words[i : i + k])] for i in range(len(words) - k + 1)], np.int64))
        return np.concatenate(found)


def bucket_counts(texts: DataFrame, buckets: int, longest: int, text_col: str = "text") -> DataFrame:
    """bucket, n: features of all texts; a task sends one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in grouped(batches, 0):
            found = [known.of(terms(x), longest) for x in utf8(batch.column(0))]
            seen += np.bincount(np.concatenate(found), minlength=buckets)
        full = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": full, "n": seen[full]})

    return texts.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, text_col: str = "text", target_col: str = "text") -> np.ndarray:
    """The gain of each bucket: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))."""
    s, t = ({r.bucket: r.n for r in bucket_counts(x, buckets, longest, c).collect()} for x, c in ((docs, text_col), (target, target_col)))
    all_s, all_t = sum(s.values()), sum(t.values())
    share = lambda b: (t.get(b, 0) + 1) * (all_s + buckets) / ((s.get(b, 0) + 1) * (all_t + buckets))
    return np.array([math.floor(1000 * math.log(share(b))) for b in range(buckets)], np.int64)


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the hash of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs (or its columns in `keep`) with n_words, n_features, weight and score, all long."""
    names = [c for c in (keep or docs.columns) if c not in NEW]
    given = free_name(docs, "scored_text")[0]
    rows = docs.select(*names, F.col(text_col).alias(given))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(gain))
        for batch in grouped(batches, len(names)):
            words, features, weights = [], [], []
            for text in utf8(batch.column(len(names))):
                own = terms(text)
                found = known.of(own, longest)
                words.append(len(own))
                features.append(len(found))
                weights.append(int(gain[found].sum()))
            new = [pa.array(x, pa.int64()) for x in (words, features, weights)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new], names=[*names, *NEW[:3]])

    schema = T.StructType([*(rows.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in NEW[:3])])
    return rows.mapInArrow(weigh, schema).withColumn("score", F.col("weight") + noise(id_col, seed))


class Cutoff(NamedTuple):
    """size: rows drawn; least: the lowest score that is drawn; width: ids in a band; ahead: score, band and the rows
    ahead of these, for what is drawn."""

    size: int
    least: int
    width: int
    ahead: DataFrame | None


def band(id_col: str, width: int) -> Column:
    """Bands of ids in order; null ids come last."""
    return F.expr(f"coalesce(cast(`{id_col}` as bigint), {NO_ID}L) div {width}L")


def cutoff(scores: DataFrame, percent: int, least_words: int, id_col: str = "doc_id") -> Cutoff:
    """The exact cutoff for the highest `percent` of the rows with least_words words, from a table with their scores."""
    spark = scores.sparkSession
    able = scores.where(F.col("n_words") >= least_words)
    seen = able.agg(F.count("*").alias("n"), F.min(id_col).alias("lo"), F.max(id_col).alias("hi")).first()
    size = percent * seen.n // 100
    if not size:
        return Cutoff(0, 0, 1, None)
    width = ((seen.hi or 0) - (seen.lo or 0)) // ID_BANDS + 1
    order = [F.desc("score"), F.asc("band")]
    counts = able.groupBy("score", band(id_col, width).alias("band")).agg(F.count("*").alias("n"))
    with Scratch(spark) as scratch:
        ranges = scratch.saved(counts.repartitionByRange(partitions_for(spark), *order).withColumn("part", F.spark_partition_id()), "score-histogram")
        before, sums = 0, {}
        for part, n in sorted(map(tuple, ranges.groupBy("part").agg(F.sum("n")).collect())):  # ranges are numbered in their order
            sums[part] = before
            before += n
        needed = spark.createDataFrame([(p, b) for p, b in sums.items() if b < size], "part int, before long")
        above = F.sum("n").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
        ahead = ranges.join(F.broadcast(needed), "part").select("score", "band", (F.col("before") + F.coalesce(above, F.lit(0))).alias("ahead")).where(F.col("ahead") < size)
        ahead = saved(ahead, "score-ranks")
    return Cutoff(size, ahead.agg(F.min("score")).first()[0], width, ahead)


def ranked(rows: DataFrame, cut: Cutoff, id_col: str = "doc_id") -> DataFrame:
    """Rows at or above the lowest drawn score, with rank (1: highest score), null where ties leave a row undrawn."""
    band_name, ahead_name, at = free_name(rows, "band", "ahead", "at")
    ahead = cut.ahead.select("score", F.col("band").alias(band_name), F.col("ahead").alias(ahead_name))
    own = W.partitionBy("score", band_name).orderBy(F.col(id_col).asc_nulls_last(), "n_features", "weight")
    found = rows.withColumn(band_name, band(id_col, cut.width)).join(ahead, ["score", band_name], "left").withColumn(at, F.row_number().over(own))
    rank = F.col(ahead_name) + F.col(at)
    return found.select(*rows.columns, F.when(rank <= cut.size, rank).alias("rank"))


def with_ranks(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024, id_col: str = "doc_id") -> DataFrame:
    """Every document's id, n_features, weight, score and rank, null where it is not drawn."""
    gain = gains(docs, target, buckets, longest)
    scores = saved(scored(docs, gain, longest, seed, id_col, keep=(id_col,)), "scores")
    cut = cutoff(scores, percent, least_words, id_col)
    high = (F.col("n_words") >= least_words) & (F.col("score") >= cut.least) & F.lit(cut.size > 0)
    out = scores.where(~high).withColumn("rank", F.lit(None).cast("long"))
    if cut.size:
        out = out.unionByName(ranked(scores.where(high), cut, id_col))
    return out.select(id_col, "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024, id_col: str = "doc_id") -> DataFrame:
    """The drawn documents with all their columns, n_words, n_features, weight, score and rank.

    Texts are scored again where they lie, and only those down to the lowest drawn score are shuffled."""
    gain = gains(docs, target, buckets, longest)
    with Scratch(docs.sparkSession) as scratch:
        cut = cutoff(scratch.saved(scored(docs, gain, longest, seed, id_col, keep=(id_col,)), "scores"), percent, least_words, id_col)
    rows = scored(docs.drop("rank"), gain, longest, seed, id_col)
    if not cut.size:
        return rows.limit(0).withColumn("rank", F.lit(None).cast("long"))
    return ranked(rows.where((F.col("n_words") >= least_words) & (F.col("score") >= cut.least)), cut, id_col).where("rank is not null")
