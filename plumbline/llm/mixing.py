"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

Every source's documents are laid out in a hash-shuffled order on an axis of words, which is cut into blocks of
equal size. A source's target is turned into a number of slots, one block each; slot numbers are van der Corput
points (bit-reversed integers) mapped through the sources' cumulative slot counts, so that any stretch of the
schedule is close to the target weights. The r-th slot of a source, by schedule order, takes its r-th block,
starting over when the axis ends; its last slot is cut so that the words taken meet the target exactly.

Null texts have size 0 and are never taken; a null source is a source of its own, the last one. Rows equal in
doc_id, text and source are copies of one document: each counts, and has a place of its own on the axis, one after
the other. Texts of any length are counted whole. An empty table gives an empty schedule. Ties of the shuffle are
broken by the document's key, so reruns agree. Other columns may have any name.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.llm.common import NOT_SPACE, free_name, partitions_for, saved

#: Words in a block, slots that one row of the slot list is expanded to, schedule positions ranked together.
BLOCK, CHUNK, SEGMENT_BITS = 1024, 4096, 14

#: Documents of one source that are laid out together, on average.
BUCKET_DOCS = 1024


class Mix(NamedTuple):
    """documents: key, doc_id, source, size, copies, source_size, target; schedule: slot (its place in the mix),
    key, copy, doc_id, source, epoch, block, start and length (in words of the document)."""

    documents: DataFrame
    schedule: DataFrame


def source_key(source: Column) -> Column:
    """A key that equality joins can use for null sources too."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def document_key(source_col: str = "source") -> Column:
    """Equal for rows that are one document."""
    return F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), source_key(F.col(source_col)), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Per source: words to take. Weights repeat over the sources by code point, nulls last; a source stops at cap
    times its size and what it leaves is shared by weight among the others, until none is above its cap.

    The windows have no key: the table has one row for each source."""
    by_name = W.orderBy(F.col("source").isNull(), "source")
    s = sizes.groupBy("skey").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    s = s.withColumn("nth", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("nth") - 1) % len(weights) + 1))
    s = s.withColumn("most", cap * F.col("source_size"))
    fills, every = W.orderBy(F.col("most") / F.col("weight"), "nth"), W.partitionBy()
    before = fills.rowsBetween(W.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("left", left).withColumn("heavy", heavy)
    level = F.when(F.col("most") * F.col("heavy") > F.col("weight") * F.col("left"), F.col("left") / F.col("heavy"))
    s = s.withColumn("level", F.first(level, ignorenulls=True).over(fills.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return s.withColumn("target", F.least("most", F.col("weight") * F.coalesce("level", F.lit(0.0)))).select("skey", "source", "nth", "source_size", "target")


def slot_counts(sources: DataFrame, block: int) -> DataFrame:
    """Adds full (whole passes), rest (words of the last one), blocks (of a pass), slots, before (those of earlier
    sources), and bits, with 2**bits schedule positions in all."""
    s = sources.withColumn("words", F.round("target").cast("long")).withColumn("full", F.expr("coalesce(try_divide(words - words % nullif(source_size, 0), source_size), 0)").cast("long"))
    s = s.withColumn("rest", F.col("words") - F.col("full") * F.col("source_size")).withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    s = s.withColumn("slots", F.col("full") * F.col("blocks") + F.expr(f"(rest + {block - 1}) div {block}"))
    s = s.withColumn("before", F.sum("slots").over(W.orderBy("nth")) - F.col("slots"))
    total = F.sum("slots").over(W.partitionBy())
    return s.withColumn("bits", F.greatest(F.lit(1), F.length(F.bin(F.greatest(total - 1, F.lit(1))))).cast("int"))


def slot_list(sources: DataFrame) -> DataFrame:
    """One row for each slot: slot (schedule position), skey, nth_slot (its rank within the source)."""
    n = partitions_for(sources.sparkSession)
    rows = sources.where("slots > 0").select("skey", "before", "slots", "bits", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK})")).alias("chunk")).repartition(n, "skey", "chunk")
    rows = rows.select("skey", "before", "bits", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(slots, (chunk + 1) * {CHUNK}) - 1)")).alias("k"))
    rows = rows.select("skey", F.expr("cast(conv(reverse(lpad(bin(before + k), bits, '0')), 2, 10) as long)").alias("slot"))
    rows = rows.withColumn("segment", F.shiftright("slot", SEGMENT_BITS))
    counts = rows.groupBy("skey", "segment").agg(F.count("*").alias("n"))
    counts = counts.select("skey", "segment", (F.sum("n").over(W.partitionBy("skey").orderBy("segment")) - F.col("n")).alias("earlier"))
    within = F.row_number().over(W.partitionBy("skey", "segment").orderBy("slot"))
    return rows.withColumn("within", within).join(counts, ["skey", "segment"]).select("skey", "slot", (F.col("earlier") + F.col("within") - 1).alias("nth_slot"))


def laid_out(documents: DataFrame, total: int) -> DataFrame:
    """Adds at: the words of the same source that come before the document and its copies in the shuffled order.

    Sums over ranges of the shuffle key come first, so that no source is ordered in one task."""
    bits = min(28, max(0, math.ceil(math.log2(max(1, total / BUCKET_DOCS)))))
    d = documents.where("size > 0").withColumn("bucket", F.shiftright(F.conv(F.substring("place", 1, 7), 16, 10).cast("long"), 28 - bits))
    words = F.col("size") * F.col("copies")
    sums = d.groupBy("skey", "bucket").agg(F.sum(words).alias("n"))
    sums = sums.select("skey", "bucket", (F.sum("n").over(W.partitionBy("skey").orderBy("bucket")) - F.col("n")).alias("earlier"))
    order = W.partitionBy("skey", "bucket").orderBy("place", "key").rowsBetween(W.unboundedPreceding, W.currentRow)
    return d.withColumn("within", F.sum(words).over(order) - words).join(sums, ["skey", "bucket"]).withColumn("at", F.col("earlier") + F.col("within"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2, block: int = BLOCK, seed: int = 1, source_col: str = "source") -> Mix:
    """Mix docs (doc_id, text and source_col) to `share` times all words, split by weights; see the module.

    cap: no source gives more than cap times its own words, and so no document more than ceil(cap) passes."""
    size = F.coalesce(F.regexp_count("text", F.lit(NOT_SPACE)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("skey"), size.alias("size"), document_key(source_col).alias("key"))
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), "key")))
    rows = rows.groupBy("key").agg(*(F.first(c).alias(c) for c in ("doc_id", "source", "skey", "size")), F.count("*").alias("copies")).withColumn("place", place)
    documents = saved(rows, "mix-documents")
    sources = saved(slot_counts(targets(documents, weights, share, cap), block), "mix-sources")
    laid = laid_out(documents, documents.count())
    laid = laid.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {CHUNK})"))).withColumn("copy", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(copies, (chunk + 1) * {CHUNK}) - 1)")))
    laid = laid.withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
    pieces = laid.select("key", "copy", "doc_id", "source", "skey", "size", "at", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
    slots = slot_list(sources).join(sources.select("skey", "blocks", "full", "rest", "source_size"), "skey")
    slots = slots.select("skey", "slot", (F.col("nth_slot") % F.col("blocks")).alias("block"), F.expr("nth_slot div blocks").alias("epoch"), "full", F.when(F.expr("nth_slot div blocks < full"), F.col("source_size")).otherwise(F.col("rest")).alias("until"))
    first, last = F.greatest("at", F.col("block") * block), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block, "until")
    taken = slots.join(pieces, ["skey", "block"]).where(first < last)
    schedule = taken.select("slot", "key", "copy", "doc_id", "source", "epoch", "block", (first - F.col("at")).alias("start"), (last - first).alias("length"))
    return Mix(documents.join(sources.select("skey", "source_size", "target"), "skey"), schedule)


def figures(mixed: Mix) -> DataFrame:
    """Per row of the input: doc_id, size, source_size, target and taken, the words that the schedule takes of it."""
    taken = mixed.schedule.groupBy("key", "copy").agg(F.sum("length").alias("taken"))
    rows = mixed.documents.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {CHUNK})"))).withColumn("copy", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(copies, (chunk + 1) * {CHUNK}) - 1)")))
    return rows.join(taken, ["key", "copy"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def texts(docs: DataFrame, mixed: Mix, source_col: str = "source") -> DataFrame:
    """The mix as rows of docs: a row for each pass that takes from a document. A pass that takes all of it keeps
    its text; one that ends within it keeps the words taken, joined by one space. Copies of a document, which are equal
    in doc_id, text and source, show the other columns of one of them."""
    key, doc, start, length, size = free_name(docs, "mix_key", "mix_doc", "mix_start", "mix_length", "mix_size")
    passes = mixed.schedule.groupBy("key", "copy", "epoch").agg(F.min("start").alias("start"), F.sum("length").alias("length"))
    passes = passes.join(mixed.documents.select("key", "size"), "key").select(F.col("key").alias(key), F.col("start").alias(start), F.col("length").alias(length), F.col("size").alias(size))
    rows = docs.withColumn(key, document_key(source_col)).groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*(c for c in docs.columns if c != "text")))).alias(doc))
    rows = rows.join(passes, key).select(f"{doc}.*", start, length, size)
    part = F.expr(rf"array_join(slice(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0), cast({start} + 1 as int), cast({length} as int)), ' ')")
    text = F.when(F.col(length) == F.col(size), F.col("text")).otherwise(part)
    return rows.select(*(text.alias(c) if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))
