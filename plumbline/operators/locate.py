"""Finding passages: occurrences, spans, and which sentence a citation belongs to."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.operators.filters import maybe_in


def hits(text: Column, needle: Column) -> Column:
    """All places of needle in text, from 0, overlapping ones too."""
    last = F.length(text) - F.length(needle)
    return F.when((last >= 0) & (needle != ""), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substr(text, i + 1, F.length(needle)) == needle)).otherwise(F.array().cast("array<int>"))


def kth_occurrence(planned: DataFrame, printed: DataFrame) -> DataFrame:
    """planned (doc, needle, seq) with the place of its k-th printed hit (doc, needle, page, at), k being its turn among
    planned rows of the same needle; null, with reason "exhausted" or "absent", where there are not so many."""
    mine = planned.withColumn("k", F.row_number().over(W.partitionBy("doc", "needle").orderBy("seq")))
    found = printed.withColumn("k", F.row_number().over(W.partitionBy("doc", "needle").orderBy("page", "at")))
    any_hit = printed.select("doc", "needle").distinct().withColumn("present", F.lit(True))
    rows = mine.join(found, ["doc", "needle", "k"], "left").join(any_hit, ["doc", "needle"], "left")
    reason = F.when(F.col("page").isNull(), F.when(F.col("present"), "exhausted").otherwise("absent"))
    return rows.select("doc", "needle", "seq", "page", "at", reason.alias("reason"))


def sentence_of_citation(citations: DataFrame, sentences: DataFrame, most: int = 2) -> DataFrame:
    """citations (doc, cite, start, end) with seq of the sentence (doc, seq, s0, s1) that holds the end of its range,
    else of the last that ends before it starts; null with reason "wide" for ranges over more than `most` sentences,
    "none" otherwise. Sentences of a document do not overlap.

    If sentences have a text, a sentence that is nothing but cited link text (no letter outside the ranges that start in
    it) passes its citations to the one before. Both sides are shuffled once, together, by document; in order of place
    the last sentence begun and the one before it are carried forward, so no citation meets more than these. Rows that
    repeat wholly are one citation, and each of them counts the sentences that it covers."""
    last = F.greatest(F.col("end") - 1, F.col("start"))
    told = sentences.select("doc", *(F.col(c).cast("long").alias(c) for c in ("seq", "s0", "s1")), *(c for c in ("text",) if c in sentences.columns), F.lit(False).alias("cited"))
    rows = told.unionByName(citations.select("doc", "cite", "start", "end", F.lit(True).alias("cited")), allowMissingColumns=True)
    # A given number of parts: by their compressed size they would be put together until the sorts below spill.
    rows = rows.repartition(int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc")
    in_order = lambda at, *more: W.partitionBy("doc").orderBy(F.coalesce("s0", at.cast("long")), "cited", *more)  # noqa: E731  at one place: sentences, citations
    so_far = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)

    by_start = in_order(F.col("start"), "end", "cite")  # rows that repeat are neighbours, and the last of them stays
    row = F.struct("cited", "start", "end", "cite")
    rows = rows.withColumn("previous", F.last("seq", ignorenulls=True).over(by_start.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("nth", F.row_number().over(by_start)).withColumn("first", ~row.eqNullSafe(F.lag(row).over(by_start))).withColumn("repeated", F.col("cited") & row.eqNullSafe(F.lead(row).over(by_start)))
    begun = F.last(F.when(~F.col("cited"), F.struct("seq", "s0", "s1", "previous")), ignorenulls=True).over(so_far(by_start))
    rows = rows.select("*", begun.alias("local"), F.count_if(~F.col("cited")).over(so_far(by_start)).alias("n_local"), (F.col("nth") - F.last(F.when(F.col("first"), F.col("nth")), ignorenulls=True).over(so_far(by_start)) + 1).alias("times"))
    rows = rows.where(~F.col("repeated")).drop("nth", "first", "repeated")

    by_last = so_far(in_order(last))
    inside = F.last(F.when(~F.col("cited"), F.struct("seq", "s1")), ignorenulls=True).over(by_last)
    rows = rows.select("*", inside.alias("inside"), F.count_if(~F.col("cited")).over(by_last).alias("n_last"))
    open_yet = F.coalesce(F.col("local.s1") > F.col("start"), F.lit(False))
    wide = (F.col("n_last") - F.col("n_local") + open_yet.cast("long")) * F.col("times") > most
    before = F.when(open_yet, F.col("local.previous")).otherwise(F.col("local.seq"))
    rows = rows.withColumn("wide", F.col("cited") & wide).withColumn("seq", F.when(~F.col("cited"), F.col("seq")).when(~F.col("wide"), F.coalesce(F.when(last < F.col("inside.s1"), F.col("inside.seq")), before)))
    if "text" in sentences.columns:
        here = F.col("cited") & ~F.col("wide") & (F.col("start") < F.col("local.s1"))
        span = F.struct((F.col("start") - F.col("local.s0")).alias("a"), (F.col("end") - F.col("local.s0")).alias("b"))
        rows = rows.select("doc", "cite", "cited", "wide", "seq", "previous", "text", F.when(here, span).alias("span"), F.when(F.col("cited"), F.col("local.seq")).otherwise(F.col("seq")).alias("of"))
        rows = rows.withColumn("spans", F.collect_set("span").over(W.partitionBy("doc", "of")))
        signs = F.filter(F.sequence(F.lit(0), F.length("text") - 1), lambda i: F.substr("text", i + 1, F.lit(1)).rlike(r"\p{L}"))
        bare = F.exists(signs, lambda i: ~F.exists("spans", lambda s: (s["a"] <= i) & (i < s["b"])))
        any_cited = F.exists("spans", lambda s: (s["b"] > s["a"]) & (s["a"] < F.length("text")))
        link = ~F.col("cited") & F.col("doc").isNotNull() & F.col("seq").isNotNull() & (F.length("text") > 0) & any_cited & ~bare
        rows = rows.select("doc", "cite", "cited", "wide", "seq", F.when(link, F.col("previous")).alias("instead"))
        rows = rows.withColumn("seq", F.coalesce(F.max("instead").over(W.partitionBy("doc", "seq")), "seq"))
    return rows.where("cited").select("doc", "cite", "seq", F.when(F.col("wide"), "wide").when(F.col("seq").isNull(), "none").alias("reason"))


def merged_spans(spans: DataFrame, by: tuple[str, ...], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching spans of each group as one."""
    w = W.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = spans.withColumn("__new", (F.col(start) > F.coalesce(reach, F.lit(-1))).cast("int")).withColumn("__island", F.sum("__new").over(w))
    return rows.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def containment_matches(texts: DataFrame, references: DataFrame, least: float = 0.5) -> DataFrame:
    """texts (id, grams) against references (ref, rank, grams): the reference that holds the largest share of a text's
    grams, if `least` or more, the lowest rank at a tie. Through an inverted index, which grams that no text has do not
    enter; a text's grams are distinct."""
    mine = texts.select("id", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    theirs = maybe_in(references.select("ref", "rank", F.explode(F.array_distinct("grams")).alias("g")), "g", mine.select("g"))
    shares = mine.join(theirs, "g").groupBy("id", "n", "ref", "rank").agg(F.count("*").alias("hits")).withColumn("score", F.col("hits") / F.col("n")).where(F.col("score") >= least)
    return shares.groupBy("id").agg(F.max_by(F.struct("ref", "score"), F.struct("score", -F.col("rank"))).alias("best")).select("id", "best.*")


def merged_lines(boxes: DataFrame, by: tuple[str, ...], unit: float = 3.0) -> DataFrame:
    """Text boxes (x0, y0, x1, y1) of each group put together where their baselines round to the same multiple of unit."""
    line = F.floor(F.col("y0") / unit + 0.5)
    return boxes.groupBy(*by, line.alias("line")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def ambiguous_locations(places: DataFrame, sections: DataFrame) -> DataFrame:
    """places (doc, kind, paragraph) with how many sections (doc, section, kind) have that kind; more than one is
    ambiguous."""
    n = sections.groupBy("doc", "kind").agg(F.count("*").alias("n"))
    return places.join(n, ["doc", "kind"], "left").withColumn("state", F.when(F.coalesce("n", F.lit(0)) == 0, "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("anchored"))


def placed_passages(sections: DataFrame, passages: DataFrame) -> DataFrame:
    """passages (doc, idx, kind, text, start) with the section (doc, section, kind, text) in which each is placed and its
    place there, from 0; both null if it is not.

    Sections are taken in order, and each takes the passages of its kind that none before it has taken, by start and idx,
    looking behind the last one that it has taken; one that is not found there is passed over. The order is a fold over
    the passages of a section with the place reached as its state, and only what is placed nowhere goes on to the next
    section of its kind."""
    both = sections.groupBy("doc", "kind").agg(F.array_sort(F.collect_list(F.struct("section", "text"))).alias("sections"))
    mine = passages.groupBy("doc", "kind").agg(F.array_sort(F.collect_list(F.struct("start", "idx", "text"))).alias("passages"))
    state = "struct<at:int,out:array<struct<idx:bigint,section:bigint,place:int>>>"

    def taken(out: Column, idx: Column) -> Column:
        return F.exists(out, lambda o: o["idx"] == idx)

    def through(done: Column, section: Column) -> Column:
        def one(s: Column, p: Column) -> Column:
            place = F.when(F.length(p["text"]) == 0, s["at"]).otherwise(F.call_function("locate", p["text"], section["text"], s["at"] + 1) - 1)
            hit = ~taken(done, p["idx"]) & (place >= 0)
            row = F.struct(p["idx"].cast("long").alias("idx"), section["section"].cast("long").alias("section"), place.alias("place"))
            return F.struct(F.when(hit, place + F.length(p["text"])).otherwise(s["at"]).alias("at"), F.when(hit, F.concat(s["out"], F.array(row))).otherwise(s["out"]).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(state)
        return F.concat(done, F.aggregate("passages", start, lambda s, p: one(s, p).cast(state), lambda s: s["out"]))

    folded = F.aggregate("sections", F.array().cast("array<struct<idx:bigint,section:bigint,place:int>>"), through)
    found = mine.join(both, ["doc", "kind"]).select("doc", "kind", F.inline(folded))
    return passages.join(found, ["doc", "kind", "idx"], "left").select("doc", "idx", "kind", "section", "place")


#: Characters of needles that are sought at once.
NEEDLE_CHARS = 2_000_000


def needle_hits(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """id, needle and at (from 0) of every place of every needle (needle, text) in texts (id, text), overlapping ones too.

    The needles are a stated set: they come to the driver a partition at a time, in blocks of at most NEEDLE_CHARS, and
    each block is one automaton that goes over every text once, however many needles it holds. Null and empty needles are
    nowhere; needles that are equal are found each under its own number."""
    import ahocorasick
    import pyarrow as pa

    def blocks() -> Iterator[dict[str, list[int]]]:
        block: dict[str, list[int]] = {}
        size = 0
        for row in needles.where("text is not null and text <> ''").select(F.col("needle").cast("long").alias("needle"), "text").toLocalIterator():
            if block and size + len(row.text) > NEEDLE_CHARS:
                yield block
                block, size = {}, 0
            block.setdefault(row.text, []).append(row.needle)
            size += len(row.text)
        if block:
            yield block

    def seek(block: dict[str, list[int]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for text, numbers in block.items():
                automaton.add_word(text, (len(text), numbers))
            automaton.make_automaton()
            for batch in batches:
                found: tuple[list, list, list] = ([], [], [])
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for end, (length, numbers) in automaton.iter(text or ""):
                        for n in numbers:
                            for column, value in zip(found, (key, n, end - length + 1), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["id", "needle", "at"])

        return texts.select(F.col("id").cast("long"), "text").mapInArrow(run, "id long, needle long, at long")

    found = [seek(b) for b in blocks()]
    return reduce(DataFrame.unionByName, found) if found else texts.sparkSession.createDataFrame([], "id long, needle long, at long")
