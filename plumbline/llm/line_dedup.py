"""Line dedup: overlapping windows of three consecutive lines, found again anywhere in the corpus.

Lines without a word are passed over when windows are formed and always stay. Lines are compared without the white
space at their ends. The first occurrence of a window, by (doc_id, text, line), stays; the lines that later occurrences
cover go, unless they also belong to the first occurrence of a repeated window.

Null texts count as empty and come back null. Texts of fewer than three full lines have no window and stay whole; texts
of any length are read whole. A null doc_id is the largest. Rows of one doc_id with different texts are different
documents, in an order of their own (a hash); rows that repeat wholly are one document and lose the same lines. Other
columns are kept, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import NO_ID, Scratch, free_name, row_key, saved, with_flag

WINDOW = 3

#: Fixed value: white space in a regular expression.
SPACE = r"[\x20\x09-\x0D]"


def lines_of(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def windows(docs: DataFrame, text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """key, id, nth (window of the document), places (its lines), h1 and h2 (a 128-bit hash of them)."""
    trimmed = F.transform(F.col("lines"), lambda x, i: F.struct(i.alias("i"), F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "").alias("x")))
    full = F.filter(trimmed, lambda v: v["x"] != "")
    rows = docs.select(row_key(text_col=text_col).alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), lines_of(text_col).alias("lines"))
    rows = rows.select("key", "id", full.alias("full")).where(F.size("full") >= width)

    def hashed(i: Column) -> Column:
        at = [F.element_at("full", (i + k + 1).cast("int")) for k in range(width)]
        return F.struct(i.cast("long").alias("nth"), F.array(*(x["i"] for x in at)).alias("places"), F.xxhash64(*(x["x"] for x in at)).alias("h1"), F.xxhash64(*(x["x"] for x in reversed(at)), F.lit(1)).alias("h2"))

    found = F.transform(F.sequence(F.lit(0), F.size("full") - width), hashed)
    return rows.select("key", "id", F.inline(found))


def removed_lines(docs: DataFrame, text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """key (of row_key) and removed: the sorted numbers of the lines that go, for documents that lose any."""
    with Scratch(docs.sparkSession) as scratch:
        all_windows = scratch.saved(windows(docs, text_col, width), "line-windows")
        here = F.struct("id", "key", "nth")
        first = all_windows.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first < last").drop("last")
        repeated = all_windows.join(first, ["h1", "h2"]).select("key", "places", (here > F.col("first")).alias("later"))
        sides = repeated.groupBy("key").agg(*(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("later") == later, F.col("places"))))).alias(name) for name, later in (("go", True), ("stay", False))))
        return saved(sides.select("key", F.array_sort(F.array_except("go", "stay")).alias("removed")).where(F.size("removed") > 0), "line-removed")


def dedup(docs: DataFrame, text_col: str = "text", width: int = WINDOW, report: bool = False) -> DataFrame:
    """docs with the repeated lines taken out of text_col; with report, also n_lines and n_removed, in the place of
    columns of these names."""
    key, removed, cut, maybe = free_name(docs, "row_key", "removed", "cut", "maybe_cut")
    gone = removed_lines(docs, text_col, width).select(F.col("key").alias(key), F.col("removed").alias(removed))
    rows = with_flag(docs.withColumn(key, row_key(text_col=text_col)), key, gone.select(key), maybe)  # other texts stay where they lie
    rows = rows.where(maybe).drop(maybe).join(gone, key, "left").unionByName(rows.where(~F.col(maybe)).drop(maybe), allowMissingColumns=True)
    lines = lines_of(text_col)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(removed))
    text = F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    extra = {"n_lines": F.size(lines).cast("long"), "n_removed": F.coalesce(F.size(removed), F.lit(0)).cast("long")} if report else {}
    columns = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in extra]
    rows = rows.select(*columns, *(v.alias(c) for c, v in extra.items()), F.col(removed).isNotNull().alias(cut))
    if "n_chars" in docs.columns:  # in a step of its own, so that the text is made once
        rows = rows.withColumn("n_chars", F.when(F.col(cut), F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.drop(cut)
