"""Citation libraries: duplicates against a library, import plans, enrichment and export keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions import biblio as B


def keyed(citations: DataFrame) -> DataFrame:
    """citations (id, seq, c) with doi_key and title_key."""
    return citations.withColumn("doi_key", B.doi_key(F.col("c.DOI"))).withColumn("title_key", B.title_year_key(F.col("c.title"), F.col("c.year")))


def duplicates(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """candidates with tier (doi, title-year or null) and match, the earliest id of the library that has the key."""
    first = lambda key: keyed(library).where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("id", "seq").alias(f"{key}_match"))
    rows = keyed(candidates).join(first("doi_key"), "doi_key", "left").join(first("title_key"), "title_key", "left")
    tier = F.when(F.col("doi_key_match").isNotNull(), "doi").when(F.col("title_key_match").isNotNull(), "title-year")
    return rows.select("id", "seq", "c", tier.alias("tier"), F.coalesce("doi_key_match", "title_key_match").alias("match"))


def import_plan(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """What to do with each entry: failed (no title and no DOI), enrich (a DOI match that lacks what it has), skipped (a
    DOI match with nothing new), review (same title and year), added. Entries also meet those before them in the batch.

    Groups of one key are settled by their first entry, in one window each; batches are what a person imports."""
    rows = duplicates(candidates, library)
    rows = rows.withColumn("doi_key", B.doi_key(F.col("c.DOI"))).withColumn("title_key", B.title_year_key(F.col("c.title"), F.col("c.year")))
    earlier = lambda key: F.when(F.col(key).isNotNull(), F.first("id").over(W.partitionBy(key).orderBy("seq")))
    rows = rows.withColumn("first_doi", earlier("doi_key")).withColumn("first_title", earlier("title_key"))
    existing = library.select(F.col("id").alias("match"), F.col("c").alias("held"))
    rows = rows.join(existing, "match", "left")
    delta = F.when(F.col("tier") == "doi", B.field_delta(F.col("held"), F.col("c")))
    action = (
        F.when((F.coalesce("c.title", F.lit("")) == "") & F.col("doi_key").isNull(), "failed").when((F.col("tier") == "doi") & (F.size(delta) > 0), "enrich").when(F.col("tier") == "doi", "skipped")
        .when(F.col("tier") == "title-year", "review").when(F.col("first_doi") != F.col("id"), "skipped").when(F.col("first_title") != F.col("id"), "review").otherwise("added")
    )
    return rows.select("id", "seq", action.alias("action"), "match", F.coalesce(delta, F.array().cast("array<string>")).alias("fills"))


def enriched(library: DataFrame, incoming: DataFrame) -> DataFrame:
    """library (id, c) with gaps filled from incoming (match, c)."""
    rows = library.join(incoming.select(F.col("match").alias("id"), F.col("c").alias("new")), "id", "left")
    return rows.select("id", F.when(F.col("new").isNotNull(), B.filled(F.col("c"), F.col("new"))).otherwise(B.filled(F.col("c"), F.col("c"))).alias("c"))


def decollided(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows (key, order) with unique_key: a key seen before gets the lowest -N, from 2, that is free at its turn.

    Only keys with the same stem can get in each other's way: a stem is a key without -N at its end, and the rows of a
    stem, in order, are one group of an export."""
    import pandas as pd

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def number(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        taken: set[str] = set()
        out = []
        for k in group[key]:
            name, n = k, 2
            while name in taken:
                name, n = f"{k}-{n}", n + 1
            taken.add(name)
            out.append(name)
        return group.drop(columns="__stem").assign(unique_key=out)

    stem = F.regexp_replace(F.col(key), r"(-\d+)+$", "")
    return rows.withColumn("__stem", stem).groupBy("__stem").applyInPandas(number, f"{kinds}, unique_key string")


def search(library: DataFrame, text: str, tag: str | None = None) -> DataFrame:
    """Entries (title, authors, doi, year, tags) that contain the text in any field, and have the tag if given."""
    q = text.strip().lower()
    fields = F.lower(F.concat_ws("\n", "title", "authors", "doi", F.col("year").cast("string"), F.array_join("tags", "\n")))
    out = library.where(fields.contains(q))
    return out if tag is None else out.where(F.array_contains("tags", tag))
