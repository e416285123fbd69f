"""Bibliographic records: normalised keys, record states, and citation formats, as Column expressions.

A citation is a struct column with title, author (array of family, given), year, containerTitle, volume, issue, page,
DOI and URL, all nullable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The fields that enrichment may fill, in the order in which a difference lists them.
ENRICHED = ("title", "author", "year", "containerTitle", "volume", "issue", "page", "URL")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def doi_key(doi: Column) -> Column:
    """A DOI for comparison: small letters, no resolver or doi: in front, no slash behind; null if nothing is left."""
    out = F.lower(F.trim(doi))
    out = F.regexp_replace(out, r"^https?://(dx\.)?doi\.org/", "")
    out = F.regexp_replace(out, r"^doi:\s*", "")
    return blank_to_null(F.trim(F.regexp_replace(out, "/+$", "")))


def doi_as_typed(doi: Column) -> Column:
    """A DOI for display: resolver and doi: dropped, letters and slashes left."""
    return F.regexp_replace(F.regexp_replace(F.trim(doi), r"(?i)^https?://(dx\.)?doi\.org/", ""), r"(?i)^doi:\s*", "")


def title_key(title: Column) -> Column:
    """Small letters, punctuation as white space, runs collapsed; empty for null."""
    out = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def title_year_key(title: Column, year: Column) -> Column:
    """title::year, null unless there are both."""
    key = title_key(title)
    return F.when((key != "") & year.isNotNull(), F.concat_ws("::", key, year.cast("string")))


def isbn(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[-\s]", "")


def pmid(raw: Column) -> Column:
    """The first run of digits, or empty."""
    return F.regexp_extract(raw, r"(\d+)", 1)


def issn(text: Column) -> Column:
    """The first ISSN in a text, in capitals, or null."""
    return blank_to_null(F.upper(F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d{4}-\d{3}[\dxX])", 1)))


def issn_key(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "[^0-9xX]", ""))


def quartile(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(F.coalesce(text, F.lit("")), "(Q[1-4])", 1))


def risk(scopus: Column, wos: Column, signals: Column, issn_: Column, quartile_: Column) -> Column:
    """struct(level, reasons): attention that a journal's record calls for, and why. Evidence, not a verdict."""
    indexed = scopus | wos
    found = F.concat(
        F.when(~indexed, F.array(F.lit("Not indexed in Scopus or Web of Science"))).otherwise(F.array().cast("array<string>")), signals,
        F.when(issn_.isNull(), F.array(F.lit("No ISSN on record"))).otherwise(F.array().cast("array<string>")),
    )
    level = F.when(~indexed | (F.size(signals) > 0), "red").when(F.coalesce(quartile_ == "Q4", F.lit(False)) | issn_.isNull() | ((scopus != wos) & ~wos), "amber").otherwise("green")
    default = F.when(level == "red", F.lit("Multiple caution signals")).when(level == "amber", F.lit("Indexed, but single-database or lower quartile — verify fit")).otherwise(F.when(wos, F.lit("Indexed in Scopus & Web of Science")).otherwise(F.lit("Indexed in Scopus")))
    return F.struct(level.alias("level"), F.when((level == "green") | (F.size(found) == 0), F.array(default)).otherwise(found).alias("reasons"))


def status(retracted: Column, malformed: Column, orphan: Column) -> Column:
    """The most serious state first."""
    return F.when(retracted, "retracted").when(malformed, "malformed").when(orphan, "orphan").otherwise("ok")


def verification(provenance: Column, checked_at: Column) -> Column:
    """verified, unverified or unchecked: a missing check is not a failed one."""
    return F.when(F.exists(provenance, lambda p: p.contains("crossref")), "verified").when(checked_at.isNotNull(), "unverified").otherwise("unchecked")


def retraction(retracted: Column, checked_at: Column) -> Column:
    """retracted, clear or unchecked; an absent check is never clear."""
    return F.when(retracted, "retracted").when(checked_at.isNotNull(), "clear").otherwise("unchecked")


def is_empty(c: Column, field: str) -> Column:
    value = c[field]
    return F.coalesce(F.size(value) <= 0, F.lit(True)) if field == "author" else value.isNull() if field == "year" else F.coalesce(value == "", F.lit(True))


def field_delta(existing: Column, incoming: Column) -> Column:
    """The fields that existing lacks and incoming has."""
    return F.filter(F.array(*(F.when(is_empty(existing, f) & ~is_empty(incoming, f), F.lit(f)) for f in ENRICHED)), lambda x: x.isNotNull())


def filled(existing: Column, incoming: Column) -> Column:
    """existing with what it lacks taken from incoming; what it has stays."""
    fields = [F.when(is_empty(existing, f) & ~is_empty(incoming, f), incoming[f]).otherwise(existing[f]).alias(f) for f in ENRICHED]
    return F.struct(*fields, existing["DOI"].alias("DOI"))


def initials(given: Column) -> Column:
    """J. R. for given names; empty for none."""
    parts = F.split(F.coalesce(given, F.lit("")), r"\s+")
    return F.when(F.coalesce(given, F.lit("")) == "", F.lit("")).otherwise(F.array_join(F.transform(parts, lambda g: F.concat(F.upper(F.substring(g, 1, 1)), F.lit("."))), " "))


def joined(names: Column, last: str) -> Column:
    n = F.size(names)
    return (
        F.when(n == 0, F.lit("Anonymous")).when(n == 1, F.get(names, F.lit(0)))
        .otherwise(F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(last), F.element_at(names, -1)))
    )


def italic(s: Column) -> Column:
    return F.when(s != "", F.concat(F.lit("*"), s, F.lit("*"))).otherwise(F.lit(""))


def bold(s: Column) -> Column:
    return F.when(s != "", F.concat(F.lit("**"), s, F.lit("**"))).otherwise(F.lit(""))


def formatted(c: Column, style: str) -> Column:
    """One citation in apa, mla, chicago-author-date, vancouver, harvard, ieee, nature or ama."""
    text = lambda f: F.coalesce(c[f], F.lit(""))
    vol, issue, pages, journal, title = (text(f) for f in ("volume", "issue", "page", "containerTitle", "title"))
    iss = F.when(issue != "", F.concat(F.lit("("), issue, F.lit(")"))).otherwise(F.lit(""))
    year = F.coalesce(c["year"].cast("string"), F.lit("n.d."))
    link = F.coalesce(F.concat(F.lit("https://doi.org/"), blank_to_null(c["DOI"])), c["URL"], F.lit(""))
    given = lambda a: F.coalesce(a["given"], F.lit(""))
    apa = joined(F.transform(c["author"], lambda a: F.concat(a["family"], F.lit(", "), initials(a["given"]))), ", & ")
    mla = joined(F.transform(c["author"], lambda a, i: F.trim(F.when(i == 0, F.concat(a["family"], F.lit(", "), given(a))).otherwise(F.concat(given(a), F.lit(" "), a["family"])))), ", and ")
    bare = lambda a: F.regexp_replace(initials(a["given"]), r"[.\s]", "")
    vancouver = F.array_join(F.transform(c["author"], lambda a: F.trim(F.concat(a["family"], F.lit(" "), bare(a)))), ", ")
    ieee = joined(F.transform(c["author"], lambda a: F.trim(F.concat(F.regexp_replace(initials(a["given"]), r"\s", ""), F.lit(" "), a["family"]))), " and ")
    parts = {
        "mla": (mla, ". “", title, ".” ", italic(journal), ", vol. ", vol, ", no. ", issue, ", ", year, ", pp. ", pages, "."),
        "chicago-author-date": (mla, ". ", year, ". “", title, ".” ", italic(journal), " ", vol, iss, ": ", pages, "."),
        "vancouver": (vancouver, ". ", title, ". ", journal, ". ", year, ";", vol, iss, ":", pages, "."),
        "harvard": (apa, " (", year, ") ‘", title, "’, ", italic(journal), ", ", vol, iss, ", pp. ", pages, "."),
        "ieee": (ieee, ", “", title, ",” ", italic(journal), ", vol. ", vol, ", no. ", issue, ", pp. ", pages, ", ", year, "."),
        "nature": (vancouver, ". ", title, ". ", italic(journal), " ", bold(vol), ", ", pages, " (", year, ")."),
        "ama": (vancouver, ". ", title, ". ", italic(journal), ". ", year, ";", vol, iss, ":", pages, ". doi:", F.coalesce(c["DOI"], F.lit(""))),
        "apa": (apa, " (", year, "). ", title, ". ", italic(journal), ", ", vol, iss, ", ", pages, ". ", link),
    }[style]
    return F.trim(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))


def unique_keys(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with unique_key: the second row of a key gets key-2, and so on, in order. Keys that themselves end in -N
    of an earlier key are passed over: see plumbline.operators.biblio.decollided for the lowest free number."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(key).orderBy(order))
    return rows.withColumn("unique_key", F.when(n == 1, F.col(key)).otherwise(F.concat_ws("-", F.col(key), n.cast("string"))))
