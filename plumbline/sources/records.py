"""Bibliographic services and files as DataFrames: records arrive as text columns and leave as citation structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

AUTHOR = "array<struct<family:string,given:string>>"

# The parts of the services' records that are read.
WORK = "id string, title string, publication_date string, type string, abstract_inverted_index map<string,array<bigint>>, biblio struct<first_page:string,last_page:string>"
CROSSREF = "title array<string>, `container-title` array<string>, author array<struct<family:string,given:string,name:string>>, issued struct<`date-parts`:array<array<int>>>, volume string, issue string, page string, DOI string, URL string"
OPEN_LIBRARY = "title string, publish_date string, authors array<struct<name:string>>, publishers array<string>"
PUBMED = "title string, pubdate string, epubdate string, authors array<struct<name:string>>"


def citation(title: Column, author: Column, year: Column, journal: Column, **more: Column) -> Column:
    """A citation struct; fields that are not given are null."""
    fields = {"title": title, "author": author.cast(AUTHOR), "year": year.cast("int"), "containerTitle": journal, **more}
    order = ("title", "author", "year", "containerTitle", "volume", "issue", "page", "URL", "DOI")
    return F.struct(*(fields.get(f, F.lit(None).cast("string")).alias(f) for f in order))


def literal_authors(names: Column) -> Column:
    """Names that are not split; one unknown author where there is none."""
    named = F.transform(F.filter(names, lambda n: F.trim(n) != ""), lambda n: F.struct(F.trim(n).alias("family"), F.lit(None).cast("string").alias("given")))
    return F.when(F.coalesce(F.size(named), F.lit(0)) > 0, named).otherwise(F.array(F.struct(F.lit("Unknown author").alias("family"), F.lit(None).cast("string").alias("given"))))


def leading_year(text: Column) -> Column:
    return F.substring(text, 1, 4).try_cast("int")


def abstract(inverted: Column) -> Column:
    """The text of an inverted index (word to places): all places in order, their words joined by spaces."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


def works(bodies: DataFrame, json_col: str = "body") -> DataFrame:
    """id, title, abstract_text, publication_date, work_type, first_page and last_page of one work a row."""
    w = bodies.select(F.from_json(json_col, WORK).alias("w"))
    page = lambda c: F.nullif(F.col(f"w.biblio.{c}"), F.lit(""))
    text = lambda c: F.coalesce(F.col(f"w.{c}"), F.lit(""))
    return w.select(text("id").alias("id"), text("title").alias("title"), abstract(F.col("w.abstract_inverted_index")).alias("abstract_text"), text("publication_date").alias("publication_date"), text("type").alias("work_type"), page("first_page").alias("first_page"), page("last_page").alias("last_page"))


def recent_works(all_works: DataFrame, since: str, most: int) -> DataFrame:
    """The newest works from a date on, at most 200."""
    return all_works.where(F.col("publication_date") >= since).orderBy(F.desc("publication_date"), "id").limit(max(1, min(200, most)))


def crossref(json: Column) -> Column:
    m = F.from_json(json, CROSSREF)
    name = lambda a: F.when(F.coalesce(a["family"], F.lit("")) != "", a["family"]).when(F.coalesce(a["given"], F.lit("")) == "", F.coalesce(a["name"], F.lit(""))).otherwise("")
    authors = F.filter(F.transform(m["author"], lambda a: F.struct(name(a).alias("family"), a["given"].alias("given"))), lambda a: (a["family"] != "") | (F.coalesce(a["given"], F.lit("")) != ""))
    url = F.coalesce(m["URL"], F.concat(F.lit("https://doi.org/"), m["DOI"]))
    return citation(F.coalesce(F.get(m["title"], F.lit(0)), F.lit("")), authors, F.get(F.get(m["issued"]["date-parts"], F.lit(0)), F.lit(0)), F.get(m["container-title"], F.lit(0)), volume=m["volume"], issue=m["issue"], page=m["page"], DOI=m["DOI"], URL=url)


def open_library(json: Column) -> Column:
    m = F.from_json(json, OPEN_LIBRARY)
    return citation(F.coalesce(m["title"], F.lit("")), literal_authors(m["authors"]["name"]), leading_year(m["publish_date"]), F.get(m["publishers"], F.lit(0)))


def pubmed(uid: Column, json: Column) -> Column:
    m = F.from_json(json, PUBMED)
    date = F.coalesce(F.nullif(m["pubdate"], F.lit("")), m["epubdate"])
    return citation(F.regexp_replace(F.coalesce(m["title"], F.lit("")), r"\.$", ""), literal_authors(m["authors"]["name"]), leading_year(date), F.lit(None).cast("string"), URL=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), uid, F.lit("/")))


def detected_format(text: Column) -> Column:
    """bibtex, ris, json, xml, plain or unknown."""
    t = F.trim(text)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "unknown").when(t.startswith("@"), "bibtex").when(t.rlike(r"(?m)^TY\s\s?-"), "ris")
        .when((t.startswith("{") | t.startswith("[")) & t.contains('"type"'), "json").when(t.contains("<record") & t.contains("</record>"), "xml")
        .when(t.contains("<?xml") & t.contains("EndNote"), "xml").otherwise("plain")
    )


def plain_reference(line: Column) -> Column:
    """A reference "Author, Author (2020). Title. Journal": a citation, or null where the line has another shape."""
    s = F.trim(line)
    rest = F.regexp_extract(s, r"\((\d{4})\)\s*\.\s*(.+)", 2)
    names = F.split(F.regexp_extract(s, r"^([^(]*)\(", 1), r"(?i),| and ")
    parts = F.split(rest, r"\.\s+")
    made = citation(F.coalesce(F.nullif(F.trim(F.get(parts, F.lit(0))), F.lit("")), rest), literal_authors(names), F.regexp_extract(s, r"\((\d{4})\)\s*\.\s*.+", 1).try_cast("int"), F.trim(F.get(parts, F.lit(1))))
    return F.when((F.length(s) >= 12) & (rest != ""), made)


def endnote_xml(xml: Column) -> Column:
    """An array of citations, one for each record with a title or authors."""
    def one(rec: Column) -> Column:
        text = lambda *tags: F.coalesce(*(F.nullif(F.trim(F.regexp_replace(F.regexp_extract(rec, rf"(?s)<{t}\b[^>]*>(.*?)</{t}>", 1), "<[^>]+>", " ")), F.lit("")) for t in tags), F.lit(""))
        authors = F.split(text("author", "Authors", "Author"), r"(?i);|,|\band\b")
        return citation(text("title", "ArticleTitle", "Title"), literal_authors(authors), leading_year(text("year", "Year", "PublicationYear")), F.nullif(text("secondary-title", "Journal", "Periodical"), F.lit("")))

    records = F.regexp_extract_all(xml, F.lit(r"(?s)(<record\b.*?</record>)"), 1)
    return F.filter(F.transform(records, one), lambda c: (c["title"] != "") | (F.get(c["author"], F.lit(0))["family"] != "Unknown author"))


def ris_entries(text: Column) -> Column:
    """The entries of a RIS file, TY to ER; what is not closed is an entry too."""
    lines = F.regexp_replace(text, "\r\n?", "\n")
    return F.filter(F.transform(F.split(lines, r"(?m)^ER\s\s?-.*$"), lambda e: F.trim(e)), lambda e: e.rlike(r"(?m)^TY\s\s?-"))


def ris_citation(entry: Column) -> Column:
    tag = lambda *names: F.coalesce(*(F.nullif(F.trim(F.regexp_extract(entry, rf"(?m)^{t}\s\s?-\s*(.*)$", 1)), F.lit("")) for t in names))
    names = F.regexp_extract_all(entry, F.lit(r"(?m)^(?:AU|A1)\s\s?-\s*(.*)$"), 1)
    authors = F.transform(names, lambda n: F.struct(F.trim(F.get(F.split(n, ","), F.lit(0))).alias("family"), F.trim(F.get(F.split(n, ","), F.lit(1))).alias("given")))
    pages = F.concat_ws("-", tag("SP"), tag("EP"))
    return citation(tag("TI", "T1"), authors, leading_year(tag("PY", "Y1")), tag("JO", "T2", "JF"), volume=tag("VL"), issue=tag("IS"), page=F.nullif(pages, F.lit("")), DOI=tag("DO"), URL=tag("UR"))


def bibtex_entries(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each entry of BibTeX texts: type, key and fields (a map, names in small letters), or error. Comments,
    strings and preambles are passed over; an entry that cannot be read does not stop the others."""
    import pandas as pd

    def entries(text: str):
        import re

        at = 0
        while m := re.compile(r"@\s*(\w+)\s*\{").search(text, at):
            depth, i = 1, m.end()
            while i < len(text) and depth:
                depth += (text[i] == "{") - (text[i] == "}")
                i += 1
            body, kind = text[m.end() : i - 1], m[1].lower()
            at = i if not depth else m.end()
            if kind in ("comment", "string", "preamble"):
                continue
            key, _, rest = body.partition(",")
            if depth or not key.strip() or "=" in key:
                yield kind, None, None, "unbalanced" if depth else "no_key"
                continue
            fields, j = {}, 0
            while f := re.compile(r"\s*([\w-]+)\s*=\s*").match(rest, j):
                k, opened = f.end(), rest[f.end() : f.end() + 1]
                level, n = 0, k
                while n < len(rest) and not (rest[n] == "," and level == 0 and not (opened == '"' and rest.count('"', k, n) % 2)):
                    level += (rest[n] == "{") - (rest[n] == "}")
                    n += 1
                fields[f[1].lower()] = re.sub(r"\s+", " ", rest[k:n].strip().strip('"').replace("{", "").replace("}", "")).strip()
                j = n + 1
            yield kind, key.strip(), fields, None

    def read(batches):
        for batch in batches:
            rows = [e for t in batch[text_col] for e in entries((t or "").replace("\r\n", "\n").lstrip("﻿"))]
            yield pd.DataFrame(rows, columns=["type", "key", "fields", "error"])

    return texts.select(text_col).mapInPandas(read, "type string, key string, fields map<string,string>, error string")


def bibtex_citation(fields: Column) -> Column:
    f = lambda name: F.nullif(F.try_element_at(fields, F.lit(name)), F.lit(""))
    names = F.split(f("author"), r"\s+and\s+")
    authors = F.transform(names, lambda n: F.when(n.contains(","), F.struct(F.trim(F.get(F.split(n, ","), F.lit(0))).alias("family"), F.trim(F.get(F.split(n, ","), F.lit(1))).alias("given"))).otherwise(F.struct(F.regexp_extract(n, r"(\S+)\s*$", 1).alias("family"), F.trim(F.regexp_extract(n, r"^(.*?)\S+\s*$", 1)).alias("given"))))
    return citation(f("title"), authors, f("year").try_cast("int"), F.coalesce(f("journal"), f("booktitle")), volume=f("volume"), issue=f("number"), page=F.replace(f("pages"), F.lit("--"), F.lit("-")), DOI=f("doi"), URL=f("url"))


def to_bibtex(key: Column, c: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"  {name} = {{"), value.cast("string"), F.lit("},\n"))
    names = F.array_join(F.transform(c["author"], lambda a: F.concat_ws(", ", a["family"], F.nullif(a["given"], F.lit("")))), " and ")
    fields = (("title", c["title"]), ("author", F.nullif(names, F.lit(""))), ("year", c["year"]), ("journal", c["containerTitle"]), ("volume", c["volume"]), ("number", c["issue"]), ("pages", c["page"]), ("doi", c["DOI"]), ("url", c["URL"]))
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), *(F.coalesce(line(n, v), F.lit("")) for n, v in fields), F.lit("}"))


def to_ris(c: Column) -> Column:
    line = lambda tag, value: F.concat(F.lit(f"{tag}  - "), value.cast("string"), F.lit("\n"))
    names = F.array_join(F.transform(c["author"], lambda a: line("AU", F.concat_ws(", ", a["family"], F.nullif(a["given"], F.lit(""))))), "")
    fields = (("TI", c["title"]), ("PY", c["year"]), ("JO", c["containerTitle"]), ("VL", c["volume"]), ("IS", c["issue"]), ("SP", c["page"]), ("DO", c["DOI"]), ("UR", c["URL"]))
    return F.concat(F.lit("TY  - JOUR\n"), F.coalesce(names, F.lit("")), *(F.coalesce(line(t, v), F.lit("")) for t, v in fields), F.lit("ER  - "))
