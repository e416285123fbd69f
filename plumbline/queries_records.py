"""Registered queries on records, identifiers, labels, scripts and small measures of text and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions import biblio, checks, dist, numbers, symbolic, text
from plumbline.operators import biblio as library, locate, relational as rel, stats, vector
from plumbline.registry import query, table
from plumbline.sources import records, tables


def picked(column: str, *options: object) -> Column:
    """One of the options, by turns, by a column of whole numbers."""
    return F.element_at(F.array(*map(F.lit, options)), (F.col(column) % len(options) + 1).cast("int"))


# Records of services and files


@query("""
SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 3 > 0 THEN 'Doe' || p_partkey END AS family, CASE WHEN p_partkey % 3 > 0 THEN 'Jo' END AS given, CASE WHEN p_partkey % 4 > 0 THEN 1990 + p_size END::INT AS year, p_brand AS journal,
       CASE WHEN p_partkey % 2 = 0 THEN 'https://x.org/' || p_partkey ELSE 'https://doi.org/10.1/' || p_partkey END AS url, '10.1/' || p_partkey AS doi FROM part
""")
def crossref_records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    body = F.to_json(F.struct(
        F.array("p_name").alias("title"), F.array("p_brand").alias("container-title"), F.when(k % 3 > 0, F.array(F.struct(F.concat(F.lit("Doe"), k.cast("string")).alias("family"), F.lit("Jo").alias("given")))).alias("author"),
        F.when(k % 4 > 0, F.struct(F.array(F.array(F.lit(1990) + F.col("p_size"), F.lit(1))).alias("date-parts"))).alias("issued"), F.concat(F.lit("10.1/"), k.cast("string")).alias("DOI"), F.when(k % 2 == 0, F.concat(F.lit("https://x.org/"), k.cast("string"))).alias("URL"),
    ))
    found = table(spark, d, "part").select(k.alias("id"), records.crossref(body).alias("c"))
    first = F.get("c.author", F.lit(0))
    return found.select("id", "c.title", first["family"].alias("family"), first["given"].alias("given"), "c.year", F.col("c.containerTitle").alias("journal"), F.col("c.URL").alias("url"), F.col("c.DOI").alias("doi"))


@query("""
SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 3 > 0 THEN 'Jo Doe' ELSE 'Unknown author' END AS author, CASE WHEN p_partkey % 4 > 0 THEN 1990 + p_size END::INT AS year, p_brand AS publisher FROM part
""")
def open_library_records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    date = F.when(k % 4 > 0, F.concat((F.lit(1990) + F.col("p_size")).cast("string"), F.lit(" May"))).otherwise("May 1990")
    body = F.to_json(F.struct(F.col("p_name").alias("title"), date.alias("publish_date"), F.when(k % 3 > 0, F.array(F.struct(F.lit(" Jo Doe ").alias("name")))).alias("authors"), F.array("p_brand").alias("publishers")))
    found = table(spark, d, "part").select(k.alias("id"), records.open_library(body).alias("c"))
    return found.select("id", "c.title", F.get("c.author", F.lit(0))["family"].alias("author"), "c.year", F.col("c.containerTitle").alias("publisher"))


@query("""
SELECT p_partkey AS id, p_name AS title, 1990 + p_size AS year, 'https://pubmed.ncbi.nlm.nih.gov/' || p_partkey || '/' AS url FROM part
""")
def pubmed_records(spark: SparkSession, d: str) -> DataFrame:
    k, year = F.col("p_partkey"), (F.lit(1990) + F.col("p_size")).cast("string")
    body = F.to_json(F.struct(F.concat("p_name", F.when(k % 2 == 0, ".").otherwise("")).alias("title"), F.when(k % 3 == 0, F.concat(year, F.lit(" Jan 1"))).otherwise("").alias("pubdate"), F.concat(year, F.lit("/01/01")).alias("epubdate")))
    found = table(spark, d, "part").select(k.alias("id"), records.pubmed(k.cast("string"), body).alias("c"))
    return found.select("id", "c.title", "c.year", F.col("c.URL").alias("url"))


@query("""
SELECT 'W' || p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 3 > 0 THEN p_brand || ' and ' || p_brand ELSE '' END AS abstract_text, '2020-01-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') AS publication_date, CASE WHEN p_partkey % 2 = 0 THEN '7' END AS first_page FROM part
WHERE p_size % 28 >= 9 QUALIFY row_number() OVER (ORDER BY publication_date DESC, id) <= 50
""")
def recent_works(spark: SparkSession, d: str) -> DataFrame:
    """The fifty newest works of a date on, a report; abstracts from their inverted indexes."""
    k = F.col("p_partkey")
    index = F.when(k % 3 > 0, F.create_map("p_brand", F.array(F.lit(0), F.lit(2)), F.lit("and"), F.array(F.lit(1))))
    date = F.concat(F.lit("2020-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"))
    body = F.to_json(F.struct(F.concat(F.lit("W"), k.cast("string")).alias("id"), F.col("p_name").alias("title"), date.alias("publication_date"), index.alias("abstract_inverted_index"), F.struct(F.when(k % 2 == 0, "7").otherwise("").alias("first_page")).alias("biblio")))
    return records.recent_works(records.works(table(spark, d, "part").select(body.alias("body"))), "2020-01-10", 50).select("id", "title", "abstract_text", "publication_date", "first_page")


@query("""
SELECT p_partkey AS id, i - 1 AS nth, CASE WHEN i = 1 THEN p_name ELSE 'Second' END AS title, CASE WHEN i = 1 THEN 'Doe' ELSE 'Unknown author' END AS author, CASE WHEN i = 1 THEN 1990 + p_size END::INT AS year, CASE WHEN i = 1 AND p_partkey % 2 = 0 THEN p_brand END AS journal
FROM part, (SELECT unnest([1, 2]) AS i) WHERE i = 1 OR p_partkey % 3 = 0
""")
def endnote_records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    first = F.concat(F.lit("<record><title>"), F.col("p_name"), F.lit("</title><author><b>Doe</b></author><year>"), (F.lit(1990) + F.col("p_size")).cast("string"), F.lit(" c</year>"), F.when(k % 2 == 0, F.concat(F.lit("<secondary-title>"), "p_brand", F.lit("</secondary-title>"))).otherwise(""), F.lit("</record>"))
    xml = F.concat(F.lit("<xml><records>"), first, F.when(k % 3 == 0, "<record n='2'>\n<Title> Second </Title></record>").otherwise("<record><year>1999</year></record>"), F.lit("</records></xml>"))
    rows = table(spark, d, "part").select(k.alias("id"), F.posexplode(records.endnote_xml(xml)).alias("nth", "c"))
    return rows.select("id", "nth", "c.title", F.get("c.author", F.lit(0))["family"].alias("author"), "c.year", F.col("c.containerTitle").alias("journal"))


@query("""
SELECT p_partkey AS id, ['bibtex', 'ris', 'json', 'xml', 'plain', 'unknown'][p_partkey % 6 + 1] AS format, CASE WHEN p_partkey % 6 = 4 THEN p_name END AS title, CASE WHEN p_partkey % 6 = 4 THEN 1990 + p_size END::INT AS year, CASE WHEN p_partkey % 6 = 4 THEN 'Doe|Roe' END AS authors, CASE WHEN p_partkey % 6 = 4 THEN p_brand END AS journal FROM part
""")
def reference_formats(spark: SparkSession, d: str) -> DataFrame:
    """What a pasted reference is written in, and what a plain one says."""
    plain = F.concat(F.lit("Doe, Roe ("), (F.lit(1990) + F.col("p_size")).cast("string"), F.lit("). "), F.col("p_name"), F.lit(". "), F.col("p_brand"))
    raw = F.element_at(F.array(F.lit(" @article{x}"), F.lit("\nTY  - JOUR"), F.lit('{"type": "x"}'), F.lit("<a><record>1</record></a>"), plain, F.lit("  ")), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), records.detected_format(raw).alias("format"), F.when(F.col("p_partkey") % 6 == 4, records.plain_reference(raw)).alias("c"))
    return rows.select("id", "format", "c.title", "c.year", F.array_join(F.transform("c.author", lambda a: a["family"]), "|").alias("authors"), F.col("c.containerTitle").alias("journal"))


@query("""
SELECT p_partkey AS id, '10.1/AB' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '' END AS doi, '97801' || p_partkey || '9' AS isbn, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_partkey::VARCHAR END AS pmid, lpad((p_partkey % 10000)::VARCHAR, 4, '0') || '123X' AS issn FROM part
""")
def typed_identifiers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    doi = F.concat(picked("p_partkey", "https://doi.org/", "HTTP://dx.doi.org/", "doi: ", " DOI:", ""), F.lit("10.1/AB"), k, F.when(F.col("p_partkey") % 2 == 0, "/").otherwise(""))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), biblio.doi_as_typed(doi).alias("doi"), biblio.isbn(F.concat(F.lit("978-0 1"), k, F.lit("-9"))).alias("isbn"), biblio.pmid(F.when(F.col("p_partkey") % 5 == 0, "none").otherwise(F.concat(F.lit("PMID: "), k, F.lit(" x 7")))).alias("pmid"),
        biblio.issn_key(F.concat(F.lit("issn "), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.lit("-123x"))).alias("issn"),
    )


@query("""
WITH p AS (SELECT p_partkey AS k FROM part)
SELECT k AS id, CASE WHEN k % 2 = 0 THEN 'retracted' WHEN k % 3 = 0 THEN 'malformed' WHEN k % 5 = 0 THEN 'orphan' ELSE 'ok' END AS status, CASE WHEN k % 4 = 0 THEN 'verified' WHEN k % 3 = 0 THEN 'unverified' ELSE 'unchecked' END AS verification,
       CASE WHEN k % 2 = 0 THEN 'retracted' WHEN k % 3 = 0 THEN 'clear' ELSE 'unchecked' END AS retraction FROM p
""")
def record_states(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    checked = F.when(k % 3 == 0, k)
    sources = F.when(k % 4 == 0, F.array(F.lit("file"), F.lit("via crossref"))).otherwise(F.array(F.lit("file")))
    return table(spark, d, "part").select(k.alias("id"), biblio.status(k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("status"), biblio.verification(sources, checked).alias("verification"), biblio.retraction(k % 2 == 0, checked).alias("retraction"))


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'new title' END AS title, CASE WHEN p_partkey % 3 > 0 THEN p_size WHEN p_partkey % 5 > 0 THEN 2000 END::INT AS year, CASE WHEN p_partkey % 2 = 0 THEN 'own' WHEN p_partkey % 5 > 0 THEN 'theirs' END AS page FROM
  (SELECT *, p_partkey % 5 > 0 AS met FROM part) WHERE p_partkey % 2 = 0 OR met
UNION ALL SELECT p_partkey, '', CASE WHEN p_partkey % 3 > 0 THEN p_size END::INT, NULL FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 5 = 0
""")
def enriched_records(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of a library filled from what matched, nothing overwritten."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    none = F.lit(None).cast("string")
    mine = p.select(k.alias("id"), records.citation(F.when(k % 2 == 0, F.col("p_name")).otherwise(""), F.array().cast(records.AUTHOR), F.when(k % 3 > 0, F.col("p_size")), none, page=F.when(k % 2 == 0, "own")).alias("c"))
    theirs = p.where(k % 5 > 0).select(k.alias("match"), records.citation(F.lit("new title"), F.array().cast(records.AUTHOR), F.lit(2000), none, page=F.lit("theirs")).alias("c"))
    return library.enriched(mine, theirs).select("id", "c.title", "c.year", "c.page")


@query("SELECT p_partkey AS id FROM part WHERE (contains(lower(p_name), 'ring') OR p_partkey % 10 = 3) AND p_partkey % 2 = 1")
def library_search(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    entries = table(spark, d, "part").select(k.alias("id"), F.col("p_name").alias("title"), F.when(k % 10 == 3, "A RINGER").alias("authors"), F.lit(None).cast("string").alias("doi"), F.col("p_size").alias("year"), F.when(k % 2 == 1, F.array(F.lit("mine"))).otherwise(F.array(F.lit("other"))).alias("tags"))
    return library.search(entries, " Ring ", "mine").select("id")


# Scripts and directories


@query("""
SELECT p_partkey AS id, ['sps', 'r', 'exe', 'csv', 'py'][p_partkey % 5 + 1] AS kind, CASE p_partkey % 5 WHEN 2 THEN 'rejected' WHEN 4 THEN 'rejected' WHEN 0 THEN 'parsed' ELSE 'stored' END AS outcome, CASE p_partkey % 5 WHEN 2 THEN 'unsupported_format' WHEN 4 THEN 'empty' END AS reason FROM part
""")
def script_outcomes(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "part").select(F.concat(F.lit("/a.b/"), F.col("p_partkey").cast("string"), F.lit("."), picked("p_partkey", "SPS", "r", "exe", "csv", "py")).alias("path"), F.when(F.col("p_partkey") % 5 == 4, " \n").otherwise(F.col("p_name")).alias("text"))
    found = tables.script_outcomes(files)
    return found.select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("long").alias("id"), "kind", "outcome", "reason")


@query("""
SELECT p_partkey AS id, unnest([0, 1]) AS nth, unnest(['T-TEST GROUPS', 'FREQUENCIES VARIABLES']) AS kind, unnest(['MISSING=ANALYSIS;VARIABLES=v' || p_size, 'ORDER=ANALYSIS']) AS subcommands FROM part
""")
def syntax_procedures(spark: SparkSession, d: str) -> DataFrame:
    """Commands of SPSS syntax with comments around them."""
    body = F.concat(F.lit("* a comment.\r\nT-TEST GROUPS=g(1 2)\n  /MISSING=ANALYSIS\n  /VARIABLES=v"), F.col("p_size").cast("string"), F.lit(".\n\nfrequencies variables=x\n /ORDER=ANALYSIS /* why */.\n"))
    found = tables.syntax_procedures(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), body.alias("text")))
    subs = F.array_join(F.transform("subcommands", lambda s: F.concat(s["name"], F.lit("="), F.regexp_replace(s["value"], r"\s*/\* why \*/", ""))), ";")
    return found.select(F.col("path").cast("long").alias("id"), "nth", F.upper("kind").alias("kind"), subs.alias("subcommands"))


@query("""
SELECT p_brand || p_partkey AS title, CASE WHEN p_partkey % 2 = 0 THEN 'Life Sciences' ELSE 'General' END AS category, 'Q' || (p_size % 4 + 1) AS quartile, 'House ' || p_partkey AS publisher, CASE WHEN p_partkey % 3 = 0 THEN 'https://x.org' ELSE '' END AS website FROM part
""")
def journal_directories(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    lines = F.array(F.when(k % 2 == 0, "Life Sciences").otherwise("Contents"), F.lit(""), F.concat("p_brand", k.cast("string")), F.concat(F.lit("ISSN: 1234-5678 | Quartile: Q"), (F.col("p_size") % 4 + 1).cast("string"), F.lit(" | x")), F.concat(F.lit("Publisher: House "), k.cast("string")), F.when(k % 3 == 0, "Website: https://x.org").otherwise("Open access: no"))
    rows = table(spark, d, "part").select(k.alias("file"), F.posexplode(lines).alias("at", "line"))
    return tables.journal_directory(rows).select("title", "category", "quartile", "publisher", "website")


# Store


@query("SELECT 'kept' AS side, count(*) FILTER (c + t > 1000) AS n FROM (SELECT event_id % 900 AS c, event_id % 400 AS t FROM events) UNION ALL SELECT 'gone', count(*) FILTER (c + t <= 1000) FROM (SELECT event_id % 900 AS c, event_id % 400 AS t FROM events)")
def stale_rows(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "events").select("event_id", (F.col("event_id") % 900).alias("created_at"), (F.col("event_id") % 400).alias("ttl_seconds"))
    kept, gone = rel.without_stale(cache, 1000)
    return kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("side"), "n").unionByName(gone.select(F.lit("gone").alias("side"), "n"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'done' END AS outcome, false AS unknown FROM events WHERE user_id = 7
UNION ALL SELECT event_id, NULL, true FROM events WHERE event_id % 3 = 0 AND user_id <> 7
""")
def logged_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """One user's log with its outcomes, and the outcomes that belong to none of its entries."""
    events = table(spark, d, "events")
    log = rel.owned_by(events, "user_id", "7").select("event_id", F.lit(None).cast("string").alias("outcome"))
    done, unknown = rel.with_outcome(log, events.where("event_id % 3 = 0").select("event_id", F.lit("done").alias("outcome")), "event_id")
    return done.select("event_id", "outcome", F.lit(False).alias("unknown")).unionByName(unknown.select("event_id", F.lit(None).cast("string").alias("outcome"), F.lit(True).alias("unknown")))


@query("""
WITH p AS (SELECT l_orderkey % 500 AS doc, ['methods', 'results', 'other'][l_linenumber % 3 + 1] AS kind, l_linenumber AS paragraph FROM lineitem),
s AS (SELECT o_orderkey % 500 AS doc, ['methods', 'results'][o_orderkey % 2 + 1] AS kind, count(*) AS n FROM orders WHERE o_orderkey < 800 GROUP BY ALL)
SELECT doc, kind, paragraph, n, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'anchored' END AS state FROM p LEFT JOIN s USING (doc, kind)
""")
def ambiguous_locations(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("doc"), picked("l_linenumber", "methods", "results", "other").alias("kind"), F.col("l_linenumber").alias("paragraph"))
    s = table(spark, d, "orders").where("o_orderkey < 800").select((F.col("o_orderkey") % 500).alias("doc"), F.col("o_orderkey").alias("section"), picked("o_orderkey", "methods", "results").alias("kind"))
    return locate.ambiguous_locations(p, s)


@query("""
SELECT l_orderkey AS page, floor(l_quantity / 3 + 0.5)::BIGINT AS line, min(l_partkey) AS x0, min(l_quantity) AS y0, max(l_partkey + 5) AS x1, max(l_quantity + 2) AS y1 FROM lineitem GROUP BY ALL
""")
def merged_lines(spark: SparkSession, d: str) -> DataFrame:
    boxes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("x0"), F.col("l_quantity").alias("y0"), (F.col("l_partkey") + 5).alias("x1"), (F.col("l_quantity") + 2).alias("y1"))
    return locate.merged_lines(boxes, ("page",))


@query("SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS norm, round(u[1], 6) AS first, len(u) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN vec_id % 9 = 0 THEN 0 ELSE x / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))) END) AS u FROM embeddings)")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("vec_id") % 9 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    rows = table(spark, d, "embeddings").select("vec_id", vector.unit(v).alias("u"))
    return rows.select("vec_id", F.round(vector.dot(F.col("u"), F.col("u")), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"), F.size("u").cast("long").alias("n"))


# Text and labels


@query(r"""
WITH d AS (SELECT doc_id, text, string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+') AS raw FROM documents), w AS (SELECT doc_id, text, list_filter(raw, lambda x: x <> '') AS w FROM d),
g AS (SELECT doc_id, w, CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i+2], ' ')) ELSE [] END AS g FROM w)
SELECT doc_id, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN ('the', 'of', 'de', 'la'))) / len(w) END, 9) AS stopwords, round(CASE WHEN len(g) > 0 THEN len(list_distinct(g)) / len(g) END, 9) AS distinct_trigrams,
       array_to_string(list_transform(list_sort(list_transform(w, lambda x, i: {'n': -length(x), 'i': i, 'x': x}))[1:4], lambda v: v.x), ' ') AS longest, len(list_intersect(list_distinct(w), ['the', 'de', 'und', 'et'])) AS shared FROM g
""")
def word_measures(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", text.word_measures(F.col("text"), ("the", "of", "de", "la"), ("the", "de", "und", "et"), 4).alias("m"))
    return rows.select("doc_id", F.round("m.stopwords", 9).alias("stopwords"), F.round("m.distinct", 9).alias("distinct_trigrams"), F.array_join("m.terms", " ").alias("longest"), "m.shared")


@query("""
SELECT p_partkey AS id, p_partkey % 4 < 2 AS is_total, CASE p_partkey % 3 WHEN 0 THEN 1234.5 WHEN 1 THEN 12.0 END::DOUBLE AS quantity, round((p_size - 3.5)::DOUBLE, 6) AS numbers, 'a' || p_size || '.png' AS image, 'model-' || p_size AS model FROM part
""")
def cell_measures(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    label = picked("p_partkey", " Grand Total:: ", "overall", "total cost", "subtotal")
    found = text.numbers_in(F.concat(F.lit("n "), size, F.lit(" and -3.5 or so")))
    images = text.image_refs(F.concat(F.lit("x plumbline-image://a"), size, F.lit(".png y plumbline-image://a"), size, F.lit(".png")))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), text.is_total_label(label).alias("is_total"), text.quantity(picked("p_partkey", "1,234.5", " 12% ", "n/a")).alias("quantity"), F.round(F.aggregate(found, F.lit(0.0), lambda s, x: s + x), 6).alias("numbers"), F.array_join(images, "|").alias("image"),
        text.model_id(F.concat(F.lit("C:\\models/Model-"), size, F.lit(".GGUF"))).alias("model"),
    ).withColumn("image", F.regexp_replace("image", "^plumbline-image://", ""))


@query("""
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'internal duplication' WHEN value >= 98 THEN 'near-identical' WHEN value >= 85 THEN 'high overlap' ELSE 'partial overlap' END AS label, CASE WHEN value < 20 THEN 'below_p10' WHEN value < 50 THEN 'below_median' ELSE 'typical' END AS place,
       [0.7, 0.45, 0.2][event_id % 3 + 1]::DOUBLE AS risk, CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 END::DOUBLE AS weight, floor(event_id * 0.767::DOUBLE)::BIGINT AS words FROM events
""")
def signal_labels(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", text.match_label(v / 100, F.col("event_id") % 10 == 0).alias("label"), text.perplexity_place(v, F.lit(20.0), F.lit(50.0)).alias("place"), text.signal_risk(picked("event_id", "high", "medium", "low")).alias("risk"),
        text.tier_weight(picked("event_id", "factual", "structural", "stylometric", "none")).alias("weight"), vector.budget_words(F.col("event_id")).alias("words"),
    )


@query("""
SELECT doc_id, [true, false, false, false][doc_id % 4 + 1] AS one_tailed, [true, false, true, false, false][doc_id % 5 + 1] AS corrected, CASE WHEN doc_id % 2 = 0 THEN 'All authors of papers must submit the data with their own manuscript' || doc_id || '.' ELSE '' END AS told FROM documents
""")
def sentence_detectors(spark: SparkSession, d: str) -> DataFrame:
    tails = picked("doc_id", "A one-tailed test.", "Not one-tailed at all.", "A one-sided confidence interval.", "Two-tailed.")
    fixes = picked("doc_id", "Holm corrected.", "No more.", "The FDR was 5%.", "Hollow.", "Tuk")
    told = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Short one. All authors of papers must submit the data with their own manuscript"), F.col("doc_id").cast("string"), F.lit(". This long sentence says nothing at all of what anybody has to do."))).otherwise("Nothing is told here.")
    return table(spark, d, "documents").select("doc_id", text.one_tailed(tails).alias("one_tailed"), text.names_correction(fixes).alias("corrected"), F.array_join(text.expectation_sentences(told), "|").alias("told"))


@query("""
SELECT event_id, [true, true, false][event_id % 3 + 1] AS guidance, CASE event_id % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'too_long' END AS title, CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'done' END AS moved FROM events
""")
def guards_and_moves(spark: SparkSession, d: str) -> DataFrame:
    url = picked("event_id", "https://x.org/Peer-Review", "https://x.org/a", "https://x.org/a")
    subjects = F.when(F.col("event_id") % 3 == 1, F.array(F.lit("Review methods"), F.lit("b"))).otherwise(F.array(F.lit("Review methods")))
    title = F.when(F.col("event_id") % 4 == 0, "  ").when(F.col("event_id") % 4 == 1, F.repeat(F.lit("x"), 121)).otherwise("fine")
    moves = {("queued", "start"): "running", ("running", "finish"): "done"}
    return table(spark, d, "events").select("event_id", checks.reviewer_guidance(url, F.lit("t"), subjects).alias("guidance"), checks.title_ok(title).alias("title"), checks.can_move(picked("event_id", "queued", "running", "done"), picked("event_id", "start", "finish", "start"), moves).alias("moved"))


@query("""
SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'dimension' WHEN 2 THEN 'not_finite' END AS reason FROM embeddings
""")
def vector_refusals(spark: SparkSession, d: str) -> DataFrame:
    v, k = F.col("embedding"), F.col("vec_id") % 5
    spoiled = F.when(k == 0, None).when(k == 1, F.slice(v, 1, 3)).when(k == 2, F.transform(v, lambda x, i: F.when(i == 1, F.lit(float("nan"))).otherwise(x))).otherwise(v)
    dim = table(spark, d, "embeddings").agg(F.max(F.size("embedding")).alias("dim")).first()["dim"] or 0
    return table(spark, d, "embeddings").select("vec_id", checks.vector_ok(spoiled, dim).alias("reason"))


@query("""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'missing_group' WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'other_level' WHEN c_custkey % 7 = 0 THEN 'missing_outcome' WHEN c_custkey % 11 = 0 THEN 'missing_code' ELSE 'used' END AS reason FROM customer) GROUP BY reason
""")
def every_exclusion(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.when(k % 5 == 0, F.when(k % 2 == 0, "")).otherwise(F.col("c_mktsegment")).alias("g"), F.when(k % 7 == 0, None).when(k % 11 == 0, -99.0).otherwise(F.col("c_acctbal") + 1e6).alias("y"))
    return stats.exclusion_counts(rows, "g", "y", ("BUILDING", "MACHINERY"), (-99.0,))


@query("""
SELECT event_type, CASE WHEN event_type = 'error' THEN 'BLOCKED' WHEN event_type = 'click' THEN 'ROLLBACK' WHEN event_type = 'purchase' THEN 'PROMOTE' ELSE 'HOLD' END AS verdict FROM (SELECT DISTINCT event_type FROM events)
""")
def every_promotion(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, d, "events").select("event_type").distinct().select("event_type", F.when(kind == "click", -0.5).when(kind.isin("purchase", "error"), 0.5).otherwise(0.01).alias("delta"), (kind != "error").alias("deterministic"))
    return rel.gate(rows).select("event_type", "verdict")


# Numbers


@query("""
WITH p AS (SELECT p_partkey AS k, p_size / 10.0 AS x, p_partkey % 19 / 20.0 AS r FROM part), q AS (SELECT *, x / sqrt(1 + x * x / 4) AS u FROM p)
SELECT k, round(1 - 0.75 * u * (1 - u * u / 12), 9) AS t4, round(exp(-x / 2) * (1 + x / 2), 9) AS chi4, round((1 + x / 2) ** -2, 9) AS f24, round(1 - (1 + x / 2) ** -2, 9) AS f24_lower, round(least(1, 2 * least((1 + x / 2) ** -2, 1 - (1 + x / 2) ** -2)), 9) AS f24_two, round(1 - r, 9) AS r2,
       round(CASE WHEN p_t > 0 THEN p_t END, 9) AS t2 FROM (SELECT *, 1 - x / sqrt(2 + x * x) AS p_t FROM q)
""")
def tails_in_closed_form(spark: SparkSession, d: str) -> DataFrame:
    """t with 2 and 4 degrees of freedom, chi-square with 4, F with (2, 4) in its three tails, r with 2."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") / 10.0).alias("x"), (F.col("p_partkey") % 19 / 20.0).alias("r"))
    two, four = F.lit(2.0), F.lit(4.0)
    columns = {"t4": dist.t_two_tailed("x", four), "chi4": dist.chi_square_upper("x", four), "f24": dist.f_upper("x", two, four), "f24_lower": dist.f_lower("x", two, four), "f24_two": dist.f_two_tailed("x", two, four), "r2": dist.r_two_tailed("r", two), "t2": dist.t_two_tailed("x", two)}
    found = rows.select("k", *(c.alias(n) for n, c in columns.items()))
    return found.select("k", *(F.round(n, 9).alias(n) for n in columns))


@query("""
WITH i AS (SELECT p_partkey AS k, p_size - 25.0 AS n, p_retailprice AS x, p_partkey % 40 / 10.0 - 2 AS y FROM part), v AS (SELECT k, n, x - 0.005 AS a, x + 0.005 AS b, y - 0.05 AS c, y + 0.05 AS d FROM i)
SELECT k, round(n::DOUBLE, 3) AS literal, round(-d, 3) AS negated, a <= n + 950 AND b >= n + 950 AS overlaps, CASE WHEN c <= 0 AND d >= 0 THEN 0 ELSE round(least(c * c, d * d), 4) END AS square_lo, round(greatest(c * c, d * d), 4) AS square_hi, c <= 0 AND d >= 0 AS no_quotient FROM v
""")
def interval_steps(spark: SparkSession, d: str) -> DataFrame:
    n, x, y = (F.col("p_size") - 25).cast("string"), numbers.measured(F.format_string("%.2f", "p_retailprice")), numbers.measured(F.format_string("%.1f", F.col("p_partkey") % 40 / 10.0 - 2))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), numbers.literal(n).alias("n"), numbers.literal((F.col("p_size") + 925).cast("string")).alias("m"), x.alias("x"), y.alias("y"))
    rows = rows.select("*", numbers.to_power(F.col("y"), 2).alias("s"))
    value = lambda c, p: F.round(c.cast("double"), p)
    return rows.select("k", value(F.col("n.lo"), 3).alias("literal"), value(numbers.negated(F.col("y"))["lo"], 3).alias("negated"), numbers.overlaps(F.col("x"), F.col("m")).alias("overlaps"), value(F.col("s.lo"), 4).alias("square_lo"), value(F.col("s.hi"), 4).alias("square_hi"), numbers.over(F.col("x"), F.col("y")).isNull().alias("no_quotient"))


@query("""
SELECT p_partkey AS k, ['identical', 'differs', 'agrees_at_every_point_tested', 'undetermined'][p_partkey % 4 + 1] AS verdict FROM part
""")
def equivalent_expressions(spark: SparkSession, d: str) -> DataFrame:
    """A square and its expansion, the same with another constant, a quotient, and a root."""
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    square, expanded = F.concat(F.lit("(a + "), n, F.lit(")^2")), F.concat(F.lit("a^2 + 2*a*"), n, F.lit(" + "), n, F.lit("*"), n)
    left = F.when(k < 2, square).when(k == 2, F.concat(F.lit("(a^2 - "), n, F.lit("^2) / (a - "), n, F.lit(")"))).otherwise("sqrt(a)")
    right = F.when(k == 0, expanded).when(k == 1, F.concat(expanded, F.lit(" + 1"))).when(k == 2, F.concat(F.lit("a + "), n)).otherwise("a")
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), symbolic.equivalence(left, right)["verdict"].alias("verdict"))
