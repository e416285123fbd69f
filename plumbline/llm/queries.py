"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import ann, html_text, importance, lexical_search, license_scan, line_dedup, mixing, near_dup, packing, quality_model, quality_rules, substring, token_shards
from plumbline.llm.common import NO_ID, new_path, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.figures(mixing.mix(table(spark, sf_dir, "documents")))


def vocabulary() -> str:
    """The tokenizer file that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.components(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, num=90, den=100)
    given = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(given("id").alias("doc_id"), "n_shingles", given("component").alias("component_id"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    scores = quality_model.scored(table(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards, written to a new folder of the shared one, and what is known of each record in them."""
    path = new_path(spark, "token-shards")
    return token_shards.materialised(table(spark, sf_dir, "documents"), vocabulary(), path).withColumn("path", F.lit(path))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.with_verdict(docs, statistics=True)
    return judged.select("doc_id", *quality_rules.STATISTICS, "base_failed", F.col("rejected_by").isNull().alias("kept"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "found")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.with_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20, buckets=10_000, longest=1, seed=2024)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_quality_model": op5_quality_model,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_shards": op7_token_shards,
    "op8_quality_rules": op8_quality_rules,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_html_text": op10_html_text,
    "op11_lexical_search": op11_lexical_search,
    "op12_license_scan": op12_license_scan,
    "op13_importance_resampling": op13_importance_resampling,
}

#: Terms of a text, A-Z lower-cased.
TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {TERMS_SQL} AS w FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({TERMS_SQL}) AS t FROM benchmark),
u AS (SELECT rid, unnest(w) AS t FROM d),
p AS (SELECT rid, t, CAST(count(*) AS BIGINT) AS tf FROM u SEMI JOIN q USING (t) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY t, big_n),
m AS (SELECT rid, doc_id, 50 + (50 * len(w) * big_n) // big_l AS m FROM d, c),
s AS (SELECT item_id, doc_id, rid, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM q JOIN p USING (t) JOIN f USING (t) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""


def as_expression(template: license_scan.Template) -> str:
    """A template as a regular expression over words with a space before and behind each."""
    kinds = {"must": lambda x: " " + b" ".join(x).decode(), "opt": lambda x: f"(?: {b' '.join(x).decode()})?", "var": lambda x: f"(?: [^ ]+){{0,{x}}}?"}
    return "".join(kinds[kind](what) for kind, what in license_scan.parts(template.wording)) + " "


#: Each template as label, expression and weight.
TEMPLATES_SQL = ", ".join(f"('{t.label}', '{as_expression(t)}', {t.weight}::DOUBLE, {str(t in license_scan.BASE).lower()})" for t in (*license_scan.BASE, *license_scan.TEMPLATES))

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {TERMS_SQL} AS w FROM documents),
l AS (SELECT rid, ' ' || array_to_string(w, ' ') || ' ' AS x FROM d),
b AS (SELECT rid, list_filter(generate_series(0, len(w) - 1), lambda i:
        w[i+1] = 'mit' AND w[i+2] = 'license' OR w[i+1] = 'apache' AND w[i+2] = 'license' OR w[i+1] = 'general' AND w[i+2] = 'public' AND w[i+3] = 'license') AS spots FROM d),
t AS (SELECT * FROM (VALUES {TEMPLATES_SQL}) AS t(label, form, weight, base)),
f AS (SELECT rid, label, weight, base FROM l JOIN t ON regexp_matches(x, form)),
g AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score FROM f GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base, list_min(spots) AS first_word, list_max(spots) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d JOIN b USING (rid) LEFT JOIN g USING (rid)
"""

#: crc32 of a word: the register runs over the bytes, eight steps of shift and polynomial (fixed value) each.
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(1, len(hex(encode(t))), 2), lambda i: ('0x' || substr(hex(encode(t)), i, 2))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {TERMS_SQL} AS w FROM documents),
a AS (SELECT rid, unnest(w) AS t FROM d),
b AS (SELECT unnest({TERMS_SQL}) AS t FROM benchmark),
h AS (SELECT t, {CRC_SQL} % 10000 AS bucket FROM (SELECT t FROM a UNION SELECT t FROM b)),
sa AS (SELECT bucket, count(*) AS s FROM a JOIN h USING (t) GROUP BY bucket),
sb AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (t) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM a) AS all_s, (SELECT count(*) FROM b) AS all_t),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000)))) AS BIGINT) AS gain FROM sa LEFT JOIN sb USING (bucket), n),
v AS (SELECT rid, sum(gain) AS weight FROM a JOIN h USING (t) JOIN g USING (bucket) GROUP BY rid),
r AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
             ('0x' || left(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 8))::BIGINT AS h FROM d LEFT JOIN v USING (rid)),
s AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM k
"""

OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines
  FROM documents),
g AS (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5),
h AS (SELECT rid, i, w[i:i+4] AS g FROM g),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM h) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2, i+3, i+4]) AS p FROM r) GROUP BY rid),
s AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         len(regexp_extract_all(text, '!')) AS n_exclaim, len(full_lines) AS n_lines,
         CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words
            OR 2 * n_exclaim > n_words OR 10 * n_dup_lines > 7 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM s
"""

OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth
  FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(nth - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS most FROM s),
f AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0) AS left_over,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS heavy,
         row_number() OVER (ORDER BY most / weight, nth) AS turn
  FROM w WINDOW b AS (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(left_over / heavy, turn) AS level FROM f WHERE most * heavy > weight * left_over),
t AS (
  SELECT source, source_size, least(most, weight * coalesce(level, 0)) AS target,
         CAST(round(least(most, weight * coalesce(level, 0))) AS BIGINT) AS words
  FROM f, v),
a AS (
  SELECT d.*, t.source_size, t.target, t.words,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY place ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size
         + greatest(0, least(pos + size, words % source_size) - pos) END AS taken
FROM a
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS g FROM g),
m AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY g) AS later FROM h),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(i, i + 12)) AS p FROM m WHERE later)),
u AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS p, unnest(w) AS x FROM d),
k AS (SELECT u.doc_id, count(gone.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY u.p) FILTER (gone.p IS NULL), '') AS kept
      FROM u LEFT JOIN gone USING (doc_id, p) GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g, count(*) AS c FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT s.doc_id, s.g FROM s JOIN f USING (g)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 90 * (a.n + b.n - shared)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
c AS (SELECT doc_id AS v, doc_id AS root FROM d UNION SELECT l.y, c.root FROM c JOIN l ON l.x = c.v WHERE c.root < l.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(c.root) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.v = d.doc_id GROUP BY d.doc_id, n.n
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT id, unnest(generate_series(0, len(lines) - 1)) AS i, unnest(lines) AS x FROM d),
t AS (SELECT id, i, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS x FROM l),
f AS (SELECT id, i, x, row_number() OVER (PARTITION BY id ORDER BY i) AS nth FROM t WHERE x <> ''),
w AS (SELECT a.id, a.nth, [a.i, b.i, c.i] AS places, [a.x, b.x, c.x] AS xs
      FROM f a JOIN f b ON a.id = b.id AND b.nth = a.nth + 1 JOIN f c ON a.id = c.id AND c.nth = a.nth + 2),
r AS (SELECT id, places, row_number() OVER (PARTITION BY xs ORDER BY id, nth) > 1 AS later, count(*) OVER (PARTITION BY xs) AS n FROM w),
p AS (SELECT id, later, unnest(places) AS i FROM r WHERE n > 1),
gone AS (SELECT id, i FROM p GROUP BY id, i HAVING bool_and(later)),
k AS (SELECT l.id, count(*) AS n_lines, count(gone.i) AS n_removed,
             coalesce(string_agg(x, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '') AS kept
      FROM l LEFT JOIN gone ON l.id = gone.id AND l.i = gone.i GROUP BY l.id)
SELECT id AS doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM k
"""

ORACLES = {
    "op3_substring_dedup": OP3_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op6_line_dedup": OP6_SQL,
    "op1_mixing": OP1_SQL,
    "op8_quality_rules": OP8_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_license_scan": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
}
