"""Registered queries on claims: reproduction, intervals, shared passages, search, citations and wording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions import features, intervals, places, wording
from plumbline.operators import locate, vector, verbatim
from plumbline.plans.reproduce import Claim, reproduced
from plumbline.registry import query, table
from plumbline.streaming import gate

# Claims against data


def line_claims(printed: dict[tuple[str, str], str]) -> list[Claim]:
    """Fifty claims on line items: a t-test for each of seven line numbers and two statuses with other prints, and more."""
    out = []
    for i in range(42):
        filters = (("l_linenumber", (str(i % 7 + 1),)), ("l_linestatus", ("F",) if i % 3 else ("F", "O")))
        key = f"t{i:02d}"
        out.append(Claim(key, 1, "independent_t", ("l_returnflag", "l_quantity"), printed.get((key, "student"), "0"), ("A", "R"), filters=filters if i % 4 else (), variant=(None, "welch", "student")[i % 3], decimals=(("l_quantity", 0),) if i % 2 else ()))
    out.append(Claim("p1", 1, "paired_t", ("l_discount", "l_tax"), printed.get(("p1", "paired"), "0"), decimals=(("l_discount", 2), ("l_tax", 2))))
    out.append(Claim("p2", 1, "paired_t", ("l_discount", "l_tax"), printed.get(("p2", "paired"), "0"), filters=(("l_returnflag", ("N",)),)))
    out.append(Claim("f1", 1, "one_way", ("l_returnflag", "l_quantity"), printed.get(("f1", "one_way"), "0"), ("A", "N", "R"), decimals=(("l_quantity", 0),)))
    out.append(Claim("f2", 1, "one_way", ("l_linenumber", "l_extendedprice"), printed.get(("f2", "one_way"), "0"), ("1", "2", "3", "4")))
    out.append(Claim("r1", 1, "pearson", ("l_quantity", "l_extendedprice"), printed.get(("r1", "pearson"), "0"), decimals=(("l_quantity", 0), ("l_extendedprice", 2))))
    out.append(Claim("x1", 1, "chi_square", ("l_returnflag", "l_linestatus"), printed.get(("x1", "uncorrected"), "0"), (("A", "N", "R"), ("F", "O"))))
    out.append(Claim("x2", 1, "chi_square", ("l_returnflag", "l_linestatus"), printed.get(("x2", "yates"), "0"), (("A", "R"), ("F", "O"))))
    out.append(Claim("m1", 1, "one_way", ("l_returnflag", "l_quantity"), "1.0", ("A", "no such level")))
    return out


CLAIMS_SQL = """
WITH c AS (
  SELECT printf('t%02d', i) AS claim_id, CASE WHEN i % 4 > 0 THEN [(i % 7 + 1)::VARCHAR] END AS numbers, CASE WHEN i % 4 > 0 THEN CASE WHEN i % 3 > 0 THEN ['F'] ELSE ['F', 'O'] END END AS statuses,
         [['student', 'welch'], ['welch'], ['student']][i % 3 + 1] AS variants, i % 2 = 1 AS rounded FROM (SELECT unnest(generate_series(0, 41)) AS i)),
t AS (
  SELECT claim_id, variants, rounded, l_returnflag AS g, l_quantity AS y,
         numbers IS NOT NULL AND NOT (list_contains(numbers, l_linenumber::VARCHAR) AND list_contains(statuses, l_linestatus)) AS gone,
         l_returnflag IS NULL OR l_quantity IS NULL AS missing FROM lineitem, c),
m AS (
  SELECT claim_id, any_value(variants) AS variants, CASE WHEN any_value(rounded) THEN 0.5 ELSE 0 END AS h, count(*) AS rows_read, count(*) FILTER (gone) AS filtered_out,
         count(*) FILTER (NOT gone AND missing) AS missing_in_bound_column, count(*) FILTER (NOT gone AND NOT missing AND g NOT IN ('A', 'R')) AS level_not_selected,
         count(*) FILTER (NOT gone AND NOT missing AND g IN ('A', 'R')) AS n,
         (count(y) FILTER (NOT gone AND g = 'A'))::DOUBLE AS n1, avg(y) FILTER (NOT gone AND g = 'A') AS m1, var_pop(y) FILTER (NOT gone AND g = 'A') AS v1,
         (count(y) FILTER (NOT gone AND g = 'R'))::DOUBLE AS n2, avg(y) FILTER (NOT gone AND g = 'R') AS m2, var_pop(y) FILTER (NOT gone AND g = 'R') AS v2
  FROM t GROUP BY claim_id),
s AS (
  SELECT *, unnest(variants) AS variant, m1 - m2 AS diff, v1 * n1 AS s1, v2 * n2 AS s2 FROM m),
u AS (
  SELECT *, CASE WHEN variant = 'student' THEN sqrt(s1 + s2) * sqrt((1 / n1 + 1 / n2) / (n1 + n2 - 2)) ELSE sqrt(s1 / (n1 * (n1 - 1)) + s2 / (n2 * (n2 - 1))) END AS se,
         CASE WHEN variant = 'student' THEN greatest(sqrt(s1 + s2) - h * sqrt(n1 + n2), 0) * sqrt((1 / n1 + 1 / n2) / (n1 + n2 - 2))
              ELSE sqrt(greatest(sqrt(s1) - h * sqrt(n1), 0) ** 2 / (n1 * (n1 - 1)) + greatest(sqrt(s2) - h * sqrt(n2), 0) ** 2 / (n2 * (n2 - 1))) END AS se0,
         CASE WHEN variant = 'student' THEN (sqrt(s1 + s2) + h * sqrt(n1 + n2)) * sqrt((1 / n1 + 1 / n2) / (n1 + n2 - 2))
              ELSE sqrt((sqrt(s1) + h * sqrt(n1)) ** 2 / (n1 * (n1 - 1)) + (sqrt(s2) + h * sqrt(n2)) ** 2 / (n2 * (n2 - 1))) END AS se1
  FROM s)
SELECT claim_id, variant, round(diff / se, 6) AS computed, rows_read, filtered_out, missing_in_bound_column, level_not_selected, n,
       round((diff - 2 * h) / CASE WHEN diff - 2 * h <= 0 THEN se0 ELSE se1 END, 5) AS precision_lo, round((diff + 2 * h) / CASE WHEN diff + 2 * h >= 0 THEN se0 ELSE se1 END, 5) AS precision_hi
FROM u
"""


@query(CLAIMS_SQL)
def reproduced_t_claims(spark: SparkSession, d: str) -> DataFrame:
    """The t-tests of fifty claims that share one read, with the interval that rounding leaves and the rows dropped."""
    claims = line_claims({})
    found = reproduced(spark, [(c, c.token("items")) for c in claims], "items", lambda: table(spark, d, "lineitem")).where("claim_id like 't%'")
    return found.select("claim_id", "variant", F.round("computed", 6).alias("computed"), "rows_read", "filtered_out", "missing_in_bound_column", "level_not_selected", "n", F.round("precision_lo", 5).alias("precision_lo"), F.round("precision_hi", 5).alias("precision_hi"))


@query("""
WITH f AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) * count(*) AS s FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1),
f1 AS (SELECT sum(n)::DOUBLE AS n, sum(n * (m - (SELECT sum(n * m) / sum(n) FROM f)) ** 2) AS b, sum(s) AS w FROM f),
e AS (SELECT l_linenumber AS g, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS s FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1),
f2 AS (SELECT sum(n)::DOUBLE AS n, sum(n * (m - (SELECT sum(n * m) / sum(n) FROM e)) ** 2) AS b, sum(s) AS w FROM e),
p AS (SELECT unnest(['p1', 'p2']) AS id), q AS (SELECT id, l_discount - l_tax AS x FROM lineitem, p WHERE id = 'p1' OR l_returnflag = 'N'),
r AS (SELECT count(*)::DOUBLE AS n, corr(l_quantity, l_extendedprice) AS r, var_pop(l_quantity) * count(*) AS sx, var_pop(l_extendedprice) * count(*) AS sy FROM lineitem),
k AS (SELECT *, CASE WHEN 0.5 * sqrt(n) < sqrt(sx) THEN asin(0.5 * sqrt(n) / sqrt(sx)) ELSE pi() * 1.5 END + asin(0.005 * sqrt(n) / sqrt(sy)) AS turn FROM r),
c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS o FROM lineitem GROUP BY ALL),
x AS (SELECT id, a, b, (SELECT coalesce(sum(o), 0) FROM c WHERE c.a = i.a AND c.b = j.b) AS o FROM (VALUES ('x1', 'A'), ('x1', 'N'), ('x1', 'R'), ('x2', 'A'), ('x2', 'R')) i(id, a), (VALUES ('F'), ('O')) j(b)),
y AS (SELECT *, sum(o) OVER (PARTITION BY id, a) * sum(o) OVER (PARTITION BY id, b) / sum(o) OVER (PARTITION BY id) AS ex, min(o) OVER () AS z FROM x),
z AS (SELECT id, sum((o - ex) ** 2 / nullif(ex, 0)) AS plain, sum((abs(o - ex) - least(0.5, abs(o - ex))) ** 2 / nullif(ex, 0)) AS yates, min(ex) = 0 AS empty FROM y GROUP BY id)
SELECT 'f1' AS claim_id, 'one_way' AS variant, round(b / w * (n - 3) / 2, 5) AS computed, round(greatest(sqrt(b) - 0.5 * sqrt(n), 0) ** 2 * (n - 3) / 2 / (sqrt(w) + 0.5 * sqrt(n)) ** 2, 5) AS precision_lo,
       round((sqrt(b) + 0.5 * sqrt(n)) ** 2 * (n - 3) / 2 / greatest(sqrt(w) - 0.5 * sqrt(n), 0) ** 2, 4) AS precision_hi, NULL AS reason FROM f1
UNION ALL SELECT 'f2', 'one_way', round(b / w * (n - 4) / 3, 5), round(b / w * (n - 4) / 3, 5), round(b / w * (n - 4) / 3, 4), NULL FROM f2
UNION ALL SELECT id, 'paired', round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 5), round((avg(x) - CASE WHEN id = 'p1' THEN 0.01 ELSE 0 END)
          / (CASE WHEN id = 'p2' THEN sqrt(var_pop(x) * count(*)) WHEN avg(x) - 0.01 <= 0 THEN sqrt(var_pop(x) * count(*)) - 0.01 * sqrt(count(*)) ELSE sqrt(var_pop(x) * count(*)) + 0.01 * sqrt(count(*)) END / sqrt(count(*) * (count(*) - 1.0))), 5),
          round((avg(x) + CASE WHEN id = 'p1' THEN 0.01 ELSE 0 END)
          / (CASE WHEN id = 'p2' THEN sqrt(var_pop(x) * count(*)) WHEN avg(x) + 0.01 >= 0 THEN sqrt(var_pop(x) * count(*)) - 0.01 * sqrt(count(*)) ELSE sqrt(var_pop(x) * count(*)) + 0.01 * sqrt(count(*)) END / sqrt(count(*) * (count(*) - 1.0))), 4), NULL FROM q GROUP BY id
UNION ALL SELECT 'r1', 'pearson', round(r, 5), round(cos(least(pi(), acos(r) + turn)), 5), round(cos(greatest(0, acos(r) - turn)), 4), NULL FROM k
UNION ALL SELECT id, 'uncorrected', CASE WHEN NOT empty THEN round(plain, 5) END, CASE WHEN NOT empty THEN round(plain, 5) END, CASE WHEN NOT empty THEN round(plain, 4) END, CASE WHEN empty THEN 'empty_row_or_column' END FROM z
UNION ALL SELECT id, 'yates', CASE WHEN NOT empty THEN round(yates, 5) END, CASE WHEN NOT empty THEN round(yates, 5) END, CASE WHEN NOT empty THEN round(yates, 4) END, CASE WHEN empty THEN 'empty_row_or_column' END FROM z WHERE id = 'x2'
UNION ALL SELECT 'm1', 'one_way', NULL, NULL, NULL, 'single_group'
""")
def reproduced_other_claims(spark: SparkSession, d: str) -> DataFrame:
    """The other claims of the same read: paired t, F, r and chi-square."""
    claims = line_claims({})
    found = reproduced(spark, [(c, c.token("items")) for c in claims], "items", lambda: table(spark, d, "lineitem")).where("claim_id not like 't%'")
    return found.select("claim_id", "variant", F.round("computed", 5).alias("computed"), F.round("precision_lo", 5).alias("precision_lo"), F.round("precision_hi", 4).alias("precision_hi"), F.when(F.col("computed").isNull(), F.col("reason")).alias("reason"))


VERDICT_SQL = """
WITH g AS (SELECT l_returnflag AS g, count(*)::DOUBLE AS n, avg(l_quantity) AS m, var_pop(l_quantity) * count(*) AS s FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1),
x AS (SELECT a.n AS n1, b.n AS n2, a.m - b.m AS diff, sqrt(a.s + b.s) AS root, sqrt((1 / a.n + 1 / b.n) / (a.n + b.n - 2)) AS k FROM g a, g b WHERE a.g = 'A' AND b.g = 'R'),
y AS (SELECT diff / (root * k) AS t, (diff - 1) / (CASE WHEN diff - 1 <= 0 THEN greatest(root - 0.5 * sqrt(n1 + n2), 0) ELSE root + 0.5 * sqrt(n1 + n2) END * k) AS lo,
             (diff + 1) / (CASE WHEN diff + 1 >= 0 THEN greatest(root - 0.5 * sqrt(n1 + n2), 0) ELSE root + 0.5 * sqrt(n1 + n2) END * k) AS hi FROM x)
SELECT 'as printed' AS claim_id, 'matched' AS status, NULL AS reason FROM y
UNION ALL SELECT 'moved', 'could_not_check', 'data_precision:0' FROM y WHERE t + 0.5 BETWEEN lo AND hi
UNION ALL SELECT 'far', 'not_matched', NULL FROM y WHERE hi < 1e6 AND lo > -1e6
UNION ALL SELECT 'exact', 'not_matched', NULL
UNION ALL SELECT 'stale', 'could_not_check', 'gate_stale'
UNION ALL SELECT 'column', 'could_not_check', 'unknown_column:no_such'
UNION ALL SELECT 'method', 'could_not_check', 'method_not_available'
UNION ALL SELECT 'words', 'could_not_check', 'printed_not_a_number'
"""


@query(VERDICT_SQL)
def claim_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """One statistic printed rightly, off by less and by more than rounding explains, and claims that are refused."""
    items, rounded = table(spark, d, "lineitem"), (("l_quantity", 0),)
    base = lambda key, printed, **more: Claim(key, 1, "independent_t", more.pop("columns", ("l_returnflag", "l_quantity")), printed, ("A", "R"), variant="student", **more)
    probe = base("probe", "0")
    t = reproduced(spark, [(probe, probe.token("f"))], "f", lambda: items).first().computed or 0.0
    claims = [base("as printed", f"{t:.2f}"), base("moved", f"{t + 0.5:.2f}", decimals=rounded), base("far", "9999999.0", decimals=rounded), base("exact", f"{t + 0.5:.2f}"), base("column", "1", columns=("l_returnflag", "no_such")), Claim("method", 1, "no such method", ("l_quantity",), "1"), base("words", "n.s.")]
    stale = base("stale", "1")
    found = reproduced(spark, [*((c, c.token("f")) for c in claims), (stale, stale.token("of other data"))], "f", lambda: items)
    return found.select("claim_id", "status", "reason")


# Intervals


@query("""
WITH b AS (SELECT p_partkey AS k, p_retailprice AS x, p_size AS n FROM part),
i AS (SELECT k, n, x - 0.005 AS a, x + 0.005 AS b, n - 25.0 AS c FROM b),
e AS (
  SELECT k, 'x * (n - 25) + 0.5' AS expression, least(a * c, b * c) + 0.45 AS lo, greatest(a * c, b * c) + 0.55 AS hi, NULL AS reason FROM i
  UNION ALL SELECT k, 'x / (n - 25)', CASE WHEN c <> 0 THEN least(a / c, b / c) END, CASE WHEN c <> 0 THEN greatest(a / c, b / c) END, CASE WHEN c = 0 THEN 'division_by_zero' END FROM i
  UNION ALL SELECT k, '(x - 1000)^2', least((a - 1000) ** 2, (b - 1000) ** 2, (a - 1000) * (b - 1000)), greatest((a - 1000) ** 2, (b - 1000) ** 2), NULL FROM i
  UNION ALL SELECT k, 'x - x', a - b, b - a, NULL FROM i
  UNION ALL SELECT k, 'n^2 - n', n * n - n, n * n - n, NULL FROM i
  UNION ALL SELECT k, '1 / (x - 1000)', CASE WHEN NOT (a <= 1000 AND b >= 1000) THEN 1 / (b - 1000) END, CASE WHEN NOT (a <= 1000 AND b >= 1000) THEN 1 / (a - 1000) END, CASE WHEN a <= 1000 AND b >= 1000 THEN 'division_by_zero' END FROM i
  UNION ALL SELECT k, 'sqrt(x)', NULL, NULL, 'irrational_root' FROM i
  UNION ALL SELECT k, 'x ^ 0.5', NULL, NULL, 'non_integer_exponent' FROM i
  UNION ALL SELECT k, 'x + y', NULL, NULL, 'unbound_variable' FROM i
  UNION ALL SELECT k, '(x', NULL, NULL, 'unreadable' FROM i)
SELECT k, expression, round(lo, 7) AS lo, round(hi, 7) AS hi, reason FROM e
""")
def interval_expressions(spark: SparkSession, d: str) -> DataFrame:
    """Expressions over printed prices (two places) and counts, for every part."""
    forms = ("x * (n - 25) + 0.5", "x / (n - 25)", "(x - 1000)^2", "x - x", "n^2 - n", "1 / (x - 1000)", "sqrt(x)", "x ^ 0.5", "x + y", "(x")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.create_map(F.lit("x"), F.format_string("%.2f", "p_retailprice"), F.lit("n"), F.col("p_size").cast("string")).alias("bound"), F.explode(F.array(*map(F.lit, forms))).alias("expression"))
    found = rows.select("k", "expression", intervals.evaluated(F.col("expression"), F.col("bound"), exact=("n",)).alias("i"))
    return found.select("k", "expression", *(F.round(F.col(f"i.{c}").cast("double"), 7).alias(c) for c in ("lo", "hi")), "i.reason")


# Shared passages

WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

SPANS_SQL = rf"""
WITH d AS (SELECT doc_id AS doc, {WORDS_SQL} AS w FROM documents), r AS (SELECT item_id AS ref, {WORDS_SQL} AS w FROM benchmark),
a AS (SELECT doc, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
b AS (SELECT ref, j, array_to_string(w[j:j+7], ' ') AS g FROM (SELECT ref, w, unnest(generate_series(1, len(w) - 7)) AS j FROM r WHERE len(w) >= 8)),
h AS (SELECT doc, ref, i, j, i - row_number() OVER (PARTITION BY doc, ref, i - j ORDER BY i) AS run FROM a JOIN b USING (g)),
s AS (SELECT doc, ref, min(i) - 1 AS start, max(i) + 7 AS "end", min(j) - 1 AS ref_start, max(j) + 7 AS ref_end FROM h GROUP BY doc, ref, i - j, run)
"""


def shared_with_benchmark(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return verbatim.shared_spans(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query(SPANS_SQL + 'SELECT doc, ref, start, "end", ref_start, ref_end, "end" - start AS words, array_to_string(d.w[start + 1:"end"], \' \') AS passage FROM s JOIN d USING (doc)')
def shared_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of eight words or more that documents share with benchmark items, with their words from the text."""
    spans = shared_with_benchmark(spark, d)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    cut = F.substr("text", (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int"))
    small = F.translate(F.regexp_replace(cut, r"[\x20\x09-\x0D]+", " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return spans.join(texts, "doc").select("doc", "ref", "start", "end", "ref_start", "ref_end", "words", small.alias("passage"))


@query(SPANS_SQL + """,
p AS (SELECT DISTINCT doc, unnest(generate_series(start, "end" - 1)) AS at FROM s)
SELECT doc, CAST(len(w) AS BIGINT) AS words, (SELECT count(*) FROM p WHERE p.doc = d.doc) AS covered, round(CASE WHEN len(w) > 0 THEN (SELECT count(*) FROM p WHERE p.doc = d.doc) / len(w) ELSE 0 END, 9) AS ratio FROM d
""")
def duplication_ratio(spark: SparkSession, d: str) -> DataFrame:
    totals = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), verbatim.word_count(F.col("text")).alias("words"))
    return verbatim.duplication(shared_with_benchmark(spark, d), totals).withColumn("ratio", F.round("ratio", 9))


@query(rf"""
WITH d AS (SELECT doc_id AS doc, {WORDS_SQL} AS w FROM documents),
a AS (SELECT doc, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
h AS (SELECT a.doc, a.i, b.i AS j, a.i - row_number() OVER (PARTITION BY a.doc, a.i - b.i ORDER BY a.i) AS run FROM a JOIN a b ON a.doc = b.doc AND a.g = b.g AND a.i < b.i)
SELECT doc, min(i) - 1 AS start, max(i) + 7 AS "end", min(j) - 1 AS again, max(i) - min(i) + 8 AS words FROM h GROUP BY doc, i - j, run
""")
def self_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Passages of eight words or more that a document repeats, by the places of both."""
    found = verbatim.shared_spans(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return found.select("doc", "start", "end", F.col("ref_start").alias("again"), "words")


# Search

SEARCH_SQL = r"""
WITH t AS (
  SELECT doc_id, lang, text, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$')))) AS tokens, list_transform(embedding, lambda x: x::DOUBLE) AS v
  FROM documents JOIN embeddings ON doc_id = vec_id),
q AS (
  SELECT doc_id AS qid, CASE WHEN doc_id % 40 = 0 THEN ['nosuchtoken'] ELSE
           list_transform(list_sort(list_transform(tokens, lambda w, i: {'n': -length(w), 'i': i, 'w': w}))[1:4], lambda x: x.w) END AS terms, v AS query FROM t WHERE doc_id % 20 = 0),
p AS (SELECT qid, doc_id AS cid, query, v, len(list_intersect(tokens, terms)) > 0 AS hit FROM q, t WHERE @where),
n AS (SELECT qid, count(*) FILTER (hit) >= 5 AS rich FROM p GROUP BY qid),
s AS (SELECT qid, cid, CASE WHEN len(query) = len(v) AND list_inner_product(query, query) > 0 AND list_inner_product(v, v) > 0
                            THEN list_inner_product(query, v) / (sqrt(list_inner_product(query, query)) * sqrt(list_inner_product(v, v))) ELSE 0 END AS score, CASE WHEN rich THEN 'lexical' ELSE 'all' END AS via
      FROM p JOIN n USING (qid) WHERE hit OR NOT rich)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, cid) AS rank, cid, round(score, 9) AS score, via FROM s QUALIFY rank <= 5
"""


def searched(spark: SparkSession, d: str, where: str | None) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    chunks = docs.select(F.col("doc_id").alias("cid"), "text", F.col("embedding").alias("vector"), "lang")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 40 == 0, "nosuchtoken").otherwise(F.col("text")).alias("text"), F.col("embedding").alias("vector"))
    found = vector.semantic_search(asked, chunks, 5, where=F.expr(where) if where else None)
    return found.withColumn("score", F.round("score", 9))


@query(SEARCH_SQL.replace("@where", "true"))
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents nearest to every twentieth one among those that share one of its four longest tokens; every fortieth
    has no such token and is compared with all."""
    return searched(spark, d, None)


@query(SEARCH_SQL.replace("@where", "lang = 'de'"))
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """The same among the documents of one language."""
    return searched(spark, d, "lang = 'de'")


# Citations


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^http:', 'https:') AS url, page_id % 8 AS kind FROM pages),
h AS (SELECT *, regexp_extract(url, '^https://([^/?#]*)', 1) AS host FROM p),
e AS (SELECT * FROM h)
SELECT page_id, CASE WHEN kind IN (0, 1) AND ok THEN 201 END AS start, CASE WHEN kind IN (0, 1) AND ok THEN 201 + length(url) END::INT AS "end",
       CASE WHEN NOT ok THEN NULL WHEN kind = 0 THEN 'code_points' WHEN kind = 1 THEN 'utf16' END AS unit,
       CASE WHEN kind = 5 THEN 'malformed' WHEN kind = 3 THEN 'not_https' WHEN kind = 4 THEN 'bad_host' WHEN NOT ok THEN 'domain_not_allowed'
            WHEN kind = 2 THEN 'range_does_not_name_source' WHEN kind = 6 THEN 'range_outside_text' WHEN kind = 7 THEN 'range_does_not_name_source' END AS reason
FROM (SELECT *, regexp_matches(host, '(^|\.)example\.(com|org|net)$') AS ok FROM e)
""")
def placed_citations(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of pages cited between signs of two units, by either unit, wrongly, and from hosts that are refused."""
    kind = F.col("page_id") % 8
    rows = table(spark, d, "pages").select("page_id", kind.alias("kind"), F.regexp_replace("url", "^http:", "https:").alias("url"))
    size = F.length("url")
    rows = rows.withColumn("text", F.concat(F.lit("😀" * 200 + " "), "url", F.lit(" and 🎉 more")))
    at = lambda *values: F.element_at(F.array(*(F.lit(v) if isinstance(v, int) else v for v in values)), (F.col("kind") + 1).cast("int"))
    cited = F.when(F.col("kind") == 3, F.regexp_replace("url", "^https:", "http:")).when(F.col("kind") == 4, F.regexp_replace("url", "^https://", "https://user@")).otherwise(F.col("url"))
    found = rows.select("page_id", places.placed(F.col("text"), cited, F.lit("no title here"), at(201, 401, 7, 201, 201, -1, 10000, 0), at(201 + size, 401 + size, 7, 201 + size, 201 + size, 3, 10001, 5), ("example.com", "example.org", "example.net")).alias("p"))
    return found.select("page_id", "p.*")


@query("""
WITH s AS (SELECT o_orderkey AS doc, i AS seq, i * 25 AS s0, i * 25 + 20 AS s1, CASE WHEN (o_orderkey + i) % 3 = 0 THEN '12 345, 678 - 901 23.' ELSE 'Words of a sentence. ' END AS text FROM orders, (SELECT unnest(generate_series(0, 5)) AS i)),
c AS (SELECT l_orderkey AS doc, l_linenumber AS cite, l_partkey % 130 AS a, l_partkey % 130 + 1 + l_suppkey % 30 AS e FROM lineitem),
j AS (SELECT c.doc, cite, a, e, count(s.seq) FILTER (a < s1 AND e > s0) AS covered, min(seq) FILTER (s0 <= e - 1 AND e - 1 < s1) AS inside, arg_max(seq, s1) FILTER (s1 <= a) AS before FROM c LEFT JOIN s ON c.doc = s.doc GROUP BY ALL),
o AS (SELECT *, CASE WHEN covered <= 2 THEN coalesce(inside, before) END AS seq FROM j),
y AS (SELECT s.doc, s.seq, any_value(text) AS text, list({'a': a - s0, 'b': e - s0}) AS spans FROM s JOIN j ON s.doc = j.doc AND covered <= 2 AND a >= s0 AND a < s1 AND s.seq > 0 GROUP BY ALL),
x AS (SELECT doc, seq, true AS linked FROM y WHERE len(list_filter(generate_series(0, length(text) - 1), lambda i: regexp_matches(text[i+1], '[A-Za-z]') AND NOT list_bool_or(list_transform(spans, lambda p: i >= p.a AND i < p.b)))) = 0)
SELECT o.doc, cite, CASE WHEN linked THEN o.seq - 1 ELSE o.seq END AS seq, CASE WHEN covered > 2 THEN 'wide' WHEN o.seq IS NULL THEN 'none' END AS reason FROM o LEFT JOIN x ON o.doc = x.doc AND o.seq = x.seq
""")
def citations_of_links(spark: SparkSession, d: str) -> DataFrame:
    """Citations among sentences of which every third is link text without a letter of its own."""
    at = F.col("l_partkey") % 130
    cites = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("cite"), at.alias("start"), (at + 1 + F.col("l_suppkey") % 30).alias("end"))
    sentences = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<bigint>")).alias("seq"))
    words = F.when((F.col("doc") + F.col("seq")) % 3 == 0, "12 345, 678 - 901 23.").otherwise("Words of a sentence. ")
    return locate.sentence_of_citation(cites, sentences.select("doc", "seq", (F.col("seq") * 25).alias("s0"), (F.col("seq") * 25 + 20).alias("s1"), words.alias("text")))


# Wording

#: Parts of sentences: what is said of a test, and what it comes to (t variant, continuity, one-tailed, adjusted).
FRAGMENTS = (
    ("Equal variances were not assumed", "welch", None, False, False), ("Assuming equal variances", "student", None, False, False), ("We used Welch's t-test rather than Student's t-test", "welch", None, False, False),
    ("A pooled t-test was used", "student", None, False, False), ("Without a pooled variance estimate", None, None, False, False), ("Without Yates' correction", None, "uncorrected", False, False),
    ("A continuity-corrected chi-square was run", None, "yates", False, False), ("No continuity correction was applied", None, None, False, False), ("One-tailed tests were used", None, None, True, False),
    ("We did not use one-tailed tests", None, None, False, False), ("A Bonferroni correction, as planned, was not applied", None, None, False, False), ("Results were similar with and without Bonferroni correction", None, None, False, True),
    ("Tukey's HSD followed a one-sided test", None, None, True, True), ("The students were pooled across sites", None, None, False, False),
)

TAILS = (("", "t", "independent_t,paired_t"), (" in a paired design", "t", "paired_t,independent_t"), (" by Spearman rank correlation", "r", "spearman,pearson"), (" in a regression", "f", "ols,one_way"), (" by analysis of variance", "f", "one_way,ols"))


def sql_text(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"


@query(f"""
WITH f AS (SELECT * FROM (VALUES {', '.join(f"({i}, {', '.join(map(sql_text, x[1:]))})" for i, x in enumerate(FRAGMENTS))}) AS f(i, t_variant, continuity, one_tailed, adjusted)),
g AS (SELECT * FROM (VALUES {', '.join(f"({i}, {sql_text(x[2])})" for i, x in enumerate(TAILS))}) AS g(j, methods))
SELECT doc_id, t_variant, continuity, one_tailed, adjusted, methods FROM documents JOIN f ON i = doc_id % {len(FRAGMENTS)} JOIN g ON j = doc_id % {len(TAILS)}
""")
def method_words(spark: SparkSession, d: str) -> DataFrame:
    """What a sentence on each document says of its test."""
    pick = lambda options, c: F.element_at(F.array(*(F.lit(x) for x in options)), (F.col(c) + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % len(FRAGMENTS)).alias("i"), (F.col("doc_id") % len(TAILS)).alias("j"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    sentence = F.concat(pick([x[0] for x in FRAGMENTS], "i"), pick([x[0] for x in TAILS], "j"), F.lit("; t("), F.col("n"), F.lit(") = 2.10, p = .040."))
    found = rows.select("doc_id", wording.sentence_methods(sentence, pick([x[1] for x in TAILS], "j")).alias("w"))
    return found.select("doc_id", "w.t_variant", "w.continuity", "w.one_tailed", "w.adjusted", F.array_join("w.methods", ",").alias("methods"))


# Style and places of passages

#: Word lists of the features query; both are parameters of the operator.
FUNCTION_WORDS, TEMPLATES = ("the", "of", "and", "in", "that", "de", "la", "der", "die", "le", "et"), ("on the", "in the", "de la", "of the")

@query(rf"""
WITH d AS (SELECT doc_id, text AS raw, lower(text) AS t, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*') AS w,
                  CASE WHEN doc_id % 3 = 0 THEN ['10.1234/abc', 'doi missing', 'none'] WHEN doc_id % 3 = 1 THEN []::VARCHAR[] END AS refs FROM documents),
l AS (SELECT *, list_filter(list_transform(string_split_regex(t, '[.!?]+'), lambda s: len(regexp_extract_all(s, '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*'))::DOUBLE), lambda n: n > 0) AS len,
             CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: w[i:i+2]) ELSE [] END AS g,
             len(regexp_extract_all(raw, '\[\d+(?:\s*[,–-]\s*\d+)*\]')) AS numbered, len(regexp_extract_all(raw, '\([^()]*?\b(?:1[89]|20)\d\d[a-z]?\)')) AS named,
             list_transform(['on the', 'in the', 'de la', 'of the'], lambda p: (length(t) - length(replace(t, p, ''))) // length(p)) AS hits FROM d)
SELECT doc_id, round(CASE WHEN len(len) > 1 THEN sqrt(list_sum(list_transform(len, lambda x: (x - list_avg(len)) ** 2)) / len(len)) / list_avg(len) END, 6) AS sentence_length_cv,
       round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains(['the', 'of', 'and', 'in', 'that', 'de', 'la', 'der', 'die', 'le', 'et'], x))) / len(w) END, 6) AS function_word_ratio,
       round(CASE WHEN len(w) > 0 THEN 100.0 * (length(raw) - length(replace(raw, '—', ''))) / len(w) END, 6) AS em_dash_per100,
       round(CASE WHEN len(g) > 0 THEN 1 - len(list_distinct(g)) / len(g) END, 6) AS ngram_repetition,
       round(CASE WHEN len(w) > 0 THEN CASE WHEN len(list_filter(hits, lambda h: h > 0)) >= 2 THEN 100.0 * list_sum(hits) / len(w) ELSE 0 END END, 6) AS template_density,
       round(CASE WHEN len(w) > 0 AND NOT (coalesce(len(refs), 0) > 0 AND numbered + named = 0) THEN 1000.0 * (numbered + named) / len(w) END, 6) AS citation_density,
       round(CASE WHEN numbered + named > 0 THEN greatest(numbered, named) / (numbered + named) END, 6) AS citation_style_consistency, CASE WHEN doc_id % 3 = 0 AND raw IS NOT NULL THEN 0.5::DOUBLE END AS doi_syntax_validity
FROM l
""")
def style_features(spark: SparkSession, d: str) -> DataFrame:
    """The features that SQL can express quickly: all but lexical diversity."""
    return document_features(spark, d).drop("mtld", "mtld_deviation")


@query()
def document_features(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("10.1234/abc"), F.lit("doi missing"), F.lit("none"))).when(F.col("doc_id") % 3 == 1, F.array().cast("array<string>")).alias("refs"))
    found = rows.select("doc_id", features.document_features(F.col("text"), F.col("refs"), FUNCTION_WORDS, TEMPLATES).alias("f"))
    return found.select("doc_id", *(F.round(F.col(f"f.{c}"), 6).alias(c) for c in features.RESULT.names))


@query("""
WITH RECURSIVE d AS (SELECT doc_id AS doc, text, length(text) // 2 AS half FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc, i AS section, CASE i WHEN 0 THEN left(text, half) WHEN 1 THEN substr(text, half + 1) ELSE text END AS text, CASE i WHEN 2 THEN 'other' ELSE 'body' END AS kind FROM d, (SELECT unnest([0, 1, 2]) AS i)),
p AS (SELECT doc, i AS idx, CASE i WHEN 5 THEN 'other' ELSE 'body' END AS kind, CASE i WHEN 4 THEN 'no such passage' ELSE substr(text, 1 + (i * 7 % 4) * 40, 12) END AS text, CASE WHEN i = 3 THEN 0 ELSE (i * 7 % 4) * 40 END AS start FROM d, (SELECT unnest(generate_series(0, 5)) AS i)),
t AS (SELECT p.doc, p.idx, s.section, s.text AS inside, p.text, p.kind, row_number() OVER (PARTITION BY p.doc, p.kind ORDER BY s.section, p.start, p.idx) AS step FROM p JOIN s ON p.doc = s.doc AND p.kind = s.kind),
r AS (
  SELECT doc, kind, 0 AS step, -1 AS section, 0 AS reached, []::BIGINT[] AS used, NULL::BIGINT AS idx, NULL::BIGINT AS place FROM (SELECT DISTINCT doc, kind FROM t)
  UNION ALL
  SELECT doc, kind, step, section, CASE WHEN hit THEN found + length(text) ELSE base END, CASE WHEN hit THEN list_append(used, idx) ELSE used END, CASE WHEN hit THEN idx END, CASE WHEN hit THEN found END
  FROM (SELECT *, NOT list_contains(used, idx) AND found >= 0 AS hit FROM (
    SELECT t.doc, t.kind, t.step, t.section, t.idx, t.text, r.used, CASE WHEN t.section = r.section THEN r.reached ELSE 0 END AS base,
           CASE WHEN strpos(substr(t.inside, CASE WHEN t.section = r.section THEN r.reached ELSE 0 END + 1), t.text) > 0 THEN CASE WHEN t.section = r.section THEN r.reached ELSE 0 END + strpos(substr(t.inside, CASE WHEN t.section = r.section THEN r.reached ELSE 0 END + 1), t.text) - 1 ELSE -1 END AS found
    FROM r JOIN t ON r.doc = t.doc AND r.kind = t.kind AND t.step = r.step + 1)))
SELECT p.doc, p.idx, p.kind, r.section::BIGINT AS section, r.place::INT AS place FROM p LEFT JOIN r ON p.doc = r.doc AND p.idx = r.idx
""")
def placed_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of each document in and out of order, repeated and absent, among two sections of a kind and one of another."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), "text", F.floor(F.length("text") / 2).cast("int").alias("half"))
    i = F.col("i")
    parts = docs.withColumn("i", F.explode(F.array(*map(F.lit, range(3)))))
    sections = parts.select("doc", i.alias("section"), F.when(i == 0, F.substr("text", F.lit(1), F.col("half"))).when(i == 1, F.substr("text", F.col("half") + 1)).otherwise(F.col("text")).alias("text"), F.when(i == 2, "other").otherwise("body").alias("kind"))
    at = (i * 7 % 4) * 40
    cut = docs.withColumn("i", F.explode(F.array(*map(F.lit, range(6)))))
    passages = cut.select("doc", i.cast("long").alias("idx"), F.when(i == 5, "other").otherwise("body").alias("kind"), F.when(i == 4, "no such passage").otherwise(F.substr("text", at + 1, F.lit(12))).alias("text"), F.when(i == 3, 0).otherwise(at).alias("start"))
    return locate.placed_passages(sections, passages)


# Requests


@query("""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, ts, strftime(ts, '%Y-%m') AS month, CASE event_type WHEN 'click' THEN 'open' WHEN 'view' THEN 'held' WHEN 'purchase' THEN 'done' END AS "to" FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id, month ORDER BY ts, event_id) AS nth, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM e),
r AS (
  SELECT user_id, 0::BIGINT AS step, NULL::BIGINT AS event_id, false AS granted, 0::BIGINT AS quota_remaining, false AS accepted, 'new' AS status FROM (SELECT DISTINCT user_id FROM g)
  UNION ALL
  SELECT user_id, step, event_id, granted, quota_remaining, ok, CASE WHEN ok THEN "to" ELSE status END
  FROM (SELECT g.user_id, g.step, g.event_id, nth <= 5 AS granted, greatest(5 - nth, 0) AS quota_remaining, r.status, "to",
               coalesce(nth <= 5 AND (r.status = 'new' AND "to" = 'open' OR r.status = 'open' AND "to" IN ('held', 'done') OR r.status = 'held' AND "to" = 'open'), false) AS ok
        FROM r JOIN g ON g.user_id = r.user_id AND g.step = r.step + 1))
SELECT CAST(user_id AS VARCHAR) AS key, event_id, granted, quota_remaining, accepted, status FROM r WHERE step > 0
""")
def request_gate(spark: SparkSession, d: str) -> DataFrame:
    """Quota and status of every user's events, with a bucket that is never empty."""
    events = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.when(F.col("event_type") == "click", "open").when(F.col("event_type") == "view", "held").when(F.col("event_type") == "purchase", "done").alias("to"))
    rules = gate.Rules(capacity=1e9, rate=1.0, limit=5, first="new", moves={"new": ("open",), "open": ("held", "done"), "held": ("open",)})
    return gate.decided(events, rules, int(spark.conf.get("spark.sql.shuffle.partitions"))).select("key", "event_id", "granted", "quota_remaining", "accepted", "status")


# Needles and vectors


@query()
def needle_hits(spark: SparkSession, d: str) -> DataFrame:
    """Where short pieces of benchmark items stand in documents, inside words too. SQL takes minutes for it."""
    needles = table(spark, d, "benchmark").select(F.col("item_id").alias("needle"), F.substr("text", F.lit(3), (F.col("item_id") % 5 + 4).cast("int")).alias("text"))
    found = locate.needle_hits(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), needles)
    return found.groupBy("id", "needle").agg(F.count("*").alias("hits"), F.min("at").alias("first"), F.max("at").alias("last"))


@query("""
SELECT vec_id + 1 AS id, CASE WHEN vec_id % 3 = 1 THEN round(-embedding[1]::DOUBLE, 6) WHEN vec_id % 4 = 0 THEN NULL ELSE round(embedding[1]::DOUBLE, 6) END AS first, NOT (vec_id % 3 <> 1 AND vec_id % 4 = 0) AS found FROM embeddings
""")
def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """Vectors put into a space of a store, some in place of others, and fetched by id."""
    k = F.col("vec_id")
    v = table(spark, d, "embeddings").select((k + 1).alias("id"), "vec_id", F.col("embedding").alias("vector"))
    store = v.where(k % 4 > 0).select("id", F.lit("a").alias("space"), "vector").unionByName(v.select("id", F.lit("b").alias("space"), F.slice("vector", 2, 3).alias("vector")))
    after = vector.stored(store, v.where(k % 3 == 1).select("id", F.transform("vector", lambda x: -x).alias("vector")), "a")
    found = vector.fetched(after, v, "a")
    return found.select("id", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"), "found")


@query("""
WITH c AS (SELECT label AS doc, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 4)
SELECT a.doc AS doc_a, b.doc AS doc_b, count(*) AS pairs, round(max(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v))), 9) AS best, round(avg(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v))), 9) AS mean
FROM c a JOIN c b ON a.doc < b.doc GROUP BY ALL
""")
def cross_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The first four vectors of each label against those of every other: a study of as many documents as there are labels."""
    found = vector.cross_similarity(table(spark, d, "embeddings").select(F.col("label").alias("doc"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vector")), 4)
    return found.select("doc_a", "doc_b", "pairs", F.round("best", 9).alias("best"), F.round("mean", 9).alias("mean"))
