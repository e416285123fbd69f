"""Registered queries over the driver's tables: one for each family of operators, with SQL for the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from plumbline.functions import biblio, checks, dist, numbers, text
from plumbline.operators import biblio as library, locate, relational as rel, stats, vector
from plumbline.plans.describe import Describe, described
from plumbline.registry import ORACLES, QUERIES, query, table
from plumbline.sources import records, tables
from plumbline.streaming import limits

__all__ = ["ORACLES", "QUERIES"]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places, so that two engines' sums agree."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# Descriptive and inferential statistics


@query("""
SELECT "column", statistic, CAST(NULL AS VARCHAR) AS level, round(value, 4) AS value FROM (
  SELECT c AS "column", unnest(['n','missing','mean','sd','min','q1','median','q3','max']) AS statistic,
         unnest([n, m, mean, sd, mn, q[1], q[2], q[3], mx]) AS value
  FROM (SELECT c, count(x)::DOUBLE AS n, count(*) FILTER (x IS NULL)::DOUBLE AS m, avg(x) AS mean, stddev_samp(x - s) AS sd,
               min(x) AS mn, quantile_cont(x, [0.25, 0.5, 0.75]) AS q, max(x) AS mx
        FROM (SELECT c, x, min(x) OVER (PARTITION BY c) AS s FROM (
                SELECT unnest(['l_quantity','l_extendedprice','l_discount']) AS c, unnest([l_quantity, l_extendedprice, l_discount]) AS x FROM lineitem))
        GROUP BY c))
UNION ALL
SELECT 'l_returnflag', 'count', l_returnflag, count(*)::DOUBLE FROM lineitem GROUP BY l_returnflag
""")
def describe_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return rounded(described(table(spark, d, "lineitem"), Describe(("l_quantity", "l_extendedprice", "l_discount"), ("l_returnflag",))), 4)


@query("""
SELECT 'C' || nth AS alias, header, kind, n, missing, n_distinct FROM (
  SELECT 1 AS nth, 'c_name' AS header, 'categorical' AS kind, count(c_name) AS n, count(*) - count(c_name) AS missing, count(DISTINCT c_name) AS n_distinct FROM customer
  UNION ALL SELECT 2, 'c_acctbal', 'numeric', count(c_acctbal), count(*) - count(c_acctbal), count(DISTINCT c_acctbal) FROM customer
  UNION ALL SELECT 3, 'c_mktsegment', 'categorical', count(c_mktsegment), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment) FROM customer)
""")
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return stats.profile(table(spark, d, "customer").select("c_name", "c_acctbal", "c_mktsegment"))


@query("""
SELECT CASE WHEN c_mktsegment IS NULL OR c_mktsegment = '' THEN 'missing_group' WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'other_level'
            WHEN c_acctbal IS NULL THEN 'missing_outcome' ELSE 'used' END AS reason, count(*) AS n
FROM customer GROUP BY 1
""")
def exclusion_cascade(spark: SparkSession, d: str) -> DataFrame:
    return stats.exclusion_counts(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", ("BUILDING", "MACHINERY"), (-99999.0,))


T_TEST_SQL = """
WITH g AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS m FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1),
v AS (SELECT g, any_value(n) AS n, any_value(m) AS m, sum((l_extendedprice - m) ** 2) / (any_value(n) - 1) AS v FROM lineitem JOIN g ON l_returnflag = g GROUP BY g),
x AS (SELECT a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.v AS v1, b.v AS v2 FROM v a, v b WHERE a.g = 'A' AND b.g = 'R'),
y AS (SELECT *, {se} AS se, {df} AS df, {unit} AS unit FROM x)
SELECT n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2, round(m1 - m2, 6) AS diff, round(se, 6) AS se, round((m1 - m2) / se, 6) AS t,
       round(df, 6) AS df, round((m1 - m2) / unit, 6) AS d, round(sqrt(greatest(v1, v2)) / sqrt(least(v1, v2)), 6) AS sd_ratio, CAST(NULL AS VARCHAR) AS reason
FROM y
"""
POOLED = "((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)"


@query(T_TEST_SQL.format(se=f"sqrt({POOLED} * (1.0 / n1 + 1.0 / n2))", df="(n1 + n2 - 2)::DOUBLE", unit=f"sqrt({POOLED})"))
def t_test_student(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.t_test(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", ("A", "R"), welch=False, inference=False))


@query(T_TEST_SQL.format(se="sqrt(v1 / n1 + v2 / n2)", df="(v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))", unit="sqrt((v1 + v2) / 2)"))
def t_test_welch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.t_test(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", ("A", "R"), welch=True, inference=False))


@query()
def t_test_inference(spark: SparkSession, d: str) -> DataFrame:
    return stats.t_test(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", ("BUILDING", "MACHINERY"), welch=True)


@query("""
WITH p AS (SELECT l_extendedprice * l_discount - l_extendedprice * l_tax AS d FROM lineitem)
SELECT count(*) AS n, round(avg(d), 6) AS mean_diff, round(stddev_samp(d), 6) AS sd_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, count(*) - 1 AS df FROM p
""")
def paired_t(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_extendedprice") * F.col("l_discount")).alias("a"), (F.col("l_extendedprice") * F.col("l_tax")).alias("b"))
    return rounded(stats.paired_t(rows, "a", "b", inference=False))


@query("""
WITH m AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1),
w AS (SELECT sum((o_totalprice - m) ** 2) AS ssw FROM orders JOIN m ON o_orderpriority = g),
b AS (SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS groups, sum(n * (m - gm) ** 2) AS ssb FROM m, (SELECT sum(n * m) / sum(n) AS gm FROM m))
SELECT n, groups, round(ssb, 0) AS ss_between, round(ssw, 0) AS ss_within, groups - 1 AS df1, n - groups AS df2,
       round((ssb / (groups - 1)) / (ssw / (n - groups)), 6) AS f FROM b, w
""")
def anova_one_way(spark: SparkSession, d: str) -> DataFrame:
    out = stats.anova(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", inference=False)
    return out.select("n", "groups", F.round("ss_between", 0).alias("ss_between"), F.round("ss_within", 0).alias("ss_within"), "df1", "df2", F.round("f", 6).alias("f"))


@query()
def inference_of_tests(spark: SparkSession, d: str) -> DataFrame:
    """p of each test, on the tables of the queries without it."""
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    tests = {
        "paired_t": stats.paired_t(items, "l_discount", "l_tax"), "anova": stats.anova(orders, "o_orderpriority", "o_totalprice"), "pearson": stats.correlation(items, "l_quantity", "l_extendedprice"),
        "spearman": stats.correlation(items, "l_quantity", "l_discount", ranks=True), "chi_square": stats.chi_square(items, "l_returnflag", "l_linestatus"),
    }
    return reduce(DataFrame.unionByName, (t.select(F.lit(name).alias("test"), "n", "p") for name, t in tests.items()))


@query("SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 9) AS r, count(*) - 2 AS df FROM lineitem")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", inference=False), 9)


@query("""
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
                  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT count(*) AS n, round(corr(a, b), 9) AS r, count(*) - 2 AS df FROM r
""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ranks=True, inference=False), 9)


@query("""
WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS o FROM lineitem GROUP BY ALL),
g AS (SELECT x.a, y.b, x.r, y.c, (SELECT sum(o) FROM c) AS n FROM (SELECT a, sum(o) AS r FROM c GROUP BY a) x, (SELECT b, sum(o) AS c FROM c GROUP BY b) y)
SELECT CAST(any_value(n) AS BIGINT) AS n, round(sum((coalesce(o, 0) - r * g.c / n) ** 2 / (r * g.c / n)), 4) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df FROM g LEFT JOIN c USING (a, b)
""")
def chi_square(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.chi_square(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", inference=False), 4)


@query("""
WITH o AS (SELECT count(*) FILTER (quality = 0 AND toxic = 0)::DOUBLE AS a, count(*) FILTER (quality = 0 AND toxic = 1)::DOUBLE AS b,
                  count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE AS c, count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS d FROM labels),
e AS (SELECT unnest([a, b, c, d]) AS o, unnest([(a+b)*(a+c), (a+b)*(b+d), (c+d)*(a+c), (c+d)*(b+d)]) / (a+b+c+d) AS e, a+b+c+d AS n FROM o)
SELECT CAST(any_value(n) AS BIGINT) AS n, round(sum((abs(o - e) - least(0.5, abs(o - e))) ** 2 / e), 6) AS chi2, 1 AS df FROM e
""")
def chi_square_yates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.chi_square_yates(table(spark, d, "labels"), "quality", "toxic", (0, 1), (0, 1), inference=False))


@query("""
WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n FROM lineitem)
SELECT unnest(['(intercept)', 'l_quantity']) AS term, round(unnest([a, b]), 4) AS coefficient, round(r2, 9) AS r2, round(r2 / (1 - r2) * (n - 2), 3) AS f, 1::BIGINT AS df1, n - 2 AS df2 FROM s
""")
def least_squares(spark: SparkSession, d: str) -> DataFrame:
    out = stats.least_squares(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return out.select("term", F.round("coefficient", 4).alias("coefficient"), F.round("r2", 9).alias("r2"), F.round("f", 3).alias("f"), "df1", "df2")


@query()
def least_squares_two(spark: SparkSession, d: str) -> DataFrame:
    return stats.least_squares(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


@query("""
SELECT g AS df, round(1 - 2 * atan(x) / pi(), 9) AS t_p, round(exp(-x / 2), 9) AS chi_p, round(1 / (1 + x), 9) AS f_p
FROM (SELECT 1 AS g, n_nationkey / 4.0 AS x FROM nation)
""")
def tail_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Closed forms: t with 1 df, chi-square with 2, F with (2, 2)."""
    rows = table(spark, d, "nation").select((F.col("n_nationkey") / 4.0).alias("x"))
    one, two = F.lit(1.0), F.lit(2.0)
    out = rows.select(F.lit(1).alias("df"), dist.t_two_tailed("x", one).alias("t_p"), dist.chi_square_upper("x", two).alias("chi_p"), dist.f_upper("x", two, two).alias("f_p"))
    return rounded(out, 9)


# Exact numbers and checks of what is reported


@query("""
SELECT l_returnflag AS level, count(*) AS n, (SELECT count(*) FROM lineitem) AS total,
       CASE WHEN 100.0 * count(*) / (SELECT count(*) FROM lineitem) BETWEEN round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 1) - 0.05 AND round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 1) + 0.05 THEN 'consistent' ELSE 'inconsistent' END AS printed_ok,
       'inconsistent' AS shifted
FROM lineitem GROUP BY 1
""")
def percent_matches_count(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    rows = li.groupBy(F.col("l_returnflag").alias("level")).agg(F.count("*").alias("n"))
    rows = rows.withColumn("total", F.sum("n").over(W.partitionBy()))  # one row for each level
    share = F.round(100.0 * F.col("n") / F.col("total"), 1)
    check = lambda p: numbers.percent_matches_count(F.col("n"), F.col("total"), F.format_string("%.1f", p))["verdict"]
    return rows.select("level", "n", "total", check(share).alias("printed_ok"), check(share + 1).alias("shifted"))


@query("""
SELECT p_size AS n, mean, CASE WHEN p_size >= 100 THEN 'could_not_check' WHEN ceil((mean - 0.005) * p_size) <= floor((mean + 0.005) * p_size) THEN 'consistent' ELSE 'inconsistent' END AS verdict
FROM (SELECT DISTINCT p_size, (1 + p_size % 7 + CAST(p_size * 13 % 100 AS DECIMAL(10,0)) / 100)::DECIMAL(10,2) AS mean FROM part)
""")
def grim(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    mean = (1 + size % 7 + (size * 13 % 100).cast("decimal(10,0)") / 100).cast("decimal(10,2)")
    rows = table(spark, d, "part").select("p_size").distinct().select(size.alias("n"), mean.alias("mean"))
    return rows.select("n", "mean", numbers.grim(F.col("mean").cast("string"), F.col("n"), F.lit(1), F.lit(True))["verdict"].alias("verdict"))


@query("""
SELECT family, n, df, CASE WHEN family <> 'r' THEN 'could_not_check' WHEN n - 2 = df THEN 'consistent' ELSE 'inconsistent' END AS verdict
FROM (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 't' ELSE 'r' END AS family, n_nationkey + 10 AS n, n_nationkey + 8 + n_nationkey % 2 AS df FROM nation)
""")
def df_matches_n(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(F.when(k % 3 == 0, "t").otherwise("r").alias("family"), (k + 10).alias("n"), (k + 8 + k % 2).alias("df"))
    return rows.select("family", "n", "df", numbers.df_matches_n(F.col("family"), F.col("n"), F.col("df").cast("string"), F.lit(False))["verdict"].alias("verdict"))


@query("""
SELECT k, CASE WHEN e BETWEEN -1.05 AND 2.05 THEN 'consistent' WHEN -e BETWEEN -1.05 AND 2.05 OR (e <> 0 AND 1 / e BETWEEN -1.05 AND 2.05) THEN 'concern' ELSE 'inconsistent' END AS verdict
FROM (SELECT n_nationkey AS k, n_nationkey - 12.0 AS e FROM nation)
""")
def estimate_in_interval(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    check = numbers.estimate_in_interval((k - 12).cast("string"), F.lit("-1.0"), F.lit("2.0"))
    return table(spark, d, "nation").select(k.alias("k"), check["verdict"].alias("verdict"))


@query("""
WITH v AS (SELECT n_nationkey AS k, (n_nationkey - 12) / 4.0 AS x, n_nationkey / 10.0 + 1 AS y FROM nation),
i AS (SELECT k, x - 0.005 AS a, x + 0.005 AS b, y - 0.05 AS c, y + 0.05 AS d FROM v)
SELECT k, round(a + c, 6) AS plus_lo, round(b - c, 6) AS minus_hi, round(least(a * c, a * d, b * c, b * d), 6) AS times_lo, round(greatest(a / c, a / d, b / c, b / d), 6) AS over_hi, a <= 0 AND b >= 0 AS zero FROM i
""")
def interval_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = numbers.measured(F.format_string("%.2f", (k - 12) / 4.0)), numbers.measured(F.format_string("%.1f", k / 10.0 + 1))
    rows = table(spark, d, "nation").select(k.alias("k"), x.alias("x"), y.alias("y"))
    x, y = F.col("x"), F.col("y")
    value = lambda c: F.round(c.cast("double"), 6)
    return rows.select("k", value(numbers.plus(x, y)["lo"]).alias("plus_lo"), value(numbers.minus(x, y)["hi"]).alias("minus_hi"), value(numbers.times(x, y)["lo"]).alias("times_lo"), value(numbers.over(x, y)["hi"]).alias("over_hi"), numbers.contains_zero(x).alias("zero"))


@query("SELECT o_orderkey, sha256(o_orderstatus || chr(10) || o_orderpriority) AS digest FROM orders")
def input_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", numbers.digest(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("digest"))


@query()
def printed_against_computed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"))
    return rows.select("o_orderpriority", *(numbers.printed_matches(F.format_string(p, F.col("mean") + s), F.col("mean")).alias(n) for n, p, s in (("exact", "%.2f", 0.0), ("whole", "%.0f", 0.0), ("off", "%.1f", 0.3))))


# Store queries


@query("SELECT o.o_orderkey, o.o_totalprice FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return rel.missing_from(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), returned, ["o_orderkey"])


@query("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE lang = 'en'")
def inner_join(spark: SparkSession, d: str) -> DataFrame:
    docs = rel.optional_filter(table(spark, d, "documents").select("doc_id", "lang"), {"lang": "en", "doc_id": None})
    return docs.join(table(spark, d, "labels"), "doc_id")


@query("SELECT DISTINCT c.* FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '1-URGENT'")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    return rel.of_ids(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT doc_id, rank, n_chars FROM documents JOIN (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20) USING (doc_id)")
def rank_refetch(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    top = docs.orderBy(F.desc("n_chars"), "doc_id").limit(20).withColumn("rank", F.row_number().over(W.orderBy(F.desc("n_chars"), "doc_id"))).select("doc_id", "rank")  # a report of 20
    return rel.in_rank_order(docs, "doc_id", top).select("doc_id", F.col("rank").cast("long").alias("rank"), "n_chars")


@query("SELECT lang, source, count(*) AS n, count(*) FILTER (n_chars < 500) AS short, count(*) FILTER (n_chars > 5000) AS long FROM documents GROUP BY ALL")
def tally(spark: SparkSession, d: str) -> DataFrame:
    return rel.tally(table(spark, d, "documents"), ["lang", "source"], short=F.col("n_chars") < 500, long=F.col("n_chars") > 5000)


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS r FROM conversations) WHERE r <= 2")
def newest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return rel.newest(table(spark, d, "conversations"), 2, "turn", "role", ["conv_id"]).drop("rank")


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def top_n(spark: SparkSession, d: str) -> DataFrame:
    return rel.newest(table(spark, d, "events").select("event_id", "ts", "user_id"), 25, "ts", "event_id")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def keep_latest(spark: SparkSession, d: str) -> DataFrame:
    return vector.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts"), ("user_id", "event_type"), "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit(0).alias("at"))
    new = old.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(1).alias("at"))
    return rel.upserted(old, new, ["c_custkey"], "at").select("c_custkey", "c_acctbal")


@query("SELECT event_id, user_id FROM events WHERE epoch(ts)::BIGINT + 86400 > (SELECT epoch(max(ts))::BIGINT FROM events) - 86400")
def ttl_fresh(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    rows = events.select("event_id", "user_id", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("created_at"), F.lit(86400).alias("ttl_seconds"))
    now = rows.agg(F.max("created_at")).first()[0] or 0
    return rel.fresh(rows, now - 86400).select("event_id", "user_id")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'removed' ELSE 'added' END AS change FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0 OR doc_id % 3 = 0 AND doc_id % 2 <> 0")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").select("doc_id")
    return rel.id_changes(ids.where("doc_id % 2 = 0"), ids.where("doc_id % 3 = 0"), "doc_id")


@query("""
SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall FROM (
  SELECT count(*) FILTER (n_chars > 1000 AND quality = 1) AS tp, count(*) FILTER (n_chars > 1000 AND quality <> 1) AS fp, count(*) FILTER (NOT n_chars > 1000 AND quality = 1) AS fn
  FROM documents JOIN labels USING (doc_id))
""")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return rounded(rel.precision_recall(rows, F.col("n_chars") > 1000, F.col("quality") == 1), 9)


@query("""
WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang),
n AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS hits FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT CAST(sum(size) AS BIGINT) AS population, CAST(sum(n) AS BIGINT) AS sampled, round(sum(size * hits / n) / sum(size), 9) AS share FROM s LEFT JOIN n USING (lang)
""")
def stratified_share(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return rounded(rel.stratified_share(docs, docs.join(table(spark, d, "labels"), "doc_id"), "lang", F.col("quality") == 1), 9)


@query("""
SELECT lang, count(*) AS n, list_sort(list(n_chars))[(floor((count(*) - 1) * 0.1) + 1)::BIGINT] AS p10, list_sort(list(n_chars))[(floor((count(*) - 1) * 0.5) + 1)::BIGINT] AS p50, list_sort(list(n_chars))[(floor((count(*) - 1) * 0.9) + 1)::BIGINT] AS p90
FROM documents GROUP BY lang
""")
def floor_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rel.floor_percentile(table(spark, d, "documents"), ["lang"], "n_chars", (0.1, 0.5, 0.9))


@query("""
SELECT source, count(*) AS n, list_sort(list(n_chars))[(floor((count(*) - 1) * 0.1 + 0.5) + 1)::BIGINT] AS p10, list_sort(list(n_chars))[(floor((count(*) - 1) * 0.9 + 0.5) + 1)::BIGINT] AS p90
FROM documents GROUP BY source
""")
def nearest_rank_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rel.floor_percentile(table(spark, d, "documents"), ["source"], "n_chars", (0.1, 0.9), nearest=True)


@query("""
WITH t AS (SELECT lang, n_chars >= 1000 AS long FROM documents)
SELECT lang, delta, CASE WHEN delta < -0.01 THEN 'ROLLBACK' WHEN delta > 0.01 THEN 'PROMOTE' ELSE 'HOLD' END AS verdict
FROM (SELECT lang, round(avg(long::INT) - (SELECT avg(long::INT) FROM t), 9) AS delta FROM t GROUP BY lang)
""")
def promotion_gate(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("lang", (F.col("n_chars") >= 1000).cast("int").alias("long"))
    overall = t.agg(F.avg("long").alias("overall"))
    rows = t.groupBy("lang").agg(F.avg("long").alias("share")).join(F.broadcast(overall)).select("lang", F.round(F.col("share") - F.col("overall"), 9).alias("delta"), F.lit(True).alias("deterministic"))  # one row
    return rel.gate(rows).select("lang", "delta", "verdict")


@query("""
SELECT user_id, event_type, event_id, nth, nth <= 2 AS granted FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('month', ts) ORDER BY ts, event_id) AS nth FROM events)
""")
def quota(spark: SparkSession, d: str) -> DataFrame:
    out = rel.quota_consumed(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", 2)
    return out.select("user_id", "event_type", "event_id", F.col("nth").cast("long").alias("nth"), "granted")


@query("""
WITH a AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'supported' ELSE 'refuted' END AS verdict, CASE WHEN s_suppkey % 7 = 0 THEN 'x' ELSE 'r1' END AS r FROM supplier)
SELECT id, CASE WHEN verdict IS NULL OR r = 'x' THEN 'unknown' ELSE verdict END AS verdict, CASE WHEN verdict IS NULL THEN 'missing_from_response' WHEN r = 'x' THEN 'potential_hallucination' END AS reason FROM a
""")
def verdict_gate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    ids = table(spark, d, "supplier").select(k.alias("id"))
    sent = ids.withColumn("evidence", F.array(F.lit("r1"), F.lit("r2")))
    said = ids.where("id % 5 <> 0").select("id", F.when(F.col("id") % 2 == 0, "supported").otherwise("refuted").alias("verdict"), F.lit(0.9).alias("confidence"), F.array(F.when(F.col("id") % 7 == 0, "x").otherwise("r1")).alias("refs"))
    return rel.gated_verdicts(sent, said).select("id", "verdict", "reason")


@query("SELECT id, ['c_acctbal'] AS changed FROM (SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 = 0)")
def protected_columns(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_acctbal")
    new = old.withColumn("c_acctbal", F.when(F.col("id") % 4 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return rel.changed_protected(old, new, "id", ["c_name", "c_acctbal"])


# Vectors and evidence


@query("""
SELECT vec_id, round(distance, 5) AS distance FROM (
  SELECT v.vec_id, sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) ** 2))) AS distance
  FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q) ORDER BY distance, vec_id LIMIT 10
""")
def knn(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return rounded(vector.knn_of_row(vectors, vectors.where("vec_id = 7"), 10, "vec_id", "embedding"), 5)


@query("""
SELECT a.vec_id, round(list_sum(list_transform(generate_series(1, 64), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def cosine_neighbours(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return rounded(pairs.select("vec_id", vector.cosine(F.col("embedding"), F.col("next")).alias("cosine")))


@query("""
SELECT lang, doc_id, n_chars FROM (
  SELECT *, max(CASE WHEN used > 20000 AND r > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY lang ORDER BY r) AS cut FROM (
    SELECT lang, doc_id, n_chars, row_number() OVER w AS r, sum(n_chars) OVER w AS used FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING))) WHERE cut = 0
""")
def evidence_budget(spark: SparkSession, d: str) -> DataFrame:
    return vector.within_budget(table(spark, d, "documents").select("lang", "doc_id", "n_chars"), 20000, "doc_id", "n_chars", ("lang",)).select("lang", "doc_id", "n_chars")


@query("""
SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS n FROM (
  SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS run FROM (SELECT DISTINCT user_id, (ts::DATE - DATE '1970-01-01')::BIGINT AS day FROM events)) GROUP BY user_id, run
""")
def islands(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").select("user_id", F.unix_date(F.col("ts").cast("date")).alias("day"))
    return vector.islands(days, ("user_id",), "day")


@query()
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    docs = vector.hash_embed(table(spark, d, "documents").select("doc_id", "text"), "text", dim=64)
    return docs.select("doc_id", vector.to_blob(F.col("vector")).alias("blob"))


@query("""
SELECT doc_id, count(*) AS chunks, CAST(sum(len(c)) AS BIGINT) AS words FROM (
  SELECT doc_id, w[i * 448 + 1 : i * 448 + 512] AS c FROM (
    SELECT doc_id, w, unnest(generate_series(0, CASE WHEN len(w) <= 512 THEN 0 ELSE ceil((len(w) - 512) / 448.0)::BIGINT END)) AS i
    FROM (SELECT doc_id, string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents))) GROUP BY doc_id
""")
def chunked(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.split(text.collapse(F.col("text")), " ").alias("w"))
    parts = docs.select("doc_id", F.explode(text.chunks(F.col("w"))).alias("c"))
    return parts.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.size("c")).alias("words"))


# Text


@query("""
WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), '')) AS ch FROM documents) GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN any_value(total) < 2 THEN 1.0 ELSE pow(2, -sum(n / total * log2(n / total))) END, 6) AS perplexity FROM c JOIN t USING (doc_id) GROUP BY doc_id
""")
def char_perplexity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("length(text) > 0")
    return rounded(docs.select("doc_id", text.char_perplexity(F.array_join(text.folded_chars(F.col("text")), "")).alias("perplexity")))


@query("""
WITH g AS (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN generate_series(1, len(w) - 4) ELSE [] END) AS i
           FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS w FROM documents)),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT item_id, w, unnest(CASE WHEN len(w) >= 5 THEN generate_series(1, len(w) - 4) ELSE [] END) AS i
      FROM (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS w FROM benchmark)),
r AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS g FROM b),
h AS (SELECT item_id, doc_id, count(*) AS hits FROM s JOIN r USING (g) GROUP BY ALL),
m AS (SELECT item_id, count(*) AS n FROM r GROUP BY item_id)
SELECT item_id AS id, arg_min(doc_id, (-hits, doc_id)) AS ref, round(max(hits / n), 6) AS score FROM h JOIN m USING (item_id) WHERE hits / n >= 0.5 GROUP BY item_id
""")
def containment(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), text.shingles(F.col("text")).alias("grams"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ref"), F.col("doc_id").alias("rank"), text.shingles(F.col("text")).alias("grams"))
    return rounded(locate.containment_matches(items, docs))


@query("""
WITH s AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: len(string_split_regex(x, '\\s+')) > 1), lambda x: len(string_split_regex(x, '\\s+'))::DOUBLE) AS l FROM documents),
c AS (SELECT doc_id, CASE WHEN len(l) < 2 THEN 1.0 ELSE sqrt(list_sum(list_transform(l, lambda x: (x - list_sum(l) / len(l)) ** 2)) / len(l)) / (list_sum(l) / len(l)) END AS cv FROM s)
SELECT doc_id, round(cv, 6) AS cv, CASE WHEN sc >= 0.7 THEN 'ai_generated' WHEN sc >= 0.4 THEN 'ai_assisted' ELSE 'human_written' END AS badge
FROM (SELECT doc_id, cv, 0.5 * CASE WHEN cv < 0.2 THEN 1.0 WHEN cv < 0.35 THEN 0.6 ELSE 0.15 END AS sc FROM c)
""")
def prose_badge(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", text.cliche_count(F.col("text")).alias("markers"), text.burstiness(F.col("text")).alias("cv"))
    return rounded(docs.select("doc_id", "cv", text.ai_badge(text.ai_score(F.col("markers"), F.col("cv"))).alias("badge")))


@query("""
SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+')))) AS tokens FROM documents
""")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each whole document."""
    return table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))


@query()
def clean_quotes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", text.clean_quote(text.fold_typography(F.col("text"), ligatures=True)).alias("q"))
    return rows.select("doc_id", F.length("q.text").alias("n"), "q.cut")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '</?i>', '*', 'gi'), '</?(?:b|strong)>', '**', 'gi'), '<[^>]+>', '', 'g'), '&amp;', '&', 'g'), '&lt;', '<', 'g'), '&gt;', '>', 'g'), '&#0?38;|&#x0?26;', '&', 'gi'), '&nbsp;|&#0?160;', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def markers_from_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.html_markers(F.col("html")).alias("text"))


@query()
def winnowed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", text.winnow_text(F.col("text"), 8, 4).alias("prints"))
    return rows.select("doc_id", F.size("prints").alias("n_prints"))


# Locating


@query("""
WITH p AS (SELECT conv_id AS doc, role AS needle, turn AS seq, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations),
h AS (SELECT conv_id AS doc, role AS needle, turn AS page, length(text) AS at, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, length(text)) AS k FROM conversations WHERE length(text) > 60)
SELECT p.doc, p.needle, p.seq, h.page, h.at, CASE WHEN h.page IS NULL THEN CASE WHEN (p.doc, p.needle) IN (SELECT (doc, needle) FROM h) THEN 'exhausted' ELSE 'absent' END END AS reason
FROM p LEFT JOIN h USING (doc, needle, k)
""")
def kth_occurrence(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("role").alias("needle"), "turn", F.length("text").cast("long").alias("at"))
    return locate.kth_occurrence(c.select("doc", "needle", F.col("turn").alias("seq")), c.where("at > 60").select("doc", "needle", F.col("turn").alias("page"), "at"))


@query("""
SELECT item_id, i AS at FROM (SELECT item_id, text, unnest(generate_series(0, length(text) - 2)) AS i FROM benchmark) WHERE substring(text, i + 1, 2) = 'th'
""")
def substring_hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.explode(F.transform(locate.hits(F.col("text"), F.lit("th")), lambda i: i.cast("long"))).alias("at"))


@query("""
WITH s AS (SELECT l_orderkey AS g, l_linenumber * 10 AS a, l_linenumber * 10 + (l_quantity % 20)::INT AS b FROM lineitem),
m AS (SELECT g, a, b, max(b) OVER (PARTITION BY g ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s),
i AS (SELECT g, a, b, sum(CASE WHEN a > coalesce(r, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM m)
SELECT g, min(a) AS start, max(b) AS "end" FROM i GROUP BY g, n
""")
def merged_spans(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("l_linenumber") * 10
    spans = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), at.alias("start"), (at + (F.col("l_quantity") % 20).cast("int")).alias("end"))
    return locate.merged_spans(spans, ("g",))


@query("""
WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS cite, l_partkey % 100 AS a, l_partkey % 100 + 5 + l_suppkey % 60 AS e FROM lineitem),
s AS (SELECT o_orderkey AS doc, i AS seq, i * 25 AS s0, i * 25 + 20 AS s1 FROM orders, (SELECT unnest(generate_series(0, 5)) AS i)),
j AS (SELECT c.doc, cite, a, e, count(*) FILTER (a < s1 AND e > s0) AS covered, min(seq) FILTER (e > s0 AND e <= s1) AS inside, arg_max(seq, s1) FILTER (s1 <= a) AS before FROM c LEFT JOIN s ON c.doc = s.doc GROUP BY ALL)
SELECT doc, cite, CASE WHEN covered > 2 THEN NULL ELSE coalesce(inside, before) END AS seq, CASE WHEN covered > 2 THEN 'wide' WHEN coalesce(inside, before) IS NULL THEN 'none' END AS reason FROM j
""")
def citation_sentences(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("l_partkey") % 100
    cites = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("cite"), at.alias("start"), (at + 5 + F.col("l_suppkey") % 60).alias("end"))
    sentences = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<bigint>")).alias("seq"))
    return locate.sentence_of_citation(cites, sentences.select("doc", "seq", (F.col("seq") * 25).alias("s0"), (F.col("seq") * 25 + 20).alias("s1")))


# Bibliographic records


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Citation records made of parts: id, seq and c."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    author = F.array(F.struct(F.split("p_name", " ").getItem(0).alias("family"), F.split("p_name", " ").getItem(1).alias("given")))
    c = records.citation(F.concat(F.col("p_name"), F.lit(", Part?")), author, (1990 + k % 30), F.col("p_brand"), volume=F.when(k % 2 == 0, F.col("p_size").cast("string")), page=F.when(k % 3 == 0, F.lit("1-9")), DOI=F.when(k % 5 != 0, F.concat(F.lit("https://doi.org/10.1/"), F.upper(F.lpad((k % 900).cast("string"), 4, "X")), F.lit("/"))))
    return p.select(k.alias("id"), k.alias("seq"), c.alias("c"))


CITATION_SQL = """
c AS (SELECT p_partkey AS id, p_name || ', Part?' AS title, 1990 + p_partkey % 30 AS year, CASE WHEN p_partkey % 5 <> 0 THEN 'https://doi.org/10.1/' || upper(lpad((p_partkey % 900)::VARCHAR, 4, 'X')) || '/' END AS doi FROM part),
k AS (SELECT id, nullif(trim(regexp_replace(regexp_replace(lower(trim(doi)), '^https?://(dx\\.)?doi\\.org/', ''), '/+$', '')), '') AS doi_key,
             trim(regexp_replace(regexp_replace(lower(title), '[^\\pL\\pN\\s]', ' ', 'g'), '\\s+', ' ', 'g')) || '::' || year AS title_key FROM c)
"""


@query("WITH " + CITATION_SQL + "SELECT id, doi_key, title_key FROM k")
def citation_keys(spark: SparkSession, d: str) -> DataFrame:
    return library.keyed(citations(spark, d)).select("id", "doi_key", "title_key")


@query("WITH " + CITATION_SQL + """,
d AS (SELECT doi_key, min(id) AS m FROM k WHERE id % 2 = 0 AND doi_key IS NOT NULL GROUP BY doi_key),
t AS (SELECT title_key, min(id) AS m FROM k WHERE id % 2 = 0 GROUP BY title_key)
SELECT id, CASE WHEN d.m IS NOT NULL THEN 'doi' WHEN t.m IS NOT NULL THEN 'title-year' END AS tier, coalesce(d.m, t.m) AS match
FROM k LEFT JOIN d USING (doi_key) LEFT JOIN t USING (title_key) WHERE id % 2 = 1
""")
def citation_duplicates(spark: SparkSession, d: str) -> DataFrame:
    c = citations(spark, d)
    return library.duplicates(c.where("id % 2 = 1"), c.where("id % 2 = 0")).select("id", "tier", "match")


@query()
def citation_import(spark: SparkSession, d: str) -> DataFrame:
    c = citations(spark, d)
    plan = library.import_plan(c.where("id % 2 = 1"), c.where("id % 2 = 0"))
    return plan.select("id", "action", "match", F.array_join("fills", ",").alias("fills"))


@query("""
SELECT p_partkey AS id, split_part(p_name, ' ', 1) || ', ' || upper(left(split_part(p_name, ' ', 2), 1)) || '. (' || (1990 + p_partkey % 30) || '). ' || p_name || ', Part?' || '. *' || p_brand || '*, '
       || CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE '' END || ', ' || CASE WHEN p_partkey % 3 = 0 THEN '1-9' ELSE '' END || '.'
       || CASE WHEN p_partkey % 5 <> 0 THEN ' https://doi.org/' || 'https://doi.org/10.1/' || upper(lpad((p_partkey % 900)::VARCHAR, 4, 'X')) || '/' ELSE '' END AS apa
FROM part
""")
def citation_apa(spark: SparkSession, d: str) -> DataFrame:
    return citations(spark, d).select("id", biblio.formatted(F.col("c"), "apa").alias("apa"))


@query()
def citation_styles(spark: SparkSession, d: str) -> DataFrame:
    styles = ("mla", "chicago-author-date", "vancouver", "harvard", "ieee", "nature", "ama")
    c = citations(spark, d)
    return c.select("id", *(biblio.formatted(F.col("c"), s).alias(s.replace("-", "_")) for s in styles), records.to_bibtex(F.concat(F.lit("k"), F.col("id").cast("string")), F.col("c")).alias("bibtex"), records.to_ris(F.col("c")).alias("ris"))


@query("SELECT p_partkey AS id, CASE WHEN n = 1 THEN p_brand ELSE p_brand || '-' || n END AS unique_key FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def unique_export_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("key"))
    return biblio.unique_keys(rows, "key", "id").select("id", "unique_key")


@query("""
SELECT s_suppkey AS id, CASE WHEN q = 'Q4' OR s_suppkey % 4 = 0 OR q NOT IN ('Q1', 'Q2') THEN 'amber' ELSE 'green' END AS level
FROM (SELECT *, 'Q' || (1 + s_suppkey % 4) AS q FROM supplier)
""")
def journal_signals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    q = biblio.quartile(F.concat(F.lit("SJR Q"), (1 + k % 4).cast("string")))
    number = biblio.issn(F.when(k % 4 != 0, F.concat(F.lit("ISSN: 1234-"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("x"))))
    risk = biblio.risk(F.lit(True), q.isin("Q1", "Q2"), F.array().cast("array<string>"), number, q)
    return table(spark, d, "supplier").select(k.alias("id"), risk["level"].alias("level"))


@query("""
SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).where("k is not null")


@query("""
SELECT item_id, string_agg(w, ' ' ORDER BY i) AS abstract FROM (
  SELECT item_id, unnest(w) AS w, unnest(generate_series(1, len(w))) AS i FROM (SELECT item_id, string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM benchmark)) GROUP BY item_id
""")
def inverted_abstract(spark: SparkSession, d: str) -> DataFrame:
    """Texts turned into an inverted index and put together again."""
    words = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split(text.collapse(F.col("text")), " ")).alias("p", "w"))
    places = words.groupBy("item_id", "w").agg(F.collect_list(F.col("p").cast("long")).alias("ps"))
    index = places.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("item_id", records.abstract(F.col("index")).alias("abstract"))


# Guards


@query("""
SELECT page_id, CASE WHEN length(url) > 2048 THEN 'too_long' WHEN NOT regexp_matches(url, '^(http|https|mailto):') THEN 'scheme' END AS refused,
       starts_with(url, 'https://') AND regexp_matches(url, '^https://([^/?#]*\\.)?example\\.com([/?#:]|$)') AS allowed
FROM pages
""")
def link_guards(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", checks.external_link(url).alias("refused"), checks.allowed_host(url, ["example.com"]).alias("allowed"))


@query("""
SELECT conv_id, CASE WHEN sum(length(text)) > 8000 THEN 'payload_too_large' WHEN max(length(text)) > 2000 THEN 'field_too_long'
       WHEN bool_or(len(regexp_extract_all(text, '[.!?]+(?:\\s|$)')) > 8 AND length(text) > 400) THEN 'free_text' END AS refused
FROM conversations GROUP BY conv_id
""")
def payload_guard(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("fields"))
    return fields.select("conv_id", checks.structured_payload(F.col("fields")).alias("refused"))


@query("SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'dimension' END AS refused FROM embeddings")
def vector_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", checks.vector_ok(F.col("embedding"), 64).alias("refused"))


# Streams and files


@query()
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return limits.token_bucket(events.select("key", "event_id", (F.col("us") / 1e6).alias("ts")), 5.0, 1 / 3600, int(spark.conf.get("spark.sql.shuffle.partitions")))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    out = limits.windowed_counts(table(spark, d, "events"), "ts", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query()
def summary_csv(spark: SparkSession, d: str) -> DataFrame:
    summary = stats.numeric_summary(table(spark, d, "orders"), ["o_totalprice"]).withColumn("alias", F.lit("C1"))
    return tables.summary_lines(summary).select("line")


@query("""
SELECT doc_id, 'info' AS severity, 'statistic' AS category, lang AS message FROM documents
UNION ALL SELECT doc_id, 'warning', 'reference', source FROM documents WHERE doc_id % 2 = 0
""")
def extraction_findings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.array("lang").alias("statistics"), F.array(F.struct(F.col("source").alias("text"), F.when(F.col("doc_id") % 2 == 1, F.lit("10.1/x")).alias("doi"))).alias("refs"))
    return tables.extraction_rows(docs)[1]

from plumbline import queries_claims, queries_records, queries_reports  # noqa: E402, F401  (they register their queries)
