"""Registered queries on reports: totals, shares, funnels, lookups, findings, bindings, tokens and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions import numbers, reported
from plumbline.operators import biblio as library, bindings, relational as rel, reports, stats
from plumbline.registry import query, table
from plumbline.sources import tables


@query("SELECT lang, count(*) AS n, count(*) FILTER (n_chars < 500) AS short, grouping(lang) = 1 AS is_total FROM documents GROUP BY ROLLUP (lang)")
def grand_totals(spark: SparkSession, d: str) -> DataFrame:
    return reports.with_grand_total(table(spark, d, "documents"), "lang", short=F.col("n_chars") < 500)


@query("""
WITH f AS (SELECT o_custkey % 400 AS batch, CASE WHEN o_orderkey % 5 = 0 THEN 'rejected' WHEN o_orderkey % 3 = 0 THEN 'stored' ELSE 'parsed' END AS outcome, o_orderkey % 7 AS c, o_orderkey % 2 AS s FROM orders),
g AS (SELECT batch, count(*) AS n, count(*) FILTER (outcome = 'parsed') AS parsed, count(*) FILTER (outcome = 'stored') AS stored, count(*) FILTER (outcome = 'rejected') AS rejected,
             CAST(coalesce(sum(c) FILTER (outcome = 'parsed'), 0) AS BIGINT) AS commands, CAST(coalesce(sum(s) FILTER (outcome = 'parsed'), 0) AS BIGINT) AS statistical FROM f GROUP BY batch)
SELECT batch, parsed, stored, rejected, commands, statistical, n || CASE WHEN n = 1 THEN ' file: ' ELSE ' files: ' END || concat_ws(', ',
       CASE WHEN parsed > 0 THEN parsed || ' parsed (' || commands || ' commands, ' || statistical || ' statistical)' END, CASE WHEN stored > 0 THEN stored || ' stored and not parsed' END, CASE WHEN rejected > 0 THEN rejected || ' could not be read' END) || '.' AS summary FROM g
""")
def ingest_totals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    outcome = F.when(k % 5 == 0, "rejected").when(k % 3 == 0, "stored").otherwise("parsed")
    files = table(spark, d, "orders").select((F.col("o_custkey") % 400).alias("batch"), outcome.alias("outcome"), F.when(outcome == "parsed", k % 7).alias("commands"), F.when(outcome == "parsed", k % 2).alias("statistical"))
    return reports.ingest_summary(files, ["batch"])


@query("SELECT lang, CAST(round(100.0 * count(*) / (SELECT count(*) FROM documents)) AS BIGINT) AS percent FROM documents GROUP BY lang")
def population_shares(spark: SparkSession, d: str) -> DataFrame:
    return reports.population_shares(table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")), "lang", "n")


@query("SELECT source, count(n_chars) AS n, list_sort(list(n_chars))[count(n_chars) // 2 + 1] AS median FROM documents WHERE n_chars IS NOT NULL GROUP BY source")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return reports.upper_median(table(spark, d, "documents"), ["source"], "n_chars")


@query("SELECT source, round(sum(CASE WHEN quality = 0 THEN n_chars ELSE 0 END) / nullif(sum(n_chars), 0), 9) AS proportion FROM documents JOIN labels USING (doc_id) GROUP BY source")
def signal_proportion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return reports.share_of_sums(rows, ["source"], F.when(F.col("quality") == 0, F.col("n_chars")).otherwise(0), F.col("n_chars")).withColumn("proportion", F.round("proportion", 9))


@query("""
WITH e AS (SELECT user_id, event_id, ['fetched', 'abstractOnly', 'paywalled', 'noOaCopy', 'rateLimited', 'elsewhere'][event_id % 6 + 1] AS outcome FROM events),
c AS (SELECT user_id, outcome, count(*) AS n, min(event_id) AS first FROM e GROUP BY ALL),
t AS (SELECT *, CASE outcome WHEN 'abstractOnly' THEN 'abstract only' WHEN 'noOaCopy' THEN 'no OA copy' WHEN 'rateLimited' THEN 'rate-limited' ELSE outcome END AS label FROM c)
SELECT user_id, sum(n)::BIGINT || ' source' || CASE WHEN sum(n) = 1 THEN ': ' ELSE 's: ' END || string_agg(n || ' ' || label, ', ' ORDER BY first) || '.' AS summary FROM t GROUP BY user_id
""")
def outcome_tally(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("fetched", "abstractOnly", "paywalled", "noOaCopy", "rateLimited", "elsewhere")))
    events = table(spark, d, "events").select("user_id", "event_id", F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("outcome"))
    return reports.outcome_tally(events, ["user_id"], "outcome", "event_id")


@query("""
WITH s AS (SELECT l_orderkey AS k, l_discount * 10 AS similarity FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey AS k, coalesce(max(similarity), 0) AS peak, CASE WHEN coalesce(max(similarity), 0) >= 0.85 THEN 'concern' ELSE 'pass' END AS verdict, count(*) FILTER (similarity >= 0.85) AS major, count(*) FILTER (similarity < 0.85) AS minor, CASE WHEN count(similarity) = 0 THEN 1 ELSE 0 END::BIGINT AS info
FROM orders LEFT JOIN s ON o_orderkey = k GROUP BY o_orderkey
""")
def peak_verdicts(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), (F.col("l_discount") * 10).alias("similarity"))
    return reports.peak_verdicts(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), spans, "k", "similarity", 0.85)


@query("""
SELECT source, count(*) AS n, CASE WHEN count(*) >= 60 THEN 'INFERRED' ELSE 'UNAVAILABLE' END AS status, round(CASE WHEN count(*) >= 60 THEN quantile_cont(n_chars, 0.5) END, 6) AS median,
       round(CASE WHEN count(*) >= 60 THEN quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25) END, 6) AS iqr FROM documents WHERE n_chars IS NOT NULL GROUP BY source
""")
def journal_conventions(spark: SparkSession, d: str) -> DataFrame:
    found = reports.conventions(table(spark, d, "documents"), ["source"], "n_chars", 60)
    return found.select("source", "n", "status", F.round("median", 6).alias("median"), F.round("iqr", 6).alias("iqr"))


@query("SELECT user_id, round(coalesce(avg(CASE WHEN event_type = 'click' THEN value END), 0), 9) AS mean_bits, round(2 ** coalesce(avg(CASE WHEN event_type = 'click' THEN value / 10 END), 0), 6) AS perplexity FROM events GROUP BY user_id")
def mean_surprisal(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "click", F.col("value")).alias("bits"), F.when(F.col("event_type") == "click", F.col("value") / 10).alias("tenth"))
    raw = reports.perplexity_of_bits(events, ["user_id"], "bits").select("user_id", F.round("mean_bits", 9).alias("mean_bits"))
    return raw.join(reports.perplexity_of_bits(events, ["user_id"], "tenth").select("user_id", F.round("perplexity", 6).alias("perplexity")), "user_id")


@query("""
WITH s AS (SELECT count(*) AS n, count(*) FILTER (a) AS a, count(*) FILTER (a AND b) AS b, count(*) FILTER (a AND b AND c) AS c FROM (SELECT coalesce(n_chars > 200, false) AS a, coalesce(lang = 'en', false) AS b, coalesce(source IS NOT NULL AND doc_id % 2 = 0, false) AS c FROM documents))
SELECT unnest(['long', 'english', 'even']) AS stage, unnest([1, 2, 3])::BIGINT AS nth, unnest([a, b, c]) AS reached, unnest([n - a, a - b, b - c]) AS lost FROM s
""")
def document_funnel(spark: SparkSession, d: str) -> DataFrame:
    return reports.funnel(table(spark, d, "documents"), [("long", F.col("n_chars") > 200), ("english", F.col("lang") == "en"), ("even", F.col("source").isNotNull() & (F.col("doc_id") % 2 == 0))])


@query("""
SELECT user_id, array_to_string(list(event_type ORDER BY first), ',') AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events WHERE event_type <> 'error' GROUP BY ALL) GROUP BY user_id
""")
def kinds_in_order(spark: SparkSession, d: str) -> DataFrame:
    found = reports.kinds_in_order(table(spark, d, "events"), ["user_id"], "event_type", "event_id", F.col("event_type") != "error")
    return found.select("user_id", F.array_join("kinds", ",").alias("kinds"))


COMMON_SQL = """
WITH t AS (SELECT doc_id, quality = 1 AS pos FROM labels), a AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unsure' WHEN n_chars > 1000 THEN 'yes' ELSE 'no' END AS x, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END AS y FROM documents),
c AS (SELECT x = 'yes' AS x, y = 'yes' AS y, pos FROM a JOIN t USING (doc_id) WHERE x IN ('yes', 'no') AND y IN ('yes', 'no')),
r AS (SELECT 'new' AS run, x AS said, pos FROM c UNION ALL SELECT 'old', y, pos FROM c)
SELECT run, count(*) AS n, count(*) FILTER (said AND pos) AS tp, count(*) FILTER (said AND NOT pos) AS fp, count(*) FILTER (NOT said AND pos) AS fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall FROM r GROUP BY run
"""


@query(COMMON_SQL)
def compared_on_common(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    new = docs.select("doc_id", F.when(k % 7 == 0, "unsure").when(F.col("n_chars") > 1000, "yes").otherwise("no").alias("answer"))
    old = docs.select("doc_id", F.when(k % 5 == 0, None).when(k % 2 == 0, "yes").otherwise("no").alias("answer"))
    found = reports.compared_on_common(new, old, table(spark, d, "labels"), "doc_id", "answer", F.col("quality") == 1)
    return found.select("run", "n", "tp", "fp", "fn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("""
WITH p AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS a, list_transform(CASE WHEN a.vec_id % 3 = 0 THEN b.embedding[1:10] WHEN a.vec_id % 50 = 1 THEN [] ELSE b.embedding END, lambda x: x::DOUBLE) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
g AS (SELECT vec_id, list_transform(generate_series(1, least(len(a), len(b))), lambda i: abs(a[i] - b[i])) AS g FROM p)
SELECT vec_id, len(g) AS n, round(CASE WHEN len(g) > 0 THEN list_sum(g) / len(g) END, 9) AS mean_abs, round(list_max(g), 9) AS max_abs FROM g
""")
def zip_delta(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    cut = F.when(F.col("vec_id") % 3 == 0, F.slice("b", 1, 10)).when(F.col("vec_id") % 50 == 1, F.array().cast("array<double>")).otherwise(F.col("b"))
    found = v.join(b, "vec_id").select("vec_id", reports.zip_delta(F.col("a"), cut).alias("z"))
    return found.select("vec_id", "z.n", F.round("z.mean_abs", 9).alias("mean_abs"), F.round("z.max_abs", 9).alias("max_abs"))


@query("""
WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'premium' ELSE 'free' END AS tier, CASE WHEN c_custkey % 5 = 0 THEN 'cancelled' ELSE 'active' END AS status, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 100 END AS ends FROM customer WHERE c_custkey % 4 < 3)
SELECT c_custkey, CASE WHEN tier = 'premium' AND status = 'active' AND (ends IS NULL OR ends > 50) THEN 'premium' ELSE 'free' END AS tier FROM customer LEFT JOIN s USING (c_custkey)
""")
def effective_tier(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    users = table(spark, d, "customer").select("c_custkey")
    held = users.where(k % 4 < 3).select("c_custkey", F.when(k % 2 == 0, "premium").otherwise("free").alias("tier"), F.when(k % 5 == 0, "cancelled").otherwise("active").alias("status"), F.when(k % 3 > 0, k % 100).alias("period_end"))
    return reports.effective_tier(users, held, "c_custkey", F.lit(50))


@query("SELECT event_type, user_id, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id)::INT AS rank FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)")
def ranked_by_count(spark: SparkSession, d: str) -> DataFrame:
    return reports.ranked_by_count(table(spark, d, "events"), "user_id", ["event_type"])


@query("SELECT source, doc_id, n_chars, r::INT AS rank FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS r FROM documents) WHERE r <= 2")
def longest_two(spark: SparkSession, d: str) -> DataFrame:
    return reports.longest(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], "n_chars", "doc_id")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def answered_in_both(spark: SparkSession, d: str) -> DataFrame:
    return reports.in_both(table(spark, d, "documents"), table(spark, d, "labels").where("quality = 1"), "doc_id")


@query(r"""
WITH j AS (SELECT p_partkey AS id, p_name AS name, printf('%04d-%03d%s', p_partkey % 10000, p_size, CASE WHEN p_partkey % 11 = 0 THEN 'X' ELSE '1' END) AS issn, 'https://www.' || replace(p_name, ' ', '-') || '.example.org/j' AS site FROM part),
q AS (SELECT id AS qid, CASE id % 5 WHEN 0 THEN upper(name) WHEN 1 THEN ' issn ' || replace(issn, '-', '') WHEN 2 THEN 'http://' || replace(name, ' ', '-') || '.example.org/x' WHEN 3 THEN split_part(name, ' ', 1) ELSE 'no such name' END AS q, id % 5 AS kind, name, issn FROM j WHERE id < 40),
f AS (
  SELECT qid, j.id, kind FROM q JOIN j ON CASE kind WHEN 0 THEN lower(j.name) = lower(q.name) WHEN 1 THEN j.issn = q.issn WHEN 2 THEN contains(lower(j.site), replace(lower(q.name), ' ', '-') || '.example.org') WHEN 3 THEN contains(lower(j.name), lower(q.q)) ELSE false END)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY id) AS nth, id AS journal FROM f QUALIFY kind <> 3 OR nth <= 10
""")
def journal_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Forty queries of every way against all parts as journals."""
    issn = F.format_string("%04d-%03d%s", F.col("p_partkey") % 10000, F.col("p_size"), F.when(F.col("p_partkey") % 11 == 0, "X").otherwise("1"))
    host = F.replace("p_name", F.lit(" "), F.lit("-"))
    journals = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), issn.alias("issn"), F.concat(F.lit("https://www."), host, F.lit(".example.org/j")).alias("website"))
    k = F.col("id") % 5
    text = F.when(k == 0, F.upper("name")).when(k == 1, F.concat(F.lit(" issn "), F.replace("issn", F.lit("-"), F.lit("")))).when(k == 2, F.concat(F.lit("http://"), F.replace("name", F.lit(" "), F.lit("-")), F.lit(".example.org/x"))).when(k == 3, F.split_part("name", F.lit(" "), F.lit(1))).otherwise("no such name")
    return reports.journal_lookup(journals, journals.where("id < 40").select(F.col("id").alias("qid"), text.alias("q")))


@query("""
WITH n AS (SELECT conv_id, turn, role, text, ['t' || conv_id % 3, role] AS tags FROM conversations)
SELECT conv_id, turn FROM n WHERE (contains(lower(text), 'an') OR contains(lower(role), 'an') OR len(list_filter(tags, lambda t: contains(lower(t), 'an'))) > 0) AND list_contains(tags, 't1') AND role = 'assistant'
""")
def note_search(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("title"), F.lit("").alias("body"), F.lit(None).cast("string").alias("fields_json"), F.col("role").alias("paper_title"), F.array(F.concat(F.lit("t"), (F.col("conv_id") % 3).cast("string")), F.col("role")).alias("tags"), F.col("role").alias("note_type"), F.lit("p").alias("paper_id"), F.col("turn").alias("updated_at"))
    return reports.notes_found(notes, " AN ", "t1", "assistant", "p").select("conv_id", "turn")


@query("""
SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'half' END AS value FROM events
""")
def subcommand_values(spark: SparkSession, d: str) -> DataFrame:
    """The value of a subcommand by name in any case; the first of two counts."""
    one = lambda n, v: F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"))
    subs = F.when(F.col("event_id") % 4 == 0, F.array(one("STATISTICS", "x"), one("Print", "full"), one("PRINT", "none"))).when(F.col("event_id") % 4 == 1, F.array(one("print", "half"))).otherwise(F.array(one("OTHER", "y")))
    return table(spark, d, "events").select("user_id", "event_id", reports.subcommand(subs, "PRINT").alias("value"))


@query("""
SELECT event_id, ['planned', 'deprecated', 'experimental', 'beta', 'stable'][event_id % 5 + 1] AS lifecycle, CASE event_id % 5 WHEN 2 THEN event_id % 2 = 0 WHEN 3 THEN true WHEN 4 THEN true ELSE false END AS runs,
       CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'confirmed' WHEN event_id % 3 > 0 AND event_id % 2 > 0 THEN 'detected' ELSE 'requires_author_confirmation' END AS agreement FROM events
""")
def lifecycle_and_agreement(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ("planned", "deprecated", "experimental", "beta", "stable"))), (k % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", state.alias("lifecycle"), reports.runnable(state, F.when(k % 2 == 0, "devtools").otherwise("release")).alias("runs"), reports.agreement(k % 3 == 0, k % 2 == 0).alias("agreement"))


@query("""
WITH c AS (SELECT o_orderkey AS claim, o_orderkey % 3 = 0 AS w, o_orderkey % 2 = 0 AS r, o_orderstatus AS st, o_orderpriority AS line FROM orders)
SELECT claim, CASE WHEN NOT w AND NOT r THEN 'detected' ELSE 'requires_author_confirmation' END AS status, CASE WHEN NOT w AND NOT r THEN 'major' ELSE 'minor' END AS severity,
       'Arithmetic ' || CASE WHEN NOT w AND NOT r THEN 'detected' ELSE 'requires author confirmation' END || ': ' || CASE WHEN length(line) > 8 THEN left(line, 8) || '…' ELSE line END AS title,
       'sides differ' || chr(10) || chr(10) || 'Left:  a = ' || st || chr(10) || 'Right: b' || CASE WHEN claim % 5 = 0 THEN chr(10) || chr(10) || 'To check this by hand:' || chr(10) || '  - first' || chr(10) || '  - then' ELSE '' END AS detail,
       'signal:equation-arithmetic,epistemic:' || CASE WHEN NOT w AND NOT r THEN 'detected' ELSE 'requires_author_confirmation' END || ',claim-index:' || claim || ',reading:as_written=' || CASE WHEN w THEN 'holds' ELSE 'fails' END || ',reading:as_rounded=' || CASE WHEN r THEN 'holds' ELSE 'fails' END AS provenance
FROM c WHERE NOT (w AND r)
""")
def arithmetic_findings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    checks = table(spark, d, "orders").select(k.alias("claim"), (k % 3 == 0).alias("as_written"), (k % 2 == 0).alias("as_rounded"), F.col("o_orderpriority").alias("line"), F.lit("sides differ").alias("message"), F.lit("a").alias("left_text"), F.col("o_orderstatus").alias("left_value"), F.lit("b").alias("right_text"), F.lit(None).cast("string").alias("right_value"), F.when(k % 5 == 0, F.array(F.lit("first"), F.lit("then"))).otherwise(F.array().cast("array<string>")).alias("trail"))
    return reports.arithmetic_findings(checks, 8).withColumn("provenance", F.array_join("provenance", ","))


@query(r"""
WITH t AS (SELECT page_id, html AS text FROM pages UNION ALL SELECT -1 - doc_id, text FROM documents),
f AS (SELECT page_id, length(text) AS n, string_split(regexp_replace(lower(text), '\s+', ' ', 'g'), '') AS c FROM t),
h AS (SELECT page_id, n, len(c) AS m, list_transform(list_distinct(c), lambda x: len(list_filter(c, lambda y: y = x)) / len(c)) AS p FROM f),
s AS (SELECT page_id, n, CASE WHEN m < 2 THEN 1.0 ELSE 2 ** -list_sum(list_transform(p, lambda x: x * log2(x))) END AS s FROM h)
SELECT page_id, round(CASE WHEN n >= 120 AND s > 30 THEN s END, 6) AS score FROM s
""")
def anomaly_scores(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "pages").select("page_id", F.col("html").alias("text")).unionByName(table(spark, d, "documents").select((-1 - F.col("doc_id")).alias("page_id"), "text"))
    return texts.select("page_id", F.round(reports.anomaly_score(F.col("text")), 6).alias("score"))


@query("""
WITH p AS (SELECT conv_id, turn // 2 AS section, CASE WHEN turn % 5 = 4 THEN 'References' ELSE 'Results' END AS kind, CASE WHEN turn % 2 = 1 THEN turn END AS paragraph, text FROM conversations)
SELECT conv_id, section, paragraph FROM p WHERE kind <> 'References' AND contains(text, 'on') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY section, coalesce(paragraph, -1)) = 1
""")
def first_position(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    rows = table(spark, d, "conversations").select("conv_id", F.floor(t / 2).alias("section"), F.when(t % 5 == 4, "References").otherwise("Results").alias("kind"), F.when(t % 2 == 1, t).alias("paragraph"), "text")
    return reports.first_position(rows, ["conv_id"], F.col("text").contains("on"))


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'p-value p < 0.05' WHEN 2 THEN CASE WHEN l_orderkey % 2 = 0 THEN '95% ' ELSE '' END || 'CI [1, 2]' WHEN 3 THEN 'sample size n = ' || l_orderkey WHEN 4 THEN 'statistical test: t-test'
       WHEN 5 THEN 't-test(1, 20) = 0.05' WHEN 6 THEN 'effect size: t-test = 0.05' ELSE 'significance threshold p < 0.05' END || ' (Results¶' || l_linenumber + 1 || ')' AS message FROM lineitem
""")
def described_statistics(spark: SparkSession, d: str) -> DataFrame:
    n, lit = F.col("l_linenumber"), F.lit
    kind = F.element_at(F.array(*map(lit, ("p_value", "confidence_interval", "sample_size", "test", "test_statistic", "effect_size", "significance_threshold"))), n)
    fields = {"name": lit("t-test"), "operator": lit("<"), "value": lit("0.05"), "level": F.when(F.col("l_orderkey") % 2 == 0, "95"), "low": lit("1"), "high": lit("2"), "n": F.col("l_orderkey").cast("string"), "df": lit("1, 20")}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reports.described_statistic(kind, fields, lit("Results"), n).alias("message"))


@query("""
WITH p AS (SELECT doc_id, quality, toxic, doc_id % 3 = 0 AS effect, doc_id % 2 = 0 AS ci, CASE WHEN doc_id % 4 = 0 THEN 3 ELSE 2 END AS groups,
                  ['This proves the effect.', 'This does not prove it.', 'We found conclusive evidence.', 'A difference was seen.', 'No study has proven it; ours demonstrates that it holds.'][doc_id % 5 + 1] AS text FROM labels),
f AS (SELECT doc_id, CASE WHEN NOT effect THEN 1 ELSE 0 END AS a, CASE WHEN NOT ci THEN 1 ELSE 0 END AS b, CASE WHEN groups > 2 THEN 1 ELSE 0 END AS c, CASE WHEN doc_id % 5 IN (0, 2) THEN 1 ELSE 0 END AS e FROM p)
SELECT doc_id, unnest(['missing_effect_size', 'missing_confidence_interval', 'test_group_mismatch', 'p_value_overclaim']) AS rule, unnest([a, b, c, e])::BIGINT AS flags, unnest([a = 0, b = 0, c = 0, e = 0]) AS passed FROM f
""")
def manuscript_rule_outcomes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    said = F.element_at(F.array(*map(F.lit, ("This proves the effect.", "This does not prove it.", "We found conclusive evidence.", "A difference was seen.", "No study has proven it; ours demonstrates that it holds."))), (k % 5 + 1).cast("int"))
    rows = table(spark, d, "labels").select("doc_id", F.lit(".03").alias("p"), F.when(k % 3 == 0, "d = 1").alias("effect_size"), F.when(k % 2 == 0, "[1, 2]").alias("interval"), F.lit("t").alias("family"), F.when(k % 4 == 0, 3).otherwise(2).alias("groups"), said.alias("text"))
    return reported.rule_outcomes(rows, "doc_id")


# Statistics


@query("""
WITH g AS (SELECT l_orderkey % 6 AS g, 'small' AS "column", l_quantity * 1e-200 AS x FROM lineitem UNION ALL SELECT l_orderkey % 6, 'large', l_quantity * CASE WHEN l_orderkey % 6 < 3 THEN 1e200 ELSE 1 END FROM lineitem UNION ALL SELECT l_orderkey % 6, 'plain', l_quantity FROM lineitem)
SELECT g, "column", count(*) AS n, CASE WHEN "column" = 'small' THEN 'underflow' WHEN "column" = 'large' AND g < 3 THEN 'overflow' END AS reason FROM g GROUP BY ALL
""")
def range_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose squares leave the range of doubles, though none of them does."""
    q, g = F.col("l_quantity"), F.col("l_orderkey") % 6
    rows = table(spark, d, "lineitem").select(g.alias("g"), (q * 1e-200).alias("small"), (q * F.when(g < 3, 1e200).otherwise(1.0)).alias("large"), q.alias("plain"))
    return stats.range_refusals(rows, ["small", "large", "plain"], ["g"])


@query("""
WITH p AS (SELECT p_partkey AS k, p_size::DOUBLE AS x, p_retailprice AS y FROM part WHERE p_partkey IN (3, 8, 11, 20)),
s AS (SELECT regr_slope(y, x) AS b, regr_r2(y, x) AS r2, sqrt(regr_r2(y, x) / (1 - regr_r2(y, x)) * 2) AS t FROM p)
SELECT round(abs(t), 6) AS t, round(1 - t / sqrt(2 + t * t), 9) AS p, round(1 - sqrt(t * t / (2 + t * t)), 9) AS f_p FROM s
""")
def least_squares_p(spark: SparkSession, d: str) -> DataFrame:
    """p of a slope on two degrees of freedom, which has a closed form; F of the whole is its square. The parts are
    found in the whole table."""
    four = table(spark, d, "part").where(F.col("p_partkey").isin(3, 8, 11, 20)).select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    found = stats.with_p(stats.least_squares(four, "y", ["x"])).where("term = 'x'")
    return found.select(F.round(F.abs("t"), 6).alias("t"), F.round("p", 9).alias("p"), F.round("f_p", 9).alias("f_p"))


# Bindings and tokens


@query("""
WITH c AS (SELECT doc_id AS claim, doc_id % 4 AS kind FROM documents)
SELECT claim, unnest([1, 2, 3])::BIGINT AS nth, unnest(CASE kind WHEN 0 THEN ['independent_t', 'independent_t', 'paired_t'] WHEN 1 THEN ['paired_t', 'paired_t', 'paired_t'] WHEN 2 THEN ['spearman', 'spearman', 'spearman'] ELSE ['one_way', 'one_way', 'one_way'] END) AS method,
       unnest(CASE kind WHEN 0 THEN ['outcome', 'outcome', 'first'] WHEN 1 THEN ['first', 'first', 'first'] WHEN 2 THEN ['x', 'x', 'x'] ELSE ['outcome', 'outcome', 'outcome'] END) AS first_role,
       unnest(CASE kind WHEN 0 THEN ['C1', 'C2', 'C1'] WHEN 1 THEN ['C2', 'C1', 'C2'] WHEN 2 THEN ['C3', 'C1', 'C3'] ELSE ['C1', 'C2', 'C1'] END) AS first_column,
       unnest(CASE kind WHEN 0 THEN ['group', 'group', 'second'] WHEN 1 THEN ['second', 'second', 'second'] WHEN 2 THEN ['y', 'y', 'y'] ELSE ['group', 'group', 'group'] END) AS second_role,
       unnest(CASE kind WHEN 0 THEN ['C4', 'C4', 'C2'] WHEN 1 THEN ['C1', 'C2', 'C3'] WHEN 2 THEN ['C1', 'C3', 'C2'] ELSE ['C5', 'C5', 'C4'] END) AS second_column,
       unnest(CASE kind WHEN 0 THEN ['header_matches_sentence', 'header_matches_sentence', 'header_matches_sentence'] WHEN 3 THEN ['header_matches_sentence', 'header_matches_sentence', 'first_eligible_columns'] ELSE ['header_matches_sentence', 'header_matches_sentence', 'header_matches_sentence'] END) AS reason
FROM c
""")
def binding_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Proposals for a claim on each document over a table of five columns."""
    said = ("Weight differed by sex", "In a paired design, weight before and after (score) differed", "A Spearman correlation of age", "An ANOVA by region")
    kinds = ("t", "t", "r", "f")
    k = (F.col("doc_id") % 4 + 1).cast("int")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), k)
    claims = table(spark, d, "documents").select(F.col("doc_id").alias("claim"), pick(kinds).alias("family"), pick(said).alias("sentence"))
    columns = spark.createDataFrame([("C1", "body weight", True, None), ("C2", "score after weight", True, None), ("C3", "age", True, None), ("C4", "sex", False, 2), ("C5", "region", False, 4)], "alias string, header string, numeric boolean, levels int")
    return bindings.proposals(claims, columns).drop("matched")


@query("""
WITH r AS (SELECT doc_id, 'c' || doc_id AS claim_id, doc_id % 3 AS revision FROM documents)
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unknown' WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 10 = 0 THEN 'revoked:dataset_replaced' ELSE 'revoked:withdrawn' END WHEN doc_id % 4 = 0 THEN 'claim_mismatch' WHEN doc_id % 11 = 0 THEN 'stale:fingerprint' WHEN doc_id % 13 = 0 THEN 'stale:claim_revision' WHEN doc_id % 17 = 0 THEN 'stale:binding' ELSE 'open' END AS gate FROM r
""")
def token_gate(spark: SparkSession, d: str) -> DataFrame:
    """A token for each document, some revoked, some asked about wrongly."""
    k = F.col("doc_id")
    records = table(spark, d, "documents").select("doc_id", F.concat(F.lit("c"), k.cast("string")).alias("claim_id"), (k % 3).alias("revision"), F.lit("f1").alias("fingerprint"), F.concat(F.lit("b"), k.cast("string")).alias("binding"), k.alias("issued_at"))
    tokens = bindings.issued(records, "a secret", ["issued_at"])
    held = tokens.select("token", "claim_id")
    store = bindings.revoked(bindings.revoked(tokens, records.where(k % 10 == 0), "dataset_replaced"), records.where(k % 5 == 0), "withdrawn")
    asked = records.join(held, "claim_id").select(
        "doc_id", F.when(k % 7 == 0, "no such token").otherwise(F.col("token")).alias("token"), F.when(k % 4 == 0, "another").otherwise(F.col("claim_id")).alias("claim_id"), F.when(k % 13 == 0, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"),
        F.when(k % 11 == 0, "f2").otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(k % 17 == 0, "other").otherwise(F.col("binding")).alias("binding"),
    )
    return bindings.looked_up(asked, store).select("doc_id", "gate")


# Exports


@query()
def t_test_csv(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a Welch test's export and the hash of them in its manifest."""
    customers = table(spark, d, "customer")
    levels = ("BUILDING", "MACHINERY")
    t = stats.t_test(customers, "c_mktsegment", "c_acctbal", levels, welch=True)
    sd = customers.where(F.col("c_mktsegment").isin(*levels)).agg(*(F.stddev_samp(F.when(F.col("c_mktsegment") == x, F.col("c_acctbal"))).alias(f"sd{i}") for i, x in enumerate(levels, 1)))
    row = t.crossJoin(sd).select(  # one row each
        F.lit("welch").alias("variant"), "t", "df", "p", F.col("diff").alias("mean_difference"), F.col("se").alias("standard_error"), F.lit(0.95).alias("confidence_level"), F.col("ci_low").alias("ci_lower"), F.col("ci_high").alias("ci_upper"), F.col("d").alias("cohens_d"),
        F.sqrt((F.pow("sd1", F.lit(2)) + F.pow("sd2", F.lit(2))) / 2).alias("d_standardizer"), "sd_ratio", F.lit("root_mean_variance").alias("standardizer"), *(c for i in (1, 2) for c in (F.lit(levels[i - 1]).alias(f"level{i}"), f"n{i}", f"mean{i}", f"sd{i}")),
    )
    excluded = stats.exclusion_counts(customers, "c_mktsegment", "c_acctbal", levels).where("reason <> 'used'").select(F.col("reason").alias("code"), "n")
    lines = tables.t_test_lines(row, excluded)
    manifest = tables.run_manifest(lines.select(F.lit("t_test.csv").alias("name"), "nth", "line"), F.struct(F.lit("welch").alias("variant")), excluded.select("code"), "1")
    return lines.unionByName(manifest.select(F.lit(9999).alias("nth"), F.col("manifest").alias("line")))


@query("""
WITH p AS (SELECT p_partkey AS id, p_partkey // 4 AS g, p_partkey % 4 AS i FROM part)
SELECT id, 'k' || g || CASE WHEN i = 1 THEN '-2' ELSE '' END AS key, 'k' || g || ['', '-2', '-3', '-4'][i + 1] AS unique_key FROM p
""")
def lowest_free_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of four rows each, of which the second has literally the suffix that the third would get otherwise."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("id"), F.concat(F.lit("k"), F.floor(k / 4).cast("string"), F.when(k % 4 == 1, "-2").otherwise("")).alias("key"))
    return library.decollided(rows, "key", "id")


@query("""
WITH o AS (SELECT user_id AS debate, event_id AS agent, event_type AS answer, event_id % 4 AS round, event_id % 5 = 0 AS reconsidered FROM events),
c AS (SELECT *, count(*) OVER (PARTITION BY debate) - count(*) OVER (PARTITION BY debate, answer) AS contradicting FROM o)
SELECT *, contradicting > 0 AND NOT reconsidered AND round < 3 AS due FROM c
""")
def revisions_due(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    opinions = table(spark, d, "events").select(F.col("user_id").alias("debate"), k.alias("agent"), F.col("event_type").alias("answer"), (k % 4).alias("round"), (k % 5 == 0).alias("reconsidered"))
    return reports.revisions_due(opinions)


@query("""
SELECT o_orderkey, o_orderkey % 3 AS lacking, o_orderkey % 2 AS thresholds FROM orders WHERE o_orderpriority = '1-URGENT'
""")
def severe_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of one severity with the statistics that lack an effect size, and declared thresholds."""
    one = lambda threshold, effect: F.struct(F.lit(threshold).alias("is_threshold"), F.lit(effect).alias("effect_size_present"))
    k = F.col("o_orderkey")
    some = F.concat(F.array_repeat(one(False, False), (k % 3).cast("int")), F.array_repeat(one(True, False), (k % 2).cast("int")), F.array(one(False, True)))
    found = reports.of_severity(table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("severity"), some.alias("statistics")), "1-URGENT")
    return found.select("o_orderkey", F.size(reports.lacking_effect_size(F.col("statistics"))).cast("long").alias("lacking"), F.size(reports.thresholds(F.col("statistics"))).cast("long").alias("thresholds"))


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1 AND (l_partkey % 50 = 0 OR l_suppkey % 50 = 0)")
def touching_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges from parts to suppliers with a seed at either end."""
    edges = table(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_partkey", "l_suppkey")
    seeds = table(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id")).union(table(spark, d, "supplier").where("s_suppkey % 50 = 0").select("s_suppkey"))
    return rel.touching(edges, seeds, "l_partkey", "l_suppkey")


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS n, (p_partkey * 37 % 1000 / 10.0)::DECIMAL(10,1) AS pc FROM part)
SELECT k, n, CASE WHEN n >= 1000 THEN 'could_not_check' WHEN greatest(ceil((pc - 0.05) * n / 100), 0) <= least(floor((pc + 0.05) * n / 100), n) THEN 'consistent' ELSE 'inconsistent' END AS verdict FROM p
""")
def grim_percentages(spark: SparkSession, d: str) -> DataFrame:
    """Can a share of so many cases print as this percentage?"""
    pc = (F.col("p_partkey") * 37 % 1000 / 10.0).cast("decimal(10,1)").cast("string")
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n"), numbers.grim_percent(pc, F.col("p_size"))["verdict"].alias("verdict"))
