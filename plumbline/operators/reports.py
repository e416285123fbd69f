"""Counts, summaries and selections of reports: totals, shares, funnels, tiers, searches and findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.text import char_perplexity, folded_chars
from plumbline.operators import quantiles

#: What an outcome of a batch is called.
OUTCOME_LABELS = {
    "fetched": "fetched", "abstractOnly": "abstract only", "paywalled": "paywalled", "noOaCopy": "no OA copy", "rateLimited": "rate-limited", "alreadyLinked": "already linked", "failed": "failed",
}

#: Statuses of a check that are put before an author, with their severities, and lifecycles by build.
FINDINGS = {"detected": "major", "requires_author_confirmation": "minor"}
RUNNABLE = {"beta": ("release", "devtools"), "stable": ("release", "devtools"), "experimental": ("devtools",)}

#: Characters below which a text is not scored, and the perplexity above which it is anomalous.
SCORED_CHARS, ANOMALOUS = 120, 30.0


def with_grand_total(df: DataFrame, by: str, **counts: Column) -> DataFrame:
    """by, n, the counts of each condition and is_total: a row for each group, and one for all."""
    out = df.rollup(by).agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in counts.items()), (F.grouping(by) == 1).alias("is_total"))
    return out.select(by, "n", *counts, "is_total")


def ingest_summary(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, parsed, stored, rejected, commands, statistical and summary of files (outcome, commands, statistical)."""
    of = lambda outcome: F.count_if(F.col("outcome") == outcome).alias(outcome)
    rows = files.groupBy(*by).agg(of("parsed"), of("stored"), of("rejected"), F.coalesce(F.sum("commands"), F.lit(0)).alias("commands"), F.coalesce(F.sum("statistical"), F.lit(0)).alias("statistical"), F.count("*").alias("n"))
    clause = lambda c, text: F.when(F.col(c) > 0, text)
    parts = F.concat_ws(
        ", ", clause("parsed", F.format_string("%d parsed (%d commands, %d statistical)", "parsed", "commands", "statistical")), clause("stored", F.format_string("%d stored and not parsed", "stored")),
        clause("rejected", F.format_string("%d could not be read", "rejected")),
    )
    return rows.withColumn("summary", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " file: ").otherwise(" files: "), parts, F.lit("."))).drop("n")


def population_shares(strata: DataFrame, name: str, population: str) -> DataFrame:
    """name and percent, whole, of each stratum in all; 0 where there is nobody. One row a stratum."""
    total = F.sum(population).over(W.partitionBy())
    return strata.select(name, F.when(total > 0, F.round(100.0 * F.col(population) / total)).otherwise(0).cast("long").alias("percent"))


def upper_median(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """by, n and median: the upper of the two middle values of an even number, never their mean."""
    return quantiles.selected(df, by, x, [("median", 0.5, lambda n, _: F.floor(n / 2))])


def share_of_sums(df: DataFrame, by: Sequence[str], part: Column, whole: Column) -> DataFrame:
    """by and proportion: a sum over a sum; null where the whole is 0."""
    return df.groupBy(*by).agg(F.try_divide(F.sum(part), F.sum(whole)).alias("proportion"))


def outcome_tally(df: DataFrame, by: Sequence[str], outcome: str, order: str, noun: str = "source", labels: Mapping[str, str] = OUTCOME_LABELS) -> DataFrame:
    """by and summary: every outcome of a batch by name with its count, in the order in which each first occurred."""
    counts = df.groupBy(*by, outcome).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    names = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    parts = F.array_sort(F.collect_list(F.struct("first", F.concat(F.col("n").cast("string"), F.lit(" "), F.coalesce(F.try_element_at(names, F.col(outcome)), F.col(outcome))).alias("text"))))
    rows = counts.groupBy(*by).agg(F.sum("n").alias("n"), parts.alias("parts"))
    return rows.select(*by, F.concat(F.col("n").cast("string"), F.lit(f" {noun}"), F.when(F.col("n") == 1, ": ").otherwise("s: "), F.array_join(F.transform("parts", lambda p: p["text"]), ", "), F.lit(".")).alias("summary"))


def peak_verdicts(reports: DataFrame, spans: DataFrame, key: str, similarity: str, threshold: float) -> DataFrame:
    """key, peak, verdict (concern from the threshold on, else pass), major, minor and info of each report: findings by
    severity, with one info where a report has none."""
    found = spans.groupBy(key).agg(F.max(similarity).alias("peak"), F.count_if(F.col(similarity) >= threshold).alias("major"), F.count_if(F.col(similarity) < threshold).alias("minor"))
    peak = F.coalesce("peak", F.lit(0.0))
    rows = reports.select(key).join(found, key, "left")
    return rows.select(key, peak.alias("peak"), F.when(peak >= threshold, "concern").otherwise("pass").alias("verdict"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("major", "minor")), F.when(F.col("major").isNull(), 1).otherwise(0).cast("long").alias("info"))


def conventions(df: DataFrame, by: Sequence[str], x: str, least: int) -> DataFrame:
    """by, n, status, median and iqr (type 7): inferred from `least` values on, unavailable below, then without figures."""
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    rows = quantiles.selected(df, by, x, [(f"{name}_{side}", p, place) for name, p in shares.items() for side, place in (("lo", quantiles.floor_position), ("hi", quantiles.ceiling_position))])
    value = {name: F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * ((F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)) for name, p in shares.items()}
    enough = F.col("n") >= least
    return rows.select(*by, "n", F.when(enough, "INFERRED").otherwise("UNAVAILABLE").alias("status"), F.when(enough, value["median"]).alias("median"), F.when(enough, value["q3"] - value["q1"]).alias("iqr"))


def perplexity_of_bits(df: DataFrame, by: Sequence[str], bits: str) -> DataFrame:
    """by, mean_bits and perplexity (2 to it); without any bits 0 and 1."""
    rows = df.groupBy(*by).agg(F.coalesce(F.avg(bits), F.lit(0.0)).alias("mean_bits"))
    return rows.withColumn("perplexity", F.pow(F.lit(2.0), F.col("mean_bits")))


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """stage, nth, reached and lost: how many rows pass each stage and all before it, and how many it loses. One
    aggregate, whatever the number of stages."""
    passed, counts = F.lit(True), []
    for name, condition in stages:
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    sums = df.agg(F.count("*").alias("all"), *counts)
    before = ["all", *(name for name, _ in stages[:-1])]
    rows = [F.struct(F.lit(name).alias("stage"), F.lit(i).cast("long").alias("nth"), F.col(name).alias("reached"), (F.col(b) - F.col(name)).alias("lost")) for i, ((name, _), b) in enumerate(zip(stages, before, strict=True), 1)]
    return sums.select(F.inline(F.array(*rows)))


def kinds_in_order(procedures: DataFrame, by: Sequence[str], kind: str, order: str, statistical: Column) -> DataFrame:
    """by and kinds: the distinct kinds of the statistical procedures, each at its first place."""
    first = procedures.where(statistical).groupBy(*by, kind).agg(F.min(order).alias("at"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", kind))), lambda x: x[kind]).alias("kinds"))


def compared_on_common(new: DataFrame, old: DataFrame, truth: DataFrame, key: str, answer: str, positive: Column) -> DataFrame:
    """run, n, tp, fp, fn, precision and recall of two runs of answers (yes or no; others are not answered), both only on
    the keys that both answered."""
    answered = lambda df, name: df.where(F.col(answer).isin("yes", "no")).select(key, (F.col(answer) == "yes").alias(name))
    rows = answered(new, "new").join(answered(old, "old"), key).join(truth.select(key, positive.alias("is")), key)
    long = rows.select("is", F.inline(F.array(*(F.struct(F.lit(r).alias("run"), F.col(r).alias("said")) for r in ("new", "old")))))
    out = long.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("said") & F.col("is")).alias("tp"), F.count_if(F.col("said") & ~F.col("is")).alias("fp"), F.count_if(~F.col("said") & F.col("is")).alias("fn"))
    return out.select("run", "n", "tp", "fp", "fn", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def zip_delta(a: Column, b: Column) -> Column:
    """struct(n, mean_abs, max_abs) of two sequences place by place, as far as both reach; null figures without any."""
    n = F.least(F.size(a), F.size(b))
    gaps = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.abs(x - y))
    return F.struct(n.cast("long").alias("n"), F.when(n > 0, F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / n).alias("mean_abs"), F.array_max(gaps).alias("max_abs"))


def effective_tier(users: DataFrame, subscriptions: DataFrame, key: str, now: Column) -> DataFrame:
    """key and tier: premium with an active subscription of that tier that has not ended by now, else free."""
    rows = users.select(key).join(subscriptions.select(key, "tier", "status", "period_end"), key, "left")
    active = (F.col("status") == "active") & (F.col("period_end").isNull() | (F.col("period_end") > now))
    return rows.select(key, F.when((F.col("tier") == "premium") & active, "premium").otherwise("free").alias("tier"))


def ranked_by_count(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """by, key, n and rank: by count, highest first, then by key."""
    counts = df.groupBy(*by, key).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), key)))


def longest(df: DataFrame, by: Sequence[str], length: str, tie: str, k: int = 2) -> DataFrame:
    """The k longest rows of each group, ties by `tie`, with rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(length), tie))).where(F.col("rank") <= k)


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The distinct keys of both."""
    return a.select(key).intersect(b.select(key))


def journal_lookup(journals: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """qid, nth and journal (id) of what each query (qid, q) finds in journals (id, name, issn, website).

    A query with an ISSN looks for it, one like an address for its domain in websites; others for the name itself and,
    only where no journal has it, for names that contain it, `most` at most, by id. The queries are a stated set and go
    to every journal; equal names and ISSN are joins, and only what is left meets all names."""
    q = F.lower(F.trim("q"))
    issn = F.regexp_extract(q, r"\d{4}-?\d{3}[\dx]", 0)
    address = q.contains(".") & (q.contains("/") | q.startswith("http") | q.contains("www"))
    domain = F.get(F.split(F.regexp_replace(F.regexp_replace(q, r"^https?://", ""), r"^www\.", ""), "/"), F.lit(0))
    asked = queries.where(q != "").select("qid", q.alias("q"), F.regexp_replace(issn, "-", "").alias("issn_key"), F.when(issn != "", "issn").when(address, "address").otherwise("name").alias("way"), domain.alias("domain"))
    known = journals.select("id", F.lower("name").alias("lower_name"), F.regexp_replace(F.lower("issn"), "[^0-9x]", "").alias("own_issn"), F.lower("website").alias("site"))
    by_issn = asked.where("way = 'issn'").join(known.where("own_issn <> ''"), F.col("issn_key") == F.col("own_issn")).select("qid", "id", F.lit(False).alias("cut"))
    by_site = asked.where("way = 'address'").join(known, F.col("site").contains(F.col("domain"))).select("qid", "id", F.lit(False).alias("cut"))
    named = asked.where("way = 'name'")
    exact = named.join(known, F.col("q") == F.col("lower_name")).select("qid", "id", F.lit(False).alias("cut"))
    rest = named.join(exact.select("qid").distinct(), "qid", "left_anti")
    within = rest.join(known, F.col("lower_name").contains(F.col("q"))).select("qid", "id", F.lit(True).alias("cut"))
    found = by_issn.unionByName(by_site).unionByName(exact).unionByName(within)
    found = found.withColumn("nth", F.row_number().over(W.partitionBy("qid").orderBy("id")))
    return found.where(~F.col("cut") | (F.col("nth") <= most)).select("qid", F.col("nth").cast("long").alias("nth"), F.col("id").alias("journal"))


def notes_found(notes: DataFrame, query: str = "", tag: str | None = None, note_type: str | None = None, paper: str | None = None) -> DataFrame:
    """notes (title, body, fields_json, paper_title, tags, note_type, paper_id, updated_at) that contain the query in a
    field or a tag, with the tag, type and paper if given; newest first."""
    q = query.strip().lower()
    fields = [F.coalesce(F.lower(c), F.lit("")).contains(q) for c in ("title", "body", "fields_json", "paper_title")]
    hit = F.lit(q == "") | fields[0] | fields[1] | fields[2] | fields[3] | F.coalesce(F.exists("tags", lambda t: F.lower(t).contains(q)), F.lit(False))
    out = notes.where(hit)
    for column, value in (("note_type", note_type), ("paper_id", paper)):
        out = out if not value else out.where(F.col(column) == value)
    return (out if not tag else out.where(F.array_contains("tags", tag))).orderBy(F.desc("updated_at"))


def subcommand(subcommands: Column, name: str) -> Column:
    """The value of the first of an array of structs (name, value) with that name in any case; null without one."""
    return F.try_element_at(F.filter(subcommands, lambda s: F.lower(s["name"]) == name.lower()), F.lit(1))["value"]


def runnable(lifecycle: Column, build: Column) -> Column:
    """Whether a capability runs in a build: beta and stable do, experimental in devtools alone, others never."""
    out = F.lit(False)
    for state, builds in RUNNABLE.items():
        out = out | ((lifecycle == state) & build.isin(*builds))
    return F.coalesce(out, F.lit(False))


def agreement(as_written: Column, as_rounded: Column) -> Column:
    """What two readings of a claim come to: confirmed by both, detected by neither, else for the author."""
    return F.when(as_written & as_rounded, "confirmed").when(~as_written & ~as_rounded, "detected").otherwise("requires_author_confirmation")


def arithmetic_findings(checks: DataFrame, label_chars: int = 60) -> DataFrame:
    """checks (claim, as_written, as_rounded, line, message, left_text, left_value, right_text, right_value, trail) as
    findings: claim, status, severity, title, detail and provenance. What is confirmed is no finding."""
    status = agreement(F.col("as_written"), F.col("as_rounded"))
    severity = F.try_element_at(F.create_map(*(F.lit(x) for pair in FINDINGS.items() for x in pair)), F.col("status"))
    side = lambda name: F.concat(F.col(f"{name}_text"), F.coalesce(F.concat(F.lit(" = "), F.col(f"{name}_value")), F.lit("")))
    steps = F.when(F.size("trail") > 0, F.concat(F.lit("\n\nTo check this by hand:"), F.array_join(F.transform("trail", lambda s: F.concat(F.lit("\n  - "), s)), ""))).otherwise(F.lit(""))
    reading = lambda c: F.concat(F.lit(f"reading:{c}="), F.when(F.col(c), "holds").otherwise("fails"))
    line = F.when(F.length("line") > label_chars, F.concat(F.substring("line", 1, label_chars), F.lit("…"))).otherwise(F.col("line"))
    provenance = F.array(F.lit("signal:equation-arithmetic"), F.concat(F.lit("epistemic:"), F.col("status")), F.concat(F.lit("claim-index:"), F.col("claim").cast("string")), reading("as_written"), reading("as_rounded"))
    rows = checks.withColumn("status", status).where(F.col("status").isin(*FINDINGS))
    return rows.select("claim", "status", severity.alias("severity"), F.concat(F.lit("Arithmetic "), F.replace("status", F.lit("_"), F.lit(" ")), F.lit(": "), line).alias("title"), F.concat("message", F.lit("\n\nLeft:  "), side("left"), F.lit("\nRight: "), side("right"), steps).alias("detail"), provenance.alias("provenance"))


def anomaly_score(text: Column) -> Column:
    """The character perplexity of a text of SCORED_CHARS characters or more, where it is above ANOMALOUS; else null."""
    score = char_perplexity(F.array_join(folded_chars(text), ""))
    return F.when((F.length(text) >= SCORED_CHARS) & (score > ANOMALOUS), score)


def first_position(paragraphs: DataFrame, by: Sequence[str], said: Column) -> DataFrame:
    """by, section and paragraph of the first text (section, kind, paragraph; a heading's paragraph is null) outside the
    references of which `said` holds; documents without one are left out."""
    rows = paragraphs.where((F.col("kind") != "References") & said)
    at = F.min(F.struct("section", F.coalesce("paragraph", F.lit(-1)).alias("p"))).alias("at")  # a heading comes first
    return rows.groupBy(*by).agg(at).select(*by, "at.section", F.when(F.col("at.p") >= 0, F.col("at.p")).alias("paragraph"))


def described_statistic(kind: Column, fields: Mapping[str, Column], section: Column, paragraph: Column) -> Column:
    """One line on a statistic with its place. fields: name, operator, value, level, low, high, n and df, as text."""
    f = fields
    where = F.concat(F.lit(" ("), section, F.lit("¶"), (paragraph + 1).cast("string"), F.lit(")"))
    level = F.coalesce(F.concat(f["level"], F.lit("% ")), F.lit(""))
    text = (
        F.when(kind == "p_value", F.concat(F.lit("p-value p "), f["operator"], F.lit(" "), f["value"])).when(kind == "confidence_interval", F.concat(level, F.lit("CI ["), f["low"], F.lit(", "), f["high"], F.lit("]")))
        .when(kind == "sample_size", F.concat(F.lit("sample size n = "), f["n"])).when(kind == "test", F.concat(F.lit("statistical test: "), f["name"])).when(kind == "test_statistic", F.concat(f["name"], F.lit("("), f["df"], F.lit(") = "), f["value"]))
        .when(kind == "effect_size", F.concat(F.lit("effect size: "), f["name"], F.lit(" = "), f["value"])).when(kind == "significance_threshold", F.concat(F.lit("significance threshold p "), f["operator"], F.lit(" "), f["value"]))
    )
    return F.concat(text, where)


def of_severity(findings: DataFrame, severity: str) -> DataFrame:
    """The findings of one severity, in the order they have."""
    return findings.where(F.col("severity") == severity)


def lacking_effect_size(statistics: Column) -> Column:
    """Of an array of statistics (is_threshold, effect_size_present, ...) those that report a result without an effect
    size; a declared threshold reports none."""
    return F.filter(statistics, lambda s: ~s["is_threshold"] & ~s["effect_size_present"])


def thresholds(statistics: Column) -> Column:
    return F.filter(statistics, lambda s: s["is_threshold"])


def revisions_due(opinions: DataFrame, rounds: int = 3) -> DataFrame:
    """opinions (debate, agent, answer, round, reconsidered) with contradicting, the peers of another answer, and due: an
    agent reconsiders once, if a peer contradicts it and a round is left. Peers are counted by answer, never paired."""
    by_answer = opinions.groupBy("debate", "answer").agg(F.count("*").alias("same"))
    of_all = opinions.groupBy("debate").agg(F.count("*").alias("all"))
    rows = opinions.join(by_answer, ["debate", "answer"]).join(of_all, "debate")
    due = (F.col("all") > F.col("same")) & ~F.col("reconsidered") & (F.col("round") < rounds)
    return rows.select(*opinions.columns, (F.col("all") - F.col("same")).alias("contradicting"), due.alias("due"))
