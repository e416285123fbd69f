"""Reports, bindings, tokens and exports: edge cases, and every query of the newer modules against its SQL."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline import queries_claims, queries_records, queries_reports
from plumbline.functions import numbers, places, reported, symbolic
from plumbline.operators import bindings, locate, relational as reports_rel, reports, stats, vector
from plumbline.queries import ORACLES, QUERIES
from plumbline.sources import tables

DATA = "/root/testdata/sf0.001"
OWN = sorted(k for k, f in QUERIES.items() if f.__module__ in {m.__name__ for m in (queries_claims, queries_records, queries_reports)} and k in ORACLES)


def plain(rows):
    number = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(number(v) for v in r) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are elsewhere")
@pytest.mark.parametrize("name", OWN)
def test_query_against_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    found = QUERIES[name](spark, DATA)
    assert sorted(found.columns) == sorted(columns)
    assert plain(map(tuple, found.select(*columns).collect())) == plain(want.fetchall())


def test_empty_tables(spark):
    e = spark.createDataFrame([], "g string, x double, n long, outcome string, commands long, statistical long")
    assert reports.with_grand_total(e, "g").count() <= 1 and reports.ingest_summary(e, ["g"]).count() == 0 and reports.population_shares(e, "g", "n").count() == 0
    assert reports.upper_median(e, ["g"], "x").count() == 0 and reports.conventions(e, ["g"], "x", 1).count() == 0 and reports.outcome_tally(e, ["g"], "outcome", "n").count() == 0
    assert reports.funnel(e, [("a", F.col("x") > 1)]).first().asDict() == {"stage": "a", "nth": 1, "reached": 0, "lost": 0}
    assert stats.range_refusals(e, ["x"], ["g"]).count() == 0


def test_medians_and_shares(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 5.0), ("c", None)], "g string, x double")
    assert {r.g: r.median for r in reports.upper_median(df, ["g"], "x").collect()} == {"a": 3.0, "b": 5.0}
    rows = {r.g: (r.n, r.status, r.median, r.iqr) for r in reports.conventions(df, ["g"], "x", 4).collect()}
    assert rows == {"a": (4, "INFERRED", 2.5, 1.5), "b": (1, "UNAVAILABLE", None, None)}
    shares = spark.createDataFrame([("a", 1), ("b", 2), ("c", 0)], "g string, n long")
    assert {r.g: r.percent for r in reports.population_shares(shares, "g", "n").collect()} == {"a": 33, "b": 67, "c": 0}
    assert {r.percent for r in reports.population_shares(shares.withColumn("n", F.lit(0)), "g", "n").collect()} == {0}
    bits = reports.perplexity_of_bits(df, ["g"], "x").where("g = 'c'").first()
    assert (bits.mean_bits, bits.perplexity) == (0.0, 1.0)


def test_tally_names_every_outcome_in_order(spark):
    df = spark.createDataFrame([(1, 3, "failed"), (1, 1, "noOaCopy"), (1, 2, "failed"), (2, 9, "new kind")], "b long, at long, o string")
    assert {r.b: r.summary for r in reports.outcome_tally(df, ["b"], "o", "at").collect()} == {1: "3 sources: 1 no OA copy, 2 failed.", 2: "1 source: 1 new kind."}


def test_journal_lookup_falls_back_to_parts_of_names(spark):
    journals = spark.createDataFrame([(i, f"Journal of X{i}", "1234-567x" if i == 3 else None, f"https://www.x{i}.org/a") for i in range(15)] + [(20, "journal of", None, None)], "id long, name string, issn string, website string")
    queries = spark.createDataFrame([(1, " JOURNAL OF "), (2, "of x"), (3, "issn 1234567X"), (4, "www.x3.org/z"), (5, " "), (6, "zzz"), (7, "0000-0000")], "qid long, q string")
    got = {}
    for r in reports.journal_lookup(journals, queries).orderBy("qid", "nth").collect():
        got.setdefault(r.qid, []).append(r.journal)
    assert got == {1: [20], 2: list(range(10)), 3: [3], 4: [3]}


def test_notes(spark):
    notes = spark.createDataFrame([("A Title", "b", None, "p", ["x"], "n", "1", 1), ("t", None, '{"k": "Title"}', "p", ["y", "x"], "n", "2", 2), ("t", "b", "", "p", ["TITLE"], "m", "1", 3), ("t", "b", "", None, None, "m", "1", 4)], "title string, body string, fields_json string, paper_title string, tags array<string>, note_type string, paper_id string, updated_at long")
    at = lambda **k: [r.updated_at for r in reports.notes_found(notes, **k).collect()]
    assert at(query=" title ") == [3, 2, 1] and at(query="title", tag="x") == [2, 1] and at() == [4, 3, 2, 1] and at(note_type="m") == [4, 3] and at(paper="2") == [2]


def test_proposals_need_columns_for_every_role(spark):
    claims = spark.createDataFrame([(1, "t", "the score"), (2, "z", "x"), (3, "chi_square", None)], "claim long, family string, sentence string")
    one = spark.createDataFrame([("C1", "score", True, None)], "alias string, header string, numeric boolean, levels int")
    assert bindings.proposals(claims, one).count() == 0
    two = one.union(spark.createDataFrame([("C2", "other", True, None)], one.schema))
    rows = bindings.proposals(claims, two).orderBy("nth").collect()
    assert [(r.claim, r.method, r.first_column, r.second_column, r.matched) for r in rows] == [(1, "paired_t", "C1", "C2", "score"), (1, "paired_t", "C2", "C1", "score")]


def test_tokens(spark):
    records = spark.createDataFrame([("a", 1, "f", "b1", 1), ("a", 2, "f", "b2", 2), ("b", 1, "f", "b1", 3)], "claim_id string, revision long, fingerprint string, binding string, issued_at long")
    tokens = bindings.issued(records, "s", ["issued_at"])
    assert tokens.select("token").distinct().count() == 3 and bindings.issued(records, "t", ["issued_at"]).join(tokens, "token").count() == 0
    once = bindings.revoked(tokens, spark.createDataFrame([("a",)], "claim_id string"), "claim_revised")
    twice = bindings.revoked(once, records, "withdrawn")
    assert {r.revoked for r in twice.where("claim_id = 'a'").collect()} == {"claim_revised"} and twice.where("claim_id = 'b'").first().revoked == "withdrawn"


@pytest.mark.parametrize(("cells", "reason"), [([1.0, 2.0], None), ([1e200, -1e200], "overflow"), ([1e-200, 2e-200], "underflow"), ([5.0, 5.0], None), ([0.0, 0.0], None), ([1.0, float("nan")], "non_finite_input"), ([1.0, float("inf")], "non_finite_input"), ([None, 1.0], None)])
def test_range_refusals(spark, cells, reason):
    assert stats.range_refusals(spark.createDataFrame([(x,) for x in cells], "x double"), ["x"]).first().reason == reason


@pytest.mark.parametrize(("text", "said"), [
    ("This proves it.", True), ("This does not prove it.", False), ("Proof is here.", True), ("We approve it.", False), ("A definitive answer, not a guess.", True), ("It cannot, we think, establish that.", False), (None, False), ("Results confirm the hypothesis.", True),
])
def test_overclaims(spark, text, said):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(reported.overclaims(F.col("t"), F.lit(".01"))).first()[0] is said and df.select(reported.overclaims(F.col("t"), F.lit(None))).first()[0] is False


def test_t_test_lines_and_manifest(spark):
    values = {s: float(i) + 0.5 for i, s in enumerate(tables.T_TEST_STATISTICS)} | {"sd_ratio": None}
    row = {"variant": "welch", "standardizer": "root_mean_variance", **values, "level1": '=a "x"', "n1": 3, "mean1": 1.0, "sd1": 0.5, "level2": "b", "n2": 4, "mean2": -2.0, "sd2": 0.1}
    result = spark.createDataFrame([row], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long' if isinstance(v, int) else 'double'}" for k, v in row.items()))
    excluded, limits = spark.createDataFrame([("missing_group", 2)], "code string, n long"), spark.createDataFrame([("no_pairing",)], "code string")
    lines = [r.line for r in tables.t_test_lines(result, excluded, limits).orderBy("nth").collect()]
    assert lines[0] == '"variant","","",,"welch"' and '"sd_ratio","","",,"not_computable"' in lines and '"cohens_d","","",8.5,"root_mean_variance"' in lines
    assert '"n","1","\'=a ""x""",3,""' in lines and lines[-2:] == ['"excluded","","",2,"missing_group"', '"limitation","","",,"no_pairing"'] and len(lines) == 1 + 11 + 8 + 2
    outputs = spark.createDataFrame([("b.csv", 2, "y"), ("b.csv", 1, "x"), ("a.csv", 1, "é")], "name string, nth long, line string")
    made = json.loads(tables.run_manifest(outputs, F.struct(F.lit(1).alias("k")), excluded, "9").first()[0])
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert made == {"codes": ["missing_group"], "engine": "9", "outputs": [{"bytes": 2, "lines": 1, "name": "a.csv", "sha256": h(h("é"))}, {"bytes": 2, "lines": 2, "name": "b.csv", "sha256": h(h("x") + "\n" + h("y"))}], "settings": {"k": 1}}


def test_unequal_quotients_differ_without_a_witness(monkeypatch):
    monkeypatch.setattr(symbolic, "points", lambda names: iter(()))
    assert symbolic.compared("a", "a + 1") == ("differs", None)


def test_needles(spark, monkeypatch):
    texts = [(1, "aaaa bb 😀aa"), (2, None), (3, ""), (4, "xbbx")]
    needles = [(1, "aa"), (2, "bb"), (3, "😀"), (4, ""), (5, None), (6, "aa"), (7, "zz")]
    t, n = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(needles, "needle long, text string")
    want = sorted((i, k, at) for i, x in texts for k, y in needles if x and y for at in range(len(x)) if x.startswith(y, at))
    for chars in (1, 10**6):
        monkeypatch.setattr(locate, "NEEDLE_CHARS", chars)
        assert sorted(map(tuple, locate.needle_hits(t, n).collect())) == want
    assert locate.needle_hits(t, n.limit(0)).count() == 0 and locate.needle_hits(t.limit(0), n).count() == 0


def test_budget_takes_rows_up_to_the_first_overrun(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([0, 1, 5, 40])) for g, n in (("a", 500), (None, 300), ("b", 1), ("c", 7)) for i in range(n)] + [("d", 5, 999), ("d", 6, 1)]
    want = set()
    for g in {r[0] for r in rows}:
        used = 0
        for k, (_, i, w) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1])):
            used += w
            if used > 100 and k:
                break
            want.add((g, i))
    df = spark.createDataFrame(rows, "g string, r long, w long")
    assert {(x.g, x.r) for x in vector.within_budget(df, 100, "r", "w", ("g",)).collect()} == want
    assert vector.within_budget(df.where("g = 'a'"), 0, "r", "w").count() >= 1 and vector.within_budget(df.limit(0), 5, "r", "w", ("g",)).count() == 0


@pytest.mark.parametrize(("percent", "n", "verdict"), [("33.3", 3, "consistent"), ("33.4", 3, "inconsistent"), ("50", 7, "inconsistent"), ("57", 7, "consistent"), ("100", 7, "consistent"), ("0.0", 7, "consistent"), ("50.0", 1000, "could_not_check"), ("x", 5, "could_not_check"), ("120", 5, "could_not_check"), ("12.5", 0, "could_not_check")])
def test_grim_of_percentages(spark, percent, n, verdict):
    df = spark.createDataFrame([(percent, n)], "p string, n long")
    assert df.select(numbers.grim_percent(F.col("p"), F.col("n"))["verdict"]).first()[0] == verdict


def test_touching_edges_of_both_ends_come_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 5), (1, 1), (None, 1), (6, None)], "source long, target long")
    found = reports_rel.touching(edges, spark.createDataFrame([(1,), (1,), (3,)], "id long"))
    assert set(map(tuple, found.collect())) >= {(1, 2), (2, 1), (3, 3), (1, 1)} and found.where("source in (4, 6)").count() == 0 and found.count() <= 5


def test_lines_logs_and_units(spark, tmp_path):
    lines = spark.createDataFrame([("a,b",)], "line string")
    tables.write_lines(lines, str(tmp_path / "l"), header="h")
    raw = b"".join(sorted(p.read_bytes() for p in (tmp_path / "l").glob("part-*")))
    assert raw == b"a,b\r\nh\r\n" or raw == b"h\r\na,b\r\n"
    for i in range(2):
        tables.append_log(spark.createDataFrame([(i,)], "i long"), str(tmp_path / "log"))
    assert {r.i for r in spark.read.json(str(tmp_path / "log")).collect()} == {0, 1}
    df = spark.createDataFrame([("a😀b",)], "t string")
    assert [df.select(places.to_utf16(F.lit(i), places.astral_places(F.col("t")))).first()[0] for i in range(4)] == [0, 1, 3, 4]
    found = reported.manuscript_rules(spark.createDataFrame([(1, "t", None, "i", 3), (2, "F", "d", None, 3), (3, "t", "d", "i", 2)], "doc_id long, family string, effect_size string, interval string, groups int"))
    assert sorted((r.doc_id, r.finding) for r in found.collect()) == [(1, "missing_effect_size"), (1, "test_group_mismatch"), (2, "missing_interval")]


@pytest.mark.parametrize(("name", "content", "caps", "code"), [
    ("x.xls", b"a\n1\n", {}, "unsupported_format"), ("none.csv", None, {}, "not_readable"), ("x.csv", b"a\n" + b"1\n" * 50, {"file_bytes": 20}, "file_too_large"), ("x.csv", b"a,b,c\n1,2,3\n", {"columns": 2}, "too_wide"),
    ("x.csv", b"a\n1\n2\n3\n", {"rows": 2}, "too_large"), ("x.csv", b"a\n" + b"y" * 90 + b"\n", {"cell_bytes": 80}, "content_too_large"), ("x.csv", b"a\n\xff\xfe\n", {}, "encoding_not_utf8"), ("x.csv", b"", {}, "no_table"),
])
def test_tables_that_are_refused(spark, tmp_path, name, content, caps, code):
    if content is not None:
        (tmp_path / name).write_bytes(content)
    with pytest.raises(tables.Refused) as refused:
        tables.read_table(spark, str(tmp_path / name), tables.CAPS | caps)
    assert refused.value.code == code


def test_ttl_fresh_rounds_seconds_as_its_sql(spark, tmp_path):
    last, edge = 1_700_000_000_000_000, 1_700_000_000_000_000 - 172_800_000_000
    at = [last, last - 1, *(edge + k for k in (-500_000, 0, 499_999, 500_000, 500_001, 600_000, 1_000_000, 1_500_000))]
    rows = spark.createDataFrame(list(enumerate(at)), "event_id long, at long").select("event_id", F.lit(1).cast("long").alias("user_id"), F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(r.event_id for r in QUERIES["ttl_fresh"](spark, str(tmp_path)).collect()) == [0, 1, 6, 7, 8, 9]
