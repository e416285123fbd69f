import dataclasses
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import biblio, dist, numbers, reported, symbolic, text
from plumbline.operators import biblio as library, locate, relational, stats, vector
from plumbline.plans.describe import Describe, described
from plumbline.plans.reproduce import Claim, reproduced
from plumbline.queries import QUERIES
from plumbline.sources import records, tables
from plumbline.streaming import gate, limits


def one(df):
    return df.first()[0]


def test_tails_closed_forms():
    x = np.array([0.1, 0.7, 2.0, 9.0, 60.0])
    assert np.allclose(dist.t_tail(x, np.ones(5)), 1 - 2 * np.arctan(x) / np.pi, rtol=1e-9)
    assert np.allclose(dist.t_tail(x, np.full(5, 2.0)), 1 - x / np.sqrt(2 + x * x), rtol=1e-8)
    assert np.allclose(dist.gamma_upper(np.ones(5), x / 2), np.exp(-x / 2), rtol=1e-12)
    upper, lower = dist.f_tails(x, np.full(5, 2.0), np.full(5, 2.0))
    assert np.allclose(upper, 1 / (1 + x), rtol=1e-12) and np.allclose(upper + lower, 1)
    assert np.allclose(dist.t_quantile(np.array([1.0, 2.0, 10.0])), [12.7062047362, 4.3026527297, 2.2281388520], rtol=1e-9)
    z, n = 1.959963984540054, np.array([1e3, 1e4])
    terms = (z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    assert np.allclose(dist.t_quantile(n), sum(x / n**i for i, x in enumerate(terms)), rtol=1e-11)  # the expansion for many degrees of freedom
    assert np.isnan(dist.t_quantile(np.array([1e4 + 1])))[0] and np.isnan(dist.t_tail(np.array([1.0]), np.array([0.0])))[0]


def test_constant_and_offset_columns(spark):
    x = 1e9 + np.arange(200) / 128
    df = spark.createDataFrame([(float(v), 1e9 + 0.1, None, 5.0 if i == 0 else None) for i, v in enumerate(x)], "a double, b double, c double, d double").repartition(7)
    got = {r.column: r for r in stats.numeric_summary(df, ["a", "b", "c", "d"]).collect()}
    assert abs(got["a"].sd - np.std(x - x.min(), ddof=1)) < 1e-12 and got["b"].sd == 0
    assert (got["c"].reason, got["c"].n, got["c"].mean) == ("stats.desc.no_values", 0, None)
    assert (got["d"].reason, got["d"].sd) == ("stats.desc.single_value", None)
    assert got["a"].q1 == pytest.approx(np.quantile(x, 0.25), abs=1e-6)


def test_t_test_properties(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.integers(-999, 999, 12) / 128] + [("b", float(v)) for v in rng.integers(-999, 999, 9) / 128] + [(None, 1.0), ("c", 2.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, y double")
    for welch in (False, True):
        r, s = (stats.t_test(df, "g", "y", p, welch).first() for p in (("a", "b"), ("b", "a")))
        assert r.t == pytest.approx(-s.t) and r.p == pytest.approx(s.p) and r.n1 == 12 and r.n2 == 9
        assert r.ci_low < r["diff"] < r.ci_high and min(12, 9) - 1 <= r.df <= 19 + 1e-9
    assert stats.t_test(df, "g", "y", ("a", "z"), False).first().reason == "stats.ttest.group_too_small"
    same = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, y double")
    assert stats.t_test(same, "g", "y", ("a", "b"), False).first().reason == "stats.ttest.both_groups_constant"


def test_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2)) * [1, 1e4]
    y = 3 + x @ [2, -5e-4] + rng.normal(size=60)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    got = [r.coefficient for r in stats.least_squares(df, "y", ["a", "b"]).collect()]
    assert np.allclose(got, np.linalg.lstsq(np.c_[np.ones(60), x], y, rcond=None)[0], rtol=1e-8)
    assert stats.least_squares(df.withColumn("c", F.col("a") * 2), "y", ["a", "c"]).first().reason == "stats.ols.singular_design"


def test_spearman_ties(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 6, 80), rng.integers(0, 6, 80)
    rank = lambda v: pd.Series(v).rank().to_numpy()
    df = spark.createDataFrame(pd.DataFrame({"a": a.astype(float), "b": b.astype(float)}))
    assert stats.correlation(df, "a", "b", ranks=True).first().r == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])


def test_p_values_closed_forms(spark):
    rows = [("a", 1.0, 2.5, 0.0), ("b", 2.0, 1.0, 1.0), ("c", 4.0, 7.0, 3.0), ("a", 5.0, 2.0, 7.0), ("b", 9.0, 3.5, 2.0)]
    df = spark.createDataFrame(rows, "g string, y double, z double, w double")
    r = stats.paired_t(df.limit(3).coalesce(1), "y", "z").first()
    assert r.df == 2 and r.p == pytest.approx(1 - abs(r.t) / math.sqrt(2 + r.t**2), rel=1e-9)
    r = stats.anova(df, "g", "y").first()
    assert (r.df1, r.df2) == (2, 2) and r.p == pytest.approx(1 / (1 + r.f), rel=1e-9)
    four = df.where("w < 5")
    for ranks in (False, True):
        r = stats.correlation(four, "y", "z", ranks=ranks).first()
        t = r.r * math.sqrt(2 / (1 - r.r**2))
        assert r.df == 2 and r.p == pytest.approx(1 - abs(t) / math.sqrt(2 + t**2), rel=1e-9)
    table = spark.createDataFrame([(i, j) for i, j, n in ((0, 0, 5), (0, 1, 2), (1, 0, 3), (1, 1, 9)) for _ in range(n)], "a int, b int")
    for r in (stats.chi_square(table, "a", "b").first(), stats.chi_square_yates(table, "a", "b", (0, 1), (0, 1)).first()):
        assert r.df == 1 and r.p == pytest.approx(math.erfc(math.sqrt(r.chi2 / 2)), rel=1e-9)


def test_printed_intervals(spark):
    df = spark.createDataFrame([("1.20",), ("-3",), ("x",)], "s string")
    m = numbers.measured(F.col("s"))
    assert [(float(r.lo), float(r.hi)) if r.lo is not None else None for r in df.select(m["lo"].alias("lo"), m["hi"].alias("hi")).collect()] == [(1.195, 1.205), (-3.5, -2.5), None]
    grim = lambda mean, n: one(df.limit(1).select(numbers.grim(F.lit(mean), F.lit(n), F.lit(1), F.lit(True))["verdict"]))
    assert (grim("5.19", 28), grim("5.18", 28), grim("5.19", 100)) == ("inconsistent", "consistent", "could_not_check")


def test_p_consistency_cases(spark):
    rows = [
        ("t", "4.20", 28, None, "=", ".000", None, False, False, "consistent", None),
        ("t", "2.20", 28, None, "=", ".04", None, False, True, "could_not_check", "adjusted_p"),
        ("t", "1.80", 28, None, "=", ".041", None, False, False, "concern", "one_tailed_unstated"),
        ("t", "1.90", 28, None, "=", ".02", 0.01, False, False, "inconsistent", None),
        ("t", "11.0", 60, None, "=", ".0001", None, False, False, "consistent", "floor_printed_as_equality"),
        ("chi_square", "5.99", 2, None, "<", ".06", None, False, False, "consistent", None),
        ("z", "1.96", None, None, "=", ".05", None, False, False, "consistent", None),
    ]
    df = spark.createDataFrame(rows, "family string, statistic string, df1 int, df2 int, relation string, p string, alpha double, one_tailed boolean, adjusted boolean, want string, why string")
    for r in reported.p_consistency(df).collect():
        assert (r.verdict, r.reason) == (r.want, r.why), r
        assert not r.conclusion_changes


def test_reproduction_reads_once_and_only_if_open(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0), ("b", 4.0, 5.0), ("b", 6.0, 4.0), ("b", 5.5, 7.0)], "g string, y double, z double")
    reads = []
    read = lambda: reads.append(1) or df
    claim = Claim("c1", 1, "independent_t", ("g", "y"), "-4.53", ("a", "b"))
    stale = reproduced(spark, [(claim, "no")], "f", read).collect()
    assert not reads and stale[0].reason == "gate_stale"
    got = {r.variant: r.status for r in reproduced(spark, [(claim, claim.token("f")), (Claim("c2", 1, "nothing", (), "1"), Claim("c2", 1, "nothing", (), "1").token("f"))], "f", read).collect()}
    assert len(reads) == 1 and got[None] == "could_not_check" and got["student"] == "not_matched" and got["welch"] in ("matched", "not_matched")


@pytest.mark.parametrize(("left", "right", "verdict"), [
    ("(a+b)^2", "a^2 + 2*a*b + b^2", "identical"), ("a/b", "b/a", "differs"), ("a/a", "1", "agrees_at_every_point_tested"), ("sqrt(a)", "a", "undetermined"), ("1/(a-a)", "2", "undetermined"), ("a^0.5", "a", "undetermined"), ("a +", "a", "undetermined"),
    ("(a+b)^40", "(b+a)^40", "identical"), ("(a+b+c+d)^30", "(d+c+b+a)^30", "agrees_at_every_point_tested"), ("a^-1", "1/a", "agrees_at_every_point_tested"), ("(a^2-1)/(a-1)", "a+1", "agrees_at_every_point_tested"), ("3", "6/2", "identical"), ("a*(a-1)", "0", "differs"), ("a-a", "0", "identical"),
])
def test_equivalence(left, right, verdict):
    assert symbolic.compared(left, right)[0] == verdict


def test_text_functions(spark):
    row = lambda c, t: one(spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))))
    assert row(text.rejoin_hyphens, "a treat- ment of pre- and post- war inter- Est") == "a treatment of pre- and post- war inter- Est".replace("post- war", "postwar")
    assert row(text.fold_typography, "“a”  – b­c") == '"a" - bc'
    assert row(text.one_tailed, "a one-tailed test") and not row(text.one_tailed, "it was not one-tailed") and not row(text.one_tailed, "a one-sided 95% confidence interval")
    assert row(text.names_correction, "Bonferroni corrected") and not row(text.names_correction, "corrected")
    assert row(lambda t: text.chunks(F.split(t, " "), 4, 3), "a b c d e f g") == [list("abcd"), list("defg")]
    assert row(lambda t: text.recovered_grid(F.split(t, ","))["columns"], "Group,N,Mean,a,1,2,b,3,4") == 3
    assert row(lambda t: text.recovered_grid(F.split(t, ","))["reason"], "Group,N,Mean,a,1,2,b,3") == "ragged"
    assert row(lambda t: F.size(text.winnow(text.normal_words(t), 3, 2)), "a b c d e f") >= 2
    assert row(text.expectation_sentences, "Authors must include a statement of the data behind the work. Short one.") == ["Authors must include a statement of the data behind the work."]


def test_winnowed_texts_are_winnowed_words(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "B", "b7", "c ", " ", "\n", "é", "\x0b", "\x1c", "\u2003", "-", "İ", "\u212a", "😀"]) for _ in range(rng.choice([1, 6, 30, 200]))) for _ in range(300)]
    texts += [None, "", " ", "é", "a b", "a b c", "a b c d", "a " * 50, "same words again " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for shingle, window in ((3, 2), (8, 4), (1, 1)):
        rows = df.select("k", text.winnow_text(F.col("t"), shingle, window).alias("now"), text.winnow(text.normal_words(F.col("t")), shingle, window).alias("then")).collect()
        assert len(rows) == len(texts) and all(r.now == r.then for r in rows)
    assert df.limit(0).select(text.winnow_text(F.col("t"), 3, 2)).count() == 0


def test_winnowed_is_not_interpreted_by_element(spark, tmp_path, capsys):
    """No lambda function over a text's words."""
    spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["winnowed"](spark, str(tmp_path))
    found.explain()
    assert "lambdafunction" not in capsys.readouterr().out
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (2, 0)]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [1.0])], "id int, v array<float>")
    assert [r.id for r in vector.knn(df, [1.0, 0.1], 2, "id", "v").collect()] == [1, 3] and vector.knn(df, [1.0, 0.1], 0, "id", "v").count() == 0
    assert {r.id: r.c for r in df.select("id", vector.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    again = vector.hash_embed(spark.createDataFrame([("Hello, hello world",), (None,)], "t string"), "t", dim=384).select(vector.from_blob(vector.to_blob(F.col("vector"))).alias("v")).collect()
    assert np.linalg.norm(again[0].v) == pytest.approx(1, abs=1e-6) and not any(again[1].v) and len(again[0].v) == 384
    assert one(spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(vector.from_blob(F.col("b")))) is None
    with pytest.raises(ValueError):
        vector.only_space(df, "id")


def test_citations(spark):
    bib = "@comment{x}\n@article{k1, title={A {B} C}, author={Doe, Jane and John Q. Smith}, year=2020, journal=\"J, of X\", pages={1--9}, doi={10.1/ABC}}\r\n@book{bad\n@misc{k2, title={T}, year={x}}"
    rows = {r.key: r for r in records.bibtex_entries(spark.createDataFrame([(bib,)], "text string")).collect()}
    assert rows["k1"].fields["journal"] == "J, of X" and rows["k1"].fields["title"] == "A B C" and None in rows
    c = spark.createDataFrame([(rows["k1"].fields,)], "f map<string,string>").select(records.bibtex_citation(F.col("f")).alias("c"))
    assert one(c.select(biblio.formatted(F.col("c"), "apa"))) == "Doe, J., & Smith, J. Q. (2020). A B C. *J, of X*, , 1-9. https://doi.org/10.1/ABC"
    assert one(c.select(biblio.formatted(F.col("c"), "vancouver"))) == "Doe J, Smith JQ. A B C. J, of X. 2020;:1-9."
    ris = "TY  - JOUR\nTI  - T one\nAU  - Doe, J\nPY  - 2019/01\nER  - \nTY  - BOOK\nT1  - Two\n"
    got = spark.createDataFrame([(ris,)], "t string").select(F.explode(F.transform(records.ris_entries(F.col("t")), records.ris_citation)).alias("c")).select("c.title", "c.year").collect()
    assert [tuple(r) for r in got] == [("T one", 2019), ("Two", None)]
    keys = spark.createDataFrame([(i, k) for i, k in enumerate(["a", "a-2", "a", "a", "b"])], "i int, k string")
    assert [r.unique_key for r in library.decollided(keys, "k", "i").orderBy("i").collect()] == ["a", "a-2", "a-3", "a-4", "b"]
    detect = lambda t: one(spark.createDataFrame([(t,)], "t string").select(records.detected_format(F.col("t"))))
    assert [detect(t) for t in ("@a{", ris, '{"type": 1}', "<record></record>", "x", " ")] == ["bibtex", "ris", "json", "xml", "plain", "unknown"]
    ref = spark.createDataFrame([("Doe J, Roe K (2020). A title here. Journal",)], "t string").select(records.plain_reference(F.col("t")).alias("c")).select("c.title", "c.year", "c.containerTitle").first()
    assert tuple(ref) == ("A title here", 2020, "Journal")


def test_import_plan(spark):
    rec = lambda title, doi, year=2020, vol=None: (title, [("Doe", "J")], year, "J", vol, None, None, None, doi)
    schema = "id long, seq long, c struct<title:string,author:array<struct<family:string,given:string>>,year:int,containerTitle:string,volume:string,issue:string,page:string,URL:string,DOI:string>"
    held = spark.createDataFrame([(1, 1, rec("Old", "10.1/a")), (2, 2, rec("Other", None))], schema)
    new = spark.createDataFrame([(10, 1, rec("Old!", "https://doi.org/10.1/A/", vol="7")), (11, 2, rec("Old", "10.1/a")), (12, 3, rec("OTHER", None)), (13, 4, rec("New", "10.1/n")), (14, 5, rec("New again", "10.1/N")), (15, 6, rec("", None))], schema)
    assert {r.id: (r.action, r.fills) for r in library.import_plan(new, held).collect()} == {10: ("enrich", ["volume"]), 11: ("skipped", []), 12: ("review", []), 13: ("added", []), 14: ("skipped", []), 15: ("failed", [])}


def test_token_bucket_batch_equals_stream_step(spark, tmp_path):
    rows = [("k", i, float(t)) for i, t in enumerate([0, 0, 0, 1, 1, 10])] + [("j", 100, 5.0)]
    df = spark.createDataFrame(rows, "key string, event_id long, ts double")
    batch = sorted(tuple(r) for r in limits.token_bucket(df, 2.0, 0.5, 3).collect())
    assert [r[3] for r in batch if r[0] == "k"] == [True, True, False, False, False, True]
    assert next(r for r in batch if r[1] == 2)[4] == pytest.approx(2.0)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = limits.token_bucket_stream(stream, 2.0, 0.5).writeStream.format("memory").queryName("bucket").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    assert sorted(tuple(r) for r in spark.table("bucket").collect()) == batch


def test_tables_and_guards(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,=2\n,x\n")
    df = tables.read_table(spark, str(tmp_path / "x.csv"), tables.CAPS)
    assert [tuple(r) for r in df.collect()] == [("1", "=2"), (None, "x")]
    assert [r[0] for r in df.select(tables.guarded(F.col("b"))).collect()] == ['"\'=2"', '"x"']
    with pytest.raises(tables.Refused):
        tables.read_table(spark, "x.docx")
    with pytest.raises(ValueError, match="numeric_on_text:a"):
        described(df, Describe(numeric=("a",)))
    lines = ["Health Sciences", "", "J of X", "", "ISSN: 1234-567x | Quartile: Q1 | Frequency: y", "Publisher: P", "Website: w", "", "K of Y", "ISSN: 2"]
    got = tables.journal_directory(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, at int, line string")).orderBy("at").collect()
    assert [(r.title, r.category, r.publisher, r.quartile) for r in got] == [("J of X", "Health Sciences", "P", "Q1"), ("K of Y", "Health Sciences", "", "")]
    sps = "* a comment.\nT-TEST GROUPS=g(1 2)\n  /VARIABLES=y\n  /CRITERIA=CI(.95).\nFREQUENCIES x."
    procs = tables.syntax_procedures(spark.createDataFrame([("p", sps)], "path string, text string")).collect()
    assert [(r.kind, [s.name for s in r.subcommands]) for r in procs] == [("T-TEST GROUPS", ["VARIABLES", "CRITERIA"]), ("FREQUENCIES X", [])]


def test_relational(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 0)], "k int, v string, t int")
    assert sorted(tuple(r) for r in relational.upserted(old, new, ["k"], "t").collect()) == [(1, "a", 1), (2, "c", 1), (3, "d", 0)]
    cache = spark.createDataFrame([(1, 0, 10), (2, 0, 20)], "k int, created_at int, ttl_seconds int")
    stay, gone = relational.without_stale(cache, 10)
    assert [r.k for r in stay.collect()] == [2] and one(gone) == 1 and [r.k for r in relational.fresh(cache, 9).collect()] == [1, 2]
    spans = spark.createDataFrame([("d", 1, 4), ("d", 3, 6), ("d", 6, 7), ("d", 9, 10)], "doc string, start int, end int")
    assert sorted((r.start, r.end) for r in locate.merged_spans(spans, ("doc",)).collect()) == [(1, 7), (9, 10)]
    none = relational.stratified_share(old.withColumn("s", F.col("v")), old.where("k = 1").withColumn("s", F.col("v")), "s", F.lit(True)).first()
    assert none.share is None
    assert math.isclose(relational.precision_recall(old, F.col("k") > 0, F.col("k") == 1).first().precision, 0.5)


def test_tokens_of_whole_documents(spark, tmp_path):
    texts = ["Word " * 60 + "Last-Wörter x 12 a1", "short one", "", None, "a" * 300 + " beyond 77"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = lambda t: None if t is None else sorted({w for w in re.findall(r"[^\W_]+", t.lower()) if len(w) >= 2 and not re.fullmatch("[0-9]+", w)})
    assert {r.doc_id: r.tokens for r in QUERIES["tokens"](spark, str(tmp_path)).collect()} == {i: want(t) for i, t in enumerate(texts)}


def test_markers_of_all_pages(spark, tmp_path):
    pages = ["<p>1 &lt; 2 &gt; 0</p>", "<i>a</i> &#38; <b>b</b>&#160;c", "x &#x26; y &#X026; z", "a &amp; b&nbsp;c", "<p>plain</p>", "", None]
    want = ["1 < 2 > 0", "*a* & **b** c", "x & y & z", "a & b c", "plain", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r.page_id: r.text for r in QUERIES["markers_from_html"](spark, str(tmp_path)).collect()} == dict(enumerate(want))


def test_knn_without_its_query_row(spark, tmp_path):
    rows = [(i, [float(i), 1.0]) for i in range(20)]
    for name, some in (("all", rows), ("other", rows[:7]), ("none", [])):
        spark.createDataFrame(some, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / name / "embeddings.parquet"))
    found = {name: [tuple(r) for r in QUERIES["knn"](spark, str(tmp_path / name)).collect()] for name in ("all", "other", "none")}
    assert found["all"] == sorted(((i, float(abs(i - 7))) for i in range(20)), key=lambda x: (x[1], x[0]))[:10]
    assert found["other"] == found["none"] == []


def claims_of(spark, df, *claims):
    found = reproduced(spark, [(c, c.token("f")) for c in claims], "f", lambda: df)
    return {(r.claim_id, r.variant): r for r in found.collect()}


def test_rounding_of_stored_cells_can_explain_a_mismatch(spark):
    """Two honest papers whose deposits are rounded to one decimal, and the same numbers on exact data."""
    s1 = [("1.0", "a"), ("1.1", "a"), ("1.0", "a"), ("1.2", "b"), ("1.1", "b"), ("1.2", "b"), ("1.1", "c"), ("1.3", "c"), ("1.2", "c")]
    one = spark.createDataFrame(s1, "y string, g string")
    f = Claim("f", 1, "one_way", ("g", "y"), "17.66", ("a", "b", "c"))
    r = claims_of(spark, one, f)["f", "one_way"]
    assert (r.status, r.reason) == ("could_not_check", "data_precision:1") and r.computed == pytest.approx(4.2) and r.precision_lo <= 4.2 and r.precision_hi >= 17.657419
    two = spark.createDataFrame([("1.0", "2.0"), ("1.1", "2.2"), ("1.3", "2.5"), ("1.4", "2.8"), ("1.6", "3.2"), ("1.7", "3.3")], "x string, y string")
    r = claims_of(spark, two, Claim("r", 1, "pearson", ("x", "y"), ".96"))["r", "pearson"]
    assert (r.status, r.reason) == ("could_not_check", "data_precision:1") and r.computed == pytest.approx(0.996069, abs=1e-6) and r.precision_lo < 0.956247 < r.precision_hi
    exact = one.select(F.col("y").cast("double").alias("y"), "g")
    r = claims_of(spark, exact, f)["f", "one_way"]
    assert (r.status, r.reason) == ("not_matched", None) and r.precision_lo == r.precision_hi == r.computed
    r = claims_of(spark, exact, dataclasses.replace(f, decimals=(("y", 1),)))["f", "one_way"]
    assert r.reason == "data_precision:1"


def test_welch_refuses_students_numbers_on_exact_whole_numbers(spark):
    a, b = [10, 12, 11, 13, 12, 14], [15, 25, 9, 30, 12, 28, 20, 18]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, y int")
    pooled = (np.var(a, ddof=1) * 5 + np.var(b, ddof=1) * 7) / 12
    student = (np.mean(a) - np.mean(b)) / np.sqrt(pooled * (1 / 6 + 1 / 8))
    claim = Claim("w", 1, "independent_t", ("g", "y"), f"{student:.2f}", ("a", "b"), variant="welch", exact=("y",))
    found = claims_of(spark, df, claim, dataclasses.replace(claim, claim_id="rounded", exact=()), dataclasses.replace(claim, claim_id="both", variant=None), dataclasses.replace(claim, claim_id="other", variant="paired"))
    assert found["w", "welch"].status == "not_matched" and ("w", "student") not in found
    assert found["rounded", "welch"].precision_lo < found["rounded", "welch"].computed < found["rounded", "welch"].precision_hi
    assert found["both", "student"].status == "matched" and found["other", None].reason == "variant_not_available"


@pytest.mark.parametrize("seed", range(4))
def test_precision_intervals_hold_every_rounding(spark, seed):
    """Cells drawn at random within half a unit never leave the interval; the interval is not vacuous."""
    rng = np.random.default_rng(seed)
    n = 12
    x, g = np.round(rng.normal(5, 1, n), 1), np.array(["a", "b", "c"])[np.arange(n) % 3]
    y = np.round(0.7 * x + rng.normal(0, 0.6, n), 1)
    df = spark.createDataFrame([(str(i), f"{j:.1f}", f"{k:.1f}") for i, j, k in zip(g, x, y)], "g string, x string, y string")
    claims = [Claim("t", 1, "independent_t", ("g", "y"), "0", ("a", "b")), Claim("p", 1, "paired_t", ("x", "y"), "0"), Claim("f", 1, "one_way", ("g", "y"), "0", ("a", "b", "c")), Claim("r", 1, "pearson", ("x", "y"), "0")]
    found = claims_of(spark, df, *claims)

    def all_of(x, y):
        u, v = y[g == "a"], y[g == "b"]
        pooled = (u.var(ddof=1) * (len(u) - 1) + v.var(ddof=1) * (len(v) - 1)) / (len(u) + len(v) - 2)
        means = [y[g == k].mean() for k in "abc"]
        between, within = sum(4 * (m - y.mean()) ** 2 for m in means), sum(((y[g == k] - m) ** 2).sum() for k, m in zip("abc", means))
        return {
            ("t", "student"): (u.mean() - v.mean()) / np.sqrt(pooled * (1 / len(u) + 1 / len(v))), ("t", "welch"): (u.mean() - v.mean()) / np.sqrt(u.var(ddof=1) / len(u) + v.var(ddof=1) / len(v)),
            ("p", "paired"): (x - y).mean() / ((x - y).std(ddof=1) / np.sqrt(n)), ("f", "one_way"): between / 2 / (within / 9), ("r", "pearson"): np.corrcoef(x, y)[0, 1],
        }

    for k, v in all_of(x, y).items():
        assert found[k].computed == pytest.approx(v, rel=1e-9)
    for _ in range(300):
        e = [rng.choice([-0.05, 0.05], n) if rng.random() < 0.5 else rng.uniform(-0.05, 0.05, n) for _ in range(2)]
        for k, v in all_of(x + e[0], y + e[1]).items():
            assert found[k].precision_lo - 1e-9 <= v <= found[k].precision_hi + 1e-9, k
    assert all(abs(found[k].precision_hi - found[k].precision_lo) < 6 * abs(v) + 3 for k, v in all_of(x, y).items())


def test_claims_share_one_scan_and_count_what_they_drop(spark, tmp_path):
    rows = [("a", 1.0, "u", "x"), ("a", 2.0, "u", "x"), ("a", None, "u", "x"), ("b", 4.0, "u", "y"), ("b", 6.0, "v", "y"), ("c", 5.0, "u", "x"), (None, 5.0, "u", "y"), ("b", 5.5, "u", None)]
    spark.createDataFrame(rows, "g string, y double, f string, h string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    claims = [Claim(f"c{i}", 1, "independent_t", ("g", "y"), "1.0", ("a", "b"), filters=(("f", ("u",)),) if i % 2 else ()) for i in range(50)]
    pairs = [(c, c.token("f")) for c in [*claims, Claim("k", 1, "chi_square", ("g", "h"), "5.0", (("a", "b"), ("x", "y"))), Claim("few", 1, "independent_t", ("g", "y"), "1", ("a", "zz")), Claim("bad", 1, "independent_t", ("h", "g"), "1", ("x", "y"))]]
    found = reproduced(spark, pairs, "f", lambda: df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "Join" not in plan
    by = {(r.claim_id, r.variant): r for r in found.collect()}
    assert len(by) == 50 * 2 + 2 + 2 + 2
    r = by["c1", "student"]
    assert (r.rows_read, r.filtered_out, r.missing_in_bound_column, r.level_not_selected, r.n) == (8, 1, 2, 1, 4)
    assert (by["c0", "student"].filtered_out, by["c0", "student"].n) == (0, 5)
    assert by["k", "uncorrected"].status == "matched" and by["k", "uncorrected"].n == 5 and by["k", "yates"].computed == pytest.approx(1.7013888889)
    assert by["few", "welch"].reason == "too_few_complete_cases" and by["bad", "student"].reason == "not_numeric"
    empty = {r.reason for r in reproduced(spark, pairs, "f", lambda: df.limit(0)).collect()}
    assert empty <= {"too_few_complete_cases", "empty_row_or_column"}


def test_claims_of_ranks(spark):
    df = spark.createDataFrame([(float(i), float(i * i), "u") for i in range(9)] + [(3.0, 100.0, "v"), (None, 1.0, "u")], "x double, y double, f string")
    r = claims_of(spark, df, Claim("s", 1, "spearman", ("x", "y"), "1.00", filters=(("f", ("u",)),)))["s", "spearman"]
    assert (r.status, r.rows_read, r.filtered_out, r.missing_in_bound_column, r.n) == ("matched", 11, 1, 1, 9)


# The gate of requests

RULES = gate.Rules(capacity=3.0, rate=0.02, limit=6, first="new", moves={"new": ("open",), "open": ("held", "done"), "held": ("open",)}, idle=300.0)


def requests_of(seed=0, n=120):
    rng = np.random.default_rng(seed)
    rows = [(f"k{rng.integers(3)}", i, float(np.round(rng.uniform(0, 4000), 3)), [None, "open", "held", "done", "new"][rng.integers(5)]) for i in range(n)]
    return rows + [("k0", n, rows[0][2], "open"), (None, n + 1, 5.0, "open"), ("k1", n + 2, 40 * 86400.0, "open")]


def by_hand(rows):
    """The gate's rules written out once more, a request at a time."""
    out, state = [], {}
    for key, event, ts, to in sorted(rows, key=lambda r: (r[0] or "", r[2], r[1])):
        s = state.setdefault(key or "", {"tokens": 3.0, "at": ts, "used": {}, "status": "new"})
        s["tokens"] = 3.0 if ts - s["at"] > 300 else min(3.0, s["tokens"] + (ts - s["at"]) * 0.02)
        s["at"] = ts
        allowed = s["tokens"] >= 1
        s["tokens"] -= allowed
        month = int(ts // (31 * 86400))  # January 1970 and what comes after
        granted = allowed and s["used"].get(month, 0) < 6
        s["used"][month] = s["used"].get(month, 0) + granted
        accepted = granted and to in RULES.moves.get(s["status"], ())
        s["status"] = to if accepted else s["status"]
        out.append((key or "", event, allowed, granted, 6 - s["used"][month], accepted, s["status"]))
    return sorted(out)


def short(rows):
    return sorted((r.key, r.event_id, r.allowed, r.granted, r.quota_remaining, r.accepted, r.status) for r in rows)


def test_gate_over_a_table(spark):
    rows = requests_of()
    df = spark.createDataFrame(rows, "key string, event_id long, ts double, to string")
    found = gate.decided(df, RULES, 3).collect()
    assert short(found) == by_hand(rows)
    assert {r.granted for r in found} == {True, False} and any(r.accepted for r in found) and any(r.allowed and not r.granted for r in found)
    assert all(r.retry_after == 0 if r.allowed else r.retry_after > 0 for r in found)
    assert gate.decided(df.limit(0), RULES, 3).count() == 0


def test_gate_over_a_stream_is_that_over_the_table(spark, tmp_path):
    """Shuffled micro-batches, a stop between them and a restart from the checkpoint give the table's answers."""
    rows = requests_of(1)
    order = np.random.default_rng(5).permutation(len(rows) - 1)  # the last request, far ahead, comes last
    shuffled = [rows[i] for i in order] + [rows[-1]]
    schema = "key string, event_id long, ts double, to string"
    want = by_hand(rows)
    (tmp_path / "in").mkdir()
    for part in (0, 1):
        for i in range(part, 4, 2):
            cut = shuffled[i * len(shuffled) // 4 : (i + 1) * len(shuffled) // 4] if part == 0 or i < 3 else shuffled[3 * len(shuffled) // 4 :] + [("end", 10**6, 80 * 86400.0, None)]
            spark.createDataFrame(cut, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = gate.decided_stream(stream, RULES, late="2 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
    found = [r for r in short(spark.read.parquet(str(tmp_path / "out")).collect()) if r[0] != "end"]
    assert found == want


def test_word_measures_equal_the_column_functions(spark):
    from plumbline.functions import text

    plain = "The\u212aing of\x1fthe la--la; 7 seas, " * 3
    rows = [(i, t) for i, t in enumerate([None, "", "  ", "One", "two words", plain, plain * 40, "\u0130x \u03a3\u03a3 de\x85la la", *(f"w{i} x y z" * i for i in range(1, 12))] * 20)]
    df = spark.createDataFrame(rows, "id long, t string").coalesce(1)
    w = text.normal_words(F.col("t"))
    m = df.select(text.word_measures(F.col("t"), ("the", "la"), ("la", "de", "no"), 3).alias("m"), w.alias("w"))
    same = F.col("m.stopwords").eqNullSafe(text.stopword_share(F.col("w"), ("the", "la"))) & F.col("m.distinct").eqNullSafe(text.distinct_ngram_share(F.col("w"))) & F.col("m.terms").eqNullSafe(text.distinctive_terms(F.col("w"), 3))
    shared = F.size(text.overlap(F.array_distinct("w"), F.array(*map(F.lit, ("la", "de", "no"))))).cast("long")
    assert m.where(~(same & F.col("m.shared").eqNullSafe(shared))).isEmpty()


def test_arrow_functions_take_some_rows_at_a_time():
    import pyarrow as pa

    from plumbline.functions import text

    slices = list(text.in_slices(pa.array([*map(str, range(300)), None])))
    assert max(map(len, slices)) <= text.TOGETHER and sum(slices, []) == [*map(str, range(300)), None]
