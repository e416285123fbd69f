"""Spans, intervals, places, search, wording, features, quantiles and passages against brute force."""

import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions import features, intervals, numbers, places, wording
from plumbline.operators import filters, locate, quantiles, stats, vector, verbatim

# Shared spans


def spans_by_hand(mine, theirs, least, same):
    """Maximal equal runs on every diagonal."""
    a, b = mine.split(), theirs.split()
    out = []
    for d in range(-len(b) + 1, len(a)):
        if same and d >= 0:
            continue
        i, run = max(d, 0), 0
        while i <= len(a):
            if i < len(a) and 0 <= i - d < len(b) and a[i] == b[i - d]:
                run += 1
            else:
                if run >= least:
                    out.append((i - run, i, i - run - d, i - d))
                run = 0
            i += 1
    return sorted(out)


@pytest.mark.parametrize("same", [False, True])
def test_shared_spans(spark, same):
    rng = random.Random(3)
    word = lambda: rng.choice(["ab", "cd", "ef", "gh", "é", "😀x"])
    base = [word() for _ in range(60)]
    docs = {i: " ".join([word() for _ in range(20)] + base[i : i + 25] + [word() for _ in range(20)] + base[5:20]) for i in range(6)}
    refs = {i: " ".join([word() for _ in range(5)] + base[i * 4 : i * 4 + 30]) for i in range(4)}
    left = spark.createDataFrame([*docs.items(), (90, None), (91, ""), (92, "ab cd"), (None, docs[0])], "id long, text string")
    right = spark.createDataFrame([*refs.items(), (90, None), (91, " ")], "id long, text string")
    found = verbatim.shared_spans(left, None if same else right, shingle=3, window=3).collect()
    got = {}
    for r in found:
        text = docs[r.doc].split()
        other = (docs if same else refs)[r.ref]
        assert text[r.start : r.end] == other.split()[r.ref_start : r.ref_end] and r.words == r.end - r.start >= 5
        assert docs[r.doc][r.start_char : r.end_char].split() == text[r.start : r.end] and other[r.ref_start_char : r.ref_end_char].split() == text[r.start : r.end]
        got.setdefault((r.doc, r.ref), []).append((r.start, r.end, r.ref_start, r.ref_end))
    for i, text in docs.items():
        for j, other in ([(i, text)] if same else refs.items()):
            assert sorted(got.get((i, j), [])) == spans_by_hand(text, other, 5, same)
    assert verbatim.shared_spans(left.limit(0), right).count() == 0


def test_what_a_text_repeats_is_not_shuffled(spark, capsys):
    docs = spark.createDataFrame([(1, "a b c d e f g h " * 3), (2, "a " * 40), (3, None), (4, "x y")], "id long, text string")
    found = verbatim.shared_spans(docs)
    found.explain()
    assert "Exchange" not in capsys.readouterr().out
    got = sorted((r.doc, r.start, r.end, r.ref_start) for r in found.collect())
    assert got == [(1, 0, 8, 16), (1, 0, 16, 8), *sorted((2, 0, 40 - d, d) for d in range(1, 33))]


def test_documents_are_read_twice(spark):
    """Once for their prints and once for the texts that share any: the prints are not found again for the filter."""
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    passage = "a b c d e f g h i j"
    docs = spark.createDataFrame([(k, f"{k} {passage if k % 5 == 0 else ''} {k}") for k in range(40)], "id long, text string").mapInArrow(counted, "id long, text string")
    found = verbatim.shared_spans(docs, spark.createDataFrame([(1, passage)], "id long, text string")).collect()
    assert sorted((r.doc, r.start, r.end) for r in found) == [(k, 1, 11) for k in range(0, 40, 5)]
    assert rows.value == 80


@pytest.mark.parametrize("together", [1, 7, 40, 1 << 17])
def test_words_of_many_texts_at_once(monkeypatch, together):
    """Words, their hashes and the winnowed shingles are those of each text by itself, in whatever groups texts are taken."""
    rng = random.Random(together)
    monkeypatch.setattr(verbatim, "BYTES_TOGETHER", together)
    texts = ["".join(rng.choice(["a", "B", "b", " ", "\n", "é", "\x0b", "\x1c", "\u2003", "😀"]) for _ in range(rng.choice([0, 1, 4, 30, 80]))) if k % 9 else None for k in range(300)]
    hashes, seen = {}, 0
    for i, data, edges in verbatim.together(pa.array(["x", *texts], pa.string())[1:]):
        starts, ends = verbatim.word_edges(data, edges)
        first = np.searchsorted(starts, edges)
        of = np.repeat(np.arange(len(edges) - 1), np.diff(first))
        found = verbatim.hashes_between(data, starts, ends)
        prints, at = verbatim.chosen(found, 3, 2, of)
        for k in range(len(edges) - 1):
            mine = slice(first[k], first[k + 1])
            words = [bytes(data[a:b]).lower() for a, b in zip(starts[mine], ends[mine], strict=True)]
            assert words == verbatim.WORD.findall(verbatim.lowered(texts[i + k]))
            assert all(hashes.setdefault(w, h) == h for w, h in zip(words, found[mine].tolist(), strict=True))
            shingles = [p for _, p in sorted(zip(at[of[at] == k].tolist(), prints[of[at] == k].tolist(), strict=True))]
            alone, places = verbatim.chosen(found[mine], 3, 2)
            assert shingles == alone.tolist() and (at[of[at] == k] - first[k]).tolist() == places.tolist() and (len(words) >= 3) == (len(alone) > 0)
            seen += 1
    assert seen == len(texts) and len(set(hashes.values())) == len(hashes) > 20


def test_chosen_shingles_are_the_last_least_of_each_window():
    rng = np.random.default_rng(5)
    for n in range(12):
        hashes = rng.integers(0, 3, n).astype(np.uint64)
        every, at = verbatim.chosen(hashes, 2, 1)
        assert at.tolist() == list(range(n - 1)) or n == 0
        size = min(4, len(every))
        wanted = sorted({max(range(i, i + size), key=lambda j: (-int(every[j]), j)) for i in range(len(every) - size + 1)}) if size else []
        assert verbatim.chosen(hashes, 2, 4)[1].tolist() == wanted


def test_word_count(spark):
    texts = ["a  b\tc\n", "", None, " ", "é\u2003x y", "\x1ca b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", verbatim.word_count(F.col("t")).alias("n")).collect()
    assert {r.k: r.n for r in rows} == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(texts)}


def test_prints_that_agree_by_chance_give_no_span():
    assert verbatim.extended([b"a", b"b"], [b"c", b"b"], [(0, 0)], False) == []


def test_duplication(spark):
    spans = spark.createDataFrame([(1, 0, 8), (1, 4, 10), (1, 20, 30)], "doc long, start long, end long")
    rows = verbatim.duplication(spans, spark.createDataFrame([(1, 40), (2, 5), (3, 0)], "doc long, words long")).collect()
    assert {r.doc: (r.covered, r.ratio) for r in rows} == {1: (20, 0.5), 2: (0, 0.0), 3: (0, 0.0)}


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_filter_keeps_every_key(spark, bits):
    rows = spark.range(2000).withColumnRenamed("id", "k")
    kept = {r.k for r in filters.maybe_in(rows, "k", spark.range(0, 2000, 7).withColumnRenamed("id", "k"), bits).collect()}
    assert set(range(0, 2000, 7)) <= kept and (bits == 64 or len(kept) < 700)


# Intervals


def interval_by_hand(text, at):
    """Python's own evaluation over a class of intervals."""

    class I:  # noqa: E742
        def __init__(self, lo, hi):
            self.lo, self.hi = lo, hi

        def __add__(self, o):
            return I(self.lo + o.lo, self.hi + o.hi)

        def __neg__(self):
            return I(-self.hi, -self.lo)

        def __sub__(self, o):
            return self + -o

        def __mul__(self, o):
            ends = [a * b for a in (self.lo, self.hi) for b in (o.lo, o.hi)]
            return I(min(ends), max(ends))

        def __truediv__(self, o):
            if o.lo <= 0 <= o.hi:
                raise ZeroDivisionError
            return self * I(1 / o.hi, 1 / o.lo)

    r = eval(text, {}, {k: I(*v) for k, v in at.items()})  # noqa: S307
    return r.lo, r.hi


def test_expressions_over_intervals(spark):
    rng = random.Random(1)
    names, prints = ("a", "b", "c"), ["1.0", "-2.50", "3", "0.04", "-0.3", "12.125", "0.0"]
    rows = []
    for _ in range(150):
        text = rng.choice(names)
        for _ in range(rng.randint(1, 4)):
            text = rng.choice([f"({text}) {rng.choice('+-*/')} {rng.choice(names)}", f"{rng.choice(names)} {rng.choice('+-*/')} ({text})", f"-({text})"])
        rows.append((text, {n: rng.choice(prints) for n in names}))
    df = spark.createDataFrame(rows, "e string, m map<string,string>")
    for r in df.select("e", "m", intervals.evaluated(F.col("e"), F.col("m")).alias("i")).collect():
        at = {k: intervals.of_literal(v, measured=True) for k, v in r.m.items()}
        try:
            lo, hi = interval_by_hand(r.e, at)
            assert r.i.reason is None and r.i.lo <= lo and r.i.hi >= hi and float(hi - lo) == pytest.approx(float(r.i.hi - r.i.lo), abs=1e-9)
        except ZeroDivisionError:
            assert r.i.reason == "division_by_zero"


@pytest.mark.parametrize(("text", "lo", "hi", "reason"), [
    ("x^2", -2, 4, None), ("x - x", -3, 3, None), ("1 + 2^3", 9, 9, None), ("0.5", "0.45", "0.55", None), ("1,000 + 1", 1001, 1001, None), ("2^-2", "0.25", "0.25", None), ("x^-1", None, None, "division_by_zero"),
    ("y^(1+1)", 4, 9, None), ("x^0", 1, 1, None), ("1 / (y - y)", None, None, "division_by_zero"), ("sqrt(y)", None, None, "irrational_root"), ("sin(y)", None, None, "unsupported_function"), ("y^x", None, None, "non_integer_exponent"),
    ("y^0.5", None, None, "non_integer_exponent"), ("z", None, None, "unbound_variable"), ("y +", None, None, "unreadable"), ("y^999", None, None, "overflow"), (None, None, None, "unreadable"), ("y // 2", None, None, "unreadable"),
])
def test_reasons_of_intervals(text, lo, hi, reason):
    try:
        node, prints = intervals.tree(text or "")
        at = {"x": (Fraction(-1), Fraction(2)), "y": (Fraction(2), Fraction(3))} | {k: intervals.of_literal(v) for k, v in prints.items()}
        assert intervals.value(node, at) == (Fraction(lo), Fraction(hi)) and reason is None
    except intervals.Undefined as e:
        assert str(e) == reason
    except SyntaxError:
        assert reason == "unreadable"


def test_powers_in_their_true_range():
    assert intervals.power((Fraction(-1), Fraction(2)), 2, True) == (0, 4) and intervals.power((Fraction(-1), Fraction(2)), 3, True) == (-1, 8) and intervals.power((Fraction(-3), Fraction(-2)), 2, True) == (4, 9)


@pytest.mark.parametrize("text", ["a*b + 0.5", "a / b", "(a - b)^2", "a^3 - 2*a", "-a / (b^2)", "1/(a - a)", "b^-1 + a^0"])
def test_compiled_encloses_evaluated(spark, text):
    df = spark.createDataFrame([("1.50", "2.25"), ("-3.1", "0.5"), ("0.04", "7")], "a string, b string")
    cols = {c: numbers.measured(F.col(c)) for c in "ab"}
    for r in df.select(intervals.compiled(text, cols).alias("c"), intervals.evaluated(F.lit(text), F.create_map(F.lit("a"), "a", F.lit("b"), "b")).alias("e")).collect():
        assert (r.c is None) == (r.e.reason is not None)
        if r.c:
            assert r.c.lo <= r.e.lo and r.c.hi >= r.e.hi and float(r.c.hi - r.c.lo) == pytest.approx(float(r.e.hi - r.e.lo), abs=1e-3)


# Places


def test_places_in_utf16(spark):
    texts = ["", "abc", "😀", "a😀b🎉🎉c", "🎉" * 5 + "é"]
    rows = [(t, u) for t in texts for u in range(-1, 2 * len(t) + 2)]
    df = spark.createDataFrame(rows, "t string, u int").withColumn("a", places.astral_places(F.col("t")))
    for r in df.select("t", "u", places.from_utf16(F.col("u"), F.col("a"), F.length("t")).alias("c"), places.utf16_length(F.col("t")).alias("n"), "a").collect():
        raw = r.t.encode("utf-16-le")
        want = None
        if 0 <= r.u * 2 <= len(raw):
            try:
                want = len(raw[: r.u * 2].decode("utf-16-le"))
            except UnicodeDecodeError:
                want = None
        assert (r.c, r.n) == (want, len(raw) // 2) and r.a == [i for i, c in enumerate(r.t) if ord(c) > 0xFFFF]


@pytest.mark.parametrize(("text", "url", "title", "start", "end", "want"), [
    ("see https://bmj.com/x now", "https://bmj.com/x", "T", 4, 21, (4, 21, "code_points", None)),
    ("😀😀😀😀😀😀 bmj.com now ok", "https://bmj.com/x", "T", 13, 20, (7, 14, "utf16", None)),
    ("a Title of work", "https://bmj.com/x", " TITLE ", 2, 7, (2, 7, "code_points", None)),
    ("😀", "https://bmj.com/x", "T", 1, 1, (None, None, None, "range_does_not_name_source")),
    ("bmj.com", "https://bmj.com/x", "T", 5, 2, (None, None, None, "range_outside_text")),
    ("bmj.com", "https://bmj.com/x", "T", 0, 99, (None, None, None, "range_outside_text")),
    ("bmj.com", "https://www.bmj.com./x", "T", 0, 7, (None, None, None, "range_does_not_name_source")),
    ("x", "https://notbmj.com", "T", 0, 1, (None, None, None, "domain_not_allowed")),
    ("x", "http://bmj.com", "T", 0, 1, (None, None, None, "not_https")), ("x", "https://a:1/", "T", 0, 1, (None, None, None, "bad_host")), ("x", "https:///p", "T", 0, 1, (None, None, None, "bad_host")),
    (None, "https://bmj.com", "T", 0, 1, (None, None, None, "malformed")), ("x", "https://bmj.com", None, 0, 1, (None, None, None, "malformed")), ("x", "https://bmj.com", "T", -1, 1, (None, None, None, "malformed")),
])
def test_placed(spark, text, url, title, start, end, want):
    df = spark.createDataFrame([(text, url, title, start, end)], "t string, u string, n string, s int, e int")
    r = df.select(places.placed(*(F.col(c) for c in ("t", "u", "n", "s", "e")), hosts=("bmj.com",)).alias("p")).first().p
    assert (r.start, r.end, r.unit, r.reason) == want


def test_citations_of_sentences(spark):
    """Inside, between, before the first, over three sentences, and link text that passes on its citations."""
    sentences = spark.createDataFrame([(1, 0, 0, 10, "Words one."), (1, 1, 12, 20, "(bmj.co)"), (1, 2, 22, 30, "Last one"), (1, 3, 32, 36, "1, 2"), (2, 0, 5, 9, "Solo")], "doc long, seq long, s0 long, s1 long, text string")
    cites = [(1, 0, 2, 5), (1, 1, 12, 20), (1, 2, 20, 22), (1, 3, 0, 30), (1, 4, 8, 24), (1, 5, 33, 34), (2, 6, 0, 3), (2, 7, 6, 6), (3, 8, 0, 1), (1, 9, 50, 60)]
    found = {r.cite: (r.seq, r.reason) for r in locate.sentence_of_citation(spark.createDataFrame(cites, "doc long, cite long, start long, end long"), sentences).collect()}
    assert found == {0: (0, None), 1: (0, None), 2: (0, None), 3: (None, "wide"), 4: (None, "wide"), 5: (2, None), 6: (None, "none"), 7: (0, None), 8: (None, "none"), 9: (2, None)}
    plain = {r.cite: r.seq for r in locate.sentence_of_citation(spark.createDataFrame(cites, "doc long, cite long, start long, end long"), sentences.drop("text")).collect()}
    assert plain[1] == 1 and plain[5] == 3
    plan = locate.sentence_of_citation(spark.createDataFrame(cites, "doc long, cite long, start long, end long"), sentences.drop("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_citations_are_shuffled_once(spark):
    """Also with texts; a citation that is there twice counts its sentences twice, and one row is returned."""
    sentences = spark.createDataFrame([(1, 0, 0, 10, "Words one."), (1, 1, 12, 20, "(bmj.co)"), (1, 2, 20, 30, "Last one")], "doc long, seq long, s0 long, s1 long, text string")
    cites = spark.createDataFrame([(1, 0, 2, 5), (1, 0, 2, 5), (1, 1, 8, 14), (1, 1, 8, 14), (1, 2, 12, 20), (1, 3, 20, 21), (None, 4, 1, 2)], "doc long, cite long, start long, end long")
    df = locate.sentence_of_citation(cites, sentences)
    assert sorted(tuple(r)[1:] for r in df.collect()) == [(0, 0, None), (1, None, "wide"), (2, 0, None), (3, 2, None), (4, None, "none")]
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


# Search


def test_search_in_parts_gives_what_one_part_gives(spark, monkeypatch, capsys):
    rng = random.Random(4)
    odd = {3: None, 5: [0.0, 0.0], 7: [1.0], 9: [1.0, None], 11: [float("nan"), 1.0]}
    rows = [(i, rng.choice(["alpha beta", "gamma", "delta 12", None]), odd.get(i, [float(i % 4), 0.1])) for i in range(60)]
    chunks = spark.createDataFrame(rows, "cid long, text string, vector array<double>")
    asked = chunks.where("cid % 6 < 3").withColumnRenamed("cid", "qid")
    for where in (None, F.col("cid") < 3):
        whole = vector.semantic_search(asked, chunks, 4, where=where).orderBy("qid", "rank").collect()
        monkeypatch.setattr(vector, "BLOCK_QUERIES", 7)
        monkeypatch.setattr(vector, "PART_CHUNKS", 9)
        found = vector.semantic_search(asked, chunks, 4, where=where)
        assert str(found.orderBy("qid", "rank").collect()) == str(whole) and len(whole) > 20
        monkeypatch.undo()
    found.explain()
    assert "CartesianProduct" not in (plan := capsys.readouterr().out) and "NestedLoop" not in plan


def test_semantic_search(spark):
    rng = np.random.default_rng(2)
    words = ["alphabetical", "bordering", "cat", "dog", "encyclopaedia", "frog"]
    chunks = [(i, " ".join(rng.choice(words, 3)), [float(x) for x in np.round(rng.normal(size=4), 2)], "ab"[i % 2]) for i in range(60)] + [(60, None, [1.0, 0.0, 0.0, 0.0], "a"), (61, "cat", None, "a"), (62, "frog", [1.0], "a")]
    queries = [(0, "encyclopaedia cat", [1.0, 2.0, 0.0, 1.0]), (1, "nothing known", [0.5, -1.0, 0.0, 1.0]), (2, None, [0.0, 0.0, 1.0, 0.0]), (3, "cat", None), (4, "frog dog bordering alphabetical cat", [1.0, 1.0, 1.0, 1.0])]
    q, c = spark.createDataFrame(queries, "qid long, text string, vector array<double>"), spark.createDataFrame(chunks, "cid long, text string, vector array<double>, kind string")

    def cosine(a, b):
        return 0.0 if len(a) != len(b) else float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))

    for where, keep in ((None, lambda k: True), (F.col("kind") == "a", lambda k: k == "a")):
        got = {}
        for r in vector.semantic_search(q, c, 4, where=where).collect():
            got.setdefault(r.qid, []).append((r["rank"], r.cid, round(r.score, 9), r.via))
        for qid, text, v in queries:
            if v is None:
                assert qid not in got
                continue
            tokens = sorted({t for t in re.split(r"\W+", (text or "").lower()) if len(t) >= 2})
            gate = sorted(tokens, key=lambda t: (-len(t), tokens.index(t)))[:4]
            pool = [(i, t, x) for i, t, x, k in chunks if keep(k) and x is not None]
            hits = [(i, x) for i, t, x in pool if set(gate) & set((t or "").split())]
            via, hits = ("lexical", hits) if len(hits) >= 4 else ("all", [(i, x) for i, _, x in pool])
            want = sorted(((-round(cosine(v, x), 9), i) for i, x in hits))[:4]
            assert sorted(got[qid]) == [(n, i, -s, via) for n, (s, i) in enumerate(want, 1)]


# Wording

#: Phrases and what they say, by the rule that is tested.
T_VARIANTS = {
    "Equal variances were not assumed; the groups differed, t(15) = -1.35, p = .198.": "welch", "Student participants in group A differed from group B, t(15) = -1.35, p = .198.": None,
    "With data pooled across sites, the groups differed, t(15) = -1.35, p = .198.": None, "Without a pooled variance estimate, the groups differed, t(15) = -1.35, p = .198.": None,
    "Assuming unequal variances, the groups differed, t(15) = -1.35, p = .198.": "welch", "A Student's t-test showed a difference, t(21) = 0.98, p = .34.": "student", "A Student’s t test showed a difference, t(21) = 0.98, p = .34.": "student",
    "A Students' t-test showed a difference, t(21) = 0.98, p = .34.": "student", "The student sample differed by group, t(21) = 0.98, p = .34.": None, "Each student's score was higher in group A, t(21) = 0.98, p = .34.": None,
    "A pooled-variance t-test gave t(21) = 0.98, p = .34.": "student", "A t-test with pooled variances gave t(21) = 0.98, p = .34.": None, "The pooled SD was 2.1, and the groups differed, t(21) = 0.98, p = .34.": None,
    "Equal variances not assumed, t(15) = -1.35, p = .198.": "welch", "Not assuming equal variances, the groups differed, t(15) = -1.35, p = .198.": "welch", "We did not use Welch's correction; t(21) = 0.98, p = .34.": None,
    "Welch's correction was not applied, t(21) = 0.98, p = .34.": None, "We used Welch's t-test rather than Student's t-test, t(15) = -1.35, p = .198.": "welch", "Assuming equal variances, the groups differed, t(21) = 0.98, p = .34.": "student",
    "We could not confirm that the groups had equal variances, t(21) = 0.98, p = .34.": None, "Welch's t-test, which does not assume equal variances, gave t(15) = -1.35, p = .198.": "welch", "Student's t-test and Welch's t-test both gave t(21) = 0.98, p = .34.": None,
}
CONTINUITY = {
    "Without Yates' correction, response differed by sex, χ2(1) = 4.08, p = .043.": "uncorrected", "Without continuity correction, response differed by sex, χ2(1) = 4.08, p = .043.": "uncorrected", "An uncorrected chi-square test gave χ2(1) = 4.08, p = .043.": "uncorrected",
    "Uncorrected p values are reported; χ2(1) = 4.08, p = .043.": None, "With Yates' correction, response differed by sex, χ2(1) = 3.06, p = .080.": "yates", "No continuity correction was applied, χ2(1) = 4.08, p = .043.": None,
    "A continuity-corrected chi-square gave χ2(1) = 3.06, p = .080.": "yates", "Yates' correction was not applied, χ2(1) = 4.08, p = .043.": None,
}
ONE_TAILED = {
    "We did not use one-tailed tests.": False, "No one-tailed tests were used.": False, "One-tailed tests were not used.": False, "One-tailed tests were used.": True, "Tests were one-tailed, not two-tailed.": True, "We tested a directional hypothesis.": False,
    "One-sided 95% confidence intervals were computed; tests were two-sided.": False, "Although no outliers were found, one-tailed tests were used.": False, "Rather than one-tailed tests, two-tailed tests were used.": False,
    "One-tailed tests, however, were not used.": False, "We report a one-sided 95% CI for the difference.": False, "We computed one-sided confidence bounds.": False,
}
ADJUSTED = {
    "P values were FDR-corrected.": True, "P values were corrected for multiple comparisons.": True, "Sphericity was violated, so Greenhouse-Geisser corrected degrees of freedom are reported.": False, "P values were not corrected for multiple comparisons.": False,
    "The procedure is described elsewhere (Benjamini & Hochberg, 1995).": False, "The Holm–Bonferroni method was used.": True, "Holmes et al. (2010) reported a similar effect.": False, "Holm (1979) proposed a sequential method.": False, "Tukey's HSD post hoc tests followed.": True,
    "As Tukey (1977) argued, the data were plotted first.": False, "No significant effects survived Bonferroni correction.": True, "Uncorrected p values are reported.": False, "A Bonferroni correction was not applied.": False, "We report bias-corrected bootstrap intervals.": False,
    "Bonferroni correction did not change the results.": True, "Results were similar with and without Bonferroni correction.": True, "No Bonferroni correction was applied.": False, "A Bonferroni correction, as planned, was not applied.": False, "Genes with padj < .05 were kept.": True,
}


def test_words_of_methods(spark):
    phrases = [*T_VARIANTS, *CONTINUITY, *ONE_TAILED, *ADJUSTED, None, ""]
    df = spark.createDataFrame([(p,) for p in phrases], "s string")
    found = {r.s: r.w for r in df.select("s", wording.sentence_methods(F.col("s"), F.lit("t")).alias("w")).collect()}
    for table, c in ((T_VARIANTS, "t_variant"), (CONTINUITY, "continuity"), (ONE_TAILED, "one_tailed"), (ADJUSTED, "adjusted")):
        assert {p: found[p][c] for p in table} == table
    assert found[None].t_variant is None and not found[""].adjusted


@pytest.mark.parametrize(("family", "text", "want"), [
    ("t", "a paired design", ["paired_t", "independent_t"]), ("t", "paired and independent samples", ["independent_t", "paired_t"]), ("f", "a regression of y", ["ols", "one_way"]), ("f", "one-way ANOVA", ["one_way", "ols"]),
    ("r", "Spearman's rho", ["spearman", "pearson"]), ("chi_square", "", ["chi_square"]), ("z", "paired", []), (None, "paired", []), ("t", "not paired", ["independent_t", "paired_t"]),
])
def test_methods_of_a_family(family, text, want):
    assert wording.methods(family, wording.said_by(text)) == want


# Features


def test_mtld_by_hand():
    def one_way(words):
        count, start = 0.0, 0
        for end in range(1, len(words) + 1):
            if len(set(words[start:end])) <= 0.72 * (end - start):
                count, start = count + 1, end
        rest = words[start:]
        return count + ((1 - len(set(rest)) / len(rest)) / 0.28 if rest else 0)

    rng = random.Random(6)
    for n in (100, 137, 400):
        words = [f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(n)]
        assert features.mtld(words) == pytest.approx((n / one_way(words) + n / one_way(words[::-1])) / 2)
    assert features.mtld(["a"] * 99) is None and features.mtld([f"w{i}" for i in range(120)]) == 120


def test_document_features(spark):
    text = "The cat — the dog — sat. It sat [1, 2] and it sat [3] on the mat (Doe, 1999). On the mat of the cat."
    refs = ["10.1234/abc def", "doi: bad", None, "Doe 1999"]
    df = spark.createDataFrame([(text, refs), (None, refs), ("", None), ("No citation here at all.", refs), ("one", [])], "t string, r array<string>")
    a, none, empty, uncited, single = (r.f for r in df.select(features.document_features(F.col("t"), F.col("r"), ("the", "it", "of"), ("on the", "of the", "absent")).alias("f")).collect())
    words = re.findall(r"[^\W_]+", text.lower())
    grams = list(zip(words, words[1:], words[2:]))
    lengths = [len(re.findall(r"[^\W_]+", s)) for s in text.split(".") if s.strip()]
    assert a.sentence_length_cv == pytest.approx(np.std(lengths) / np.mean(lengths)) and a.function_word_ratio == pytest.approx(sum(w in ("the", "it", "of") for w in words) / len(words))
    assert a.em_dash_per100 == pytest.approx(200 / len(words)) and a.ngram_repetition == pytest.approx(1 - len(set(grams)) / len(grams)) and a.template_density == pytest.approx(300 / len(words))
    assert a.citation_density == pytest.approx(3000 / len(words)) and a.citation_style_consistency == pytest.approx(2 / 3) and a.doi_syntax_validity == 0.5 and a.mtld is None
    assert all(v is None for v in none) and empty.function_word_ratio is None and uncited.citation_density is None and single.sentence_length_cv is None and single.ngram_repetition is None


# Quantiles


@pytest.mark.parametrize("kind", ["spread", "ties", "outlier", "few"])
def test_selected_quantiles(spark, kind):
    rng = np.random.default_rng(7)
    n = 5 if kind == "few" else 60_000
    x = {"spread": rng.normal(size=n), "ties": rng.integers(0, 3, n).astype(float), "outlier": np.where(np.arange(n) == 5, 1e12, rng.random(n)), "few": rng.random(n)}[kind]
    keys = [None if i % 10 == 0 else f"g{i % 3}" if i % 7 else "rare" if i < 40 else "g0" for i in range(n)]
    df = spark.createDataFrame([(k, float(v)) for k, v in zip(keys, x)] + [("g0", None), ("only null", None)], "g string, x double")
    shares = (0.0, 0.1, 0.5, 0.937, 1.0)
    found = {r.g: r for r in quantiles.selected(df, ["g"], "x", [(f"p{i}", s, f) for i, (s, f) in enumerate((s, f) for s in shares for f in (quantiles.floor_position, quantiles.ceiling_position, quantiles.nearest_position))]).collect()}
    assert set(found) == set(keys)
    for g in set(keys):
        own = np.sort(x[[k == g for k in keys]])
        at = [p for s in shares for p in (int(np.floor((len(own) - 1) * s)), int(np.ceil((len(own) - 1) * s)), int(np.floor((len(own) - 1) * s + 0.5)))]
        assert found[g].n == len(own) and [found[g][f"p{i}"] for i in range(15)] == own[at].tolist()
    whole = quantiles.selected(df, [], "x", [("m", 0.5, quantiles.floor_position)]).first()
    assert whole.m == np.sort(x)[(n - 1) // 2] and quantiles.selected(df.limit(0), ["g"], "x", [("m", 0.5, quantiles.floor_position)]).count() == 0


@pytest.mark.parametrize("off", [-0.05, 0.003, 0.4])
def test_selected_quantiles_where_the_sketch_is_off(spark, monkeypatch, off):
    sketch = quantiles.F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda x, ends, accuracy: sketch(x, [min(1.0, max(0.0, e + off)) for e in ends], accuracy))
    df = spark.range(0, 30_000, 1, 4).select((F.col("id") % 2).alias("g"), F.pmod(F.col("id") * 7919, F.lit(1_000_003)).alias("x"))
    found = quantiles.selected(df, ["g"], "x", [("a", 0.1, quantiles.nearest_position), ("m", 0.5, lambda n, _: F.floor(n / 2))]).collect()
    for r in found:
        own = sorted(i * 7919 % 1_000_003 for i in range(r.g, 30_000, 2))
        assert (len(found), r.n, r.a, r.m) == (2, 15_000, own[1500], own[7500])


def test_summary_quartiles_by_selection(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=40_003), np.full(30_000, 0.25)])
    df = spark.createDataFrame([(float(v), float(i % 4)) for i, v in enumerate(x)], "x double, y double")
    r = {r.column: r for r in stats.numeric_summary(df, ["x", "y"]).collect()}
    assert [r["x"].q1, r["x"].median, r["x"].q3] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.75]).tolist(), abs=1e-12)
    assert [r["y"].q1, r["y"].median, r["y"].q3] == pytest.approx(np.quantile(np.arange(len(x)) % 4, [0.25, 0.5, 0.75]).tolist(), abs=1e-12)


# Passages


def placed_by_hand(sections, passages):
    used, out = set(), {}
    for section, kind, text in sorted(sections):
        at = 0
        for start, idx, k, words in sorted((p[3], p[0], p[1], p[2]) for p in passages):
            if k != kind or idx in used:
                continue
            place = text.find(words, at)
            if place >= 0:
                used.add(idx)
                out[idx] = (section, place)
                at = place + len(words)
    return {p[0]: out.get(p[0], (None, None)) for p in passages}


def test_passages_are_placed_in_order(spark):
    rng = random.Random(9)
    for trial in range(3):
        sections = [(i, rng.choice("ab"), "".join(rng.choice("xy ") for _ in range(25))) for i in range(4)]
        passages = [(i, rng.choice("abc"), "".join(rng.choice("xy ") for _ in range(rng.randint(0, 3))) or ("absent" if i % 2 else ""), rng.randint(0, 5)) for i in range(14)]
        s = spark.createDataFrame([(trial, *x) for x in sections], "doc long, section long, kind string, text string")
        p = spark.createDataFrame([(trial, i, k, t, at) for i, k, t, at in passages], "doc long, idx long, kind string, text string, start long")
        assert {r.idx: (r.section, r.place) for r in locate.placed_passages(s, p).collect()} == placed_by_hand(sections, passages)


def test_expressions_that_come_again_are_not_worked_out_again():
    from plumbline.functions import symbolic

    bound = {"x": "1.50", "n": "3", "unused": "7"}
    first = intervals.at_row("x / n", bound, ["n"], False)
    before = intervals.at_prints.cache_info().misses
    assert intervals.at_row("x / n", bound | {"unused": "8"}, ["n"], False) == first and intervals.at_prints.cache_info().misses == before
    assert [str(v) for v in first[:2]] == ["0.498333333333", "0.501666666667"] and first[2:] == (False, None)
    assert intervals.at_row("x", {"x": "1", "y": "no"}, [], False)[3] == intervals.at_row("(x", bound, [], False)[3] == "unreadable"
    symbolic.compared("(a + 1)^2", "a^2 + 2*a + 1")
    before = symbolic.compared.cache_info().misses
    assert symbolic.compared("(a + 1)^2", "a^2 + 2*a + 1") == ("identical", None) and symbolic.compared.cache_info().misses == before
