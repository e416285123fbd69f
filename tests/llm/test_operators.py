import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from plumbline.llm import ann, common, html_text, labelled_pages, line_dedup, mixing, near_dup, packing, quality_model, quality_rules, substring
from plumbline.llm.queries import QUERIES, vocabulary
from tests.llm.fixtures import SCHEMA, corpus, frame, prose

NO_ID = 2**63 - 1


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()



# 1


def test_mix_meets_targets(docs, empty):
    mixed = mixing.mix(docs, block=16)
    rows = mixing.figures(mixed).collect()
    assert len(rows) == len(corpus())
    assert all(r["size"] == len(words(dict(corpus()).get(r.doc_id))) for r in rows if r.doc_id is not None)
    by = defaultdict(list)
    for r in rows:
        by[r.target, r.source_size].append(r)
        assert 0 <= r.taken <= 2 * r["size"]
    for (target, size), own in by.items():
        assert target <= 2 * size
    totals = defaultdict(int)
    for r in rows:
        totals[r.target, r.source_size] += r.taken
    assert sum(size for _, size in totals) == sum(len(words(t)) for _, t in corpus())
    assert all(abs(t - target) <= 1 for (target, _), t in totals.items())
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.figures(mixing.mix(docs, block=16)).collect()), key=str)
    assert mixing.figures(mixing.mix(empty)).count() == 0


def test_mix_schedule_is_even(spark):
    rows = [(i, "w " * 50, "en", "ab"[i % 2], 100, "k", "r", "s") for i in range(400)]
    mixed = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights=(3, 1), share=0.5, block=50)
    order = [r.source for r in mixed.schedule.select("slot", "source").distinct().orderBy("slot").collect()]
    share = order.count("a") / len(order)
    for n in range(40, len(order), 20):
        assert abs(order[:n].count("a") / n - share) < 3 * math.log2(n) / n


def test_mix_texts(docs):
    mixed = mixing.mix(docs, block=16)
    taken = mixing.texts(docs, mixed)
    assert taken.columns == docs.columns
    got = Counter()
    for r in taken.collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in mixing.figures(mixed).collect():
        want[r.doc_id] += r.taken
    assert got == +want


def test_mix_counts_copies(spark):
    rows = [(1, "a b c d", "en", "x", 7, "k", "r", "s")] * 2 + [(None, t, "en", "x", 7, "k", "r", "s") for t in ("a b c d", "e f g h", None)]
    mixed = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights=(1,), share=1.25, block=2)
    got = [(r.source_size, r.target, r.taken) for r in mixing.figures(mixed).collect()]
    assert len(got) == 5 and {g[:2] for g in got} == {(16, 20.0)} and sum(g[2] for g in got) == 20


CLASHING = ["row_key", "_row_key", "removed", "cut", "__key", "__removed", "__cut", "__row", "mix_key", "mix_start", "__start", "doc", "n_lines"]


def test_clashing_names(spark):
    """Columns that are called as helpers are come through as they were."""
    rows = [(*r[:5], *CLASHING) for r in frame(spark, corpus()).select("doc_id", "text", "lang", "source", "n_chars").collect()]
    schema = T.StructType([*SCHEMA.fields[:5], *(T.StructField(c, T.StringType()) for c in CLASHING)])
    docs = spark.createDataFrame(rows, schema)
    for made in (line_dedup.dedup(docs), near_dup.one_of_each(docs), quality_rules.keep(docs), mixing.texts(docs, mixing.mix(docs))):
        assert made.columns == docs.columns
        assert [tuple(r) for r in made.select(*CLASHING).distinct().collect()] == [tuple(CLASHING)]


# 2


def test_pack_exact_and_tight(docs, empty):
    rows = packing.pack_documents(docs, vocabulary(), context=64).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in dict(corpus()).items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(got[doc_id], key=lambda r: r.start)[:: 2 if doc_id == 60 else 1]:
            piece = ids[r.start : r.start + r.length].tobytes()
            assert r.start == at and bytes(r.ids) == piece and r.ids_crc32 == zlib.crc32(piece) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack_documents(empty, vocabulary()).count() == 0


def test_patterns_place_all():
    rng = np.random.default_rng(2)
    histogram = Counter(rng.integers(1, 129, 5000).tolist())
    found = packing.patterns(histogram, 128)
    placed = Counter()
    for n, pattern in found:
        assert sum(x * m for x, m in pattern.items()) <= 128
        for x, m in pattern.items():
            placed[x] += n * m
    assert placed == histogram
    assert sum(x * n for x, n in histogram.items()) / (128 * sum(n for n, _ in found)) > 0.97


def test_word_ids_equal_whole_text():
    ids = packing.WordIds(vocabulary())
    for text in ("İstanbul, ǅ don't I'LL <|endoftext|> a<|startoftext|>b ﬁ H̱ ẖ 9.5, Å.", "X.\x0by A,B C.. d!?", "", "ΑΣ. ß 中文，好"):
        assert np.frombuffer(ids.of([packing.words_of(text)])[0], "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_streams_equal_whole_texts():
    """Many texts at once; each different word of them is looked up once."""

    class Counted(packing.WordIds):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    ids = Counted(vocabulary())
    assert ids.plain
    texts = ["A stop. And, one.", None, "", ".", "\u00c9t\u00e9. Z, q.\x0bdon't I'LL", "e\u0301. A, b", "x<|endoftext|>Y. z, ", "a\u00a0b \u00a0 c", "  \n", "1.5, 2. zqxj", "Stop.\nNext,", "\U0001f600. OK"]
    whole = [ids.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    found, ends = ids.stream(texts, 1)
    assert [x.tolist() for x in np.split(found, ends)[:-1]] == whole and len(found) == ends[-1]
    ids.clear()
    ids.asked = 0
    assert ids.stream(["word other. " * 500] * 3, 1)[1].tolist() == [1501, 3002, 4503]
    assert ids.asked < 20


# 3


def removed_by_hand(rows, width):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            key, i_ = tuple(w[k : k + width]), NO_ID if i is None else i
            first[key] = min(first.get(key, NO_ID), i_)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - width + 1):
            if (NO_ID if i is None else i) > first[tuple(w[k : k + width])]:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for n, x in enumerate(w) if n not in gone)).hexdigest()))
    return out


def test_substring_against_hand(docs, empty):
    got = [tuple(r) for r in substring.without_repeats(docs, digest=True).collect()]
    assert sorted(got, key=str) == sorted(removed_by_hand(corpus(), 13), key=str)
    assert substring.without_repeats(empty).count() == 0


def test_spans_point_at_their_source(docs):
    texts = {(NO_ID if i is None else i): words(t) for i, t in corpus()}
    spans = substring.repeated_spans(docs).collect()
    assert spans
    for s in spans:
        n = s.n + 12
        assert s.source_doc < s.doc_id and texts[s.doc_id][s.start : s.start + n] == texts[s.source_doc][s.source_start : s.source_start + n]


def test_sources_across_batches():
    """The same stretches, whole or a row a batch."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = sorted((int(k), int(d)) for k, d in zip(rng.integers(0, 4, 60), rng.integers(0, 9, 60)))
    lists = [(100 * k + rng.integers(0, 6, 3)).tolist() for k, _ in rows]  # an edge has one key
    columns = {"key": np.array([k for k, _ in rows]), "doc_id": np.array([d for _, d in rows]), "row": np.arange(len(rows)), "start": np.zeros(len(rows), np.int64)}
    batch = substring.span_batch(columns, pa.array(lists, pa.list_(pa.int64())))
    edges = lambda out: sorted((r["row"], r["start"] + i) for b in out for r in b.to_pylist() for i in range(r["n"]))
    assert edges(substring.sources([batch])) == edges(substring.sources([batch.slice(i, 1) for i in range(len(rows))]))


# 4


def components_by_hand(rows, k, num, den):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets.append((NO_ID if i is None else i, frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else frozenset()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if s and t and a < b and den * len(s & t) >= num * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


def near_rows():
    import random

    rng = random.Random(4)
    base = [f"w{rng.randint(0, 400)}" for _ in range(70)]
    rows = corpus()
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 9)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, " ".join(f"s{j}" for j in range(n))) for i, n in enumerate((3, 4, 11, 12, 21, 22, 23, 40, 41, 44))]
    return rows


@pytest.mark.parametrize(("k", "num", "den", "bits"), [(3, 90, 100, 2048), (5, 80, 100, 64)])
def test_components_against_hand(spark, k, num, den, bits, monkeypatch):
    monkeypatch.setattr(near_dup, "SKETCH_BITS", bits)  # few bits: more pairs to ask about, the same answer
    got = near_dup.components(frame(spark, near_rows()), k, num, den)
    assert {(r.id, r.n_shingles, r.component) for r in got.collect()} == components_by_hand(near_rows(), k, num, den)


def test_components_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    monkeypatch.setattr(near_dup, "HUBS", 1)
    got = near_dup.components(frame(spark, near_rows()), 5, 80, 100)
    assert {(r.id, r.n_shingles, r.component) for r in got.collect()} == components_by_hand(near_rows(), 5, 80, 100)


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_flag_misses_no_key(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "BITS", bits)
    rows = spark.range(3000).selectExpr("cast(id as string) as k", "id as word", "id as bits")
    keys = spark.createDataFrame([(str(i),) for i in range(0, 3000, 7)] * 2, "k string")
    got = common.with_flag(rows, "k", keys, "listed")
    assert got.columns == ["k", "word", "bits", "listed"] and got.count() == 3000
    flagged = {int(r.k) for r in got.where("listed").collect()}
    assert set(range(0, 3000, 7)) <= flagged and (bits == 64 or len(flagged) < 440)
    assert common.with_flag(rows, "k", keys.limit(0), "listed").where("listed").isEmpty()


def test_one_of_each(spark, docs, empty):
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in components_by_hand(corpus(), 5, 80, 100)}
    got = [NO_ID if r.doc_id is None else r.doc_id for r in kept.collect()]
    assert sorted(got) == sorted(want)
    assert near_dup.one_of_each(empty).count() == 0


def test_one_of_each_keeps_unlike_rows_of_one_id(spark):
    rng = random.Random(5)
    unlike = [prose(rng, 40) for _ in range(7)]
    rows = [(None, t) for t in unlike[:3]] + [(7, t) for t in unlike[3:6]] + [(None, "few words"), (None, "others"), (None, None), (7, "few"), (7, "")]
    copies = [(None, unlike[0]), (None, unlike[1] + " end"), (8, unlike[3]), (3, unlike[6]), (None, unlike[6]), (7, "few")]
    got = [(r.doc_id, r.text) for r in near_dup.one_of_each(frame(spark, rows + copies).repartition(3)).collect()]
    assert [i for i, t in got if t in (unlike[1], unlike[1] + " end")] == [None]
    assert sorted((p for p in got if p[1] != unlike[1] + " end"), key=str) == sorted([p for p in [*rows, (3, unlike[6])] if p[1] != unlike[1] or (None, unlike[1]) in got], key=str)


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100), (50, 100)])
def test_linked_sets_share_a_first_shingle(num, den):
    """In any one order, among the first few of both, and within first() of the smaller."""
    rng, m = np.random.default_rng(3), near_dup.Measure(5, num, den)
    for n in (*range(1, 60), 170, 400, 667, 1001):
        for other in {n, (n + m.partners(n)[-1]) // 2, m.partners(n)[-1]}:
            order = rng.permutation(n + other)
            both = order[: m.overlap(n, other)]
            s = np.sort(np.concatenate([both, order[m.overlap(n, other) : n]]))
            t = np.sort(np.concatenate([both, order[n : n + other - len(both)]]))
            assert set(s[: m.first(n)].tolist()) & set(t[: m.prefix(other)].tolist())


def test_boundary_follows_the_costs():
    m = near_dup.Measure(5, 80, 100)
    assert near_dup.boundary({}, m) == near_dup.boundary({3: (1.0, 5.0), 30: (1.0, 9e9)}, m) == 0
    assert near_dup.boundary({3: (100.0, 5.0), 30: (10.0, 9e9)}, m) == 3
    assert near_dup.boundary({3: (100.0, 5.0), 30: (1e12, 9e9)}, m) >= 30


def test_shared_lists_across_batches(monkeypatch):
    """The same lists whole, and a row a batch; long ones have the length COUNTED."""
    monkeypatch.setattr(near_dup, "COUNTED", 5)
    rng = np.random.default_rng(7)
    key = np.sort(rng.integers(0, 30, 120))
    key[:9] = 0
    hot, first = [i % 11 == 0 for i in range(120)], [i % 3 == 0 for i in range(120)]
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(120)), pa.array(np.full(120, 8)), pa.array(first), pa.array([7 if x else None for x in hot], pa.int64())], names=["key", "sig", "n", "first", "hot"])
    out = lambda batches: sorted(tuple(r.values()) for b in near_dup.shared_lists(iter(batches)) for r in b.to_pylist())
    counts, some = Counter(k for k, h in zip(key.tolist(), hot) if not h), {k for k, h, f in zip(key.tolist(), hot, first) if f and not h}
    want = [(k, i, 8, first[i], min(counts[k], 5)) for i, k in enumerate(key.tolist()) if not hot[i] and counts[k] > 1 and (k in some or counts[k] >= 5)] + [(7, i, 8, first[i], 5) for i in range(0, 120, 11)]
    assert out([rows]) == out([rows.slice(i, 1) for i in range(120)]) == sorted(want)


def test_screen_leaves_out_no_link():
    rng, m = np.random.default_rng(12), near_dup.Measure(5, 80, 100)
    base = rng.integers(0, 2**64, 300, np.uint64)
    sets = [np.unique(np.concatenate([base[int(k) :], rng.integers(0, 2**64, int(k), np.uint64)])) for k in rng.integers(0, 90, 60)]
    sets += [rng.integers(0, 2**64, 300, np.uint64) for _ in range(20)]
    name = np.sort(rng.integers(0, 4, 80))
    order = rng.permutation(80)
    sketch = [near_dup.parities(sets[i], m.coarse_bits()) for i in order]
    rows = pa.RecordBatch.from_arrays([pa.array(name), pa.array(order), pa.array([len(sets[i]) for i in order]), pa.array([True] * 80), pa.array(sketch, pa.binary())], names=["list", "sig", "n", "first", "coarse"])
    got = {(r["list"], r["sig"]) for b in near_dup.screen(m)(iter([rows.slice(0, 33), rows.slice(33)])) for r in b.to_pylist()}
    for k in range(4):
        own = order[name == k].tolist()
        for i in own:
            if any(i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])) for j in own):
                assert (k, i) in got
    assert not any(i >= 60 for _, i in got)


def test_signatures_that_two_sets_have():
    """A signature that is unsure is replaced, by one that the second signature is in."""
    m = near_dup.Measure(5, 80, 100)
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y"]), pa.array([1, 2]), pa.array(["a b c d e f", "b c d e f a"])], names=["row", "id", "text"])
    sure, again = (next(near_dup.signatures(m, frozenset(unsure))(iter([batch]))).column("sig").to_pylist() for unsure in ((), ()))
    assert sure == again and sure[0] != sure[1]
    other = next(near_dup.signatures(m, frozenset(sure[:1]))(iter([batch]))).column("sig").to_pylist()
    assert other[0] not in sure and other[1] == sure[1]


def test_folded_sketches():
    rng = np.random.default_rng(5)
    for n in (10, 3000, 9000):
        words = " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
        s = near_dup.shingles(words, near_dup.Measure(5, 80, 100), near_dup.WordHashes())
        sketch = near_dup.sketch(s)
        assert len(sketch) * 8 >= max(2048, n - 5)
        small = np.packbits((np.bincount((s % np.uint64(2048)).astype(np.int64), minlength=2048) & 1).astype(bool)).tobytes()
        assert (near_dup.folded([sketch, small])[0] == near_dup.folded([small])[0]).all()


# 5


def test_rules_of_tree():
    text = "DecisionTree\n  If (feature 0 <= 1.5)\n   If (feature 2 <= 0.5)\n    Predict: 0.0\n   Else (feature 2 > 0.5)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    rules = quality_model.rules_of(text)
    assert [len(r.bounds) for r in rules] == [1, 2, 2, 1]
    assert rules[2].bounds[1] == (quality_model.STATISTICS[2], 0.5, math.inf)


def test_quality_held_out(spark):
    import random

    from tests.llm.fixtures import prose

    rng = random.Random(6)
    rows = [(i, prose(rng, 40) + "." if i % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 40).split())) for i in range(300)] + [(400, None), (None, "x"), (401, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, label int")
    scores = {r.doc_id: r.score for r in quality_model.scored(frame(spark, rows), labels).collect()}
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores.values())
    assert np.mean([(scores[i] >= 0.5) == (i % 3 > 0) for i in range(200, 300)]) > 0.97
    none = quality_model.scored(frame(spark, rows), labels.where("label = 7")).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


# 6


def test_lines(docs, empty):
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.dedup(docs, report=True).collect()}
    assert got[50] == (0, dict(corpus())[50])
    assert got[51] == (3, "intro")
    assert got[52] == (6, "")
    assert got[53][0] == 0 and got[40] == (0, None)
    assert line_dedup.dedup(docs).columns == docs.columns and line_dedup.dedup(empty).count() == 0


def test_lines_keep_first_occurrence(spark):
    rows = [(1, "a a\nb b\nc c\nx x"), (2, "a a\nb b\nc c\nd d\ne e"), (3, "c c\nd d\ne e")]
    got = {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "c c\nd d\ne e", 3: ""}


def test_lines_of_rows_of_one_id(spark):
    lines = "a a\nb b\nc c"
    got = sorted((r.text for r in line_dedup.dedup(frame(spark, [(1, lines), (1, f"z z\n{lines}"), (None, f"{lines}\ny y"), (None, f"{lines}\ny y")])).collect()), key=len)
    one, other = sorted([lines, "z z", "y y", "y y"], key=len), sorted(["", f"z z\n{lines}", "y y", "y y"], key=len)
    assert got in (one, other)  # one of the two rows of id 1 comes first


# 8


def test_repeat_words_against_hand():
    rng = np.random.default_rng(8)
    for _ in range(300):
        w = [bytes([97 + x]) for x in rng.integers(0, 4, rng.integers(0, 40))]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert quality_rules.count_in_repeats(w) == len(covered)


def test_cascade_order_keeps_verdicts(docs, empty):
    measured = quality_rules.measure(docs)
    assert set(measured) == {r.name for r in quality_rules.RULES} and all(c > 0 and 0 <= s <= 1 for c, s in measured.values())
    one = {(r.doc_id, r.rejected_by is None) for r in quality_rules.with_verdict(docs).collect()}
    other = {(r.doc_id, r.rejected_by is None) for r in quality_rules.with_verdict(docs, tuple(reversed(quality_rules.RULES))).collect()}
    assert one == other and (0, True) in one and (40, False) in one and (46, False) in one
    assert quality_rules.keep(docs).columns == docs.columns and quality_rules.keep(empty).count() == 0
    stats = {r.doc_id: r for r in quality_rules.with_verdict(docs, statistics=True).collect()}
    assert (stats[47].n_words, stats[47].word_chars) == (5, 10) and stats[40].n_words == 0


# 9


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:1000] = x[700]  # one vector of a fifth of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 16), (2001, [float("nan")] * 16), (2002, [1.0]), (2003, [None] + [1.0] * 15), (None, [1.0] * 16)]
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(frame_, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, 1500, 50):
        s = y @ y[q]
        s[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        hits += len(set(best.tolist()) & {v for _, v, _ in got[q]})
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        assert all(abs(score - s[v]) < 1e-12 for _, v, score in got[q])
    assert hits / 150 >= 0.9 and set(got) == set(range(0, 1500, 50))
    assert [v for _, v, _ in sorted(got[700])] == [701, 702, 703, 704, 705]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>"), F.lit(True))
    assert few.count() == 2


# 10


def test_pages_held_out():
    model = html_text.default_model()
    right = wanted = found = 0
    for page in labelled_pages.pages(150, seed=99):
        truth = Counter(n.text for n in html_text.parse(page) if n.text and n.label)
        got = Counter(html_text.main_text(page.replace(' data-main="1"', "").replace(' data-main="0"', ""), model).split("\n"))
        right, wanted, found = right + sum((truth & got).values()), wanted + sum(truth.values()), found + sum(got.values())
    assert right / wanted > 0.95 and right / found > 0.9


def test_page_cases(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two&nbsp;three<br>four<p>Five <b>six<script>x<p></script></article><footer>&copy; me</footer>"
    rows = spark.createDataFrame([(1, "u", page, "t"), (2, "u", None, None), (3, "u", "", None), (4, "u", "<p", None), (1, "u", page, "t")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in html_text.extract(rows).collect()]
    assert got.count((1, "A & B\nOne two three four\nFive six")) == 2 and {t for i, t in got if i in (2, 3)} == {""}
    assert html_text.extract(rows.where("page_id = 9")).count() == 0


@pytest.mark.parametrize(("attributes", "hidden"), [
    ('class="overflow-hidden"', False), ('style="overflow:hidden"', False), ('aria-hidden="false"', False), ('aria-hidden="true"', False), ("href=/hidden-gems", False), ('href="/a hidden"', False), ('data-hidden="1"', False),
    ('hidden="until-found"', False), ('title="display:none"', False), ('style="--display:none"', False), ('style="display:none;display:block"', False), ("style=\"background:url('a;display:none')\"", False), ("", False),
    ("hidden", True), ('class=x hidden=""', True), ("HIDDEN=hidden", True), ('style="color:red; Display : none !important"', True), ("style=display:none", True), ('style="display:none!important;display:block"', True),
])
def test_only_hidden_elements_are_skipped(attributes, hidden):
    page = f"<body><div {attributes}><p>One two three.</p></div><p>Read <a {attributes}>these words</a> too.</p></body>"
    assert [n.text for n in html_text.parse(page) if n.text] == (["Read too."] if hidden else ["One two three.", "Read these words too."])


@pytest.mark.parametrize(("page", "want"), [
    ("<html><head><title>x</title><meta name=a><body><p>One.</p></body>", ["One."]),
    ("<head><style>p {}</style><script>x</script></head><body><p>One.", ["One."]),
    ("<body><p hidden>No.<p>One.<p>Two.", ["One.", "Two."]),
    ("<ul><li>One<li style=display:none>no <b>no<li>Two</ul><p>Three.", ["One", "Two", "Three."]),
    ("<ul><li hidden><p>no<li>One<li>Two</ul>", ["One", "Two"]),
    ("<dl><dt hidden>No<dd>One<dd hidden>no<dt>Two</dl>", ["One", "Two"]),
    ("<table><tr hidden><td>No<td>no<tr><td>One<td hidden>no<td>Two</table>", ["One", "Two"]),
    ("<p>One <select><option>no<option>no</select>two <option>no<p>Three", ["One two", "Three"]),
    ("<div><div hidden>No<p>no</div><p>One.</div>", ["One."]), ("<section><div hidden>No<p>no</section><p>One.", ["One."]),
    ("<p>One <button><div>no</div></button>two <svg><p>no</svg>three", ["One two three"]),
    ("<div>One <div hidden>no<br>no<a>no</a></div>two <span hidden>no</span>three</div>", ["One two three"]),
    ("<article data-x=it's><p title=\"a > b\">One.</p><p title=don't>Two.</article>", ["One.", "Two."]),
    ("<p>One <math><mi>x</mi></math> two <button>no <i>three", ["One x two no three"]),
    ("<p>One <svg><p>Two.</p><select><p>Three.", ["One", "Two.", "Three."]), ("<p>One <BUTTON>no</BUTTON>two", ["One two"]),
    ("<template><p>no</div></template><p>One <a hidden href=\"/\">no</a>two", ["One two"]),
])
def test_skipped_elements_end_as_others_do(page, want):
    nodes = html_text.parse(page)
    assert [n.text for n in nodes if n.text] == want and not any(n.linked for n in nodes)


def test_marginals_are_those_of_enumeration():
    """Sum-product on a small tree against summing over all labellings."""
    from itertools import product

    model = html_text.default_model()
    nodes = html_text.parse("<body><div class=menu><a href=/>x</a></div><article><p>One two three.</p><div class=ad>Buy</div></article></body>")
    total, mass = 0.0, [0.0] * len(nodes)
    for labels in product((0, 1), repeat=len(nodes)):
        if labels[0]:
            continue
        p = 1.0
        for i, n in enumerate(nodes):
            if i:
                p *= model.edge[bool(n.text)][labels[n.parent]][labels[i]]
            for f in n.features:
                if f in model.emit:
                    p *= model.emit[f][labels[i]]
        total += p
        for i, y in enumerate(labels):
            mass[i] += p * y
    assert np.allclose([m / total for m in mass], html_text.marginals(nodes, model), atol=1e-9)
