"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import importance, lexical_search, license_scan
from plumbline.llm.license_scan import Template
from plumbline.llm.texts import terms
from tests.llm.fixtures import SCHEMA, corpus, frame, prose

NO_ID = 2**63 - 1


def terms_by_hand(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_terms_are_those_of_the_expression():
    rng = random.Random(3)
    signs = "aZ09 _-@[`{\x7f\x0b\n\u0085 é中😀ß"
    for _ in range(200):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        assert [t.decode() for t in terms(text.encode())] == terms_by_hand(text)


# 11


def search_by_hand(rows, items, k):
    bags = [(i, Counter(terms_by_hand(t))) for i, t in rows]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, query in items:
        scores = []
        for i, b in bags:
            m = 50 + 50 * b.total() * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in query if b[t])
            if score > 0:
                scores.append((-score, NO_ID if i is None else i))
        out += [(item, rank, None if i == NO_ID else i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, score string, rank string")


@pytest.mark.parametrize(("shard_words", "block_terms", "k"), [(10**6, 10**6, 50), (60, 40, 3), (10**6, 1, 1)])
def test_search_against_hand(spark, docs, empty, monkeypatch, shard_words, block_terms, k):
    monkeypatch.setattr(lexical_search, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block_terms)
    texts = dict(corpus())
    queries = [(1, texts[3]), (2, " ".join(texts[30].split()[:25])), (3, "words, WORDS a b zzz"), (4, ""), (5, None), (6, "notthere"), (1, texts[3]), (None, "same here now")]
    items = items_of(spark, [(i, t, "x", "y") for i, t in queries])
    found = lexical_search.ranked(docs, items, k)
    distinct = {(i, frozenset(terms_by_hand(t))) for i, t in queries}
    assert sorted(map(tuple, found.collect()), key=str) == search_by_hand(corpus(), distinct, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical_search.ranked(empty, items).count() == 0
    assert lexical_search.ranked(docs, items.limit(0)).count() == 0


def test_lists_that_cannot_matter_are_not_read_whole():
    """A word of every document is non-essential behind a rare one: it is probed for the rare word's documents only."""
    found = [np.array([0, 1] if i < 5 else [0], np.int64) for i in range(500)]
    total = lexical_search.Totals(500, 500, np.array([1, 5000], np.int64))
    part = lexical_search.shard(np.arange(500), found, [len(x) for x in found], total)
    taken = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            taken.append(key)
            return super().__getitem__(key)

    docs, _ = lexical_search.best_of(part._replace(adds=part.adds.view(Watched)), np.array([0, 1]), 3, int(part.bound[0]) + 1)
    assert docs.tolist() == [0, 1, 2]
    whole = [k for k in taken if isinstance(k, slice) and k.start == part.first[0]]
    assert len(taken) >= 2 and part.bound[1] > part.bound[0] and len(whole) == 1  # the slice that is then probed by place


def test_ties_across_shards_keep_the_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_WORDS", 30)
    rows = [(i, "alpha beta gamma") for i in random.Random(1).sample(range(1000), 400)] + [(2000 + i, "delta other words") for i in range(100)]
    found = lexical_search.ranked(frame(spark, rows).repartition(5), items_of(spark, [(1, "alpha", "", "")]), k=20).orderBy("rank").collect()
    assert [r.doc_id for r in found] == sorted(i for i, _ in rows if i < 2000)[:20]


# 12


def accepts(wording, text):
    return bool(license_scan.scan(words := terms(text.encode()), b" " + b" ".join(words) + b" ", [(t := Template("x", wording, 1.0), license_scan.compiled(t))]))


@pytest.mark.parametrize(("wording", "yes", "no"), [
    ("a b", ["a b", "x a b y", "a a b"], ["a", "b a", "a x b", "ab", ""]),
    ("a <<opt:b c>> d", ["a d", "a b c d"], ["a b d", "a c d", "a b c"]),
    ("a <<var:2>> d", ["a d", "a x d", "a x y d", "a d d"], ["a x y z d", "a"]),
    ("a <<var:1>> <<opt:b>> <<var:1>> c", ["a c", "a b c", "a x b c", "a x b y c", "a x y c"], ["a x y z c", "a x b y z c"]),
    ("<<opt:z>> a b <<opt:y>>", ["a b", "z a b y", "q a b"], ["z a y"]),
    ("a <<var:3>> a c", ["a a c", "a x a c", "a x y z a c", "a a a a c"], ["a c"]),
])
def test_automata(wording, yes, no):
    assert all(accepts(wording, t) for t in yes) and not any(accepts(wording, t) for t in no)


def test_automata_against_expressions():
    from plumbline.llm.queries import as_expression

    rng = random.Random(5)
    kinds = ["a", "b", "a b", "<<opt:a>>", "<<opt:b a>>", "<<var:1>>", "<<var:2>>", "c"]
    for _ in range(300):
        wording = f"{rng.choice('abc')} {' '.join(rng.choice(kinds) for _ in range(rng.randint(0, 5)))} {rng.choice('abc')}"
        form = re.compile(as_expression(Template("x", wording, 1.0)))
        for _ in range(10):
            text = " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))
            assert accepts(wording, text) == bool(form.search(f" {text} ")), (wording, text)


def test_templates_need_mandatory_wording():
    with pytest.raises(ValueError, match="mandatory"):
        license_scan.compiled(Template("x", "<<opt:a>> <<var:3>>", 1.0))


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software."""


@pytest.mark.parametrize(("text", "base", "labels", "score"), [
    ("Released under the MIT License.", "mit", "mit", 0.8),
    ("see the MIT-license; or the APACHE license", "apache,mit", "apache,mit", 0.5),
    ("Licensed under the Apache License, Version 2.0.", "apache", "apache,apache-2.0", 0.9),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl", "gpl,gpl-3.0", 0.9),
    ("Licensed under CC BY-NC 4.0.", "", "cc-by-nc", 0.9),
    ("Licensed under CC BY 4.0.", "", "cc-by", 0.9),
    ("Copyright (c) 2020, 2021 Jo Doe and others. All rights reserved.", "", "all-rights-reserved", 0.6),
    (MIT, "", "mit", 1.0),
    (MIT.replace("merge", "join"), "", "", 0.0),
    ("mit licenses, mitlicense, license mit", "", "", 0.0),
    ("", "", "", 0.0),
    (None, "", "", 0.0),
])
def test_notices(spark, text, base, labels, score):
    row = license_scan.scanned(frame(spark, [(1, text)])).first()
    assert (row.base_labels, row.labels, row.score, row.n_words) == (base, labels, score, len(terms_by_hand(text)))
    assert row.key == "k" and all(0 <= f.start < f.end <= row.n_words for f in row.found)


def test_scan_counts_places(spark, docs, empty):
    rows = [(1, "x MIT license y mit license general public license"), (1, "x MIT license y mit license general public license"), (None, "nothing " * 30_000 + "mit license")]
    found = license_scan.scanned(frame(spark, rows)).collect()
    assert sorted((r.n_base, r.first_word, r.last_word) for r in found) == [(1, 30_000, 30_000), (3, 1, 6), (3, 1, 6)]
    assert license_scan.scanned(docs).count() == len(corpus()) and license_scan.scanned(empty).count() == 0
    clash = license_scan.scanned(docs.withColumn("labels", F.lit(1)).withColumn("found", F.lit(2)))
    assert dict(clash.dtypes)["labels"] == "string" and clash.columns.count("labels") == 1


# 13


def draw_by_hand(rows, target, percent, least, buckets=10_000, longest=1, seed=2024):
    def features(text):
        w = terms_by_hand(text)
        return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)) for texts in ([x for _, x in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, text in rows:
        own = features(text)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(terms_by_hand(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], NO_ID if r[0] is None else r[0], r[1], r[2]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("percent", "least", "buckets", "longest"), [(10, 20, 10_000, 1), (50, 1, 64, 2), (100, 0, 10, 3), (1, 20, 100, 1), (0, 0, 10, 1)])
def test_draw_against_hand(spark, docs, empty, percent, least, buckets, longest):
    texts = [dict(corpus())[5], None, "", dict(corpus())[30]]
    target = items_of(spark, [(i, t, "", "") for i, t in enumerate(texts)])
    found = importance.with_ranks(docs, target, percent, least, buckets, longest)
    assert sorted(map(tuple, found.collect()), key=str) == draw_by_hand(corpus(), texts, percent, least, buckets, longest)
    assert importance.with_ranks(empty, target, percent, least).count() == 0
    drawn = importance.resampled(docs.withColumn("weight", F.lit("old")), target, percent, least, buckets, longest)
    want = [r for r in draw_by_hand(corpus(), texts, percent, least, buckets, longest) if r[4]]
    assert sorted((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in drawn.where("doc_id is not null").collect()) == sorted(r for r in want if r[0] is not None)
    assert {"text", "source", "size"} <= set(drawn.columns)


def test_draw_with_one_score_for_all(spark):
    """Ties are cut by id: exact copies with one score, ids over the whole range of longs."""
    rng = random.Random(2)
    ids = sorted({rng.randint(-(2**62), 2**62) for _ in range(300)}, key=lambda i: i % 1009)
    scores = spark.createDataFrame([(i, 30, 30, 7, 7 if i % 3 else 8) for i in ids], "doc_id long, n_words long, n_features long, weight long, score long")
    cut = importance.cutoff(scores, 50, 20)
    found = {r.doc_id: r["rank"] for r in importance.ranked(scores.where(F.col("score") >= cut.least), cut).collect()}
    want = sorted(ids, key=lambda i: (-(7 if i % 3 else 8), i))
    assert {i: r for i, r in found.items() if r} == {i: r for r, i in enumerate(want[:150], 1)}


def test_draw_follows_the_target(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 40)) for i in range(200)] + [(200 + i, " ".join(rng.choice(["wanted", "theme", "words"]) for _ in range(40))) for i in range(20)]
    target = items_of(spark, [(0, "wanted theme words " * 2000, "", "")])
    found = importance.resampled(frame(spark, rows), target, percent=5, least_words=20)
    assert all(r.doc_id >= 200 for r in found.collect()) and found.count() == 11


def test_cosines_of_very_large_and_small_components(spark):
    from plumbline.llm import ann

    rows = [(0, [1.0, 0.0]), (1, [1e-200, 0.0]), (2, [2.0**600, 2.0**600]), (3, [0.0, -3.0]), (4, [5e-324, 0.0]), (5, [2.0**1023, 2.0**1023]), (6, [0.0, 0.0])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=5).collect()
    assert [(r.vec_id, round(r.score, 12)) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1.0), (4, 1.0), (2, round(0.5**0.5, 12)), (5, round(0.5**0.5, 12)), (3, 0.0)]
