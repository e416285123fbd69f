"""Exact Jaccard self-join of word-shingle sets: a size-aware heavy-light join that keeps the components.

Equal sets are one class. Lists are made from the texts where they lie. One text of each set that is in a list with
another is saved, once, and pairs are compared on these; a filter of bounded size leaves the others out of the shuffle
(beyond some BITS such sets it leaves out ever fewer, and at worst all texts are shuffled that once). A link between
different sets is found by size:

* Light sets, up to a boundary, list all their subsets of the size that a link to a partner of each possible size
  takes; linked light sets list the same subset.
* Heavy sets are found through inverted lists of their shingles. In one order for all, the rarest first, two linked
  sets share a shingle among the first few of both, so only these are listed and their lists scanned. Shingles are
  counted over all texts, in buckets by hash: the order needs no exact counts, only to be the same for all sets, and
  what is frequent comes last.

The boundary is the size at which listing subsets of all smaller sets and scanning lists for the others costs least, by
the lengths of the lists; sets near it go both ways.

Within a list of bounded length a first scan by coarse parity sketches leaves out members that are like no other. What
is left of lists of nearly the same sets becomes one list, named after the least of them, so that the many shingles that
a group of near copies shares are scanned once. These lists are scanned with finer sketches. Bits that differ in two
sketches are shingles that differ, so a scan rules pairs out and never a link. A minimum spanning forest of what is left
is checked on whole texts; where a pair of it turns out not to be linked, its list is scanned again without that pair,
asking for sixteen times as many at once, until every list has a forest of true links. A list is scanned in blocks of
bounded size, in different tasks: first each block alone with a few members of the list, then each two that are not of
one component already. No pair is set aside, so the components are those of all links. Nothing of the corpus reaches the
driver but counts of bounded number.

Shingles are compared by 64-bit hashes; two different sets of one signature are told apart by a second one. Null and
empty texts have the empty set and no link. Texts of any length are read whole. Rows may repeat; a null doc_id is the
largest. An empty table gives an empty table. Other columns of documents may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import NO_ID, Scratch, WordHashes, free_name, mix, partitions_for, row_key, saved, shingle_hashes, spread_join, with_flag
from plumbline.llm.components import stars
from plumbline.llm.texts import grouped, runs, signed, whole_groups

#: Sizes that may be light; what the comparison of two sketches costs against a row that is written and sorted.
LIGHT_SIZES, SCAN_COST = 64, 1 / 64

#: Members of a list that are scanned together, and how many of them are with every block at the first look.
BLOCK, HUBS = 1024, 16

#: Bits of a sketch, at least; those of larger sets have as many as shingles, so that unlike ones differ in more bits
#: than a link allows.
SKETCH_BITS = 2048

#: Shingles are counted in so many buckets; those of a bucket with more than 1 / HOT of all are spread by set too.
BUCKETS, HOT = 1 << 16, 1024

#: Members of one list that a task counts exactly; longer lists, and those of hot shingles, have that length for all.
COUNTED = 1 << 20

#: One row for each document, small being its shingles if they are few enough for a light set, and rows without row: id a
#: bucket, n how many shingles of its texts are in it.
SET = "row binary, id long, sig long, check long, n long, coarse binary, sketch binary, small binary"


class Measure(NamedTuple):
    """Shingles of so many words (one shorter one for shorter texts); links at a similarity of num/den or more."""

    words: int
    num: int
    den: int

    def overlap(self, n: int, m: int) -> int:
        """The least intersection of linked sets of these sizes."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def partners(self, n: int) -> range:
        """The sizes of sets that a set of size n can be linked to."""
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def prefix(self, n: int) -> int:
        """Among so many rarest shingles a set of size n shares one with any partner."""
        return n - self.overlap(n, max(1, self.partners(n)[0])) + 1

    def first(self, n: int) -> int:
        """Among so many rarest shingles it shares one with any partner that is not smaller."""
        return n - self.overlap(n, n) + 1

    def subsets(self, n: int) -> float:
        """How many subsets a light set of size n lists."""
        return float(sum(math.comb(n, self.overlap(n, m)) for m in self.partners(n)))

    def differ(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """In how many shingles linked sets of these sizes differ at most; below 0 where they cannot be linked."""
        most = n + m - 2 * -(-self.num * (n + m) // (self.num + self.den))
        return np.where(np.minimum(n, m) * self.den >= np.maximum(n, m) * self.num, most, -1)

    def coarse_bits(self) -> int:
        """Bits of a coarse sketch; with them unlike sets of up to some 500 shingles differ in more than linked ones."""
        return 64 * max(4, round(80 * (self.den - self.num) / (self.den + self.num)))


def shingles(text: str | None, measure: Measure, hashes: WordHashes) -> np.ndarray:
    """The sorted hashes of the text's shingles."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(shingle_hashes(hashes.of(words), min(measure.words, len(words))))


def signature(s: np.ndarray, salt: int = 0) -> np.uint64:
    return mix(np.array([mix(s + np.uint64(salt)).sum(dtype=np.uint64) + np.uint64(len(s))]))[0]


def set_name(s: np.ndarray, unsure: frozenset[int]) -> np.uint64:
    """The signature; where two different sets have it (unsure), the second signature joins in."""
    sig = signature(s)
    return mix(np.array([sig ^ signature(s, 1)]))[0] if unsure and int(sig.view(np.int64)) in unsure else sig


def parities(s: np.ndarray, bits: int) -> bytes:
    """Bit i: how many shingles have the hash i, odd or even."""
    return np.packbits((np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def sketch(s: np.ndarray) -> bytes:
    """Bits in a power of two: the halves of a sketch, one xor the other, are the sketch of half the bits."""
    return parities(s, max(SKETCH_BITS, 1 << max(0, len(s) - 1).bit_length()))


def signatures(measure: Measure, unsure: frozenset[int]) -> Callable:
    """(row, id, text) to SET."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, bits = WordHashes(), np.zeros(BUCKETS, np.int64), measure.coarse_bits()
        names = ["row", "id", "sig", "check", "n", "coarse", "sketch", "small"]
        for batch in grouped(batches, 2):
            sigs, checks, ns, coarse, fine, small, seen = [], [], [], [], [], [], {}
            for text in batch.column(2).to_pylist():
                s = shingles(text, measure, hashes)
                sig, check = (set_name(s, unsure), signature(s, 1)) if len(s) else (np.uint64(0), np.uint64(0))
                if len(s):
                    seen[sig] = s
                sigs.append(sig)
                checks.append(check)
                ns.append(len(s))
                coarse.append(parities(s, bits))
                fine.append(sketch(s))
                small.append(s.tobytes() if len(s) <= LIGHT_SIZES else None)
            if seen:
                counts += np.bincount((np.concatenate(list(seen.values())) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed(np.array(sigs, np.uint64)), signed(np.array(checks, np.uint64)), pa.array(ns, pa.int64()), *(pa.array(x, pa.binary()) for x in (coarse, fine, small))], names=names)
        full = np.flatnonzero(counts)
        none = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(full), pa.binary()), pa.array(full), none, none, pa.array(counts[full]), *[pa.nulls(len(full), pa.binary())] * 3], names=names)

    return read


def rarest_first(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return s[np.lexsort((s, counts[(s % np.uint64(BUCKETS)).astype(np.int64)]))]


def list_members(measure: Measure, counts: np.ndarray, hot: np.ndarray, unsure: frozenset[int]) -> Callable:
    """Texts to (key, sig, n, first, hot): the lists a set is in, by their shingle, which is the key, or, spread by set,
    in hot (of hot buckets). Equal sets are listed once a batch."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in grouped(batches, 0):
            sets = {set_name(s, unsure): s for s in (shingles(text, measure, hashes) for text in batch.column(0).to_pylist()) if len(s)}
            if not sets:
                continue
            n = np.array([len(s) for s in sets.values()])
            listed = [rarest_first(s, counts)[: measure.prefix(len(s))] for s in sets.values()]
            size = np.array([len(s) for s in listed])
            term, sig = np.concatenate(listed), np.repeat(np.array(list(sets), np.uint64), size)
            nth = np.arange(len(term)) - np.repeat(np.cumsum(size) - size, size)
            first = nth < np.repeat([measure.first(x) for x in n.tolist()], size)
            is_hot = np.isin(term % np.uint64(BUCKETS), hot)
            key = np.where(is_hot, mix(term ^ mix(sig)), term)
            yield pa.RecordBatch.from_arrays([signed(key), signed(sig), pa.array(np.repeat(n, size)), pa.array(first), pa.array(term.view(np.int64), mask=~is_hot)], names=["key", "sig", "n", "first", "hot"])

    return read


def shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of list_members() in the order of (key, sig), each counted once, to (list, sig, n, first, m) for lists of two
    sets or more, one of them with first; m is the length, COUNTED for hot and very long lists. At most COUNTED rows are
    held."""
    names = ["list", "sig", "n", "first", "m"]

    def out(key: np.ndarray, sig: np.ndarray, n: np.ndarray, first: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (key, sig, n, first, m)], names=names)

    empty = [np.empty(0, np.int64)] * 3 + [np.empty(0, bool)]
    held, passed = empty, None  # the last list so far; a list of which COUNTED rows came before
    for batch in with_end(without_repeats(batches)):
        over = batch is None
        rows = empty
        if not over:
            is_hot = batch.column("hot").is_valid().to_numpy(zero_copy_only=False)
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sig", "n", "first")]
            if is_hot.any():
                _, sig, n, first = (x[is_hot] for x in columns)
                yield out(batch.column("hot").drop_null().to_numpy(), sig, n, first, np.full(len(sig), COUNTED))
            rows = [x[~is_hot] for x in columns]
        key, sig, n, first = (np.concatenate(x) for x in zip(held, rows, strict=True))
        if passed is not None and len(key):
            more = key == passed
            if more.any():
                yield out(key[more], sig[more], n[more], first[more], np.full(int(more.sum()), COUNTED))
            key, sig, n, first = (x[~more] for x in (key, sig, n, first))
            passed = passed if not len(key) else None
        if not len(key):
            held = empty
            continue
        start = runs(key[1:] != key[:-1])
        size = np.diff(np.append(start, len(key)))
        use = (size > 1) & np.logical_or.reduceat(first, start)
        upto = len(key)
        if size[-1] >= COUNTED:
            use[-1], passed = True, key[-1]
        elif not over:
            upto = start[-1]
        at = np.flatnonzero(np.repeat(use, size)[:upto])
        yield out(key[at], sig[at], n[at], first[at], np.minimum(np.repeat(size, size)[at], COUNTED))
        held = [x[upto:] for x in (key, sig, n, first)]


def without_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose (key, sig) is not that of the row before."""
    last = None
    for batch in batches:
        if batch.num_rows:
            key, sig = (batch.column(c).to_numpy() for c in ("key", "sig"))
            new = np.append((key[0], sig[0]) != last, (key[1:] != key[:-1]) | (sig[1:] != sig[:-1]))
            last = (key[-1], sig[-1])
            yield batch.filter(pa.array(new))


def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def screen(measure: Measure) -> Callable:
    """(list, sig, n, first, coarse) of lists of bounded length, together, to the (list, sig) that some other of the
    list may be linked to, by the coarse sketches."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "list"):
            name, n, first = (part.column(c).to_numpy(zero_copy_only=False) for c in ("list", "n", "first"))
            sketch = np.frombuffer(b"".join(part.column("coarse").to_pylist()), np.uint64).reshape(len(name), -1)
            start = runs(name[1:] != name[:-1])
            size = np.diff(np.append(start, len(name)))
            behind = np.repeat(start + size, size) - np.arange(len(name)) - 1  # rows of the same list that come later
            like, rows, step = np.zeros(len(name), bool), np.arange(len(name)), 0
            while True:
                step += 1
                rows = rows[behind[rows] >= step]
                if not len(rows):
                    break
                i = rows[first[rows] | first[rows + step]]
                j = i + step
                most = measure.differ(n[i], n[j])
                ok = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64) <= most
                like[i[ok]] = like[j[ok]] = True
            yield pa.RecordBatch.from_arrays([part.column("list").filter(pa.array(like)), part.column("sig").filter(pa.array(like))], names=["list", "sig"])

    return read


def boundary(costs: dict[int, tuple[float, float]], measure: Measure) -> int:
    """The size up to which sets list subsets, from {size: (cost of its sets' lists, of their subsets)}."""
    total = lambda b: sum(light * (n <= b) + heavy * (measure.partners(n)[-1] > b) for n, (heavy, light) in costs.items())
    return min(range(LIGHT_SIZES + 1), key=lambda b: (total(b), b))


def subset_lists(measure: Measure, upto: int) -> Callable:
    """(sig, small) of light sets to (list, sig): their subsets that suffice for a link, with both sizes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, 1):
            names, sizes = [np.empty(0, np.uint64)], []
            for small in batch.column(1).to_pylist():
                s, before = mix(np.frombuffer(small, np.uint64)).tolist(), len(names)
                for other in measure.partners(len(s)):
                    if 0 < other <= upto:
                        sums = np.array([sum(x) % 2**64 for x in combinations(s, measure.overlap(len(s), other))], np.uint64)
                        names.append(mix(sums + mix(np.array([(min(len(s), other) << 20) + max(len(s), other)], np.uint64))))
                sizes.append(sum(map(len, names[before:])))
            yield pa.RecordBatch.from_arrays([signed(np.concatenate(names)), pa.array(np.repeat(batch.column(0).to_numpy(), sizes))], names=["list", "sig"])

    return read


def folded(sketches: list[bytes]) -> np.ndarray:
    """The sketches as rows of 64-bit numbers, all of as many bits as the shortest."""
    least = min(map(len, sketches))
    return np.array([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least // 8)) for x in sketches])


def forest(sketch: np.ndarray, n: np.ndarray, measure: Measure, good: set, bad: set, at_once: int) -> list[tuple[int, int]]:
    """Pairs to ask about: those of a minimum spanning forest of what the sketches leave possible, by the least surplus
    of differing bits (Prim's method, a row at a time), except where it is known to be linked (good). Pairs in bad are
    known not to be. A member that joins by an unknown pair asks for its at_once best ones."""
    m, never = len(n), 1 << 30
    slack, todo, asked, v = np.full(m, never), np.ones(m, bool), [], 0
    known: dict[int, list] = {}
    for pairs, value in ((good, -(1 << 29)), (bad, never)):
        for a, b in pairs:
            known.setdefault(a, []).append((b, value))
            known.setdefault(b, []).append((a, value))
    while True:
        differ = np.bitwise_count(sketch ^ sketch[v]).sum(1, dtype=np.int64)
        allowed = measure.differ(n, n[v])
        row = np.where(differ <= allowed, differ - allowed, never)
        for other, value in known.get(v, ()):
            row[other] = value
        if -(1 << 29) < slack[v] < never:
            near = np.flatnonzero(~todo & (row < never) & (row > -(1 << 29)))
            if len(near) > at_once:
                near = near[np.argpartition(row[near], at_once - 1)[:at_once]]
            asked += [(int(x), v) for x in near]
        todo[v] = False
        slack = np.where(todo, np.minimum(slack, row), slack)
        left = np.flatnonzero(todo)
        if not len(left):
            return asked
        v = int(left[np.argmin(slack[left])])


def scan(measure: Measure, at_once: int) -> Callable:
    """Members (list, sig, n, sketch, root) and known pairs (list, sig, other, linked), in the order of their list, members
    first, to the pairs (list, a, b) that forest() asks about in each list."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["list", "a", "b"])
            out.clear()
            return made

        def one(part: pa.RecordBatch) -> None:
            sig, other, linked = (part.column(c).to_pylist() for c in ("sig", "other", "linked"))
            m = sum(x is None for x in other)
            sketch = folded(part.column("sketch").slice(0, m).to_pylist())
            number = {s: i for i, s in enumerate(sig[:m])}
            pairs = [(number[a], number[b], ok) for a, b, ok in zip(sig[m:], other[m:], linked[m:], strict=True)]
            good, bad = {(a, b) for a, b, ok in pairs if ok}, {(a, b) for a, b, ok in pairs if not ok}
            first: dict[int, int] = {}
            for i, root in enumerate(part.column("root").slice(0, m).to_pylist()):  # members known to be of one component
                if first.setdefault(root, i) != i:
                    good.add((first[root], i))
            for a, b in forest(sketch, part.column("n").slice(0, m).to_numpy(), measure, good, bad, at_once):
                out.append((part.column(0)[0].as_py(), min(sig[a], sig[b]), max(sig[a], sig[b])))

        for part in whole_groups(batches, "list"):
            names = part.column(0).to_numpy()
            start = runs(names[1:] != names[:-1]).tolist()
            for i, j in zip(start, [*start[1:], len(names)], strict=True):
                one(part.slice(i, j - i))
                if len(out) > 50_000:
                    yield flush()
        yield flush()

    return read


def compare(measure: Measure) -> Callable:
    """(a, b, text_a, text_b) to (a, b, linked), on the whole texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = shingles(x, measure, hashes), shingles(y, measure, hashes)
                both = len(np.intersect1d(s, t, assume_unique=True))
                linked.append(measure.den * both >= measure.num * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return read


def classes(docs: DataFrame, measure: Measure, keep: Callable) -> tuple[DataFrame, frozenset[int]]:
    """SET of docs (row, id, text), in which equal signatures are equal sets, and the signatures that were not enough."""
    unsure: frozenset[int] = frozenset()
    while True:
        found = keep(docs.mapInArrow(signatures(measure, unsure), SET), "near-sets")
        twice = found.where("n > 0 and row is not null").groupBy("sig").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y")
        new = frozenset(r.sig for r in twice.select("sig").collect())  # chance collisions of 64 bits: none below a billion sets
        if not new:
            return found, unsure
        unsure |= new


def all_lists(docs: DataFrame, sets: DataFrame, chosen: DataFrame, unsure: frozenset[int], measure: Measure, keep: Callable) -> DataFrame:
    """(list, sig) of all lists in which sets may be linked; chosen are the sets (sig, n, coarse, small), each once."""
    n = partitions_for(docs.sparkSession)
    rows = sets.where("row is null").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row for each bucket
    counts = np.zeros(BUCKETS, np.int64)
    counts[[r.id for r in rows]] = [r.n for r in rows]
    hot = np.flatnonzero(counts * HOT > counts.sum()).astype(np.uint64)
    members = docs.select("text").mapInArrow(list_members(measure, counts, hot, unsure), "key long, sig long, n long, first boolean, hot long")
    members = members.repartition(n, "key").sortWithinPartitions("key", "sig").mapInArrow(shared_lists, "list long, sig long, n long, first boolean, m long")
    members = keep(members, "near-members")

    sizes = dict(chosen.where(F.col("n") <= LIGHT_SIZES).groupBy("n").agg(F.count("*")).collect())  # a row for each size
    scanned = dict(members.where(F.col("n") <= LIGHT_SIZES).groupBy("n").agg(F.sum("m")).collect())
    costs = {k: (c * measure.prefix(k) + SCAN_COST * scanned.get(k, 0), c * measure.subsets(k)) for k, c in sizes.items()}
    upto = boundary(costs, measure)
    light = max((k for k in range(upto + 1) if measure.partners(k)[-1] <= upto), default=0)  # with light partners only
    members = members.where(F.col("n") > light)
    subsets = chosen.where(F.col("n") <= upto).select("sig", "small").mapInArrow(subset_lists(measure, upto), "list long, sig long")
    again = subsets.groupBy("list").agg(F.count("*").alias("m")).where("m > 1").select("list")

    short = members.where(F.col("m") <= BLOCK).join(chosen.select("sig", "coarse"), "sig").select("list", "sig", "n", "first", "coarse")
    short = short.repartition(n, "list").sortWithinPartitions("list").mapInArrow(screen(measure), "list long, sig long")
    found = short.unionByName(members.where(F.col("m") > BLOCK).select("list", "sig")).unionByName(subsets.join(again, "list"))
    found = keep(found, "near-found")
    names = found.groupBy("list").agg(F.min(F.xxhash64("sig")).alias("name"))
    return keep(found.join(names, "list").select(F.col("name").alias("list"), "sig").distinct(), "near-lists")


def links(docs: DataFrame, chosen: DataFrame, members: DataFrame, measure: Measure, keep: Callable) -> DataFrame:
    """Links (a, b) between the signatures of different sets, enough to connect all that links connect; chosen are the
    sets (sig, row, n, sketch), each once, and row is whose text stands for it."""
    n = partitions_for(docs.sparkSession)

    def judged(asked: DataFrame) -> DataFrame:
        sides = asked.select("a", "b").distinct().select("a", "b", F.explode(F.array("a", "b")).alias("sig"))
        text = lambda side: F.max(F.when(F.col("sig") == F.col(side), F.col("text"))).alias(f"text_{side}")
        pairs = texts.join(sides, "sig").groupBy("a", "b").agg(text("a"), text("b"))
        return keep(pairs.mapInArrow(compare(measure), "a long, b long, linked boolean"), "near-judged")

    def with_sketch(rows: DataFrame) -> DataFrame:
        none = [F.lit(None).cast("long").alias("other"), F.lit(None).cast("boolean").alias("linked")]
        return rows.join(listed.select("sig", "n", "sketch"), "sig").select("list", "sig", "n", "sketch", "root", *none)

    def asked_of(rows: DataFrame, at_once: int) -> DataFrame:
        rows = rows.repartition(n, "list").sortWithinPartitions("list", F.col("other").isNotNull())
        return keep(rows.mapInArrow(scan(measure, at_once), "list long, a long, b long"), "near-asked")

    # What each round joins is of listed sets only, and neither it nor the texts send the other sets through a shuffle.
    in_list = keep(members.select("sig").distinct(), "near-in-list")
    listed = with_flag(chosen.select("sig", "row", "n", "sketch"), "sig", in_list, "listed").where("listed").drop("listed")
    listed = keep(listed.join(in_list, "sig"), "near-listed")
    texts = with_flag(docs.select("row", "text"), "row", listed.select("row"), "listed").where("listed")
    texts = keep(texts.groupBy("row").agg(F.first("text").alias("text")).join(listed.select("row", "sig"), "row").select("sig", "text"), "near-texts")

    # A first look at each set's longest list alone, which joins most of a group; the rest meets as components.
    blocks = keep(own_blocks(members), "near-own-blocks")
    length = blocks.groupBy("list").agg(F.count("*").alias("m"))
    longest = blocks.join(length, "list").groupBy("sig").agg(F.max(F.struct("m", "list")).alias("x")).select(F.col("x.list").alias("list")).distinct()
    look = judged(asked_of(with_sketch(blocks.join(longest, "list", "left_semi").withColumn("root", F.col("sig"))), 1))
    out = look.where("linked").select("a", "b")
    roots = stars(out, keep)
    members = members.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("list", "sig", F.coalesce("root", "sig").alias("root"))
    members = keep(members, "near-rooted")
    open_lists = members.groupBy("list").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("list")
    members = keep(in_blocks(keep(members.join(open_lists, "list", "left_semi"), "near-open-members")), "near-blocks")
    at_once, known, todo = 1, None, with_sketch(members)
    while True:
        asked = asked_of(todo, at_once)
        answer = judged(asked)
        out = out.unionByName(answer.where("linked").select("a", "b"))
        if answer.where("not linked").isEmpty():
            return out.distinct()
        at_once *= 16
        # Lists with a pair that failed are scanned again, with all that is known of them.
        answers = asked.join(answer, ["a", "b"]).select("list", "a", "b", "linked")
        known = keep(answers if known is None else known.unionByName(answers), "near-known")
        again = keep(answers.where("not linked").select("list").distinct(), "near-open")
        todo = with_sketch(members.join(again, "list", "left_semi"))
        pairs = known.join(again, "list", "left_semi")
        todo = todo.unionByName(pairs.select("list", F.col("a").alias("sig"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("sketch"), F.lit(None).cast("long").alias("root"), F.col("b").alias("other"), "linked"))
        todo = keep(todo, "near-again")  # a union of joined tables is not dealt out anew by its key without this


def own_blocks(lists: DataFrame) -> DataFrame:
    """(list, sig) with a list longer than BLOCK replaced by blocks of about that size; some HUBS members of the list are
    in all of them, so that blocks of one component can link."""
    long = lists.groupBy("list").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("list", "m", F.ceil(F.col("m") / BLOCK).alias("parts"))
    rows = lists.join(long, "list", "left")
    is_hub = F.pmod(F.xxhash64("sig", F.lit(1)), F.col("m")) < HUBS
    to = F.when(F.col("m").isNull(), F.array(F.lit(0).cast("long"))).when(is_hub, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("sig"), F.col("parts"))))
    rows = rows.select("list", "sig", "m", F.explode(to).alias("block"))
    return rows.select(F.when(F.col("m").isNull(), F.col("list")).otherwise(F.xxhash64("list", "block")).alias("list"), "sig")


def in_blocks(lists: DataFrame) -> DataFrame:
    """(list, sig, root) with a list longer than BLOCK replaced by one list for each two of its blocks. A block is part
    of one large component (of) or of all the small ones; two of the same large component need no scan."""
    groups = lists.groupBy("list", "root").agg(F.count("*").alias("m")).withColumn("of", F.when(F.col("m") >= BLOCK, F.col("root")))
    sizes = groups.groupBy("list").agg(F.sum("m").alias("total"), F.sum(F.when(F.col("of").isNull(), F.col("m"))).alias("small")).where(F.col("total") > BLOCK)
    parts = F.ceil(F.when(F.col("of").isNull(), F.col("small")).otherwise(F.col("m")) / BLOCK)
    split = groups.join(sizes, "list").select("list", "root", "of", parts.alias("parts"))
    block = F.xxhash64("list", "of", F.pmod(F.xxhash64("sig"), F.col("parts")))
    rows = lists.join(split, ["list", "root"], "left").select("list", "sig", "root", "of", F.when(F.col("parts").isNotNull(), block).alias("block"))
    blocks = rows.where("block is not null").select("list", "block", "of").distinct()
    other = blocks.select("list", F.col("block").alias("other"), F.col("of").alias("other_of"))
    pairs = blocks.join(other, "list").where("block < other and (of is null or other_of is null or of <> other_of) or block = other and of is null")
    pairs = pairs.select(F.xxhash64("list", "block", "other").alias("name"), "list", F.explode(F.array("block", "other")).alias("block")).distinct()
    apart = rows.join(pairs, ["list", "block"]).select(F.col("name").alias("list"), "sig", "root")
    return rows.where("block is null").select("list", "sig", "root").unionByName(apart)


def rooted(docs: DataFrame, measure: Measure) -> DataFrame:
    """row (row_key), id (doc_id, NO_ID for null), n, sig (null for the empty set), and root: one signature for all of a
    component, null without one."""
    rows = docs.select(row_key().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    with Scratch(docs.sparkSession) as scratch:
        sets, unsure = classes(rows, measure, scratch.saved)
        chosen = sets.where("n > 0 and row is not null").groupBy("sig").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("n", "coarse", "sketch", "small")))
        chosen = scratch.saved(chosen, "near-classes")
        members = all_lists(rows, sets, chosen, unsure, measure, scratch.saved)
        roots = stars(links(rows, chosen, members, measure, scratch.saved), scratch.saved)
        found = sets.where("row is not null").select("row", "id", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
        found = spread_join(found, roots.withColumnRenamed("node", "sig"), "sig", "row").withColumn("root", F.coalesce("root", "sig"))
        return saved(found, "near-rooted-sets")


def components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """row (row_key), id (doc_id, NO_ID for null), n_shingles, and component: the smallest id reachable by links."""
    found = rooted(docs, Measure(words, num, den))
    least = found.where("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    return spread_join(found, least, "root", "row").select("row", "id", F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The document of smallest doc_id of each component, one row of it, with all columns of docs. Ids say nothing of
    likeness: rows of one doc_id, or of none, are in one component only by links. A row without shingles is its own."""
    found = rooted(docs, Measure(words, num, den))
    key, doc, stays, maybe = free_name(docs, "row_key", "doc", "stays", "maybe")
    by = F.coalesce(F.col("root").cast("string"), F.concat(F.lit("row:"), F.hex("row"))).alias("component")
    first = found.groupBy(by).agg(F.min(F.struct("id", "row")).alias("first")).select(F.col("first.row").alias("row"), F.lit(True).alias("stays"))
    rows = found.groupBy("row").agg(F.count("*").alias("n")).join(first, "row", "left").withColumn("stays", F.coalesce("stays", F.lit(False)))
    # Most rows stay as they are: those that the filter of the others knows nothing of do so without a shuffle.
    others = saved(rows.where("n > 1 or not stays").select(F.col("row").alias(key), F.col("stays").alias(stays)), "near-others")
    marked = with_flag(docs.withColumn(key, row_key()), key, others.select(key), maybe)
    asked = marked.where(F.col(maybe)).join(others, key, "left")
    whole = marked.where(~F.col(maybe)).select(*docs.columns).unionByName(asked.where(F.col(stays).isNull()).select(*docs.columns))
    order = F.to_json(F.struct(*(c for c in docs.columns if c != "text")))  # the texts are equal
    repeated = asked.where(F.col(stays)).groupBy(key).agg(F.min_by(F.struct(*docs.columns), order).alias(doc)).select(f"{doc}.*")
    return whole.unionByName(repeated)
