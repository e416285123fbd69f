"""Packing tokenised documents into sequences, shortest pack first over the length histogram.

Documents become token ids (by a public tokenizer, plus an end id) and are cut into pieces of at most `context`
tokens. Only the histogram of piece lengths, at most `context` numbers, reaches the driver: lengths are placed
longest first, each into the packs that are shortest so far, counting packs by their pattern of lengths instead of
one by one. Pieces then find their place by their rank among pieces of the same length.

Null texts count as empty; an empty text is one piece that holds the end id. Repeated rows are packed each on its own.
An empty table gives an empty table. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import math
import os
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.llm.common import saved

CONTEXT, END_ID = 2048, 1

#: Distinct words whose ids a worker remembers; characters whose words are looked up together; pieces of one length
#: that are ranked together, on average.
REMEMBERED, GROUP_CHARS, RANKED_TOGETHER = 200_000, 1 << 20, 16_384


class WordIds(dict):
    """Each word's ids as little-endian 32-bit bytes. White space always separates tokens of the tokenizers used
    here, so a text's ids are those of its words; a word is looked up instead of being merged again.

    New words of letters only are tokenised many at a time: in a vocabulary with word ends each is one run of ids up
    to a word end. Punctuation after such a word, and ASCII capitals, do not change its ids. When there are too many
    words, those not met since the last time are forgotten."""

    STOPS, TOGETHER = string.punctuation.encode(), 2000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread would keep memory
        from tokenizers import Tokenizer

        self.tokenizer, self.before = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.code = [i.to_bytes(4, "little") for i in range(len(self.ends))]
        self.plain = self.leaves_letters()

    def leaves_letters(self) -> bool:
        """Whether words of the letters a-z reach the model as they are, so that it can be asked for their ids itself."""
        letters, before, normalizer = string.ascii_lowercase, self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        same = normalizer is None or normalizer.normalize_str(letters) == letters
        return same and before is not None and all(before.pre_tokenize_str(x) == [(x, (0, len(x)))] for x in (letters, letters[::-1], *letters))

    def singly(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of each text, given as its words."""
        ids, sizes = self.coded(pa.array([w for words in texts for w in words], pa.binary()))
        ends = np.cumsum(np.append(0, sizes))[np.cumsum([len(words) for words in texts])]
        return [x.tobytes() for x in np.split(ids, ends)[: len(texts)]]

    def stream(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, each text with end_id behind it, one after another, and where each text ends."""
        words, counts = split(texts)
        ids, sizes = self.coded(words)
        ends = np.cumsum(np.append(0, sizes))[np.cumsum(counts)]
        return np.insert(ids, ends, end_id), ends + np.arange(1, len(texts) + 1)

    def coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each word has. Each different word is looked up once."""
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()
        encoded = words.dictionary_encode()
        distinct = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist() makes an object more for each
        found = list(map(self.get, distinct))
        if None in found:
            now = self.resolved([w for w, ids in zip(distinct, found, strict=True) if ids is None])
            found = [now[w] if ids is None else ids for w, ids in zip(distinct, found, strict=True)]
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = encoded.indices.to_numpy()
        sizes = n[which]
        ahead = (np.cumsum(n) - n)[which] - (np.cumsum(sizes) - sizes)  # of a word's ids, from where they go to where they are
        return np.frombuffer(b"".join(found), "<u4")[np.repeat(ahead, sizes) + np.arange(sizes.sum())], sizes

    def resolved(self, unknown: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new words, which are known from now on."""
        again = dict(zip(unknown, map(self.before.get, unknown), strict=True))
        new = [w for w, ids in again.items() if ids is None]
        if self.plain:
            merged, code = self.tokenizer.model.tokenize, self.code
            letters = [w for w in new if w.isalpha() and w.islower()]  # of bytes: a-z only
            again.update((w, b"".join([code[x.id] for x in merged(w.decode())])) for w in letters)
            new = [w for w in new if again[w] is None]
        cores = {w: w.rstrip(self.STOPS) for w in new}
        runs = {c: ids for c in set(cores.values()) if (ids := again.get(c) or self.get(c)) is not None}
        new = [c for c in set(cores.values()) if c not in runs and c.decode().isalpha()] if self.ends.any() else []
        groups = [new[i : i + self.TOGETHER] for i in range(0, len(new), self.TOGETHER)]
        for group in groups:  # one at a time: encodings are some hundred bytes a token
            (encoding,) = self.tokenizer.encode_batch_fast([b" ".join(group).decode()], add_special_tokens=False)
            ids = np.array(encoding.ids, "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(cuts) == len(group) + 1:  # else one of them is more than one run, and they are taken singly
                run = ids.tobytes()
                runs.update(zip(group, (run[i:j] for i, j in zip(cuts, cuts[1:], strict=False)), strict=True))
        tails: dict[bytes, bytes] = {b"": b""}
        for word, core in cores.items():
            tail = word[len(core) :]
            if tail not in tails:
                tails[tail] = self.singly(tail)
            again[word] = runs[core] + tails[tail] if core in runs else self.singly(word)
        self.update(runs)
        self.update(again)
        return again


#: Bytes that separate words; what a stop ends a word behind, and stands ahead of, if it is to be a word of its own.
WHITE, LETTER, BREAK = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\v\f\r", (string.ascii_lowercase + string.digits).encode(), b" \n"))


def split(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """Words with the ids of the texts', one text after another, and how many each has. Where that cannot change ids,
    capitals are made small and a stop after a letter or digit is a word of its own, so that there are fewer different
    words."""
    raw = [(text or "").encode() for text in texts]
    plain = np.array([b"<|" not in x and b"\xcc" not in x and b"\xcd" not in x for x in raw], bool)  # special tokens; signs that combine with letters
    signs = np.frombuffer(b"".join([(x.lower() if small else x) + b"\n" for x, small in zip(raw, plain, strict=True)]), np.uint8)
    begins = np.cumsum([0, *(len(x) + 1 for x in raw)])
    white = WHITE[signs]
    first = ~white
    first[1:] &= white[:-1]
    stops = np.flatnonzero((signs == ord(".")) | (signs == ord(",")))
    stops = stops[LETTER[signs[stops - 1]] & BREAK[signs[stops - len(signs) + 1]]]  # there is an end of line behind each, and ahead of the first
    first[stops[plain[np.searchsorted(begins, stops, "right") - 1]]] = True
    at = np.flatnonzero(first)
    offsets = np.append(at - np.searchsorted(np.flatnonzero(white), at), len(signs) - np.count_nonzero(white)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(signs[~white])])
    return words, np.diff(np.searchsorted(at, begins))


def words_of(text: str | None) -> list[bytes]:
    """The words of split(), of one text."""
    return split([text])[0].to_pylist()


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, vocabulary: str, context: int = CONTEXT, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Rows doc_id, start, length, doc_tokens, ids_crc32 and, with_ids, ids (32-bit little-endian).

    vocabulary: the file of a tokenizer whose tokens never reach across white space."""
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "doc_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})
    schema = pa.schema(list(kinds.items()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(vocabulary)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sizes = np.cumsum([len(x or "") for x in texts])
            for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes // GROUP_CHARS)) + 1):
                if not len(rows):
                    continue
                ids, ends = known.stream([texts[i] for i in rows], end_id)
                ids = ids.tobytes()
                out: dict[str, list] = {c: [] for c in kinds}
                for i, begin, upto in zip(rows.tolist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                    n = upto - begin
                    for start in range(0, n, context):
                        piece = ids[4 * (begin + start) : 4 * min(begin + start + context, upto)]
                        for c, v in zip(out, (doc_ids[i], start, len(piece) // 4, n, zlib.crc32(piece), piece), strict=False):
                            out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def patterns(histogram: dict[int, int], context: int = CONTEXT) -> list[tuple[int, dict[int, int]]]:
    """(packs, {length: pieces in each}) from {length: pieces}: longest lengths first, into the shortest packs."""
    packs: dict[tuple[int, ...], int] = {}  # pattern, longest first: its packs
    heap: list[tuple[int, tuple[int, ...]]] = []  # (tokens, pattern), the shortest on top

    def add(pattern: tuple[int, ...], n: int) -> None:
        if pattern not in packs:
            heapq.heappush(heap, (sum(pattern), pattern))
        packs[pattern] = packs.get(pattern, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not heap or heap[0][0] + length > context:
                add((length,), left)
                break
            used, pattern = heap[0]
            n = packs[pattern]
            if n > left:
                packs[pattern] -= left
            else:
                heapq.heappop(heap)
                del packs[pattern]
            add((*pattern, length), min(n, left))
            left -= min(n, left)
    return [(n, {x: p.count(x) for x in dict.fromkeys(p)}) for p, n in packs.items()]


def places(found: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, pieces, in_each, first_sequence, first_offset): pieces of that length from first_rank
    on go to that many packs of one pattern, in_each to each, from first_offset on."""
    rows, taken, sequence = [], {}, 0
    for n, pattern in found:
        offsets = accumulate((x * m for x, m in pattern.items()), initial=0)
        for (length, m), offset in zip(pattern.items(), offsets, strict=False):
            rows.append((length, taken.get(length, 0), n * m, m, sequence, offset))
            taken[length] = taken.get(length, 0) + n * m
        sequence += n
    return rows


def ranked(df: DataFrame, total: int) -> DataFrame:
    """Adds rank, from 0, among the rows of a length; pieces are ranked in hash buckets, whose counts are summed up,
    so that a length that a third of all pieces have is not ordered in one task."""
    buckets = max(1, math.ceil(total / RANKED_TOGETHER))
    rows = df.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = counts.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("earlier"))
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    return rows.withColumn("within", within).join(counts, ["length", "bucket"]).withColumn("rank", F.col("earlier") + F.col("within") - 1).drop("bucket", "within", "earlier")


def pack(cut: DataFrame, context: int = CONTEXT) -> DataFrame:
    """cut (doc_id, start, length, doc_tokens, ids_crc32 and more, read several times) with sequence_id and offset.

    The table of patterns is broadcast: with `context` lengths it has some thousand rows at any input size."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most context rows
    table = spark.createDataFrame(places(patterns(histogram, context)), "of_length long, first_rank long, pieces long, in_each long, first_sequence long, first_offset long")
    rank = F.col("rank") - F.col("first_rank")
    placed = ranked(cut, sum(histogram.values())).join(F.broadcast(table), (F.col("length") == F.col("of_length")) & (rank >= 0) & (rank < F.col("pieces")))
    return placed.select(*cut.columns, (F.col("first_sequence") + F.floor(rank / F.col("in_each"))).alias("sequence_id"), (F.col("first_offset") + rank % F.col("in_each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, context: int = CONTEXT, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """docs cut into pieces and packed: the columns of pieces() with sequence_id and offset."""
    return pack(saved(pieces(docs, vocabulary, context, end_id, with_ids), "pack-pieces"), context)
