"""Vector search and evidence assembly in DataFrame operations."""

from __future__ import annotations

from collections import Counter
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions import text
from plumbline.operators.filters import maybe_in

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

#: Queries and chunks that meet in a task; queries whose products are taken at once.
BLOCK_QUERIES, PART_CHUNKS, TOGETHER = 4096, 20_000, 128

#: Ranges of ranks over which words are summed up.
RANGES = 64


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths and for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(doubles(v), lambda x: x / norm)).otherwise(doubles(v))


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str, vector_col: str) -> DataFrame:
    """The k rows nearest to one query by L2, ties by id; k = 0 gives none. Each task keeps k rows."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.where(F.size(vector_col) == len(query)).select(id_col, l2_distance(F.col(vector_col), q).alias("distance")).orderBy("distance", id_col).limit(k)


def knn_of_row(vectors: DataFrame, query: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """knn for a query that is a row of a table; without such a row there are no neighbours."""
    pairs = vectors.crossJoin(F.broadcast(query.select(F.col(vector_col).alias("__q")))).where(F.size(vector_col) == F.size("__q"))
    return pairs.select(id_col, l2_distance(F.col(vector_col), F.col("__q")).alias("distance")).orderBy("distance", id_col).limit(k)


def semantic_search(queries: DataFrame, chunks: DataFrame, k: int, least: int | None = None, terms: int = 4, where: Column | None = None) -> DataFrame:
    """qid, rank, cid, score and via of the k chunks (cid, text, vector) nearest to each query (qid, text, vector) by
    cosine, ties by cid, among those that `where` keeps.

    A query's `terms` longest tokens choose its candidates through an inverted index, and these alone are ranked (via
    lexical). Where fewer than `least` (k) are found, the query is ranked against all chunks instead (via all). Null
    texts have no tokens, vectors of another length score 0, null ones take no part. Ids must be distinct.

    Tokens that no query asks for are dropped before anything is shuffled. Blocks of queries meet parts of the chunks, each
    pair in a task of its own that multiplies matrices and sends on k rows of either kind and a count for each query."""
    least = k if least is None else least
    pool = (chunks if where is None else chunks.where(where)).select("cid", "text", "vector").where(F.col("vector").isNotNull())
    asked = queries.where(F.col("vector").isNotNull()).select("qid", text.distinctive_terms(text.tokens(F.col("text")), terms).alias("terms"), doubles(F.col("vector")).alias("query"))
    n, size = asked.count(), pool.count()
    blocks, parts = max(1, -(-n // BLOCK_QUERIES)), max(1, -(-size // PART_CHUNKS))
    # Not explode, for which Spark would put a filter below the caller's joins and so take all texts apart, and twice.
    held = maybe_in(pool.select("cid", F.explode_outer(text.tokens(F.col("text"))).alias("token")), "token", asked.select(F.explode_outer("terms").alias("token")))
    held = held.groupBy("cid").agg(F.collect_list("token").alias("tokens"))
    known = pool.select("cid", doubles(F.col("vector")).alias("vector")).join(held, "cid", "left").withColumn("part", F.pmod(F.xxhash64("cid"), F.lit(parts)))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    left = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("part", every(parts)).groupBy("block", "part")
    right = known.withColumn("block", every(blocks)).groupBy("block", "part")
    schema = f"qid {asked.schema['qid'].dataType.simpleString()}, cid {known.schema['cid'].dataType.simpleString()}, score double, via string, hits long"
    found = left.cogroup(right).applyInArrow(lambda a, b: nearest_of_part(a, b, k, least), schema)
    rich = F.sum("hits").over(W.partitionBy("qid")) >= least
    best = W.partitionBy("qid").orderBy(F.desc("score"), "cid")
    chosen = found.withColumn("rich", rich).where(F.col("via") == F.when(F.col("rich"), "lexical").otherwise("all"))
    ranked = chosen.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("qid", F.col("rank").cast("long").alias("rank"), "cid", "score", "via")


def nearest_of_part(asked: pa.Table, chunks: pa.Table, k: int, least: int) -> pa.Table:
    """Of each query (qid, terms, query): the count of chunks (cid, vector, tokens) that share a term, the k nearest of
    these, and of all if they are fewer than `least`. Products of matrices choose, and what they choose is computed again a
    term after the other, so that equal vectors score equally wherever they stand."""
    import numpy as np
    import pyarrow as pa

    cids, vectors = np.array(chunks["cid"].to_pylist(), object), chunks["vector"].to_pylist()
    where: dict[str, list[int]] = {}
    for i, tokens in enumerate(chunks["tokens"].to_pylist()):
        for token in tokens or ():
            where.setdefault(token, []).append(i)
    places = {token: np.array(at) for token, at in where.items()}
    usual = max(Counter(map(len, vectors)).items(), key=lambda x: x[1], default=(0, 0))[0]
    plain = np.array([len(v) == usual and None not in v for v in vectors], bool)
    matrix = np.array([v if ok else [0.0] * usual for v, ok in zip(vectors, plain, strict=True)], float).reshape(len(vectors), usual)
    norms = np.sqrt(in_order(matrix, matrix))
    with np.errstate(all="ignore"):
        units = matrix / np.where(norms > 0, norms, 1.0)[:, None]
    plain &= np.isfinite(units).all(1) & np.isfinite(norms) & ((norms == 0) | (norms > 1e-100))
    units[~plain] = 0.0
    odd = np.flatnonzero(~plain)

    def exact(query: list, at: np.ndarray) -> list[tuple[float | None, int]]:
        """(score, place) of the chunks at these places, as cosine() has it."""
        scores: list[float | None] = []
        own = np.array(query, float) if len(query) == usual and None not in query else None
        if own is not None:
            with np.errstate(all="ignore"):
                both = np.sqrt(in_order(own[None], own[None])[0]) * norms[at]
                scores = np.where(both == 0, 0.0, in_order(own[None], matrix[at]) / np.where(both == 0, 1.0, both)).tolist()
        out = []
        for j, i in enumerate(at.tolist()):
            v = vectors[i]
            if len(v) != len(query):
                out.append((0.0, i))
            elif None in v or None in query:
                out.append((None, i))
            elif own is not None:
                out.append((scores[j], i))
            else:
                with np.errstate(all="ignore"):
                    x, y = np.array([query], float), np.array([v], float)
                    both = np.sqrt(in_order(x, x)[0]) * np.sqrt(in_order(y, y)[0])
                    out.append((0.0 if both == 0 else float(in_order(x, y)[0] / both), i))
        return out

    def first(query: list, rough: np.ndarray | None, at: np.ndarray | None) -> list[tuple[float | None, int]]:
        if rough is not None:
            near = rough if at is None else rough[at]
            if len(near) > k:
                kth = np.partition(near, len(near) - k)[len(near) - k]
                keep = near >= kth - 1e-9
                if at is None:
                    keep[odd] = True
                else:
                    keep |= ~plain[at]
                at = np.flatnonzero(keep) if at is None else at[keep]
        found = exact(query, np.arange(len(vectors)) if at is None else at)
        rank = lambda x: (x[0] is None, 0 if x[0] is None else -np.inf if np.isnan(x[0]) else -x[0], x[0] is not None and not np.isnan(x[0]), cids[x[1]])
        return sorted(found, key=rank)[:k]

    out: dict[str, list] = {c: [] for c in ("qid", "cid", "score", "via", "hits")}
    ids, terms, queries = (asked[c].to_pylist() for c in ("qid", "terms", "query"))
    for start in range(0, len(ids) if len(vectors) else 0, TOGETHER):
        block = range(start, min(start + TOGETHER, len(ids)))
        usable = [len(queries[q]) == usual and None not in queries[q] for q in block]
        with np.errstate(all="ignore"):
            own = np.array([queries[q] if ok else [0.0] * usual for q, ok in zip(block, usable, strict=True)], float).reshape(len(block), usual)
            length = np.sqrt(in_order(own, own))
            usable = np.array(usable) & np.isfinite(length) & (length > 1e-100)
            own = np.where(usable[:, None], own, 0.0) / np.where(usable, length, 1.0)[:, None]
        table = own @ units.T
        for j, q in enumerate(block):
            rough = table[j] if usable[j] else None
            shared = [places[t] for t in terms[q] or () if t in places]
            at = np.unique(np.concatenate(shared)) if shared else np.empty(0, int)
            rows = [("lexical", x) for x in first(queries[q], rough, at)] if len(at) else []
            if len(at) < least:
                rows += [("all", x) for x in first(queries[q], rough, None)]
            for via, (score, i) in rows:
                for c, v in zip(out, (ids[q], cids[i], score, via, 0), strict=True):
                    out[c].append(v)
            for c, v in zip(out, (ids[q], None, None, "count", len(at)), strict=True):
                out[c].append(v)
    kinds = {"qid": asked.schema.field("qid").type, "cid": chunks.schema.field("cid").type, "score": pa.float64(), "via": pa.string(), "hits": pa.int64()}
    return pa.table({c: pa.array(v, kinds[c], from_pandas=False) for c, v in out.items()})


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the products of a and b, summed up from the first column to the last."""
    import numpy as np

    total = np.zeros(np.broadcast_shapes(a.shape, b.shape)[0])
    with np.errstate(all="ignore"):
        for i in range(b.shape[1]):
            total += a[:, i] * b[:, i]
    return total


def only_space(rows: DataFrame, *columns: str) -> dict:
    """The one value of columns that all rows share; an error if there is none or more than one."""
    found = rows.select(*columns).distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("no vectors" if not found else "vectors of more than one space")
    return found[0].asDict()


def within_budget(ranked: DataFrame, budget: int, rank: str, words: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of each group, by rank (a number), up to the first that would overrun the budget of words; the first
    always.

    Words are first summed up over ranges of ranks, and only the ranges that begin within the budget go on, so that the
    rows of a group are never put in order as a whole."""
    key, part, start = "__g", "__part", "__start"
    rows = ranked.withColumn(key, F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by))) if by else F.lit(0))  # structs join where nulls meet
    edges = rows.groupBy(key).agg(F.percentile_approx(rank, [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("__edges"))
    parts = rows.join(edges, key).withColumn(part, F.size(F.filter("__edges", lambda e: e < F.col(rank)))).withColumn("__end", F.get("__edges", F.col(part)))
    ahead = W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sums = parts.groupBy(key, part).agg(F.sum(words).alias("__words"), F.max("__end").alias("__end")).withColumn(start, F.coalesce(F.sum("__words").over(ahead), F.lit(0)))
    open_parts = sums.withColumn("__most", F.max(start).over(ahead.rowsBetween(W.unboundedPreceding, W.currentRow))).where(F.col("__most") <= budget)
    reach = open_parts.groupBy(key).agg(F.max_by("__end", part).alias("__end"))  # an edge and not its number, as edges may come out otherwise when made again
    w = W.partitionBy(key).orderBy(rank)
    rows = rows.join(reach, key).where(F.col("__end").isNull() | (F.col(rank) <= F.col("__end"))).withColumn("used", F.sum(words).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    over = (F.col("used") > budget) & (F.row_number().over(w) > 1)
    rows = rows.withColumn("cut", F.max(over.cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.where("cut = 0").drop("cut", key, "__end")


def budget_words(tokens: Column, words_per_token: float = 0.767) -> Column:
    return F.floor(tokens * words_per_token)


def latest(rows: DataFrame, keys: tuple[str, ...], time: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(time, tie)).alias("row")).select(*keys, "row.*")


def islands(rows: DataFrame, by: tuple[str, ...], seq: str) -> DataFrame:
    """Runs of consecutive numbers of seq in each group: first, last and n."""
    distinct = rows.select(*by, F.col(seq).cast("long").alias("seq")).distinct()
    run = F.col("seq") - F.row_number().over(W.partitionBy(*by).orderBy("seq"))
    return distinct.withColumn("run", run).groupBy(*by, "run").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n")).drop("run")


def hash_embed(df: DataFrame, text_col: str, out_col: str = "vector", dim: int = 384) -> DataFrame:
    """df with a feature-hash embedding: letter-digit runs in small letters, FNV-1a of 64 bits, the index by its rest,
    the sign by its top bit, to unit length."""
    import numpy as np
    import pandas as pd

    def fnv(word: bytes) -> int:
        h = 0xCBF29CE484222325
        for b in word:
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return h

    @F.pandas_udf("array<float>", F.PandasUDFType.SCALAR)
    def embed(texts):
        import re

        known: dict[str, int] = {}
        out = []
        for text in texts:
            v = np.zeros(dim)
            for word in re.findall(r"[^\W_]+", (text or "").lower()):
                h = known.get(word)
                if h is None:
                    h = known[word] = fnv(word.encode())
                v[h % dim] += -1.0 if h >> 63 else 1.0
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).astype(np.float32))
        return pd.Series(out)

    return df.withColumn(out_col, embed(text_col))


def stored(store: DataFrame, new: DataFrame, space: str) -> DataFrame:
    """store (id, space, vector) with new vectors (id, vector) of a space put in, in place of those of the same id and
    space. Vectors of other spaces stay, as they are not comparable."""
    coming = new.select("id", F.lit(space).alias("space"), "vector")
    return store.join(coming, ["id", "space"], "left_anti").select("id", "space", "vector").unionByName(coming)


def fetched(store: DataFrame, ids: DataFrame, space: str) -> DataFrame:
    """id, vector and found for each of the ids, in one space."""
    held = store.where(F.col("space") == space).select("id", "vector")
    return ids.select("id").join(held, "id", "left").withColumn("found", F.col("vector").isNotNull())


def cross_similarity(chunks: DataFrame, first: int = 12) -> DataFrame:
    """doc_a, doc_b, pairs, best and mean cosine between the first chunks (doc, seq, vector) of each two documents, doc_a
    before doc_b. Every two documents are compared, so the work grows with their square: it is a study of a few
    documents, `first` chunks of each; those beyond are not read, as they are beyond the study."""
    some = chunks.withColumn("nth", F.row_number().over(W.partitionBy("doc").orderBy("seq"))).where(F.col("nth") <= first).select("doc", "vector")
    a, b = some.select(F.col("doc").alias("doc_a"), F.col("vector").alias("a")), some.select(F.col("doc").alias("doc_b"), F.col("vector").alias("b"))
    score = a.join(b, F.col("doc_a") < F.col("doc_b")).select("doc_a", "doc_b", cosine(F.col("a"), F.col("b")).alias("s"))
    return score.groupBy("doc_a", "doc_b").agg(F.count("*").alias("pairs"), F.max("s").alias("best"), F.avg("s").alias("mean"))


def to_blob(v: Column) -> Column:
    """A vector as little-endian 32-bit floats."""
    import numpy as np

    @F.pandas_udf("binary", F.PandasUDFType.SCALAR)
    def pack(x):
        return x.map(lambda a: None if a is None else np.asarray(a, "<f4").tobytes())

    return pack(v)


def from_blob(blob: Column) -> Column:
    """The vector of a blob; null where the length is no multiple of four."""
    import numpy as np

    @F.pandas_udf("array<float>", F.PandasUDFType.SCALAR)
    def unpack(x):
        return x.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return unpack(blob)
