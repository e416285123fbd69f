"""Helpers shared by the training-data operators: saved intermediates, row keys, sorted scans."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: the white space that separates words, in regular-expression form.
NOT_SPACE = r"[^\x20\x09-\x0D]+"

#: A null doc_id is treated as the largest possible id.
NO_ID = 2**63 - 1

#: Bits of a filter of keys: at most BITS / 64 rows of two longs, 16 MB, however many keys there are.
BITS = 1 << 26

#: Distinct words whose hashes a task remembers before it starts over.
WORD_MEMORY = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a local one if it runs locally."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/plumbline/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return the written table, whose lineage is only its files."""
    return Scratch(df.sparkSession).saved(df, name)


class Scratch:
    """Tables saved in the shared folder, deleted together at the end of a with-block.

    What leaves the block must not read them: it is saved by saved(), and then needs none of them, also when executors
    are lost."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        df.write.option("compression", "zstd").parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in map(jvm.org.apache.hadoop.fs.Path, self.paths):
            path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Names that df has no column of: those given, with as many underscores before them as that takes."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, ways: int = 16) -> DataFrame:
    """left joined to right (one row for each key), where one key may be on a third of the rows of left: these are dealt
    out over `ways` copies of right's row, by the column `by`."""
    (salt,) = free_name(left, "salt")
    left = left.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(ways)))
    right = right.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))))
    return left.join(right, [key, salt], "left").drop(salt)


def with_flag(rows: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """rows with a boolean column that is true where key is in keys (a table with that column) and rarely elsewhere.

    The keys set bits, one in BITS each, and only words of bits are broadcast: few for few keys, BITS / 64 at most. With
    more than some BITS keys the flag is true for nearly all rows, so what it saves goes, but no result."""
    word, bits = free_name(rows, "word", "bits")
    at = F.pmod(F.xxhash64(key), F.lit(BITS))
    bit = F.pmod(at, F.lit(64)).cast("int")
    filled = keys.groupBy(F.shiftright(at, 6).alias(word)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias(bits))
    rows = rows.withColumn(word, F.shiftright(at, 6)).join(F.broadcast(filled), word, "left")
    return rows.withColumn(flag, F.coalesce(F.getbit(bits, bit) == 1, F.lit(False))).drop(word, bits)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """One 128-bit key for each (doc_id, text); repeated rows share it, and so share every decision."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).cast("string"), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))))


class WordHashes(dict):
    """xxh64 of each word as bytes, remembered for a bounded number of distinct words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k word hashes, in order; empty when there are fewer than k."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = mix(words[:n] + np.uint64(k))
    for i in range(1, k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return h


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
