"""Training-order materialisation: token sequences in the order of a keyed permutation, as fixed-stride shard files.

The documents' token ids form one stream, in the order of their files and rows, so that neither file splits nor the size
of the cluster change it; a table that is not read from Parquet files is written first. Sequence i is the `context` ids from i * context on. A Feistel network keyed
by a seed permutes the sequence numbers; a result beyond the last number goes through it again until it is not
(cycle-walking), so every sequence gets a slot of its own and nothing is kept in memory. The pieces of documents are
range-partitioned by shard and written as flat files of n * stride bytes: the record of slot s is in the file of shard
s // per_shard at byte (s % per_shard) * stride, little-endian 16-bit ids. A reader seeks to any slot and goes on from
there. A shard is written under another name and then moved, so a task that runs again writes the same file.

Null and empty texts are their end id alone; texts of any length are read whole. Only the last sequence is padded.
Repeated rows are written each. An empty table gives no shards. Other columns, doc_id included, are not read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from plumbline.llm.common import Scratch, mix, partitions_for, saved
from plumbline.llm.packing import word_ids

CONTEXT, PER_SHARD, END_ID, PAD_ID, ROUNDS = 2048, 1024, 1, 65535, 6

#: Characters of text that are tokenised together; token ids in a row of the stream at most.
TOGETHER, RUN = 1 << 20, 1 << 15

#: What is known of each record: its place, the number of its sequence before the permutation, its ids without padding.
RECORD = "slot long, shard long, byte_offset long, number long, n_tokens long, crc32 long"


def feistel(x: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A permutation of 0 .. size - 1, at x."""
    half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [np.uint64(xxhash.xxh64_intdigest(f"{seed}:{r}")) for r in range(ROUNDS)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for key in keys:
            left, right = right, left ^ (mix(right + key) & mask)
        return left << half | right

    out = once(np.asarray(x, np.uint64))
    while (beyond := out >= np.uint64(size)).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def positioned(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """file, block (where the split that one task reads begins in it) and text, in the order of rows within a split."""
    try:
        return docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "text")
    except AnalysisException:  # not from Parquet files
        return positioned(scratch.saved(docs.select("text"), "shard-texts"), scratch)


def tokenised(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The stream in runs: file and block name the split that a run is of, whichever of its rows are there, start is its
    place among the ids of these; n and ids (little-endian 16-bit). Each text ends with the end id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(vocabulary)
        split, start = None, 0
        for batch in batches:
            texts, names, blocks = batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch.column(1).to_numpy()
            sizes = np.cumsum([len(t or "") for t in texts])
            cuts = np.flatnonzero(np.diff(sizes // TOGETHER)) + 1
            others = [i for i in range(1, len(texts)) if blocks[i] != blocks[i - 1] or names[i] != names[i - 1]]
            for part in np.split(np.arange(len(texts)), np.union1d(cuts, others).astype(np.int64)):
                if not len(part):
                    continue
                name, block = names[part[0]], int(blocks[part[0]])
                if (name, block) != split:
                    split, start = (name, block), 0
                ids = known.stream([texts[i] for i in part], END_ID)[0].astype("<u2")
                runs = [ids[i : i + RUN] for i in range(0, len(ids), RUN)]
                n = np.array([len(x) for x in runs])
                starts = start + np.cumsum(n) - n
                start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(runs)), pa.array([block] * len(runs), pa.int64()), pa.array(starts), pa.array(n), pa.array([x.tobytes() for x in runs], pa.binary())], names=["file", "block", "start", "n", "ids"])

    return docs.mapInArrow(read, "file string, block long, start long, n long, ids binary")


def placed(tokens: DataFrame) -> DataFrame:
    """start (in the whole stream) and ids of each run. The window, and the broadcast, have one row for each split."""
    order = W.orderBy("file", "block")
    counts = tokens.groupBy("file", "block").agg(F.sum("n").alias("all"))
    before = counts.select("file", "block", (F.sum("all").over(order) - F.col("all")).alias("before"))
    return tokens.join(F.broadcast(before), ["file", "block"]).select((F.col("before") + F.col("start")).alias("start"), "ids")


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


def materialised(docs: DataFrame, vocabulary: str, path: str | None = None, seed: int = 7, context: int = CONTEXT, per_shard: int = PER_SHARD) -> DataFrame:
    """RECORD for each sequence of docs; with path, their shards are written there, a new folder that driver and
    executors share.

    vocabulary: a tokenizer of less than 65535 ids whose tokens never reach across white space."""
    spark, stride = docs.sparkSession, 2 * context
    if path:
        file_system(path)[0].create_dir(file_system(path)[1], recursive=True)

    with Scratch(spark) as scratch:
        tokens = scratch.saved(tokenised(positioned(docs, scratch), vocabulary), "shard-tokens")
        size = -(-tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // context)
        shards, n = -(-size // per_shard), partitions_for(spark)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = pa.Codec("zstd", compression_level=1)  # ids of one part take two thirds of their bytes, on disk too
            for b in batches:
                for start, ids in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                    ends = np.append(np.arange(context - start % context, len(ids) // 2, context), len(ids) // 2)
                    begins = np.append(0, ends[:-1])
                    number, offset = np.divmod(start + begins, context)
                    slot = feistel(number, size, seed)
                    parts = [codec.compress(ids[2 * i : 2 * j], asbytes=True) for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot), pa.array(number), pa.array(offset), pa.array(ends - begins), pa.array(parts, pa.binary())], names=["shard", "slot", "number", "offset", "n", "part"])

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, held, known, codec = None, bytearray(), {}, pa.Codec("zstd")
            for b in batches:
                for at, slot, number, offset, n, part in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                    if at != shard:
                        if shard is not None:
                            yield filled(shard, held, known)
                        shard, known = at, {}
                        held = bytearray(PAD_ID.to_bytes(2, "little") * (context * min(per_shard, size - at * per_shard)))
                    place = (slot % per_shard) * stride + 2 * offset
                    held[place : place + 2 * n] = codec.decompress(part, 2 * n, asbytes=True)
                    known[slot] = number, known.get(slot, (0, 0))[1] + n
            if shard is not None:
                yield filled(shard, held, known)

        def filled(shard: int, held: bytearray, known: dict[int, tuple[int, int]]) -> pa.RecordBatch:
            if path:
                fs, folder = file_system(path)
                name = f"{folder}/{shard:010d}.bin"
                other = f"{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(other) as f:
                    f.write(held)
                fs.move(other, name)
            slots = sorted(known)
            at = [slot % per_shard * stride for slot in slots]
            columns = [slots, [shard] * len(slots), at, [known[x][0] for x in slots], [known[x][1] for x in slots], [zlib.crc32(held[i : i + stride]) for i in at]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["slot", "shard", "byte_offset", "number", "n_tokens", "crc32"])

        pieces = placed(tokens).mapInArrow(cut, "shard long, slot long, number long, offset long, n long, part binary")
        # The permutation spreads sequences evenly, so ranges of equally many shards need no sample.
        ranges = F.expr(f"cast(shard * {n} div {max(1, shards)} as int)")
        pieces = pieces.repartitionById(n, ranges).sortWithinPartitions("shard")
        index = saved(pieces.mapInArrow(fill, RECORD), "shard-index")
    if path:
        with file_system(path)[0].open_output_stream(f"{file_system(path)[1]}/shards.json") as f:
            f.write(json.dumps({"sequences": size, "context": context, "per_shard": per_shard, "seed": seed}).encode())
    return index


def read(spark: SparkSession, path: str, from_slot: int = 0) -> DataFrame:
    """slot, shard, byte_offset and tokens of the records that write() wrote, in training order from a slot on."""
    fs, folder = file_system(path)
    with fs.open_input_file(f"{folder}/shards.json") as f:
        about = json.loads(f.read())
    stride, per_shard, size = 2 * about["context"], about["per_shard"], about["sequences"]

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(path)
        for b in batches:
            for shard in b.column(0).to_pylist():
                slots = range(max(from_slot, shard * per_shard), min(size, (shard + 1) * per_shard))
                with fs.open_input_file(f"{folder}/{shard:010d}.bin") as f:
                    f.seek(slots.start % per_shard * stride)
                    records = [f.read(stride) for _ in slots]
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array([shard] * len(slots), pa.int64()), pa.array([s % per_shard * stride for s in slots], pa.int64()), pa.array(records, pa.binary())], names=["slot", "shard", "byte_offset", "tokens"])

    first, last = from_slot // per_shard, -(-size // per_shard)
    shards = spark.range(first, max(first, last), numPartitions=max(1, min(partitions_for(spark), last - first)))
    return shards.mapInArrow(seek, "slot long, shard long, byte_offset long, tokens binary").orderBy("slot")
