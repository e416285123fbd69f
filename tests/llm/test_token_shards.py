import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import token_shards
from plumbline.llm.queries import vocabulary
from tests.llm.fixtures import SCHEMA, corpus, frame


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation(size):
    x = np.arange(size)
    y = token_shards.feistel(x, size, 7)
    assert sorted(y.tolist()) == x.tolist()
    assert size < 64 or (y != token_shards.feistel(x, size, 8)).any() and (y != x).any()


def test_shards_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    frame(spark, corpus()).repartition(2).write.parquet(str(tmp_path / "docs"))
    docs, path = spark.read.parquet(str(tmp_path / "docs")), str(tmp_path / "shards")
    index = token_shards.materialised(docs, vocabulary(), path, context=64, per_shard=8).orderBy("slot").collect()
    rows = token_shards.read(spark, path).collect()
    n = len(rows)
    assert [r.slot for r in index] == [r.slot for r in rows] == list(range(n)) and sorted(r.number for r in index) == list(range(n))
    assert all(r.shard == r.slot // 8 and r.byte_offset == r.slot % 8 * 128 for r in index)
    with open(f"{path}/{11 // 8:010d}.bin", "rb") as f:  # a slot by seeking
        f.seek(11 % 8 * 128)
        assert f.read(128) == bytes(rows[11].tokens)
    assert [zlib.crc32(bytes(r.tokens)) for r in rows] == [r.crc32 for r in index]
    tokenizer = Tokenizer.from_file(vocabulary())
    want = sorted(tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in corpus())
    ids = np.concatenate([np.frombuffer(bytes(rows[r.slot].tokens), "<u2")[: r.n_tokens] for r in sorted(index, key=lambda r: r.number)])
    got, at = [], 0
    for i in np.flatnonzero(ids == 1):
        got.append(tuple(ids[at : i + 1].tolist()))
        at = i + 1
    assert sorted(got) == want and sum(r.n_tokens < 64 for r in index) <= 1
    later = token_shards.read(spark, path, from_slot=11).collect()
    assert [(r.slot, bytes(r.tokens)) for r in later] == [(r.slot, bytes(r.tokens)) for r in rows[11:]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    other = token_shards.materialised(docs, vocabulary(), context=64, per_shard=8).orderBy("slot").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in other] == [tuple(r) for r in index]  # other splits, the same order
    made = token_shards.materialised(frame(spark, corpus()).repartition(3), vocabulary(), context=64, per_shard=8)
    assert made.count() == n and made.agg(F.sum("n_tokens")).first()[0] == sum(map(len, want))
    empty = str(tmp_path / "empty")
    assert token_shards.materialised(spark.createDataFrame([], SCHEMA), vocabulary(), empty).count() == token_shards.read(spark, empty).count() == 0


def test_query_writes_its_shards(spark, tmp_path):
    from plumbline.llm.queries import op7_token_shards

    frame(spark, corpus()).write.parquet(str(tmp_path / "documents.parquet"))
    index = op7_token_shards(spark, str(tmp_path)).orderBy("slot").collect()
    rows = token_shards.read(spark, index[0].path).collect()
    assert [(r.slot, r.shard, r.byte_offset, zlib.crc32(bytes(r.tokens))) for r in rows] == [(r.slot, r.shard, r.byte_offset, r.crc32) for r in index]


def test_a_filtered_table_has_one_stretch_a_split(spark, tmp_path):
    frame(spark, corpus()).repartition(2).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs")).where("doc_id % 2 = 0")
    runs = token_shards.tokenised(token_shards.positioned(docs, None), vocabulary()).collect()
    assert len({(r.file, r.block) for r in runs}) <= 2
    index = token_shards.materialised(docs, vocabulary(), context=64, per_shard=8)
    assert index.agg(F.sum("n_tokens")).first()[0] == sum(r.n for r in runs)
