"""Documents through quality rules, line dedup, near-duplicate removal, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Each
works on all that the one before kept, and its decisions take effect: rejected documents go, repeated lines are cut
out, one document of each near-duplicate group stays, sources are taken from by weight (a document taken twice is two
rows, one taken in part is cut), and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import line_dedup, mixing, near_dup, packing, quality_rules
from plumbline.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule rejects."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that only later occurrences of three-line windows cover."""
    return line_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 or more over five-word shingles."""
    return near_dup.one_of_each(docs, words=5, num=80, den=100)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As much text as before, split over the sources by weights 5, 2, 1, none beyond twice what it has."""
    return mixing.texts(docs, mixing.mix(docs, weights=(5, 2, 1), share=1.0, cap=2))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids, sequence and offset."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("sequences", sequences)]

#: The stages of near duplicates (components), shuffled order and token ids are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
