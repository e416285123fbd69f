"""A small corpus with every awkward case: nulls, empties, one very long text, ties, repeats and near copies."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("row", T.StringType()), T.StructField("size", T.StringType()),
])


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(seed=1):
    """(doc_id, text) rows; the ids are unique but for one repeated row."""
    rng = random.Random(seed)
    passage = prose(rng, 30)
    base = [prose(rng, rng.randint(20, 90)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[3]), (21, base[3]), (22, base[4] + " tail"), (23, "x " + base[4])]
    rows += [(30 + i, f"{prose(rng, 15)} {passage} {prose(rng, 15)}") for i in range(4)]
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "one"), (44, "two words"), (45, prose(rng, 30_000)), (46, "a b " * 40), (47, "é ü ß 中文 x\x0by\x0cz\r\n")]
    lines = "first line here\nsecond line here\nthird line here"
    rows += [(50, f"{lines}\nfourth own line"), (51, f"intro\n{lines}"), (52, f"{lines}\n\n{lines}"), (53, "A B C\nd e\nf g\nh")]
    rows += [(60, "Same Words here NOW and then"), (60, "Same Words here NOW and then"), (None, base[0])]
    return rows


def frame(spark, rows):
    full = [(i, t, "en", None if i is None else f"s{i % 3}" if i % 7 else None, None if t is None else len(t), "k", "r", "s") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)
