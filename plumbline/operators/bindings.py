"""Proposals that bind a claim's roles to columns, and the tokens that confirm them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions import text, wording

#: The roles of each method with the kind of column that each takes, and the proposals a claim gets.
SLOTS = {
    "independent_t": (("outcome", "numeric"), ("group", "two_levels")), "paired_t": (("first", "numeric"), ("second", "numeric")), "one_way": (("outcome", "numeric"), ("group", "levels")),
    "ols": (("outcome", "numeric"), ("predictor", "numeric")), "pearson": (("x", "numeric"), ("y", "numeric")), "spearman": (("x", "numeric"), ("y", "numeric")), "chi_square": (("rows", "levels"), ("columns", "levels")),
}
MOST = 3

TOKENS = "token string, claim_id string, revision long, fingerprint string, binding string, issued_at long, revoked string"


def proposals(claims: DataFrame, columns: DataFrame) -> DataFrame:
    """claim, nth, method, first_role, first_column, second_role, second_column, reason and matched of up to MOST
    proposals for each claim (claim, family, sentence) over columns (alias, header, numeric, levels).

    Methods come from the family and the sentence's words. Each role's columns are ranked by the words that header and
    sentence share, then by alias; the best for both roles comes first, then the runner-up of the first role, then that
    of the second, no column twice. Claims meet the columns of one table, of which there are a few hundred at most."""
    asked = claims.select("claim", "family", "sentence", text.tokens(F.col("sentence")).alias("said"), wording.sentence_methods(F.col("sentence"), F.col("family"))["methods"].alias("methods"))
    slots = F.create_map(*(x for m, roles in SLOTS.items() for x in (F.lit(m), F.array(*(F.struct(F.lit(r).alias("role"), F.lit(k).alias("kind")) for r, k in roles)))))
    methods = asked.select("claim", "said", F.posexplode("methods").alias("choice", "method")).select("*", F.posexplode(F.element_at(slots, F.col("method"))).alias("slot", "need"))
    fits = F.when(F.col("need.kind") == "numeric", F.col("numeric")).when(F.col("need.kind") == "two_levels", F.col("levels") == 2).otherwise(F.col("levels") >= 2)
    met = methods.crossJoin(F.broadcast(columns.select("alias", "numeric", "levels", text.tokens(F.col("header")).alias("words")))).where(fits)  # the columns of one table
    met = met.withColumn("shared", F.array_intersect("words", "said"))
    candidates = F.array_sort(F.collect_list(F.struct((-F.size("shared")).alias("less"), "alias", "shared")))
    role = met.groupBy("claim", "choice", "method", "slot", F.col("need.role").alias("role")).agg(candidates.alias("c"))
    both = role.groupBy("claim", "choice", "method").agg(*(F.max(F.when(F.col("slot") == s, F.col(v))).alias(f"{v}{s}") for s in (0, 1) for v in ("role", "c"))).where(F.col("c0").isNotNull() & F.col("c1").isNotNull())
    picks = F.filter(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("turn")), F.when(F.size("c0") > 1, F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("turn"))), F.when(F.size("c1") > 1, F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(2).alias("turn")))), lambda p: p.isNotNull())
    rows = both.select("*", F.explode(picks).alias("p")).withColumn("first", F.get("c0", F.col("p.a")))
    free = F.filter("c1", lambda c: c["alias"] != F.col("first.alias"))
    rows = rows.withColumn("second", F.coalesce(F.get(free, F.col("p.b")), F.get(free, F.lit(0)))).where(F.col("second").isNotNull())
    matched = F.array_sort(F.array_distinct(F.concat("first.shared", "second.shared")))
    once = rows.groupBy("claim", "choice", "method", "role0", "role1", F.col("first.alias").alias("a0"), F.col("second.alias").alias("a1")).agg(F.min("p.turn").alias("turn"), F.first(matched).alias("matched"))
    once = once.withColumn("nth", F.row_number().over(W.partitionBy("claim").orderBy("choice", "turn"))).where(F.col("nth") <= MOST)
    reason = F.when(F.size("matched") > 0, "header_matches_sentence").otherwise("first_eligible_columns")
    return once.select("claim", F.col("nth").cast("long").alias("nth"), "method", F.col("role0").alias("first_role"), F.col("a0").alias("first_column"), F.col("role1").alias("second_role"), F.col("a1").alias("second_column"), reason.alias("reason"), F.array_join("matched", ",").alias("matched"))


def issued(records: DataFrame, secret: str, order: Sequence[str]) -> DataFrame:
    """TOKENS of records (claim_id, revision, fingerprint, binding, issued_at): a hash of the secret, of the record's turn
    for its claim and of the binding, so that no token can be guessed or stands for two records."""
    turn = F.row_number().over(W.partitionBy("claim_id").orderBy(*order))
    token = F.sha2(F.concat_ws("\n", F.lit(secret), F.col("claim_id"), turn.cast("string"), F.col("binding")), 256)
    return records.select(token.alias("token"), "claim_id", F.col("revision").cast("long").alias("revision"), "fingerprint", "binding", F.col("issued_at").cast("long").alias("issued_at"), F.lit(None).cast("string").alias("revoked"))


def revoked(tokens: DataFrame, doomed: DataFrame, because: str) -> DataFrame:
    """tokens with those of the claims in doomed (claim_id) revoked; one that is revoked keeps its first reason."""
    hit = doomed.select("claim_id").distinct().withColumn("hit", F.lit(True))
    return tokens.join(hit, "claim_id", "left").withColumn("revoked", F.coalesce("revoked", F.when(F.col("hit"), because))).select(*(c.split()[0] for c in TOKENS.split(", ")))


def looked_up(asked: DataFrame, tokens: DataFrame) -> DataFrame:
    """asked (token, claim_id, revision, fingerprint, binding) with gate: open, unknown, revoked:<why>, claim_mismatch or
    stale:<what> — what a token was given for is not what it is used for."""
    held = tokens.select("token", *(F.col(c).alias(f"held_{c}") for c in ("claim_id", "revision", "fingerprint", "binding")), "revoked")
    rows = asked.join(held, "token", "left")
    other = lambda c: ~F.col(c).eqNullSafe(F.col(f"held_{c}"))
    gate = (
        F.when(F.col("held_claim_id").isNull(), "unknown").when(F.col("revoked").isNotNull(), F.concat(F.lit("revoked:"), F.col("revoked"))).when(other("claim_id"), "claim_mismatch")
        .when(other("fingerprint"), "stale:fingerprint").when(other("revision"), "stale:claim_revision").when(other("binding"), "stale:binding").otherwise("open")
    )
    return rows.select(*asked.columns, gate.alias("gate"))
