"""Claims on documents, state transitions and replay of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docledger.operators.skew import attach_per_key
from docledger.rules import TRANSITIONS
from docledger.schemas import CLAIM_KEY

RECLAIMABLE = ["FAILED", "REVIEW_REQUIRED"]
PROCESSED = ["STORED", "ARCHIVED"]
REPLAY_OWNER = "replay-worker"


def _join_claims(per_key: DataFrame, claims: DataFrame) -> DataFrame:
    held = claims.select(
        *CLAIM_KEY, F.col("status").alias("held_status"), F.col("owner_id").alias("held_owner")
    )
    return per_key.join(held, CLAIM_KEY, "left")


def claim(batch: DataFrame, claims: DataFrame, *keep: str) -> DataFrame:
    """Result of each claim attempt: claimed, already_processed or already_claimed, with the owner, plus columns to keep.

    ``batch``: key, owner_id and ``arrival``, which orders attempts and is unique. The first
    attempt on a free key wins; later ones see it taken.
    """
    winner = F.min(F.struct("arrival", "owner_id")).alias("_winner")
    attempts = attach_per_key(
        batch, CLAIM_KEY, ["arrival"], [winner], lambda per_key: _join_claims(per_key, claims)
    )
    free = F.col("held_status").isNull() | F.col("held_status").isin(RECLAIMABLE)
    won = free & (F.col("arrival") == F.col("_winner.arrival"))
    return attempts.select(
        *CLAIM_KEY,
        "arrival",
        F.when(won, F.lit("claimed"))
        .when(F.col("held_status").isin(PROCESSED), F.lit("already_processed"))
        .otherwise(F.lit("already_claimed"))
        .alias("claim_status"),
        F.when(free, F.col("_winner.owner_id")).otherwise(F.col("held_owner")).alias("owner_id"),
        *keep,
    )


def claims_after(batch: DataFrame, claims: DataFrame, now: str) -> DataFrame:
    """Rows of the claim table that a batch of attempts adds or changes."""
    winners = batch.groupBy(*CLAIM_KEY).agg(F.min(F.struct("arrival", "owner_id")).alias("_winner"))
    held = claims.select(
        *CLAIM_KEY,
        F.col("status").alias("_held"),
        F.col("claimed_at_utc").alias("_claimed_at"),
    )
    free = F.col("_held").isNull() | F.col("_held").isin(RECLAIMABLE)
    return winners.join(held, CLAIM_KEY, "left").where(free).select(
        *CLAIM_KEY,
        F.lit("CLAIMED").alias("status"),
        F.col("_winner.owner_id").alias("owner_id"),
        F.coalesce("_claimed_at", F.lit(now)).alias("claimed_at_utc"),
        F.lit(now).alias("updated_at_utc"),
    )


def merge_status(updates: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims with the last status of each key; updates of unknown keys are ignored.

    ``updates``: key, status, ``seq`` and ``updated_at_utc``.
    """
    last = updates.groupBy(*CLAIM_KEY).agg(
        F.max(F.struct("seq", "status", "updated_at_utc")).alias("_last")
    )
    return claims.join(last, CLAIM_KEY, "left").select(
        *CLAIM_KEY,
        F.coalesce("_last.status", "status").alias("status"),
        "owner_id",
        "claimed_at_utc",
        F.coalesce("_last.updated_at_utc", claims["updated_at_utc"]).alias("updated_at_utc"),
    )


def transition_result(from_state: Column, to_state: Column) -> Column:
    """``ok`` or the reason why a step between two states is not allowed."""
    source = F.upper(F.trim(from_state))
    target = F.upper(F.trim(to_state))
    states = list(TRANSITIONS)
    allowed = F.lit(False)
    for state, following in TRANSITIONS.items():
        if following:
            allowed = allowed | ((source == state) & target.isin(following))
    return (
        F.when(~source.isin(states), F.concat(F.lit("Unknown state: "), from_state))
        .when(~target.isin(states), F.concat(F.lit("Unknown state: "), to_state))
        .when(~allowed, F.concat(F.lit("Invalid transition: "), source, F.lit(" -> "), target))
        .otherwise(F.lit("ok"))
    )


def check_transitions(log: DataFrame, grain: str = "hour") -> DataFrame:
    """Check each state of a document against the one before it.

    ``log``: document_id, status, ts, seq. The predecessor is found within slices of time; the
    first entry of a slice takes the last one of the document's previous slice. A document with a
    very long history is thus spread over many tasks.
    """
    sliced = log.withColumn("_slice", F.date_trunc(grain, F.col("ts")))
    within = W.partitionBy("document_id", "_slice").orderBy("ts", "seq")
    steps = sliced.withColumn("_before", F.lag("status").over(within))
    ends = sliced.groupBy("document_id", "_slice").agg(
        F.max(F.struct("ts", "seq", "status"))["status"].alias("_last")
    )
    across = W.partitionBy("document_id").orderBy("_slice")
    carried = ends.select(
        "document_id", "_slice", F.lag("_last").over(across).alias("_carried")
    ).where(F.col("_carried").isNotNull())
    pairs = (
        steps.join(carried, ["document_id", "_slice"], "left")
        .withColumn("from_status", F.coalesce("_before", "_carried"))
        .where(F.col("from_status").isNotNull())
    )
    return pairs.select(
        "document_id",
        "seq",
        "from_status",
        F.col("status").alias("to_status"),
        transition_result(F.col("from_status"), F.col("status")).alias("result"),
    )


def classify_replay(dead_letters: DataFrame, claims: DataFrame, status: str) -> DataFrame:
    """Outcome per dead letter of one status: queued, already processed, or incomplete.

    ``dead_letters`` needs a unique ``seq``. Order among repeats does not matter, since replay
    never brings a key into a processed state.
    """
    def blank(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    letters = dead_letters.where(F.col("status") == status)
    known = attach_per_key(
        letters, CLAIM_KEY, ["seq"], [F.count(F.lit(1)).alias("_n")],
        lambda per_key: _join_claims(per_key, claims),
    )
    outcome = (
        F.when(blank("drive_file_id") | blank("file_hash") | blank("document_id"), "skipped_invalid")
        .when(F.col("held_status").isin(PROCESSED), "skipped_processed")
        .otherwise("queued_for_replay")
    )
    reason = (
        F.when(F.col("outcome") == "skipped_invalid", "missing drive_file_id/file_hash/document_id")
        .when(F.col("outcome") == "skipped_processed", "already_processed")
        .otherwise("claim_acquired")
    )
    return (
        known.withColumn("outcome", outcome)
        .withColumn("reason", reason)
        .select("seq", "document_id", *CLAIM_KEY, "status", "outcome", "reason")
    )


def replay_summary(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.count_if(F.col("outcome") == "queued_for_replay").alias("queued"),
        F.count_if(F.col("outcome") == "skipped_processed").alias("skipped_processed"),
        F.count_if(F.col("outcome") == "skipped_invalid").alias("skipped_invalid"),
    )


def reclaimed(classified: DataFrame, claims: DataFrame, now: str, owner: str = REPLAY_OWNER) -> DataFrame:
    """Claim rows that replay takes over: queued keys that were new or could be reclaimed."""
    queued = classified.where(F.col("outcome") == "queued_for_replay").select(
        *CLAIM_KEY, F.lit(owner).alias("owner_id"), F.col("seq").alias("arrival")
    )
    return claims_after(queued, claims, now)
