"""Routing of validated documents to ledger, review queue and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.checks import error_text
from docledger.functions.once import compute_once
from docledger.rules import DECISION_THRESHOLD, REVIEW_THRESHOLD, STORE_REVIEW_SCORE
from docledger.schemas import RECORD_FIELDS


def review_reasons(valid: Column, confidence: Column, threshold: float = DECISION_THRESHOLD) -> Column:
    reasons = F.array(
        F.when(~valid, F.lit("validation_failed")),
        F.when(confidence < threshold, F.lit("low_confidence")),
    )
    return F.filter(reasons, lambda reason: reason.isNotNull())


def decide(df: DataFrame, threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """Add ``reason_codes`` and ``decision``: REVIEW_REQUIRED when there is any reason."""
    return df.withColumn(
        "reason_codes", review_reasons(F.col("is_valid"), F.col("model_confidence"), threshold)
    ).withColumn(
        "decision",
        F.when(F.size("reason_codes") > 0, F.lit("REVIEW_REQUIRED")).otherwise(F.lit("VALIDATED")),
    )


def route(
    df: DataFrame,
    threshold: float = REVIEW_THRESHOLD,
    store_review_score: float = STORE_REVIEW_SCORE,
) -> DataFrame:
    """Add ``route`` (STORED, REVIEW_REQUIRED, FAILED), ``reason_codes`` and ``needs_review``.

    Needs the columns of ``validate_and_score`` plus ``error_code``; a row with an error code
    failed in extraction.
    """
    none = F.array().cast("array<string>")
    reasons = (
        F.when(F.col("error_code").isNotNull(), none)
        .when(~F.col("schema_ok"), F.array(F.lit("schema_validation_failed")))
        .otherwise(review_reasons(F.col("is_valid"), F.col("model_confidence"), threshold))
    )
    chosen = (
        F.when(F.col("error_code").isNotNull(), F.lit("FAILED"))
        .when(F.size("reason_codes") > 0, F.lit("REVIEW_REQUIRED"))
        .otherwise(F.lit("STORED"))
    )
    staged = df.withColumn("reason_codes", reasons).withColumn("_route", chosen)
    flagged = F.when(F.col("_route") == "STORED", F.col("validation_score") < store_review_score)
    return compute_once(
        staged,
        {"route": F.col("_route"), "reason_codes": F.col("reason_codes"), "needs_review": flagged},
    ).drop("_route")


def dead_letter_rows(routed: DataFrame, recorded_at: Column, *keep: str) -> DataFrame:
    """One dead letter per document that was not stored, plus columns to keep."""
    failed = F.col("route") == "FAILED"
    schema_text = error_text(F.col("schema_errors"))
    return routed.where(F.col("route") != "STORED").select(
        recorded_at.cast("string").alias("recorded_at_utc"),
        "document_id",
        "drive_file_id",
        "file_hash",
        F.col("route").alias("status"),
        F.when(failed, F.col("error_code"))
        .otherwise(F.array_join("reason_codes", ","))
        .alias("error_code"),
        F.when(failed, F.col("error_message"))
        .when(~F.col("schema_ok"), schema_text)
        .otherwise(F.lit("Routed to review queue"))
        .alias("error_message"),
        F.when(~failed, F.col("provider")).alias("used_provider"),
        *keep,
    )


def record_struct(*extra: Column) -> Column:
    return F.struct(*RECORD_FIELDS, *extra)


def ledger_rows(routed: DataFrame, processed_at: Column, *keep: str) -> DataFrame:
    """Ledger rows of the stored documents, record and metadata as JSON text, plus columns to keep."""
    metadata = F.struct(
        "document_id",
        "drive_file_id",
        "file_hash",
        F.lit("STORED").alias("status"),
        processed_at.cast("string").alias("processed_at_utc"),
        "needs_review",
        F.col("provider").alias("used_provider"),
    )
    return routed.where(F.col("route") == "STORED").select(
        "drive_file_id",
        "file_hash",
        F.lit("STORED").alias("status"),
        F.to_json(record_struct(F.col("needs_review"))).alias("record_json"),
        F.to_json(metadata).alias("metadata_json"),
        processed_at.alias("processed_at_utc"),
        *keep,
    )


def review_rows(
    routed: DataFrame, created_at: Column, moved_to: Column | None = None
) -> DataFrame:
    """Review-queue items; schema failures carry the error text and the raw payload instead of
    the rule violations."""
    bad_schema = ~F.col("schema_ok")
    raw = F.col("payload") if "payload" in routed.columns else F.lit(None).cast("variant")
    metadata = F.struct(
        F.col("drive_file_id").alias("source_file_id"),
        "file_hash",
        F.col("provider").alias("used_provider"),
        record_struct().alias("normalized_record"),
        F.when(~bad_schema, F.col("violations")).alias("violations"),
        F.when(bad_schema, error_text(F.col("schema_errors"))).alias("error"),
        F.when(bad_schema, raw).alias("raw_extracted"),
    )
    return routed.where(F.col("route") == "REVIEW_REQUIRED").select(
        "document_id",
        F.lit("REVIEW_REQUIRED").alias("status"),
        "reason_codes",
        F.parse_json(F.to_json(metadata)).alias("metadata"),
        (F.lit(None).cast("string") if moved_to is None else moved_to).alias("source_file_moved_to"),
        created_at.cast("string").alias("created_at_utc"),
    )


def run_counters(outcomes: DataFrame) -> DataFrame:
    """Counters of one run from the column ``route``; duplicates have the route SKIPPED_DUPLICATE."""
    names = {
        "documents_processed_total": F.count(F.lit(1)),
        "documents_duplicate_skipped_total": F.count_if(F.col("route") == "SKIPPED_DUPLICATE"),
        "documents_review_total": F.count_if(F.col("route") == "REVIEW_REQUIRED"),
        "documents_success_total": F.count_if(F.col("route") == "STORED"),
        "documents_failed_total": F.count_if(F.col("route") == "FAILED"),
    }
    return outcomes.agg(*[value.alias(name) for name, value in names.items()])
