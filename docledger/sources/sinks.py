"""Writing ledgers, logs, queues and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.text import filled
from docledger.operators.skew import attach_per_key
from docledger.schemas import CLAIM_KEY
from docledger.sources.readers import base_name


def _first_per_key(rows: DataFrame, keys: list[str], stored: DataFrame) -> DataFrame:
    """``seq`` of the first row of each key that is not stored yet."""
    first = rows.groupBy(*keys).agg(F.min("seq").alias("seq"))
    return first.join(stored.select(*keys), keys, "left_anti").select("seq", F.lit(True).alias("_first"))


def append_if_absent(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Add ``append_status``: appended, skipped_duplicate, or missing_key.

    ``rows`` have a unique ``seq``; of several with one key the first is appended. Rows meet their
    key's winner by ``seq`` alone, so a key with very many rows does not pile up in one task and winners' keys are not moved again. Whether
    a row has a key is known before that, so that a caller who wants no keys moves none.
    """
    no_key = (F.coalesce("drive_file_id", F.lit("")) == "") | (F.coalesce("file_hash", F.lit("")) == "")
    first = _first_per_key(rows, CLAIM_KEY, ledger)
    return rows.withColumn("_no_key", no_key).join(first, "seq", "left").select(
        *[F.col(name) for name in rows.columns],
        F.when(F.col("_no_key"), F.lit("missing_key"))
        .when(F.col("_first"), F.lit("appended"))
        .otherwise(F.lit("skipped_duplicate"))
        .alias("append_status"),
    )


def append_by_hash(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Add ``dedupe_key`` and ``append_status``; rows without a key are always appended.

    ``rows`` have file_hash, idempotency_key and a unique ``seq``; ``seen`` holds ``dedupe_key``.
    """
    keyed = rows.withColumn("dedupe_key", F.coalesce(filled(F.col("file_hash")), F.col("idempotency_key")))
    first = _first_per_key(keyed.where(F.col("dedupe_key").isNotNull()), ["dedupe_key"], seen)
    joined = keyed.join(first, "seq", "left")
    appended = F.col("_first") | F.col("dedupe_key").isNull()
    return joined.select(
        *[F.col(name) for name in rows.columns],
        "dedupe_key",
        F.when(appended, F.lit("appended")).otherwise(F.lit("skipped_duplicate")).alias("append_status"),
    )


def write_ledger(rows: DataFrame, path: str) -> None:
    """Append ledger rows, one folder per month of processing.

    Rebalancing gathers a month's rows in few files and splits a month that is too large. Records are JSON text, which zstd
    packs much closer than the default codec.
    """
    dated = rows.withColumn("processing_month", F.date_format("processed_at_utc", "yyyy-MM"))
    balanced = dated.hint("rebalance", "processing_month")
    balanced.write.mode("append").partitionBy("processing_month").option("compression", "zstd").parquet(path)


FLAT_RECORD = [
    "document_type", "vendor_name", "invoice_number", "invoice_date", "currency", "subtotal",
    "tax_amount", "total_amount", "model_confidence", "validation_score",
]


def ledger_flat_row(df: DataFrame, now: str) -> DataFrame:
    """The fifteen columns of a spreadsheet ledger."""
    return df.select(
        "document_id",
        *CLAIM_KEY,
        *FLAT_RECORD,
        F.coalesce("status", F.lit("STORED")).alias("status"),
        F.coalesce(F.col("processed_at_utc").cast("string"), F.lit(now)).alias("processed_at_utc"),
    )


def stamp_events(events: DataFrame, now: Column) -> DataFrame:
    """Events with ``recorded_at_utc``; an event's own time is kept."""
    stamp = now.cast("string")
    if "recorded_at_utc" in events.columns:
        stamp = F.coalesce(F.col("recorded_at_utc"), stamp)
    return events.withColumn("recorded_at_utc", stamp)


def append_events(events: DataFrame, path: str, now: Column) -> None:
    """Append events to a log of JSON lines."""
    stamp_events(events, now).write.mode("append").json(path)


def snapshot_events(snapshot: DataFrame, stage: str) -> DataFrame:
    """A one-row snapshot as metric events, whole-number values only."""
    whole = [name for name, kind in snapshot.dtypes if kind in ("tinyint", "smallint", "int", "bigint")]
    return snapshot.select(*whole).unpivot([], whole, "metric", "value").withColumn("stage", F.lit(stage))


def upsert_review(new: DataFrame, queue: DataFrame) -> DataFrame:
    """The queue with new items added; a known document keeps only its resolution columns.

    ``new`` has each document_id once.
    """
    taken = ["status", "reason_codes", "metadata", "source_file_moved_to", "created_at_utc"]
    fresh = new.select("document_id", *[F.col(name).alias(f"_{name}") for name in taken], F.lit(True).alias("_new"))
    joined = queue.join(fresh, "document_id", "full_outer")
    return joined.select(*[
        F.when(F.col("_new"), F.col(f"_{name}")).otherwise(F.col(name)).alias(name) if name in taken else F.col(name)
        for name in queue.columns
    ])


def archive_manifest(files: DataFrame, prefix: str) -> DataFrame:
    """Where each stored file (``id``, unique) goes, and whether another file goes there too."""
    target = F.concat(F.lit(prefix.rstrip("/") + "/"), base_name(F.col("id")))
    planned = files.select(F.col("id").alias("source"), target.alias("destination"))
    counted = attach_per_key(planned, ["destination"], ["source"], [F.count(F.lit(1)).alias("sources")])
    return counted.withColumn("collision", F.col("sources") > 1)


def replay_audit(classified: DataFrame, recorded_at: Column) -> DataFrame:
    return classified.select(
        recorded_at.cast("string").alias("recorded_at_utc"), "document_id", "status", "outcome", "reason"
    )


def evaluation_report(results: DataFrame) -> DataFrame:
    """One JSON document per case; ``results`` carry their field results."""
    return results.select("id", F.to_json(F.struct(*results.columns)).alias("report"))


def write_report(results: DataFrame, summary: DataFrame, path: str) -> None:
    """The report as JSON lines, cases and summary in folders of their own."""
    evaluation_report(results).select("report").write.mode("overwrite").text(f"{path}/cases")
    summary.write.mode("overwrite").json(f"{path}/summary")
