"""Flat views over the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.schemas import LEDGER_METADATA_TEXT, LEDGER_RECORD_TEXT

AMOUNT = "decimal(38,6)"


def _parsed(ledger: DataFrame) -> DataFrame:
    return ledger.withColumns({
        "_record": F.from_json("record_json", LEDGER_RECORD_TEXT),
        "_metadata": F.from_json("metadata_json", LEDGER_METADATA_TEXT),
    })


def _text(*names: str) -> list[Column]:
    return [F.col(f"_record.{name}").alias(name) for name in names]


def _amount(*names: str) -> list[Column]:
    return [F.col(f"_record.{name}").cast(AMOUNT).alias(name) for name in names]


def records_flat(ledger: DataFrame) -> DataFrame:
    """One typed row per ledger record; text that is no number where one belongs is an error."""
    return _parsed(ledger).select(
        "id",
        "processed_at_utc",
        F.col("status").alias("row_status"),
        "drive_file_id",
        "file_hash",
        *_text("document_type", "vendor_name", "vendor_tax_id", "invoice_number", "invoice_date",
               "due_date", "currency"),
        *_amount("subtotal", "tax_amount", "total_amount"),
        *_text("payment_method"),
        *_amount("model_confidence", "validation_score"),
        F.coalesce(F.col("_record.needs_review").cast("boolean"), F.lit(False)).alias("needs_review"),
        F.col("_metadata.document_id").alias("document_id"),
        F.col("_metadata.used_provider").alias("used_provider"),
    )


def line_items_flat(ledger: DataFrame) -> DataFrame:
    """One row per line item, numbered from one; records without items give none."""
    exploded = _parsed(ledger).select(
        "id", "drive_file_id", "_record", "_metadata",
        F.posexplode("_record.line_items").alias("_place", "_item"),
    )
    return exploded.select(
        F.col("id").alias("ledger_id"),
        F.col("_metadata.document_id").alias("document_id"),
        "drive_file_id",
        *_text("vendor_name", "invoice_number", "invoice_date", "currency"),
        (F.col("_place") + 1).cast("bigint").alias("line_no"),
        F.col("_item.description").alias("description"),
        *[F.col(f"_item.{name}").cast(AMOUNT).alias(name) for name in ("quantity", "unit_price", "line_total")],
        F.col("_item.category").alias("category"),
    )


def mean(name: str) -> Column:
    """Average of an exact column, the same however the rows are divided."""
    return F.sum(name).cast("double") / F.count(name)


def daily_totals(flat: DataFrame) -> DataFrame:
    return flat.groupBy(F.to_date("processed_at_utc").alias("processing_date")).agg(
        F.count(F.lit(1)).alias("records_total"),
        F.count_if(F.col("row_status") == "STORED").alias("stored_total"),
        F.count_if("needs_review").alias("needs_review_total"),
        F.sum("total_amount").alias("total_amount_sum"),
        mean("model_confidence").alias("avg_model_confidence"),
        mean("validation_score").alias("avg_validation_score"),
    )


def daily_summary(flat: DataFrame) -> DataFrame:
    """Counts, sum and averages per day of processing, newest first."""
    return daily_totals(flat).orderBy(F.col("processing_date").desc())


def register_views(ledger: DataFrame) -> None:
    """Make the three views available to SQL."""
    flat = records_flat(ledger)
    flat.createOrReplaceTempView("ledger_records_flat")
    line_items_flat(ledger).createOrReplaceTempView("ledger_line_items_flat")
    daily_summary(flat).createOrReplaceTempView("ledger_daily_summary")
