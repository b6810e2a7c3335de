"""Types of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

LINE_ITEM = T.StructType([
    T.StructField("description", T.StringType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("line_total", T.DoubleType()),
    T.StructField("category", T.StringType()),
])

RECORD = T.StructType([
    T.StructField("document_type", T.StringType()),
    T.StructField("vendor_name", T.StringType()),
    T.StructField("vendor_tax_id", T.StringType()),
    T.StructField("invoice_number", T.StringType()),
    T.StructField("invoice_date", T.DateType()),
    T.StructField("due_date", T.DateType()),
    T.StructField("currency", T.StringType()),
    T.StructField("subtotal", T.DoubleType()),
    T.StructField("tax_amount", T.DoubleType()),
    T.StructField("total_amount", T.DoubleType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("line_items", T.ArrayType(LINE_ITEM)),
    T.StructField("model_confidence", T.DoubleType()),
    T.StructField("validation_score", T.DoubleType()),
])

RECORD_FIELDS = RECORD.fieldNames()

# Every field as text: the form in which a stored record is read back.
LEDGER_RECORD_TEXT = (
    "document_type string, vendor_name string, vendor_tax_id string, invoice_number string, "
    "invoice_date string, due_date string, currency string, subtotal string, tax_amount string, "
    "total_amount string, payment_method string, model_confidence string, validation_score string, "
    "needs_review string, line_items array<struct<description:string,quantity:string,"
    "unit_price:string,line_total:string,category:string>>"
)
LEDGER_METADATA_TEXT = "document_id string, used_provider string"

LEDGER = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("drive_file_id", T.StringType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("record_json", T.StringType()),
    T.StructField("metadata_json", T.StringType()),
    T.StructField("processed_at_utc", T.TimestampNTZType()),
])

DEAD_LETTER = T.StructType([
    T.StructField("recorded_at_utc", T.StringType()),
    T.StructField("document_id", T.StringType()),
    T.StructField("drive_file_id", T.StringType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error_code", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("used_provider", T.StringType()),
    T.StructField("seq", T.LongType()),
])

METRIC = T.StructType([
    T.StructField("recorded_at_utc", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.VariantType()),
    T.StructField("stage", T.StringType()),
])

REVIEW_ITEM = T.StructType([
    T.StructField("document_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("reason_codes", T.ArrayType(T.StringType())),
    T.StructField("created_at_utc", T.StringType()),
    T.StructField("resolved_at_utc", T.StringType()),
    T.StructField("source_file_moved_to", T.StringType()),
    T.StructField("metadata", T.VariantType()),
    T.StructField("resolved_record", T.VariantType()),
    T.StructField("storage_result", T.VariantType()),
    T.StructField("resolution_note", T.StringType()),
])

GOLDEN_FILE = T.StructType([
    T.StructField("cases", T.ArrayType(T.VariantType())),
])

CLAIM_KEY = ["drive_file_id", "file_hash"]
