"""The review queue: active items, history, decisions and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.checks import error_text
from docledger.functions.once import compute_once
from docledger.functions.payload import is_object
from docledger.functions.text import filled
from docledger.operators.route import record_struct
from docledger.operators.validate import read_record, validate_and_score
from docledger.schemas import CLAIM_KEY


def _of(column: str, *path: str) -> Column:
    steps = "".join(f"['{step}']" for step in path)
    return F.try_variant_get(column, f"${steps}", "string")


def _source_file() -> Column:
    return F.coalesce(filled(_of("metadata", "source_file_id")), filled(_of("metadata", "drive_file_id")))


def waiting_items(queue: DataFrame) -> DataFrame:
    """Items waiting for review, with ``file_hash``, which may be empty."""
    return queue.where(F.col("status") == "REVIEW_REQUIRED").withColumn(
        "file_hash", F.coalesce(_of("metadata", "file_hash"), F.lit(""))
    )


def active_items(queue: DataFrame, resolved: DataFrame) -> DataFrame:
    """Items waiting for review whose file is not stored meanwhile.

    ``resolved``: ``file_hash``. Items without a hash always stay.
    """
    normalized = F.try_variant_get("metadata", "$['normalized_record']", "variant")
    return waiting_items(queue).join(resolved.where(F.col("file_hash") != ""), "file_hash", "left_anti").select(
        "document_id",
        "status",
        "reason_codes",
        "created_at_utc",
        _source_file().alias("source_file_id"),
        "file_hash",
        F.coalesce(_of("metadata", "used_provider"), F.lit("unknown")).alias("used_provider"),
        *[
            _of("metadata", "normalized_record", name).alias(name)
            for name in ("vendor_name", "invoice_number", "invoice_date", "currency")
        ],
        F.try_variant_get("metadata", "$['normalized_record']['total_amount']", "double").alias("total_amount"),
        F.when(is_object(normalized), normalized).alias("normalized_record"),
    )


def active_size(queue: DataFrame, resolved: DataFrame) -> DataFrame:
    return active_items(queue, resolved).agg(F.count(F.lit(1)).alias("review_queue_total"))


def queue_size(queue: DataFrame) -> DataFrame:
    """All items in the queue, whatever their state."""
    return queue.agg(F.count(F.lit(1)).alias("queue_total"))


def history_items(queue: DataFrame) -> DataFrame:
    def resolved(name: str) -> Column:
        return filled(_of("resolved_record", name))

    return queue.where(F.coalesce("status", F.lit("")) != "REVIEW_REQUIRED").select(
        "document_id",
        "status",
        "created_at_utc",
        "resolved_at_utc",
        _source_file().alias("source_file_id"),
        F.coalesce(_of("metadata", "used_provider"), F.lit("unknown")).alias("used_provider"),
        F.coalesce(resolved("vendor_name"), filled(_of("metadata", "vendor_name")), F.lit("Unknown")).alias("vendor_name"),
        F.coalesce(resolved("invoice_number"), F.lit("-")).alias("invoice_number"),
        F.try_variant_get("resolved_record", "$['total_amount']", "double").alias("total_amount"),
        F.coalesce(resolved("currency"), F.lit("NA")).alias("currency"),
        "resolution_note",
    )


def decided_at() -> Column:
    return F.coalesce(filled(F.col("resolved_at_utc")), filled(F.col("created_at_utc")), F.lit(""))


def history(queue: DataFrame, limit: int = 20) -> DataFrame:
    """The items decided last, newest first."""
    return history_items(queue).orderBy(decided_at().desc(), F.col("document_id")).limit(limit)


def approve(
    decisions: DataFrame, queue: DataFrame, ledger_keys: DataFrame, now: str, corrected: DataFrame | None = None
) -> DataFrame:
    """Approvals: each becomes a stored record, a duplicate, or is refused with a reason.

    The record is the decision's own, else that of ``corrected`` (document_id, record: variant, one per
    document), else what the normaliser made.

    ``decisions``: document_id, record_override (variant or null), note, one per document. Business
    rule errors do not stop an approval; a record that breaks the schema does. Two items of one
    file store it once, for the lower document id.
    """
    override = F.col("record_override")
    normalized = F.try_variant_get("metadata", "$['normalized_record']", "variant")
    given = F.when(override.isNotNull() & ~F.is_variant_null(override), override).otherwise(
        F.coalesce(F.col("_corrected"), F.when(is_object(normalized), normalized))
    )
    if corrected is None:
        asked = decisions.withColumn("_corrected", F.lit(None).cast("variant"))
    else:
        known = corrected.select("document_id", F.col("record").alias("_corrected"))
        asked = decisions.join(known, "document_id", "left")
    provider = F.coalesce(_of("metadata", "used_provider"), F.lit("manual_review"))
    items = asked.select("document_id", "record_override", "_corrected", "note").join(
        queue.select("document_id", "status", "metadata").withColumn("found", F.lit(True)),
        "document_id",
        "left",
    ).withColumns({
        "record": given,
        "drive_file_id": _source_file(),
        "file_hash": filled(_of("metadata", "file_hash")),
        "used_provider": provider,
        "item_status": F.col("status"),
    }).drop("metadata", "status", "record_override", "_corrected")
    scored = validate_and_score(read_record(items))
    reason = (
        F.when(F.col("found").isNull(), F.lit("not_found"))
        .when(F.col("item_status") != "REVIEW_REQUIRED", F.lit("not_active"))
        .when(F.col("record").isNull(), F.lit("no_record"))
        .when(~F.col("schema_ok"), F.concat(F.lit("schema: "), error_text(F.col("schema_errors"))))
        .when(F.col("drive_file_id").isNull() | F.col("file_hash").isNull(), F.lit("missing_key"))
    )
    checked = compute_once(
        scored,
        {
            "refused": reason,
            "record_json": F.to_json(record_struct(F.lit(False).alias("needs_review"))),
        },
    ).select(
        "document_id", "note", *CLAIM_KEY, "used_provider", "validation_score", "refused", "record_json"
    )
    usable = F.col("refused").isNull()
    stored = ledger_keys.select(*CLAIM_KEY, F.lit(True).alias("_stored"))
    winners = (
        checked.where(usable)
        .groupBy(*CLAIM_KEY)
        .agg(F.min("document_id").alias("_winner"))
        .join(stored, CLAIM_KEY, "left_anti")
        .select(F.col("_winner").alias("document_id"), F.lit(True).alias("_appended"))
    )
    status = F.when(
        usable, F.when(F.col("_appended"), F.lit("RESOLVED_STORED")).otherwise(F.lit("RESOLVED_DUPLICATE"))
    )
    return checked.join(winners, "document_id", "left").select(
        "document_id",
        *CLAIM_KEY,
        "used_provider",
        "validation_score",
        F.when(usable, F.col("record_json")).alias("record_json"),
        "note",
        "refused",
        status.alias("resolution_status"),
        F.when(usable, F.when(F.col("_appended"), F.lit("appended")).otherwise(F.lit("skipped_duplicate"))).alias("storage_status"),
        F.lit(now).alias("resolved_at_utc"),
    )


def approved_ledger_rows(approved: DataFrame, processed_at: Column) -> DataFrame:
    """Ledger rows of the approvals that are stored."""
    metadata = F.struct(
        "document_id",
        *CLAIM_KEY,
        F.lit("STORED").alias("status"),
        processed_at.cast("string").alias("processed_at_utc"),
        F.lit(False).alias("needs_review"),
        "used_provider",
        F.lit("manual_review").alias("resolution_source"),
    )
    return approved.where(F.col("storage_status") == "appended").select(
        *CLAIM_KEY,
        F.lit("STORED").alias("status"),
        "record_json",
        F.to_json(metadata).alias("metadata_json"),
        processed_at.alias("processed_at_utc"),
    )


ACTIONS = {"approve": None, "reject": "REJECTED", "duplicate": "RESOLVED_DUPLICATE_MANUAL"}


def decided_action(column: str = "action") -> Column:
    """A decision's action in lower case; none means approve."""
    return F.coalesce(F.lower(F.trim(column)), F.lit("approve"))


def dismiss(decisions: DataFrame, queue: DataFrame, now: str) -> DataFrame:
    """Rejections and manual duplicates; other actions and unknown items are refused.

    A decision without an action is an approval, as everywhere (see ``decided_action``).

    ``decisions``: document_id, action, note. Unlike an approval this does not need an active item.
    """
    action = decided_action()
    status = F.when(action == "reject", "REJECTED").when(action == "duplicate", "RESOLVED_DUPLICATE_MANUAL")
    known = queue.select("document_id", F.lit(True).alias("found"))
    refused = (
        F.when(~action.isin(list(ACTIONS)), F.concat(F.lit("Unsupported review action: "), action))
        .when(F.col("found").isNull(), F.lit("not_found"))
    )
    resolution = F.when(F.col("refused").isNull(), F.col("_status"))
    return (
        decisions.where(action != "approve")
        .withColumn("_status", status)
        .join(known, "document_id", "left")
        .withColumn("refused", refused)
        .select(
            "document_id",
            resolution.alias("resolution_status"),
            F.when(resolution.isNotNull(), F.lit("dismissed")).alias("storage_status"),
            F.when(resolution.isNotNull(), F.lit(now)).alias("resolved_at_utc"),
            "note",
            "refused",
        )
    )


def merge_resolution(resolutions: DataFrame, queue: DataFrame, keep_note: bool = False) -> DataFrame:
    """The queue with resolutions applied.

    ``resolutions``: document_id, resolution_status, resolved_at_utc, record_json, storage_status,
    note, one per document. With ``keep_note`` an empty new note leaves the old one in place.
    """
    new = resolutions.select(
        "document_id",
        F.col("resolution_status").alias("_status"),
        F.col("resolved_at_utc").alias("_at"),
        F.try_parse_json("record_json").alias("_record"),
        F.to_variant_object(F.struct(F.col("storage_status").alias("status"))).alias("_result"),
        F.col("note").alias("_note"),
        F.lit(True).alias("_hit"),
    )
    hit = F.coalesce("_hit", F.lit(False))

    def changed(new_value: str, old: str) -> Column:
        return F.when(hit, F.col(new_value)).otherwise(F.col(old))

    note = changed("_note", "resolution_note")
    if keep_note:
        note = F.when(hit & filled(F.col("_note")).isNotNull(), F.col("_note")).otherwise(F.col("resolution_note"))
    merged = queue.join(new, "document_id", "left")
    replaced = {
        "status": changed("_status", "status"),
        "resolved_at_utc": changed("_at", "resolved_at_utc"),
        "resolved_record": changed("_record", "resolved_record"),
        "storage_result": changed("_result", "storage_result"),
        "resolution_note": note,
    }
    return merged.select(*[
        (replaced[name].alias(name) if name in replaced else F.col(name)) for name in queue.columns
    ])


def unmatched_resolutions(resolutions: DataFrame, queue: DataFrame) -> DataFrame:
    """Resolutions of documents that are not in the queue."""
    return resolutions.join(queue.select("document_id"), "document_id", "left_anti")


def active_report(queue: DataFrame) -> DataFrame:
    """Waiting items for a listing, blanks shown as a dash."""
    reasons = filled(F.array_join("reason_codes", ","))
    return queue.where(F.col("status") == "REVIEW_REQUIRED").select(
        "document_id",
        F.coalesce(_source_file(), F.lit("-")).alias("source"),
        F.coalesce(reasons, F.lit("-")).alias("reasons"),
        "created_at_utc",
    )


def lookup(ids: DataFrame, queue: DataFrame) -> DataFrame:
    """The queue item of each id, with ``found`` false where there is none."""
    return ids.join(queue.withColumn("found", F.lit(True)), "document_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )

