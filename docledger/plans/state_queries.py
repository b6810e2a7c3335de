"""Queries over sources, sinks, claims, replay and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.operators import claims, evaluate, review
from docledger.operators.reports import resolved_hashes
from docledger.operators.route import run_counters
from docledger.plans import fixtures as fx
from docledger.plans.evaluation_queries import gated_cases
from docledger.plans.fixtures import every, numbered, order_key
from docledger.plans.registry import query
from docledger.schemas import CLAIM_KEY
from docledger.session import work_folder
from docledger.sources import keyed, readers, sinks

NOW = "2026-01-01T00:00:00+00:00"


def keyed_table(spark: SparkSession, rows: DataFrame, key: list[str], buckets: int = 16) -> keyed.KeyedTable:
    """The rows as a table that is stored by key."""
    stored = keyed.KeyedTable(spark, work_folder(spark, "keyed"), rows.schema, key, buckets)
    stored.append(rows)
    return stored


def variant_text(column: str, path: str) -> Column:
    return F.try_variant_get(column, f"$.{path}", "string")


# ---- sources ------------------------------------------------------------------------------------

INBOX_SQL = """
    SELECT k, CASE WHEN k % 60 = 0 THEN 'inbox/.pdf' WHEN k % 48 = 0 THEN 'inbox/' || k || '.pdf.gz' WHEN k % 49 = 0 THEN ''
             ELSE 'inbox/sub' || (k % 7) || '/' || (k % 1000) ||
               CASE k % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.png' WHEN 4 THEN '.txt' ELSE '/' END END AS id,
           CASE WHEN k % 60 = 0 THEN NULL WHEN k % 48 = 0 THEN 'application/pdf' WHEN k % 49 = 0 THEN NULL
                WHEN k % 6 = 0 THEN 'application/pdf' WHEN k % 6 IN (1, 2) THEN 'image/jpeg' WHEN k % 6 = 3 THEN 'image/png' END AS mime_type
    FROM fx_orders"""


@query("src_inbox", f"""
    SELECT id, regexp_extract(id, '[^/]*$') AS name, mime_type, k * 3 AS size FROM ({INBOX_SQL}) WHERE mime_type IS NOT NULL""", ("fx_orders",))
def src_inbox(spark, folder):
    return readers.accept_files(fx.inbox(spark, folder)).drop("last_modified")


@query("src_inbox_scan", f"""
    SELECT DISTINCT id, regexp_extract(id, '[^/]*$') AS name, mime_type, 3 * length(id) AS size FROM ({INBOX_SQL}) WHERE mime_type IS NOT NULL""", ("fx_orders",))
def src_inbox_scan(spark, folder):
    return readers.scan_inbox(spark, fx.inbox_tree(spark, folder), prefix="inbox/").drop("last_modified")


@query("src_event_log", "SELECT * FROM fx_dead WHERE status = 'FAILED'", ("fx_dead",))
def src_event_log(spark, folder):
    path = work_folder(spark, "dead-letters")
    fx.dead_letters(spark, folder).write.json(path)
    return readers.read_event_log(spark, path, status="FAILED")


@query("src_review_queue", """
    SELECT document_id, status, reasons, created_at_utc, file_hash, n_vendor AS vendor_name FROM fx_queue WHERE k % 97 <> 0""", ("fx_queue",))
def src_review_queue(spark, folder):
    path = work_folder(spark, "review-queue")
    queue = fx.review_queue(spark, folder)
    line = F.to_json(F.struct(*queue.columns))
    cut = F.regexp_extract("document_id", r"(\d+)", 1).cast("bigint") % 97 == 0
    queue.select(F.when(cut, F.substring(line, 1, 40)).otherwise(line)).write.text(path)
    read = readers.read_review_queue(spark, path, one_per_file=False)
    return read.select(
        "document_id", "status", F.array_join("reason_codes", ",").alias("reasons"), "created_at_utc",
        variant_text("metadata", "file_hash").alias("file_hash"),
        variant_text("metadata", "normalized_record.vendor_name").alias("vendor_name"),
    )


@query("src_golden", """
    SELECT 'case-' || k AS id, CASE WHEN k % 50 = 0 THEN 'missing/' || k ELSE drive_file_id END AS file_path,
           CASE WHEN k % 51 = 0 OR k % 52 = 0 OR k % 55 = 0 THEN NULL ELSE '  ' || upper(vendor_name) END AS vendor_name
    FROM fx_truth""", ("fx_truth",))
def src_golden(spark, folder):
    path = work_folder(spark, "golden")
    case = F.concat(
        F.lit('{"id":"'), "id", F.lit('","file_path":"'), "file_path", F.lit('","expected":'), "expected_text", F.lit("}")
    )
    golden = fx.golden(spark, folder)
    # One file object per hundred order keys, so no object grows with the data.
    shards = golden.groupBy(F.floor(order_key() / 100).alias("_shard")).agg(
        F.array_join(F.collect_list(case), ",").alias("_cases")
    )
    shards.select(F.concat(F.lit('{"cases":['), "_cases", F.lit("]}"))).write.text(path)
    read = readers.read_golden(spark, path, one_per_file=False)
    return read.select("id", "file_path", variant_text("expected", "vendor_name").alias("vendor_name"))


@query("src_ledger", """
    SELECT id, drive_file_id, file_hash, row_status AS status, strftime(processed_at_utc, '%Y-%m') AS processing_month FROM fx_ledger""", ("fx_ledger",))
def src_ledger(spark, folder):
    path = work_folder(spark, "ledger")
    sinks.write_ledger(fx.ledger(spark, folder), path)
    return readers.read_ledger(spark, path).select(
        "id", "drive_file_id", "file_hash", "status", "processing_month"
    )


# ---- sinks --------------------------------------------------------------------------------------

APPEND_SQL = """
    SELECT a.arrival AS seq, a.drive_file_id, a.file_hash,
           CASE WHEN a.k % 77 = 0 THEN 'missing_key' WHEN a.p = 1 OR l.id IS NOT NULL THEN 'skipped_duplicate' ELSE 'appended' END AS append_status
    FROM (SELECT * REPLACE (CASE WHEN k % 77 = 0 THEN NULL ELSE drive_file_id END AS drive_file_id) FROM fx_attempts) a
    LEFT JOIN fx_ledger l ON l.drive_file_id = a.drive_file_id AND l.file_hash = a.file_hash"""


@query("snk_append_if_absent", APPEND_SQL, ("fx_attempts", "fx_ledger"))
def snk_append_if_absent(spark, folder):
    key = F.floor(F.col("arrival") / 2)
    rows = fx.claim_attempts(spark, folder).select(
        F.col("arrival").alias("seq"),
        F.when(key % 77 != 0, F.col("drive_file_id")).alias("drive_file_id"),
        "file_hash",
    )
    return sinks.append_if_absent(rows, fx.ledger(spark, folder))


@query("snk_append_keyed", APPEND_SQL, ("fx_attempts", "fx_ledger"))
def snk_append_keyed(spark, folder):
    """The same against a stored ledger: first attempts as one batch, second ones as the next, which finds what the first has added."""
    stored = keyed_table(spark, fx.ledger(spark, folder).select("drive_file_id", "file_hash", "id"), CLAIM_KEY)
    key, found = F.floor(F.col("arrival") / 2), []
    rows = fx.claim_attempts(spark, folder).select(
        F.col("arrival").alias("seq"), F.when(key % 77 != 0, F.col("drive_file_id")).alias("drive_file_id"), "file_hash"
    )
    for place in range(2):
        made = lambda new: new.select(*CLAIM_KEY, F.col("seq").alias("id"))
        found.append(keyed.store_if_absent(rows.where(F.col("seq") % 2 == place), stored, made))
    return found[0].unionByName(found[1])


@query("snk_append_by_hash", """
    SELECT seq, dedupe_key,
           CASE WHEN dedupe_key IS NULL THEN 'appended'
                WHEN dedupe_key IN (SELECT file_hash FROM fx_resolved) THEN 'skipped_duplicate'
                WHEN row_number() OVER (PARTITION BY dedupe_key ORDER BY seq) > 1 THEN 'skipped_duplicate'
                ELSE 'appended' END AS append_status
    FROM (SELECT seq, coalesce(file_hash, CASE WHEN seq % 50 <> 0 THEN 'key-' || (seq % 75) END) AS dedupe_key FROM fx_dead)""", ("fx_dead", "fx_resolved"))
def snk_append_by_hash(spark, folder):
    seen = resolved_hashes(fx.ledger(spark, folder)).withColumnRenamed("file_hash", "dedupe_key")
    seq = F.col("seq")
    rows = fx.dead_letters(spark, folder).select(
        "seq", "file_hash", F.when(seq % 50 != 0, numbered("key-", seq % 75)).alias("idempotency_key")
    )
    return sinks.append_by_hash(rows, seen).select("seq", "dedupe_key", "append_status")


@query("snk_flat_row", """
    SELECT document_id, drive_file_id, file_hash, document_type, vendor_name, invoice_number,
           strftime(invoice_date, '%Y-%m-%d') AS invoice_date, currency, subtotal, tax_amount, total_amount, model_confidence,
           model_confidence AS validation_score, CASE WHEN k % 2 = 0 THEN 'REVIEWED' ELSE 'STORED' END AS status,
           CASE WHEN k % 3 = 0 THEN '2026-01-01T00:00:00+00:00' ELSE strftime(ordered_at, '%Y-%m-%d %H:%M:%S') END AS processed_at_utc
    FROM fx_records""", ("fx_records",))
def snk_flat_row(spark, folder):
    rows = fx.records(spark, folder).withColumns({
        "status": F.when(every(2), "REVIEWED"),
        "processed_at_utc": F.when(~every(3), F.col("ordered_at")),
    })
    flat = sinks.ledger_flat_row(rows, NOW)
    return flat.withColumn("invoice_date", F.date_format("invoice_date", "yyyy-MM-dd"))


@query("snk_event_log", """
    SELECT metric, cast(value AS BIGINT) AS value, 'poll_once' AS stage, '2026-01-01 00:00:00' AS recorded_at_utc
    FROM (SELECT count(*) AS documents_processed_total, 0::BIGINT AS documents_duplicate_skipped_total,
                 count(*) FILTER (route = 'REVIEW_REQUIRED') AS documents_review_total,
                 count(*) FILTER (route = 'STORED') AS documents_success_total, 0::BIGINT AS documents_failed_total FROM fx_routed)
    UNPIVOT (value FOR metric IN (documents_processed_total, documents_duplicate_skipped_total, documents_review_total,
                                  documents_success_total, documents_failed_total))""", ("fx_routed",))
def snk_event_log(spark, folder):
    path = work_folder(spark, "metrics")
    counters = run_counters(fx.routed(spark, folder))
    now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    sinks.append_events(sinks.snapshot_events(counters, "poll_once"), path, now)
    layout = "metric string, value bigint, stage string, recorded_at_utc string, status string"
    return readers.read_event_log(spark, path, layout).drop("status")


UPSERT_SQL = """
    SELECT coalesce(q.document_id, n.document_id) AS document_id,
           CASE WHEN n.document_id IS NOT NULL THEN 'REVIEW_REQUIRED' ELSE q.status END AS status,
           CASE WHEN n.document_id IS NOT NULL THEN 'low_confidence' ELSE q.reasons END AS reasons,
           CASE WHEN n.document_id IS NOT NULL THEN '2026-01-01T00:00:00+00:00' ELSE q.created_at_utc END AS created_at_utc,
           q.resolved_at_utc, q.resolution_note
    FROM fx_queue q FULL OUTER JOIN (SELECT * FROM fx_orders WHERE k % 5 = 0) n ON n.document_id = q.document_id"""


@query("snk_review_upsert", UPSERT_SQL, ("fx_queue",))
def snk_review_upsert(spark, folder):
    return review_columns(sinks.upsert_review(new_reviews(spark, folder), fx.review_queue(spark, folder)))


def new_reviews(spark, folder):
    return fx.order_keys(spark, folder).where(every(5)).select(
        "document_id",
        F.lit("REVIEW_REQUIRED").alias("status"),
        F.array(F.lit("low_confidence")).alias("reason_codes"),
        F.to_variant_object(F.struct("file_hash")).alias("metadata"),
        F.lit(None).cast("string").alias("source_file_moved_to"),
        F.lit(NOW).alias("created_at_utc"),
    )


def review_columns(queue: DataFrame) -> DataFrame:
    return queue.select(
        "document_id", "status", F.array_join("reason_codes", ",").alias("reasons"), "created_at_utc",
        "resolved_at_utc", "resolution_note",
    )


@query("snk_upsert_keyed", UPSERT_SQL, ("fx_queue",))
def snk_upsert_keyed(spark, folder):
    queue = keyed_table(spark, fx.review_queue(spark, folder), ["document_id"])
    keyed.upsert_review_in_place(new_reviews(spark, folder), queue)
    return review_columns(queue.rows())


@query("snk_archive_manifest", f"""
    SELECT id AS source, 'archive/' || regexp_extract(id, '[^/]*$') AS destination,
           count(*) OVER (PARTITION BY regexp_extract(id, '[^/]*$')) AS sources,
           count(*) OVER (PARTITION BY regexp_extract(id, '[^/]*$')) > 1 AS collision
    FROM ({INBOX_SQL}) WHERE mime_type IS NOT NULL""", ("fx_orders",))
def snk_archive_manifest(spark, folder):
    return sinks.archive_manifest(readers.accept_files(fx.inbox(spark, folder)), "archive/")


@query("snk_replay_audit", """
    SELECT '2026-01-01 00:00:00' AS recorded_at_utc, document_id, status, outcome,
           CASE outcome WHEN 'skipped_invalid' THEN 'missing drive_file_id/file_hash/document_id'
             WHEN 'skipped_processed' THEN 'already_processed' ELSE 'claim_acquired' END AS reason
    FROM fx_replay""", ("fx_replay",))
def snk_replay_audit(spark, folder):
    path = work_folder(spark, "replay-audit")
    now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    audit = sinks.replay_audit(replayed(spark, folder), now)
    sinks.append_events(audit, path, now)
    layout = "recorded_at_utc string, document_id string, status string, outcome string, reason string"
    return readers.read_event_log(spark, path, layout)


@query("snk_evaluation_report", """
    SELECT id, status, coalesce(total, 0) AS field_rows, CASE WHEN status = 'ok' THEN round_even(matched / total, 4) END AS score FROM fx_eval""", ("fx_eval",))
def snk_evaluation_report(spark, folder):
    results = evaluate.case_results(gated_cases(spark, folder), with_fields=True)
    report = sinks.evaluation_report(results)
    layout = "status string, score double, field_results array<struct<field:string,matched:boolean>>"
    read = F.from_json("report", layout)
    return report.select("id", read.alias("r")).select(
        "id", "r.status", F.size("r.field_results").cast("bigint").alias("field_rows"), "r.score"
    )


# ---- claims and replay --------------------------------------------------------------------------

@query("clm_claim", "SELECT * FROM fx_claim_results", ("fx_claim_results",))
def clm_claim(spark, folder):
    return claims.claim(fx.claim_attempts(spark, folder), fx.claims(spark, folder))


@query("clm_claim_keyed", "SELECT * FROM fx_claim_results", ("fx_claim_results",))
def clm_claim_keyed(spark, folder):
    """Claims taken in place: first attempts as one batch, second ones as the next."""
    held, found = keyed_table(spark, fx.claims(spark, folder), CLAIM_KEY), []
    for place in range(2):
        found.append(keyed.claim_in_place(fx.claim_attempts(spark, folder).where(F.col("arrival") % 2 == place), held, NOW))
    return found[0].unionByName(found[1])


@query("clm_claims_after", """
    SELECT o.drive_file_id, o.file_hash, 'CLAIMED' AS status, 'poll-' || (o.k % 4) AS owner_id,
           CASE WHEN c.status IS NULL THEN '2026-01-01T00:00:00+00:00' ELSE strftime(o.ordered_at, '%Y-%m-%d %H:%M:%S') END AS claimed_at_utc,
           '2026-01-01T00:00:00+00:00' AS updated_at_utc
    FROM fx_orders o LEFT JOIN fx_claims c USING (drive_file_id, file_hash)
    WHERE c.status IS NULL OR c.status IN ('FAILED', 'REVIEW_REQUIRED')""", ("fx_orders", "fx_claims"))
def clm_claims_after(spark, folder):
    return claims.claims_after(fx.claim_attempts(spark, folder), fx.claims(spark, folder), NOW)


MERGE_SQL = """
    SELECT c.drive_file_id, c.file_hash, coalesce(u.status, c.status) AS status, c.owner_id,
           u.seq IS NOT NULL AS updated
    FROM fx_claims c LEFT JOIN (
      SELECT drive_file_id, file_hash, max(seq) AS seq, arg_max(CASE WHEN seq % 2 = 0 THEN 'STORED' ELSE 'FAILED' END, seq) AS status
      FROM fx_dead WHERE drive_file_id IS NOT NULL GROUP BY ALL) u USING (drive_file_id, file_hash)"""


@query("clm_merge_status", MERGE_SQL, ("fx_claims", "fx_dead"))
def clm_merge_status(spark, folder):
    return merged_columns(claims.merge_status(status_updates(spark, folder), fx.claims(spark, folder)))


@query("clm_merge_keyed", MERGE_SQL, ("fx_claims", "fx_dead"))
def clm_merge_keyed(spark, folder):
    held = keyed_table(spark, fx.claims(spark, folder), CLAIM_KEY)
    keyed.mark_in_place(status_updates(spark, folder), held)
    return merged_columns(held.rows())


def status_updates(spark, folder):
    return fx.dead_letters(spark, folder).where(F.col("drive_file_id").isNotNull()).select(
        "drive_file_id", "file_hash", "seq",
        F.when(F.col("seq") % 2 == 0, "STORED").otherwise("FAILED").alias("status"),
        F.lit(NOW).alias("updated_at_utc"),
    )


def merged_columns(merged: DataFrame) -> DataFrame:
    return merged.select(
        "drive_file_id", "file_hash", "status", "owner_id", (F.col("updated_at_utc") == NOW).alias("updated")
    )


TRANSITION_SQL = """
    SELECT document_id, seq, f AS from_status, t AS to_status,
           CASE WHEN upper(trim(f)) = 'MISSING' THEN 'Unknown state: ' || f
                WHEN upper(trim(t)) = 'MISSING' THEN 'Unknown state: ' || t
                WHEN (upper(trim(f)) || '>' || upper(trim(t))) IN ('NEW>CLAIMED', 'NEW>FAILED', 'CLAIMED>EXTRACTED', 'CLAIMED>FAILED',
                  'EXTRACTED>VALIDATED', 'EXTRACTED>REVIEW_REQUIRED', 'EXTRACTED>FAILED', 'VALIDATED>STORED', 'VALIDATED>REVIEW_REQUIRED',
                  'VALIDATED>FAILED', 'REVIEW_REQUIRED>CLAIMED', 'REVIEW_REQUIRED>FAILED', 'STORED>ARCHIVED', 'STORED>FAILED') THEN 'ok'
                ELSE 'Invalid transition: ' || upper(trim(f)) || ' -> ' || upper(trim(t)) END AS result
    FROM (SELECT document_id, seq, t, lag(t) OVER (PARTITION BY document_id ORDER BY ts, seq) AS f
          FROM (SELECT 'doc-' || user_id AS document_id, event_id AS seq, ts,
                       CASE WHEN event_id % 7 = 0 THEN ' ' || lower(s) ELSE s END AS t
                FROM (SELECT *, ['NEW', 'CLAIMED', 'EXTRACTED', 'VALIDATED', 'REVIEW_REQUIRED', 'STORED', 'ARCHIVED', 'FAILED', 'MISSING'][(event_id * 7 + user_id) % 9 + 1] AS s FROM events)))
    WHERE f IS NOT NULL"""


@query("clm_transitions", TRANSITION_SQL)
def clm_transitions(spark, folder):
    return claims.check_transitions(fx.status_log(spark, folder))


def replayed(spark, folder) -> DataFrame:
    return claims.classify_replay(fx.dead_letters(spark, folder), fx.claims(spark, folder), "FAILED")


@query("rpl_classify", "SELECT seq, document_id, outcome FROM fx_replay", ("fx_replay",))
def rpl_classify(spark, folder):
    return replayed(spark, folder).select("seq", "document_id", "outcome")


@query("rpl_summary", """
    SELECT count(*) FILTER (outcome = 'queued_for_replay') AS queued, count(*) FILTER (outcome = 'skipped_processed') AS skipped_processed,
           count(*) FILTER (outcome = 'skipped_invalid') AS skipped_invalid FROM fx_replay""", ("fx_replay",))
def rpl_summary(spark, folder):
    return claims.replay_summary(replayed(spark, folder))


@query("rpl_reclaimed", """
    SELECT DISTINCT drive_file_id, file_hash, 'CLAIMED' AS status, 'replay-worker' AS owner_id, '2026-01-01T00:00:00+00:00' AS updated_at_utc
    FROM fx_replay WHERE outcome = 'queued_for_replay' AND (held IS NULL OR held IN ('FAILED', 'REVIEW_REQUIRED'))""", ("fx_replay",))
def rpl_reclaimed(spark, folder):
    taken = claims.reclaimed(replayed(spark, folder), fx.claims(spark, folder), NOW)
    return taken.drop("claimed_at_utc")


# ---- review queue -------------------------------------------------------------------------------

ACTIVE_COLUMNS = [
    "document_id", "status", "created_at_utc", "source_file_id", "file_hash", "used_provider", "vendor_name",
    "invoice_number", "invoice_date", "currency", "total_amount",
]
ACTIVE_SQL = """document_id, status, reasons, created_at_utc, source_file_id, file_hash, used_provider, n_vendor AS vendor_name,
           n_number AS invoice_number, n_date AS invoice_date, n_currency AS currency, n_total AS total_amount"""


def queue_and_resolved(spark, folder) -> tuple[DataFrame, DataFrame]:
    """The review queue, and which of its files are stored meanwhile."""
    queue = fx.review_queue(spark, folder)
    return queue, resolved_hashes(fx.ledger(spark, folder), review.waiting_items(queue))


@query("rev_active", f"SELECT {ACTIVE_SQL} FROM fx_active", ("fx_active",))
def rev_active(spark, folder):
    active = review.active_items(*queue_and_resolved(spark, folder))
    return active.select(*ACTIVE_COLUMNS, F.array_join("reason_codes", ",").alias("reasons"))


@query("rev_active_size", """
    SELECT (SELECT count(*) FROM fx_active) AS review_queue_total, (SELECT count(*) FROM fx_queue) AS queue_total""", ("fx_active",))
def rev_active_size(spark, folder):
    queue, resolved = queue_and_resolved(spark, folder)
    total = review.queue_size(queue).select(F.col("queue_total")).scalar()
    return review.active_size(queue, resolved).withColumn("queue_total", total)


@query("rev_history", """
    SELECT * EXCLUDE (decided_at) FROM fx_history ORDER BY decided_at DESC, document_id LIMIT 20""", ("fx_history",))
def rev_history(spark, folder):
    return review.history(fx.review_queue(spark, folder))


def approvals(spark, folder) -> DataFrame:
    asked = fx.decisions(spark, folder).where(review.decided_action() == "approve")
    keys = fx.ledger(spark, folder).select("drive_file_id", "file_hash")
    return review.approve(asked, fx.review_queue(spark, folder), keys, NOW)


@query("rev_approve", """
    SELECT document_id, refused, resolution_status, CASE WHEN refused IS NULL THEN score END AS validation_score,
           CASE WHEN refused IS NULL THEN used_provider_2 END AS used_provider
    FROM (SELECT *, CASE WHEN k % 24 <> 0 THEN 'mistral' ELSE 'manual_review' END AS used_provider_2 FROM fx_approved)""", ("fx_approved",))
def rev_approve(spark, folder):
    usable = F.col("refused").isNull()
    return approvals(spark, folder).select(
        "document_id", "refused", "resolution_status",
        F.when(usable, F.col("validation_score")).alias("validation_score"),
        F.when(usable, F.col("used_provider")).alias("used_provider"),
    )


@query("rev_approved_rows", """
    SELECT 'inbox/' || k || '.pdf' AS drive_file_id, file_hash, 'STORED' AS status, CASE WHEN has_override THEN 'Fixed ' || k ELSE NULL END AS fixed_vendor
    FROM fx_approved WHERE resolution_status = 'RESOLVED_STORED'""", ("fx_approved",))
def rev_approved_rows(spark, folder):
    rows = review.approved_ledger_rows(approvals(spark, folder), F.lit(NOW).cast("timestamp"))
    vendor = F.get_json_object("record_json", "$.vendor_name")
    return rows.select(
        "drive_file_id", "file_hash", "status", F.when(vendor.startswith("Fixed"), vendor).alias("fixed_vendor")
    )


@query("rev_dismiss", """
    SELECT d.document_id, CASE WHEN refused IS NULL THEN CASE action WHEN 'reject' THEN 'REJECTED' ELSE 'RESOLVED_DUPLICATE_MANUAL' END END AS resolution_status,
           refused, note
    FROM (SELECT d.*, CASE WHEN action = 'postpone' THEN 'Unsupported review action: postpone' WHEN q.document_id IS NULL THEN 'not_found' END AS refused
          FROM fx_decisions d LEFT JOIN fx_queue q USING (document_id) WHERE action <> ' Approve') d""", ("fx_decisions", "fx_queue"))
def rev_dismiss(spark, folder):
    dismissed = review.dismiss(fx.decisions(spark, folder), fx.review_queue(spark, folder), NOW)
    return dismissed.select("document_id", "resolution_status", "refused", "note")


def resolutions(spark, folder) -> DataFrame:
    dismissed = review.dismiss(fx.decisions(spark, folder), fx.review_queue(spark, folder), NOW)
    columns = ["document_id", "resolution_status", "resolved_at_utc", "storage_status", "note"]
    taken = dismissed.where((F.col("refused") == "not_found") | F.col("resolution_status").isNotNull())
    return taken.select(*columns).withColumn("record_json", F.lit(None).cast("string"))


@query("rev_merge", """
    SELECT q.document_id, CASE WHEN hit THEN CASE action WHEN 'reject' THEN 'REJECTED' ELSE 'RESOLVED_DUPLICATE_MANUAL' END ELSE status END AS status,
           CASE WHEN hit THEN '2026-01-01T00:00:00+00:00' ELSE resolved_at_utc END AS resolved_at_utc,
           CASE WHEN hit THEN note ELSE resolution_note END AS resolution_note,
           CASE WHEN hit THEN coalesce(note, resolution_note) ELSE resolution_note END AS kept_note,
           CASE WHEN hit THEN 'dismissed' END AS storage_status
    FROM fx_queue q LEFT JOIN (SELECT document_id, action, note, true AS hit FROM fx_decisions WHERE action IN ('reject', 'duplicate')) d
      ON d.document_id = q.document_id""", ("fx_queue", "fx_decisions"))
def rev_merge(spark, folder):
    queue = fx.review_queue(spark, folder)
    given = resolutions(spark, folder)
    merged = review.merge_resolution(given, queue)
    kept = review.merge_resolution(given, queue, keep_note=True).select(
        "document_id", F.col("resolution_note").alias("kept_note")
    )
    return merged.join(kept, "document_id").select(
        "document_id", "status", "resolved_at_utc", "resolution_note", "kept_note",
        variant_text("storage_result", "status").alias("storage_status"),
    )


@query("rev_merge_unmatched", """
    SELECT document_id FROM fx_decisions WHERE action IN ('reject', 'duplicate') AND document_id NOT IN (SELECT document_id FROM fx_queue)""", ("fx_decisions", "fx_queue"))
def rev_merge_unmatched(spark, folder):
    return review.unmatched_resolutions(
        resolutions(spark, folder), fx.review_queue(spark, folder)
    ).select("document_id")


@query("rev_report", """
    SELECT document_id, coalesce(source_file_id, '-') AS source, coalesce(nullif(reasons, ''), '-') AS reasons, created_at_utc
    FROM fx_queue WHERE status = 'REVIEW_REQUIRED'""", ("fx_queue",))
def rev_report(spark, folder):
    return review.active_report(fx.review_queue(spark, folder))


@query("rev_lookup", """
    SELECT o.document_id, q.document_id IS NOT NULL AS found, q.status FROM fx_orders o LEFT JOIN fx_queue q USING (document_id)""", ("fx_orders", "fx_queue"))
def rev_lookup(spark, folder):
    ids = fx.order_keys(spark, folder).select("document_id")
    return review.lookup(ids, fx.review_queue(spark, folder)).select("document_id", "found", "status")
