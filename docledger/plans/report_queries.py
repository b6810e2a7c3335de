"""Queries over views, reports and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.operators import reports, review, search, views
from docledger.plans import fixtures as fx
from docledger.plans.registry import query
from docledger.plans.state_queries import ACTIVE_COLUMNS, ACTIVE_SQL, queue_and_resolved
from docledger.schemas import METRIC
from docledger.session import work_folder
from docledger.streaming import claim_state, jobs, totals


def flat(spark, folder) -> DataFrame:
    return views.records_flat(fx.ledger(spark, folder))


def as_doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("double") for name in names})


def money_sum(name: str) -> str:
    return f"cast(sum(cast({name} AS DECIMAL(18,2))) AS DOUBLE)"


# ---- views --------------------------------------------------------------------------------------

@query("viw_records", """
    SELECT id, strftime(processed_at_utc, '%Y-%m-%d %H:%M:%S') AS processed_at_utc, row_status, drive_file_id, file_hash,
           document_type, vendor_name, vendor_tax_id, invoice_number, invoice_date, cast(NULL AS VARCHAR) AS due_date, currency,
           subtotal, tax_amount, total_amount, payment_method, model_confidence, validation_score, needs_review, document_id, used_provider
    FROM fx_ledger""", ("fx_ledger",))
def viw_records(spark, folder):
    shown = flat(spark, folder).withColumn("processed_at_utc", F.col("processed_at_utc").cast("string"))
    return as_doubles(shown, "subtotal", "tax_amount", "total_amount", "model_confidence", "validation_score")


@query("viw_line_items", """
    SELECT f.id AS ledger_id, f.document_id, f.drive_file_id, f.vendor_name, f.invoice_number, f.invoice_date, f.currency,
           l.line_no, l.description, l.quantity, CASE WHEN f.k % 23 = 0 THEN 0.0 ELSE l.unit_price END AS unit_price,
           CASE WHEN f.k % 23 = 0 THEN 0.0 ELSE l.line_total END AS line_total, l.category
    FROM fx_ledger f JOIN fx_lines l ON l.k = f.k""", ("fx_ledger", "fx_lines"))
def viw_line_items(spark, folder):
    return as_doubles(views.line_items_flat(fx.ledger(spark, folder)), "quantity", "unit_price", "line_total")


DAILY_SQL = f"""strftime(processed_at_utc, '%Y-%m-%d') AS processing_date, count(*) AS records_total,
           count(*) FILTER (row_status = 'STORED') AS stored_total, count(*) FILTER (needs_review) AS needs_review_total,
           {money_sum('total_amount')} AS total_amount_sum"""


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("processing_date", F.col("processing_date").cast("string"))


DAILY_SUMMARY_SQL = f"""
    SELECT {DAILY_SQL}, cast(sum(cast(model_confidence AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS avg_model_confidence,
           cast(sum(cast(validation_score AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS avg_validation_score
    FROM fx_ledger GROUP BY 1"""


@query("viw_daily_summary", DAILY_SUMMARY_SQL, ("fx_ledger",))
def viw_daily_summary(spark, folder):
    return as_doubles(_dated(views.daily_summary(flat(spark, folder))), "total_amount_sum")


# ---- reports ------------------------------------------------------------------------------------

KPIS_SQL = """
    SELECT count(*) AS records_total, count(*) FILTER (row_status = 'STORED') AS stored_total,
           count(*) FILTER (needs_review) AS needs_review_total FROM fx_ledger"""


@query("rpt_kpis", KPIS_SQL, ("fx_ledger",))
def rpt_kpis(spark, folder):
    return reports.kpis(flat(spark, folder))


CURRENCY_SQL = f"""
    SELECT currency, {money_sum('total_amount')} AS total_amount_sum FROM fx_ledger GROUP BY currency"""


@query("rpt_currency_totals", CURRENCY_SQL, ("fx_ledger",))
def rpt_currency_totals(spark, folder):
    return reports.currency_totals(flat(spark, folder))


CURRENCY_DISPLAY_SQL = f"""
    SELECT 'all' AS part, count(DISTINCT currency) || ' currencies' AS total_amount_display FROM fx_ledger
    UNION ALL SELECT 'eur', 'EUR ' || format('{{:,.2f}}', {money_sum('total_amount')}) FROM fx_ledger WHERE currency = 'EUR'
    UNION ALL SELECT 'none', '0'"""


@query("rpt_currency_display", CURRENCY_DISPLAY_SQL, ("fx_ledger",))
def rpt_currency_display(spark, folder):
    totals = reports.currency_totals(flat(spark, folder))
    parts = {"all": totals, "eur": totals.where("currency = 'EUR'"), "none": totals.where("currency = 'XXX'")}
    shown = [
        reports.currency_display(part).select(F.lit(name).alias("part"), "total_amount_display")
        for name, part in parts.items()
    ]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query("rpt_daily_tail", f"""
    SELECT {DAILY_SQL} FROM fx_ledger GROUP BY 1 ORDER BY 1 DESC LIMIT 14""", ("fx_ledger",))
def rpt_daily_tail(spark, folder):
    return _dated(reports.daily_tail(views.records_flat(reports.last_days(fx.stored_ledger(spark, folder)))))


VENDORS_SQL = f"""
    SELECT vendor_name, count(*) AS invoices, {money_sum('total_amount')} AS total_spend FROM fx_ledger
    GROUP BY vendor_name ORDER BY total_spend DESC, vendor_name LIMIT 10"""


@query("rpt_top_vendors", VENDORS_SQL, ("fx_ledger",))
def rpt_top_vendors(spark, folder):
    return reports.top_vendors(flat(spark, folder))


PROVIDERS_SQL = """
    SELECT used_provider, n AS records_total, cast(floor(n / greatest(max(n) OVER (), 1) * 100 + 0.5) AS BIGINT) AS bar_percent
    FROM (SELECT used_provider, count(*) AS n FROM fx_ledger GROUP BY used_provider)"""


@query("rpt_provider_mix", PROVIDERS_SQL, ("fx_ledger",))
def rpt_provider_mix(spark, folder):
    return reports.provider_mix(flat(spark, folder))


SHOWN_SQL = """strftime(processed_at_utc, '%Y-%m-%d %H:%M:%S') AS processed_at_utc, document_id, drive_file_id, vendor_name, currency,
           total_amount, coalesce(invoice_number, '-') AS invoice_number, used_provider, needs_review"""


@query("rpt_recent", f"""
    SELECT {SHOWN_SQL} FROM fx_ledger ORDER BY fx_ledger.processed_at_utc DESC, document_id LIMIT 20""", ("fx_ledger",))
def rpt_recent(spark, folder):
    return reports.recent_records(views.records_flat(reports.newest_rows(fx.stored_ledger(spark, folder))))


@query("rpt_activity_feed", """
    SELECT * FROM (
      SELECT strftime(processed_at_utc, '%Y-%m-%d %H:%M:%S') AS recorded_at_utc, CASE WHEN needs_review THEN 'STORED_REVIEW_FLAG' ELSE 'STORED' END AS status,
             document_id, drive_file_id AS source_file_id, vendor_name, coalesce(invoice_number, '-') AS invoice_number, currency, total_amount, used_provider,
             CASE WHEN needs_review THEN 'Stored with needs_review flag' ELSE 'Stored in ledger' END AS message FROM fx_ledger
      UNION ALL SELECT created_at_utc, 'REVIEW_REQUIRED', document_id, source_file_id, n_vendor, n_number, n_currency, n_total, used_provider,
             CASE WHEN reasons = '' THEN 'routed to review' ELSE replace(reasons, ',', ', ') END FROM fx_active
      UNION ALL SELECT decided_at, status, document_id, source_file_id, vendor_name, invoice_number, currency, total_amount, used_provider,
             coalesce(resolution_note, 'Review decision recorded') FROM fx_history
      UNION ALL SELECT recorded_at_utc, status, document_id, drive_file_id, NULL, NULL, NULL, NULL, coalesce(used_provider, 'unknown'),
             coalesce(error_message, error_code, 'Processing failed') FROM fx_active_dead WHERE status = 'FAILED')
    ORDER BY recorded_at_utc DESC, document_id NULLS FIRST, status LIMIT 200""", ("fx_ledger", "fx_active", "fx_history", "fx_active_dead"))
def rpt_activity_feed(spark, folder):
    dead, queue, resolved = dead_and_rest(spark, folder, active=False)
    limit = 200
    return reports.activity_feed(
        reports.recent_records(views.records_flat(reports.newest_rows(fx.stored_ledger(spark, folder), limit)), limit),
        review.active_items(queue, resolved),
        review.history_items(queue),
        reports.active_dead_letters(dead, resolved),
        limit,
    )


@query("rpt_resolved_hashes", "SELECT file_hash FROM fx_resolved", ("fx_resolved",))
def rpt_resolved_hashes(spark, folder):
    return reports.resolved_hashes(fx.ledger(spark, folder))


def dead_and_rest(spark, folder, active: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dead letters, the review queue, and which of their files are stored: one reading of the ledger for both."""
    dead, queue = fx.dead_letters(spark, folder), fx.review_queue(spark, folder)
    resolved = reports.resolved_hashes(fx.ledger(spark, folder), review.waiting_items(queue), reports.open_failures(dead))
    return reports.active_dead_letters(dead, resolved) if active else dead, queue, resolved


@query("rpt_active_dead_letters", "SELECT * FROM fx_active_dead", ("fx_active_dead",))
def rpt_active_dead_letters(spark, folder):
    return dead_and_rest(spark, folder)[0]


@query("rpt_metric_counters", "SELECT * FROM fx_counters", ("fx_counters",))
def rpt_metric_counters(spark, folder):
    return reports.metric_counters(fx.metrics(spark, folder))


@query("rpt_stats", """
    SELECT * FROM fx_counters UNION ALL SELECT 'dead_letter_total', count(*) FROM fx_active_dead
    UNION ALL SELECT 'review_queue_total', count(*) FROM fx_active""", ("fx_counters", "fx_active_dead", "fx_active"))
def rpt_stats(spark, folder):
    return reports.stats(fx.metrics(spark, folder), *dead_and_rest(spark, folder))


@query("rpt_backlog", """
    SELECT r AS review_queue_total, d AS dead_letter_total, r + d AS attention_total
    FROM (SELECT (SELECT count(*) FROM fx_active) AS r, (SELECT count(*) FROM fx_active_dead) AS d)""", ("fx_active", "fx_active_dead"))
def rpt_backlog(spark, folder):
    return reports.backlog(*dead_and_rest(spark, folder))


@query("rpt_failures_tail", """
    SELECT *, (SELECT count(*) FROM fx_dead) AS log_total FROM fx_dead ORDER BY seq DESC LIMIT 50""", ("fx_dead",))
def rpt_failures_tail(spark, folder):
    return reports.failures_tail(fx.dead_letters(spark, folder))


@query("rpt_run_snapshot", """
    SELECT run, cast(sum((event_id % 6 = 0)::INT) AS BIGINT) AS throughput_total, cast(sum((event_id % 6 = 1)::INT) AS BIGINT) AS success_total,
           cast(sum((event_id % 6 = 2)::INT) AS BIGINT) AS review_total, cast(sum((event_id % 6 = 3)::INT) AS BIGINT) AS failure_total,
           0::BIGINT AS duplicate_skips_total, max(CASE WHEN rn = floor(0.95 * (n - 1)) + 1 THEN latency END) AS latency_p95_ms
    FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY latency) AS rn, count(*) OVER (PARTITION BY run) AS n
          FROM (SELECT *, 'run-' || (user_id % 7) AS run, event_id % 997 AS latency FROM events))
    GROUP BY run""")
def rpt_run_snapshot(spark, folder):
    events = fx.table(spark, folder, "events")
    run = fx.numbered("run-", F.col("user_id") % 7).alias("run")
    kind = F.col("event_id") % 6
    names = list(reports.SNAPSHOT.values())
    metric = F.when(kind == 0, names[0]).when(kind == 1, names[1]).when(kind == 2, names[2]).when(kind == 3, names[3])
    counters = events.select(run, metric.alias("metric"), F.lit(1).cast("bigint").alias("value"))
    latencies = events.select(run, (F.col("event_id") % 997).alias("latency_ms"))
    return reports.run_snapshot(counters, latencies, width=50)


def any_contains(names: list[str], text: str) -> str:
    return " OR ".join(f"contains(lower(coalesce({name}, '')), '{text}')" for name in names)


SEARCH_RECENT_SQL = f"""
    SELECT * FROM (SELECT {SHOWN_SQL} FROM fx_ledger)
    WHERE {any_contains(['processed_at_utc', 'vendor_name', 'invoice_number', 'used_provider', 'currency'], '99')}"""


@query("rpt_search_recent", SEARCH_RECENT_SQL, ("fx_ledger",))
def rpt_search_recent(spark, folder):
    return reports.search_recent(reports.shown_records(flat(spark, folder)), " 99")


SEARCH_REVIEW_SQL = f"""
    SELECT {ACTIVE_SQL} FROM fx_active
    WHERE {any_contains(['document_id', 'source_file_id', 'n_vendor', 'n_number', "replace(reasons, ',', ', ')"], 'failed, low')}
       OR {any_contains(['document_id', 'source_file_id', 'n_vendor', 'n_number'], 'failed, low')}"""


@query("rpt_search_review", SEARCH_REVIEW_SQL, ("fx_active",))
def rpt_search_review(spark, folder):
    found = reports.search_review(review.active_items(*queue_and_resolved(spark, folder)), "FAILED, low")
    return found.select(*ACTIVE_COLUMNS, F.array_join("reason_codes", ",").alias("reasons"))


SEARCH_HISTORY_SQL = f"""
    SELECT * EXCLUDE (decided_at) FROM fx_history
    WHERE {any_contains(['document_id', 'status', 'vendor_name', 'resolution_note', 'invoice_number'], 'reject')}"""


@query("rpt_search_history", SEARCH_HISTORY_SQL, ("fx_history",))
def rpt_search_history(spark, folder):
    return reports.search_history(review.history_items(fx.review_queue(spark, folder)), "Reject")


def in_two_batches(index: search.TextIndex, rows: DataFrame) -> search.TextIndex:
    half = F.pmod(F.xxhash64("document_id"), F.lit(2))
    for part in range(2):
        index.append(rows.where(half == part))
    return index


@query("rpt_search_recent_index", SEARCH_RECENT_SQL.replace("'99'", "'099'"), ("fx_ledger",))
def rpt_search_recent_index(spark, folder):
    rows = reports.shown_records(flat(spark, folder))
    index = search.recent_index(spark, work_folder(spark, "index"), rows, ["document_id"], 16)
    return in_two_batches(index, rows).search(" 099")


@query("rpt_search_review_index", SEARCH_REVIEW_SQL, ("fx_active",))
def rpt_search_review_index(spark, folder):
    rows = review.active_items(*queue_and_resolved(spark, folder))
    found = in_two_batches(search.review_index(spark, work_folder(spark, "index"), rows, 16), rows).search("FAILED, low")
    return found.select(*ACTIVE_COLUMNS, F.array_join("reason_codes", ",").alias("reasons"))


@query("rpt_search_history_index", SEARCH_HISTORY_SQL, ("fx_history",))
def rpt_search_history_index(spark, folder):
    rows = review.history_items(fx.review_queue(spark, folder))
    return in_two_batches(search.history_index(spark, work_folder(spark, "index"), rows, 16), rows).search("Reject")


# ---- streams ------------------------------------------------------------------------------------

def finish(started) -> None:
    """Wait until all present files are handled; a failed stream raises here."""
    started.awaitTermination()


def as_files(df: DataFrame, path: str) -> None:
    """Packed JSON lines, in files small enough to be read side by side."""
    df.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", 100_000).json(path)


def stream_of(df: DataFrame, folder: str) -> DataFrame:
    """The rows again as a stream of JSON files."""
    as_files(df, f"{folder}/in")
    return jobs.ingest_stream(df.sparkSession, f"{folder}/in", df.schema)


@query("str_ingest", """
    SELECT metric, count(*) AS events FROM fx_metrics GROUP BY metric""", ("fx_metrics",))
def str_ingest(spark, folder):
    work = work_folder(spark, "ingest")
    events = fx.metrics(spark, folder).select("recorded_at_utc", "metric", "value", "stage")
    as_files(events, f"{work}/in")
    for _ in range(2):  # the second cycle finds nothing new
        stream = jobs.ingest_stream(spark, f"{work}/in", METRIC)
        finish(
            stream.writeStream.format("parquet").option("path", f"{work}/out")
            .option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
        )
    return spark.read.parquet(f"{work}/out").groupBy("metric").agg(F.count(F.lit(1)).alias("events"))


@query("str_claims", """
    SELECT drive_file_id, file_hash, claim_status, owner_id, count(*) AS attempts FROM fx_claim_results GROUP BY ALL""", ("fx_claim_results",))
def str_claims(spark, folder):
    work = work_folder(spark, "claims")
    jobs.seed_claims(fx.claims(spark, folder), f"{work}/claims")
    stream = stream_of(fx.claim_attempts(spark, folder), work)
    finish(jobs.claim_stream(stream, f"{work}/claims", f"{work}/results", f"{work}/checkpoint", "2026-01-01"))
    results = spark.read.parquet(f"{work}/results")
    return results.groupBy("drive_file_id", "file_hash", "claim_status", "owner_id").agg(F.count(F.lit(1)).alias("attempts"))


@query("str_claims_state", "SELECT * FROM fx_claim_results", ("fx_claim_results",))
def str_claims_state(spark, folder):
    """First attempts and second ones in runs of their own, so that the second meet the first in the state store."""
    work = work_folder(spark, "claim-state")
    attempts = fx.claim_attempts(spark, folder)
    for place in range(2):
        stream = stream_of(attempts.where(F.col("arrival") % 2 == place), work)
        finish(claim_state.claim_results_stream(stream, f"{work}/results", f"{work}/checkpoint", fx.claims(spark, folder)))
    return spark.read.parquet(f"{work}/results").drop("batch")


@query("str_first_claims", "SELECT drive_file_id, file_hash, k * 2 AS arrival FROM fx_orders", ("fx_orders",))
def str_first_claims(spark, folder):
    """Of two runs with attempts on the same keys, those of the second are dropped."""
    work = work_folder(spark, "first-claims")
    rows = fx.order_keys(spark, folder).select("drive_file_id", "file_hash", F.col("ordered_at").cast("timestamp").alias("at"), (F.col("k") * 2).alias("arrival"))
    for place in range(2):
        stream = stream_of(rows.withColumn("arrival", F.col("arrival") + place), work)
        finish(jobs.changes_stream(jobs.first_claims_stream(stream, "at", "1 hour"), f"{work}/results", f"{work}/checkpoint"))
    return spark.read.parquet(f"{work}/results").select("drive_file_id", "file_hash", "arrival")


@query("str_routed_sinks", """
    SELECT s AS sink, count(*) AS written FROM (
      SELECT unnest(CASE WHEN failed THEN ['dead_letters'] WHEN good THEN ['ledger'] ELSE ['dead_letters', 'review_queue'] END) AS s
      FROM (SELECT k % 41 = 0 AS failed, NOT (k % 12 = 0) AND totalprice > 0 AS good FROM fx_orders)) GROUP BY s""", ("fx_orders",))
def str_routed_sinks(spark, folder):
    work = work_folder(spark, "routed")
    fields = F.struct(
        fx.numbered("Vendor ", F.col("custkey")).alias("vendor"),
        fx.numbered("INV-").alias("invoice_no"),
        F.col("totalprice").alias("subtotal"),
        F.when(fx.every(12), F.lit("$5.00")).otherwise(F.lit("0")).alias("tax"),
        F.col("totalprice").alias("total"),
        F.lit(0.9).alias("confidence"),
        F.date_format("ordered_at", "dd/MM/yyyy").alias("date"),
    )
    failed = fx.every(41)
    rows = fx.order_keys(spark, folder).select(
        "document_id", "drive_file_id", "file_hash", F.col("k").alias("seq"),
        F.when(~failed, F.to_json(fields)).alias("raw_text"),
        F.lit(None).cast("string").alias("ocr_text"),
        F.lit("mistral").alias("provider"),
        F.when(failed, F.lit("all_providers_failed")).alias("error_code"),
        F.when(failed, F.lit("down")).alias("error_message"),
    )
    stream = stream_of(rows, work)
    now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    finish(jobs.routed_sinks(stream, work, f"{work}/checkpoint", fx.AS_OF, now))
    parts = [
        spark.read.parquet(f"{work}/{sink}").agg(F.count(F.lit(1)).alias("written")).select(F.lit(sink).alias("sink"), "written")
        for sink in ("ledger", "review_queue", "dead_letters")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


RUN_SQL = """
    SELECT * FROM (WITH runs AS (SELECT *, 'doc-' || k AS name, 2 * k AS place FROM fx_orders
                  UNION ALL SELECT *, 'again-' || k, 2 * k + 1000000000000 FROM fx_orders WHERE k % 11 = 0),
    judged AS (SELECT *, CASE WHEN k % 41 = 0 OR k % 29 = 0 THEN 'FAILED' WHEN k % 12 = 0 THEN 'REVIEW_REQUIRED' ELSE 'STORED' END AS outcome FROM runs),
    outcomes AS (SELECT * REPLACE (CASE WHEN outcome = 'STORED' AND place >= 1000000000000 THEN 'SKIPPED_DUPLICATE' ELSE outcome END AS outcome) FROM judged),
    told AS (SELECT *, CASE WHEN outcome = 'REVIEW_REQUIRED' THEN 'validation_failed: Routed to review queue'
                            WHEN k % 41 = 0 THEN 'all_providers_failed: All configured providers failed: mistral: down'
                            ELSE 'invalid_json_shape: Model output must be a JSON object' END AS detail FROM outcomes)
    SELECT 'ledger' AS sink, place, name, 'STORED' AS status, 'Vendor ' || custkey AS detail FROM outcomes WHERE outcome = 'STORED'
    UNION ALL SELECT 'dead_letters', place, name, outcome, detail FROM told WHERE outcome IN ('FAILED', 'REVIEW_REQUIRED')
    UNION ALL SELECT 'review_queue', NULL, name, outcome, 'validation_failed' FROM outcomes WHERE outcome = 'REVIEW_REQUIRED'
    UNION ALL SELECT 'claims', NULL, drive_file_id, CASE outcome WHEN 'STORED' THEN 'ARCHIVED' ELSE outcome END, 'poll-1' FROM judged WHERE place < 1000000000000
    UNION ALL SELECT 'manifest', NULL, drive_file_id, NULL, 'archive/' || k || '.pdf' FROM outcomes WHERE outcome = 'STORED'
    UNION ALL SELECT 'counters', count(*), 'documents_processed_total', NULL, NULL FROM outcomes
    UNION ALL SELECT 'counters', count(*) FILTER (outcome = 'SKIPPED_DUPLICATE'), 'documents_duplicate_skipped_total', NULL, NULL FROM outcomes
    UNION ALL SELECT 'counters', count(*) FILTER (outcome = 'REVIEW_REQUIRED'), 'documents_review_total', NULL, NULL FROM outcomes
    UNION ALL SELECT 'counters', count(*) FILTER (outcome = 'STORED'), 'documents_success_total', NULL, NULL FROM outcomes
    UNION ALL SELECT 'counters', count(*) FILTER (outcome = 'FAILED'), 'documents_failed_total', NULL, NULL FROM outcomes)"""
LATER = 1_000_000_000_000


def run_attempts(spark, folder, again: bool) -> DataFrame:
    """Attempts of every document, or of those that come a second time. Some providers are down, some models
    give no JSON object at first, and some never do."""
    fields = F.struct(
        fx.numbered("Vendor ", F.col("custkey")).alias("vendor"), fx.numbered("INV-").alias("invoice_no"),
        F.col("totalprice").alias("subtotal"), F.when(fx.every(12), F.lit("$5.00")).otherwise(F.lit("0")).alias("tax"),
        F.col("totalprice").alias("total"), F.lit(0.9).alias("confidence"), F.date_format("ordered_at", "dd/MM/yyyy").alias("date"),
    )
    down, broken, retried = fx.every(41), fx.every(29), fx.every(31)
    orders = fx.order_keys(spark, folder)
    if again:
        orders = orders.where(fx.every(11)).withColumn("document_id", fx.numbered("again-"))
    seq = 2 * F.col("k") + F.lit(LATER if again else 0)
    first = F.when(down, F.lit(None)).when(broken | retried, F.lit("not json")).otherwise(F.to_json(fields))
    second = F.when(~down & broken, F.concat(F.lit("["), F.col("k").cast("string"), F.lit("]"))).when(~down & retried, F.to_json(fields))

    def attempt(place: int, kind: str, raw: Column, error: Column) -> Column:
        return F.struct(
            (seq + place).alias("seq"), F.lit(kind).alias("prompt_kind"), F.lit("mistral").alias("provider"), raw.alias("raw_text"),
            F.lit(None).cast("string").alias("ocr_text"), error.cast("string").alias("error"),
        )

    both = F.array(
        attempt(0, "first", first, F.when(down, F.lit("down"))),
        F.when(second.isNotNull(), attempt(1, "corrective", second, F.lit(None))),
    )
    return orders.select("document_id", "drive_file_id", "file_hash", F.inline(F.filter(both, lambda one: one.isNotNull())))


@query("str_run", RUN_SQL, ("fx_orders",))
def str_run(spark, folder):
    """Two cycles of the whole run; the second brings documents again, some of which may be claimed anew."""
    work = work_folder(spark, "run")
    now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    for again in (False, True):
        stream = stream_of(run_attempts(spark, folder, again), work)
        finish(jobs.run_documents(stream, work, f"{work}/checkpoint", fx.AS_OF, now, "poll-1", "2026-01-01", "archive"))
    read = lambda name: spark.read.parquet(f"{work}/{name}")
    none = F.lit(None)

    def shown(df: DataFrame, sink: str, place: Column, name: Column, status: Column, detail: Column) -> DataFrame:
        return df.select(
            F.lit(sink).alias("sink"), place.cast("bigint").alias("place"), name.cast("string").alias("name"),
            status.cast("string").alias("status"), detail.cast("string").alias("detail"),
        )

    counters = read("counters").drop("batch")
    summed = counters.agg(*[F.sum(name).alias(name) for name in counters.columns]).unpivot([], counters.columns, "metric", "value")
    claims = jobs.current_claims(spark, f"{work}/claims", LATER)
    col = F.col
    parts = [
        shown(views.records_flat(read("ledger")), "ledger", col("id"), col("document_id"), col("row_status"), col("vendor_name")),
        shown(read("dead_letters"), "dead_letters", col("seq"), col("document_id"), col("status"), F.concat_ws(": ", "error_code", "error_message")),
        shown(read("review_queue"), "review_queue", none, col("document_id"), col("status"), F.array_join("reason_codes", ",")),
        shown(claims, "claims", none, col("drive_file_id"), col("status"), col("owner_id")),
        shown(read("manifest"), "manifest", none, col("source"), none, col("destination")),
        shown(summed, "counters", col("value"), col("metric"), none, none),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("str_counters", "SELECT * FROM fx_counters", ("fx_counters",))
def str_counters(spark, folder):
    work = work_folder(spark, "counters")
    events = fx.metrics(spark, folder).select("recorded_at_utc", "metric", "value", "stage")
    as_files(events, f"{work}/in")
    totals = jobs.counters_stream(jobs.ingest_stream(spark, f"{work}/in", METRIC))
    finish(jobs.snapshot_stream(totals, f"{work}/out", f"{work}/checkpoint"))
    return jobs.read_snapshot(spark, f"{work}/out")


@query("str_daily", f"""
    SELECT {DAILY_SQL}, cast(sum(cast(model_confidence AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS avg_model_confidence,
           cast(sum(cast(validation_score AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS avg_validation_score
    FROM fx_ledger GROUP BY 1""", ("fx_ledger",))
def str_daily(spark, folder):
    work = work_folder(spark, "daily")
    stream = jobs.ledger_stream(spark, fx.ledger_path(spark, folder))
    finish(jobs.changes_stream(jobs.daily_stream(stream), f"{work}/out", f"{work}/checkpoint"))
    return as_doubles(_dated(jobs.read_last_changes(spark, f"{work}/out", "processing_date")), "total_amount_sum")


# ---- reports from stored totals -------------------------------------------------------------------

def kept_totals(spark, folder):
    """Totals kept up over two runs: every day gets records in the second that it lacked in the first."""
    work = work_folder(spark, "totals")
    ledger = fx.ledger(spark, folder)
    table = totals.totals_table(ledger, f"{work}/table", 16)
    for part in range(2):
        ledger.where(F.col("id") % 2 == part).write.mode("append").option("compression", "zstd").parquet(f"{work}/in")
        finish(totals.totals_stream(jobs.ledger_stream(spark, f"{work}/in"), table, f"{work}/checkpoint"))
    return table.rows()


@query("viw_daily_kept", DAILY_SUMMARY_SQL, ("fx_ledger",))
def viw_daily_kept(spark, folder):
    return as_doubles(_dated(totals.daily_summary(kept_totals(spark, folder))), "total_amount_sum")


@query("rpt_kpis_kept", KPIS_SQL, ("fx_ledger",))
def rpt_kpis_kept(spark, folder):
    return totals.kpis(kept_totals(spark, folder))


@query("rpt_currency_kept", CURRENCY_SQL, ("fx_ledger",))
def rpt_currency_kept(spark, folder):
    return totals.currency_totals(kept_totals(spark, folder))


@query("rpt_vendors_kept", VENDORS_SQL, ("fx_ledger",))
def rpt_vendors_kept(spark, folder):
    return totals.top_vendors(kept_totals(spark, folder))


@query("rpt_providers_kept", PROVIDERS_SQL, ("fx_ledger",))
def rpt_providers_kept(spark, folder):
    return totals.provider_mix(kept_totals(spark, folder))
