"""Dashboard and operations reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docledger.functions.text import filled
from docledger.operators.review import active_size, decided_at
from docledger.operators.views import daily_totals

FEED_COLUMNS = [
    "recorded_at_utc", "status", "document_id", "source_file_id", "vendor_name", "invoice_number",
    "currency", "total_amount", "used_provider", "message",
]


def kpis(flat: DataFrame) -> DataFrame:
    return flat.agg(
        F.count(F.lit(1)).alias("records_total"),
        F.count_if(F.col("row_status") == "STORED").alias("stored_total"),
        F.count_if("needs_review").alias("needs_review_total"),
    )


def _sum_of(name: str) -> Column:
    return F.coalesce(F.sum(name).cast("double"), F.lit(0.0))


def currency_totals(flat: DataFrame) -> DataFrame:
    return (
        flat.groupBy(F.coalesce("currency", F.lit("NA")).alias("currency"))
        .agg(_sum_of("total_amount").alias("total_amount_sum"))
        .orderBy(F.col("total_amount_sum").desc(), "currency")
    )


def currency_display(totals: DataFrame) -> DataFrame:
    """One text for the headline: nothing, the single currency's sum, or how many there are."""
    return totals.agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("currency").alias("_currency"),
        F.min("total_amount_sum").alias("_sum"),
    ).select(
        F.when(F.col("_n") == 0, F.lit("0"))
        .when(F.col("_n") == 1, F.concat_ws(" ", "_currency", F.format_number("_sum", 2)))
        .otherwise(F.concat(F.col("_n").cast("string"), F.lit(" currencies")))
        .alias("total_amount_display")
    )


def _not_before(ledger: DataFrame, time: Column) -> DataFrame:
    """Rows from a time on; earlier months' folders are not read."""
    rows = ledger.where(F.col("processed_at_utc") >= time)
    if "processing_month" in ledger.columns:
        rows = rows.where(F.col("processing_month") >= F.date_format(time, "yyyy-MM"))
    return rows


def last_days(ledger: DataFrame, limit: int = 14) -> DataFrame:
    """Ledger rows of the last days that have any; only their times are read to find these days."""
    days = ledger.select(F.date_trunc("day", "processed_at_utc").alias("day")).distinct().orderBy(F.col("day").desc()).limit(limit)
    return _not_before(ledger, days.agg(F.min("day")).scalar())


def newest_rows(ledger: DataFrame, limit: int = 20) -> DataFrame:
    """Ledger rows no older than the ``limit`` newest, found by their times alone, so that few records are parsed."""
    newest = ledger.select("processed_at_utc").orderBy(F.col("processed_at_utc").desc()).limit(limit)
    return _not_before(ledger, newest.agg(F.min("processed_at_utc")).scalar())


def daily_tail(flat: DataFrame, limit: int = 14) -> DataFrame:
    """The last days' totals. Take ``flat`` from ``last_days``, or the whole ledger is parsed."""
    return (
        daily_totals(flat)
        .select(
            "processing_date", "records_total", "stored_total", "needs_review_total",
            F.coalesce(F.col("total_amount_sum").cast("double"), F.lit(0.0)).alias("total_amount_sum"),
        )
        .orderBy(F.col("processing_date").desc())
        .limit(limit)
    )


def top_vendors(flat: DataFrame, limit: int = 10) -> DataFrame:
    return (
        flat.groupBy(F.coalesce("vendor_name", F.lit("Unknown")).alias("vendor_name"))
        .agg(F.count(F.lit(1)).alias("invoices"), _sum_of("total_amount").alias("total_spend"))
        .orderBy(F.col("total_spend").desc(), "vendor_name")
        .limit(limit)
    )


def provider_mix(flat: DataFrame) -> DataFrame:
    """Records per provider with the width of its bar, in percent of the largest."""
    mix = flat.groupBy(F.coalesce("used_provider", F.lit("unknown")).alias("used_provider")).agg(
        F.count(F.lit(1)).alias("records_total")
    )
    largest = F.max("records_total").over(W.partitionBy())  # over one row per provider
    share = F.floor(F.col("records_total") / largest * 100 + F.lit(0.5)).cast("bigint")
    return mix.withColumn("bar_percent", share).orderBy(F.col("records_total").desc(), "used_provider")


def shown_records(flat: DataFrame) -> DataFrame:
    return flat.select(
        F.col("processed_at_utc").cast("string").alias("processed_at_utc"),
        F.coalesce("document_id", F.lit("")).alias("document_id"),
        F.coalesce("drive_file_id", F.lit("")).alias("drive_file_id"),
        F.coalesce("vendor_name", F.lit("Unknown")).alias("vendor_name"),
        F.coalesce("currency", F.lit("NA")).alias("currency"),
        F.coalesce(F.col("total_amount").cast("double"), F.lit(0.0)).alias("total_amount"),
        F.coalesce("invoice_number", F.lit("-")).alias("invoice_number"),
        F.coalesce("used_provider", F.lit("unknown")).alias("used_provider"),
        F.coalesce("needs_review", F.lit(False)).alias("needs_review"),
    )


def recent_records(flat: DataFrame, limit: int = 20) -> DataFrame:
    """The newest records. Take ``flat`` from ``newest_rows``, or the whole ledger is parsed."""
    newest = flat.orderBy(F.col("processed_at_utc").desc(), F.col("document_id")).limit(limit)
    return shown_records(newest)


def _newest(events: DataFrame, limit: int) -> DataFrame:
    return events.orderBy(
        F.coalesce("recorded_at_utc", F.lit("")).desc(), "document_id", "status"
    ).limit(limit)


def activity_feed(
    recent: DataFrame, review: DataFrame, history: DataFrame, dead_letters: DataFrame, limit: int = 20
) -> DataFrame:
    """What happened last: stored records, waiting and decided reviews, failures."""
    flagged = F.col("needs_review")
    stored = recent.select(
        F.col("processed_at_utc").alias("recorded_at_utc"),
        F.when(flagged, "STORED_REVIEW_FLAG").otherwise("STORED").alias("status"),
        "document_id",
        F.col("drive_file_id").alias("source_file_id"),
        "vendor_name", "invoice_number", "currency", "total_amount", "used_provider",
        F.when(flagged, "Stored with needs_review flag").otherwise("Stored in ledger").alias("message"),
    )
    waiting = review.select(
        F.col("created_at_utc").alias("recorded_at_utc"),
        F.lit("REVIEW_REQUIRED").alias("status"),
        "document_id", "source_file_id", "vendor_name", "invoice_number", "currency",
        "total_amount", "used_provider",
        F.coalesce(filled(F.array_join("reason_codes", ", ")), F.lit("routed to review")).alias("message"),
    )
    decided = history.select(
        filled(decided_at()).alias("recorded_at_utc"),
        "status", "document_id", "source_file_id", "vendor_name", "invoice_number", "currency",
        "total_amount", "used_provider",
        F.coalesce(filled(F.col("resolution_note")), F.lit("Review decision recorded")).alias("message"),
    )
    none = F.lit(None).cast("string")
    failed = dead_letters.where(F.col("status") == "FAILED").select(
        "recorded_at_utc",
        "status",
        "document_id",
        F.col("drive_file_id").alias("source_file_id"),
        none.alias("vendor_name"),
        none.alias("invoice_number"),
        none.alias("currency"),
        F.lit(None).cast("double").alias("total_amount"),
        F.coalesce("used_provider", F.lit("unknown")).alias("used_provider"),
        F.coalesce(
            filled(F.col("error_message")), filled(F.col("error_code")), F.lit("Processing failed")
        ).alias("message"),
    )
    parts = [_newest(part.select(*FEED_COLUMNS), limit) for part in (stored, waiting, decided, failed)]
    events = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return _newest(events, limit)


def resolved_hashes(ledger: DataFrame, *among: DataFrame) -> DataFrame:
    """Hashes of files that are stored or archived: each once, or only those that rows of ``among`` ask for.

    Open items and failures are few against a ledger, so with them the ledger is filtered before anything of it moves;
    one such table serves several reports.
    """
    stored = ledger.where(F.col("status").isin("STORED", "ARCHIVED") & (F.col("file_hash") != "")).select("file_hash")
    if not among:
        return stored.distinct()
    wanted = among[0].select("file_hash")
    for other in among[1:]:
        wanted = wanted.union(other.select("file_hash"))
    return stored.join(wanted.where(F.col("file_hash") != "").distinct(), "file_hash", "left_semi")


def open_failures(dead_letters: DataFrame) -> DataFrame:
    return dead_letters.where(F.col("status").isin("FAILED", "REVIEW_REQUIRED"))


def active_dead_letters(dead_letters: DataFrame, resolved: DataFrame) -> DataFrame:
    """The latest open failure per document.

    ``dead_letters`` needs ``seq``, the log order. Status and resolved files are filtered before
    the latest is taken, so a filtered row never hides an older one.
    """
    unresolved = open_failures(dead_letters).join(resolved.where(F.col("file_hash") != ""), "file_hash", "left_anti")
    key = F.coalesce(
        filled(F.col("document_id")),
        F.concat(F.coalesce("drive_file_id", F.lit("")), F.lit("|"), F.coalesce("file_hash", F.lit(""))),
    )
    columns = dead_letters.columns
    place = F.row_number().over(W.partitionBy("_key").orderBy(F.col("seq").desc()))
    return unresolved.withColumn("_key", key).withColumn("_place", place).where("_place = 1").select(*columns)


def metric_counters(events: DataFrame) -> DataFrame:
    """Sum of the whole-number values per metric; true counts as one, fractions do not count."""
    kind = F.schema_of_variant("value")
    number = F.try_variant_get("value", "$", "bigint")
    return (
        events.where(F.col("metric").isNotNull() & kind.isin("BIGINT", "BOOLEAN"))
        .groupBy("metric")
        .agg(F.sum(number).alias("value"))
    )


def stats(events: DataFrame, dead: DataFrame, queue: DataFrame, resolved: DataFrame) -> DataFrame:
    """Metric counters plus the sizes of dead letters and review queue."""
    return (
        metric_counters(events)
        .unionByName(dead.agg(F.count(F.lit(1)).alias("value")).select(F.lit("dead_letter_total").alias("metric"), "value"))
        .unionByName(
            active_size(queue, resolved).select(
                F.lit("review_queue_total").alias("metric"), F.col("review_queue_total").alias("value")
            )
        )
    )


def backlog(dead: DataFrame, queue: DataFrame, resolved: DataFrame) -> DataFrame:
    """Open reviews and failures in one row."""
    zero = F.lit(0).cast("bigint")
    reviews = active_size(queue, resolved).select("review_queue_total", zero.alias("dead_letter_total"))
    letters = dead.agg(F.count(F.lit(1)).alias("dead_letter_total")).select(
        zero.alias("review_queue_total"), "dead_letter_total"
    )
    total = reviews.unionByName(letters).agg(
        F.sum("review_queue_total").alias("review_queue_total"),
        F.sum("dead_letter_total").alias("dead_letter_total"),
    )
    return total.withColumn(
        "attention_total", F.col("review_queue_total") + F.col("dead_letter_total")
    )


def failures_tail(dead_letters: DataFrame, limit: int = 50) -> DataFrame:
    """The last entries in log order, with the count of all; a limit of zero gives all."""
    total = dead_letters.agg(F.count(F.lit(1))).scalar()
    last = dead_letters.orderBy(F.col("seq").desc()).limit(limit) if limit else dead_letters
    return last.withColumn("log_total", total).orderBy("seq")


def latency_p95(latencies: DataFrame, group: str = "run", width: int = 1000) -> DataFrame:
    """The value at place ``int(0.95 * (n - 1))`` of each group's sorted latencies.

    Rows are counted per distinct value, then per range of ``width`` values. The running count goes
    over ranges to find the one that holds the place, and over the values of that range only, so no
    task sees all values of a group.
    """
    value = F.col("latency_ms")
    counted = (
        latencies.where(value.isNotNull())
        .groupBy(group, "latency_ms")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_range", F.floor(value / width))
    )
    ranges = counted.groupBy(group, "_range").agg(F.sum("_n").alias("_n"))
    total = ranges.groupBy(group).agg(F.sum("_n").alias("_total"))
    upto = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, 0)
    place = F.floor(F.lit(0.95) * (F.col("_total") - 1)) + 1
    holding = (
        ranges.withColumn("_upto", F.sum("_n").over(upto))
        .join(total, group)
        .withColumn("_place", place - F.col("_upto") + F.col("_n"))
        .where((F.col("_place") >= 1) & (F.col("_place") <= F.col("_n")))
        .select(group, "_range", "_place")
    )
    within = W.partitionBy(group, "_range").orderBy("latency_ms").rowsBetween(W.unboundedPreceding, 0)
    return (
        counted.join(holding, [group, "_range"])
        .withColumn("_upto", F.sum("_n").over(within))
        .where(F.col("_upto") >= F.col("_place"))
        .groupBy(group)
        .agg(F.min("latency_ms").alias("latency_p95_ms"))
    )


SNAPSHOT = {
    "throughput_total": "documents_processed_total",
    "success_total": "documents_success_total",
    "review_total": "documents_review_total",
    "failure_total": "documents_failed_total",
    "duplicate_skips_total": "documents_duplicate_skipped_total",
}


def run_snapshot(counters: DataFrame, latencies: DataFrame, group: str = "run", width: int = 1000) -> DataFrame:
    """Five counters (zero when absent) and the latency rank per run.

    ``counters``: group, metric, value. ``latencies``: group, latency_ms; ``width`` as in ``latency_p95``.
    """
    sums = counters.groupBy(group).agg(*[
        F.coalesce(F.sum(F.when(F.col("metric") == source, F.col("value"))), F.lit(0)).cast("bigint").alias(name)
        for name, source in SNAPSHOT.items()
    ])
    return sums.join(latency_p95(latencies, group, width), group, "left").withColumn(
        "latency_p95_ms", F.coalesce(F.col("latency_p95_ms"), F.lit(0)).cast("bigint")
    )


def matching(df: DataFrame, text: str, columns: list[Column]) -> DataFrame:
    """Rows in which any column holds the text, whatever its case; empty text keeps all rows."""
    if not text:
        return df
    wanted = text.strip().lower()
    found = F.lit(False)
    for column in columns:
        found = found | F.lower(F.coalesce(column.cast("string"), F.lit(""))).contains(wanted)
    return df.where(found)


def recent_texts() -> list[Column]:
    return [F.col(name) for name in ("processed_at_utc", "vendor_name", "invoice_number", "used_provider", "currency")]


def review_texts() -> list[Column]:
    names = ("document_id", "source_file_id", "vendor_name", "invoice_number")
    return [*[F.col(name) for name in names], F.array_join("reason_codes", ", ")]


def history_texts() -> list[Column]:
    return [F.col(name) for name in ("document_id", "status", "vendor_name", "resolution_note", "invoice_number")]


def search_recent(records: DataFrame, text: str) -> DataFrame:
    return matching(records, text, recent_texts())


def search_review(items: DataFrame, text: str) -> DataFrame:
    return matching(items, text, review_texts())


def search_history(items: DataFrame, text: str) -> DataFrame:
    return matching(items, text, history_texts())
