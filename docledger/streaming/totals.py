"""Totals that the dashboard shows, kept up as the ledger grows.

A streaming aggregation keeps one row of counts and exact sums for each day, currency, vendor and provider in the state store. What a
micro-batch changes is put into a table stored by key, as whole rows and not as increments, so a repeated micro-batch changes nothing, and
late records simply change an older day. A record's JSON is read once, when it arrives; a refresh of the dashboard reads the table, which has
as many rows as there are days, currencies, vendors and providers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docledger.operators.views import records_flat
from docledger.sources.keyed import KeyedTable
from docledger.streaming.claim_state import state_store

KEY = ["dimension", "value"]
AVERAGED = ["model_confidence", "validation_score"]


def partial_totals(flat: DataFrame) -> DataFrame:
    """One row for each day ('' where a record has no time), currency, vendor and provider, of a table or a stream of flat records."""
    dimensions = {
        "day": F.coalesce(F.to_date("processed_at_utc").cast("string"), F.lit("")),
        "currency": F.coalesce("currency", F.lit("NA")),
        "vendor": F.coalesce("vendor_name", F.lit("Unknown")),
        "provider": F.coalesce("used_provider", F.lit("unknown")),
    }
    each = F.array(*[F.struct(F.lit(name).alias("dimension"), value.alias("value")) for name, value in dimensions.items()])
    rows = flat.select("row_status", "needs_review", "total_amount", *AVERAGED, F.explode(each).alias("_of"))
    averages = [one for name in AVERAGED for one in (F.sum(name).alias(f"{name}_sum"), F.count(name).alias(f"{name}_count"))]
    return rows.groupBy(F.col("_of.dimension").alias("dimension"), F.col("_of.value").alias("value")).agg(
        F.count(F.lit(1)).alias("records_total"),
        F.count_if(F.col("row_status") == "STORED").alias("stored_total"),
        F.count_if("needs_review").alias("needs_review_total"),
        F.sum("total_amount").alias("total_amount_sum"),
        *averages,
    )


def totals_table(ledger: DataFrame, location: str, buckets: int | None = None) -> KeyedTable:
    """The stored totals of a ledger or a stream of one; made empty if there are none."""
    return KeyedTable(ledger.sparkSession, location, partial_totals(records_flat(ledger)).schema, KEY, buckets)


def totals_stream(ledger: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Bring the totals up to date with the rows that are new in a stream of the ledger, and stop."""
    def process(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        table.upsert(batch)
        batch.unpersist()

    with state_store(ledger.sparkSession):
        writer = partial_totals(records_flat(ledger)).writeStream.outputMode("update").foreachBatch(process)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _of(totals: DataFrame, dimension: str) -> DataFrame:
    return totals.where(F.col("dimension") == dimension)


def _amount() -> Column:
    return F.coalesce(F.col("total_amount_sum").cast("double"), F.lit(0.0))


def daily_summary(totals: DataFrame) -> DataFrame:
    """As `operators.views.daily_summary` over the whole ledger."""
    averages = [(F.col(f"{name}_sum").cast("double") / F.col(f"{name}_count")).alias(f"avg_{name}") for name in AVERAGED]
    return (
        _of(totals, "day")
        .select(F.try_to_date("value").alias("processing_date"), "records_total", "stored_total", "needs_review_total", "total_amount_sum", *averages)
        .orderBy(F.col("processing_date").desc())
    )


def kpis(totals: DataFrame) -> DataFrame:
    """As `operators.reports.kpis`."""
    names = ["records_total", "stored_total", "needs_review_total"]
    return _of(totals, "day").agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names])


def currency_totals(totals: DataFrame) -> DataFrame:
    """As `operators.reports.currency_totals`, and so fit for `currency_display`."""
    rows = _of(totals, "currency").select(F.col("value").alias("currency"), _amount().alias("total_amount_sum"))
    return rows.orderBy(F.col("total_amount_sum").desc(), "currency")


def top_vendors(totals: DataFrame, limit: int = 10) -> DataFrame:
    """As `operators.reports.top_vendors`."""
    rows = _of(totals, "vendor").select(F.col("value").alias("vendor_name"), F.col("records_total").alias("invoices"), _amount().alias("total_spend"))
    return rows.orderBy(F.col("total_spend").desc(), "vendor_name").limit(limit)


def provider_mix(totals: DataFrame) -> DataFrame:
    """As `operators.reports.provider_mix`."""
    mix = _of(totals, "provider").select(F.col("value").alias("used_provider"), "records_total")
    share = F.floor(F.col("records_total") / F.max("records_total").over(W.partitionBy()) * 100 + F.lit(0.5)).cast("bigint")
    return mix.withColumn("bar_percent", share).orderBy(F.col("records_total").desc(), "used_provider")
