from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from docledger.operators import reports, views
from docledger.streaming import totals

RECORD = "id bigint, processed_at_utc timestamp, status string, drive_file_id string, file_hash string, record_json string, metadata_json string"


def ledger_rows(spark, rows):
    """(id, day or None, vendor, currency, amount, provider, needs review) as ledger rows."""
    made = [
        (n, None, "STORED" if n % 3 else "ARCHIVED", f"f{n}", "h",
         json.dumps({"vendor_name": vendor, "currency": currency, "total_amount": amount, "needs_review": review, "model_confidence": 0.1 * (n % 7), "validation_score": None if n % 5 else 0.25}),
         json.dumps({"document_id": f"d{n}", "used_provider": provider}), day)
        for n, day, vendor, currency, amount, provider, review in rows
    ]
    df = spark.createDataFrame(made, RECORD + ", day string")
    return df.withColumn("processed_at_utc", F.to_timestamp("day")).drop("day")


def same(got, expected):
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.select(*got.columns).collect()))


def test_totals_equal_a_recount(spark, tmp_path):
    parts = [
        [(n, f"2026-01-0{1 + n % 3}", f"V{n % 4}", "EUR" if n % 2 else None, 1.25 * n, "p1", n % 2 == 0) for n in range(40)],
        [(100 + n, f"2026-01-0{1 + n % 9}", None if n % 6 == 0 else "V1", "USD", None if n == 3 else -2.5, None, False) for n in range(30)],
        [(200 + n, None if n == 0 else "2025-12-31", "V9", "EUR", 10.0, "p2", True) for n in range(3)],  # late, and without time
    ]
    table = None
    for number, rows in enumerate([*parts, None]):
        if rows is not None:
            ledger_rows(spark, rows).write.mode("append").json(str(tmp_path / "in"))
        else:  # the last micro-batch again: its commit is lost
            os.remove(tmp_path / "checkpoint" / "commits" / "2")
            crc = tmp_path / "checkpoint" / "commits" / ".2.crc"
            if crc.exists():
                os.remove(crc)
        stream = spark.readStream.schema(RECORD).json(str(tmp_path / "in"))
        table = table or totals.totals_table(stream, str(tmp_path / "table"), 4)
        totals.totals_stream(stream, table, str(tmp_path / "checkpoint")).awaitTermination()
        flat = views.records_flat(spark.read.schema(RECORD).json(str(tmp_path / "in")))
        kept = table.rows()
        same(totals.daily_summary(kept), views.daily_summary(flat))
        same(totals.kpis(kept), reports.kpis(flat))
        same(totals.currency_totals(kept), reports.currency_totals(flat))
        same(totals.top_vendors(kept, 3), reports.top_vendors(flat, 3))
        same(totals.provider_mix(kept), reports.provider_mix(flat))
        same(reports.currency_display(totals.currency_totals(kept)), reports.currency_display(reports.currency_totals(flat)))
    plan = totals.daily_summary(table.rows())._jdf.queryExecution().executedPlan().toString()
    assert "variant" not in plan and "json" not in plan
    assert table.rows().count() == table.rows().select(*totals.KEY).distinct().count()


def test_empty_totals(spark, tmp_path):
    empty = ledger_rows(spark, [(1, "2026-01-01", "V", "EUR", 1.0, "p", False)]).limit(0)
    kept = totals.totals_table(empty, str(tmp_path / "table"), 2).rows()
    same(totals.kpis(kept), reports.kpis(views.records_flat(empty)))
    assert totals.daily_summary(kept).count() == totals.top_vendors(kept).count() == 0
