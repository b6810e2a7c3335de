from __future__ import annotations

import glob

import pyarrow.parquet as pq
from conftest import TABLES
from docledger.plans import fixtures as fx, report_queries  # noqa: F401
from docledger.plans.registry import QUERIES
from docledger.sources import sinks
from docledger.streaming import jobs


def test_joins_move_narrow_rows(spark):
    """Customers are joined before lists of lines are in the rows, and texts that follow from the key are made after all joins."""
    plan = fx.truth(spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line.strip(" :+-") for line in plan.splitlines() if "Join " in line]
    assert [join.split(",")[0] for join in joins[:2]] == ["Join Inner", "Join LeftOuter"]
    assert "sha2" in plan[: plan.index("Join ")] and "sha2" not in plan[plan.index("Join "):]


def test_ledger_files_are_packed(spark, tmp_path):
    sinks.write_ledger(fx.made_ledger(spark, TABLES), str(tmp_path / "ledger"))
    files = glob.glob(f"{tmp_path}/ledger/*/*.parquet")
    assert {pq.ParquetFile(name).metadata.row_group(0).column(4).compression for name in files} == {"ZSTD"}


def test_streams_read_ledger_files_as_they_lie(spark, tmp_path, monkeypatch):
    """Rows of new ledger files arrive once each; the daily stream and the kept totals write no JSON copies of the ledger."""
    ledger, found = fx.ledger(spark, TABLES), []
    for part in range(2):
        sinks.write_ledger(ledger.where(f"id % 2 = {part}"), str(tmp_path / "in"))
        query = jobs.changes_stream(jobs.ledger_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        found.append({tuple(row) for row in spark.read.parquet(str(tmp_path / "out")).select(*ledger.columns).collect()})
    assert found[1] == {tuple(row) for row in ledger.collect()} and len(found[0]) < len(found[1])
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(found[1])
    monkeypatch.delattr("docledger.plans.report_queries.as_files")
    assert QUERIES["str_daily"](spark, TABLES).count() and QUERIES["rpt_kpis_kept"](spark, TABLES).count() == 1


def test_winners_meet_rows_by_seq_alone(spark):
    rows = spark.createDataFrame([(1, "a", "h"), (2, "a", "h"), (3, "b", "h"), (4, None, "h"), (5, "", "h")], "seq long, drive_file_id string, file_hash string")
    ledger = spark.createDataFrame([("b", "h")], "drive_file_id string, file_hash string")
    found = sinks.append_if_absent(rows, ledger)
    join = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line][0]
    assert "seq" in join and "file_hash" not in join
    assert {row["seq"]: row["append_status"] for row in found.collect()} == {
        1: "appended", 2: "skipped_duplicate", 3: "skipped_duplicate", 4: "missing_key", 5: "missing_key",
    }
