from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from docledger.operators import claims as claim_operators
from docledger.schemas import CLAIM_KEY
from docledger.sources.keyed import KeyedTable, claim_in_place, mark_in_place, store_if_absent

CLAIM = "drive_file_id string, file_hash string, status string, owner_id string, claimed_at_utc string, updated_at_utc string"
ATTEMPT = "drive_file_id string, file_hash string, owner_id string, arrival bigint"


def stored(spark, location, count=200, buckets=8):
    rows = spark.createDataFrame([(f"f{k}", "h", "CLAIMED" if k % 2 else "FAILED", "w0", "t0", "t0") for k in range(count)], CLAIM)
    table = KeyedTable(spark, str(location), rows.schema, CLAIM_KEY, buckets)
    table.append(rows)
    return table


def files_of(table) -> dict[str, set[str]]:
    top = table.location.removeprefix("file:") + "/rows"
    return {part: {name for name in os.listdir(f"{top}/{part}") if name.endswith(".parquet")} for part in os.listdir(top) if part.startswith("part=")}


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges_over(df, table) -> int:
    """Exchanges between the table's scan and the join above it."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scan = next(n for n, line in enumerate(lines) if f"FileScan parquet spark_catalog.default.{table.name}" in line)
    depth = lambda line: len(re.match(r"[\s:|+-]*", line)[0])
    found, at = 0, depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < at:
            at = depth(line)
            if re.search(r"Join", line):
                break
            found += "Exchange" in line
    else:
        raise AssertionError(plan)
    return found


def test_stored_rows_do_not_move(spark, tmp_path, no_broadcast):
    table = stored(spark, tmp_path / "t")
    attempts = spark.createDataFrame([("f3", "h", "w", 1), ("new", "h", "w", 2)], ATTEMPT)
    parts = table.touched(attempts)
    for partitions in ("8", "5", "64"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        with table.laid_out():
            first = attempts.groupBy(*CLAIM_KEY).agg(F.min("arrival").alias("seq"))
            assert exchanges_over(first.join(table.held(parts).select(*CLAIM_KEY), CLAIM_KEY, "left_anti"), table) == 0
            assert exchanges_over(claim_operators.claim(attempts, table.held(parts)), table) == 0
            marks = attempts.selectExpr("*", "'STORED' AS status", "arrival AS seq", "'t' AS updated_at_utc")
            assert exchanges_over(claim_operators.merge_status(marks, table.held(parts)), table) == 0
        spark.conf.set("spark.sql.shuffle.partitions", before)
    plan = claim_operators.claim(attempts, table.held(parts))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "SelectedBucketsCount" in plan


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = stored(spark, tmp_path / "t")
    before = files_of(table)
    assert len(before) == 8 and all(len(names) == 1 for names in before.values())
    updates = spark.createDataFrame([("f3", "h", "STORED", 1, "t1"), ("f3", "h", "FAILED", 2, "t2"), ("zz", "h", "STORED", 3, "t3"), (None, "h", "STORED", 4, "t3")],
                                    "drive_file_id string, file_hash string, status string, seq bigint, updated_at_utc string")
    touched = {f"part={part}" for part in table.touched(updates.dropna(subset=CLAIM_KEY))}
    mark_in_place(updates, table)
    after = files_of(table)
    assert {part for part in before if before[part] != after[part]} <= touched < set(before)
    rows = {r.drive_file_id: (r.status, r.updated_at_utc) for r in table.rows().collect()}
    assert len(rows) == 200 and rows["f3"] == ("FAILED", "t2") and rows["f5"] == ("CLAIMED", "t0") and "zz" not in rows


def test_claims_in_place_over_batches(spark, tmp_path):
    table, now = stored(spark, tmp_path / "t"), None
    held = table.rows().collect()
    expected_held = spark.createDataFrame(held, CLAIM)
    for number in range(3):
        attempts = spark.createDataFrame([(f"f{k}", "h", f"w{number}", number * 1000 + k) for k in range(150 + 40 * number, 190 + 40 * number)]
                                         + [("hot", "h", f"x{k}", number * 1000 + 500 + k) for k in range(50)], ATTEMPT)
        now = f"t{number}"
        expected = sorted(tuple(r) for r in claim_operators.claim(attempts, expected_held).collect())
        changed = claim_operators.claims_after(attempts, expected_held, now).collect()
        assert sorted(tuple(r) for r in claim_in_place(attempts, table, now).collect()) == expected
        keys = {tuple(r)[:2] for r in changed}
        expected_held = spark.createDataFrame([tuple(r) for r in expected_held.collect() if tuple(r)[:2] not in keys] + [tuple(r) for r in changed], CLAIM)
        assert sorted(map(tuple, table.rows().collect())) == sorted(map(tuple, expected_held.collect()))


def test_store_if_absent_repeated(spark, tmp_path):
    rows = spark.createDataFrame([(n, None if n == 7 else f"f{n % 20}", "h") for n in range(40)], "seq bigint, drive_file_id string, file_hash string")
    table = KeyedTable(spark, str(tmp_path / "t"), rows.select(*CLAIM_KEY, F.col("seq").alias("id")).schema, CLAIM_KEY, 4)
    made = lambda new: new.select(*CLAIM_KEY, F.col("seq").alias("id"))
    first = {r.seq: r.append_status for r in store_if_absent(rows, table, made).collect()}
    assert first == {n: "missing_key" if n == 7 else "appended" if n < 20 or n == 27 else "skipped_duplicate" for n in range(40)}
    again = {r.append_status for r in store_if_absent(rows, table, made).collect()}
    assert again == {"skipped_duplicate", "missing_key"} and table.rows().count() == 20


def test_layout_is_checked_and_survives_sessions(spark, tmp_path):
    table = stored(spark, tmp_path / "t")
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "t"), table.schema, CLAIM_KEY, 5)
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "t"), table.schema, ["file_hash"])
    spark.sql(f"DROP TABLE {table.name}")  # as for another application: the files stay
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "5")
    again = KeyedTable(other, str(tmp_path / "t"), table.schema, CLAIM_KEY)
    assert again.buckets == 8 and again.rows().count() == 200
    attempts = other.createDataFrame([("f3", "h", "w", 1), ("f4", "h", "w", 2)], ATTEMPT)
    assert {r.drive_file_id: r.claim_status for r in claim_in_place(attempts, again, "t9").collect()} == {"f3": "already_claimed", "f4": "claimed"}


def test_compaction(spark, tmp_path):
    table = stored(spark, tmp_path / "t", count=20, buckets=2)
    for number in range(5):
        table.append(spark.createDataFrame([(f"n{number}-{k}", "h", "CLAIMED", "w", "t", "t") for k in range(10)], CLAIM))
    rows = sorted(map(tuple, table.rows().collect()))
    assert table.compact() == [0, 1] and table.compact() == []
    assert all(len(names) == 1 for names in files_of(table).values()) and sorted(map(tuple, table.rows().collect())) == rows


def test_odd_batches(spark, tmp_path):
    table = stored(spark, tmp_path / "t", count=3)
    empty = spark.createDataFrame([], ATTEMPT)
    assert claim_in_place(empty, table, "t1").collect() == [] and table.rows().count() == 3
    fresh = KeyedTable(spark, str(tmp_path / "none"), table.schema, CLAIM_KEY, 4)
    assert fresh.rows().collect() == [] and claim_in_place(spark.createDataFrame([("a", "h", "w", 1)], ATTEMPT), fresh, "t1").first()["claim_status"] == "claimed"
    assert fresh.rows().count() == 1
