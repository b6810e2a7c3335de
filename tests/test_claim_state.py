from __future__ import annotations

import random
import time

import pandas as pd

from docledger.operators.claims import claim, claims_after, merge_status
from docledger.schemas import CLAIM_KEY
from docledger.streaming import claim_state, jobs

ATTEMPT = "drive_file_id string, file_hash string, owner_id string, arrival bigint, status string"
HELD = "drive_file_id string, file_hash string, status string, owner_id string, claimed_at_utc string, updated_at_utc string"


def batches_of(spark, tmp_path, batches, held=None, ttl_ms=None, wait=0.0):
    """Results of each batch, run after one another against the same state."""
    found = []
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, ATTEMPT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = jobs.ingest_stream(spark, str(tmp_path / "in"), ATTEMPT)
        query = claim_state.claim_results_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), held, ttl_ms)
        query.awaitTermination()
        every = spark.read.parquet(str(tmp_path / "out")).collect()
        done = {tuple(row) for batch in found for row in batch}
        found.append(sorted(tuple(row)[:5] for row in every if tuple(row)[:5] not in done))
        time.sleep(wait)
    return found


def test_equals_the_batch_operator(spark, tmp_path):
    rng = random.Random(3)
    held_rows = [(f"f{k}", "h", rng.choice(["STORED", "ARCHIVED", "FAILED", "REVIEW_REQUIRED", "CLAIMED"]), "old", "t0", "t0") for k in range(0, 40, 2)]
    held = spark.createDataFrame(held_rows, HELD)
    arrivals = iter(rng.sample(range(10_000), 600))
    batches = [[(f"f{rng.choice([3, rng.randrange(60)])}", "h", f"w{n % 5}", next(arrivals), None) for n in range(150)] for _ in range(3)]
    got = batches_of(spark, tmp_path, batches, held)
    now = held
    for rows, results in zip(batches, got):
        attempts = spark.createDataFrame(rows, ATTEMPT)
        expected = claim(attempts, now).select(*CLAIM_KEY, "arrival", "claim_status", "owner_id")
        assert results == sorted(tuple(row) for row in expected.collect())
        changed = claims_after(attempts, now, "t1").collect()
        keys = {tuple(row)[:2] for row in changed}
        now = spark.createDataFrame([tuple(r) for r in now.collect() if tuple(r)[:2] not in keys] + [tuple(r) for r in changed], HELD)


def test_marks_open_and_close_claims(spark, tmp_path):
    batches = [
        [("a", "h", "w1", 1, None), ("b", "h", "w1", 2, None), (None, "h", "w1", 3, None)],
        [("a", "h", None, 10, "STORED"), ("b", "h", None, 11, "STORED"), ("b", "h", None, 12, "FAILED"), ("zz", "h", None, 13, "STORED")],
        [("a", "h", "w2", 20, None), ("b", "h", "w2", 21, None), ("zz", "h", "w2", 22, None)],
    ]
    first, marks, last = batches_of(spark, tmp_path, batches)
    assert first == [("a", "h", 1, "claimed", "w1"), ("b", "h", 2, "claimed", "w1")] and marks == []
    assert last == [("a", "h", 20, "already_processed", "w1"), ("b", "h", 21, "claimed", "w2"), ("zz", "h", 22, "claimed", "w2")]
    held = spark.createDataFrame([("b", "h", "CLAIMED", "w1", "t", "t")], HELD)
    marked = merge_status(spark.createDataFrame(batches[1], ATTEMPT).withColumnsRenamed({"arrival": "seq"}).withColumn("updated_at_utc", jobs.F.lit("t")), held)
    assert marked.first()["status"] == "FAILED"


def test_state_expires(spark, tmp_path):
    """A claim that nobody finished is free again after its time to live, and not before."""
    batches = [[("a", "h", f"w{n}", n, None), ("b", "h", f"w{n}", n + 100, None)] for n in range(2)]
    assert [row[3] for row in batches_of(spark, tmp_path / "long", batches, ttl_ms=3_600_000)[1]] == ["already_claimed"] * 2
    assert [row[3:] for row in batches_of(spark, tmp_path / "short", batches, ttl_ms=500, wait=1.0)[1]] == [("claimed", "w1")] * 2


def test_settings_come_back(spark):
    before = {name: spark.conf.get(name, None) for name in claim_state.STATE_STORE}
    with claim_state.state_store(spark):
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")
    assert {name: spark.conf.get(name, None) for name in claim_state.STATE_STORE} == before


def test_state_is_called_per_slot_and_not_per_key():
    """A thousand keys of one slot cost two calls to the state store, and outdated entries do not pile up."""
    calls, state = [], []

    class Listed:
        def get(self):
            calls.append("get")
            return iter(list(state))

        def appendList(self, rows):  # noqa: N802
            calls.append("appendList")
            state.extend(rows)

        def put(self, rows):
            calls.append("put")
            state[:] = rows

    processor = claim_state.ClaimState()
    processor.claims = Listed()
    for batch in range(6):
        frame = pd.DataFrame({
            "drive_file_id": [f"f{n}" for n in range(1000)], "file_hash": "h", "owner_id": f"w{batch}",
            "arrival": range(batch * 1000, batch * 1000 + 1000), "status": None if batch % 2 == 0 else "FAILED",
        })
        rows = [row for part in processor.handleInputRows((1,), iter([frame]), None) for row in part.itertuples(index=False)]
        assert {row.claim_status for row in rows} == ({"claimed"} if batch % 2 == 0 else set())
        assert len(calls) == 2 and len(state) <= 2000
        calls.clear()
    assert {tuple(row[2:]) for row in state[-1000:]} == {("FAILED", "w4")}
