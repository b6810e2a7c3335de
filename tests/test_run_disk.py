"""What a run of documents writes and moves, and that it still appends what it should."""

from __future__ import annotations

import json
import os
import time

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from docledger.functions.text import packed, unpacked
from docledger.plans.report_queries import as_files
from docledger.sources.sinks import append_if_absent
from docledger.streaming import jobs

ATTEMPT = "document_id string, drive_file_id string, file_hash string, seq bigint, prompt_kind string, provider string, raw_text string, ocr_text string, error string"


def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")


def record(number):
    return json.dumps({"vendor": f"V{number}", "invoice_no": f"I{number}", "subtotal": 5, "tax": 0, "total": 5, "confidence": 0.9, "date": "2024-01-01"})


def test_packed_texts_come_back_and_stay_apart(spark):
    texts = ["", None, "00", "0", "abcd", "ABCD", "abc", "xyz", "é", "ab cd", "\x01", "a" * 64, "\x00"]
    df = spark.createDataFrame([(n, text) for n, text in enumerate(texts)], "n int, t string")
    rows = df.select("t", packed(F.col("t")).alias("p"), unpacked(packed(F.col("t"))).alias("u")).collect()
    assert all(row.t == row.u for row in rows) and len({row.p and bytes(row.p) for row in rows}) == len(texts)
    assert len(next(row.p for row in rows if row.t == "a" * 64)) == 33


def test_nothing_is_moved_for_claims_that_are_not_there(spark, tmp_path):
    wanted = spark.range(100).select(F.col("id").cast("string").alias("drive_file_id"), F.lit("h").alias("file_hash"))
    held = jobs.current_claims(spark, str(tmp_path / "none"), 0, wanted)
    assert held.count() == 0 and "Exchange" not in held._jdf.queryExecution().executedPlan().toString()


def test_appends_that_keep_no_keys_move_none(spark):
    rows = spark.range(100).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("drive_file_id"), F.lit("h").alias("file_hash"))
    status = append_if_absent(rows, rows.limit(0).drop("seq")).select("seq", "append_status")
    joined = status._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter", 1)
    moved = joined[1].split("\n")[1]
    assert "Project" in moved and "_no_key" in moved and "AS file_hash" not in moved


def test_only_free_keys_are_appended(spark, tmp_path):
    """Keys that are in the ledger, come twice, or are missing stay out; the others' records are whole."""
    hashes = ["a" * 64, "b", "b", None, "", "A" * 64, "c"]
    rows = spark.createDataFrame([(f"d{n}", f"f{n // 3 if h == 'b' else n}", h, n, record(n), None, "mistral", None, None) for n, h in enumerate(hashes)],
                                 "document_id string, drive_file_id string, file_hash string, seq bigint, raw_text string, ocr_text string, provider string, error_code string, error_message string")
    spark.createDataFrame([("f6", "c"), ("f5", "a" * 64)], jobs.KEYS).write.parquet(f"{tmp_path}/ledger/batch=0")
    routed = jobs.route(jobs.validate_and_score(jobs.coerce(jobs.with_parse_errors(rows), "2026-01-01")))
    jobs.write_sinks(routed, str(tmp_path), 1, now())
    left_out = {r._seq: r.append_status for r in spark.read.parquet(f"{tmp_path}/not_appended").collect()}
    assert left_out == {2: "skipped_duplicate", 3: "missing_key", 4: "missing_key", 6: "skipped_duplicate"}
    ledger = spark.read.parquet(f"{tmp_path}/ledger/batch=1").collect()
    assert {(r.id, r.file_hash, json.loads(r.record_json)["vendor_name"]) for r in ledger} == {(n, hashes[n], f"V{n}") for n in (0, 1, 5)}


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(place).getName() for place in range(files.size())]
    return {name.split("_")[1] for name in names if name.startswith("shuffle_")}


def test_a_run_keeps_no_copy_of_its_attempts(spark, tmp_path):
    """Two micro-batches; the second brings one stored document and one failed one again."""
    def attempts(ids, start):
        return spark.createDataFrame(
            [(f"{start}-{n}", f"f{n}", f"{n:064x}", start + n, "first", "mistral", "nothing" if n % 5 == 0 else record(n), None, None) for n in ids], ATTEMPT)

    folder, before = str(tmp_path), shuffles(spark)
    for ids, start in ((range(20), 0), ([5, 6], 100)):
        as_files(attempts(ids, start), f"{folder}/in")
        stream = jobs.ingest_stream(spark, f"{folder}/in", ATTEMPT)
        jobs.run_documents(stream, folder, f"{folder}/cp", "2026-01-01", now(), "me", "2026-01-01", "archive").awaitTermination()
    until = time.time() + 20
    while len(shuffles(spark) - before) > 3 and time.time() < until:
        time.sleep(0.5)
    assert len(shuffles(spark) - before) <= 3 and spark.conf.get(jobs.DROP_SHUFFLES, "false") == "false"
    assert all(name.endswith(".json.gz") for name in os.listdir(f"{folder}/in") if name.startswith("part"))
    assert not os.path.exists(f"{folder}/attempts")
    for sink in ("claim_results", "routed", "ledger", "claims"):
        files = [os.path.join(at, name) for at, _, names in os.walk(f"{folder}/{sink}") for name in names if name.endswith(".parquet")]
        read = [pq.ParquetFile(name) for name in files]
        packs = {f.metadata.row_group(0).column(0).compression for f in read if f.metadata.num_row_groups}
        assert packs == {"ZSTD"}, sink
    results = spark.read.parquet(f"{folder}/claim_results")
    assert {(r.document_id, r.claim_status, r.file_hash) for r in results.where("batch = 1").collect()} == {
        ("100-5", "claimed", f"{5:064x}"), ("100-6", "already_processed", f"{6:064x}")}
    claims = {r.drive_file_id: (r.status, r.file_hash) for r in jobs.current_claims(spark, f"{folder}/claims", 9).collect()}
    assert claims == {f"f{n}": ("FAILED" if n % 5 == 0 else "ARCHIVED", f"{n:064x}") for n in range(20)}
    assert spark.read.parquet(f"{folder}/ledger").count() == 16
