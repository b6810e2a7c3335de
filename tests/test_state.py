from __future__ import annotations

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docledger.operators import claims, evaluate, extraction, reports, review
from docledger.operators.skew import attach_per_key
from docledger.operators.validate import check_schema, read_record
from docledger.sources import readers, sinks
from docledger.streaming import jobs

CLAIMS = "drive_file_id string, file_hash string, status string, owner_id string, claimed_at_utc string, updated_at_utc string"


def test_one_of_six_workers_wins(spark):
    batch = spark.createDataFrame([("f", "h", f"w{n}", n) for n in (4, 2, 5, 1, 3, 6)],
                                  "drive_file_id string, file_hash string, owner_id string, arrival int")
    none = spark.createDataFrame([], CLAIMS)
    got = {r.arrival: (r.claim_status, r.owner_id) for r in claims.claim(batch, none).collect()}
    assert got.pop(1) == ("claimed", "w1")
    assert set(got.values()) == {("already_claimed", "w1")}


@pytest.mark.parametrize(("held", "status", "owner"), [
    ("FAILED", "claimed", "new"), ("REVIEW_REQUIRED", "claimed", "new"), ("STORED", "already_processed", "old"),
    ("ARCHIVED", "already_processed", "old"), ("CLAIMED", "already_claimed", "old"),
])
def test_claims_on_held_keys(spark, held, status, owner):
    batch = spark.createDataFrame([("f", "h", "new", 1)], "drive_file_id string, file_hash string, owner_id string, arrival int")
    table = spark.createDataFrame([("f", "h", held, "old", "t0", "t0")], CLAIMS)
    row = claims.claim(batch, table).first()
    assert (row.claim_status, row.owner_id) == (status, owner)
    after = claims.claims_after(batch, table, "t1").collect()
    assert [(r.owner_id, r.claimed_at_utc, r.updated_at_utc) for r in after] == ([("new", "t0", "t1")] if owner == "new" else [])


def test_hot_keys_keep_all_rows(spark):
    rows = spark.range(20000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    rows = rows.withColumn("key", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("key")))
    got = attach_per_key(rows, ["key"], ["id"], [F.count("*").alias("n")])
    expected = {r.key: r.n for r in rows.groupBy("key").agg(F.count("*").alias("n")).collect()}
    collected = got.collect()
    assert len(collected) == 20000 and all(r.n == expected[r.key] for r in collected)


def test_transitions(spark):
    steps = ["NEW", "claimed ", "EXTRACTED", "VALIDATED", "STORED", "ARCHIVED", "FAILED", "odd", "NEW"]
    log = spark.createDataFrame([("d", s, f"2024-01-01 {n // 2:02d}:00:00", n) for n, s in enumerate(steps)],
                                "document_id string, status string, ts string, seq int").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [r.result for r in claims.check_transitions(log).orderBy("seq").collect()]
    assert got == ["ok"] * 5 + ["Invalid transition: ARCHIVED -> FAILED", "Unknown state: odd", "Unknown state: odd"]


LETTERS = "seq int, document_id string, drive_file_id string, file_hash string, status string"


def test_replay(spark):
    letters = spark.createDataFrame([
        (1, "doc-1", "file-1", "hash-1", "FAILED"), (2, "doc-2", "file-2", "hash-2", "FAILED"),
        (3, "doc-x", None, None, "FAILED"), (4, "doc-3", "file-3", "hash-3", "REVIEW_REQUIRED"),
    ], LETTERS)
    table = spark.createDataFrame([("file-1", "hash-1", "STORED", "w", "t", "t")], CLAIMS)
    classified = claims.classify_replay(letters, table, "FAILED")
    assert claims.replay_summary(classified).first().asDict() == {"queued": 1, "skipped_processed": 1, "skipped_invalid": 1}
    assert [(r.drive_file_id, r.owner_id) for r in claims.reclaimed(classified, table, "t").collect()] == [("file-2", "replay-worker")]


def test_active_dead_letters(spark):
    columns = LETTERS + ", recorded_at_utc string"
    letters = spark.createDataFrame([
        (1, "d1", "f", "h1", "FAILED", "a"), (2, "d1", "f", "done", "FAILED", "b"), (3, "d1", "f", "h1", "QUEUED", "c"),
        (4, "", "f", "", "FAILED", "d"), (5, None, "f", None, "REVIEW_REQUIRED", "e"),
    ], columns)
    resolved = spark.createDataFrame([("done",)], "file_hash string")
    assert sorted(r.seq for r in reports.active_dead_letters(letters, resolved).collect()) == [1, 5]


def test_metrics_and_p95(spark):
    lines = ['{"metric": "a", "value": 3}', '{"metric": "a", "value": true}', '{"metric": "a", "value": 2.0}',
             '{"metric": "a", "value": "9"}', '{"value": 4}', '{"metric": "b", "value": -1}']
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    events = df.select(F.from_json("line", "metric string, value variant").alias("e")).select("e.*")
    assert {r.metric: r.value for r in reports.metric_counters(events).collect()} == {"a": 4, "b": -1}
    values = [("x", v) for v in (40, 10, 30, 20)] + [("y", 7)] + [("z", v) for v in range(1, 101)]
    p95 = reports.latency_p95(spark.createDataFrame(values, "run string, latency_ms int"))
    assert {r.run: r.latency_p95_ms for r in p95.collect()} == {"x": 30, "y": 7, "z": 95}


def attempts(spark, rows):
    return spark.createDataFrame(rows, "document_id string, prompt_kind string, provider string, raw_text string, ocr_text string, error string")


def test_payload_resolution(spark):
    good = '{"vendor_name": "A", "vendor_name": "B"}'
    df = attempts(spark, [
        ("ok", "first", "mistral", good, " page ", None),
        ("retry", "first", "mistral", "not json", None, None), ("retry", "corrective", "mistral", None, None, "down"),
        ("retry", "corrective", "groq", good, None, None),
        ("bad", "first", "mistral", "nope", None, None), ("bad", "corrective", "mistral", "[]", None, None),
        ("down", "first", "groq", None, None, "x"), ("down", "first", "mistral", None, None, "y"),
        ("alien", "first", "other", good, None, None),
    ])
    got = {r.document_id: r for r in extraction.resolve_payload(df).select(
        "*", F.try_variant_get("payload", "$.vendor_name", "string").alias("v")).drop("payload").collect()}
    assert (got["ok"].v, got["ok"].provider, got["ok"].ocr_text) == ("B", "mistral", " page ")
    assert (got["retry"].v, got["retry"].provider, got["retry"].error_code) == ("B", "groq", None)
    assert got["bad"].error_code == "invalid_json_shape"
    assert got["down"].error_message == "All configured providers failed: mistral: y; groq: x"
    assert got["alien"].error_code == "all_providers_failed"
    none = extraction.resolve_payload(df, order=[]).select("error_code").distinct().collect()
    assert [r.error_code for r in none] == ["missing_api_key"]


QUEUE = "document_id string, status string, reason_codes array<string>, created_at_utc string, resolved_at_utc string, source_file_moved_to string, resolution_note string"


def queue_of(spark, items):
    rows = [(i["document_id"], i["status"], i.get("reason_codes", []), i.get("created"), i.get("resolved"), None, i.get("note"),
             json.dumps(i.get("metadata")), json.dumps(i.get("record"))) for i in items]
    df = spark.createDataFrame(rows, QUEUE + ", m string, r string")
    return df.select(
        "document_id", "status", "reason_codes", "created_at_utc", "resolved_at_utc", "source_file_moved_to",
        F.parse_json("m").alias("metadata"), F.parse_json("r").alias("resolved_record"),
        F.lit(None).cast("variant").alias("storage_result"), "resolution_note")


RECORD = {
    "document_type": "invoice", "vendor_name": "Acme", "vendor_tax_id": None, "invoice_number": "1", "invoice_date": "2026-02-27",
    "currency": "USD", "subtotal": "100", "tax_amount": 10, "total_amount": 115.0, "model_confidence": 0.4, "validation_score": 0.4,
}


def test_review_resolution(spark):
    key = {"source_file_id": "f", "file_hash": "h"}
    queue = queue_of(spark, [
        {"document_id": "a", "status": "REVIEW_REQUIRED", "metadata": {**key, "normalized_record": RECORD}},
        {"document_id": "b", "status": "REVIEW_REQUIRED", "metadata": {**key, "normalized_record": RECORD}},
        {"document_id": "c", "status": "REJECTED", "metadata": key},
        {"document_id": "d", "status": "REVIEW_REQUIRED", "metadata": key},
        {"document_id": "e", "status": "REVIEW_REQUIRED", "metadata": {"normalized_record": {**RECORD, "total_amount": -1}}},
    ])
    asked = spark.createDataFrame([(d, None, "n") for d in "abcdex"], "document_id string, o string, note string").select(
        "document_id", F.try_parse_json("o").alias("record_override"), "note")
    ledger = spark.createDataFrame([], "drive_file_id string, file_hash string")
    done = {r.document_id: r for r in review.approve(asked, queue, ledger, "now").collect()}
    assert done["a"].resolution_status == "RESOLVED_STORED" and done["a"].validation_score == 0.6667
    assert done["b"].resolution_status == "RESOLVED_DUPLICATE"
    assert [done[d].refused for d in "cdex"] == ["not_active", "no_record", "schema: total_amount: greater_than_equal", "not_found"]
    merged = review.merge_resolution(review.approve(asked, queue, ledger, "now").where("refused is null"), queue)
    states = {r.document_id: (r.status, r.resolution_note) for r in merged.drop("metadata", "resolved_record", "storage_result").collect()}
    assert states["a"] == ("RESOLVED_STORED", "n") and states["c"] == ("REJECTED", None)


def test_schema_of_given_records(spark):
    changes = [{}, {"invoice_date": "02/27/2026"}, {"currency": "usd"}, {"total_amount": -1.0}, {"vendor_name": 5},
               {"subtotal": "abc"}, {"line_items": [{"description": "", "quantity": 0, "unit_price": 1, "line_total": "2"}, 7]},
               {"payment_method": "coin"}, {"vendor_name": None}, {"due_date": None}]
    df = spark.createDataFrame([(n, json.dumps({**RECORD, **c})) for n, c in enumerate(changes)], "n int, r string")
    checked = check_schema(read_record(df.select("n", F.parse_json("r").alias("record")))).orderBy("n")
    got = [[(e.loc, e.type) for e in r.schema_errors] for r in checked.select("schema_errors").collect()]
    assert got[0] == [] and got[9] == []
    assert got[1] == [("invoice_date", "date_parsing")] and got[2] == [("currency", "string_pattern_mismatch")]
    assert got[3] == [("total_amount", "greater_than_equal")] and got[4] == [("vendor_name", "string_type")]
    assert got[5] == [("subtotal", "float_parsing")] and got[7] == [("payment_method", "literal_error")]
    assert got[8] == [("vendor_name", "string_type")]
    assert ("line_items.0.quantity", "greater_than") in got[6] and ("line_items.1", "model_type") in got[6]


def test_feed_and_history(spark):
    queue = queue_of(spark, [
        {"document_id": "q1", "status": "REVIEW_REQUIRED", "created": "2026-01-01T00:05", "metadata": {"file_hash": ""}},
        {"document_id": "q2", "status": "RESOLVED_STORED", "created": "2026-01-01T00:00", "resolved": "2026-01-01T00:10", "note": "",
         "metadata": {}, "record": {"vendor_name": "V", "total_amount": 5}},
        {"document_id": "q3", "status": "REJECTED", "created": "2026-01-01T00:07", "metadata": {"vendor_name": "M"}},
    ])
    assert [r.document_id for r in review.history(queue, 1).collect()] == ["q2"]
    active = review.active_items(queue, spark.createDataFrame([("",)], "file_hash string"))
    recent = spark.createDataFrame([("2026-01-01T00:01", "s", "f", "V", "1", "USD", 1.0, "p", True)],
                                   "processed_at_utc string, document_id string, drive_file_id string, vendor_name string, invoice_number string, currency string, total_amount double, used_provider string, needs_review boolean")
    dead = spark.createDataFrame([("2026-01-01T00:20", "x", "f", "FAILED", None, "code", None), ("2026-01-02", "y", "f", "REVIEW_REQUIRED", None, None, None)],
                                 "recorded_at_utc string, document_id string, drive_file_id string, status string, error_message string, error_code string, used_provider string")
    feed = reports.activity_feed(recent, active, review.history_items(queue), dead, 10).collect()
    assert [(r.document_id, r.message) for r in feed] == [
        ("x", "code"), ("q2", "Review decision recorded"), ("q3", "Review decision recorded"), ("q1", "routed to review"),
        ("s", "Stored with needs_review flag")]


def cases(spark, rows):
    df = spark.createDataFrame([(i, p, json.dumps(e)) for i, p, e in rows], "id string, file_path string, e string")
    return df.select("id", "file_path", F.parse_json("e").alias("expected"))


def test_evaluation(spark):
    documents = spark.createDataFrame([
        ("a", None, None, "mistral", json.dumps({"vendor_name": "ACME  CORP", "total_amount": 100.004, "currency": "USD",
         "line_items": [{"description": "Item A", "quantity": 1.0, "line_total": 100.0}], "due_date": None, "invoice_number": ""})),
        ("b", "bad", "m", None, "{}"),
    ], "file_path string, error_code string, error_message string, used_provider string, r string").withColumn("record", F.parse_json("r")).drop("r")
    golden = cases(spark, [
        ("1", " a ", {"vendor_name": " acme corp", "total_amount": "100.0", "currency": "usd", "due_date": None, "invoice_number": "x"}),
        ("2", "a", {"line_items": [{"description": "item a", "quantity": 1, "line_total": 50.0}, {"description": "Item B"}]}),
        ("3", "b", {"currency": "USD"}), ("4", "c", {"currency": "USD"}), ("5", "a", {}), ("6", "a", {"line_items": "x"}),
    ])
    gated = evaluate.gate_cases(golden, documents)
    fields = evaluate.field_results(gated)
    rows = {(r.id, r.field): (r.matched, r.reason) for r in fields.collect()}
    assert [rows[("1", f)][0] for f in ("vendor_name", "total_amount", "currency", "due_date", "invoice_number")] == [True, True, True, True, False]
    assert rows[("2", "line_items.count")] == (False, "count mismatch")
    assert rows[("2", "line_items[0].description")][0] and rows[("2", "line_items[0].quantity")][0]
    assert rows[("2", "line_items[0].line_total")] == (False, "value mismatch")
    assert rows[("2", "line_items[1]")] == (False, "missing line item")
    assert rows[("6", "line_items")] == (False, "'line_items' must be a list")
    results = evaluate.case_results(gated)
    scores = {r.id: (r.status, r.error, r.score) for r in results.collect()}
    assert scores["1"] == ("ok", None, 0.8) and scores["2"] == ("ok", None, 0.4)
    assert [scores[i][1] for i in "345"] == ["bad", "file_not_found", "invalid_expected_payload"]
    summary = evaluate.summarize(results)
    assert summary.first().asDict() == {"cases_total": 6, "ok_total": 3, "error_total": 3, "avg_score": 0.4}
    assert evaluate.quality_gate(summary, 0.5).first().failed and not evaluate.quality_gate(summary, 0.0).first().failed
    with_fields = evaluate.case_results(gated, with_fields=True)
    report = sinks.evaluation_report(with_fields).where("id = '1'").first().report
    assert len(json.loads(report)["field_results"]) == 5


def test_equal_cases_stay_apart(spark):
    documents = spark.createDataFrame([("a", None, None, "groq", '{"currency": "USD"}')],
                                      "file_path string, error_code string, error_message string, used_provider string, r string")
    golden = cases(spark, [(None, "a", {"currency": "usd"}), (None, "a", {"currency": "usd"}), ("x", "gone", {"a": 1}), ("x", "gone", {"a": 1})])
    results = evaluate.case_results(evaluate.gate_cases(golden, documents.withColumn("record", F.parse_json("r")).drop("r")))
    assert sorted((r.id or "", r.status, r.total_fields) for r in results.collect()) == [
        ("", "ok", 1), ("", "ok", 1), ("x", "error", None), ("x", "error", None)]
    assert evaluate.summarize(results).first().cases_total == 4


def test_model_text_that_is_no_object_fails(spark, tmp_path):
    texts = ["not json", "[1, 2]", '{"vendor": "V", "invoice_no": "1", "total": 5, "confidence": 0.9, "date": "2024-01-01"}']
    rows = spark.createDataFrame([(f"d{n}", f"f{n}", "h", n, text, None, "mistral", None, None) for n, text in enumerate(texts)],
                                 "document_id string, drive_file_id string, file_hash string, seq int, raw_text string, ocr_text string, provider string, error_code string, error_message string")
    rows.write.json(str(tmp_path / "in"))
    jobs.routed_sinks(jobs.ingest_stream(spark, str(tmp_path / "in"), rows.schema), str(tmp_path), str(tmp_path / "cp"), "2026-01-01",
                      F.lit("2026-01-01").cast("timestamp")).awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "ledger")).collect()] == [2]
    dead = spark.read.parquet(str(tmp_path / "dead_letters")).orderBy("seq").collect()
    assert [(r.document_id, r.status, r.error_code) for r in dead] == [("d0", "FAILED", "invalid_json"), ("d1", "FAILED", "invalid_json_shape")]


def test_a_hot_hash_is_resolved_for_all_its_items(spark):
    queue = spark.range(500).select(
        F.concat(F.lit("d"), "id").alias("document_id"), F.lit("REVIEW_REQUIRED").alias("status"), F.array().cast("array<string>").alias("reason_codes"),
        F.lit("t").alias("created_at_utc"),
        F.when(F.col("id") % 3 == 0, F.parse_json(F.lit('{"file_hash": "hot"}'))).when(F.col("id") % 3 == 1, F.parse_json(F.lit('{"file_hash": "b"}'))).alias("metadata"))
    ledger = spark.createDataFrame([("STORED", "hot")] * 9 + [("STORED", ""), ("FAILED", "b"), ("ARCHIVED", "unasked")], "status string, file_hash string")
    resolved = reports.resolved_hashes(ledger, review.waiting_items(queue))
    assert {r.file_hash for r in resolved.collect()} == {"hot"}
    assert review.active_items(queue, resolved).count() == 333


def test_decisions_without_an_action_approve(spark):
    queue = spark.createDataFrame([("a",)], "document_id string")
    decisions = spark.createDataFrame([("a", None, None), ("a", " Reject ", None), ("b", "drop", None)], "document_id string, action string, note string")
    dismissed = review.dismiss(decisions, queue, "now").collect()
    approved = decisions.where(review.decided_action() == "approve").count()
    assert len(dismissed) + approved == 3 and {r.resolution_status for r in dismissed} == {"REJECTED", None}


def test_currency_display(spark):
    totals = spark.createDataFrame([("USD", 1234.5), ("EUR", 1.0)], "currency string, total_amount_sum double")
    shown = [reports.currency_display(df).first()[0] for df in (totals, totals.limit(1), totals.limit(0))]
    assert shown == ["2 currencies", "USD 1,234.50", "0"]


def test_files(spark, tmp_path):
    inbox = tmp_path / "inbox" / "sub"
    inbox.mkdir(parents=True)
    for name in ("a.PDF", "b.txt", "c.jpe", "d.pdf.gz", ".pdf", "e.png", "noend"):
        (inbox / name).write_bytes(b"%PDF")
    found = readers.scan_inbox(spark, str(tmp_path / "inbox"))
    assert sorted(r.name for r in found.collect()) == ["a.PDF", "c.jpe", "d.pdf.gz", "e.png"]
    log = tmp_path / "log.jsonl"
    log.write_text('{"document_id":"a","status":"FAILED"}\n\n{"document_id":"b","status":"OPEN"}\n')
    assert [r.document_id for r in readers.read_event_log(spark, str(log), status="FAILED").collect()] == ["a"]
    assert readers.read_event_log(spark, str(tmp_path / "none")).count() == 0
    log.write_text("{broken\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_event_log(spark, str(log)).collect()
    queue = tmp_path / "queue"
    queue.mkdir()
    (queue / "b.json").write_text(json.dumps({"document_id": "b", "status": "X", "metadata": {"k": 1}}, indent=1))
    (queue / "a.json").write_text(json.dumps({"document_id": "a"}))
    (queue / "c.json").write_text("{oops")
    (queue / "d.txt").write_text("{}")
    items = readers.read_review_queue(spark, str(queue))
    assert "Exchange" not in items._jdf.queryExecution().executedPlan().toString()
    assert [r.document_id for r in readers.in_file_order(items).select("document_id").collect()] == ["a", "b"]
    golden = tmp_path / "golden.json"
    golden.write_text(json.dumps({"cases": [{"id": "1", "file_path": "p", "expected": {"a": 1}}]}, indent=1))
    assert readers.read_golden(spark, str(golden)).select("id", "file_path").first() == ("1", "p")
    golden.write_text(json.dumps({"cases": []}))
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_golden(spark, str(golden)).collect()


def test_claims_survive_a_repeated_batch(spark, tmp_path):
    path = str(tmp_path / "claims")
    first = spark.createDataFrame([("f", "h", "CLAIMED", "w", "t", "t")], CLAIMS)
    jobs.write_batch(first, path, 0)
    jobs.write_batch(first.withColumn("status", F.lit("STORED")), path, 1)
    assert jobs.current_claims(spark, path, 1).first().status == "CLAIMED"
    jobs.write_batch(first.withColumn("status", F.lit("STORED")), path, 1)
    assert jobs.current_claims(spark, path, 2).collect()[0].status == "STORED"


def test_insert_if_absent_with_a_hot_key(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), F.col("id") % 50)).alias("drive_file_id"),
        F.lit("h").alias("file_hash"))
    ledger = spark.createDataFrame([("f1", "h"), ("f1", "h")], "drive_file_id string, file_hash string")
    got = sinks.append_if_absent(rows, ledger)
    counts = {r.append_status: r["count"] for r in got.groupBy("append_status").count().collect()}
    assert counts == {"appended": 50, "skipped_duplicate": 2950}


def test_first_claims_and_compaction(spark, tmp_path):
    rows = spark.createDataFrame([("f", "h", f"2024-01-01 00:0{n}:00", n) for n in range(4)] + [("g", "h", "2024-01-01 00:09:00", 9)],
                                 "drive_file_id string, file_hash string, at string, n int").withColumn("at", F.col("at").cast("timestamp"))
    rows.repartition(3).write.json(str(tmp_path / "in"))
    stream = jobs.first_claims_stream(jobs.ingest_stream(spark, str(tmp_path / "in"), rows.schema, 1), "at", "1 hour")
    started = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
               .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    assert started.awaitTermination(120)
    assert sorted(r.drive_file_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["f", "g"]
    claims_path = str(tmp_path / "claims")
    one = spark.createDataFrame([("f", "h", "CLAIMED", "w", "t", "t")], CLAIMS)
    jobs.seed_claims(one, claims_path)
    jobs.write_batch(one.withColumn("status", F.lit("STORED")), claims_path, 0)
    last = jobs.SNAPSHOT_EVERY - 1
    jobs.write_claims(one.withColumn("file_hash", F.lit("k")), claims_path, last)
    assert jobs.read_before(spark, f"{claims_path}-whole", last + 1, CLAIMS).count() == 2
    jobs.write_claims(one.withColumn("status", F.lit("FAILED")), claims_path, last + 1)
    held = {r.file_hash: r.status for r in jobs.current_claims(spark, claims_path, last + 2).collect()}
    assert held == {"h": "FAILED", "k": "CLAIMED"}
    assert jobs.current_claims(spark, claims_path, last + 2, one.limit(0)).count() == 0


def test_routed_sinks_store_a_repeated_key_once(spark, tmp_path):
    payload = json.dumps({"vendor": "V", "invoice_no": "1", "total": 5, "confidence": 0.9, "date": "2024-01-01"})
    rows = spark.createDataFrame([(f"d{n}", "f", "h", n, payload, None, "mistral", None, None) for n in range(3)],
                                 "document_id string, drive_file_id string, file_hash string, seq int, raw_text string, ocr_text string, provider string, error_code string, error_message string")
    rows.repartition(3).write.json(str(tmp_path / "in"))
    stream = jobs.ingest_stream(spark, str(tmp_path / "in"), rows.schema, 2)
    started = jobs.routed_sinks(stream, str(tmp_path), str(tmp_path / "cp"), "2026-01-01", F.lit("2026-01-01").cast("timestamp"))
    assert started.awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 1


def test_views_in_sql(spark):
    from docledger.operators.views import register_views

    record = {"vendor_name": "V", "total_amount": 1.5, "needs_review": True, "line_items": [{"description": "a", "quantity": 2}]}
    rows = [(1, "f", "h", "STORED", json.dumps(record), '{"document_id": "d"}'), (2, "g", "h", "ARCHIVED", "{}", "{}")]
    ledger = spark.createDataFrame(rows, "id long, drive_file_id string, file_hash string, status string, record_json string, metadata_json string")
    register_views(ledger.withColumn("processed_at_utc", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")))
    assert spark.sql("select records_total, stored_total, needs_review_total, total_amount_sum from ledger_daily_summary").first()[:3] == (2, 1, 1)
    assert spark.sql("select line_no, description from ledger_line_items_flat").collect() == [(1, "a")]
    bad = ledger.withColumn("record_json", F.lit('{"total_amount": "x"}')).withColumn("processed_at_utc", F.lit("2024-01-01").cast("timestamp_ntz"))
    register_views(bad)
    with pytest.raises(PySparkException):
        spark.sql("select sum(total_amount) from ledger_records_flat").collect()


def test_archive_collisions(spark):
    files = spark.createDataFrame([("in/a/x.pdf",), ("in/b/x.pdf",), ("in/y.pdf",)], "id string")
    got = {r.source: (r.destination, r.collision) for r in sinks.archive_manifest(files, "archive//").collect()}
    assert got == {"in/a/x.pdf": ("archive/x.pdf", True), "in/b/x.pdf": ("archive/x.pdf", True), "in/y.pdf": ("archive/y.pdf", False)}
