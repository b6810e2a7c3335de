"""Incremental runs with Structured Streaming.

Each job handles the files that are new since the last run and stops. State and results lie in
folders named after the micro-batch; a repeated micro-batch reads only earlier folders and
overwrites its own, so every file counts once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docledger.functions.text import packed, unpacked
from docledger.operators import claims as claim_operators
from docledger.operators.extraction import resolve_payload, with_parse_errors
from docledger.operators.normalize import coerce
from docledger.operators.reports import metric_counters
from docledger.operators.route import dead_letter_rows, ledger_rows, review_rows, route, run_counters
from docledger.operators.validate import validate_and_score
from docledger.operators.views import mean, records_flat
from docledger.schemas import CLAIM_KEY, LEDGER
from docledger.sources.sinks import append_if_absent, archive_manifest

CLAIMS = "drive_file_id string, file_hash string, status string, owner_id string, claimed_at_utc string, updated_at_utc string"
KEYS = "drive_file_id string, file_hash string"
#: Micro-batches after which the claims are written as a whole, so that a later one reads few changes.
SNAPSHOT_EVERY = 32
#: Shuffle files go when the query that made them has ended, not when the driver's memory is next collected.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ingest_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int | None = None
) -> DataFrame:
    """Unseen JSON-lines files of a folder; by default all that are there make one micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def ledger_stream(spark: SparkSession, path: str) -> DataFrame:
    """Unseen files of a ledger as `write_ledger` leaves them, or of a folder of ledger rows; nothing is copied for the stream."""
    return spark.readStream.schema(LEDGER).option("recursiveFileLookup", "true").parquet(path)


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(batch_folder(path, batch_id))


def narrow(df: DataFrame) -> DataFrame:
    """Hashes packed, for rows that are moved; `wide` undoes it."""
    return df.withColumn("file_hash", packed(F.col("file_hash")))


def wide(df: DataFrame) -> DataFrame:
    return df.withColumn("file_hash", unpacked(F.col("file_hash")))


def read_before(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """Rows of the earlier micro-batches, with their ``batch``."""
    typed = schema + ", batch bigint"
    try:
        return spark.read.schema(typed).parquet(path).where(F.col("batch") < batch_id)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], typed).limit(0)  # known to be empty, so that joins with it move nothing


def current_claims(spark: SparkSession, path: str, batch_id: int, wanted: DataFrame | None = None) -> DataFrame:
    """The last row of each claim before a micro-batch, or only of the keys in ``wanted``.

    Reads the last snapshot and the changes since; keys that aren't wanted are left out before anything is grouped.
    """
    snapshots = read_before(spark, f"{path}-whole", batch_id, CLAIMS)
    upto = snapshots.agg(F.max("batch")).first()[0]
    rows = read_before(spark, path, batch_id, CLAIMS)
    if upto is not None:
        rows = rows.where(F.col("batch") > upto).unionByName(snapshots.where(F.col("batch") == upto))
    rows = narrow(rows)
    if wanted is not None:
        rows = rows.join(narrow(wanted.select(*CLAIM_KEY)).distinct(), CLAIM_KEY, "left_semi")
    fields = ["status", "owner_id", "claimed_at_utc", "updated_at_utc"]
    last = rows.groupBy(*CLAIM_KEY).agg(F.max(F.struct("batch", *fields)).alias("_last"))
    return wide(last.select(*CLAIM_KEY, *[F.col(f"_last.{name}").alias(name) for name in fields]))


def write_claims(changed: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch's changes; every `SNAPSHOT_EVERY` micro-batches also all claims as one snapshot."""
    write_batch(changed, path, batch_id)
    if batch_id % SNAPSHOT_EVERY == SNAPSHOT_EVERY - 1:
        write_batch(current_claims(changed.sparkSession, path, batch_id + 1), f"{path}-whole", batch_id)


def claim_stream(
    stream: DataFrame, claims_path: str, results_path: str, checkpoint: str, now: str
) -> StreamingQuery:
    """Claim documents as attempts arrive; changed claims and results go to batch folders."""
    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        attempts = batch.persist()
        held = current_claims(spark, claims_path, batch_id, attempts)
        write_batch(claim_operators.claim(attempts, held), results_path, batch_id)
        write_claims(claim_operators.claims_after(attempts, held, now), claims_path, batch_id)
        attempts.unpersist()

    return _start(stream.writeStream.foreachBatch(process), checkpoint)


def seed_claims(claims: DataFrame, path: str) -> None:
    """Existing claims as the state before the first micro-batch."""
    write_batch(claims, path, -1)


def first_claims_stream(stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Only the first attempt per key, where "first wins" is all that is needed."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(CLAIM_KEY)


def routed_sinks(
    stream: DataFrame, folder: str, checkpoint: str, as_of: str, processed_at: Column
) -> StreamingQuery:
    """Normalise, validate and route documents; write ledger, review queue, dead letters, counters.

    ``stream``: document_id, key, seq, raw_text, ocr_text, provider, error_code, error_message. The
    routed documents are written once per micro-batch and every sink reads that table.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        outcome = route(validate_and_score(coerce(with_parse_errors(batch), as_of)))
        write_batch(outcome, f"{folder}/routed", batch_id)
        routed = spark.read.parquet(batch_folder(f"{folder}/routed", batch_id))
        write_sinks(routed, folder, batch_id, processed_at)
        write_batch(run_counters(routed), f"{folder}/counters", batch_id)

    return _start(stream.writeStream.foreachBatch(process), checkpoint)


def write_sinks(routed: DataFrame, folder: str, batch_id: int, processed_at: Column) -> None:
    """Ledger, review queue and dead letters of a micro-batch's routed documents, whose ``seq`` is unique over
    all batches: it becomes the id of a ledger row and the place of a dead letter in the log.

    Keys alone decide what is appended; the records are moved only if some of them stay out.
    """
    spark = routed.sparkSession
    stored = routed.where(F.col("route") == "STORED")
    keys = stored.select(*CLAIM_KEY, "seq")
    earlier = narrow(read_before(spark, f"{folder}/ledger", batch_id, KEYS))
    known = wide(earlier.join(narrow(keys.select(*CLAIM_KEY)).distinct(), CLAIM_KEY, "left_semi"))
    left_out = append_if_absent(keys, known).where(F.col("append_status") != "appended").select(F.col("seq").alias("_seq"), "append_status")
    write_batch(left_out, f"{folder}/not_appended", batch_id)
    left_out = spark.read.schema(left_out.schema).parquet(batch_folder(f"{folder}/not_appended", batch_id))
    if not left_out.isEmpty():
        stored = stored.join(left_out, F.col("seq").eqNullSafe(F.col("_seq")), "left_anti")
    write_batch(ledger_rows(stored, processed_at, "seq").withColumnRenamed("seq", "id"), f"{folder}/ledger", batch_id)
    write_batch(review_rows(routed, processed_at), f"{folder}/review_queue", batch_id)
    write_batch(dead_letter_rows(routed, processed_at, "seq"), f"{folder}/dead_letters", batch_id)


def run_documents(
    stream: DataFrame, folder: str, checkpoint: str, as_of: str, processed_at: Column, owner: str, now: str, archive: str | None = None
) -> StreamingQuery:
    """A whole run: claim documents, resolve their payloads, normalise, validate and route them, fill the sinks, mark the
    claims, and list the files to archive.

    ``stream``: attempts with document_id, key, seq, prompt_kind, provider, raw_text, ocr_text and error; a document's attempts
    arrive in one micro-batch and ``seq`` is unique over all. Documents whose key is taken are counted as
    SKIPPED_DUPLICATE and go no further. With ``archive`` stored files are listed under that prefix and their claims end as ARCHIVED.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spark.conf.set(DROP_SHUFFLES, "true")  # in the stream's own session; every table is written once and then read

        def kept(df: DataFrame, name: str) -> DataFrame:
            write_batch(df, f"{folder}/{name}", batch_id)
            return spark.read.schema(df.schema).parquet(batch_folder(f"{folder}/{name}", batch_id))

        arrivals = narrow(batch).groupBy("document_id", *CLAIM_KEY).agg(F.min("seq").alias("arrival")).withColumn("owner_id", F.lit(owner))
        held = kept(current_claims(spark, f"{folder}/claims", batch_id, batch), "held")
        numbered = wide(claim_operators.claim(arrivals, narrow(held), "document_id")).where(F.col("arrival").isNotNull())
        results = kept(numbered, "claim_results")
        won = narrow(results).where(F.col("claim_status") == "claimed").select("document_id", *CLAIM_KEY, F.col("arrival").alias("seq"))
        resolved = resolve_payload(batch.join(won.select("document_id"), "document_id", "left_semi"))
        routed = kept(route(validate_and_score(coerce(wide(resolved.join(won, "document_id")), as_of))), "routed")
        write_sinks(routed, folder, batch_id, processed_at)
        stored = F.col("route") == "STORED"
        done = F.when(stored & F.lit(archive is not None), F.lit("ARCHIVED")).otherwise(F.col("route"))
        marks = narrow(routed).select(*CLAIM_KEY, done.alias("status"), "seq", F.lit(now).alias("updated_at_utc"))
        taken = claim_operators.claims_after(narrow(results), narrow(held), now)
        write_claims(wide(claim_operators.merge_status(marks, taken)), f"{folder}/claims", batch_id)
        if archive is not None:
            files = routed.where(stored).select(F.col("drive_file_id").alias("id")).distinct()
            write_batch(archive_manifest(files, archive), f"{folder}/manifest", batch_id)
        skipped = results.where(F.col("claim_status") != "claimed").select(F.lit("SKIPPED_DUPLICATE").alias("route"))
        write_batch(run_counters(routed.select("route").unionByName(skipped)), f"{folder}/counters", batch_id)

    return _start(stream.writeStream.foreachBatch(process), checkpoint)


def counters_stream(events: DataFrame) -> DataFrame:
    """Running metric counters over a growing log."""
    return metric_counters(events)


def daily_stream(ledger: DataFrame, delay: str = "7 days") -> DataFrame:
    """The daily summary over a growing ledger. In update mode a day is emitted whenever it changes, and forgotten
    once it is older than the delay."""
    timed = records_flat(ledger).withColumn("processed_at_utc", F.col("processed_at_utc").cast("timestamp"))
    watched = timed.withWatermark("processed_at_utc", delay)
    day = F.window("processed_at_utc", "1 day")
    return watched.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("records_total"),
        F.count_if(F.col("row_status") == "STORED").alias("stored_total"),
        F.count_if("needs_review").alias("needs_review_total"),
        F.sum("total_amount").alias("total_amount_sum"),
        mean("model_confidence").alias("avg_model_confidence"),
        mean("validation_score").alias("avg_validation_score"),
    ).select(F.to_date("day.start").alias("processing_date"), "*").drop("day")


def changes_stream(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the days that a micro-batch changed to its own folder."""
    def process(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return _start(totals.writeStream.outputMode("update").foreachBatch(process), checkpoint)


def read_last_changes(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last row written for each key."""
    rows = spark.read.parquet(path)
    others = [name for name in rows.columns if name not in (key, "batch")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("_last"))
    return last.select(key, "_last.*")


def snapshot_stream(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the complete result after each micro-batch to its own folder."""
    def process(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return _start(totals.writeStream.outputMode("complete").foreachBatch(process), checkpoint)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The result after the last micro-batch."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")


def _start(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
