"""Reading inbox listings, logs, queues, golden sets and ledgers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.rules import ALLOWED_MIME
from docledger.schemas import DEAD_LETTER, GOLDEN_FILE, LEDGER, REVIEW_ITEM
from docledger.sources.listing import list_files

# File endings of the accepted types, and endings that only mark compression.
MIME_BY_ENDING = {
    "pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg",
    "png": "image/png",
}
COMPRESSION = r"\.(gz|Z|bz2|xz|br)$"


def base_name(key: Column) -> Column:
    return F.regexp_extract(key, r"([^/]*)$", 1)


def mime_type(key: Column) -> Column:
    """Type guessed from the ending; a name that starts with its only dot has no ending."""
    stem = F.regexp_replace(base_name(key), COMPRESSION, "")
    ending = F.lower(F.regexp_extract(stem, r"^\.*[^.].*\.([^.]+)$", 1))
    types = F.create_map(*[F.lit(part) for pair in MIME_BY_ENDING.items() for part in pair])
    return F.coalesce(F.try_element_at(types, ending), F.lit("application/octet-stream"))


def accept_files(listing: DataFrame, allowed: list[str] = ALLOWED_MIME) -> DataFrame:
    """Listed objects (id, size, last_modified) of the allowed types, without folder entries."""
    return (
        listing.where((F.col("id") != "") & ~F.col("id").endswith("/"))
        .withColumn("mime_type", mime_type(F.col("id")))
        .where(F.col("mime_type").isin(allowed))
        .select("id", base_name(F.col("id")).alias("name"), "mime_type", "size", "last_modified")
    )


def scan_inbox(spark: SparkSession, path: str, allowed: list[str] = ALLOWED_MIME, prefix: str = "") -> DataFrame:
    """Files below a folder, or below one of its folders, listed by the executors; ids are paths from the first."""
    return accept_files(list_files(spark, path, prefix), allowed)


def _read_or_empty(spark: SparkSession, read, schema: T.StructType) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_event_log(
    spark: SparkSession, path: str, schema: T.StructType = DEAD_LETTER, status: str | None = None
) -> DataFrame:
    """One JSON object per line; a malformed line is an error, a missing log is empty."""
    log = _read_or_empty(
        spark, lambda: spark.read.schema(schema).option("mode", "FAILFAST").json(path), schema
    )
    return log.where(F.col("status") == status) if status else log


def read_review_queue(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Review items from JSON files, malformed ones left out, in no order; see `in_file_order`."""
    def read() -> DataFrame:
        reader = spark.read.schema(REVIEW_ITEM).option("mode", "DROPMALFORMED")
        if one_per_file:
            reader = reader.option("multiLine", "true").option("pathGlobFilter", "*.json")
        return reader.json(path).select("*", F.col("_metadata.file_path").alias("_record_path"))

    schema = T.StructType([*REVIEW_ITEM.fields, T.StructField("_record_path", T.StringType())])
    return _read_or_empty(spark, read, schema)


def in_file_order(queue: DataFrame) -> DataFrame:
    """Review items as `read_review_queue` gives them, by file name, for those who show them."""
    return queue.orderBy("_record_path", "document_id")


def read_review_table(queue: DataFrame) -> DataFrame:
    """Review items of a table, oldest first."""
    return queue.orderBy("created_at_utc", "document_id")


def read_golden(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Golden cases from objects with a ``cases`` list; a missing or empty list is an error."""
    reader = spark.read.schema(GOLDEN_FILE).option("mode", "FAILFAST")
    if one_per_file:
        reader = reader.option("multiLine", "true")
    filled = F.when(F.size("cases") > 0, F.col("cases")).otherwise(
        F.raise_error(F.lit("Dataset JSON requires a non-empty 'cases' array.")).cast("array<variant>")
    )
    case = F.col("_case")
    return reader.json(path).select(F.explode(filled).alias("_case")).select(
        F.try_variant_get(case, "$.id", "string").alias("id"),
        F.try_variant_get(case, "$.file_path", "string").alias("file_path"),
        F.try_variant_get(case, "$.expected", "variant").alias("expected"),
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger table, partitioned by month of processing."""
    schema = T.StructType([*LEDGER.fields, T.StructField("processing_month", T.StringType())])
    return _read_or_empty(spark, lambda: spark.read.schema(schema).parquet(path), schema)


def read_ledger_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A ledger kept in a database, JSON columns as text. Pass partition options for large tables."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
