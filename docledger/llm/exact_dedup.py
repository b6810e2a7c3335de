"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest, one row for each distinct text seen so far. A batch
is reduced to its distinct digests, those already indexed are removed by a sort-merge anti-join (the
index side is read by bucket, without a shuffle), and the rest is appended by bucket.

Defined results: a null text counts as empty. Texts are equal when they are identical after each run of
ASCII white space is replaced by one space. A null doc_id is larger than any other. Rows that repeat both
doc_id and text are one document given several times: each is returned, one at most is kept. An empty batch
gives no rows. Other columns are neither read nor returned, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm.common import BLANKS, attach, whole_text, written
from docledger.session import work_folder


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(text, BLANKS, " "), 256))


class DigestIndex:
    """An index at ``location``; it is created if missing and can be opened again by any later session.

    The number of buckets belongs to the index. It is written beside the table when the index is made and read
    whenever it is opened, whatever the session's settings; asking for another number is an error.

    What a failed append may leave are whole files of some buckets, with rows that are right by themselves. The next
    anti-join finds them like any others, so giving the batch again completes it, and no digest is indexed twice. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int | None = None, name: str | None = None):
        self.spark = spark
        self.location = location.rstrip("/")
        self.buckets = self._layout(buckets)
        self.name = name or f"digests_{uuid.uuid5(uuid.NAMESPACE_URL, self.location).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}/rows'"
        )
        known = int(next(row["data_type"] for row in spark.sql(f"DESCRIBE EXTENDED {self.name}").collect() if row["col_name"] == "Num Buckets"))
        if known != self.buckets:
            raise ValueError(f"table {self.name} has {known} buckets, the index at {self.location} has {self.buckets}")
        spark.catalog.refreshTable(self.name)  # another session may have appended

    def _layout(self, buckets: int | None) -> int:
        """The number of buckets that the index was made with; a new index gets the number asked for."""
        path = f"{self.location}/layout"
        try:
            stored = self.spark.read.schema("buckets int").json(path).first()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = None
        if stored is None:
            made = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.spark.range(1).select(F.lit(made).alias("buckets")).coalesce(1).write.json(path)
            return made
        if buckets not in (None, stored["buckets"]):
            raise ValueError(f"the index at {self.location} has {stored['buckets']} buckets, not {buckets}")
        return stored["buckets"]

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, firsts: DataFrame) -> None:
        """Append those rows of (digest, keep_id), one per digest, whose digest is not yet indexed."""
        new = firsts.join(self.rows().hint("merge"), "digest", "left_anti")
        (
            new.select("digest", "keep_id")
            .repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.insertInto(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def compact(self, location: str) -> DigestIndex:
        """The same index at a new place, with one sorted file per bucket."""
        other = DigestIndex(self.spark, location, self.buckets)
        other.append_new(self.rows())
        return other

    def deduplicate(self, documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Deduplicate a batch within itself and against the index, and append its new texts.

        Returns one row per row of the batch: doc_id, digest, keep_id (of the row that stays, perhaps from
        an earlier batch), group_size (rows of this batch with this text) and kept. A batch that is given
        again gets the same result again.
        """
        read = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), digest_of(whole_text(text)).alias("digest"))
        rows = written(read.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("times")), "digests")
        groups = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("times").alias("group_size"))
        self.append_new(groups)
        known = groups.select("digest", "group_size").join(self.rows().hint("merge"), "digest")
        return (
            attach(rows, known, "digest", "doc_id")
            .select("doc_id", "digest", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))
            .drop("copy")
        )


def deduplicate(documents: DataFrame) -> DataFrame:
    """Deduplicate one table by a fresh index in the shared folder."""
    spark = documents.sparkSession
    return DigestIndex(spark, work_folder(spark, "digest-index")).deduplicate(documents)
