"""Tables stored by key, so that a batch meets stored rows without moving them.

A table is cut into buckets by the hash of its key. Every bucket is a folder of its own (``part=<bucket>``), and the
same hash is its bucketing, so joins on the key take stored rows as they lie: only the batch is shuffled. Only the folders whose
buckets a batch touches are read, and a change rewrites those alone. The number of buckets and the key are written beside the
table and checked on opening. One writer at a time.

An append of rows that are there, or a change that is made again, leaves the table as it is, so a repeated batch does no harm. Folders
that appends have left with many files are put together by `compact`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.operators import claims as claim_operators
from docledger.schemas import CLAIM_KEY
from docledger.session import work_folder
from docledger.sources.sinks import append_if_absent, upsert_review

BUCKETS = 64
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"
_PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class KeyedTable:
    """A table of ``schema`` at ``location``, with each key once; it is made if there is none.

    ``buckets`` counts for a new table; so many that a bucket stays a few hundred megabytes. Asking for another key or number of
    buckets than a table has is an error; without ``buckets`` the table's own are taken, whatever the session's settings.
    """

    def __init__(self, spark: SparkSession, location: str, schema: T.StructType, key: list[str], buckets: int | None = None):
        self.spark, self.schema, self.key = spark, schema, key
        self.location = location.rstrip("/")
        self.buckets = self._layout(buckets)
        self.name = f"keyed_{uuid.uuid5(uuid.NAMESPACE_URL, self.location).hex}"
        columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
        by = ", ".join(f"`{name}`" for name in key)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, part INT) USING parquet PARTITIONED BY (part) "
            f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.location}/rows'"
        )
        self.append(spark.createDataFrame([], schema))  # so that the folder is there
        spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")
        spark.catalog.refreshTable(self.name)

    def _layout(self, buckets: int | None) -> int:
        path = f"{self.location}/layout"
        try:
            found = self.spark.read.schema("buckets int, key array<string>").json(path).first()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            found = None
        if found is None:
            made = buckets or BUCKETS
            kept = self.spark.range(1).select(F.lit(made).alias("buckets"), F.array(*map(F.lit, self.key)).alias("key"))
            kept.coalesce(1).write.json(path)
            return made
        if found["key"] != self.key or buckets not in (None, found["buckets"]):
            raise ValueError(f"the table at {self.location} has {found['buckets']} buckets by {found['key']}, not {buckets} by {self.key}")
        return found["buckets"]

    @contextmanager
    def laid_out(self) -> Iterator[None]:
        """Shuffles of plans that are made and run within have as many partitions as the table has buckets. With more than that, a join
        would rather move the stored rows to where the batch's are."""
        with _setting(self.spark, _PARTITIONS, str(self.buckets)):
            yield

    def _part(self) -> Column:
        """The bucket of a row: the hash that bucketed tables are laid out by."""
        return F.pmod(F.hash(*[F.col(name).cast(self.schema[name].dataType) for name in self.key]), F.lit(self.buckets))

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop("part")

    def touched(self, batch: DataFrame) -> list[int]:
        """The buckets of a batch's keys: as many numbers as there are buckets, at most."""
        return sorted(row["part"] for row in batch.select(self._part().alias("part")).distinct().collect())

    def held(self, parts: list[int]) -> DataFrame:
        """The rows of some buckets; other folders are not read."""
        return self.spark.table(self.name).where(F.col("part").isin(parts)).drop("part")

    def _insert(self, rows: DataFrame, parts: int, overwrite: bool) -> None:
        placed = rows.select(*[F.col(field.name).cast(field.dataType) for field in self.schema]).withColumn("part", self._part())
        with _setting(self.spark, _OVERWRITE, "dynamic"):
            placed.repartition(max(1, parts), "part").write.insertInto(self.name, overwrite=overwrite)
        self.spark.catalog.refreshTable(self.name)

    def append(self, rows: DataFrame) -> None:
        """Add rows whose keys the table doesn't have."""
        self._insert(rows, self.buckets, overwrite=False)

    def replace(self, parts: list[int], rows: DataFrame) -> None:
        """Put ``rows``, all of some buckets, in place of what these buckets hold."""
        if parts:
            path = work_folder(self.spark, "buckets")
            with self.laid_out():
                rows.write.parquet(path)  # what is read must not be what is overwritten
            self._insert(self.spark.read.schema(rows.schema).parquet(path), len(parts), overwrite=True)

    def change(self, batch: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrite the buckets that a batch touches as ``merge`` makes them from their rows."""
        parts = self.touched(batch)
        self.replace(parts, merge(self.held(parts)))

    def upsert(self, changed: DataFrame) -> None:
        """Put rows, each key once, in the place of those with their keys, or add them."""
        self.change(changed, lambda held: held.join(changed.select(*self.key), self.key, "left_anti").unionByName(changed.select(*held.columns)))

    def compact(self, files: int = 4) -> list[int]:
        """Rewrite the buckets that lie in more than so many files, one file for each; returns their numbers."""
        each = self.spark.table(self.name).select("part", F.input_file_name().alias("file")).distinct()
        counted = each.groupBy("part").agg(F.count(F.lit(1)).alias("files"))
        parts = sorted(row["part"] for row in counted.where(F.col("files") > files).collect())
        self.replace(parts, self.held(parts))
        return parts


def store_if_absent(rows: DataFrame, ledger: KeyedTable, make_row: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`append_if_absent` against a stored ledger: appends what is new, and returns ``rows`` with their append_status.

    ``make_row`` turns the rows that are appended into rows of the ledger.
    """
    path = work_folder(ledger.spark, "append-status")
    with ledger.laid_out():
        append_if_absent(rows, ledger.held(ledger.touched(rows))).write.parquet(path)
    results = ledger.spark.read.parquet(path)
    ledger.append(make_row(results.where(F.col("append_status") == "appended").drop("append_status")))
    return results


def claim_in_place(attempts: DataFrame, claims: KeyedTable, now: str) -> DataFrame:
    """The result of each attempt; the claims that it takes are changed in their buckets."""
    held = claims.held(claims.touched(attempts))
    path = work_folder(claims.spark, "claims")
    with claims.laid_out():
        claim_operators.claim(attempts, held).write.parquet(f"{path}/results")
        claim_operators.claims_after(attempts, held, now).write.parquet(f"{path}/changed")
    claims.upsert(claims.spark.read.schema(claims.schema).parquet(f"{path}/changed"))
    return claims.spark.read.parquet(f"{path}/results")


def mark_in_place(updates: DataFrame, claims: KeyedTable) -> None:
    """`merge_status` within the buckets that hold the updates' keys."""
    claims.change(updates.dropna(subset=CLAIM_KEY), lambda held: claim_operators.merge_status(updates, held))


def upsert_review_in_place(new: DataFrame, queue: KeyedTable) -> None:
    """`upsert_review` within the buckets that hold the new items' documents."""
    queue.change(new, lambda held: upsert_review(new, held))
