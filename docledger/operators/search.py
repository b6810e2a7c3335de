"""Substring search by an inverted index of trigrams.

Every stored row has a posting under each three letters that occur in one of its searched texts. A search reads the shortest of the
wanted text's lists, and those that are hardly longer, intersects them, fetches the rows that are left by their key, and looks into
these for the text itself, so results are those of a scan. Texts of fewer than three letters are searched by the scan.

Postings of texts that a row no longer has are harmless: the last step drops their rows. So appending rows again, or changed, needs no
clean-up before the index is right.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.operators.reports import history_texts, matching, recent_texts, review_texts
from docledger.session import work_folder
from docledger.sources.keyed import KeyedTable

GRAM = 3
#: A list is intersected if it is at most so many times as long as the shortest; so many lists at most.
LONGER, LISTS = 4, 3

Texts = Callable[[], list[Column]]


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, in lower case."""
    letters = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), ""), lambda letter: letter != "")

    def of(whole: Column) -> Column:
        places = F.when(F.size(whole) >= GRAM, F.sequence(F.lit(1), F.size(whole) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(places, lambda place: F.concat(*[F.element_at(whole, place + ahead) for ahead in range(GRAM)])))

    return F.transform(F.array(letters), of)[0]  # so that the text is cut once, not for each place


class TextIndex:
    """Rows of ``schema`` at ``location``, each key once, with postings of the texts that ``texts`` names."""

    def __init__(self, spark: SparkSession, location: str, schema: T.StructType, key: list[str], texts: Texts, buckets: int | None = None):
        self.spark, self.key, self.texts = spark, key, texts
        gram = T.StructField("gram", T.StringType())
        listed = T.StructType([gram, *[schema[name] for name in key]])
        self.records = KeyedTable(spark, f"{location}/records", schema, key, buckets)
        self.postings = KeyedTable(spark, f"{location}/postings", listed, ["gram"], buckets)
        self.sizes = KeyedTable(spark, f"{location}/sizes", T.StructType([gram, T.StructField("rows", T.LongType())]), ["gram"], buckets)

    def append(self, rows: DataFrame) -> None:
        """Add rows, each key once, or put them in the place of those with their keys. They are made once and written, as they are read many times."""
        path = work_folder(self.spark, "index-rows")
        rows.write.parquet(path)
        rows = self.spark.read.schema(rows.schema).parquet(path)
        self.records.upsert(rows)
        each = rows.select(*self.key, F.explode(F.array_distinct(F.flatten(F.array(*map(grams, self.texts()))))).alias("gram"))
        self.postings.append(each)
        self.sizes.append(each.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")))

    def candidates(self, text: str) -> DataFrame | None:
        """Keys of rows that may hold a text; None if it is too short for the index. One row for each of its letters comes to the driver."""
        wanted = self.spark.range(1).select(grams(F.lit(text.strip())).alias("grams")).first()["grams"]
        if not wanted:
            return None
        asked = self.spark.createDataFrame([(gram,) for gram in wanted], "gram string")
        known = self.sizes.held(self.sizes.touched(asked)).where(F.col("gram").isin(wanted))
        sizes = {row["gram"]: row["rows"] for row in known.groupBy("gram").agg(F.sum("rows").alias("rows")).collect()}
        least = min((sizes.get(gram, 0) for gram in wanted), default=0)
        chosen = sorted((gram for gram in wanted if sizes.get(gram, 0) <= LONGER * least), key=lambda gram: (sizes.get(gram, 0), gram))[:LISTS]
        lists = self.postings.held(self.postings.touched(asked.where(F.col("gram").isin(chosen)))).where(F.col("gram").isin(chosen))
        met = lists.select("gram", *self.key).distinct().groupBy(*self.key).agg(F.count(F.lit(1)).alias("lists"))
        return met.where(F.col("lists") == len(chosen)).drop("lists")

    def search(self, text: str) -> DataFrame:
        """The rows in which any of the texts holds ``text``, whatever its case; empty text keeps all rows."""
        keys = self.candidates(text) if text else None
        if keys is None:
            return matching(self.records.rows(), text, self.texts())
        found = self.records.held(self.records.touched(keys)).join(keys, self.key, "left_semi")
        return matching(found, text, self.texts())


def recent_index(spark: SparkSession, location: str, records: DataFrame, key: list[str], buckets: int | None = None) -> TextIndex:
    """For `search_recent`, over rows of `shown_records`."""
    return TextIndex(spark, location, records.schema, key, recent_texts, buckets)


def review_index(spark: SparkSession, location: str, items: DataFrame, buckets: int | None = None) -> TextIndex:
    """For `search_review`, over active items."""
    return TextIndex(spark, location, items.schema, ["document_id"], review_texts, buckets)


def history_index(spark: SparkSession, location: str, items: DataFrame, buckets: int | None = None) -> TextIndex:
    """For `search_history`, over decided items."""
    return TextIndex(spark, location, items.schema, ["document_id"], history_texts, buckets)
