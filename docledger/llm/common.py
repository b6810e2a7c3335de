"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docledger.session import work_folder

#: Tasks over which the rows of one key are dealt in `attach`.
SPREAD = 1024
#: One or more of these characters separate words.
BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, read back from the shared folder: the lineage is cut and survives lost executors."""
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def attach(rows: DataFrame, values: DataFrame, key: str, identity: str) -> DataFrame:
    """Left join of at most one row per key in ``values``, for keys that may hold a third of all rows.

    Rows get a number from their identity; values are sent only to the (key, number) pairs that
    occur, so that a frequent key is dealt over `SPREAD` tasks and a rare one costs as many copies as
    it has rows. Only narrow rows should pass through here.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(identity), F.lit(SPREAD)).cast("int"))
    lookup = salted.select(key, "_salt").distinct().join(values, key)
    return salted.join(lookup, [key, "_salt"], "left").drop("_salt")


def bounded_sample(df: DataFrame, size: int, *key: str, among: float = 1.25) -> DataFrame:
    """At most ``size`` rows, those with the smallest hashes of their key; reruns agree.

    A share of the hashes, worked out from the number of rows so that about ``among`` times ``size`` rows pass, is
    cut off first: a task then hands on only its part of the sample, however many tasks there are.
    """
    rows = df.count()
    order = F.xxhash64(*key)
    share = F.pmod(order, F.lit(1 << 53)) / float(1 << 53)
    near = df if rows <= among * size else df.where(share < among * size / rows)
    return near.orderBy(order, *key).limit(size)


def packed(df: DataFrame, key: list[Column]) -> DataFrame:
    """key (a struct, in which nulls are equal), row (a struct of all columns of ``df``, so that no name can clash) and order (a hash of the
    row but for columns that hold maps or variants)."""
    own = lambda names: [F.col(f"`{name}`") for name in names]
    hashed = sorted(name for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind)
    order = F.xxhash64(*own(hashed)) if hashed else F.lit(0)
    return df.select(F.struct(*key).alias("key"), F.struct(*own(df.columns)).alias("row"), order.alias("order"))


def one_of_each(df: DataFrame, key: list[Column], wanted: DataFrame) -> DataFrame:
    """One row of ``df``, that with the smallest hash, for each key (a struct named key) in ``wanted``. Rows of ``df`` are shuffled once,
    at most one for each key from a task."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("order"))
    firsts = packed(df, key).withColumn("place", place).where("place = 1")
    return firsts.join(wanted.select("key").distinct(), "key", "left_semi").select("row.*")


def in_slices(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``size`` bytes of text; a longer text is a slice by itself."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pa.compute.binary_length(batch.column(text)).to_pylist()
        start, held = 0, 0
        for place, length in enumerate(lengths):
            if place > start and held + (length or 0) > size:
                yield batch.slice(start, place - start)
                start, held = place, 0
            held += length or 0
        yield batch.slice(start)
