from __future__ import annotations

from pyspark.sql import functions as F

from docledger.functions import items


def test_only_overcounted_documents_send_lines_to_python(spark):
    rows = [(0, [5.0, 4.0], 9.0), (1, [5.0, 4.0, 4.0], 9.0), (2, [], 9.0), (3, None, 9.0), (4, [5.0], None)]
    df = spark.createDataFrame(rows, "n int, totals array<double>, target double").withColumn(
        "lines", F.transform("totals", lambda total: F.struct(total.alias("line_total"))))
    kept = df.withColumn("keep", items.kept_positions(F.col("lines"), F.col("target"), 0.01)).sort("n").collect()
    assert [r.keep for r in kept] == [[], [0, 1], [], [], []], "an empty list, never null"
    shown = df.withColumn("keep", items.kept_positions(F.col("lines"), F.col("target"), 0.01)).select(
        "n", F.transform(items.keep_positions(F.col("lines"), F.col("keep")), lambda line: line["line_total"]).alias("left"))
    assert [r.left for r in shown.sort("n").collect()] == [[5.0, 4.0], [5.0, 4.0], [], None, [5.0]]
