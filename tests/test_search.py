from __future__ import annotations

import random

from pyspark.sql import functions as F

from docledger.operators import search
from docledger.operators.reports import history_texts, matching

ITEM = "document_id string, status string, vendor_name string, resolution_note string, invoice_number string, amount int"


def made(rng, count, start=0):
    words = ["Ökö", "Müller", "inv", "reject", "stored", "x" * 30, "aa", "ab", "😀😀b", "İstanbul", "two words", ""]
    text = lambda: rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))])
    return [(f"doc-{start + n}", rng.choice(["REJECTED", "STORED"]), text(), text(), f"INV-{rng.randint(0, 300)}", n) for n in range(count)]


def test_search_equals_the_scan(spark, tmp_path):
    rng = random.Random(8)
    rows = made(rng, 300) + [("long", "STORED", "needle in " + "hay " * 20_000 + "stack", None, None, 1)]
    frame = spark.createDataFrame(rows, ITEM)
    index = search.TextIndex(spark, str(tmp_path / "i"), frame.schema, ["document_id"], history_texts, 4)
    assert index.search("reject").count() == 0
    for part in range(2):
        index.append(spark.createDataFrame(rows[part::2], ITEM))
    changed = [("doc-3", "STORED", "quite new", None, "INV-9", 7)]
    index.append(spark.createDataFrame(changed, ITEM))
    index.append(spark.createDataFrame(changed, ITEM))  # a batch that is given again
    now = spark.createDataFrame([row for row in rows if row[0] != "doc-3"] + changed, ITEM).cache()
    for text in ["", "in", "INV-12", " reject ", "ÖKÖ", "aa ab", "quite new", "y stack", "none such", "😀😀b"]:
        assert sorted(map(tuple, index.search(text).collect())) == sorted(map(tuple, matching(now, text, history_texts()).collect())), text
    now.unpersist()


def test_only_short_lists_are_read(spark, tmp_path):
    rows = [(f"doc-{n:04}", "STORED", "common vendor", "rareword" if n % 100 == 7 else None, "INV", n) for n in range(1000)]
    frame = spark.createDataFrame(rows, ITEM)
    index = search.TextIndex(spark, str(tmp_path / "i"), frame.schema, ["document_id"], history_texts, 8)
    index.append(frame)
    assert index.candidates("a rareword").count() == 0 and index.candidates("rareword").count() == 10
    assert index.candidates("ab") is None
    plan = index.candidates("rareword")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [" in plan and "PartitionFilters: [part" in plan
    assert index.search("RAREword").count() == 10


def test_rows_are_made_once(spark, tmp_path):
    """However often an append needs its rows, what makes them runs once."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    schema = spark.createDataFrame([], "document_id string, text string").schema
    rows = spark.range(20).selectExpr("concat('d', id) AS document_id", "concat('text ', id) AS text").mapInArrow(count, schema)
    index = search.TextIndex(spark, str(tmp_path / "once"), schema, ["document_id"], lambda: [F.col("text")], 4)
    index.append(rows)
    assert made.value == 20
    assert [row["document_id"] for row in index.search("text 17").collect()] == ["d17"]
