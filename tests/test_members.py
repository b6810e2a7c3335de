from __future__ import annotations

from pyspark.sql import functions as F

from docledger.functions import items
from docledger.operators import normalize
from docledger.rules import Rules


def test_members_are_read_by_exact_names(spark):
    rules = Rules(field_aliases={"vendor_name": ["Shop", "shop", "a`b", "from.name"], "currency": ["w $['x']"], "line_items": ["lines", "Lines"]},
                  item_aliases={"description": ["Name", "name"], "quantity": ["q"]})
    texts = ['{"shop": "s", "Lines": [{"name": "Pen", "q": "2"}, null, 5, {}]}', '{"Shop": "", "a`b": "t", "lines": 3}',
             '{"from": {"name": "u"}, "w $[\'x\']": "EUR", "lines": [{"Name": "", "name": "Cup"}]}', "[1]"]
    df = spark.createDataFrame([(place, text) for place, text in enumerate(texts)], "n int, t string")
    read = normalize.pick_fields(df.withColumn("payload", F.parse_json("t")), rules)
    assert read.schema["p_line_items"].dataType.elementType.typeName() == "struct", "not a map that is searched for each alias"
    rows = read.select(
        "n", F.col("p_vendor_name").cast("string").alias("vendor"), F.col("p_currency").cast("string").alias("currency"),
        F.transform(items.normalize_items("p_line_items", rules), lambda item: F.struct(item["description"], item["quantity"])).alias("found"),
    ).sort("n").collect()
    assert [(r.vendor, r.currency, [tuple(i) for i in r.found]) for r in rows] == [
        ("s", None, [("Pen", 2.0), ("item", 1.0)]), ("t", None, []), ("u", "EUR", [("Cup", 1.0)]), (None, None, []),
    ]
