from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docledger.operators import enrich
from docledger.rules import CATEGORY_KEYWORDS, VENDOR_NAMES

RULE = "priority bigint, part string, result string"


def test_many_rules_equal_brute_force(spark):
    rng = random.Random(2)
    letters = "abcdeé😀 -"
    word = lambda low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    rules = [(rng.randrange(60_000), word(2, 9), f"r{rng.randrange(1000)}") for _ in range(100_000)]  # parts and priorities repeat
    texts = [None, "", "zzz", *(word(0, 40) for _ in range(150)), "ab" * 20_000]
    lookup = enrich.rule_lookup(spark.createDataFrame([*rules, (None, "a", "x"), (1, None, "x"), (1, "a", None)], RULE))
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = {r.n: r.found for r in df.select("n", lookup(F.col("text")).alias("found")).collect()}
    for place, text in enumerate(texts):
        hits = [] if text is None else [(priority, result) for priority, part, result in rules if part in text]
        assert got[place] == (min(hits)[1] if hits else None), text


def test_tables_equal_the_chains(spark):
    names = ["AMZN Mktp, Inc.", " Wal-Mart #12", "starbucks-coffee", "Unknown Shop ", "", None, "Walmart amazon"]
    rules = spark.createDataFrame([(n, part, name) for n, (part, name) in enumerate(VENDOR_NAMES.items())], RULE)
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = df.select(enrich.canonical_vendor_by_table(F.col("name"), rules).alias("a"), enrich.canonical_vendor(F.col("name")).alias("b")).collect()
    assert all(r.a == r.b for r in got)
    keywords = [(word, category) for category, words in CATEGORY_KEYWORDS.items() for word in words]
    rng = random.Random(1)
    texts = [" ".join(rng.choice([*[w.upper() for w, _ in keywords], "nothing", "taxis"]) for _ in range(rng.randint(0, 3))) for _ in range(60)] + [None]
    more = [(f"keyword{n:05}", f"c{n % 50}") for n in range(10_000)]
    table = spark.createDataFrame([(n, word, category) for n, (word, category) in enumerate(keywords + more)], RULE)
    df = spark.createDataFrame([(n, t) for n, t in enumerate([*texts, "has KEYWORD00077 in it"])], "n int, text string")
    by_table = {r.n: tuple(r) for r in enrich.suggest_category_by_table(df, "text", table).collect()}
    by_chain = {r.n: tuple(r) for r in enrich.suggest_category(df.where(f"n < {len(texts)}"), "text").collect()}
    assert {n: row for n, row in by_table.items() if n < len(texts)} == by_chain
    assert by_table[len(texts)][2:] == ("c27", 0.85, "rules")


def test_empty_tables_and_bounds(spark, monkeypatch):
    none = spark.createDataFrame([], RULE)
    df = spark.createDataFrame([("Some Shop",)], "name string")
    assert df.select(enrich.canonical_vendor_by_table(F.col("name"), none)).first()[0] == "Some Shop"
    every = spark.createDataFrame([(5, "", "all"), (9, "shop", "late"), (1, "shop", "early")], RULE)
    assert df.select(enrich.rule_lookup(every)(F.lit("x")), enrich.rule_lookup(every)(F.lit("a shop"))).first()[:] == ("all", "early")
    monkeypatch.setattr(enrich, "MOST_RULES", 2)
    with pytest.raises(ValueError):
        enrich.rule_lookup(every)
