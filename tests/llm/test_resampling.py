from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import TABLES
from docledger.llm import resampling
from docledger.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def buckets_of(text: str | None) -> list[int]:
    words = words_of(text)
    runs = [" ".join(words[at : at + size]) for size in (1, 2, 3) for at in range(len(words) - size + 1)]
    return [zlib.crc32(run.encode()) % 10000 for run in runs]


def brute(documents: list[tuple], target: list[str | None]) -> list[tuple]:
    """(doc_id, n_features, weight, score, rank) from (doc_id, text)."""
    held = [buckets_of(text) for _, text in documents]
    s, t = Counter(b for one in held for b in one), Counter(b for text in target for b in buckets_of(text))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for (doc_id, text), own in zip(documents, held):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((row for row in rows if row[5] >= 20), key=lambda row: (-row[3], row[0] is None, row[0] or 0))
    for rank, row in enumerate(able[: 5 * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(row[:5]) for row in rows), key=repr)


@pytest.mark.parametrize("folder", [TABLES, "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, folder):
    documents = [tuple(row) for row in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [row.text for row in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect()]
    assert sorted((tuple(row) for row in QUERIES["op13_resampling"](spark, folder).collect()), key=repr) == brute(documents, target)


@pytest.mark.parametrize("known", [0, 3, 10**6])
def test_buckets_whatever_the_dictionary_knows(known):
    texts = ["The cat. THE CAT sat", "", "  ", "é😀 ÀB z", "x" * 5000 + " y " + "ab" * 200, "one", "a\x00b\x1cc d", "the  the the\nthe", "İK ſ 9z"]
    words = sorted({word.encode() for text in texts for word in words_of(text)})[:known]
    owners, buckets, counts = resampling.Dictionary(words).buckets([text.encode() for text in texts])
    for place, text in enumerate(texts):
        assert sorted(buckets[owners == place].tolist()) == sorted(buckets_of(text)) and counts[place] == len(words_of(text))


def test_moves_against_zlib():
    rng = np.random.default_rng(3)
    moves = resampling.Moves()
    for length in [0, 1, 2, 3, 63, 64, 65, 1000, 123_457, *rng.integers(1, 300, 100).tolist()]:
        first, second = rng.bytes(20), rng.bytes(length)
        moved = moves.over(np.array([zlib.crc32(first)], np.uint32), np.array([length]))[0]
        assert int(moved) ^ zlib.crc32(second) == zlib.crc32(first + second)


def test_draw_ranks_over_ranges(spark):
    """Ties, repeated rows, null ids and a score that a third of all rows have, over many ranges."""
    rows = [(None if i % 97 == 0 else i // 2, 5, 700 if i % 3 == 0 else i * 37 % 1000, 20 - (i % 11 == 0)) for i in range(3000)]
    got = resampling.draw(spark.createDataFrame(rows, "doc_id bigint, n_features bigint, weight bigint, n_words bigint"), percent=50).collect()
    able = sorted((row for row, r in zip(rows, rows) if r[3] >= 20), key=lambda r: 0)
    ranked = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == [*range(1, len(able) // 2 + 1)]
    keys = [(-r.score, r.doc_id is None, r.doc_id or 0) for r in ranked]
    assert keys == sorted(keys) and len(got) == 3000
    undrawn = Counter((r.doc_id, r.weight) for r in got if r.rank is None)
    assert undrawn + Counter((r.doc_id, r.weight) for r in ranked) == Counter((r[0], r[2]) for r in rows)


def test_odd_rows(spark):
    made = [(5, "A b-c", 1, "x"), (5, "A b-c", 1, "x"), (None, None, None, None), (None, "w " * 30, 2, "y"), (7, "", 3, "z"), (8, "Word " * 40000, 4, "q"),
            (9, " ".join(f"u{n}" for n in range(25)), 5, "p")]
    docs = spark.createDataFrame(made, "doc_id int, text string, score int, rank string")
    target = spark.createDataFrame([("a b",), (None,), ("",)], "text string")
    for texts in (target, target.limit(0)):
        got = sorted((tuple(row) for row in resampling.resample(docs, texts).collect()), key=repr)
        assert got == brute([row[:2] for row in made], [row.text for row in texts.collect()])
    assert resampling.resample(docs.limit(0), target).collect() == []
    half = resampling.resample(docs, target, percent=70).where(F.col("rank").isNotNull()).count()
    assert half == 2
