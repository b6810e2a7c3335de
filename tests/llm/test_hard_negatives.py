from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docledger.llm import hard_negatives

ROW = "vec_id bigint, embedding array<float>, label int, list int, id string, score double"
OUT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows: list[tuple], every: int = 50, positives: int = 5, negatives: int = 3) -> list[tuple]:
    """From (id, label, q)."""
    found = []
    for anchor, label, q in rows:
        if anchor % every:
            continue
        scored = sorted((-int(sum(a * b for a, b in zip(q, other))), id_, same == label) for id_, same, other in rows if id_ != anchor)
        for minus, positive, _ in [one for one in scored if one[2]][:positives]:
            score = -minus
            fit = [one for one in scored if not one[2] and 50 * score <= 100 * -one[0] <= 95 * score][:negatives]
            found += [(anchor, positive, rank, one[1], score, -one[0]) for rank, one in enumerate(fit, 1)]
    return sorted(found)


def mined(spark, rows: list[tuple], every: int = 50) -> list[tuple]:
    df = spark.createDataFrame([(int(i), int(n), [float(x) for x in q]) for i, n, q in rows], "id bigint, label bigint, q array<double>")
    return sorted(tuple(row) for row in hard_negatives.mine(df, F.col("id") % every == 0).select(*OUT).collect())


@pytest.mark.parametrize("first, part, chunk, codes", [(8, 64, 4, 12), (1 << 30, 8192, 1024, 3), (1, 16, 2, 40)])
def test_against_brute_force(spark, monkeypatch, first, part, chunk, codes):
    """Vectors in clusters, so that most cells are never visited, with ties and a vector that a fifth of all rows repeat."""
    for name, value in (("FIRST", first), ("PART", part), ("CHUNK", chunk), ("CODES", codes), ("CELL", 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 200, (9, 10))
    q = np.floor(centres[rng.integers(0, 9, 600)] + rng.normal(0, 30, (600, 10)))
    q[::5] = q[0]
    q[3::50] = 0
    rows = [(int(i), int(n), v.tolist()) for i, n, v in zip(rng.permutation(5000)[:600], rng.integers(0, 3, 600), q)]
    assert mined(spark, rows, 25) == brute(rows, 25)


def test_heap_order():
    rng = np.random.default_rng(3)
    for sizes in ((1, 1), (1, 7), (7, 1), (9, 6)):
        a, b = rng.integers(0, 5, sizes[0]).astype(float), rng.normal(size=sizes[1])
        found = [*hard_negatives.by_bound(a, b)]
        assert sorted((i, j) for _, i, j in found) == [(i, j) for i in range(sizes[0]) for j in range(sizes[1])]
        sums = [total for total, _, _ in found]
        assert sums == sorted(sums, reverse=True) and all(math.isclose(total, a[i] + b[j]) for total, i, j in found)


def test_certified_search_skips_cells(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "FIRST", 10)
    monkeypatch.setattr(hard_negatives, "CELL", 4)
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 500, (20, 8))
    rows = [(i, i % 2, np.floor(centres[i % 20] + rng.normal(0, 5, 8)).tolist()) for i in range(800)]
    index = hard_negatives.Index(spark.createDataFrame(rows, "id bigint, label bigint, q array<double>"))
    one = F.array(F.struct(F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"), F.lit(900_000.0).alias("limit")))
    asking = index.rows.where("id % 100 = 0").select("id", "label", "q", one.alias("windows"))
    cells = sum(len(row.seconds) for wave in (True, False) for row in index._visits(asking, wave).collect())
    assert 0 < cells < 8 * (index.books.value.held > 0).sum() / 2


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    made = [
        (0, [1.0, 0.5], 1, 1, "x", 0.0), (0, [1.0, 0.5], 1, None, None, None), (50, [0.5], 1, 1, "x", 1.0), (1, [], 1, 1, "x", 1.0),
        (2, [0.0, 0.0], 2, 1, "x", 1.0), (3, [0.25, 0.75], 2, 1, "x", 1.0), (4, None, 2, 1, "x", 1.0), (5, [nan, 1.0], 2, 1, "x", 1.0),
        (6, [inf, 1.0], 2, 1, "x", 1.0), (7, [None, 1.0], 2, 1, "x", 1.0), (8, [0.5, 0.0], None, 1, "x", 1.0), (None, [0.5, 0.0], 1, 1, "x", 1.0),
        (9, [0.5, 0.25], 1, 1, "x", 1.0), (10, [0.25, 0.75], 2, 1, "x", 1.0), (11, [0.1] * 5000, 2, 1, "x", 1.0), (3, [9.0, 9.0], 2, 1, "x", 1.0),
    ]
    df = hard_negatives.usable(spark.createDataFrame(made, ROW), "vec_id", "embedding", "label", 256)
    rows = [(r.id, r.label, r.q) for r in df.collect()]
    assert sorted(r[0] for r in rows) == [0, 1, 2, 3, 9, 10, 11, 50]
    assert dict((r[0], r[2]) for r in rows)[3] == [64.0, 192.0]
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("id") % 50 == 0).select(*OUT).collect())
    assert got == brute(rows) and got
    assert hard_negatives.mine(df.where("label = 1"), F.col("id") % 50 == 0).collect() == []
    assert hard_negatives.mine(df.limit(0), F.col("id") % 50 == 0).collect() == []
