"""Every document gets its exact lines, also where no quick way has an answer."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from docledger.functions import items, subset
from docledger.operators.normalize import reconcile


def preferred(cents, limit):
    """Of all sets of usable lines with the largest sum the one whose last line comes earliest, then the one before it, and so on."""
    usable = [place for place, amount in enumerate(cents) if 0 < amount <= limit]
    sets = [chosen for size in range(len(usable) + 1) for chosen in itertools.combinations(usable, size)]
    fitting = [(sum(cents[p] for p in chosen), chosen) for chosen in sets]
    top = max(total for total, _ in fitting if total <= limit)
    return list(min((chosen for total, chosen in fitting if total == top), key=lambda chosen: chosen[::-1]))


def test_search_against_all_sets(monkeypatch):
    """Few halves, bits and list places, so that every way is taken."""
    rng = random.Random(3)
    monkeypatch.setattr(subset, "TWO_HALVES", 3)
    monkeypatch.setattr(subset, "FIRST_LINES", 4)
    searched = 0
    for _ in range(600):
        monkeypatch.setattr(subset, "MOST_BITS", rng.choice([4, 4, 200]))
        monkeypatch.setattr(subset, "LIST_MOST", rng.choice([2, 4, 50]))
        monkeypatch.setattr(subset, "WINDOW", rng.choice([2, 8, 100]))
        step, top = rng.choice([1, 1, 5, 100]), rng.choice([5, 40, 900, 10**6])
        cents = [step * rng.randint(0, top) for _ in range(rng.randint(1, 10))]
        cents[rng.randrange(len(cents))] += rng.choice([0, 0, 7])
        limit = rng.choice([rng.randint(1, sum(cents) + 2), max(1, sum(cents) - rng.randint(0, top * step))])
        expected = preferred(cents, limit)
        assert subset.chosen_lines(cents, limit) == expected, (cents, limit)
        lines = [(p, a) for p, a in enumerate(cents) if 0 < a <= limit]
        if sum(amount for _, amount in lines) > limit:
            searched += 1
            assert subset._by_search(lines, limit) == expected, (cents, limit)
    assert searched > 300


def test_many_large_lines_with_one_repeated(spark):
    """61 lines of up to a million each: the first lines don't reach the subtotal, which is too large for bits."""
    rng = random.Random(8)
    cents = [rng.randint(10**6, 10**8) for _ in range(60)]
    cents.append(cents[17])
    wanted = sum(cents[:60])
    assert subset.closest_lines(cents, wanted + 1) == [], "no quick way"
    lines = [(f"line {n}", 1.0, amount / 100, amount / 100, None) for n, amount in enumerate(cents)]
    item = "struct<description:string,quantity:double,unit_price:double,line_total:double,category:string>"
    df = spark.createDataFrame([(lines,)], f"line_items array<{item}>")
    kept = reconcile(df, "line_items", F.lit(wanted / 100))
    found = kept.select(F.size("line_items"), F.rint(items.line_sum(F.col("line_items")) * 100).cast("bigint")).first()
    assert tuple(found) == (60, wanted)


def test_half_of_many_large_lines():
    rng = random.Random(2)
    cents = [rng.randint(10**5, 10**7) for _ in range(100)]
    limit = sum(cents) * 3 // 5
    found = subset.chosen_lines(cents, limit)
    assert sum(cents[place] for place in found) == limit and found == sorted(set(found))
