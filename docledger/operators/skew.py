"""Joins that stay balanced when one key holds a large part of the rows.

Rows get a spread number from their own identity. Per-key results are sent only to the
(key, spread) pairs that occur, so a hot key is divided over many tasks, a rare key costs as many
copies as it has rows, and nothing is broadcast or dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD = 512


def spread_of(*identity: str, parts: int = SPREAD) -> Column:
    return F.pmod(F.xxhash64(*identity), F.lit(parts)).cast("int")


def _key(names: list[str]) -> list[Column]:
    return [F.col(name).alias(f"_k{place}") for place, name in enumerate(names)]


def _on(rows: DataFrame, other: DataFrame, names: list[str]) -> Column:
    condition = rows["_spread"] == other["_s"]
    for place, name in enumerate(names):
        condition = condition & rows[name].eqNullSafe(other[f"_k{place}"])
    return condition


def attach_per_key(
    rows: DataFrame,
    keys: list[str],
    identity: list[str],
    aggregates: list[Column],
    enrich: Callable[[DataFrame], DataFrame] | None = None,
    parts: int = SPREAD,
) -> DataFrame:
    """Add per-key aggregates of ``rows`` to every row.

    ``enrich`` may join more columns to the one-row-per-key table before it is attached.
    """
    spread = rows.withColumn("_spread", spread_of(*identity, parts=parts))
    per_key = spread.groupBy(*keys).agg(*aggregates, F.collect_set("_spread").alias("_places"))
    if enrich is not None:
        per_key = enrich(per_key)
    extra = [name for name in per_key.columns if name not in (*keys, "_places")]
    per_place = per_key.select(*_key(keys), *extra, F.explode("_places").alias("_s"))
    joined = spread.join(per_place, _on(spread, per_place, keys), "left")
    return joined.select(*rows.columns, *extra)
