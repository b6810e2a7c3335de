"""Computing columns in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns so that later filters on them use the computed value.

    A filter on an ordinary computed column is moved below it in the plan, with the whole
    expression written out again; with long chains of derived columns such filters grow without
    bound. A generated column stops that, at the price of one row copy.
    """
    keep = [name for name in df.columns if name not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))
