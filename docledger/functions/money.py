"""Amounts and confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.payload import as_text
from docledger.functions.text import strip

PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def money_text(text: Column) -> Column:
    """A number from free text: only digits, commas, dots and minus signs count; else null."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")


def number_text(text: Column) -> Column:
    """A number from text that must be a plain number as it stands; else null."""
    stripped = strip(text)
    return F.when(stripped.rlike(PLAIN_NUMBER), stripped.try_cast("double"))


def money(value: Column, default: Column, clean: bool = True) -> Column:
    """A number from a picked variant. JSON numbers and booleans are taken as they are."""
    direct = F.schema_of_variant(value).isin("DOUBLE", "FLOAT", "BOOLEAN")
    read = money_text if clean else number_text
    parsed = F.when(direct, F.try_variant_get(value, "$", "double")).otherwise(read(as_text(value)))
    return F.coalesce(parsed, default)


def at_least_zero(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def unit_range(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))


#: Larger amounts count as this many cents: a bar code read as an amount must not end a job.
MOST_CENTS = 10**16


def cents(value: Column) -> Column:
    """Whole cents, `MOST_CENTS` at most; ``rint`` is half-even on the binary value."""
    return F.least(F.rint(value * 100), F.lit(float(MOST_CENTS))).cast("bigint")


def round2(value: Column) -> Column:
    return F.bround(value, 2)
