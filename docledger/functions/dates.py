"""Dates in payloads and in OCR text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.text import strip

# The accepted shapes (year never 0000) and the date-like tokens of OCR text.
YEAR_FIRST = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$"
DAY_FIRST = r"^(\d{1,2})-(\d{1,2})-(?!0000)(\d{4})$"
SLASHES = r"^(\d{1,2})/(\d{1,2})/(?!0000)(\d{4})$"
MONTH_NAME = r"(?U)^([a-z]+)\s+(\d{1,2}),\s+(?!0000)(\d{4})$"
OCR_TOKEN = r"(?U)\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b"
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
]


def _month_numbers() -> Column:
    pairs: dict[str, int] = {}
    for number, name in enumerate(MONTHS, start=1):
        pairs[name] = number
        pairs[name[:3]] = number
    return F.create_map(*[F.lit(part) for pair in pairs.items() for part in pair])


def parse_date(text: Column, month_names: bool = True) -> Column:
    """A date in one of the accepted shapes; with slashes the day comes first if that is a date."""
    value = strip(text)

    def reorder(pattern: str, order: str) -> Column:
        return F.regexp_replace(value, pattern, order).try_cast("date")

    result = (
        F.when(value.rlike(YEAR_FIRST), value.try_cast("date"))
        .when(value.rlike(DAY_FIRST), reorder(DAY_FIRST, "$3-$2-$1"))
        .when(
            value.rlike(SLASHES),
            F.coalesce(reorder(SLASHES, "$3-$2-$1"), reorder(SLASHES, "$3-$1-$2")),
        )
    )
    if month_names:
        lower = F.lower(value)
        month = F.try_element_at(_month_numbers(), F.regexp_extract(lower, MONTH_NAME, 1))
        result = result.when(
            lower.rlike(MONTH_NAME),
            F.concat_ws(
                "-",
                F.regexp_extract(lower, MONTH_NAME, 3),
                F.coalesce(month.cast("string"), F.lit("0")),
                F.regexp_extract(lower, MONTH_NAME, 2),
            ).try_cast("date"),
        )
    return result


def ocr_date(text: Column, month_names: bool = True) -> Column:
    """The first date-like token of the text that is a date."""
    tokens = F.regexp_extract_all(text, F.lit(OCR_TOKEN), F.lit(1))
    dates = F.transform(tokens, lambda token: parse_date(token, month_names))
    return F.get(F.filter(dates, lambda day: day.isNotNull()), F.lit(0))


def invoice_date(picked: Column, ocr_text: Column, as_of: str, month_names: bool = True) -> Column:
    """Picked date, else one from the OCR text, else ``as_of``."""
    return F.coalesce(
        parse_date(picked, month_names), ocr_date(ocr_text, month_names), F.lit(as_of).cast("date")
    )
