"""Payment method, document type and currency codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.text import has_any, strip
from docledger.rules import CURRENCY_MARKERS, CURRENCY_NAMES


def payment_method(text: Column, keywords: dict[str, list[str]]) -> Column:
    """The first method with a keyword inside the lower-case text, else ``unknown``."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    result = F.when(F.lit(False), F.lit(""))
    for method, words in keywords.items():
        result = result.when(has_any(lowered, [word.lower() for word in words]), F.lit(method))
    return result.otherwise(F.lit("unknown"))


def document_type(text: Column, default: str) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit(default)))
    return F.when(lowered.isin("invoice", "receipt"), lowered).otherwise(F.lit("invoice"))


def currency_code(text: Column, default: str) -> Column:
    """Upper-case text of length three, else the default."""
    upper = F.upper(F.coalesce(text, F.lit(default)))
    return F.when(F.length(upper) == 3, upper).otherwise(F.lit(default))


def named_currency(text: Column) -> Column:
    """Code for a currency name, sign or any three letters; else null."""
    upper = F.upper(strip(F.coalesce(text, F.lit(""))))
    names = F.create_map(*[F.lit(part) for pair in CURRENCY_NAMES.items() for part in pair])
    return F.coalesce(F.try_element_at(names, upper), F.when(upper.rlike(r"^[A-Z]{3}\z"), upper))


def infer_currency(explicit: Column, vendor: Column, number: Column, ocr_text: Column) -> Column:
    """The explicit currency, else the first marker found in the document's texts, else BDT."""
    parts = [F.when(part != "", part) for part in (explicit, vendor, number, ocr_text)]
    corpus = F.upper(F.concat_ws(" ", *parts))

    def marked(seen: Column) -> Column:
        result = F.when(F.lit(False), F.lit(""))
        for code, patterns in CURRENCY_MARKERS:
            result = result.when(seen.rlike("(?U)" + "|".join(patterns)), F.lit(code))
        return result.otherwise(F.lit("BDT"))

    # A one-element list, so that the long text is put together and upper-cased only once.
    return F.coalesce(named_currency(explicit), F.get(F.transform(F.array(corpus), marked), F.lit(0)))
