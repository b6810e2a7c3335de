"""Record checks: the schema of a record and the business rules over its amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.items import line_sum
from docledger.functions.money import round2
from docledger.functions.text import strip
from docledger.rules import AMOUNT_TOLERANCE

RULE_COUNT = 3
DOCUMENT_TYPES = ["invoice", "receipt"]
PAYMENT_METHODS = ["card", "cash", "bank", "unknown"]
CURRENCY_SHAPE = r"^[A-Z]{3}\z"


def _error(condition: Column, loc: Column | str, kind: str) -> Column:
    place = F.lit(loc) if isinstance(loc, str) else loc
    return F.when(condition, F.struct(place.alias("loc"), F.lit(kind).alias("type")))


def schema_errors(type_errors: Column | None = None) -> Column:
    """All places where the record columns break the record schema, as (loc, type) pairs.

    ``type_errors`` are errors found while reading values; a value that could not be read is null
    here and is not reported as missing again.
    """
    nothing = F.array().cast("array<struct<loc:string,type:string>>")
    known = nothing if type_errors is None else F.coalesce(type_errors, nothing)

    def missing(name: str) -> Column:
        told = F.exists(known, lambda error: error["loc"] == name)
        return _error(F.col(name).isNull() & ~told, name, "missing")

    errors = [missing(name) for name in (
        "document_type", "vendor_name", "invoice_date", "currency", "subtotal", "tax_amount",
        "total_amount", "model_confidence", "validation_score",
    )]
    errors += [
        _error(~F.col("document_type").isin(DOCUMENT_TYPES), "document_type", "literal_error"),
        _error(F.col("vendor_name") == "", "vendor_name", "string_too_short"),
        _error(~F.col("currency").rlike(CURRENCY_SHAPE), "currency", "string_pattern_mismatch"),
        _error(~F.col("payment_method").isin(PAYMENT_METHODS), "payment_method", "literal_error"),
    ]
    for name in ("subtotal", "tax_amount", "total_amount", "model_confidence", "validation_score"):
        errors.append(_error(F.col(name) < 0, name, "greater_than_equal"))
    for name in ("model_confidence", "validation_score"):
        errors.append(_error(F.col(name) > 1, name, "less_than_equal"))

    def of_item(item: Column, place: Column) -> Column:
        def at(name: str) -> Column:
            return F.concat(F.lit("line_items."), place.cast("string"), F.lit(f".{name}"))

        def absent(name: str) -> Column:
            told = F.exists(known, lambda error: error["loc"] == at(name))
            return _error(item[name].isNull() & ~told, at(name), "missing")

        return F.array(
            absent("description"),
            absent("quantity"),
            absent("unit_price"),
            absent("line_total"),
            _error(item["description"] == "", at("description"), "string_too_short"),
            _error(item["quantity"] <= 0, at("quantity"), "greater_than"),
            _error(item["unit_price"] < 0, at("unit_price"), "greater_than_equal"),
            _error(item["line_total"] < 0, at("line_total"), "greater_than_equal"),
        )

    in_items = F.flatten(F.transform(F.coalesce(F.col("line_items"), F.array()), of_item))
    return F.filter(F.concat(known, F.array(*errors), in_items), lambda error: error.isNotNull())


def error_text(errors: Column) -> Column:
    """``loc: type`` pairs in order of place."""
    listed = F.array_sort(F.transform(errors, lambda e: F.concat(e["loc"], F.lit(": "), e["type"])))
    return F.array_join(listed, "; ")


def _violation(condition, code, severity, message, expected=None, actual=None) -> Column:
    none = F.lit(None).cast("double")
    return F.when(
        condition,
        F.struct(
            F.lit(code).alias("code"),
            F.lit(severity).alias("severity"),
            F.lit(message).alias("message"),
            (none if expected is None else expected).alias("expected"),
            (none if actual is None else actual).alias("actual"),
        ),
    )


def amount_mismatch(tolerance: float = AMOUNT_TOLERANCE) -> Column:
    computed = round2(F.col("subtotal") + F.col("tax_amount"))
    declared = round2(F.col("total_amount"))
    return _violation(
        F.abs(computed - declared) > tolerance,
        "amount_mismatch", "error", "subtotal + tax does not match total_amount", computed, declared,
    )


def _item_sums() -> tuple[Column, Column]:
    return round2(line_sum(F.col("line_items"))), round2(F.col("subtotal"))


def _without_amounts(tolerance: float) -> Column:
    items_sum, subtotal = _item_sums()
    return (items_sum <= tolerance) & (subtotal > tolerance)


def line_items_incomplete(tolerance: float = AMOUNT_TOLERANCE) -> Column:
    items_sum, subtotal = _item_sums()
    return _violation(
        (F.size("line_items") > 0) & _without_amounts(tolerance),
        "line_items_incomplete", "warning", "line items present but amounts are missing or zero",
        items_sum, subtotal,
    )


def line_item_sum_mismatch(tolerance: float = AMOUNT_TOLERANCE) -> Column:
    items_sum, subtotal = _item_sums()
    return _violation(
        (F.size("line_items") > 0)
        & ~_without_amounts(tolerance)
        & (F.abs(items_sum - subtotal) > tolerance),
        "line_item_sum_mismatch", "error", "sum(line_items.line_total) does not match subtotal",
        items_sum, subtotal,
    )


def missing_identifier() -> Column:
    def blank(name: str) -> Column:
        return F.coalesce(strip(F.col(name)), F.lit("")) == ""

    return _violation(
        (F.col("document_type") == "invoice") & blank("invoice_number") & blank("vendor_tax_id"),
        "missing_identifier", "warning", "invoice should include invoice_number or vendor_tax_id",
    )


def violations(tolerance: float = AMOUNT_TOLERANCE) -> Column:
    found = F.array(
        amount_mismatch(tolerance),
        line_items_incomplete(tolerance),
        line_item_sum_mismatch(tolerance),
        missing_identifier(),
    )
    return F.filter(found, lambda violation: violation.isNotNull())


def score(found: Column) -> Column:
    share = F.lit(1.0) - F.size(found) / F.lit(float(RULE_COUNT))
    return F.bround(F.greatest(share, F.lit(0.0)), 4)


def is_valid(found: Column) -> Column:
    return ~F.exists(found, lambda violation: violation["severity"] == "error")
