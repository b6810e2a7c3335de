"""Golden-set evaluation: expected records against what the normaliser made of the documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.money import number_text
from docledger.functions.once import compute_once
from docledger.functions.payload import as_text
from docledger.functions.text import plain_text
from docledger.rules import AMOUNT_TOLERANCE

# The fields compared as numbers within the tolerance.
NUMERIC_FIELDS = ["subtotal", "tax_amount", "total_amount", "model_confidence", "validation_score"]
RESULTS = "array<struct<field:string,expected_value:string,actual_value:string,matched:boolean,reason:string>>"
NUMBERS = ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"]


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: what a lambda names several times would be computed each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(value: Column, kind: Column, text: Column, numeric: Column) -> Column:
    """The number of a value; texts are only read as numbers where the field is numeric."""
    return F.when(kind.isin(NUMBERS), F.try_variant_get(value, "$", "double")).when(
        numeric & (kind == "STRING"), number_text(text)
    )


def gate_cases(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """Cases with the document's result; ``status`` is ok or error, ``error`` says why.

    ``cases``: id, file_path, expected (variant). ``documents``: file_path, error_code,
    error_message, used_provider, record (variant), one row per file.
    """
    known = documents.withColumn("_known", F.lit(True))
    joined = cases.withColumn("file_path", F.trim("file_path")).join(known, "file_path", "left")
    kind = F.schema_of_variant("expected")
    usable = kind.startswith("OBJECT<") & (kind != "OBJECT<>")
    error = (
        F.when(F.col("_known").isNull(), "file_not_found")
        .when(~F.coalesce(usable, F.lit(False)), "invalid_expected_payload")
        .when(F.col("error_code").isNotNull(), F.col("error_code"))
        .when(F.col("error_message").isNotNull(), "unhandled_exception")
    )
    details = (
        F.when(F.col("_known").isNull(), F.concat(F.lit("Missing file: "), "file_path"))
        .when(F.col("error") == "invalid_expected_payload",
              "Each case requires a non-empty 'expected' object.")
        .otherwise(F.col("error_message"))
    )
    return (
        joined.withColumn("error", error)
        .withColumn("details", details)
        .select(
            "id", "file_path", "expected",
            F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"),
            "error", "details",
            F.when(F.col("error").isNull(), F.coalesce("used_provider", F.lit("unknown"))).alias("used_provider"),
            "record",
        )
    )


def _read(pair: Column) -> Column:
    """A pair with kind and text of both values."""
    return F.struct(
        *[pair[name].alias(name) for name in ("field", "expected", "actual", "fixed_match", "fixed_reason")],
        pair["name"].isin(NUMERIC_FIELDS).alias("numeric"),
        *[_kind(pair[side]).alias(f"{side}_kind") for side in ("expected", "actual")],
        *[as_text(pair[side]).alias(f"{side}_text") for side in ("expected", "actual")],
    )


def _judged(pair: Column, tolerance: float) -> Column:
    """A pair's ``field``, both values as text, ``matched`` and ``reason``, from what `_read` made of it.

    The five numeric fields compare within the tolerance, expected texts without regard to case and
    spacing, and everything else by value.
    """
    expected_kind, actual_kind = pair["expected_kind"], pair["actual_kind"]
    expected_text, actual_text = pair["expected_text"], pair["actual_text"]
    numeric = pair["numeric"]
    expected_number = _number(pair["expected"], expected_kind, expected_text, numeric)
    actual_number = _number(pair["actual"], actual_kind, actual_text, numeric)
    texts = expected_kind == "STRING"
    empty = (actual_kind.isin(NUMBERS) & (actual_number == 0)) | actual_text.isin("{}", "[]")
    shown = F.when(empty & (actual_kind != "STRING"), F.lit("")).otherwise(actual_text)
    same = (
        F.when(expected_kind.isin(NUMBERS) & actual_kind.isin(NUMBERS), expected_number == actual_number)
        .when(actual_kind == "STRING", F.lit(False))
        .otherwise(expected_text.eqNullSafe(actual_text))
    )
    found = F.when(numeric, F.abs(expected_number - actual_number) <= tolerance).when(
        texts, plain_text(expected_text) == plain_text(shown)
    ).otherwise(same)
    known = pair["fixed_reason"].isNotNull() | pair["fixed_match"]
    matched = F.when(known, pair["fixed_match"]).otherwise(F.coalesce(found, F.lit(False)))
    reason = F.coalesce(
        pair["fixed_reason"],
        F.when(numeric, F.lit(f"numeric mismatch (tol={tolerance})"))
        .when(texts, F.lit("text mismatch"))
        .otherwise(F.lit("value mismatch")),
    )
    return F.struct(
        pair["field"].alias("field"), expected_text.alias("expected_value"), actual_text.alias("actual_value"),
        matched.alias("matched"), reason.alias("reason"),
    )


def _pair(field, name, expected, actual, match: Column | None = None, reason: str | None = None) -> Column:
    """One comparison; with ``match`` the outcome is already known."""
    return F.struct(
        field.alias("field"),
        name.alias("name"),
        expected.alias("expected"),
        actual.alias("actual"),
        (F.lit(False) if match is None else match).alias("fixed_match"),
        F.lit(reason).cast("string").alias("fixed_reason"),
    )


def line_item_pairs(expected: Column, actual: Column) -> Column:
    """Comparisons for a list of expected items: one for the count, then one per expected field.

    Items pair by position. An expected item without a partner gives one failed result; extra
    actual items only cost the count.
    """
    none = F.lit(None).cast("variant")
    n_expected = F.size(expected)
    n_actual = F.size(actual)
    count = _pair(
        F.lit("line_items.count"), F.lit("line_items.count"), n_expected.cast("variant"),
        n_actual.cast("variant"), n_expected == n_actual, "count mismatch",
    )

    def of_item(item: Column, place: Column) -> Column:
        prefix = F.concat(F.lit("line_items["), place.cast("string"), F.lit("]"))
        members = F.map_entries(F.try_variant_get(item, "$", "map<string,variant>"))
        partner = F.try_variant_get(F.get(actual, place), "$", "map<string,variant>")
        paired = _once(partner, lambda found: F.transform(
            members,
            lambda member: _pair(
                F.concat(prefix, F.lit("."), member["key"]),
                F.concat(F.lit("line_items."), member["key"]),
                member["value"],
                F.try_element_at(found, member["key"]),
            ),
        ))
        missing = F.array(_pair(prefix, prefix, item, none, F.lit(False), "missing line item"))
        return F.when(place >= n_actual, missing).otherwise(paired)

    return F.concat(F.array(count), F.flatten(F.transform(expected, of_item)))


def _pairs_of(name: Column, expected: Column, record: Column) -> Column:
    """Comparisons of one expected field: one, or several for line items."""
    actual = F.try_element_at(record, name)
    lists = F.struct(
        F.try_variant_get(expected, "$", "array<variant>").alias("expected"),
        F.coalesce(F.try_variant_get(actual, "$", "array<variant>"), F.array().cast("array<variant>")).alias("actual"),
    )
    no_list = _pair(name, name, expected, actual, F.lit(False), "'line_items' must be a list")
    items = _once(lists, lambda both: F.when(both["expected"].isNull(), F.array(no_list)).otherwise(
        line_item_pairs(both["expected"], both["actual"])
    ))
    return F.when(name != "line_items", F.array(_pair(name, name, expected, actual))).otherwise(items)


def with_field_results(gated: DataFrame, tolerance: float = AMOUNT_TOLERANCE) -> DataFrame:
    """Cases with ``field_results``, the list of their comparisons; null where a case could not be used.

    Every case stays in its own row, so equal cases stay apart and nothing is shuffled.
    """
    usable = F.col("status") == "ok"
    staged = gated.withColumns({
        "_members": F.when(usable, F.map_entries(F.try_variant_get("expected", "$", "map<string,variant>"))),
        "_record": F.try_variant_get("record", "$", "map<string,variant>"),
    })
    pairs = F.flatten(F.transform(
        "_members", lambda member: _pairs_of(member["key"], member["value"], F.col("_record"))
    ))
    judged = F.transform(F.transform(pairs, _read), lambda pair: _judged(pair, tolerance))
    told = F.transform(judged, lambda one: one.withField("reason", F.when(~one["matched"], one["reason"])))
    return staged.withColumn("field_results", told).select(*gated.columns, "field_results")


def field_results(gated: DataFrame, tolerance: float = AMOUNT_TOLERANCE) -> DataFrame:
    """One row per compared field of each usable case: field, values, matched and reason."""
    # Spark would ask before `inline` whether the list has entries, and compute it for that again and again.
    compared = compute_once(with_field_results(gated, tolerance), {"field_results": F.col("field_results")})
    return compared.select("id", F.inline("field_results"))


CASE_COLUMNS = ("id", "file_path", "status", "error", "details", "used_provider")


def case_results(
    gated: DataFrame, tolerance: float = AMOUNT_TOLERANCE, with_fields: bool = False
) -> DataFrame:
    """Every case with matched and total fields and their share, one row per case.

    A case that could not be used has no counts and no score. With ``with_fields`` each case also
    carries the list of its field results, in order of the fields' names.
    """
    results = F.col("field_results")
    counted = compute_once(
        with_field_results(gated, tolerance),
        {
            "matched_fields": F.size(F.filter(results, lambda one: one["matched"])).cast("bigint"),
            "total_fields": F.size(results).cast("bigint"),
            "field_results": results,
        },
    )
    share = F.coalesce(F.try_divide("matched_fields", "total_fields"), F.lit(0.0))
    ok = F.col("status") == "ok"
    return counted.select(
        *CASE_COLUMNS,
        F.when(ok, F.col("matched_fields")).alias("matched_fields"),
        F.when(ok, F.col("total_fields")).alias("total_fields"),
        F.when(ok, F.bround(share, 4)).alias("score"),
        *([F.coalesce(F.array_sort("field_results"), F.array().cast(RESULTS)).alias("field_results")] if with_fields else []),
    )


def summarize(results: DataFrame) -> DataFrame:
    ok = F.col("status") == "ok"
    scores = F.sum(F.when(ok, F.col("score").cast("decimal(10,4)"))).cast("double")
    return results.agg(
        F.count(F.lit(1)).alias("cases_total"),
        F.count_if(ok).alias("ok_total"),
        F.count_if(~ok).alias("error_total"),
        F.coalesce(F.bround(F.try_divide(scores, F.count_if(ok)), 4), F.lit(0.0)).alias("avg_score"),
    )


def evaluated_providers(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == "ok").groupBy("used_provider").agg(
        F.count(F.lit(1)).alias("ok_total")
    )


def quality_gate(summary: DataFrame, fail_under: float) -> DataFrame:
    """Add ``failed``: true when a limit is set and the average score is below it."""
    below = F.lit(fail_under > 0) & (F.col("avg_score") < fail_under)
    return summary.withColumn("failed", below)
