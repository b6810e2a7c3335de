"""Schema check, business rules and score of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions import checks
from docledger.functions.money import PLAIN_NUMBER
from docledger.functions.payload import as_text, is_object
from docledger.functions.text import strip
from docledger.rules import AMOUNT_TOLERANCE
from docledger.schemas import RECORD_FIELDS

TEXT_FIELDS = ["vendor_name", "document_type", "currency", "payment_method"]
OPTIONAL_TEXT = ["vendor_tax_id", "invoice_number"]
NUMBER_FIELDS = ["subtotal", "tax_amount", "total_amount", "model_confidence", "validation_score"]
ITEM_NUMBERS = ["quantity", "unit_price", "line_total"]
ISO_DATE = r"^(?!0000)\d{4}-\d{2}-\d{2}\z"


def _kind(value: Column) -> Column:
    """Type name of a variant: STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, OBJECT, ARRAY or VOID."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _number(value: Column) -> Column:
    text = strip(as_text(value))
    return (
        F.when(_kind(value) == "STRING", F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double")))
        .when(_kind(value).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"),
              F.try_variant_get(value, "$", "double"))
    )


def _wrong(value: Column, read: Column, loc: Column, kind: str) -> Column:
    return F.when(
        value.isNotNull() & read.isNull(), F.struct(loc.alias("loc"), F.lit(kind).alias("type"))
    )


def read_record(df: DataFrame, record: str = "record") -> DataFrame:
    """A variant record (such as a corrected one) to record columns plus ``type_errors``.

    Numbers may come as numeric text; dates must be ISO; other texts must be texts.
    """
    raw = F.col(record)

    def field(value: Column, name: str) -> Column:
        return F.try_variant_get(value, f"$['{name}']", "variant")

    staged = df.withColumns({f"r_{name}": field(raw, name) for name in RECORD_FIELDS}).withColumn(
        "r_items", F.try_variant_get(F.col("r_line_items"), "$", "array<variant>")
    )
    read: dict[str, Column] = {}
    errors = []
    for name in TEXT_FIELDS + OPTIONAL_TEXT:
        value = F.col(f"r_{name}")
        optional = name in OPTIONAL_TEXT
        read[name] = F.when(_kind(value) == "STRING", as_text(value))
        allowed = F.when(_kind(value) == "VOID", F.lit("")) if optional else F.lit(None)
        errors.append(_wrong(value, F.coalesce(read[name], allowed), F.lit(name), "string_type"))
    read["payment_method"] = F.when(F.col("r_payment_method").isNull(), F.lit("unknown")).otherwise(
        read["payment_method"]
    )
    for name in ("invoice_date", "due_date"):
        value = F.col(f"r_{name}")
        text = as_text(value)
        read[name] = F.when(
            (_kind(value) == "STRING") & text.rlike(ISO_DATE), text.try_cast("date")
        )
        allowed = F.when(_kind(value) == "VOID", F.lit("1970-01-01").cast("date"))
        tolerated = F.coalesce(read[name], allowed) if name == "due_date" else read[name]
        errors.append(_wrong(value, tolerated, F.lit(name), "date_parsing"))
    for name in NUMBER_FIELDS:
        value = F.col(f"r_{name}")
        read[name] = _number(value)
        errors.append(_wrong(value, read[name], F.lit(name), "float_parsing"))
    errors.append(_wrong(F.col("r_line_items"), F.col("r_items"), F.lit("line_items"), "list_type"))

    def item_columns(item: Column) -> Column:
        description = field(item, "description")
        category = field(item, "category")
        return F.struct(
            F.when(_kind(description) == "STRING", as_text(description)).alias("description"),
            *[_number(field(item, name)).alias(name) for name in ITEM_NUMBERS],
            F.when(_kind(category) == "STRING", as_text(category)).alias("category"),
        )

    def item_errors(item: Column, place: Column) -> Column:
        def at(name: str) -> Column:
            return F.concat(F.lit("line_items."), place.cast("string"), F.lit(f".{name}"))

        category = field(item, "category")
        description = field(item, "description")
        return F.array(
            F.when(~is_object(item), F.struct(
                F.concat(F.lit("line_items."), place.cast("string")).alias("loc"),
                F.lit("model_type").alias("type"),
            )),
            _wrong(description, F.when(_kind(description) == "STRING", F.lit("")),
                   at("description"), "string_type"),
            _wrong(category, F.when(_kind(category).isin("STRING", "VOID"), F.lit("")),
                   at("category"), "string_type"),
            *[_wrong(field(item, n), _number(field(item, n)), at(n), "float_parsing")
              for n in ITEM_NUMBERS],
        )

    listed = F.coalesce(F.col("r_items"), F.array().cast("array<variant>"))
    found = F.concat(F.array(*errors), F.flatten(F.transform(listed, item_errors)))
    keep = [name for name in df.columns if name not in RECORD_FIELDS]
    read["line_items"] = F.transform(listed, item_columns)
    return staged.select(
        *keep,
        *[read[name].alias(name) for name in RECORD_FIELDS],
        F.filter(found, lambda error: error.isNotNull()).alias("type_errors"),
    )


def check_schema(df: DataFrame) -> DataFrame:
    """Add ``schema_errors``; a record with any is invalid."""
    known = F.col("type_errors") if "type_errors" in df.columns else None
    return df.withColumn("schema_errors", checks.schema_errors(known))


def validate_and_score(df: DataFrame, tolerance: float = AMOUNT_TOLERANCE) -> DataFrame:
    """Add ``schema_errors``, ``violations``, ``is_valid`` and the rule-based score.

    ``validation_score`` is replaced by the score where the schema holds; a record that breaks
    the schema keeps its own and has no rule results.
    """
    checked = check_schema(df).withColumn("schema_ok", F.size("schema_errors") == 0)
    ruled = checked.withColumn("violations", F.when(F.col("schema_ok"), checks.violations(tolerance)))
    return ruled.withColumns({
        "is_valid": F.when(F.col("schema_ok"), checks.is_valid(F.col("violations"))),
        "validation_score": F.when(F.col("schema_ok"), checks.score(F.col("violations"))).otherwise(
            F.col("validation_score")
        ),
    })
