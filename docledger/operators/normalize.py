"""Raw payload to typed record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions import codes, dates, items, money
from docledger.functions.payload import Members, as_text, is_text, vendor_name
from docledger.rules import RULES, Rules
from docledger.schemas import RECORD_FIELDS

PICKED = [
    "vendor_name", "vendor_tax_id", "invoice_number", "invoice_date", "due_date", "currency",
    "subtotal_amount", "tax_amount", "total_amount", "payment_method", "model_confidence",
    "document_type",
]


def pick_fields(df: DataFrame, rules: Rules = RULES, payload: str = "payload") -> DataFrame:
    """Resolve each field's aliases once, as ``p_<field>`` variants and a list of item members.

    The payload object, and each item, is read in one pass into a struct of its aliased members.
    """
    fields = F.col("_fields")
    known = Members([alias for name in (*PICKED, "line_items") for alias in rules.aliases(name)])
    return df.withColumn("_fields", known.read(F.col(payload))).select(
        *df.columns,
        *[known.pick(fields, rules.aliases(name)).alias(f"p_{name}") for name in PICKED],
        known.pick_list(fields, rules.aliases("line_items"), items.members_of(rules)).alias("p_line_items"),
    )


def amounts(df: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Total, subtotal and tax before clamping: the subtotal falls back to the total, a missing
    tax to their difference, a tax that is no number to zero."""
    clean = rules.clean_money
    return (
        df.withColumn("n_total", money.money(F.col("p_total_amount"), F.lit(0.0), clean))
        .withColumn("n_subtotal", money.money(F.col("p_subtotal_amount"), F.col("n_total"), clean))
        .withColumn(
            "n_tax",
            F.when(
                F.col("p_tax_amount").isNull(),
                money.at_least_zero(F.col("n_total") - F.col("n_subtotal")),
            ).otherwise(
                money.money(
                    F.col("p_tax_amount"),
                    F.lit(0.0) if clean else money.at_least_zero(F.col("n_total") - F.col("n_subtotal")),
                    clean,
                )
            ),
        )
    )


def confidence(rules: Rules = RULES) -> Column:
    default = F.lit(rules.default_confidence)
    return money.unit_range(money.money(F.col("p_model_confidence"), default, rules.clean_money))


def line_items(df: DataFrame, rules: Rules = RULES) -> DataFrame:
    """``n_items``: extracted items, or those recovered from OCR when none has an amount."""
    staged = df.withColumn("_extracted", items.normalize_items("p_line_items", rules))
    recovered = staged.withColumn(
        "_recovered",
        F.when(
            F.col("ocr_text").isNotNull() & ~items.have_amounts(F.col("_extracted")),
            items.recover_from_ocr(F.col("ocr_text"), rules.strict_ocr_lines, rules.ignored_lines),
        ),
    )
    usable = F.when(F.size("_recovered") > 0, F.col("_recovered")).otherwise(F.col("_extracted"))
    kept = items.drop_ignored(usable, rules.ignored_lines) if rules.ignored_lines or rules.reconcile else usable
    return recovered.withColumn("n_items", kept).drop("_extracted", "_recovered")


def reconcile(
    df: DataFrame, column: str, target: Column, tolerance: float = RULES.amount_tolerance
) -> DataFrame:
    """Where items add up to more than the target, keep those that fill it best."""
    return (
        df.withColumn("_keep", items.kept_positions(F.col(column), target, tolerance))
        .withColumn(column, items.keep_positions(F.col(column), F.col("_keep")))
        .drop("_keep")
    )


def _type_errors(checks: list[tuple[str, Column]], item_list: Column) -> Column:
    """Places where the record schema wants text and the payload holds something else."""
    found = [
        F.when(bad, F.struct(F.lit(loc).alias("loc"), F.lit("string_type").alias("type")))
        for loc, bad in checks
    ]
    in_items = F.transform(
        item_list,
        lambda item, place: F.when(
            ~item["text_category"],
            F.struct(
                F.concat(F.lit("line_items."), place.cast("string"), F.lit(".category")).alias("loc"),
                F.lit("string_type").alias("type"),
            ),
        ),
    )
    any_bad = F.exists(item_list, lambda item: ~item["text_category"])
    for _, bad in checks:
        any_bad = any_bad | bad
    errors = F.filter(F.concat(F.array(*found), in_items), lambda error: error.isNotNull())
    return F.when(any_bad, errors).otherwise(F.array().cast("array<struct<loc:string,type:string>>"))


def coerce(
    df: DataFrame, as_of: str, rules: Rules = RULES, payload: str = "payload"
) -> DataFrame:
    """Payload and ``ocr_text`` to the fourteen record fields plus ``type_errors``.

    One narrow stage: aliases are resolved once, then typed, and nothing is shuffled. ``as_of``
    (yyyy-MM-dd) stands for today where a document has no date.
    """
    keep = [name for name in df.columns if name not in RECORD_FIELDS]
    picked = amounts(pick_fields(df, rules, payload), rules)
    texts = picked.withColumns({
        f"t_{name}": as_text(F.col(f"p_{name}"))
        for name in ("invoice_date", "due_date", "currency", "payment_method", "document_type",
                     "vendor_tax_id", "invoice_number")
    }).withColumn("t_vendor_name", vendor_name(F.col("p_vendor_name"), rules.vendor_objects))
    listed = line_items(texts, rules)
    if rules.reconcile:
        target = F.when(F.col("n_subtotal") > 0, F.col("n_subtotal")).otherwise(F.col("n_total"))
        listed = reconcile(listed, "n_items", target, rules.amount_tolerance)
    if rules.infer_currency:
        vendor = as_text(F.col("p_vendor_name"))
        currency = codes.infer_currency(
            F.col("t_currency"), vendor, F.col("t_invoice_number"), F.col("ocr_text")
        )
    else:
        currency = codes.currency_code(F.col("t_currency"), rules.default_currency)
    checks = [
        (name, F.col(f"p_{name}").isNotNull() & ~is_text(F.col(f"p_{name}")))
        for name in ("vendor_tax_id", "invoice_number")
    ]
    if not rules.vendor_objects:
        checks.append(
            ("vendor_name", F.col("p_vendor_name").isNotNull() & ~is_text(F.col("p_vendor_name")))
        )
    months = rules.month_names
    return listed.withColumn("model_confidence", confidence(rules)).select(
        *keep,
        codes.document_type(F.col("t_document_type"), rules.default_document_type).alias("document_type"),
        F.col("t_vendor_name").alias("vendor_name"),
        F.col("t_vendor_tax_id").alias("vendor_tax_id"),
        F.col("t_invoice_number").alias("invoice_number"),
        dates.invoice_date(F.col("t_invoice_date"), F.col("ocr_text"), as_of, months).alias("invoice_date"),
        dates.parse_date(F.col("t_due_date"), months).alias("due_date"),
        currency.alias("currency"),
        money.at_least_zero(F.col("n_subtotal")).alias("subtotal"),
        money.at_least_zero(F.col("n_tax")).alias("tax_amount"),
        money.at_least_zero(F.col("n_total")).alias("total_amount"),
        codes.payment_method(F.col("t_payment_method"), rules.payment_keywords).alias("payment_method"),
        items.public_items(F.col("n_items")).alias("line_items"),
        "model_confidence",
        F.col("model_confidence").alias("validation_score"),
        _type_errors(checks, F.col("n_items")).alias("type_errors"),
    )
