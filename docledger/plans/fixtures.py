"""Domain tables derived from the order tables, in which ``k`` is the order key.

Every rule is integer arithmetic on keys, so the same table can be stated in plain SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.operators.route import ledger_rows, route
from docledger.operators.validate import validate_and_score
from docledger.session import configure, work_folder
from docledger.sources.readers import read_ledger
from docledger.sources.sinks import write_ledger

AS_OF = "2026-01-01"


def order_key() -> Column:
    return F.col("k")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def every(n: int, rest: int = 0) -> Column:
    return order_key() % n == rest


def choose(n: int, *values: Column | str) -> Column:
    """The value at place ``k % n``."""
    result = None
    for rest, value in enumerate(values):
        value = F.lit(value) if isinstance(value, str) else value
        result = F.when(every(n, rest), value) if result is None else result.when(every(n, rest), value)
    return result


def numbered(prefix: str, value: Column | None = None, suffix: str = "") -> Column:
    value = order_key() if value is None else value
    return F.concat(F.lit(prefix), value.cast("string"), F.lit(suffix))


def file_id(value: Column) -> Column:
    return numbered("inbox/", value, ".pdf")


def file_hash(value: Column) -> Column:
    twin = F.when(value % 13 == 0, 1).otherwise(0)
    return F.sha2((value - twin).cast("string"), 256)


def euros(cents: Column) -> Column:
    return cents / F.lit(100.0)


def two_digits(cents: Column) -> Column:
    """Cents as text with two decimals."""
    return F.concat(
        F.floor(cents / 100).cast("string"),
        F.lit("."),
        F.lpad((cents % 100).cast("string"), 2, "0"),
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """The orders as they lie, without the texts that follow from the key: those need not be moved by joins."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderstatus").alias("orderstatus"),
        F.col("o_totalprice").alias("totalprice"),
        F.col("o_orderdate").alias("ordered_at"),
    )


def names_of_key() -> list[Column]:
    key = order_key()
    return [numbered("doc-", key).alias("document_id"), file_id(key).alias("drive_file_id"), file_hash(key).alias("file_hash")]


def order_keys(spark: SparkSession, folder: str) -> DataFrame:
    return orders(spark, folder).select("*", *names_of_key())


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: its lines in order."""
    # Lists do not shrink on the map side, so lines are divided by document before they are gathered.
    lines = table(spark, folder, "lineitem").join(
        table(spark, folder, "part").select("p_partkey", "p_name", "p_type"),
        F.col("l_partkey") == F.col("p_partkey"),
    ).repartition("l_orderkey")
    cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    ordered = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "p_name", "p_type",
        cents.alias("cents"),
    )
    grouped = lines.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.array_sort(F.collect_list(ordered)).alias("_lines"), F.sum(cents).alias("cents")
    )
    unit = lambda line: F.floor(line["cents"] / line["l_quantity"]).cast("bigint")
    return grouped.select(
        "k",
        "cents",
        F.transform(
            "_lines",
            lambda line: F.struct(
                line["p_name"].alias("description"),
                line["l_quantity"].alias("quantity"),
                euros(unit(line)).alias("unit_price"),
                euros(line["cents"]).alias("line_total"),
                line["p_type"].alias("category"),
            ),
        ).alias("line_items"),
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return document_lines(spark, folder).select(
        "k", F.posexplode("line_items").alias("_place", "_line")
    ).select("k", (F.col("_place") + 1).cast("bigint").alias("line_no"), "_line.*")


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """One record per order that has lines."""
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("custkey"), "c_name", "c_nationkey"
    )
    tax = F.floor(F.col("cents") / 10).cast("bigint")
    extra = F.when(every(17), 999).otherwise(0)
    unnamed = every(19)
    nation = F.col("c_nationkey") % 5
    # Customers meet the narrow orders, before lists of lines are in the rows.
    return (
        orders(spark, folder).drop("totalprice")
        .join(customers, "custkey", "left")
        .join(document_lines(spark, folder), "k")
        .select(
            "k", *names_of_key(), "ordered_at", "orderstatus",
            F.when(every(5), "receipt").otherwise("invoice").alias("document_type"),
            F.when(~every(31), F.col("c_name")).alias("vendor_name"),
            F.when(every(7) & ~unnamed, numbered("TIN-")).alias("vendor_tax_id"),
            F.when(~unnamed, numbered("INV-")).alias("invoice_number"),
            F.col("ordered_at").cast("date").alias("invoice_date"),
            F.lit(None).cast("date").alias("due_date"),
            F.when(nation == 0, "USD").when(nation == 1, "EUR").when(nation == 2, "GBP")
            .when(nation == 3, "BDT").otherwise("INR").alias("currency"),
            euros(F.col("cents")).alias("subtotal"),
            euros(tax).alias("tax_amount"),
            euros(F.col("cents") + tax + extra).alias("total_amount"),
            choose(4, "card", "cash", "bank", "unknown").alias("payment_method"),
            "line_items",
            ((order_key() % 70 + 30).cast("double") / 100).alias("model_confidence"),
            ((order_key() % 70 + 30).cast("double") / 100).alias("validation_score"),
            choose(4, "mistral", "openrouter", "groq", "openrouter").alias("provider"),
        )
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Records with some defects that the schema or the rules find."""
    def zeroed(item: Column) -> Column:
        return item.withField("unit_price", F.lit(0.0)).withField("line_total", F.lit(0.0))

    no_quantity = F.transform(
        "line_items",
        lambda item, place: F.when(place == 0, item.withField("quantity", F.lit(0.0))).otherwise(item),
    )
    return truth(spark, folder).withColumns({
        "vendor_name": F.coalesce("vendor_name", F.lit("Unknown Vendor")),
        "currency": F.when(every(47), F.lower("currency")).otherwise(F.col("currency")),
        "total_amount": F.when(every(59), F.lit(-1.0)).otherwise(F.col("total_amount")),
        "line_items": F.when(every(53), no_quantity)
        .when(every(23), F.transform("line_items", zeroed))
        .otherwise(F.col("line_items")),
        "error_code": F.lit(None).cast("string"),
        "error_message": F.lit(None).cast("string"),
    })


def routed(spark: SparkSession, folder: str) -> DataFrame:
    return route(validate_and_score(records(spark, folder)))


_LEDGERS: dict[tuple[str, str], str] = {}


def ledger_path(spark: SparkSession, folder: str) -> str:
    """Where the ledger lies in its files, by month; written once per application and folder of tables."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _LEDGERS:
        path = work_folder(spark, "ledger")
        write_ledger(made_ledger(spark, folder), path)
        _LEDGERS[key] = path
    return _LEDGERS[key]


def stored_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return read_ledger(configure(spark), ledger_path(spark, folder))


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return stored_ledger(spark, folder).drop("processing_month")


def made_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Stored documents as ledger rows; orders that are finished count as archived."""
    stored = ledger_rows(routed(spark, folder), F.col("ordered_at"), "k", "orderstatus")
    return stored.select(
        F.col("k").alias("id"), "drive_file_id", "file_hash",
        F.when(F.col("orderstatus") == "F", "ARCHIVED").otherwise(F.col("status")).alias("status"),
        "record_json", "metadata_json", "processed_at_utc",
    )


def payload_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Raw model output per document: aliases, number formats and dates vary with ``k``."""
    source = truth(spark, folder)
    dollars = lambda name: F.concat(F.lit("$"), F.format_number(F.col(name), 2))
    day = F.col("invoice_date")
    shown_date = choose(
        6,
        F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd-MM-yyyy"),
        F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "M/d/yyyy"),
        F.date_format(day, "MMMM d, yyyy"), F.date_format(day, "MMM  d, yyyy"),
    )
    extracted = F.when(every(11), F.concat("line_items", F.slice("line_items", 1, 1))).otherwise(
        F.col("line_items")
    )
    total_line = F.array(F.struct(
        F.lit("Subtotal").alias("description"), F.lit(1.0).alias("quantity"),
        F.col("subtotal").alias("unit_price"), F.col("subtotal").alias("line_total"),
        F.lit(None).cast("string").alias("category"),
    ))
    with_total = F.when(every(8), F.concat("_items", total_line)).otherwise(F.col("_items"))
    without_amounts = F.transform("_items", lambda item: item.withField(
        "unit_price", F.lit(0.0)).withField("line_total", F.lit(0.0)))
    staged = (
        source.withColumn("_items", extracted)
        .withColumn("_items", with_total)
        .withColumn("_items", F.when(every(23), without_amounts).otherwise(F.col("_items")))
    )
    as_texts = F.transform("_items", lambda item: F.struct(
        F.concat(item["description"], F.lit(" ")).alias("name"),
        item["quantity"].alias("qty"),
        F.concat(F.lit("$"), F.format_number(item["unit_price"], 2)).alias("price"),
        F.concat(F.lit("$"), F.format_number(item["line_total"], 2)).alias("amount"),
        item["category"].alias("category"),
    ))
    even = every(2)
    has_tax = ~every(14)
    has_subtotal = ~every(22)
    dated = ~every(43)

    def when(condition: Column, value: Column, name: str) -> Column:
        return F.when(condition, value).alias(name)

    number = F.col("invoice_number")
    vendor = F.col("vendor_name")
    currency = F.when(every(47), F.lit("dollars")).when(even, F.lower("currency")).otherwise(F.col("currency"))
    fields = [
        F.when(every(10, 3), "Statement").when(every(5), "RECEIPT").otherwise("invoice").alias("document_type"),
        when(every(6), F.struct(vendor.alias("name")), "vendor"),
        when(every(3, 1), vendor, "vendor_name"),
        when(every(3, 2) | every(6, 3), vendor, "merchant_name"),
        when(even, F.col("vendor_tax_id"), "tax_id"),
        when(~even, F.col("vendor_tax_id"), "gstin"),
        when(every(3), number, "invoice_number"), when(every(3, 1), number, "receipt_no"),
        when(every(3, 2), number, "order_id"),
        when(dated & every(3), shown_date, "invoice_date"), when(dated & every(3, 1), shown_date, "date_paid"),
        when(dated & every(3, 2), shown_date, "order_date"),
        when(every(10), F.date_format(F.date_add(day, 30), "yyyy-MM-dd"), "due_on"),
        when(every(3), currency, "currency"), when(~every(3), currency, "currency_code"),
        when(has_subtotal & even, dollars("subtotal"), "sub_total"),
        when(has_subtotal & ~even, F.col("subtotal"), "net_amount"),
        when(has_tax & even, dollars("tax_amount"), "vat"),
        when(has_tax & ~even, F.col("tax_amount"), "tax_amount"),
        when(every(6, 0), dollars("total_amount"), "order_total"),
        when(every(6, 1), F.col("total_amount"), "total_amount"),
        when(every(6, 2), dollars("total_amount"), "grand_total"),
        when(every(6, 3), F.col("total_amount"), "total_due"),
        when(every(6, 4), dollars("total_amount"), "amount_paid"),
        when(every(6, 5), F.col("total_amount"), "invoice_total"),
        choose(4, "Visa ending 1234", "COD", "Wire", "Bitcoin").alias("payment_mode"),
        when(every(2, 1) & every(3), F.col("_items"), "line_items"),
        when(every(2, 1) & every(3, 1), F.col("_items"), "items"),
        when(every(2, 1) & every(3, 2), F.col("_items"), "products"),
        when(even & every(3), as_texts, "details"),
        when(even & every(3, 1), as_texts, "charges"),
        when(even & every(3, 2), as_texts, "invoice_lines"),
        when(every(2), F.col("model_confidence"), "confidence"),
        when(every(2, 1), F.col("model_confidence"), "extraction_confidence"),
    ]
    return staged.select(
        "k", "document_id", "drive_file_id", "file_hash", "ordered_at",
        F.to_json(F.struct(*fields)).alias("raw_text"),
        ocr_pages_of(F.col("line_items"), F.col("invoice_date")).alias("pages"),
    )


def ocr_pages_of(items: Column, day: Column) -> Column:
    """A header page, then three lines per page, with a blank page in some documents."""
    def show(item: Column) -> Column:
        return F.concat_ws(
            " ", item["description"], item["quantity"].cast("bigint").cast("string"),
            two_digits(F.rint(item["unit_price"] * 100).cast("bigint")),
            two_digits(F.rint(item["line_total"] * 100).cast("bigint")),
        )

    shown = F.transform(items, show)
    starts = F.sequence(F.lit(1), F.size(items), F.lit(3))
    body = F.transform(starts, lambda start: F.array_join(F.slice(shown, start, F.lit(3)), "\n"))
    header = F.concat(F.lit("Invoice "), order_key().cast("string"), F.lit("\nDate "), F.date_format(day, "dd/MM/yyyy"))
    blank = F.when(every(9), F.array(F.lit("  \n"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(header), blank, body)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Payload as variant, with the full OCR text."""
    nonblank = F.filter("pages", lambda page: F.btrim(page, F.lit(" \n")) != "")
    return payload_texts(spark, folder).select(
        "k", "document_id", "drive_file_id", "file_hash", "ordered_at",
        F.try_parse_json("raw_text").alias("payload"),
        F.array_join(nonblank, "\n\n").alias("ocr_text"),
    )


def ocr_pages(spark: SparkSession, folder: str) -> DataFrame:
    return payload_texts(spark, folder).select(
        "document_id", F.posexplode("pages").alias("page_no", "markdown")
    )


def short_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A small payload and one OCR page per order."""
    return order_keys(spark, folder).select(
        "k", "document_id",
        F.concat(F.lit('{"total": '), order_key().cast("string"), F.lit("}")).alias("raw_text"),
        F.array(numbered("Invoice ")).alias("pages"),
    )


def attempts(source: DataFrame) -> DataFrame:
    """Provider calls per document: failures before the provider that answers, bad JSON in some
    first answers and in some corrective ones."""
    bad = F.when(every(29), F.lit("not json")).when(every(37), F.lit("[1, 2]"))
    still_bad = F.when(every(58), F.lit("still not json")).when(every(74), F.lit("[3]"))
    ocr = F.array_join(F.filter("pages", lambda page: F.btrim(page, F.lit(" \n")) != ""), "\n\n")
    answers = choose(4, F.lit(0), F.lit(1), F.lit(2), F.lit(1))

    def call(place: int, name: str, kind: str, text: Column) -> Column:
        fails = (F.lit(place) < F.col("_answers")) | every(41)
        wanted = (F.lit(place) <= F.col("_answers")) | every(41)
        if kind == "corrective":
            wanted = wanted & F.col("_bad").isNotNull() & ~every(41)
        return F.when(wanted, F.struct(
            F.lit(name).alias("provider"),
            F.lit(kind).alias("prompt_kind"),
            F.when(~fails, text).alias("raw_text"),
            (F.when(~fails, ocr) if name == "mistral" else F.lit(None).cast("string")).alias("ocr_text"),
            F.when(fails, F.concat(F.lit("status "), (order_key() % 3 + 500).cast("string"))).alias("error"),
        ))

    order = list(enumerate(["mistral", "openrouter", "groq"]))
    staged = source.withColumns({"_bad": bad, "_answers": answers})
    calls = [
        call(place, name, "first", F.coalesce("_bad", "raw_text")) for place, name in order
    ] + [
        call(place, name, "corrective", F.coalesce(still_bad, "raw_text")) for place, name in order
    ]
    made = F.filter(F.array(*calls), lambda entry: entry.isNotNull())
    return staged.select("k", "document_id", F.explode(made).alias("_call")).select(
        "k", "document_id", "_call.*"
    )


def claims(spark: SparkSession, folder: str) -> DataFrame:
    return order_keys(spark, folder).where(~every(10, 7)).select(
        "drive_file_id", "file_hash",
        choose(5, "STORED", "ARCHIVED", "FAILED", "REVIEW_REQUIRED", "CLAIMED").alias("status"),
        numbered("worker-", order_key() % 3).alias("owner_id"),
        F.col("ordered_at").cast("string").alias("claimed_at_utc"),
        F.col("ordered_at").cast("string").alias("updated_at_utc"),
    )


def claim_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """One claim attempt per order and a second one for every third order."""
    places = F.when(every(3), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return order_keys(spark, folder).select(
        "k", "drive_file_id", "file_hash", F.explode(places).alias("_place")
    ).select(
        "drive_file_id", "file_hash",
        numbered("poll-", (order_key() + F.col("_place")) % 4).alias("owner_id"),
        (order_key() * 2 + F.col("_place")).alias("arrival"),
    )


def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    event = F.col("event_id")
    key = event % 500
    known = event % 25 != 0
    return table(spark, folder, "events").where(F.col("event_type") == "error").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("recorded_at_utc"),
        F.when(event % 40 != 0, numbered("doc-", key)).alias("document_id"),
        F.when(known, file_id(key)).alias("drive_file_id"),
        F.when(known, file_hash(key)).alias("file_hash"),
        F.when(event % 3 == 0, "REVIEW_REQUIRED").when(event % 31 == 0, "QUEUED").otherwise("FAILED").alias("status"),
        F.when(event % 4 != 0, F.lit("invalid_json")).alias("error_code"),
        F.when(event % 5 == 0, F.lit("Model returned invalid JSON")).alias("error_message"),
        F.when(event % 6 != 0, F.lit("mistral")).alias("used_provider"),
        event.alias("seq"),
    )


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metric log: whole numbers, some booleans, some fractions that must not count."""
    event = F.col("event_id")
    whole = F.col("value").cast("bigint").cast("string")
    text = (
        F.when(event % 4 == 0, F.concat(whole, F.lit(".25")))
        .when(event % 10 == 0, F.lit("true"))
        .otherwise(whole)
    )
    return table(spark, folder, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("recorded_at_utc"),
        F.when(event % 101 != 0, F.concat(F.lit("documents_"), "event_type", F.lit("_total"))).alias("metric"),
        F.parse_json(text).alias("value"),
        F.lit("poll_once").alias("stage"),
        (event % 997).alias("latency_ms"),
        "event_type",
    )


STATES = ["NEW", "CLAIMED", "EXTRACTED", "VALIDATED", "REVIEW_REQUIRED", "STORED", "ARCHIVED", "FAILED", "MISSING"]


def status_log(spark: SparkSession, folder: str) -> DataFrame:
    event = F.col("event_id")
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), ((event * 7 + F.col("user_id")) % 9 + 1).cast("int"))
    return table(spark, folder, "events").select(
        numbered("doc-", F.col("user_id")).alias("document_id"),
        F.when(event % 7 == 0, F.concat(F.lit(" "), F.lower(state))).otherwise(state).alias("status"),
        "ts",
        event.alias("seq"),
    )


def _review_record() -> Column:
    return F.struct(
        F.lit("invoice").alias("document_type"),
        numbered("Vendor ", F.col("custkey")).alias("vendor_name"),
        F.when(~every(21), numbered("INV-")).alias("invoice_number"),
        F.date_format("ordered_at", "yyyy-MM-dd").alias("invoice_date"),
        F.when(every(27), "usd").otherwise("USD").alias("currency"),
        F.col("totalprice").alias("subtotal"),
        F.lit(0.0).alias("tax_amount"),
        F.when(every(12), F.col("totalprice") + 5).otherwise(F.col("totalprice")).alias("total_amount"),
        F.lit("card").alias("payment_method"),
        F.array().cast("array<string>").alias("line_items"),
        F.lit(0.4).alias("model_confidence"),
        F.lit(0.4).alias("validation_score"),
    )


def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Review items for every third order, in all states."""
    status = (
        F.when(every(4), "REVIEW_REQUIRED").when(every(4, 1), "RESOLVED_STORED")
        .when(every(4, 2), "RESOLVED_DUPLICATE").otherwise("REJECTED")
    )
    reasons = (
        F.when(every(15), F.array().cast("array<string>"))
        .when(every(8), F.array(F.lit("validation_failed")))
        .otherwise(F.array(F.lit("validation_failed"), F.lit("low_confidence")))
    )
    hashed = F.when(every(33), F.lit("")).otherwise(F.col("file_hash"))
    metadata = F.struct(
        F.when(~every(18), F.col("drive_file_id")).alias("source_file_id"),
        F.when(every(18) & ~every(36), F.col("drive_file_id")).alias("drive_file_id"),
        hashed.alias("file_hash"),
        F.when(~every(24), F.lit("mistral")).alias("used_provider"),
        _review_record().alias("normalized_record"),
    )
    active = every(4)
    resolved = F.when(every(4, 1) | every(4, 2), _review_record())
    return order_keys(spark, folder).where(every(3)).select(
        "document_id",
        status.alias("status"),
        reasons.alias("reason_codes"),
        F.date_format("ordered_at", "yyyy-MM-dd HH:mm:ss").alias("created_at_utc"),
        F.when(~active & ~every(7), F.date_format(F.col("ordered_at") + F.expr("interval 1 day"), "yyyy-MM-dd HH:mm:ss")).alias("resolved_at_utc"),
        F.lit(None).cast("string").alias("source_file_moved_to"),
        F.parse_json(F.to_json(metadata)).alias("metadata"),
        F.parse_json(F.to_json(resolved)).alias("resolved_record"),
        F.lit(None).cast("variant").alias("storage_result"),
        F.when(~active & ~every(5), numbered("checked ")).alias("resolution_note"),
    )


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Review decisions for every second order key, some for items that do not exist."""
    action = (
        F.when(every(10, 8), "postpone")
        .when(F.floor(order_key() / 60) % 3 == 0, " Approve").when(F.floor(order_key() / 60) % 3 == 1, "reject").otherwise("duplicate")
    )
    override = F.when(
        every(5) & ~every(60),
        F.struct(
            F.lit("receipt").alias("document_type"),
            numbered("Fixed ").alias("vendor_name"),
            F.lit("2026-02-27").alias("invoice_date"),
            F.lit("EUR").alias("currency"),
            F.col("totalprice").alias("subtotal"),
            F.lit("0").alias("tax_amount"),
            F.col("totalprice").alias("total_amount"),
            F.lit(0.9).alias("model_confidence"),
            F.lit(0.9).alias("validation_score"),
        ),
    )
    return order_keys(spark, folder).where(every(2)).select(
        "document_id",
        action.alias("action"),
        F.parse_json(F.to_json(override)).alias("record_override"),
        F.when(~every(14), numbered("note ")).alias("note"),
    )


def golden(spark: SparkSession, folder: str) -> DataFrame:
    """Expected records: part of the truth with known differences."""
    source = truth(spark, folder)
    total = (
        F.when(every(4, 1), F.col("total_amount") + 0.004)
        .when(every(4, 2), F.col("total_amount") + 0.5)
        .otherwise(F.col("total_amount"))
    )
    listed = F.when(every(6), F.slice("line_items", F.lit(1), F.size("line_items") - 1)).otherwise(F.col("line_items"))
    items = F.transform(
        listed,
        lambda item: F.struct(
            F.upper(item["description"]).alias("description"), item["quantity"].alias("quantity"),
            item["line_total"].alias("line_total"),
        ),
    )
    expected = F.struct(
        F.concat(F.lit("  "), F.upper("vendor_name")).alias("vendor_name"),
        F.date_format("invoice_date", "yyyy-MM-dd").alias("invoice_date"),
        F.when(every(7), F.lit("ZZZ")).otherwise(F.col("currency")).alias("currency"),
        total.alias("total_amount"),
        F.when(every(3), items).alias("line_items"),
    )
    text = (
        F.when(every(51), F.lit("{}")).when(every(52), F.lit("[1]"))
        .when(every(55), F.lit('{"line_items": 5}'))
        .otherwise(F.to_json(expected))
    )
    return source.select(
        "k",
        numbered("case-").alias("id"),
        F.when(every(50), numbered("missing/")).otherwise(F.col("drive_file_id")).alias("file_path"),
        text.alias("expected_text"),
        F.parse_json(text).alias("expected"),
    )


def evaluated_documents(spark: SparkSession, folder: str) -> DataFrame:
    """What the normaliser made of each document; some failed in extraction."""
    return truth(spark, folder).select(
        F.col("drive_file_id").alias("file_path"),
        F.when(every(41), F.lit("all_providers_failed")).alias("error_code"),
        F.when(every(41), F.lit("All configured providers failed: ")).alias("error_message"),
        F.col("provider").alias("used_provider"),
        F.to_variant_object(F.struct(
            "document_type", F.coalesce("vendor_name", F.lit("Unknown Vendor")).alias("vendor_name"),
            "vendor_tax_id", "invoice_number",
            F.date_format("invoice_date", "yyyy-MM-dd").alias("invoice_date"),
            "currency", "subtotal", "tax_amount", "total_amount", "payment_method", "line_items",
            "model_confidence", "validation_score",
        )).alias("record"),
    )


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """Object listing with the file names of an inbox."""
    ending = choose(6, ".pdf", ".JPG", ".jpeg", ".png", ".txt", "/")
    name = F.when(every(60), F.lit("inbox/.pdf")).when(every(48), numbered("inbox/", order_key(), ".pdf.gz")).when(
        every(49), F.lit("")).otherwise(F.concat(numbered("inbox/sub", order_key() % 7, "/"), (order_key() % 1000).cast("string"), ending))
    return order_keys(spark, folder).select(
        name.alias("id"), (order_key() * 3).alias("size"), F.col("ordered_at").alias("last_modified"), "k"
    )


def inbox_tree(spark: SparkSession, folder: str) -> str:
    """The inbox as files and empty folders in the work folder, written by the executors; each file repeats its id three times."""
    root = work_folder(spark, "inbox")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for id_ in batch.column("id").to_pylist():
                store.create_dir(f"{base}/{id_.rpartition('/')[0]}")
                if not id_.endswith("/"):
                    with store.open_output_stream(f"{base}/{id_}", compression=None) as out:
                        out.write(id_.encode() * 3)
            yield batch

    kept = inbox(spark, folder).where("id <> ''").select("id").distinct()
    archived = kept.limit(10).select(F.concat(F.lit("archive/"), "id").alias("id"))  # beside the inbox, so never listed
    kept.unionByName(archived).mapInArrow(write, "id string").write.format("noop").mode("overwrite").save()
    return root


def vendor_names(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    name = (
        F.when(key % 8 == 0, F.concat(F.lit("AMZN*Mktp "), "c_name"))
        .when(key % 8 == 1, F.concat(F.lit("Wal-Mart #"), key.cast("string")))
        .when(key % 8 == 2, F.concat(F.lit("  Star.bucks "), "c_name"))
        .when(key % 8 == 3, F.concat(F.lit("WM Supercenter "), "c_name"))
        .otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))
    )
    return table(spark, folder, "customer").select(key.alias("vendor_key"), name.alias("vendor_name"))
