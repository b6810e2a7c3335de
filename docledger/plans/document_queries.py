"""Queries over payloads, normalisation, line items, enrichment, validation and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.functions import checks, codes, dates, items, money
from docledger.functions.payload import as_text, vendor_name
from docledger.operators import enrich, extraction, normalize
from docledger.operators.route import (
    dead_letter_rows, decide, ledger_rows, review_rows, route, run_counters,
)
from docledger.operators.validate import check_schema, validate_and_score
from docledger.plans import fixtures as fx
from docledger.plans.fixtures import AS_OF, choose, every, numbered, order_key
from docledger.plans.registry import query
from docledger.rules import CATEGORY_KEYWORDS, IGNORED_LINE_KEYWORDS, OCR_DIALECT, RULES, VENDOR_NAMES


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part.cast("string") for part in parts])


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


# ---- payload resolution -------------------------------------------------------------------------

@query("pay_parse", """
    SELECT document_id,
           CASE k % 6 WHEN 0 THEN cast(k AS VARCHAR) END AS amount,
           CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'invalid_json' WHEN 5 THEN 'invalid_json'
             ELSE 'invalid_json_shape' END AS parse_error
    FROM fx_orders""", ("fx_orders",))
def pay_parse(spark, folder):
    raw = choose(6, text('{"a": ', order_key(), "}"), "not json", "[1, 2]", text('"', order_key(), '"'), "null", text('{"a": ', order_key()))
    parsed = extraction.parse_payload(fx.order_keys(spark, folder).withColumn("raw_text", raw))
    return parsed.select(
        "document_id", F.try_variant_get("payload", "$.a", "string").alias("amount"), "parse_error"
    )


@query("pay_corrective", """
    SELECT document_id,
           CASE WHEN k % 41 = 0 THEN 'first' WHEN k % 29 = 0 OR k % 37 = 0 THEN 'corrective' ELSE 'first' END AS prompt_kind,
           CASE WHEN k % 41 = 0 THEN 'all_providers_failed' WHEN k % 58 = 0 THEN 'invalid_json'
                WHEN k % 74 = 0 THEN 'invalid_json_shape' END AS error_code,
           CASE WHEN k % 41 <> 0 AND k % 58 <> 0 AND k % 74 <> 0 THEN k END AS total
    FROM fx_orders""", ("fx_orders",))
def pay_corrective(spark, folder):
    calls = fx.attempts(fx.short_texts(spark, folder))
    picked = extraction.pick_corrective(extraction.pair_prompts(calls))
    return picked.select(
        "document_id", "prompt_kind", "error_code",
        F.try_variant_get("payload", "$.total", "bigint").alias("total"),
    )


@query("pay_provider", """
    SELECT document_id, p AS prompt_kind,
           CASE WHEN k % 41 = 0 THEN NULL WHEN k % 4 = 0 THEN 'mistral' WHEN k % 4 = 2 THEN 'groq' ELSE 'openrouter' END AS provider,
           CASE WHEN k % 41 = 0 THEN 'all_providers_failed' END AS error_code,
           CASE WHEN k % 41 = 0 THEN 'All configured providers failed: mistral: status ' || (500 + k % 3)
             || '; openrouter: status ' || (500 + k % 3) || '; groq: status ' || (500 + k % 3) END AS error_message,
           CASE WHEN k % 41 <> 0 AND k % 4 = 0 THEN 'Invoice ' || k END AS ocr_text
    FROM fx_orders, (SELECT unnest(['first', 'corrective']) AS p)
    WHERE p = 'first' OR ((k % 29 = 0 OR k % 37 = 0) AND k % 41 <> 0)""", ("fx_orders",))
def pay_provider(spark, folder):
    calls = fx.attempts(fx.short_texts(spark, folder))
    return extraction.resolve_provider(calls).drop("raw_text")


@query("pay_ocr_pages", """
    SELECT document_id, sha256(header || chr(10) || chr(10) || string_agg(page, chr(10) || chr(10) ORDER BY page_no)) AS ocr_hash
    FROM (SELECT t.document_id, 'Invoice ' || t.k || chr(10) || 'Date ' || strftime(t.invoice_date, '%d/%m/%Y') AS header,
                 (l.line_no - 1) // 3 AS page_no,
                 string_agg(l.description || ' ' || cast(l.quantity AS BIGINT) || ' '
                   || printf('%d.%02d', cast(floor(l.cents / l.quantity) AS BIGINT) // 100, cast(floor(l.cents / l.quantity) AS BIGINT) % 100)
                   || ' ' || printf('%d.%02d', l.cents // 100, l.cents % 100), chr(10) ORDER BY l.line_no) AS page
          FROM fx_truth t JOIN fx_lines l ON l.k = t.k GROUP BY ALL)
    GROUP BY document_id, header""", ("fx_truth",))
def pay_ocr_pages(spark, folder):
    assembled = extraction.assemble_ocr(fx.ocr_pages(spark, folder))
    return assembled.select("document_id", F.sha2("ocr_text", 256).alias("ocr_hash"))


@query("pay_provenance", """
    SELECT document_id, CASE k % 3 WHEN 0 THEN 'mistral' ELSE 'auto' END AS provider,
           CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE ' text ' || k END AS ocr_text
    FROM fx_orders""", ("fx_orders",))
def pay_provenance(spark, folder):
    rows = fx.order_keys(spark, folder).select(
        "document_id",
        choose(3, " Mistral ", "  ", F.lit(None).cast("string")).alias("provider"),
        choose(4, " \n\t", F.lit(None).cast("string"), text(" text ", order_key()), text(" text ", order_key())).alias("ocr_text"),
    )
    return extraction.stamp_provenance(rows, " AUTO ")


@query("pay_content_hash", "SELECT doc_id, sha256(text) AS file_hash FROM documents")
def pay_content_hash(spark, folder):
    documents = fx.table(spark, folder, "documents")
    return extraction.content_hash(documents, "text").select("doc_id", "file_hash")


# ---- normalisation ------------------------------------------------------------------------------

def picked(spark, folder, payload: Column):
    """Orders with the fields picked from a JSON text."""
    rows = fx.order_keys(spark, folder).withColumn("payload", F.parse_json(payload))
    return normalize.pick_fields(rows)


@query("nrm_pick", """
    SELECT document_id,
           CASE WHEN k % 3 = 2 THEN 'A-' || k WHEN k % 2 = 1 THEN cast(k AS VARCHAR) ELSE 'R-' || k END AS invoice_number,
           CASE WHEN k % 5 = 0 THEN 'B-' || k END AS vendor_tax_id,
           CASE k % 4 WHEN 0 THEN '0' WHEN 1 THEN 'false' WHEN 2 THEN '[]' ELSE '{}' END AS due_date
    FROM fx_orders""", ("fx_orders",))
def nrm_pick(spark, folder):
    payload = text(
        '{"invoice_number": ', choose(3, "null", '""', text('"A-', order_key(), '"')),
        F.when(every(2, 1), text(', "order_id": ', order_key())).otherwise(F.lit("")),
        ', "receipt_no": "R-', order_key(), '", "bill_from": ',
        F.when(every(5), text('{"tax_id": "B-', order_key(), '"}')).otherwise(F.lit('"x"')),
        ', "due_date": ', choose(4, "0", "false", "[]", "{}"), "}",
    )
    return picked(spark, folder, payload).select("document_id", *[
        as_text(F.col(f"p_{name}")).alias(name) for name in ("invoice_number", "vendor_tax_id", "due_date")
    ])


@query("nrm_vendor", """
    SELECT document_id,
           CASE k % 6 WHEN 0 THEN 'O-' || k WHEN 2 THEN 'V-' || k WHEN 3 THEN cast(k AS VARCHAR) WHEN 4 THEN '[]'
             ELSE 'Unknown Vendor' END AS vendor_name
    FROM fx_orders""", ("fx_orders",))
def nrm_vendor(spark, folder):
    vendor = choose(
        6, text('{"name": " O-', order_key(), ' "}'), '{"name": " "}', text('"  V-', order_key(), '\\t"'), text(order_key()), "[]", "null"
    )
    rows = picked(spark, folder, text('{"vendor": ', vendor, "}"))
    return rows.select("document_id", vendor_name(F.col("p_vendor_name")).alias("vendor_name"))


@query("nrm_money", """
    SELECT document_id,
           CASE k % 10 WHEN 0 THEN totalprice WHEN 1 THEN totalprice WHEN 2 THEN cast(k AS DOUBLE) WHEN 3 THEN 1.0
             WHEN 4 THEN cast('1.' || lpad(cast(k AS VARCHAR), 5, '0') AS DOUBLE) WHEN 5 THEN 7.5 WHEN 6 THEN 1.0e20 WHEN 7 THEN -2.5 ELSE 7.5 END AS amount
    FROM fx_orders""", ("fx_orders",))
def nrm_money(spark, folder):
    value = choose(
        10,
        text('"USD ', F.format_number("totalprice", 2), '"'), text(F.col("totalprice").cast("decimal(18,2)")),
        text('"(', order_key(), ')"'), "true", text('"1.', F.lpad(order_key().cast("string"), 5, "0"), '"'),
        '"12-"', "1e20", '"- 2.5 kg"', '"1.2.3"', '"n/a"',
    )
    rows = picked(spark, folder, text('{"total": ', value, "}"))
    return rows.select("document_id", money.money(F.col("p_total_amount"), F.lit(7.5)).alias("amount"))


DATE_SQL = """CASE k % 10 WHEN 3 THEN CASE WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END
             WHEN 6 THEN NULL WHEN 7 THEN NULL WHEN 8 THEN NULL ELSE d END"""


def _date_shapes() -> Column:
    day = F.col("ordered_at").cast("date")
    return choose(
        10, text(" ", day_text(day)), F.date_format(day, "d-M-yyyy"), F.date_format(day, "dd/MM/yyyy"),
        F.date_format(day, "M/d/yyyy"), F.upper(F.date_format(day, "MMMM d, yyyy")),
        F.date_format(day, "MMM  dd, yyyy"), F.date_format(day, "dd/MM/yy"), F.date_format(day, "yyyy/MM/dd"),
        "31-02-2024", F.date_format(day, "yyyy-M-d"),
    )


@query("nrm_date", f"""
    SELECT document_id, strftime({DATE_SQL}, '%Y-%m-%d') AS parsed
    FROM (SELECT *, cast(ordered_at AS DATE) AS d FROM fx_orders)""", ("fx_orders",))
def nrm_date(spark, folder):
    rows = fx.order_keys(spark, folder)
    return rows.select("document_id", day_text(dates.parse_date(_date_shapes())).alias("parsed"))


OCR_TOKEN_SQL = r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b"


@query("nrm_ocr_date", f"""
    SELECT doc_id, strftime(list_filter(list_transform(
             regexp_extract_all(text || ' ref 99/99/2020 or 2024/03/01, dated ' || (1 + doc_id % 28) || '/' || (1 + doc_id % 12) || '/2024.', '{OCR_TOKEN_SQL}'),
             lambda t: coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%d-%m-%Y'), try_strptime(t, '%d/%m/%Y'), try_strptime(t, '%m/%d/%Y'))),
             lambda d: d IS NOT NULL)[1], '%Y-%m-%d') AS found
    FROM documents""")
def nrm_ocr_date(spark, folder):
    key = F.col("doc_id")
    read = text(F.col("text"), " ref 99/99/2020 or 2024/03/01, dated ", 1 + key % 28, "/", 1 + key % 12, "/2024.")
    return fx.table(spark, folder, "documents").select("doc_id", day_text(dates.ocr_date(read)).alias("found"))


@query("nrm_invoice_date", """
    SELECT document_id, CASE k % 3 WHEN 0 THEN strftime(ordered_at, '%Y-%m-%d') WHEN 1 THEN strftime(ordered_at, '%Y-%m-%d')
             ELSE '2026-01-01' END AS invoice_date
    FROM fx_orders""", ("fx_orders",))
def nrm_invoice_date(spark, folder):
    shown = F.date_format("ordered_at", "dd/MM/yyyy")
    picked = choose(3, shown, "soon", F.lit(None).cast("string"))
    seen = choose(3, "Date 01/01/1999", text("Paid on ", shown), "no date here")
    return fx.order_keys(spark, folder).select(
        "document_id", day_text(dates.invoice_date(picked, seen, AS_OF)).alias("invoice_date")
    )


@query("nrm_payment", """
    SELECT document_id, CASE k % 6 WHEN 0 THEN 'card' WHEN 1 THEN 'cash' WHEN 2 THEN 'bank' WHEN 3 THEN 'card' ELSE 'unknown' END AS rules,
           CASE k % 6 WHEN 2 THEN 'unknown' WHEN 0 THEN 'unknown' WHEN 1 THEN 'unknown' WHEN 3 THEN 'bank' ELSE 'unknown' END AS older
    FROM fx_orders""", ("fx_orders",))
def nrm_payment(spark, folder):
    value = choose(6, "VISA 4242", "COD", "SEPA wire", "Credit transfer", "Bitcoin", F.lit(None).cast("string"))
    return fx.order_keys(spark, folder).select(
        "document_id",
        codes.payment_method(value, RULES.payment_keywords).alias("rules"),
        codes.payment_method(value, OCR_DIALECT.payment_keywords).alias("older"),
    )


@query("nrm_document_type", """
    SELECT document_id, CASE k % 4 WHEN 0 THEN 'receipt' ELSE 'invoice' END AS document_type FROM fx_orders""", ("fx_orders",))
def nrm_document_type(spark, folder):
    value = choose(4, "RECEIPT", "Invoice", "receipt ", F.lit(None).cast("string"))
    return fx.order_keys(spark, folder).select(
        "document_id", codes.document_type(value, "invoice").alias("document_type")
    )


@query("nrm_currency", """
    SELECT document_id, CASE k % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'US$' WHEN 2 THEN 'BDT' WHEN 3 THEN 'BDT' ELSE 'EUR' END AS currency
    FROM fx_orders""", ("fx_orders",))
def nrm_currency(spark, folder):
    value = choose(5, "usd", "us$", "dollars", F.lit(None).cast("string"), "EUR")
    return fx.order_keys(spark, folder).select(
        "document_id", codes.currency_code(value, "BDT").alias("currency")
    )


@query("nrm_infer_currency", r"""
    SELECT doc_id, CASE WHEN e = '৳' THEN 'BDT' WHEN e = 'euros' THEN 'EUR' WHEN e = 'chf' THEN 'CHF'
             WHEN regexp_matches(u, '\bUSD\b|\bUS\$\b|(^|[^A-Z])\$\s*\d|\bDOLLARS?\b') THEN 'USD'
             WHEN regexp_matches(u, '\bEUR\b|€|\bEUROS?\b') THEN 'EUR'
             WHEN regexp_matches(u, '\bGBP\b|£|\bPOUNDS?\b') THEN 'GBP'
             WHEN regexp_matches(u, '\bBDT\b|৳|\bTAKA\b|(^|[^A-Z])TK\s*[\d.]') THEN 'BDT'
             WHEN regexp_matches(u, '\bINR\b|₹|\bRUPEES?\b') THEN 'INR' ELSE 'BDT' END AS currency
    FROM (SELECT doc_id, e, upper(concat_ws(' ', nullif(e, ''), 'V' || doc_id, text)) AS u
          FROM (SELECT *, CASE doc_id % 7 WHEN 0 THEN '৳' WHEN 1 THEN 'euros' WHEN 2 THEN 'chf' WHEN 3 THEN '12 rupees' END AS e
                FROM documents))""")
def nrm_infer_currency(spark, folder):
    key = F.col("doc_id")
    explicit = F.when(key % 7 == 0, "৳").when(key % 7 == 1, "euros").when(key % 7 == 2, "chf").when(key % 7 == 3, "12 rupees")
    return fx.table(spark, folder, "documents").select(
        "doc_id",
        codes.infer_currency(explicit, text("V", key), F.lit(None).cast("string"), F.col("text")).alias("currency"),
    )


AMOUNT_TEXTS = ["total_amount", "subtotal_amount", "tax_amount"]


@query("nrm_amounts", """
    SELECT document_id, t AS total_amount, s AS subtotal,
           greatest(CASE k % 4 WHEN 0 THEN 5.0 WHEN 1 THEN greatest(t - s, 0.0) WHEN 2 THEN 0.0 ELSE -3.0 END, 0.0) AS tax_amount
    FROM (SELECT *, CASE WHEN k % 5 = 0 THEN totalprice + 100 ELSE t END AS s
          FROM (SELECT *, CASE WHEN k % 7 = 0 THEN 0.0 ELSE totalprice END AS t FROM fx_orders))
    WHERE k % 5 <> 1 UNION ALL
    SELECT document_id, t, t, greatest(CASE k % 4 WHEN 0 THEN 5.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 ELSE -3.0 END, 0.0)
    FROM (SELECT *, CASE WHEN k % 7 = 0 THEN 0.0 ELSE totalprice END AS t FROM fx_orders) WHERE k % 5 = 1""", ("fx_orders",))
def nrm_amounts(spark, folder):
    total = F.when(every(7), F.lit(0.0)).otherwise(F.col("totalprice"))
    fields = F.struct(
        F.when(~every(7), total).alias("grand_total"),
        F.when(every(5), F.col("totalprice") + 100).when(~every(5, 1), total).alias("net_amount"),
        choose(4, "$5.00", F.lit(None).cast("string"), "free", "-3").alias("vat"),
    )
    rows = fx.order_keys(spark, folder).withColumn("payload", F.parse_json(F.to_json(fields)))
    read = normalize.amounts(normalize.pick_fields(rows))
    return read.select(
        "document_id",
        money.at_least_zero(F.col("n_total")).alias("total_amount"),
        money.at_least_zero(F.col("n_subtotal")).alias("subtotal"),
        money.at_least_zero(F.col("n_tax")).alias("tax_amount"),
    )


@query("nrm_confidence", """
    SELECT document_id, cast(CASE k % 5 WHEN 0 THEN 0.25 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 0.8 END AS DOUBLE) AS model_confidence
    FROM fx_orders""", ("fx_orders",))
def nrm_confidence(spark, folder):
    value = choose(5, '"25% of 0.25"', "95", "-0.5", '"high"', "null")
    value = F.when(every(5), F.lit("0.25")).otherwise(value)
    rows = picked(spark, folder, text('{"confidence_score": ', value, "}"))
    return rows.select("document_id", normalize.confidence().alias("model_confidence"))


COERCED = [
    "document_type", "vendor_name", "vendor_tax_id", "invoice_number", "currency", "subtotal",
    "tax_amount", "total_amount", "payment_method", "model_confidence",
]
COERCE_SQL = """
    SELECT document_id, document_type, coalesce(vendor_name, 'Unknown Vendor') AS vendor_name, vendor_tax_id, invoice_number,
           CASE WHEN k % 47 = 0 THEN 'BDT' ELSE currency END AS currency,
           CASE WHEN k % 22 = 0 THEN total_amount ELSE subtotal END AS subtotal,
           CASE WHEN k % 14 <> 0 THEN tax_amount WHEN k % 22 = 0 THEN 0.0 ELSE greatest(total_amount - subtotal, 0.0) END AS tax_amount,
           total_amount, payment_method, model_confidence,
           strftime(CASE WHEN k % 6 = 3 AND k % 43 <> 0 AND day(invoice_date) <= 12
                    THEN make_date(year(invoice_date), day(invoice_date), month(invoice_date)) ELSE invoice_date END, '%Y-%m-%d') AS invoice_date,
           CASE WHEN k % 10 = 0 THEN strftime(invoice_date + 30, '%Y-%m-%d') END AS due_date,
           CASE WHEN k % 11 <> 0 THEN cast(n_lines AS BIGINT) END AS n_items
    FROM fx_truth"""


@query("nrm_record", COERCE_SQL, ("fx_truth",))
def nrm_record(spark, folder):
    records = normalize.coerce(fx.documents(spark, folder), AS_OF)
    return records.select(
        "document_id", *COERCED, day_text(F.col("invoice_date")).alias("invoice_date"),
        day_text(F.col("due_date")).alias("due_date"),
        F.when(~every(11), F.size("line_items").cast("bigint")).alias("n_items"),
    )


@query("nrm_record_older", """
    SELECT document_id, vendor_name,
           strftime(CASE WHEN k % 2 = 0 THEN ordered_at WHEN day(ordered_at) <= 12
              THEN make_date(year(ordered_at), day(ordered_at), month(ordered_at)) ELSE cast(ordered_at AS DATE) END, '%Y-%m-%d') AS invoice_date,
           CASE WHEN k % 3 = 0 THEN 'USD' WHEN k % 3 = 1 THEN 'EUR' ELSE 'BDT' END AS currency,
           CASE WHEN k % 5 = 0 THEN 0.0 ELSE totalprice END AS total_amount,
           cast(CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_items, cast(CASE WHEN k % 2 = 0 THEN 40 ELSE 15 END AS DOUBLE) AS item_sum
    FROM (SELECT *, 'Shop ' || k AS vendor_name FROM fx_orders)""", ("fx_orders",))
def nrm_record_older(spark, folder):
    fields = F.struct(
        numbered("Shop ").alias("merchant_name"),
        F.when(every(5), "$9.00").otherwise(F.col("totalprice").cast("string")).alias("total"),
        F.when(every(2), F.date_format("ordered_at", "MMMM d, yyyy")).otherwise(F.date_format("ordered_at", "M/d/yyyy")).alias("date"),
        choose(3, "US$ ", "euro", "??").alias("currency_symbol"),
        F.when(every(2, 1), F.array(F.struct(F.lit("Lunch").alias("title"), F.lit("3").alias("qty"), F.lit(5.0).alias("price")))).alias("items"),
    )
    scan = text("Order ", F.date_format("ordered_at", "dd/MM/yyyy"), "\nBlue pen 2 5 10\nDelivery fee 30")
    rows = fx.order_keys(spark, folder).select(
        "document_id", "ordered_at", F.parse_json(F.to_json(fields)).alias("payload"), scan.alias("ocr_text")
    )
    records = normalize.coerce(rows, AS_OF, OCR_DIALECT)
    return records.select(
        "document_id", "vendor_name", day_text(F.col("invoice_date")).alias("invoice_date"), "currency",
        "total_amount", F.size("line_items").cast("bigint").alias("n_items"),
        items.line_sum(F.col("line_items")).alias("item_sum"),
    )


# ---- line items ---------------------------------------------------------------------------------

ITEM = ["description", "quantity", "unit_price", "line_total", "category"]


def _exploded(df, column: Column, *keys: str):
    listed = df.select(*keys, F.posexplode(column).alias("_place", "_item"))
    return listed.select(
        *keys, (F.col("_place") + 1).cast("bigint").alias("line_no"), *[F.col(f"_item.{name}") for name in ITEM]
    )


PAYLOAD_ITEMS_SQL = """
    SELECT document_id, line_no, description, quantity,
           CASE WHEN k % 23 = 0 THEN 0.0 ELSE unit_price END AS unit_price,
           CASE WHEN k % 23 = 0 THEN 0.0 ELSE line_total END AS line_total, category
    FROM (
      SELECT t.document_id, t.k, l.line_no, l.description, l.quantity, l.unit_price, l.line_total, l.category
      FROM fx_truth t JOIN fx_lines l ON l.k = t.k
      UNION ALL
      SELECT t.document_id, t.k, t.n_lines + 1, l.description, l.quantity, l.unit_price, l.line_total, l.category
      FROM fx_truth t JOIN fx_lines l ON l.k = t.k AND l.line_no = 1 WHERE t.k % 11 = 0
      UNION ALL
      SELECT document_id, k, n_lines + 1 + (k % 11 = 0)::INT, 'Subtotal', 1.0, subtotal, subtotal, NULL
      FROM fx_truth WHERE k % 8 = 0)"""


@query("lin_normalize", PAYLOAD_ITEMS_SQL, ("fx_truth",))
def lin_normalize(spark, folder):
    fields = normalize.pick_fields(fx.documents(spark, folder))
    return _exploded(fields, items.normalize_items("p_line_items"), "document_id")


IGNORED_SQL = " OR ".join(f"contains(lower(d), '{word}')" for word in IGNORED_LINE_KEYWORDS)


@query("lin_ignore", f"""
    SELECT p_partkey, d AS description
    FROM (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_name || ' Taxi' WHEN 1 THEN 'Grand Total' WHEN 2 THEN '  '
            WHEN 3 THEN 'VAT 5%' WHEN 4 THEN p_name || ' Balanced' ELSE p_name END AS d FROM part)
    WHERE trim(d) <> '' AND NOT ({IGNORED_SQL})""")
def lin_ignore(spark, folder):
    key = F.col("p_partkey")
    described = (
        F.when(key % 7 == 0, text(F.col("p_name"), " Taxi")).when(key % 7 == 1, "Grand Total").when(key % 7 == 2, "  ")
        .when(key % 7 == 3, "VAT 5%").when(key % 7 == 4, text(F.col("p_name"), " Balanced")).otherwise(F.col("p_name"))
    )
    listed = F.array(F.struct(described.alias("description")))
    return fx.table(spark, folder, "part").select(
        "p_partkey", F.explode(items.drop_ignored(listed)).alias("_item")
    ).select("p_partkey", "_item.description")


OCR_ITEMS_SQL = """
    SELECT t.document_id, {line_no} AS line_no, l.description, l.quantity, l.unit_price, l.line_total, cast(NULL AS VARCHAR) AS category
    FROM fx_truth t JOIN fx_lines l ON l.k = t.k"""


@query("lin_ocr_lines", OCR_ITEMS_SQL.format(line_no="l.line_no"), ("fx_truth",))
def lin_ocr_lines(spark, folder):
    return _exploded(
        fx.documents(spark, folder), items.recover_from_ocr(F.col("ocr_text")), "document_id"
    )


@query("lin_ocr_lines_loose", OCR_ITEMS_SQL.format(line_no="l.line_no + (t.k > 0)::INT") + """
    UNION ALL SELECT document_id, 1, 'Invoice', 1.0, cast(k AS DOUBLE), cast(k AS DOUBLE), NULL FROM fx_truth WHERE k > 0""", ("fx_truth",))
def lin_ocr_lines_loose(spark, folder):
    return _exploded(
        fx.documents(spark, folder), items.recover_from_ocr(F.col("ocr_text"), strict=False), "document_id"
    )


@query("lin_ocr_prose", r"""
    SELECT doc_id, count(*) AS found, sum(cast(replace(regexp_extract(line, '^(.+?)\s+(\d[\d,]*(?:\.\d+)?)$', 2), ',', '') AS DOUBLE)) AS item_sum
    FROM (SELECT doc_id, trim(unnest(regexp_split_to_array(text || chr(10) || 'Blue widget ' || (doc_id % 9) || chr(10) || 'Paid 12,500.50', '[\n\r]+')), ' ' || chr(9)) AS line FROM documents)
    WHERE length(line) >= 8 AND regexp_matches(line, '^.+?\s+\d[\d,]*(\.\d+)?$')
      AND cast(replace(regexp_extract(line, '^(.+?)\s+(\d[\d,]*(?:\.\d+)?)$', 2), ',', '') AS DOUBLE) > 0
    GROUP BY doc_id""")
def lin_ocr_prose(spark, folder):
    read = text(F.col("text"), "\nBlue widget ", F.col("doc_id") % 9, "\nPaid 12,500.50")
    found = fx.table(spark, folder, "documents").select(
        "doc_id", items.recover_from_ocr(read, strict=False).alias("_items")
    )
    return found.select(
        "doc_id", F.size("_items").cast("bigint").alias("found"), items.line_sum(F.col("_items")).alias("item_sum")
    )


@query("lin_reconcile", """
    SELECT document_id, CASE WHEN k % 11 <> 0 OR cents + line_cents[1] <= cents + 1 THEN cents + (CASE WHEN k % 11 = 0 THEN line_cents[1] ELSE 0 END)
             ELSE list_max(list_reduce(
               list_transform(list_concat(line_cents, [line_cents[1]]), lambda c: [c]),
               lambda acc, x: list_distinct(list_concat(acc, list_filter(list_transform(acc, lambda s: s + x[1]), lambda v: v <= cents + 1))),
               [0::BIGINT])) END AS kept_cents
    FROM fx_truth""", ("fx_truth",))
def lin_reconcile(spark, folder):
    repeated = F.when(every(11), F.concat("line_items", F.slice("line_items", 1, 1))).otherwise(F.col("line_items"))
    rows = fx.truth(spark, folder).select("document_id", "subtotal", repeated.alias("line_items"))
    kept = normalize.reconcile(rows, "line_items", F.col("subtotal"))
    total = F.aggregate(
        "line_items", F.lit(0).cast("bigint"), lambda acc, item: acc + money.cents(item["line_total"])
    )
    return kept.select("document_id", total.alias("kept_cents"))


@query("lin_have_amounts", """
    SELECT document_id, NOT (k % 23 = 0) AS have_amounts FROM fx_truth""", ("fx_truth",))
def lin_have_amounts(spark, folder):
    fields = normalize.pick_fields(fx.documents(spark, folder))
    normal = items.normalize_items("p_line_items")
    return fields.select("document_id", items.have_amounts(normal).alias("have_amounts"))


# ---- enrichment ---------------------------------------------------------------------------------

@query("enr_vendor", """
    SELECT c_custkey AS vendor_key, CASE c_custkey % 8 WHEN 0 THEN 'Amazon' WHEN 1 THEN 'Walmart' WHEN 2 THEN 'Starbucks'
             WHEN 3 THEN 'Walmart' ELSE c_name END AS canonical
    FROM customer""")
def enr_vendor(spark, folder):
    names = fx.vendor_names(spark, folder)
    return names.select("vendor_key", enrich.canonical_vendor(F.col("vendor_name")).alias("canonical"))


CATEGORY_SQL = """CASE WHEN regexp_matches(lower(text), 'paper|printer|ink|stationery') THEN 'office_supplies'
             WHEN regexp_matches(lower(text), 'uber|lyft|taxi|flight|hotel') THEN 'travel'
             WHEN regexp_matches(lower(text), 'coffee|restaurant|cafe|meal|lunch') THEN 'food_beverage'
             WHEN regexp_matches(lower(text), 'subscription|license|cloud|saas') THEN 'software' END"""


@query("enr_category", f"""
    SELECT doc_id, coalesce(c, 'uncategorized') AS category, cast(CASE WHEN c IS NULL THEN 0.2 ELSE 0.85 END AS DOUBLE) AS category_confidence,
           CASE WHEN c IS NULL THEN 'fallback' ELSE 'rules' END AS category_source
    FROM (SELECT doc_id, {CATEGORY_SQL} AS c FROM documents)""")
def enr_category(spark, folder):
    suggested = enrich.suggest_category(fx.table(spark, folder, "documents"), "text")
    return suggested.select("doc_id", "category", "category_confidence", "category_source")


def rule_rows(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules in their order, before all others."""
    return spark.createDataFrame([(place - len(rules), part, result) for place, (part, result) in enumerate(rules)], "priority bigint, part string, result string")


@query("enr_vendor_table", """
    SELECT c_custkey AS vendor_key, CASE c_custkey % 8 WHEN 0 THEN 'Amazon' WHEN 1 THEN 'Walmart' WHEN 2 THEN 'Starbucks'
             WHEN 3 THEN 'Walmart' ELSE CASE WHEN c_custkey % 5 = 0 THEN 'Known ' || c_custkey ELSE c_name END END AS canonical
    FROM customer""")
def enr_vendor_table(spark, folder):
    """The usual rules, then one for every fifth customer."""
    known = fx.table(spark, folder, "customer").where(F.col("c_custkey") % 5 == 0).select(
        F.col("c_custkey").alias("priority"), F.regexp_replace(F.lower("c_name"), "#", "").alias("part"),
        F.concat(F.lit("Known "), F.col("c_custkey").cast("string")).alias("result"),
    )
    rules = rule_rows(spark, list(VENDOR_NAMES.items())).unionByName(known)
    return fx.vendor_names(spark, folder).select("vendor_key", enrich.canonical_vendor_by_table(F.col("vendor_name"), rules).alias("canonical"))


@query("enr_category_table", f"""
    SELECT doc_id, coalesce(c, 'uncategorized') AS category, cast(CASE WHEN c IS NULL THEN 0.2 ELSE 0.85 END AS DOUBLE) AS category_confidence,
           CASE WHEN c IS NULL THEN 'fallback' ELSE 'rules' END AS category_source
    FROM (SELECT doc_id, coalesce({CATEGORY_SQL}, CASE WHEN EXISTS (
            SELECT 1 FROM benchmark b WHERE contains(lower(documents.text), lower(substr(b.text, 1, 24)))) THEN 'benchmark' END) AS c FROM documents)""")
def enr_category_table(spark, folder):
    """The usual keywords, then the beginnings of all benchmark texts as those of one more category."""
    usual = [(word, category) for category, words in CATEGORY_KEYWORDS.items() for word in words]
    more = fx.table(spark, folder, "benchmark").select(
        F.lit(1).cast("bigint").alias("priority"), F.lower(F.substring("text", 1, 24)).alias("part"), F.lit("benchmark").alias("result")
    )
    suggested = enrich.suggest_category_by_table(fx.table(spark, folder, "documents"), "text", rule_rows(spark, usual).unionByName(more))
    return suggested.select("doc_id", "category", "category_confidence", "category_source")


@query("enr_category_model", f"""
    SELECT d.doc_id, coalesce(c, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN quality = 1 THEN 'goods' ELSE 'services' END END, 'uncategorized') AS category,
           cast(CASE WHEN c IS NOT NULL THEN 0.85 WHEN l.doc_id IS NOT NULL THEN 0.5 + 0.25 * toxic ELSE 0.2 END AS DOUBLE) AS category_confidence,
           CASE WHEN c IS NOT NULL THEN 'rules' WHEN l.doc_id IS NOT NULL THEN 'model' ELSE 'fallback' END AS category_source
    FROM (SELECT doc_id, {CATEGORY_SQL} AS c FROM documents) d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def enr_category_model(spark, folder):
    predictions = fx.table(spark, folder, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 1, "goods").otherwise("services").alias("model_category"),
        (0.5 + 0.25 * F.col("toxic")).alias("model_confidence"),
    )
    documents = fx.table(spark, folder, "documents").select("doc_id", "text")
    return enrich.category_with_model(documents, "text", predictions, "doc_id").drop("text")


# ---- validation ---------------------------------------------------------------------------------

@query("val_schema", """
    SELECT document_id, concat_ws('; ', CASE WHEN k % 47 = 0 THEN 'currency: string_pattern_mismatch' END,
             CASE WHEN k % 53 = 0 THEN 'line_items.0.quantity: greater_than' END,
             CASE WHEN k % 59 = 0 THEN 'total_amount: greater_than_equal' END) AS errors, NOT bad_schema AS valid
    FROM fx_records""", ("fx_records",))
def val_schema(spark, folder):
    checked = check_schema(fx.records(spark, folder))
    return checked.select(
        "document_id", checks.error_text(F.col("schema_errors")).alias("errors"),
        (F.size("schema_errors") == 0).alias("valid"),
    )


def _rule(spark, folder, violation: Column):
    found = fx.records(spark, folder).select("document_id", violation.alias("v"))
    return found.where(F.col("v").isNotNull()).select(
        "document_id", "v.severity", F.round("v.expected", 6).alias("expected"), F.round("v.actual", 6).alias("actual")
    )


@query("val_amount_mismatch", """
    SELECT document_id, 'error' AS severity, round(round_even(subtotal + tax_amount, 2), 6) AS expected,
           round(round_even(total_amount, 2), 6) AS actual FROM fx_rules WHERE v1""", ("fx_rules",))
def val_amount_mismatch(spark, folder):
    return _rule(spark, folder, checks.amount_mismatch())


@query("val_items_incomplete", """
    SELECT document_id, 'warning' AS severity, round(round_even(item_sum, 2), 6) AS expected,
           round(round_even(subtotal, 2), 6) AS actual FROM fx_rules WHERE v2""", ("fx_rules",))
def val_items_incomplete(spark, folder):
    return _rule(spark, folder, checks.line_items_incomplete())


@query("val_item_sum_mismatch", """
    SELECT document_id, 'error' AS severity, round(round_even(item_sum, 2), 6) AS expected,
           round(round_even(s2, 2), 6) AS actual
    FROM (SELECT *, CASE WHEN k % 3 = 0 THEN subtotal + 0.5 ELSE subtotal END AS s2 FROM fx_records)
    WHERE NOT (round_even(item_sum, 2) <= 0.01 AND round_even(s2, 2) > 0.01)
      AND abs(round_even(item_sum, 2) - round_even(s2, 2)) > 0.01""", ("fx_records",))
def val_item_sum_mismatch(spark, folder):
    shifted = F.when(every(3), F.col("subtotal") + 0.5).otherwise(F.col("subtotal"))
    rows = fx.records(spark, folder).withColumn("subtotal", shifted)
    found = rows.select("document_id", checks.line_item_sum_mismatch().alias("v")).where(F.col("v").isNotNull())
    return found.select(
        "document_id", "v.severity", F.round("v.expected", 6).alias("expected"), F.round("v.actual", 6).alias("actual")
    )


@query("val_missing_identifier", """
    SELECT document_id, 'warning' AS severity, cast(NULL AS DOUBLE) AS expected, cast(NULL AS DOUBLE) AS actual
    FROM fx_rules WHERE v4""", ("fx_rules",))
def val_missing_identifier(spark, folder):
    return _rule(spark, folder, checks.missing_identifier())


@query("val_score", """
    SELECT document_id, CASE WHEN bad_schema THEN model_confidence ELSE score END AS validation_score,
           CASE WHEN NOT bad_schema THEN valid END AS is_valid,
           CASE WHEN NOT bad_schema THEN concat_ws(',', CASE WHEN v1 THEN 'amount_mismatch' END, CASE WHEN v2 THEN 'line_items_incomplete' END,
             CASE WHEN v3 THEN 'line_item_sum_mismatch' END, CASE WHEN v4 THEN 'missing_identifier' END) END AS codes
    FROM fx_routed""", ("fx_routed",))
def val_score(spark, folder):
    scored = validate_and_score(fx.records(spark, folder))
    listed = F.array_join(F.transform("violations", lambda violation: violation["code"]), ",")
    return scored.select("document_id", "validation_score", "is_valid", listed.alias("codes"))


# ---- routing ------------------------------------------------------------------------------------

@query("rte_decide", """
    SELECT document_id, concat_ws(',', CASE WHEN NOT valid THEN 'validation_failed' END,
             CASE WHEN model_confidence < 0.85 THEN 'low_confidence' END) AS reasons,
           CASE WHEN NOT valid OR model_confidence < 0.85 THEN 'REVIEW_REQUIRED' ELSE 'VALIDATED' END AS decision
    FROM fx_routed WHERE NOT bad_schema""", ("fx_routed",))
def rte_decide(spark, folder):
    decided = decide(validate_and_score(fx.records(spark, folder)))
    return decided.where("schema_ok").select(
        "document_id", F.array_join("reason_codes", ",").alias("reasons"), "decision"
    )


@query("rte_route", """
    SELECT document_id, reasons, route, CASE WHEN route = 'STORED' THEN score < 0.6 END AS needs_review FROM fx_routed""", ("fx_routed",))
def rte_route(spark, folder):
    return fx.routed(spark, folder).select(
        "document_id", F.array_join("reason_codes", ",").alias("reasons"), "route", "needs_review"
    )


@query("rte_dead_letters", """
    SELECT strftime(ordered_at, '%Y-%m-%d %H:%M:%S') AS recorded_at_utc, document_id, drive_file_id, file_hash,
           route AS status, reasons AS error_code,
           CASE WHEN bad_schema THEN concat_ws('; ', CASE WHEN k % 47 = 0 THEN 'currency: string_pattern_mismatch' END,
             CASE WHEN k % 53 = 0 THEN 'line_items.0.quantity: greater_than' END,
             CASE WHEN k % 59 = 0 THEN 'total_amount: greater_than_equal' END) ELSE 'Routed to review queue' END AS error_message,
           provider AS used_provider
    FROM fx_routed WHERE route <> 'STORED'""", ("fx_routed",))
def rte_dead_letters(spark, folder):
    return dead_letter_rows(fx.routed(spark, folder), F.col("ordered_at"))


@query("rte_ledger_metadata", """
    SELECT document_id, drive_file_id, file_hash, 'STORED' AS status, strftime(ordered_at, '%Y-%m-%d %H:%M:%S') AS processed_at_utc,
           score < 0.6 AS needs_review, provider AS used_provider
    FROM fx_routed WHERE route = 'STORED'""", ("fx_routed",))
def rte_ledger_metadata(spark, folder):
    stored = ledger_rows(fx.routed(spark, folder), F.col("ordered_at"))
    layout = (
        "document_id string, drive_file_id string, file_hash string, status string, "
        "processed_at_utc string, needs_review boolean, used_provider string"
    )
    return stored.select(F.from_json("metadata_json", layout).alias("m")).select("m.*")


@query("rte_review_items", """
    SELECT document_id, 'REVIEW_REQUIRED' AS status, reasons, drive_file_id AS source_file_id, provider AS used_provider,
           vendor_name, total_amount, bad_schema AS has_error,
           CASE WHEN bad_schema THEN NULL ELSE cast(v1::INT + v2::INT + v3::INT + v4::INT AS BIGINT) END AS violations
    FROM fx_routed WHERE route = 'REVIEW_REQUIRED'""", ("fx_routed",))
def rte_review_items(spark, folder):
    rows = review_rows(fx.routed(spark, folder), F.col("ordered_at"))

    def at(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("metadata", f"$.{path}", kind)

    return rows.select(
        "document_id", "status", F.array_join("reason_codes", ",").alias("reasons"),
        at("source_file_id").alias("source_file_id"), at("used_provider").alias("used_provider"),
        at("normalized_record.vendor_name").alias("vendor_name"),
        at("normalized_record.total_amount", "double").alias("total_amount"),
        at("error").isNotNull().alias("has_error"),
        F.size(at("violations", "array<variant>")).cast("bigint").alias("violations"),
    )


@query("rte_counters", """
    SELECT count(*) AS documents_processed_total, 0::BIGINT AS documents_duplicate_skipped_total,
           count(*) FILTER (route = 'REVIEW_REQUIRED') AS documents_review_total,
           count(*) FILTER (route = 'STORED') AS documents_success_total, 0::BIGINT AS documents_failed_total
    FROM fx_routed""", ("fx_routed",))
def rte_counters(spark, folder):
    return run_counters(fx.routed(spark, folder))


# ---- the whole way ------------------------------------------------------------------------------

def processed_documents(spark, folder):
    """Attempts resolved, normalised, validated and routed."""
    texts = fx.payload_texts(spark, folder)
    resolved = extraction.resolve_payload(fx.attempts(texts))
    keys = fx.order_keys(spark, folder).select("document_id", "drive_file_id", "file_hash", "ordered_at")
    return route(validate_and_score(normalize.coerce(resolved.join(keys, "document_id"), AS_OF)))


@query("documents_by_outcome", """
    SELECT route, provider, error_code, count(*) AS documents, cast(sum(cast(total AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
    FROM (SELECT *, CASE WHEN error_code IS NOT NULL THEN 'FAILED'
                         WHEN NOT good OR model_confidence < 0.5 THEN 'REVIEW_REQUIRED' ELSE 'STORED' END AS route,
                 CASE WHEN error_code IS NULL THEN total_amount ELSE 0.0 END AS total
          FROM (SELECT * REPLACE (CASE WHEN k % 41 = 0 THEN 'auto' ELSE provider END AS provider),
                  CASE WHEN k % 41 = 0 THEN 'all_providers_failed' WHEN k % 58 = 0 THEN 'invalid_json' WHEN k % 74 = 0 THEN 'invalid_json_shape' END AS error_code,
                  NOT (k % 17 = 0 AND k % 14 <> 0) AND (k % 22 <> 0 OR (k % 14 = 0 AND k % 23 = 0 AND k % 4 <> 0)) AS good
                FROM fx_truth))
    GROUP BY ALL""", ("fx_truth",))
def documents_by_outcome(spark, folder):
    return processed_documents(spark, folder).groupBy("route", "provider", "error_code").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.col("total_amount").cast("decimal(18,2)")).cast("double").alias("total_amount"),
    )


