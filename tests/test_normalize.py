from __future__ import annotations

import datetime as dt
import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from docledger.functions import codes, dates, items
from docledger.functions import subset
from docledger.functions.subset import _by_bits, _by_halves, closest_lines
from docledger.operators.normalize import coerce, reconcile
from docledger.operators.validate import validate_and_score
from docledger.rules import OCR_DIALECT, RULES, load_rules

AS_OF = "2026-05-05"


def records(spark, payloads, rules=RULES):
    rows = [(place, json.dumps(p, ensure_ascii=False), p.get("_ocr_text")) for place, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "n int, raw string, ocr_text string")
    parsed = df.withColumn("payload", F.try_parse_json("raw")).drop("raw")
    return coerce(parsed, AS_OF, rules).orderBy("n").collect()


def test_names_and_prices_as_models_write_them(spark):
    row, = records(spark, [{
        "vendor": {"name": "\tRiverside Glassworks GmbH ", "city": "Ulm"}, "total_amount": "EUR 1,047.35", "subtotal": "880.13 net", "currency": "eur",
        "payment_method": "VISA card", "issue_date": "x", "date": "07-11-2023", "invoice_number": "RG/77",
    }])
    assert row.vendor_name == "Riverside Glassworks GmbH"
    assert (row.total_amount, row.subtotal) == (1047.35, 880.13)
    assert abs(row.tax_amount - 167.22) < 1e-9
    assert (row.currency, row.payment_method, row.invoice_number) == ("EUR", "card", "RG/77")


def test_priced_lines_of_the_page_replace_items_without_prices(spark):
    page = "Terrace slab grey 6 31.50 189.00\nEdging stone granite 14 8.25 115.50\nThank you for your order"
    payload = {"total": "304.50", "line_items": [{"description": "slabs"}, {"description": "edging"}], "_ocr_text": page}
    row, = records(spark, [payload])
    assert [(i.description, i.quantity, i.line_total) for i in row.line_items] == [
        ("Terrace slab grey", 6.0, 189.0), ("Edging stone granite", 14.0, 115.5)]


def test_lines_beyond_the_subtotal_are_left_out(spark):
    rules = load_rules(json.dumps({
        "field_aliases": {"subtotal_amount": ["net"], "total_amount": ["gross"], "line_items": ["rows"]},
        "line_item_aliases": {"quantity": ["n"], "line_total": ["sum"]},
    }))
    lines = [("Delivery", "4.90"), ("Lamp", "61.20"), ("Shade", "18.35"), ("Carried over", "84.45")]
    row, = records(spark, [{"net": "84.45", "gross": "84.45", "rows": [{"description": d, "n": 1, "sum": s} for d, s in lines]}], rules)
    assert [i.description for i in row.line_items] == ["Delivery", "Lamp", "Shade"]


def test_aliases_of_any_spelling(spark):
    rules = load_rules(json.dumps({"field_aliases": {
        "total_amount": ["total", "Total", "to'tal", 'a "quoted" name', "sum`s.of all's"], "vendor_name": ["seller.it's"]}}))
    rows = records(spark, [{"Total": 3}, {"total": 4, "Total": 9}, {"to'tal": 5}, {'a "quoted" name': 6}, {"sum`s": {"of all's": 7}}, {"seller": {"it's": "Q"}}], rules)
    assert [r.total_amount for r in rows] == [3.0, 4.0, 5.0, 6.0, 7.0, 0.0] and rows[5].vendor_name == "Q"


def test_an_absurd_amount_spoils_no_other_document(spark):
    bar_code = "12345678901234567890123"
    rows = records(spark, [
        {"total": "20", "line_items": [{"description": "a", "line_total": bar_code}, {"description": "b", "line_total": "20"}]},
        {"total": "5", "line_items": [{"description": "c", "line_total": "5"}]},
    ])
    assert [[i.description for i in r.line_items] for r in rows] == [["b"], ["c"]]


def test_defaults_and_odd_members(spark):
    empty, odd = records(spark, [
        {},
        {"vendor": [], "invoice_number": 7, "items": [5, {"name": "", "title": " Pen ", "qty": True, "price": "2,50", "category": 3}],
         "total": {"amount": 5}, "tax": "free", "currency": "US$", "date": "31/02/2026", "due_date": "2/13/2026"},
    ])
    assert empty.vendor_name == "Unknown Vendor" and empty.currency == "BDT"
    assert empty.invoice_date == dt.date(2026, 5, 5) and empty.model_confidence == 0.8
    assert odd.vendor_name == "[]" and odd.currency == "US$" and odd.total_amount == 5.0
    assert odd.tax_amount == 0.0 and odd.due_date == dt.date(2026, 2, 13)
    assert [(i.description, i.quantity, i.unit_price, i.line_total) for i in odd.line_items] == [("Pen", 1.0, 250.0, 250.0)]
    assert sorted(e.loc for e in odd.type_errors) == ["invoice_number", "line_items.0.category"]


@pytest.mark.parametrize(("payload", "date", "currency"), [
    ({"total": 1, "currency": "bdt", "_ocr_text": "Order Date 01/03/2026"}, dt.date(2026, 3, 1), "BDT"),
    ({"currency": "", "_ocr_text": "Invoice Total USD 12.00\nAmount Due $12.00"}, None, "USD"),
    ({"currency": None, "_ocr_text": "Grand Total ৳ 68,700\nPaid by cash"}, None, "BDT"),
    ({"currency": "eur", "_ocr_text": ""}, None, "EUR"),
    ({"_ocr_text": "Cost A$ 5 and €9"}, None, "EUR"),
    ({"_ocr_text": "Total:TK 90, ₹"}, None, "BDT"),
])
def test_older_dialect(spark, payload, date, currency):
    row, = records(spark, [payload], OCR_DIALECT)
    assert row.currency == currency
    assert row.invoice_date == (date or dt.date(2026, 5, 5))


def test_dates(spark):
    cases = {
        "2026-3-1": "2026-03-01", "1/3/2026": "2026-03-01", "13/2/2026": "2026-02-13", "2/13/2026": "2026-02-13",
        "01-03-2026": "2026-03-01", "FEB 9, 2024": "2024-02-09", "february  29, 2023": None, "1/3/26": None,
        "2026/03/01": None, "0000-01-01": None, "Sept 9, 2024": None, "May 5, 2024": "2024-05-05",
        " 2026-03-01\t": "2026-03-01", "2026-03-01T00:00:00": None, "2026": None,
    }
    df = spark.createDataFrame([(text, expected) for text, expected in cases.items()], "t string, e string")
    for row in df.select("t", "e", dates.parse_date(F.col("t")).cast("string").alias("p")).collect():
        assert row.p == row.e, row.t


def test_currency_names(spark):
    df = spark.createDataFrame([("€",), ("Taka",), ("xyz",), ("US dollar",), (None,)], "t string")
    got = [r[0] for r in df.select(codes.named_currency(F.col("t"))).collect()]
    assert got == ["EUR", "BDT", "XYZ", None, None]


def preferred(cents, limit):
    """Among all sets of usable lines with the largest sum: the one whose last line comes earliest, then the one before it, and so on."""
    usable = [place for place, amount in enumerate(cents) if 0 < amount <= limit]
    sets = [chosen for size in range(len(usable) + 1) for chosen in itertools.combinations(usable, size)]
    fitting = [(sum(cents[p] for p in chosen), chosen) for chosen in sets]
    top = max(total for total, _ in fitting if total <= limit)
    return list(min((chosen for total, chosen in fitting if total == top), key=lambda chosen: chosen[::-1]))


def test_chosen_lines_against_all_sets():
    rng = random.Random(91)
    for _ in range(250):
        step = rng.choice([1, 5, 250])
        cents = [step * rng.randint(0, 40) for _ in range(rng.randint(1, 9))]
        limit = rng.randint(1, sum(cents) + 2)
        expected = preferred(cents, limit)
        assert closest_lines(cents, limit) == expected
        lines = [(p, a) for p, a in enumerate(cents) if 0 < a <= limit]
        if lines:
            assert _by_halves(lines, limit) == _by_bits(lines, limit) == expected


def test_forty_lines_of_large_amounts():
    rng = random.Random(17)
    cents = [rng.randint(10**8, 10**9) for _ in range(40)]
    wanted = sorted(rng.sample(range(40), 17))
    limit = sum(cents[p] for p in wanted)
    assert sum(cents[p] for p in closest_lines(cents, limit)) == limit


def test_sixty_lines_of_any_amounts():
    """A limit of ten thousand million units takes seconds at most; the answer is exact."""
    rng = random.Random(5)
    for top in (10**9, 10**11):
        cents = [rng.randint(1, top) for _ in range(60)]
        limit = 10 * top
        started = time.perf_counter()
        found = closest_lines(cents, limit)
        assert sum(cents[p] for p in found) == limit and time.perf_counter() - started < 20
        assert max(found) < 44


def test_first_lines_give_what_all_lines_give(monkeypatch):
    """Few first lines and few bits, so that every way is taken; against the bits of all lines."""
    rng = random.Random(6)
    monkeypatch.setattr(subset, "TWO_HALVES", 6)
    monkeypatch.setattr(subset, "FIRST_LINES", 8)
    monkeypatch.setattr(subset, "MOST_BITS", 4000)
    ways = set()
    for case in range(400):
        cents = [rng.randint(1, 40 if case % 2 else 900) for _ in range(rng.randint(7, 14))]
        limit = rng.randint(250, sum(cents) - 1) if sum(cents) > 260 else 1
        lines = [(p, a) for p, a in enumerate(cents) if 0 < a <= limit]
        found = closest_lines(cents, limit)
        if found or limit <= 4000:
            assert found == _by_bits(lines, limit)
        ways.add((max(found, default=-1) < 8, limit > 250))
    assert len(ways) == 4
    assert closest_lines([10_007 * n + n % 3 for n in range(2, 16)], 200_001) == []  # too large, and the first lines don't meet it


def test_many_lines_are_reconciled_exactly(spark):
    lines = [(f"line {n}", 1.0, 1.0, 10.0 + n, None) for n in range(70)]
    item = "struct<description:string,quantity:double,unit_price:double,line_total:double,category:string>"
    df = spark.createDataFrame([(lines,)], f"line_items array<{item}>")
    kept = reconcile(df, "line_items", F.lit(1234.0)).select(items.line_sum(F.col("line_items"))).first()[0]
    assert kept == 1234.0


def test_violations(spark):
    base = {
        "document_type": "invoice", "vendor_name": "Acme", "invoice_number": "INV-1", "invoice_date": "2026-02-27",
        "currency": "USD", "subtotal": 100.0, "tax": 10.0, "total": 110.0, "confidence": 0.9,
        "line_items": [{"description": "Paper", "quantity": 2, "unit_price": 50.0, "line_total": 100.0}],
    }
    changed = [
        {}, {"total": 999.0}, {"line_items": [{"description": "Paper", "line_total": 90.0}]},
        {"line_items": [{"description": "Paper"}]}, {"invoice_number": None}, {"currency": "U$D"},
    ]
    rows = [(n, json.dumps({**base, **change}), None) for n, change in enumerate(changed)]
    df = spark.createDataFrame(rows, "n int, raw string, ocr_text string")
    coerced = coerce(df.withColumn("payload", F.parse_json("raw")), AS_OF)
    got = validate_and_score(coerced).orderBy("n").collect()
    assert [None if r.violations is None else [v.code for v in r.violations] for r in got] == [
        [], ["amount_mismatch"], ["line_item_sum_mismatch"], ["line_items_incomplete"], ["missing_identifier"], None,
    ]
    assert [r.is_valid for r in got] == [True, False, False, True, True, None]
    assert got[1].validation_score == 0.6667 and [e.loc for e in got[5].schema_errors] == ["currency"]
