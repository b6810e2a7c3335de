"""Line items: arrays of (description, quantity, unit_price, line_total, category)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.money import MOST_CENTS, at_least_zero, cents, money, money_text
from docledger.functions.payload import Members, as_text, is_text
from docledger.functions.subset import closest_lines_udf
from docledger.functions.text import has_any, split_lines, strip
from docledger.rules import RULES, Rules

SMALLEST_QUANTITY = 0.0001
SHORTEST_LINE = 8
# The line shapes of OCR text.
PRICED_LINE = r"(?U)^(.+?)\s+(\d+(?:\.\d+)?)\s+(\$?\d[\d,]*(?:\.\d+)?)\s+(\$?\d[\d,]*(?:\.\d+)?)$"
PRICED_LINE_PLAIN = r"(?U)^(.+?)\s+(\d+(?:\.\d+)?)\s+(\d[\d,]*(?:\.\d+)?)\s+(\d[\d,]*(?:\.\d+)?)$"
TOTAL_LINE = r"(?U)^(.+?)\s+(\d[\d,]*(?:\.\d+)?)$"


def _item(description, quantity, unit_price, line_total, category, text_category) -> Column:
    return F.struct(
        description.alias("description"),
        F.greatest(quantity, F.lit(SMALLEST_QUANTITY)).alias("quantity"),
        at_least_zero(unit_price).alias("unit_price"),
        at_least_zero(line_total).alias("line_total"),
        category.alias("category"),
        text_category.alias("text_category"),
    )


ITEM_FIELDS = ["description", "quantity", "unit_price", "line_total", "category"]


def members_of(rules: Rules = RULES) -> Members:
    return Members([alias for name in ITEM_FIELDS for alias in rules.item(name)])


def normalize_items(raw: str, rules: Rules = RULES) -> Column:
    """Typed items of a column of lists of item members; null members are dropped.

    ``text_category`` is false where the category is present but no text, which the record
    schema rejects later.
    """
    known = members_of(rules)
    picked = F.transform(
        F.filter(raw, lambda item: item.isNotNull()),
        lambda item: F.struct(*[known.pick(item, rules.item(name)).alias(name) for name in ITEM_FIELDS]),
    )

    def numbers(item: Column) -> Column:
        return F.struct(
            strip(F.coalesce(as_text(item["description"]), F.lit("item"))).alias("description"),
            money(item["quantity"], F.lit(1.0), rules.clean_money).alias("quantity"),
            money(item["unit_price"], F.lit(0.0), rules.clean_money).alias("unit_price"),
            money(item["line_total"], F.lit(None).cast("double"), rules.clean_money).alias("line_total"),
            as_text(item["category"]).alias("category"),
            (item["category"].isNull() | is_text(item["category"])).alias("text_category"),
        )

    return F.transform(
        F.transform(picked, numbers),
        lambda item: _item(
            item["description"],
            item["quantity"],
            item["unit_price"],
            F.coalesce(item["line_total"], item["quantity"] * item["unit_price"]),
            item["category"],
            item["text_category"],
        ),
    )


def have_amounts(items: Column) -> Column:
    return F.exists(items, lambda item: item["line_total"] > 0)


def is_ignored(description: Column, words: list[str]) -> Column:
    return has_any(F.lower(strip(description)), words, blank=True)


def drop_ignored(items: Column, words: list[str] = RULES.ignored_lines) -> Column:
    """Without lines that are blank or name a total, tax, payment detail and the like."""
    return F.filter(items, lambda item: ~is_ignored(item["description"], words))


def recover_from_ocr(text: Column, strict: bool = True, words: list[str] = RULES.ignored_lines) -> Column:
    """Items found in OCR lines of the form ``description quantity unit total``.

    The loose form also takes ``description total`` lines and ignores no descriptions.
    """
    lines = F.filter(
        F.transform(split_lines(F.coalesce(text, F.lit(""))), strip),
        lambda line: F.length(line) >= SHORTEST_LINE,
    )
    no_category = F.lit(None).cast("string")

    def parts(line: Column, pattern: str, groups: int) -> Column:
        """The pattern's groups, in one pass; a line holds no line end, so that can divide them."""
        divided = F.regexp_replace(line, pattern, "\n".join(f"${n}" for n in range(1, groups + 1)))
        return F.split(divided, "\n")

    def priced(part: Column) -> Column:
        quantity, unit, total = (money_text(part[place]) for place in (1, 2, 3))
        return _item(strip(part[0]), quantity, unit, total, no_category, F.lit(True))

    if strict:
        split = F.transform(lines, lambda line: parts(line, PRICED_LINE, 4))
        matched = F.filter(split, lambda part: F.size(part) == 4)
        items = F.transform(matched, priced)
        return F.filter(
            items, lambda item: (item["line_total"] > 0) & ~is_ignored(item["description"], words)
        )

    def total_only(part: Column) -> Column:
        total = money_text(part[1])
        return _item(strip(part[0]), F.lit(1.0), total, total, no_category, F.lit(True))

    def loose_parts(line: Column) -> Column:
        four = parts(line, PRICED_LINE_PLAIN, 4)
        return F.when(F.size(four) == 4, four).otherwise(parts(line, TOTAL_LINE, 2))

    split = F.transform(lines, loose_parts)
    matched = F.filter(split, lambda part: F.size(part) > 1)
    items = F.transform(
        matched, lambda part: F.when(F.size(part) == 4, priced(part)).otherwise(total_only(part))
    )
    return F.filter(items, lambda item: item["line_total"] > 0)


def line_sum(items: Column) -> Column:
    """Sum of line totals in list order, which fixes the floating-point result."""
    return F.aggregate(items, F.lit(0.0), lambda total, item: total + item["line_total"])


def kept_positions(items: Column, target: Column, tolerance: float) -> Column:
    """Positions that best fill the target when the items add up to more; none elsewhere.

    Other documents send an empty list, not null: Spark's Arrow writer asks for a batch's size at each row, and goes over the
    nulls since the last list each time.
    """
    slack = round(tolerance * 100)
    amounts = F.transform(items, lambda item: cents(item["line_total"]))
    total = F.aggregate(amounts, F.lit(0).cast("bigint"), lambda acc, amount: F.least(acc + amount, F.lit(MOST_CENTS * 100)))
    limit = cents(target) + slack
    overcounted = (target > 0) & (F.size(items) > 1) & (total > limit)
    none = F.array().cast("array<bigint>")
    return closest_lines_udf(F.when(overcounted, amounts).otherwise(none), F.when(overcounted, limit).otherwise(F.lit(0)))


def keep_positions(items: Column, positions: Column) -> Column:
    """The items at the positions; null or no positions keep the items as they are."""
    chosen = F.filter(items, lambda item, place: F.array_contains(positions, place))
    return F.when(F.size(positions) > 0, chosen).otherwise(items)


def public_items(items: Column) -> Column:
    """Items without the working flag."""
    return F.transform(
        items,
        lambda item: F.struct(*[
            item[name].alias(name)
            for name in ("description", "quantity", "unit_price", "line_total", "category")
        ]),
    )
