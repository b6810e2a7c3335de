"""Vendor names and spending categories.

Few rules become branches of one expression. Rules without number come as a table of (priority, part, result): they are put into one
automaton that finds all parts in one pass over a text, and of those that occur the smallest priority counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.text import has_any, strip
from docledger.rules import CATEGORY_KEYWORDS, VENDOR_NAMES


#: Rules and letters of a table that is sent to all tasks, at most.
MOST_RULES, MOST_LETTERS = 1_000_000, 64_000_000

_AUTOMATA: dict[str, tuple[ahocorasick.Automaton, tuple | None]] = {}


def _automaton(name: str, shared: Broadcast) -> tuple[ahocorasick.Automaton, tuple | None]:
    """The worker's automaton over (priority, result) by part, and the rule of the empty part, which every text holds."""
    if name not in _AUTOMATA:
        best: dict[str, tuple] = {}
        for priority, part, result in shared.value:
            if part not in best or (priority, result) < best[part]:
                best[part] = (priority, result)
        always = best.pop("", None)
        automaton = ahocorasick.Automaton()
        for part, rule in best.items():
            automaton.add_word(part, rule)
        if best:
            automaton.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[name] = (automaton, always)
    return _AUTOMATA[name]


def rule_lookup(rules: DataFrame) -> Callable[[Column], Column]:
    """A function from a text column to the result of the rule with the smallest priority (ties: the smaller result) whose part
    occurs in the text; null where none does.

    ``rules``: priority, part and result; rows with a null take no part. The table goes to the driver and to all tasks, so it may hold at
    most `MOST_RULES` rules and `MOST_LETTERS` letters; more is an error.
    """
    known = rules.select(F.col("priority").cast("bigint").alias("priority"), F.col("part").cast("string").alias("part"), F.col("result").cast("string").alias("result")).dropna()
    size = known.agg(F.count(F.lit(1)).alias("rules"), F.coalesce(F.sum(F.length("part") + F.length("result")), F.lit(0)).alias("letters")).first()
    if size["rules"] > MOST_RULES or size["letters"] > MOST_LETTERS:
        raise ValueError(f"{size['rules']} rules of {size['letters']} letters are more than {MOST_RULES} of {MOST_LETTERS}")
    name = uuid.uuid4().hex
    shared = rules.sparkSession.sparkContext.broadcast([tuple(row) for row in known.collect()])

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        automaton, always = _automaton(name, shared)

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            hits = [rule for _, rule in automaton.iter(text)] if len(automaton) else []
            best = min(hits if always is None else [*hits, always], default=None)
            return best and best[1]

        return texts.map(one)

    return found


def _cleaned(name: Column) -> Column:
    return strip(F.regexp_replace(F.lower(name), r"(?U)[^a-z0-9\s-]", ""))


def canonical_vendor_by_table(name: Column, rules: DataFrame) -> Column:
    """As `canonical_vendor`, with the rules of a table (priority, part, result) of any size that `rule_lookup` takes."""
    return F.coalesce(rule_lookup(rules)(_cleaned(name)), strip(name))


def canonical_vendor(name: Column, names: dict[str, str] = VENDOR_NAMES) -> Column:
    """The name of the first rule whose text occurs in the cleaned name, else the trimmed name."""
    cleaned = _cleaned(name)
    result = F.when(F.lit(False), F.lit(""))
    for part, canonical in names.items():
        result = result.when(cleaned.contains(part), F.lit(canonical))
    return result.otherwise(strip(name))


def _rule_category(lowered: Column, keywords: dict[str, list[str]]) -> Column:
    result = F.when(F.lit(False), F.lit(""))
    for category, words in keywords.items():
        result = result.when(has_any(lowered, words), F.lit(category))
    return result


def suggest_category(
    df: DataFrame, text: str, keywords: dict[str, list[str]] = CATEGORY_KEYWORDS
) -> DataFrame:
    """Add category, its confidence and source from the first category with a keyword."""
    lowered = df.withColumn("_lowered", F.lower(F.col(text)))
    return _with_source(lowered.withColumn("category", _rule_category(F.col("_lowered"), keywords)).drop("_lowered"))


def suggest_category_by_table(df: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """As `suggest_category`, with keywords in a table (priority, part, result): the category of the smallest priority wins."""
    return _with_source(df.withColumn("category", rule_lookup(rules)(F.lower(F.col(text)))))


def _with_source(staged: DataFrame) -> DataFrame:
    hit = F.col("category").isNotNull()
    return staged.withColumns({
        "category": F.coalesce("category", F.lit("uncategorized")),
        "category_confidence": F.when(hit, F.lit(0.85)).otherwise(F.lit(0.2)),
        "category_source": F.when(hit, F.lit("rules")).otherwise(F.lit("fallback")),
    })


def category_with_model(
    df: DataFrame,
    text: str,
    predictions: DataFrame,
    key: str,
    keywords: dict[str, list[str]] = CATEGORY_KEYWORDS,
) -> DataFrame:
    """As ``suggest_category``, with a model's answer where no rule hits.

    ``predictions``: key, model_category, model_confidence, one row per key at most; any model,
    such as a vectorised function applied to the texts, can fill it.
    """
    ruled = suggest_category(df, text, keywords).join(predictions, key, "left")
    use_model = (F.col("category_source") == "fallback") & F.col("model_category").isNotNull()
    return ruled.withColumns({
        "category": F.when(use_model, F.col("model_category")).otherwise(F.col("category")),
        "category_confidence": F.when(use_model, F.col("model_confidence")).otherwise(
            F.col("category_confidence")
        ),
        "category_source": F.when(use_model, F.lit("model")).otherwise(F.col("category_source")),
    }).drop("model_category", "model_confidence")
