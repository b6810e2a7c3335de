"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source that should give ``rate`` times its words gives every row floor(rate) copies and a fractional probability of
one more. Rows are dealt over small random groups within their source. A group folds its rows pair by pair: of
two fractional rows, mass (probability times size) moves from one to the other, in a direction drawn so that each
probability keeps its mean, until one is 0 or 1; the other meets the next row. Each group leaves at most one fractional row.
Within a group the largest rows meet first,
so that large rows settle among themselves and the row left over is a small one. These residuals are grouped and folded again, level by level, until one per source is left, which is drawn
by itself. So a source's taken words miss its target by less than the size of one document.

Groups hold `FAN` rows on average whatever the size of a source, so a source with a third of all rows is folded by many tasks.
All draws are hashes of the rows' keys: reruns agree.

Defined results: a null text has size 0; rows of size 0 take nothing. A null source is a source of its own, after
all others. Rows that repeat doc_id, source and size are separate rows, told apart by ``copy`` (1, 2, ...).
An empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.common import WORDS, packed, whole_text, written

WEIGHTS = (5, 2, 1)
#: A source gives each of its words this often at most.
REPEATS = 3
#: Rows that one group folds, on average.
FAN = 32
EPS = 1e-9
UNIT = "struct<size:bigint,doc_id:bigint,copy:bigint,p:double>"


def size_of(text: str) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORDS)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    The targets are the levels of ``repeats`` times the sizes filled by weight: sources are ordered by the level
    at which they are full, and the first that is not full at the level of the rest sets the level. The two windows run over
    one narrow row per source, never over documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights)
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double"))
    full = (F.col("source_size") * repeats).cast("double")
    everything = Window.partitionBy()
    by_level = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.select(
        "source", "source_size", "weight", full.alias("full"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(by_level), F.lit(0.0))).alias("open_size"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0))).alias("open_weight"),
    )
    level = F.col("open_size") / F.col("open_weight")
    fits = F.when(level * F.col("weight") <= F.col("full") * (1 + EPS), level)
    chosen = levels.withColumn("level", F.max(fits).over(everything))
    return chosen.select("source", "source_size", F.least(F.col("full"), F.col("level") * F.col("weight")).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def _with(unit: Column, p: Column) -> Column:
    return F.struct(unit["size"].alias("size"), unit["doc_id"].alias("doc_id"), unit["copy"].alias("copy"), p.alias("p"))


def _fold(units: Column, seed: Column) -> Column:
    """struct(open: the fractional unit left over, done: units whose p is 0 or 1), from a non-empty array of units."""

    def step(state: Column, unit: Column) -> Column:
        left = state["open"]
        here, there = left["size"], unit["size"]
        filled, room = left["p"] * here, (1 - left["p"]) * here
        other_filled, other_room = unit["p"] * there, (1 - unit["p"]) * there
        gain, loss = F.least(room, other_filled), F.least(filled, other_room)
        drawn = _uniform(seed, left["doc_id"], left["copy"], here, unit["doc_id"], unit["copy"], there)
        gains = drawn * (gain + loss) < loss
        left_ends = F.when(gains, room <= other_filled).otherwise(filled <= other_room)
        left_end = _with(left, F.when(gains, 1.0).otherwise(0.0))
        unit_end = _with(unit, F.when(gains, 0.0).otherwise(1.0))
        moved = F.when(gains, gain).otherwise(-loss)
        bounded = lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
        left_on, unit_on = _with(left, bounded(left["p"] + moved / here)), _with(unit, bounded(unit["p"] - moved / there))
        return F.struct(
            F.when(left_ends, unit_on).otherwise(left_on).alias("open"),
            F.concat(state["done"], F.array(F.when(left_ends, left_end).otherwise(unit_end))).alias("done"),
        )

    start = F.struct(units[0].alias("open"), F.array().cast(f"array<{UNIT}>").alias("done"))
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), start, step)


def round_fractions(units: DataFrame, seed: int = 42) -> DataFrame:
    """(source, doc_id, copy, size, extra: 0 or 1) for units of (source, doc_id, copy, size > 0, p from 0 to 1)."""
    columns = ["source", "doc_id", "copy", "size", "p"]
    open_units, ended, level = units.select(columns), [], 0
    most = units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        groups = -(-most // FAN)
        group = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "copy", "size"), F.lit(groups))
        folded = written(
            open_units.groupBy("source", group.alias("g"))
            .agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "doc_id", "copy", "p")))).alias("units"))
            .select("source", _fold(F.col("units"), F.lit(seed + level)).alias("folded")),
            f"fold-{level}",
        )
        ended.append(folded.select("source", F.explode("folded.done").alias("unit")).select("source", "unit.*"))
        open_units = folded.select("source", "folded.open.*").select(columns)
        most = open_units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        level += 1
    taken = (_uniform(F.lit(seed), F.col("doc_id"), F.col("copy"), F.col("size")) < F.col("p")).cast("int")
    result = open_units.select("source", "doc_id", "copy", "size", taken.alias("extra"))
    for part in ended:
        result = result.union(part.select("source", "doc_id", "copy", "size", F.col("p").cast("int").alias("extra")))
    return result


def mix(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 42,
) -> DataFrame:
    """doc_id, source, copy, size, source_size, target (of the source) and copies (times the mix takes it) for every row.

    Texts are read once; afterwards only narrow rows move. The table of targets has one row per source; Spark broadcasts
    it if its files are below the session's limit and else joins by a shuffle that splits frequent sources.
    """
    read = documents.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"),
        size_of(text).alias("size"),
    )
    rows = written(read.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("times")), "sizes")
    sizes = rows.select("source", (F.col("size") * F.col("times")).alias("size"))
    rates = written(
        source_targets(sizes, weights, repeats).select(
            F.col("source").alias("_source"), "source_size", "target",
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        ),
        "rates",
    )
    whole = F.floor(F.col("rate") + EPS)

    def rated(df: DataFrame) -> DataFrame:
        return df.join(rates, df["source"].eqNullSafe(rates["_source"])).drop("_source")

    each = rated(rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))).withColumn(
        "p", F.when(F.col("size") > 0, F.greatest(F.col("rate") - whole, F.lit(0.0))).otherwise(0.0)
    )
    plain = each.where(f"p <= {EPS}").select("source", "doc_id", "copy", "size", F.lit(0).alias("extra"))
    drawn = round_fractions(each.where(f"p > {EPS}"), seed)
    copies = F.when(F.col("size") > 0, whole + F.col("extra")).otherwise(0).cast("bigint")
    return rated(plain.union(drawn)).select("doc_id", "source", "copy", "size", "source_size", "target", copies.alias("copies"))


def repeat(documents: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows of ``documents``, with all their columns, as often as ``mixed`` takes them. Rows are shuffled once."""
    own = [F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(text).alias("size")]
    key = F.struct(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.col("size").alias("size"))
    taken = mixed.where("copies > 0").select(key.alias("key"), "copy", "copies")
    copy = F.row_number().over(Window.partitionBy("key").orderBy("order")).cast("bigint")
    rows = packed(documents, own).withColumn("copy", copy).join(taken, ["key", "copy"])
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("time")).select("row.*")
