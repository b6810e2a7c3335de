"""Hard negatives by an inverted multi-index whose search is certified.

Vectors are cut in halves. `fit` makes one codebook for each half from a bounded sample (at most `SAMPLE` vectors and `SAMPLE_VALUES`
numbers, those with the smallest hashes); every vector then lies in the cell of its two nearest codes. The largest distance of any
vector to its code is that code's radius, taken over all vectors. For an anchor, a code's half score is at most its
inner product with the code plus the anchor half's length times the radius, and at least the product minus it, so a cell's
scores lie between the sums over its two codes.

A multi-sequence heap visits an anchor's cells by falling upper bound, in two waves. The first visits so many cells that they hold about `FIRST`
vectors; the best scores found there are a limit that the true ones can't be below. The second goes on until a cell's bound is below
that limit: whatever was not visited can't be among the results, so they are certified, exactly. Positives come first.
Each positive then makes a window of scores, and the same two waves look for the best negatives in all windows of an anchor; cells
that lie above all windows are passed over, and a window is closed by its own lower end.

Vectors are dealt by their first code in parts of about `PART` rows, so that a crowded cell is cut into many tasks, and anchors in chunks of
about `CHUNK`; an anchor goes to each first code once, with the list of second codes to be visited.

Scores are inner products of integers, floor(``scale`` times the component), exact while they stay below 2^53.

Defined results: rows whose id, label or vector is null, or that hold null or non-finite components, take no part. A zero or empty vector
does. Shorter vectors count as padded with zeros. Of rows that repeat an id, that of the smallest label and then smallest
vector counts. Ties go to the smaller id. An anchor without positives, or a positive without negatives in its window, has no rows; an
empty table gives none. Other columns aren't read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.common import bounded_sample, written

#: The sample that codebooks are fitted on, at most.
SAMPLE, SAMPLE_VALUES = 20_000, 1 << 22
#: Codes of a half, at most, and the vectors that a cell should hold.
CODES, CELL = 512, 16
#: Vectors in the cells of the first wave.
FIRST = 1024
#: Vectors and anchors that one task compares at a time.
PART, CHUNK = 8192, 1024
#: Anchors whose cells one task works out; their rows are few bytes, but each takes a heap of its own.
HEAPS = 64
#: Bounds are raised by this share, more than rounding can lower them.
SLACK = 1e-9


@dataclass
class Codebooks:
    """Codes and radii of both halves, and how many vectors each cell holds."""

    codes: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    held: np.ndarray

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.codes[0].shape[1]
        return vectors[:, :cut], vectors[:, cut:]

    def cells(self, vectors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The nearest code of each half, and the distances to them."""
        numbers, distances = [], []
        for half, codes in zip(self.halves(vectors), self.codes):
            number = ((codes**2).sum(axis=1) - 2 * half @ codes.T).argmin(axis=1) if half.shape[1] else np.zeros(len(half), np.int64)
            numbers.append(number)
            distances.append(np.sqrt(((half - codes[number]) ** 2).sum(axis=1)))
        return numbers, distances

    def bounds(self, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half, the most and the least that a vector of each code can score with each of ``vectors``."""
        found = []
        for half, codes, radii in zip(self.halves(vectors), self.codes, self.radii):
            middle = half @ codes.T
            reach = np.sqrt((half**2).sum(axis=1))[:, None] * radii
            slack = SLACK * (1 + np.abs(middle) + reach)
            found.append((middle + reach + slack, middle - reach - slack))
        return found


def by_bound(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs by falling sum, by the multi-sequence heap: a pair is pushed when those before it in its row and column are out."""
    rows, columns = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    a, b = first[rows].tolist(), second[columns].tolist()
    heap, done = [(-(a[0] + b[0]), 0, 0)], [0] * len(rows)  # done: the columns that are out, by row
    while heap:
        total, i, j = heapq.heappop(heap)
        yield -total, rows[i], columns[j]
        done[i] = j + 1
        if i + 1 < len(rows) and done[i + 1] == j:
            heapq.heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))
        if j + 1 < len(columns) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))


def _means(points: np.ndarray, count: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Codes by k-means; codes that nothing is near to stay where they are."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), count, replace=False)].copy()
    for _ in range(rounds if points.shape[1] else 0):
        number = np.concatenate([((centres**2).sum(1) - 2 * part @ centres.T).argmin(1) for part in np.array_split(points, -(-len(points) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, number, points)
        sizes = np.bincount(number, minlength=count)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def _matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    """Rows of a column of lists, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(pa.compute.list_value_length(column))
    flat = np.asarray(column.flatten(), np.float64)
    if (lengths == dimension).all():
        return flat.reshape(-1, dimension)
    out = np.zeros((len(lengths), dimension))
    out[np.arange(dimension) < lengths[:, None]] = flat
    return out


def usable(embeddings: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """id, label and q (integers, as doubles) of the rows that take part, one per id."""
    column = F.col(vector)
    proper = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(
        F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
        F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("q"), proper.alias("proper"),
    ).where("id is not null and label is not null and q is not null and coalesce(proper, false)")
    return rows.groupBy("id").agg(F.min(F.struct("label", "q")).alias("row")).select("id", "row.label", "row.q")


class Index:
    """The multi-index over one table of (id, label, q)."""

    def __init__(self, rows: DataFrame):
        self.rows = written(rows, "vectors")
        self.spark = rows.sparkSession
        sizes = self.rows.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
        self.count, self.dimension = int(sizes[0]), int(sizes[1] or 0)
        if not self.count:
            return
        bound = max(1, min(SAMPLE, SAMPLE_VALUES // max(1, self.dimension)))
        sample = _matrix(bounded_sample(self.rows, bound, "id").select("q").toArrow().column("q"), self.dimension)
        count = max(1, min(CODES, len(sample), round((self.count / CELL) ** 0.5)))
        cut = -(-self.dimension // 2)
        codes = tuple(_means(np.ascontiguousarray(half), count) for half in (sample[:, :cut], sample[:, cut:]))
        books = Codebooks(codes, (np.zeros(count), np.zeros(count)), np.zeros((count, count), np.int64))
        self.lists = written(self._dealt(books), "cells")
        for row in self.lists.groupBy("list").agg(F.max("away").alias("away")).collect():  # a row for each code
            books.radii[0][row["list"]] = row["away"]
        for row in self.lists.groupBy("second").agg(F.max("second_away").alias("away")).collect():
            books.radii[1][row["second"]] = row["away"]
        for row in self.lists.groupBy("list", "second").count().collect():  # at most `CODES` squared numbers
            books.held[row["list"], row["second"]] = row["count"]
        self.books = self.spark.sparkContext.broadcast(books)
        self.parts = self.lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))

    def _dealt(self, books: Codebooks) -> DataFrame:
        shared, dimension = self.spark.sparkContext.broadcast(books), self.dimension

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                (first, second), (away, second_away) = shared.value.cells(_matrix(batch.column("q"), dimension))
                columns = [pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), pa.array(away), pa.array(second_away)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "list", "second", "away", "second_away"])

        schema = "id bigint, label bigint, q array<double>, list int, second int, away double, second_away double"
        return self.rows.select("id", "label", "q").mapInArrow(of, schema)

    def _visits(self, asking: DataFrame, first: bool) -> DataFrame:
        """For each anchor (id, label, q, windows of low, high and limit) a row for each first code with the second codes to visit.

        The first wave ends after `FIRST` vectors, or when no window reaches down to the next cell. The second does what the first did
        and goes on, handing out only what is new, until the next cell's bound is below every window's limit.
        """
        books, dimension = self.books, self.dimension

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = books.value.held
            for batch in batches:
                (top, low_top), (side, low_side) = books.value.bounds(_matrix(batch.column("q"), dimension))
                rows, lists, seconds = [], [], []
                for at, windows in enumerate(batch.column("windows").to_pylist()):
                    windows = [window for window in windows if window["low"] <= window["high"]]
                    if not windows:
                        continue
                    highest, lowest = max(w["high"] for w in windows), min(w["low"] for w in windows)
                    limit = min(max(w["limit"], w["low"]) for w in windows)
                    seen, chosen = 0, {}
                    for bound, i, j in by_bound(top[at], side[at]):
                        begun = seen < FIRST
                        if bound < (lowest if begun else limit) or first and not begun:
                            break
                        if not held[i, j] or low_top[at, i] + low_side[at, j] > highest:
                            continue
                        seen += held[i, j]
                        if begun == first:
                            chosen.setdefault(i, []).append(j)
                    rows += [at] * len(chosen)
                    lists += chosen
                    seconds += chosen.values()
                taken = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(lists, pa.int32()), pa.array(seconds, pa.list_(pa.int32()))], [*taken.schema.names, "list", "seconds"]
                )

        tasks = max(1, min(4096, -(-asking.count() // HEAPS)))
        return asking.repartition(tasks, "id").mapInArrow(of, f"{_ASKING}, list int, seconds array<int>")

    def _wave(self, asking: DataFrame, first: bool, same: bool, keep: int) -> DataFrame:
        """anchor, window, score and id of the ``keep`` best vectors in each window from each task, of the anchor's label or of others."""
        probes = written(self._visits(asking, first), "probes")
        chunks = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
        split = written(self.parts.join(chunks, "list"), "split")
        own = lambda name: F.pmod(F.xxhash64("id"), F.col(name)).cast("int")
        every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        lists = self.lists.join(split, "list").withColumn("part", own("parts")).withColumn("chunk", every("chunks"))
        meeting = probes.join(split, "list").withColumn("chunk", own("chunks")).withColumn("part", every("parts"))
        keys, dimension = ["list", "part", "chunk"], self.dimension
        compare = _comparing(dimension, same, keep)
        left = lists.select("id", "label", "q", "second", *keys).groupBy(*keys)
        right = meeting.select("id", "label", "q", "windows", "seconds", *keys).groupBy(*keys)
        return left.cogroup(right).applyInArrow(compare, "anchor bigint, window int, score double, id bigint")

    def best(self, asking: DataFrame, same: bool, keep: int) -> DataFrame:
        """anchor, window, score, id and place: exactly the ``keep`` best vectors of each window, from (id, label, q, windows)."""
        asking = written(asking, "asking")
        found = written(_placed(self._wave(asking, True, same, keep), keep), "first-wave")
        full = found.where(F.col("place") == keep).select("anchor", F.struct("window", "score").alias("one"))
        limits = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list("one")).alias("limits"))

        def limited(window: Column, place: Column) -> Column:
            known = F.try_element_at("limits", place.cast("int"))
            return F.struct(window["low"].alias("low"), window["high"].alias("high"), F.coalesce(known, window["limit"]).alias("limit"))

        again = asking.join(limits, asking["id"] == limits["anchor"], "left").select("id", "label", "q", F.transform("windows", limited).alias("windows"))
        more = self._wave(written(again, "asking-again"), False, same, keep)
        return _placed(found.select("anchor", "window", "score", "id").union(more), keep)


_ASKING = "id bigint, label bigint, q array<double>, windows array<struct<low:double,high:double,limit:double>>"


def _placed(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def _comparing(dimension: int, same: bool, keep: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64))]
        if left.num_rows and right.num_rows:
            ids, labels, second = (left.column(name).to_numpy() for name in ("id", "label", "second"))
            order = np.argsort(ids, kind="stable")
            ids, labels, second = ids[order], labels[order], second[order]
            vectors = _matrix(left.column("q"), dimension)[order]
            scores = _matrix(right.column("q"), dimension) @ vectors.T
            codes = int(second.max()) + 1
            for at, (anchor, label, windows, seconds) in enumerate(
                zip(*(right.column(name).to_pylist() for name in ("id", "label", "windows", "seconds")))
            ):
                visited = np.zeros(codes, bool)
                visited[[code for code in seconds if code < codes]] = True
                usable = np.flatnonzero(visited[second] & (labels == label if same else labels != label) & (ids != anchor))
                own = scores[at, usable]
                for number, window in enumerate(windows):
                    inside = usable[(own >= window["low"]) & (own <= window["high"])]
                    of_these = scores[at, inside]
                    if len(inside) > keep:  # cut to the best first; ties at the cut stay
                        near = of_these >= np.partition(of_these, len(inside) - keep)[len(inside) - keep]
                        inside, of_these = inside[near], of_these[near]
                    best = np.argsort(-of_these, kind="stable")[:keep]
                    rows.append((np.full(len(best), anchor), np.full(len(best), number + 1, np.int32), of_these[best], ids[inside[best]]))
        return pa.Table.from_arrays([pa.array(np.concatenate(part)) for part in zip(*rows)], ["anchor", "window", "score", "id"])

    return compare


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, from rows of (id, label, q).

    ``is_anchor`` is over id. Negatives score from ``low`` to ``high`` hundredths of their positive.
    """
    index = Index(rows)
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not index.count:
        return rows.sparkSession.createDataFrame([], out)
    anchors = written(index.rows.where(is_anchor), "anchors")
    endless = float("inf")
    one = F.array(F.struct(F.lit(-endless).alias("low"), F.lit(endless).alias("high"), F.lit(-endless).alias("limit")))
    near = written(index.best(anchors.select("id", "label", "q", one.alias("windows")), True, positives), "positives")
    # Scores are integers, so a window is the integers between both ends.
    listed = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("near"))
    window = lambda one: F.struct(
        F.ceil(one["score"] * low / 100).cast("double").alias("low"), F.floor(one["score"] * high / 100).cast("double").alias("high"),
        F.lit(-endless).alias("limit"),
    )
    asking = anchors.join(listed, anchors["id"] == listed["anchor"]).select("id", "label", "q", F.transform("near", window).alias("windows"))
    far = index.best(asking, False, negatives)
    chosen = near.select("anchor", F.col("place").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        far.join(chosen, ["anchor", "window"])
        .select(
            F.col("anchor").alias("anchor_id"), "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            F.col("positive_score").cast("bigint").alias("positive_score"), F.col("score").cast("bigint").alias("negative_score"),
        )
    )
