"""Approximate nearest neighbours by balanced posting lists.

`fit` takes a bounded sample of vectors (at most `SAMPLE` vectors and `SAMPLE_VALUES` numbers, those with the smallest hashes)
and splits it again and again into balanced clusters until each holds few; their means are the centroids, about one for every
`LIST` distinct vectors, and at most a quarter of the sample. Centroids are linked to their nearest others in a graph
that is searched in memory by a beam, for a batch of vectors at once.

Every distinct vector goes to the list of its nearest centroid; a vector near a boundary is also written to the lists of other
centroids that are nearly as near (ratios are taken of the usual distance, where a vector is nearer than that). A query walks the graph, keeps the centroids whose
distance is within a ratio of the nearest one's, and meets the lists of these. Lists that are long, and lists that many
queries ask for, are dealt in parts over several tasks, so a task holds a bounded number of both.

Equal vectors are indexed once, with their smallest ids: as many as can be among the nearest. So a vector
that a third of all rows repeat costs one entry, and queries with equal vectors are searched once.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those whose
length isn't the most frequent one (ties: the shorter). Ids that are null take no part; of rows that repeat an id with
several vectors, that of the smallest vector counts. Ties go to the smaller id. A query without candidates has no rows; an empty
table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.common import attach, bounded_sample, written

SAMPLE = 50_000
SAMPLE_VALUES = 1 << 23
#: Distinct vectors for each centroid, as long as the sample allows.
LIST = 24
#: Lists that a vector is written to, at most, and how much farther than the nearest centroid they may be.
COPIES, COPY_RATIO = 4, 1.25
#: Centroids that a query's beam keeps: this share of all, and so many at least. Lists whose centroid is farther than the
#: ratio times the nearest one aren't searched. Vectors without any structure need this many for a recall over 0.9.
SHARE, BEAM, PROBE_RATIO = 0.1, 96, 1.45
LINKS, BACK = 24, 16
#: Vectors and queries that one task compares at a time.
PART, CHUNK = 4096, 2048


@dataclass
class Centroids:
    """Centroids with the links of their graph."""

    points: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    #: Median distance of the sample's vectors to their nearest centroid; a smaller one is no measure of what is near.
    scale: float

    def search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, distances) of near centroids for each vector, nearest first; -1 and infinity where there are fewer."""
        rows, beam = np.arange(len(vectors)), min(beam, len(self.points))
        seen = np.zeros((len(vectors), len(self.points)), bool)
        seen[:, self.entries] = True
        found = np.tile(self.entries, (len(vectors), 1))
        away = _distances(vectors, self.points[found])
        open_ = np.ones(found.shape, bool)
        while True:
            order = np.argsort(away, axis=1, kind="stable")[:, :beam]
            found, away, open_ = (np.take_along_axis(x, order, 1) for x in (found, away, open_))
            at = open_.argmax(axis=1)
            active = rows[open_[rows, at]]
            if not len(active):
                return found, away
            open_[active, at[active]] = False
            near = self.links[found[active, at[active]]]
            fresh = ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            width = near.shape[1]
            added = np.full((len(vectors), width), -1)
            added_away = np.full((len(vectors), width), np.inf)
            added[active] = np.where(fresh, near, -1)
            added_away[active] = np.where(fresh, _distances(vectors[active], self.points[near]), np.inf)
            found, away = np.hstack((found, added)), np.hstack((away, added_away))
            open_ = np.hstack((open_, added >= 0))


def _distances(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.sqrt(((others - vectors[:, None, :]) ** 2).sum(axis=2))


def _means(points: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """The cluster number of each point, by k-means whose clusters hold at most 1.5 times their share."""
    centres = points[rng.choice(len(points), count, replace=False)]
    room = int(np.ceil(1.5 * len(points) / count))
    for _ in range(rounds):
        away = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)
        order = np.argsort(away, axis=1)
        number = np.full(len(points), -1)
        left = np.full(count, room)
        for choice in range(count):  # who finds the nearest full takes the next one
            waiting = np.flatnonzero(number < 0)
            wanted = order[waiting, choice]
            for cluster in np.unique(wanted):
                mine = waiting[wanted == cluster]
                mine = mine[np.argsort(away[mine, cluster], kind="stable")][: left[cluster]]
                number[mine] = cluster
                left[cluster] -= len(mine)
        centres = np.array([points[number == c].mean(axis=0) if (number == c).any() else centres[c] for c in range(count)])
    return number


def balanced_centroids(sample: np.ndarray, count: int, seed: int = 11) -> np.ndarray:
    """About ``count`` means of balanced clusters of the sample, by repeated splits into up to eight."""
    rng, todo, found = np.random.default_rng(seed), [sample], []
    leaf = max(1.0, len(sample) / max(1, count))
    while todo:
        points = todo.pop()
        parts = min(8, int(round(len(points) / leaf)), len(points))
        if parts <= 1:
            found.append(points.mean(axis=0))
            continue
        number = _means(points, parts, rng)
        todo += [points[number == part] for part in range(parts) if (number == part).any()]
    return np.array(found)


def build_graph(points: np.ndarray, sample: np.ndarray, seed: int = 11) -> Centroids:
    """Each centroid is linked to its nearest others and to a few anywhere, and links go both ways where there is room."""
    rng, count = np.random.default_rng(seed), len(points)
    width = min(LINKS, count - 1)
    near = np.zeros((count, width), np.int64)
    squares = (points**2).sum(1)
    for start in range(0, count, 1024):
        rows = np.arange(start, min(count, start + 1024))
        away = squares[rows][:, None] - 2 * points[rows] @ points.T + squares
        away[np.arange(len(rows)), rows] = np.inf
        near[rows] = np.argsort(away, axis=1)[:, :width]
    far = rng.integers(0, count, (count, min(2, count)))
    # Some points are near to nobody; each is linked from several of its neighbours, the nearest that still have room.
    back = np.repeat(np.arange(count)[:, None], BACK, axis=1)
    filled = np.zeros(count, np.int64)
    for centroid, others in enumerate(near):
        placed = 0
        for other in others.tolist():
            if filled[other] < BACK:
                back[other, filled[other]] = centroid
                filled[other] += 1
                placed += 1
                if placed == BACK // 2:
                    break
    entries = np.unique(np.linspace(0, count - 1, min(16, count)).astype(np.int64))
    links = np.sort(np.hstack((near, far, back)), axis=1)
    links[:, 1:][links[:, 1:] == links[:, :-1]] = -1
    links = np.where(links < 0, np.arange(count)[:, None], links)  # a link that is there already leads to the point itself
    graph = Centroids(points, links, entries, 0.0)
    nearest = [graph.search(sample[start : start + 512], 8)[1][:, 0] for start in range(0, min(len(sample), 4096), 512)]
    graph.scale = float(np.median(np.concatenate(nearest)))
    return graph


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dimension)


def usable(embeddings: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, vector) of those rows that take part, one per id, and the vectors' length."""
    column = F.col(vector)
    proper = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(column, lambda x: x != 0)
    rows = embeddings.select(F.col(vec_id).cast("bigint").alias("vec_id"), column.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(proper, F.lit(False))
    )
    lengths = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if lengths is None:
        return rows, 0
    return rows.where(F.size("vector") == lengths["size"]).groupBy("vec_id").agg(F.min("vector").alias("vector")), lengths["size"]


def _probe(queries: DataFrame, centroids, dimension: int, schema: str, beam: int, pick) -> DataFrame:
    """Rows of ``queries`` (id, vector), once for each list that ``pick`` chooses from the beam's finds."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = centroids.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                vectors = _matrix(part.column("vector"), dimension)
                found, away = graph.search(vectors, beam)
                row, place = np.nonzero(pick(graph, found, away))
                lists = found[row, place]
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.astype(np.int32)), part.column("id").take(taken), part.column("vector").take(taken)],
                    ["list", "id", "vector"],
                )

    return queries.select("id", "vector").mapInArrow(of, schema)


def _copies(graph: Centroids, found: np.ndarray, away: np.ndarray) -> np.ndarray:
    """Which of the nearest centroids get a copy: those nearly as near as the first. (Leaving out a centroid that lies behind
    a chosen one, as is often done, leaves no copies at all where vectors have little structure.)"""
    chosen = (found >= 0) & (away <= COPY_RATIO * np.maximum(away[:, :1], graph.scale))
    chosen[:, COPIES:] = False
    chosen[:, 0] = True
    return chosen


def _probes(graph: Centroids, found: np.ndarray, away: np.ndarray) -> np.ndarray:
    return (found >= 0) & (away <= PROBE_RATIO * np.maximum(away[:, :1], graph.scale))


class Index:
    """Posting lists of all distinct vectors, with their centroids."""

    def __init__(self, embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", nearest: int = 10):
        self.nearest = nearest
        rows, self.dimension = usable(embeddings, vec_id, vector)
        self.rows = written(rows, "vectors")
        self.type = dict(self.rows.dtypes)["vector"]
        if not self.dimension:
            return
        spark = embeddings.sparkSession
        place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
        few = self.rows.withColumn("place", place).where(F.col("place") <= nearest + 1)
        self.distinct = written(
            few.groupBy("vector").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct-vectors"
        )
        count = self.distinct.count()
        bound = max(1, min(SAMPLE, SAMPLE_VALUES // self.dimension))
        sample = bounded_sample(self.distinct, bound, "id").select("vector").toArrow()
        points = _matrix(sample.column("vector").combine_chunks(), self.dimension)
        lists = max(1, min(-(-count // LIST), -(-len(points) // 4)))
        self.centroids = spark.sparkContext.broadcast(build_graph(balanced_centroids(points, lists), points))
        self.schema = f"list int, id bigint, vector {self.type}"
        self.lists = written(_probe(self.distinct, self.centroids, self.dimension, self.schema, COPIES * 8, _copies), "lists")
        self.parts = _parts(self.lists, PART, "parts")

    def search(self, is_query: Column) -> DataFrame:
        """query_id, rank, vec_id and score (distance) of each query's nearest others found; ``is_query`` is over vec_id."""
        out = "query_id bigint, rank int, vec_id bigint, score double"
        spark = self.rows.sparkSession
        if not self.dimension:
            return spark.createDataFrame([], out)
        asked = written(
            attach(self.rows.where(is_query), self.distinct.select("vector", "id"), "vector", "vec_id").select("vec_id", "id"), "queries"
        )
        wanted = self.distinct.select("id", "vector").join(asked.select("id").distinct(), "id", "left_semi")
        probes = written(_probe(wanted, self.centroids, self.dimension, self.schema, max(BEAM, int(SHARE * len(self.centroids.value.points))), _probes), "probes")
        split = written(self.parts.join(_parts(probes, CHUNK, "chunks"), "list"), "split")
        own = lambda name: F.pmod(F.xxhash64("id"), F.col(name)).cast("int")
        every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        columns = [*self.lists.columns, "part", "chunk"]
        lists = self.lists.join(split, "list").withColumn("part", own("parts")).withColumn("chunk", every("chunks")).select(columns)
        asking = probes.join(split, "list").withColumn("chunk", own("chunks")).withColumn("part", every("parts")).select(columns)
        keys, keep, dimension = ["list", "part", "chunk"], self.nearest + 1, self.dimension

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            asked_ids, ids = right.column("id").to_numpy(), left.column("id").to_numpy()
            rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if len(ids) and len(asked_ids):
                vectors = _matrix(left.column("vector").combine_chunks(), dimension)
                queries = _matrix(right.column("vector").combine_chunks(), dimension)
                for at, query in enumerate(queries):
                    away = np.sqrt(((vectors - query) ** 2).sum(axis=1))
                    best = np.lexsort((ids, away))[:keep]
                    rows.append((np.full(len(best), asked_ids[at]), ids[best], away[best]))
            columns = [pa.array(np.concatenate(parts)) for parts in zip(*rows)]
            return pa.Table.from_arrays(columns, ["asked", "id", "score"])

        met = lists.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(compare, "asked bigint, id bigint, score double")
        by_query = Window.partitionBy("asked").orderBy("score", "id")
        nearest = met.distinct().withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= keep)
        named = nearest.join(self.distinct.select("id", "ids"), "id").select("asked", "score", F.explode("ids").alias("vec_id"))
        by_id = Window.partitionBy("asked").orderBy("score", "vec_id")
        answers = named.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= keep)
        listed = answers.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
        each = attach(asked, listed.withColumnRenamed("asked", "id"), "id", "vec_id")
        others = F.slice(F.filter("found", lambda one: one["vec_id"] != F.col("query_id")), 1, self.nearest)
        return (
            each.select(F.col("vec_id").alias("query_id"), "found").select("query_id", F.posexplode(others).alias("place", "one"))
            .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"))
        )


def _parts(rows: DataFrame, size: int, name: str) -> DataFrame:
    """How many parts of about ``size`` rows each list makes: one row for each list, bounded by the sample."""
    return rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
