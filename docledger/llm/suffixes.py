"""Passages that repeat across documents, by anchors and hashes of all passages around shared ones.

Words are hashed. Of every `WINDOW` successive stretches of `GRAM` words that with the smallest hash is an anchor, so that
positions are chosen by content: two documents that share `LEAST` words share an anchor within them, the least stretch of the
passage. Anchors whose stretch occurs in one document are dropped by a count; the documents are read again, and every passage of `LEAST` words
whose least stretch is left is written as a hash of 64 bits. Passages are dealt by ranges of (hash, document, place), so that
one that a third of all documents hold is cut into many tasks, and sorted; each run of a hash names its two smallest documents, across
batches and, by the ends of tasks, across tasks. This misses nothing, at any size of a run. Overlapping passages of a document are
merged, those that a smaller document holds apart from the others (spans of the two kinds may overlap), so repeats of any length are covered whole.

Words are what ASCII white space separates, compared byte by byte, by hashes of 64 bits.

Defined results: a null text counts as empty; texts of fewer than `LEAST` words have no spans. Rows without doc_id take no part; rows
that repeat doc_id are one document (their texts' spans are merged). Repeats within one document only don't count. An empty table gives no rows.
Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.common import whole_text, written

LEAST = 50
GRAM = 8
WINDOW = LEAST - GRAM + 1


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return values ^ (values >> np.uint64(29))


def _stretches(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all stretches of at least `LEAST` words, and the least of those in each passage of `LEAST` words."""
    count = len(words) - GRAM + 1
    grams = np.zeros(count, np.uint64)
    for place in range(GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[place : place + count]
    grams = _mixed(grams)
    least, span = grams, 1  # least of each `span` successive stretches, by doubling
    while span * 2 <= WINDOW:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    rest = WINDOW - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return grams, least


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes of the stretches there) for one document's word hashes."""
    count = len(words) - GRAM + 1
    if count < WINDOW:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    grams, least = _stretches(words)
    # A stretch is an anchor if it is the least of any window that holds it: compare with the largest of those windows' least.
    most = np.full(count, 0, np.uint64)
    padded = np.concatenate((np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)))
    top, span = padded, 1
    while span * 2 <= WINDOW:
        top, span = np.maximum(top[:-span], top[span:]), span * 2
    rest = WINDOW - span
    if rest:
        top = np.maximum(top[:-rest], top[rest:])
    most = top[:count]
    chosen = np.flatnonzero(grams == most)
    return chosen.astype(np.int32), grams[chosen].view(np.int64)


def _anchor_rows(documents: DataFrame) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(word_hashes(text.as_py())) for text in batch.column("text").cast(pa.binary())]
            sizes = [len(places) for places, _ in found]
            if sum(sizes):
                columns = [
                    pa.array(np.repeat(batch.column("doc_id").to_numpy(), sizes)), pa.array(np.concatenate([p for p, _ in found])),
                    pa.array(np.concatenate([k for _, k in found])),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "pos", "gram"])

    return documents.mapInArrow(of, "doc_id bigint, pos int, gram bigint")


def passages(words: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the passages of `LEAST` words whose least stretch is among ``shared``."""
    grams, least = _stretches(words)
    chosen = np.flatnonzero(np.isin(least, shared.view(np.uint64)))
    hashes = np.zeros(len(chosen), np.uint64)
    for place in [*range(0, LEAST - GRAM, GRAM), LEAST - GRAM]:
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + grams[chosen + place]
    return chosen.astype(np.int32), _mixed(hashes).view(np.int64)


def _passage_rows(documents: DataFrame) -> DataFrame:
    """hash, doc_id and pos of passages, from (doc_id, text, places)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, text, places in zip(*(batch.column(name) for name in ("doc_id", "text", "places"))):
                words = word_hashes(text.cast(pa.binary()).as_py())
                chosen, grams = anchors(words)
                shared = grams[np.isin(chosen, np.asarray(places.values))]
                if not len(shared):
                    continue
                found, hashes = passages(words, shared)
                for start in range(0, len(found), 1 << 16):
                    at, keys = found[start : start + (1 << 16)], hashes[start : start + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(at), id_.as_py(), np.int64)), pa.array(at)], ["hash", "doc_id", "pos"])

    return documents.mapInArrow(of, "hash bigint, doc_id bigint, pos int")


_MATCH = "doc_id bigint, pos int, partner bigint, hash bigint"


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages that come sorted by hash, document and place, with the smallest other document that holds them.

    The first run of a task may have begun in an earlier task, and the last may go on in a later one. Rows that this
    leaves open keep their hash, and rows without pos name the two smallest documents of the task's part of these runs.
    """
    names = ["doc_id", "pos", "partner", "hash"]
    key = np.zeros(0, np.int64)
    doc, pos = np.zeros(0, np.int64), np.zeros(0, np.int32)  # of the last run: all its rows while it has one document, else its two smallest
    opening = None  # the hash of the task's first run
    opened: tuple = ()  # its two smallest documents

    def pack(doc_id: np.ndarray, at: np.ndarray, partner: np.ndarray, known: np.ndarray, hashes: np.ndarray, unsure: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_id), pa.array(at), pa.array(partner, mask=~known), pa.array(hashes, mask=~unsure)], names
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, pos = (
            np.concatenate((old, batch.column(name).to_numpy())) for old, name in ((key, "hash"), (doc, "doc_id"), (pos, "pos"))
        )
        if opening is None:
            opening = key[0]
        begins = np.concatenate(([True], key[1:] != key[:-1]))
        starts = np.flatnonzero(begins)
        run = np.cumsum(begins) - 1
        first = doc[starts]
        others = np.flatnonzero(doc != first[run])  # of these, the first one of each run is its second smallest document
        second, several = first.copy(), np.zeros(len(starts), bool)
        second[run[others[::-1]]] = doc[others[::-1]]
        several[run[others]] = True
        if key[0] == opening:
            opened = (first[0], second[0])
        unsure = key == opening
        ready = (pos >= 0) & (several[run] | unsure & (run < len(starts) - 1))
        partner = np.where(doc == first[run], second[run], first[run])
        yield pack(doc[ready], pos[ready], partner[ready], several[run][ready], key[ready], unsure[ready])
        last = slice(starts[-1], None)
        if several[-1]:
            key, doc, pos = key[-1:].repeat(2), np.array([first[-1], second[-1]]), np.array([-1, -1], np.int32)
        else:
            key, doc, pos = key[last], doc[last], pos[last]
    if opening is not None:
        left = pos >= 0
        yield pack(doc[left], pos[left], doc[left], np.zeros(left.sum(), bool), key[left], np.ones(left.sum(), bool))
        ends = {(int(opening), int(opened[0]), int(opened[1])), (int(key[0]), int(doc[0]), int(doc[-1]))}
        hashes, least, next_ = (pa.array(column, pa.int64()) for column in zip(*sorted(ends)))
        yield pa.RecordBatch.from_arrays([least, pa.nulls(len(ends), pa.int32()), next_, hashes], names)


def repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start and end (words, end exclusive), n_words, partner (the smallest other doc_id found to hold a part of it) and
    removable (whether a smaller one holds each of its passages, so a copy stays if the span goes), for every merged span."""
    read = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text")).where("doc_id is not null")
    found = written(_anchor_rows(read), "anchors")
    counted = found.groupBy("gram", "doc_id").agg(F.lit(1).alias("one")).groupBy("gram").agg(F.count("one").alias("documents"))
    shared = written(counted.where("documents > 1").select("gram"), "shared")
    places = written(found.join(shared, "gram").groupBy("doc_id").agg(F.collect_set("pos").alias("places")), "places")
    found = written(_passage_rows(read.join(places, "doc_id").select("doc_id", "text", "places")), "passages")
    return _merged(_matched(found).select("doc_id", F.col("pos").alias("start"), (F.col("pos") + LEAST).alias("end"), "partner"))


def _matched(found: DataFrame) -> DataFrame:
    """doc_id, pos and partner of the passages that two documents or more hold."""
    order = ["hash", "doc_id", "pos"]
    matches = written(found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_match, _MATCH), "matches")
    # Two rows for each task at most, whatever the tasks hold.
    ends = matches.where("pos is null").groupBy("hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("doc_id", "partner"))))).alias("holders"))
    ends = written(ends.select("hash", F.get("holders", F.lit(0)).alias("least"), F.get("holders", F.lit(1)).alias("next")), "ends")
    # All rows pass through one join with this bounded table; rows without hash are settled and keep their partner.
    named = F.when(F.col("doc_id") == F.col("least"), F.col("next")).otherwise(F.col("least"))
    partner = F.when(F.col("hash").isNull(), F.col("partner")).otherwise(named)
    joined = matches.where("pos is not null").join(F.broadcast(ends), "hash", "left")
    return joined.select("doc_id", "pos", partner.alias("partner")).where("partner is not null")


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a document become one, those with a smaller partner apart from the others."""
    each = spans.withColumn("removable", F.col("partner") < F.col("doc_id"))
    order = Window.partitionBy("doc_id", "removable").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.coalesce(before, F.lit(-1)) < F.col("start"), 1).otherwise(0)
    return (
        each.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order))
        .groupBy("doc_id", "removable", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("partner").alias("partner"))
        .select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "partner", "removable")
    )
