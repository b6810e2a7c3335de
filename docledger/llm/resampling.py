"""Importance resampling towards a target distribution, by hashed features that an Aho-Corasick dictionary composes.

The dictionary holds distinct words, each between two delimiters, with the payload CRC-32 of the word, CRC-32 of the word with a blank
after it, and the word's length in bytes. One automaton scans a whole block of texts and emits the payloads of the words it meets. A feature is
a run of one to three words joined by a blank. Its CRC-32 is composed from the payloads of adjacent words alone, since the
CRC of two strings is that of the first, moved over the second's length, xor that of the second; moves over a length are table lookups in
numpy. So no feature's text is ever built. A feature's bucket is its CRC modulo `BUCKETS`.

The dictionary is made of the words that most texts of a random sample hold (at most `WORDS`, from about `SAMPLE` texts of each
table), which only makes scans fast: words that it lacks are found by their delimiters and get
their payload on the spot, so every word of every text counts exactly.

Buckets are counted over all texts of both tables, each task adding up its own before anything is shuffled. A bucket's gain is
floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))), a document's weight the sum of its features' gains. A draw adds floor(-1000 ln(-ln u)),
with u from a hash of the seed and the document's id, and takes the largest. Ranks are given by ranges: a sort by range, positions within
each range, and the ranges' sizes added up, so no task sees all documents.

Defined results: words are what ASCII signs but letters and digits separate, in lower case as far as A to Z go. A null or empty text
has no words, features 0 and weight 0. Null ids hash as an empty one and come after all others in ties; rows that repeat an id are drawn each for
itself, alike. An empty table gives no rows; an empty target gives gains of the documents alone. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.common import in_slices, whole_text, written

BUCKETS = 10_000
#: The longest run of words that is a feature.
LONGEST = 3
#: Words of the dictionary, at most, and texts of each table that it is made from, about.
WORDS, SAMPLE = 50_000, 4_000
#: Bytes of text that are scanned as one.
BLOCK = 1 << 20

#: Bytes as the scan sees them: letters in lower case, other ASCII signs as blanks.
_PLAIN = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 48 <= byte <= 57 or 97 <= byte <= 122 or byte >= 128 else 32 for byte in range(256)
)


def _over_one_byte(crc: np.ndarray) -> np.ndarray:
    return (crc >> np.uint32(8)) ^ _BYTE[crc & np.uint32(255)]


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table.astype(np.uint32)


_BYTE = _byte_table()


class Moves:
    """How a CRC changes when so many bytes follow: four tables of 256 for each length, made when first asked for."""

    def __init__(self) -> None:
        base = np.arange(256, dtype=np.uint32)
        self.doubled = [_over_one_byte(np.stack([base << np.uint32(8 * place) for place in range(4)]))]  # over 1, 2, 4, ... bytes
        self.number: dict[int, int] = {}
        self.tables = np.zeros((64, 4, 256), np.uint32)

    @staticmethod
    def _moved(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
        parts = [table[place][(crc >> np.uint32(8 * place)) & np.uint32(255)] for place in range(4)]
        return parts[0] ^ parts[1] ^ parts[2] ^ parts[3]

    def _table(self, length: int) -> np.ndarray:
        found = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * place) for place in range(4)])
        power = 0
        while length >> power:
            if power == len(self.doubled):
                self.doubled.append(self._moved(self.doubled[-1], self.doubled[-1]))
            if length >> power & 1:
                found = self._moved(found, self.doubled[power])
            power += 1
        return found

    def over(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        distinct, which = np.unique(lengths, return_inverse=True)
        for length in distinct.tolist():
            if length not in self.number:
                if len(self.number) == len(self.tables):
                    self.tables = np.concatenate((self.tables, np.zeros_like(self.tables)))
                self.tables[len(self.number)] = self._table(length)
                self.number[length] = len(self.number)
        at = np.array([self.number[length] for length in distinct.tolist()], np.int64)[which]
        flat = self.tables.reshape(-1)
        base = at << 10
        out = flat[base + (crc & np.uint32(255))]
        for place in range(1, 4):
            out ^= flat[base + (place << 8) + ((crc >> np.uint32(8 * place)) & np.uint32(255))]
        return out


class Dictionary:
    """The automaton over delimited words, and their payloads by number."""

    def __init__(self, words: list[bytes]):
        self.automaton = ahocorasick.Automaton()
        for number, word in enumerate(words):
            self.automaton.add_word(f" {word.decode('latin-1')} ", number)
        if words:
            self.automaton.make_automaton()
        self.plain, self.blank, self.length = payloads(words)
        self.moves = Moves()

    def words(self, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, CRC, CRC with a blank, and length of each word of a block that begins and ends with a blank."""
        inside = np.frombuffer(block, np.uint8) != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        plain, blank = np.zeros(len(starts), np.uint32), np.zeros(len(starts), np.uint32)
        known = np.zeros(len(starts), bool)
        if len(self.plain):
            scan = self.automaton.iter(block.decode("latin-1"))
            while found := [*islice(scan, 1 << 18)]:
                at, numbers = (np.array(column) for column in zip(*found))  # the place of the blank after the word
                word = np.searchsorted(ends, at)
                plain[word], blank[word], known[word] = self.plain[numbers], self.blank[numbers], True
        for place in np.flatnonzero(~known).tolist():
            crc = zlib.crc32(block[starts[place] : ends[place]])
            plain[place], blank[place] = crc, zlib.crc32(b" ", crc)
        return starts, plain, blank, ends - starts

    def buckets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket) of every feature of ``texts``, and how many words each text has."""
        block = b" " + b" ".join(texts).translate(_PLAIN) + b" "
        begins = np.cumsum([1] + [len(text) + 1 for text in texts[:-1]])
        starts, plain, blank, length = self.words(block)
        text = np.searchsorted(begins, starts, "right") - 1
        owners, found = [text], [plain]
        run, run_blank = plain, blank  # of the runs that begin at each word
        for size in range(1, LONGEST):
            if len(starts) <= size:
                break
            over, ahead = length[size:], run_blank[: len(starts) - size]
            run = self.moves.over(ahead, over) ^ plain[size:]
            run_blank = self.moves.over(ahead, over + 1) ^ blank[size:] if size + 1 < LONGEST else run
            whole = text[size:] == text[:-size]
            owners.append(text[size:][whole])
            found.append(run[whole])
        return np.concatenate(owners), np.concatenate(found) % np.uint32(BUCKETS), np.bincount(text, minlength=len(texts))


def payloads(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    crcs = [zlib.crc32(word) for word in words]
    return np.array(crcs, np.uint32), np.array([zlib.crc32(b" ", crc) for crc in crcs], np.uint32), np.array([len(word) for word in words], np.int64)


_MADE: dict[int, Dictionary] = {}


def _dictionary(shared: Broadcast) -> Dictionary:
    """The worker's automaton for the words; it is made once, not for each task."""
    number = hash(tuple(shared.value))
    if number not in _MADE:
        _MADE.clear()
        _MADE[number] = Dictionary(shared.value)
    return _MADE[number]


def frequent_words(*tables: DataFrame, text: str = "text") -> list[bytes]:
    """The words that most texts of a sample of each table hold."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for value in batch.column("text").cast(pa.binary()).to_pylist():
                counts.update(set(value.translate(_PLAIN).split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "texts"])

    counted = None
    for table in tables:
        rows = table.count()
        sample = table.where(F.rand(11) < SAMPLE / max(1, rows)).select(whole_text(text).alias("text"))
        one = sample.mapInArrow(of, "word binary, texts bigint")
        counted = one if counted is None else counted.union(one)
    top = counted.groupBy("word").agg(F.sum("texts").alias("texts")).where(F.length("word") <= 64).orderBy(F.desc("texts"), "word").limit(WORDS)
    return [bytes(row["word"]) for row in top.collect()]


def bucket_counts(table: DataFrame, shared: Broadcast, text: str = "text") -> DataFrame:
    """bucket and features: one row from each task and bucket, added up."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, total = _dictionary(shared), np.zeros(BUCKETS, np.int64)
        for batch in in_slices(batches, "text", BLOCK):
            _, buckets, _ = dictionary.buckets(batch.column("text").cast(pa.binary()).to_pylist())
            total += np.bincount(buckets, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "features"])

    counted = table.select(whole_text(text).alias("text")).mapInArrow(of, "bucket int, features bigint")
    return counted.groupBy("bucket").agg(F.sum("features").alias("features"))


def gains(documents: DataFrame, target: DataFrame, shared: Broadcast) -> np.ndarray:
    """Each bucket's gain; a table of `BUCKETS` numbers."""
    counts = []
    for table in (documents, target):
        one = np.zeros(BUCKETS)
        for row in bucket_counts(table, shared).collect():  # at most a row for each bucket
            one[row["bucket"]] = row["features"]
        counts.append(one)
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weigh(documents: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    named = [table.select(F.col(text).alias("text")) for table in (documents, target)]
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(frequent_words(*named))  # at most `WORDS` words of 64 bytes
    gained = spark.sparkContext.broadcast(gains(*named, shared))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, gain = _dictionary(shared), gained.value
        for batch in in_slices(batches, "text", BLOCK):
            rows = batch.num_rows
            owners, buckets, words = dictionary.buckets(batch.column("text").cast(pa.binary()).to_pylist())
            features = np.bincount(owners, minlength=rows)
            weight = np.bincount(owners, gain[buckets], rows)  # sums stay far below 2^53
            columns = [batch.column("doc_id"), *(pa.array(one.astype(np.int64)) for one in (words, features, weight))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    read = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    return read.mapInArrow(of, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = 42) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("bigint")


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their range and their place in it."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        places = pa.array(np.arange(before + 1, before + 1 + batch.num_rows))
        before += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), places], [*batch.schema.names, "part", "place"])


def draw(weighed: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is null unless the row is among the ``percent`` of documents with
    ``least_words`` words or more that are drawn."""
    columns = ["doc_id", "n_features", "weight", "score", "n_words", "row"]
    numbered = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    scored = written(numbered.select(columns), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    wanted = able.count() * percent // 100
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("row")]  # repeated rows are dealt over ranges as well
    ranged = able.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = "doc_id bigint, n_features bigint, weight bigint, score bigint, n_words bigint, row bigint, part int, place bigint"
    placed = written(ranged.mapInArrow(_positions, kind), "placed")
    sizes = placed.groupBy("part").agg(F.max("place").alias("size"))  # a row for each task
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = placed.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn("rank", F.col("before") + F.col("place"))
    drawn = ranks.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.select(out).union(rest.select(out))


def resample(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    return draw(weigh(documents, target), percent, least_words, seed)
