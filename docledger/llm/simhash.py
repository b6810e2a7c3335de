"""SimHash near-duplicates: fingerprints that differ in at most 3 of 64 bits, met in the middle.

Three is an odd radius, so it is first made even: the 64 bits are cut into three blocks, and of three differing bits
at least one lies in some block. With that block left out, two bits at most differ, and half of that radius is one.
Every distinct fingerprint therefore emits, for each block left out, the rest of its bits and all variants of them
within one bit: 132 keys. Two fingerprints within 3 bits share a key. Rows are shuffled and sorted by key, and within a
key the distances of the whole fingerprints are verified. Of a key's fingerprints a spanning star of each
component is returned, never all pairs. A key shared by more than `CROWD` fingerprints hands them on to the plain form
over all 64 bits (balls of radius one and two), where a variant is shared by 2,081 fingerprints at most and where
all that share it with one at distance one are linked.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is linked like any other.
Null ids are larger than any other; a component of null ids only has a null id. Repeated rows are all returned. An empty
table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import attach, whole_text, written
from docledger.llm.graph import components

RADIUS = 3
SEED = 42
BLOCKS = ((0, 22), (22, 43), (43, 64))
#: Fingerprints that are compared with each other in memory; more go on to the plain form.
CROWD = 2048
PIECE = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """Bits that are set in more than half of the hashes of all shingles of ``width`` words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    total, counts = len(starts), np.zeros(64, np.int64)
    for at in range(0, total, PIECE):
        part = zip(starts[at : at + PIECE].tolist(), ends[at : at + PIECE].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in part], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fingerprint as a signed 64-bit number, text_hash as `text_hash` gives it) for every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = np.fromiter((fingerprint(value.as_py(), width) for value in texts), np.uint64, batch.num_rows)
            columns = [batch.column("doc_id"), pa.array(found.view(np.int64)), batch.column("text_hash")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fingerprint", "text_hash"])

    read = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"), text_hash(text).alias("text_hash"))
    return read.mapInArrow(of, "doc_id bigint, fingerprint bigint, text_hash bigint")


def text_hash(text: str) -> Column:
    """With doc_id, what tells rows of different texts apart."""
    return F.xxhash64(whole_text(text))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _blockwise_keys(bits: Column) -> Column:
    """For each block, the other bits and their variants within one bit; the block itself holds its number."""
    keys = []
    for number, (low, high) in enumerate(BLOCKS, 1):
        block = ((1 << (high - low)) - 1) << low
        rest = bits.bitwiseAND(F.lit(_signed(~block & (1 << 64) - 1))).bitwiseXOR(F.lit(_signed(number << low)))
        flips = [0] + [1 << place for place in range(64) if not low <= place < high]
        keys += [rest.bitwiseXOR(F.lit(_signed(flip))) for flip in flips]
    return F.array(*keys)


def _pack(first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(first), pa.array(second)], ["a", "b"])


def _near(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether fingerprints are within `RADIUS`; of signed numbers, numpy would count the bits of the absolute value."""
    return np.bitwise_count((first ^ second).view(np.uint64)) <= RADIUS


def _stars(members: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A star for each component of one key's fingerprints under the verified distance."""
    near = _near(members[:, None], members[None, :])
    left, found = np.ones(len(members), bool), []
    while left.any():
        seed = int(left.argmax())
        reached = np.zeros(len(members), bool)
        edge = np.array([seed])
        while len(edge):
            reached[edge] = True
            edge = np.flatnonzero(near[edge].any(axis=0) & ~reached)
        left &= ~reached
        reached[seed] = False
        others = members[reached]
        if len(others):
            found.append((np.full(len(others), members[seed]), others))
    return found


def _link_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the fingerprints of each key, from rows sorted by key; (f, f) hands f on to the plain form."""

    def of_run(members: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return _stars(members) if len(members) <= CROWD else [(members, members)]

    key, held, crowded = None, np.zeros(0, np.int64), False  # the run that the last batch ended in
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys, bits = batch.column("key").to_numpy(), batch.column("fingerprint").to_numpy()
        starts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1))
        ends = np.concatenate((starts[1:], [len(keys)]))
        found = []
        if keys[0] == key:
            held, starts, ends, first = np.concatenate((held, bits[: ends[0]])), starts[1:], ends[1:], ends[0]
            if crowded or len(held) > CROWD:
                found.append((held, held))
                held, crowded = held[:0], True
            if not len(starts):
                if found:
                    yield _pack(*found[0])
                continue
        if len(held) > 1 and not crowded:
            found += of_run(held)
        sizes = ends - starts
        closed = slice(0, len(starts) - 1)
        two = starts[closed][sizes[closed] == 2]
        first, second = bits[two], bits[two + 1]
        near = _near(first, second)
        found.append((first[near], second[near]))
        for start, end in zip(starts[closed][sizes[closed] > 2].tolist(), ends[closed][sizes[closed] > 2].tolist()):
            found += of_run(bits[start:end])
        key, held, crowded = keys[-1], bits[starts[-1] :], False
        if len(held) > CROWD:
            found.append((held, held))
            held, crowded = held[:0], True
        yield _pack(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
    if len(held) > 1 and not crowded:
        for star in of_run(held):
            yield _pack(*star)


def _plain_links(crowd: DataFrame) -> DataFrame:
    """Links among fingerprints by balls over all 64 bits: whatever lies within two bits of a variant that is within
    one bit of another fingerprint is within three bits of that one."""
    flips = [0] + [1 << place for place in range(64)]
    pairs = [1 << i | 1 << j for i, j in combinations(range(64), 2)]
    bits = F.col("fingerprint")
    inner = crowd.select(
        "fingerprint", F.explode(F.transform(F.array(*[F.lit(_signed(x)) for x in flips]), lambda x: bits.bitwiseXOR(x))).alias("key")
    )
    outer = crowd.select(
        "fingerprint", F.explode(F.transform(F.array(*[F.lit(_signed(x)) for x in flips + pairs]), lambda x: bits.bitwiseXOR(x))).alias("key")
    )
    least = inner.groupBy("key").agg(F.min("fingerprint").alias("least"))
    return least.join(outer, "key").where("least <> fingerprint").select(F.col("least").alias("a"), F.col("fingerprint").alias("b"))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) that connect fingerprints exactly as the pairs within `RADIUS` bits do, from one row per fingerprint."""
    keyed = distinct.select("fingerprint", F.explode(_blockwise_keys(F.col("fingerprint"))).alias("key"))
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    found = written(dealt.mapInArrow(_link_keys, "a bigint, b bigint"), "links")
    crowd = found.where("a = b").select(F.col("a").alias("fingerprint")).distinct()
    close = found.where("a <> b")
    if crowd.isEmpty():
        return close
    return close.union(_plain_links(written(crowd, "crowd")))


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """For every row: doc_id, fingerprint (signed), component_id (the smallest doc_id reachable over links), root (a fingerprint
    that names the component, also where ids repeat) and text_hash."""
    rows = written(fingerprints(documents, doc_id, text, width), "fingerprints")
    distinct = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct.select("fingerprint")))
    placed = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    firsts = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = attach(placed.select("fingerprint", "root"), firsts, "root", "fingerprint")
    return attach(rows, named, "fingerprint", "doc_id").select("doc_id", "fingerprint", "component_id", "root", "text_hash")
