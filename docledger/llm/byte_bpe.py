"""Byte-level BPE with ranks of merges, in padded numpy matrices.

A text is cut at single spaces into stretches; a stretch and the space before it are tokenised alike wherever they occur, so
each task numbers its distinct stretches and tokenises these only. The distinct pieces of the pattern are put into matrices
by length (4, 8, 16, ... bytes, padded). In each round every row of a matrix merges its leftmost pair of the
smallest rank; the freed place is compacted away, the two new pairs are looked up in a hash table of pairs, and finished rows
leave the matrix. In rows above `LONG` bytes, a round merges all occurrences of that pair, if no pair
with the merged token has a smaller rank, which is the same order of merges.

Defined results: a null text counts as empty and has no ids. Nothing is a special token. A text in which white space follows white
space is cut by the pattern as a whole. Decoding takes ids of the vocabulary; null ids decode to no bytes. Rows with equal or null
ids stay rows; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import in_slices, whole_text

LONG = 256
#: Distinct stretches that a task keeps before it starts its numbering anew.
KEPT = 200_000
#: Bytes of text that are tokenised together.
SLICE = 4 << 20
NONE = np.int32(2**31 - 1)
#: Two white space characters in a row, by a class that is no smaller than the pattern's own.
DOUBLE = regex.compile(r"[\s\x1c-\x1f][\s\x1c-\x1f]")


class Vocabulary:
    """Token bytes by rank, and the hash table from pairs of tokens to the rank of their join."""

    def __init__(self, tokens: list[bytes]):
        self.ranks = {token: rank for rank, token in enumerate(tokens)}
        self.tokens = tokens
        lengths = np.array([len(token) for token in tokens])
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([self.ranks[bytes([value])] for value in range(256)], np.int32)
        keys, joined = [], []
        for rank, token in enumerate(tokens):
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    joined.append(rank)
        self._store(np.array(keys, np.int64), np.array(joined, np.int32))
        smallest = np.full(len(tokens), NONE, np.int32)
        for side in (np.array(keys, np.int64) >> 32, np.array(keys, np.int64) & 0xFFFFFFFF):
            np.minimum.at(smallest, side, np.array(joined, np.int32))
        #: Whether no pair with this token is merged before the pair that the token is made of.
        self.settled = smallest > np.arange(len(tokens))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _store(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slots, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.keys[slots] == -1)
            _, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.keys[slots[placed]], self.values[slots[placed]] = keys[placed], values[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each join, `NONE` where the pair joins to no token or a side is padding (below zero)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        flat = keys.ravel()
        found = np.full(flat.shape, NONE, np.int32)
        slots, open_places = self._slot(flat), np.arange(len(flat))
        for _ in range(self.probes):
            held = self.keys[slots]
            hit = held == flat[open_places]
            found[open_places[hit]] = self.values[slots[hit]]
            on = ~hit & (held != -1)
            if not on.any():
                break
            open_places, slots = open_places[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return found.reshape(left.shape)

    def decode(self, ids: np.ndarray) -> bytes:
        starts, lengths = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)
        return self.flat[places].tobytes()


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from lines of base64 text and rank; ranks count from zero without gaps."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = {int(rank): base64.b64decode(text) for text, rank in pairs}
    return [tokens[rank] for rank in range(len(tokens))]


def _merge_rows(vocabulary: Vocabulary, pieces: list[bytes], width: int) -> list[np.ndarray]:
    """Ids of pieces of at most ``width`` bytes, by rounds over one padded matrix."""
    lengths = np.array([len(piece) for piece in pieces])
    text = np.frombuffer(b"".join(piece.ljust(width, b"\0") for piece in pieces), np.uint8).reshape(-1, width)
    ids = np.where(np.arange(width) < lengths[:, None], vocabulary.single[text], np.int32(-1)).astype(np.int32)
    ranks = vocabulary.pair_ranks(ids[:, :-1], ids[:, 1:])
    rows, done = np.arange(len(pieces)), [None] * len(pieces)
    while len(rows):
        at = ranks.argmin(axis=1)
        best = ranks[np.arange(len(rows)), at]
        ended = best == NONE
        for row in np.flatnonzero(ended):
            done[rows[row]] = ids[row][ids[row] >= 0]
        if ended.any():
            rows, ids, ranks, at, best = rows[~ended], ids[~ended], ranks[~ended], at[~ended], best[~ended]
            if not len(rows):
                break
        each = np.arange(len(rows))
        ids[each, at] = best
        stays = np.ones(ids.shape, bool)
        stays[each, at + 1] = False
        ids = ids[stays].reshape(len(rows), -1)
        stays = np.ones(ranks.shape, bool)
        stays[each, at] = False
        ranks = ranks[stays].reshape(len(rows), -1)
        if ranks.shape[1] == 0:
            for row, one in zip(rows, ids):
                done[row] = one[one >= 0]
            break
        right = at < ranks.shape[1]
        ranks[each[right], at[right]] = vocabulary.pair_ranks(ids[each[right], at[right]], ids[each[right], at[right] + 1])
        left = at > 0
        ranks[each[left], at[left] - 1] = vocabulary.pair_ranks(ids[each[left], at[left] - 1], ids[each[left], at[left]])
    return done


def _merge_long(vocabulary: Vocabulary, piece: bytes) -> np.ndarray:
    """Ids of one long piece: each round merges the leftmost pair of the smallest rank, and its other occurrences."""
    ids = vocabulary.single[np.frombuffer(piece, np.uint8)]
    ranks = vocabulary.pair_ranks(ids[:-1], ids[1:])
    while len(ranks):
        best = ranks.min()
        if best == NONE:
            break
        at = np.flatnonzero(ranks == best)
        if not vocabulary.settled[best]:
            at = at[:1]
        elif len(at) > 1:  # of overlapping occurrences every second one, from the left
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
        ids[at] = best
        stays = np.ones(len(ids), bool)
        stays[at + 1] = False
        ids = ids[stays]
        stays = np.ones(len(ranks), bool)
        stays[at] = False
        ranks = ranks[stays]
        now = at - np.arange(len(at))
        for place in (now[now < len(ranks)], now[now > 0] - 1):
            ranks[place] = vocabulary.pair_ranks(ids[place], ids[place + 1])
    return ids


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> list[np.ndarray]:
    """Ids of each piece."""
    found: list = [None] * len(pieces)
    by_width: dict[int, list[int]] = {}
    for place, piece in enumerate(pieces):
        whole = vocabulary.ranks.get(piece)
        if whole is not None:
            found[place] = np.array([whole], np.int32)
        elif len(piece) > LONG:
            found[place] = _merge_long(vocabulary, piece)
        elif piece:
            by_width.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(place)
        else:
            found[place] = np.zeros(0, np.int32)
    for width, places in by_width.items():
        step = max(1, (1 << 20) // width)
        for start in range(0, len(places), step):
            part = places[start : start + step]
            for place, ids in zip(part, _merge_rows(vocabulary, [pieces[p] for p in part], width)):
                found[place] = ids
    return found


class Numbering(dict):
    """Numbers for keys in order of their first use."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``starts``, one after another."""
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


class Encoder:
    """Encodes texts with one vocabulary and pattern, and remembers stretches that it has met."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.cut = vocabulary, regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.known = Numbering(), 0
        self.flat, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Tokenise the stretches that were numbered since the last time."""
        new = list(self.numbers)[self.known :]
        pieces, counts = Numbering(), []
        order: list[int] = []
        for stretch in new:
            found = self.cut(stretch)
            counts.append(len(found))
            order += map(pieces.__getitem__, found)
        ids = encode_pieces(self.vocabulary, [piece.encode() for piece in pieces])
        sizes = np.array([len(one) for one in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        order_array = np.array(order, np.int64)
        starts = np.cumsum(sizes) - sizes
        ended = np.concatenate(([0], np.cumsum(sizes[order_array])))
        cuts = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        self.flat = np.concatenate((self.flat, gather(flat, starts[order_array], sizes[order_array])))
        self.lengths = np.concatenate((self.lengths, np.diff(ended[cuts])))
        self.known = len(self.numbers)

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        if len(self.numbers) > KEPT:
            self._forget()
        used: list[int] = []
        parts = []
        number = self.numbers.__getitem__
        for text in texts:
            if DOUBLE.search(text):
                found = [number(text)]
            else:
                head, *rest = text.split(" ")
                found = [number(head)]
                found += map(number, [" " + stretch for stretch in rest])
            used += found
            parts.append(len(found))
        if len(self.numbers) > self.known:
            self._learn()
        places = np.array(used, np.int64)
        lengths = self.lengths[places]
        ids = gather(self.flat, (np.cumsum(self.lengths) - self.lengths)[places], lengths)
        ended = np.concatenate(([0], np.cumsum(lengths)))
        cuts = np.concatenate(([0], np.cumsum(parts))).astype(np.int64)
        return ids, np.diff(ended[cuts])


_LOADED: dict[tuple, Encoder] = {}


def _encoder(tokens, pattern: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    key = (hash(tuple(tokens.value[:300])), len(tokens.value), pattern)
    if key not in _LOADED:
        _LOADED[key] = Encoder(Vocabulary(tokens.value), pattern)
    return _LOADED[key]


Batches = Iterator[pa.RecordBatch]


def _encode_batches(tokens, pattern: str, batches: Batches) -> Batches:
    encoder = _encoder(tokens, pattern)
    for batch in in_slices(batches, "text", SLICE):
        ids, counts = encoder.encode(batch.column("text").to_pylist())
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"]
        )


def _decode_batches(tokens, pattern: str, batches: Batches) -> Batches:
    vocabulary = _encoder(tokens, pattern).vocabulary
    for batch in batches:
        decoded = [vocabulary.decode(np.asarray(ids.values, np.int64)) if ids.is_valid else b"" for ids in batch.column("ids")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("ids"), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"]
        )


def _shared(df: DataFrame, ranks_path: str):
    """The tokens, read once by the driver and sent to the tasks; their size is that of a vocabulary, whatever the input."""
    return df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))


def _texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))


def encode(documents: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) for every row."""
    tokens = _shared(documents, ranks_path)
    return _texts(documents, doc_id, text).mapInArrow(lambda rows: _encode_batches(tokens, pattern, rows), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded (binary) for every row of (doc_id, ids)."""
    tokens = _shared(encoded, ranks_path)
    return encoded.select("doc_id", "ids").mapInArrow(lambda rows: _decode_batches(tokens, pattern, rows), DECODED)


DECODED = "doc_id bigint, ids array<int>, decoded binary"


def round_trip(documents: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids and decoded, from the texts through the ids and back, both by one Python worker of a task."""
    tokens = _shared(documents, ranks_path)

    def both(rows: Batches) -> Batches:
        return _decode_batches(tokens, pattern, _encode_batches(tokens, pattern, rows))

    return _texts(documents, doc_id, text).mapInArrow(both, DECODED)
