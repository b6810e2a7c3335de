"""Token ids in files: frequency-ranked numbers in whole bytes, with their lengths in separate control bytes.

Texts are tokenised once and written as narrow rows. The ids are counted over all of them and ranked by frequency (the
most frequent id gets rank 0, ties go to the smaller id). Rows are then dealt by ranges of doc_id, sorted, and written in blocks of
whole documents. A block holds, beside doc_ids and lengths, one control byte for every four ids (two bits for each: its
number of bytes less one) and the ranks' bytes, lowest first. A reader looks each control byte up in a table
of lengths, adds these up to places, and gathers all ranks of a block at once.

Files lie in a folder: ``blocks`` and ``vocabulary`` (rank, id), stored with Spark's own writer and so committed as a
whole, on any store that Spark knows. Ids of a document may be read without those of any other block.

Defined results: a null text counts as empty and holds the end id only. Null doc_ids come first; rows that repeat a doc_id
stay rows, in order of checksum and length. An empty table gives files without blocks. Other columns aren't read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm.byte_bpe import SLICE, Numbering, gather
from docledger.llm.common import in_slices, whole_text, written

#: Ids of a block, unless a single document has more.
BLOCK = 1 << 18
#: Distinct stretches that a task keeps before it starts its numbering anew, and how many go to the tokenizer in one text.
KEPT, JOINED = 400_000, 20_000
_LENGTHS = np.array([[(control >> 2 * place & 3) + 1 for place in range(4)] for control in range(256)], np.uint8)
_WIDTHS = {2: "<u2", 4: "<u4"}
BLOCK_TYPE = "part int, block int, start bigint, n_tokens bigint, doc_ids array<bigint>, lengths array<bigint>, control binary, data binary"


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of numbers below 2^32."""
    ranks = ranks.astype("<u4")
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < sizes[:, None]].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The numbers that `pack` got."""
    sizes = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count].astype(np.int64)
    filled = np.zeros((count, 4), np.uint8)
    filled[np.arange(4) < sizes[:, None]] = np.frombuffer(data, np.uint8)
    return filled.view("<u4").ravel()


#: A stop or comma at a word's end after anything but a letter or digit that stays one in lower case and in composed form.
_SIGNS = re.compile(r"[^A-Za-z0-9À-ÖØ-öø-ÿ \n][.,] ")


_WIDE = re.compile(r"[^\x00-\xff]")
#: Words that are one piece as they stand: lower case, composed, letters only.
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+")
#: Byte-level pieces spell each byte by one character: printable ones by themselves, the others by those from U+0100 on, in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELLED = {byte: byte for byte in _PRINTED} | {
    byte: 0x100 + place for place, byte in enumerate(byte for byte in range(0x100) if byte not in _PRINTED)
}


class WordEncoder:
    """A tokenizer that drops white space and case, applied once to each distinct stretch between spaces.

    Line ends become spaces, a stop or comma after a letter or digit is a piece of its own and set apart, and texts of Latin-1 signs are
    put in lower case first, so that fewer stretches are distinct; all of this changes nothing in what the tokenizer sees. Words that are plainly one piece go straight to
    the tokenizer's model, all others through the whole tokenizer.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        added = [re.escape(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)", re.IGNORECASE)
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.known = Numbering(), 0
        self.flat, self.lengths, self.place = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn_plain(self, words: list[str]) -> None:
        pieces = [word if word.isascii() else word.encode().decode("latin-1").translate(_SPELLED) for word in words]
        found = [self.model.tokenize(piece) for piece in pieces]
        self.lengths = np.concatenate((self.lengths, np.fromiter(map(len, found), np.int64, len(found))))
        self.flat = np.concatenate((self.flat, np.array([token.id for tokens in found for token in tokens], np.int32)))

    def _learn(self, words: list[str]) -> None:
        """Tokenise words as one text; a token belongs to the word that its first character lies in."""
        encoded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(sizes + 1) - sizes - 1
        firsts = np.fromiter((start for start, _ in encoded.offsets), np.int64, len(encoded.offsets))
        owners = np.searchsorted(begins, firsts, "right") - 1
        self.lengths = np.concatenate((self.lengths, np.bincount(owners, minlength=len(words))))
        self.flat = np.concatenate((self.flat, np.array(encoded.ids, np.int32)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each); texts that spell an added token go whole through the tokenizer."""
        whole = {n: self.tokenizer.encode(text, add_special_tokens=False).ids for n, text in enumerate(texts) if self.added.search(text)}
        if not whole:
            return self._by_words(texts)
        ids, counts = self._by_words(["" if n in whole else text for n, text in enumerate(texts)])
        parts = np.split(ids, np.cumsum(counts)[:-1])
        parts = [np.array(whole[n], ids.dtype) if n in whole else part for n, part in enumerate(parts)]
        return np.concatenate(parts), np.fromiter(map(len, parts), counts.dtype, len(parts))

    def _by_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.numbers) > KEPT:
            self._forget()
        used, parts = [], []
        for text in texts:
            if not _WIDE.search(text):
                text = text.lower()
            text = text.replace("\n", " ")
            if not _SIGNS.search(text):
                text = text.replace(". ", " . ").replace(", ", " , ")
            found = text.split(" ")
            used += map(self.numbers.__getitem__, found)
            parts.append(len(found))
        new = list(self.numbers)[self.known :]
        plain = [_PLAIN.fullmatch(word) is not None for word in new]
        # Numbers follow the order in which words are learned: plain ones first.
        groups = [[word for word, is_plain in zip(new, plain) if is_plain is kind] for kind in (True, False)]
        for group, learn in zip(groups, (self._learn_plain, self._learn)):
            for start in range(0, len(group), JOINED):
                learn(group[start : start + JOINED])
        place = np.empty(len(new), np.int64)
        place[np.argsort(~np.array(plain, bool), kind="stable")] = np.arange(len(new))
        self.place = np.concatenate((self.place, self.known + place))
        self.known += len(new)
        places = self.place[np.array(used, np.int64)]
        lengths = self.lengths[places]
        ended = np.concatenate(([0], np.cumsum(lengths)))
        cuts = np.concatenate(([0], np.cumsum(parts))).astype(np.int64)
        return gather(self.flat, (np.cumsum(self.lengths) - self.lengths)[places], lengths), np.diff(ended[cuts])


_LOADED: dict[int, WordEncoder] = {}


def tokenise(documents: DataFrame, tokenizer_path: str, end_id: int, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, check (crc32 of the 32-bit ids) and ids with the end id (little-endian, `width` bytes each, compressed), for
    every row. Ids are what the disk and the shuffle hold most of, so each document's are compressed by the task that made them."""
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = documents.sparkSession.sparkContext.broadcast(file.read())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(definition.value)
        if key not in _LOADED:
            _LOADED[key] = WordEncoder(definition.value)
        packer = zstandard.ZstdCompressor(level=1)
        for batch in in_slices(batches, "text", SLICE):
            ids, counts = _LOADED[key].encode(batch.column("text").to_pylist())
            found, checks, start = [], [], 0
            for count in counts.tolist():
                one = np.append(ids[start : start + count], end_id).astype("<u4")
                checks.append(zlib.crc32(one.tobytes()))
                found.append(packer.compress(one.astype(_WIDTHS[width]).tobytes()))
                start += count
            columns = [batch.column("doc_id"), pa.array(counts + 1), pa.array(checks, pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "check", "ids"])

    read = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    return read.mapInArrow(of, "doc_id bigint, n_tokens bigint, check bigint, ids binary")


def _ids(packed: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), _WIDTHS[width])


def frequencies(tokens: DataFrame, width: int) -> DataFrame:
    """(id, rows) over all ids; each task adds up its own before anything moves."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for place in range(0, batch.num_rows, 256):
                part = [_ids(one.as_py(), width) for one in batch.column("ids")[place : place + 256]]
                counts = np.bincount(np.concatenate(part), minlength=len(total))
                total = counts + np.pad(total, (0, len(counts) - len(total)))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "rows"])

    return tokens.select("ids").mapInArrow(of, "id bigint, rows bigint").groupBy("id").agg(F.sum("rows").alias("rows"))


def write(documents: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all documents, in order of doc_id, to the folder ``path``.

    The driver holds one number per id of the vocabulary, whatever the input.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        size = max(max(json.load(file)["model"]["vocab"].values()) + 1, end_id + 1)
    width = 2 if size <= 1 << 16 else 4
    tokens = written(tokenise(documents, tokenizer_path, end_id, width, doc_id, text), "token-ids")
    by_rank = [row["id"] for row in frequencies(tokens, width).orderBy(F.desc("rows"), "id").collect()]
    spark = documents.sparkSession
    spark.createDataFrame([(rank, id_) for rank, id_ in enumerate(by_rank)], "rank int, id int").coalesce(1).write.parquet(
        f"{path}/vocabulary"
    )
    ranks = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    ranks[by_rank] = np.arange(len(by_rank))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            control, data = pack(np.concatenate(held))
            lengths = [len(one) for one in held]
            row = {"part": part, "block": block, "start": start, "n_tokens": sum(lengths), "doc_ids": doc_ids,
                   "lengths": lengths, "control": control, "data": data}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([
            ("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary()),
        ])
        size = 0
        for batch in batches:
            for id_, count, ids in zip(*(batch.column(name) for name in ("doc_id", "n_tokens", "ids"))):
                if held and size + count.as_py() > BLOCK:
                    yield closed()
                    block, start, size, doc_ids, held = block + 1, start + size, 0, [], []
                doc_ids.append(id_.as_py())
                held.append(ranks[_ids(ids.as_py(), width)])
                size += count.as_py()
        if held:
            yield closed()

    ordered = tokens.repartitionByRange("doc_id", "check", "n_tokens").sortWithinPartitions("doc_id", "check", "n_tokens")
    ordered.mapInArrow(of, BLOCK_TYPE).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (unsigned 32-bit, little-endian) from files.

    The driver holds one number for each part file and for each id of the vocabulary.
    """
    blocks = spark.read.schema(BLOCK_TYPE).parquet(f"{path}/blocks")
    vocabulary = spark.read.parquet(f"{path}/vocabulary").orderBy("rank").collect()
    ids = np.array([row["id"] for row in vocabulary], "<u4")
    offsets, total = {}, 0
    for row in blocks.groupBy("part").agg(F.sum("n_tokens").alias("tokens")).orderBy("part").collect():
        offsets[row["part"]] = total
        total += row["tokens"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, start, count, doc_ids, lengths, control, data = (column[row].as_py() for column in batch.columns)
                flat = ids[unpack(control, data, count)].astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                begins = ends - lengths
                columns = [
                    pa.array(doc_ids, pa.int64()), pa.array(offsets[part] + start + begins), pa.array(lengths, pa.int64()),
                    pa.array([flat[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    needed = blocks.select("part", "start", "n_tokens", "doc_ids", "lengths", "control", "data")
    return needed.mapInArrow(of, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
