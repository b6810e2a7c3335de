"""Secrets: base patterns, and credential values that cost many guesses.

The base finds spans of three kinds by fixed patterns; these always stay. Values that stand in a credential's place (after
"pwd:", "passphrase is", in a URL before the @, ...) and touch no base span are scored by the guesses that a cracker needs. A dynamic
programme finds the cheapest way to cut a value into words, dates, repeats, keyboard walks or runs, and brute-force spans; each
cut costs as well. Values of `STRONG` bits or more are added as spans of the kind guess.

What a word costs is what the corpus says: the logarithm of all words over the times that it occurs, counted over all whole texts but outside
of credential values, so that a secret in a text that is copied often stays a secret. No dictionary is sent around: the
stretches of the distinct values, a few for each sign, are joined with the counts of words. Capitals and signs that stand
for letters cost some more. Texts are read once; then only spans, values and words move.

Defined results: a null text counts as empty. Positions count code points, ends are exclusive. Of a value that is longer than
`BLOCK` signs, blocks of that length are scored, and their bits added up. Repeated rows are read alike, each for itself; an
empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import attach, whole_text, written

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: Bits from which a value counts as a secret: 2^30 guesses.
STRONG = 30.0
#: Signs of a value, at least, and of the blocks that longer ones are scored in.
LEAST, BLOCK = 6, 256
#: Letters of a word.
WORD = range(3, 21)
#: What a word costs at most, once it occurs at all; the figure doesn't grow with the corpus.
RAREST = 24.0
#: What beginning another segment costs.
CUT = 1.0
#: Distinct words whose counts a task holds.
HELD = 200_000

_NAMES = (
    r"pass(?:word|wd|phrase|code|wort|key)?|passwd|pwd|pin|psk|secret|token|cred(?:ential)?s?|login|auth(?:orization)?|bearer|kennwort|contraseña"
    r"|clave|mot de passe|mdp|(?:api|access|private|client|account|encryption)[ _-]?(?:key|secret|token)"
)
_CONTEXT = re.compile(
    rf"(?<![^\W_])(?:{_NAMES})(?:\"|')?[\x20\t]*(?:(?P<sign>[:=]{{1,2}}>?)|(?P<verb>(?<=[\x20\t])(?:is|was|ist|lautet|est|es)(?=\s)))"
    r"[\x20\t]*[\"'`]?(?P<value>[^\s\"'`<>,;]+)", re.I,
)
_HINTS = ("pass", "pwd", "pin", "psk", "secret", "token", "cred", "login", "auth", "bearer", "kennwort", "contrase", "clave", "mdp", "key")
_URL = re.compile(r"://[^\s/:@]+:(?P<value>[^\s/@]+)@")
_WORDS = re.compile(r"[^\W\d_]+")
_ENDS = ".!?)]}:"

# Rows of the keyboard, each half a key to the right of the one above it.
KEYBOARD = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
# Signs that are written for letters.
LETTERS = {"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "2": "z"}
# Passwords that everybody tries first, most frequent first.
COMMON = (
    "123456 password 123456789 12345678 12345 qwerty abc123 111111 123123 admin letmein welcome monkey dragon iloveyou master login "
    "football sunshine princess passw0rd shadow superman trustno1 changeme secret hello example test demo root user guest default"
).split()
_AT = {key: (row, column) for row, keys in enumerate(KEYBOARD) for column, key in enumerate(keys)}
_COMMON = {word: math.log2(place + 1) + 1 for place, word in enumerate(COMMON)}
_YEAR, _DAY, _MONTH, _SIGN = r"(?:19|20)[0-9]{2}", r"(?:0?[1-9]|[12][0-9]|3[01])", r"(?:0?[1-9]|1[0-2])", r"[-/._]?"
_DATES = [
    (re.compile(_YEAR + _SIGN + _MONTH + _SIGN + _DAY), math.log2(365 * 130)), (re.compile(_DAY + _SIGN + _MONTH + _SIGN + _YEAR), math.log2(365 * 130)),
    (re.compile(_MONTH + _SIGN + _DAY + _SIGN + _YEAR), math.log2(365 * 130)), (re.compile(_YEAR), math.log2(130)),
    (re.compile(r"(?:0[1-9]|[12][0-9]|3[01])[-/._]?(?:0[1-9]|1[0-2])"), math.log2(365)),
]

Span = tuple[str, int, int]


def base_spans(text: str, low: str) -> list[Span]:
    """Leftmost matches of each kind that pass its check, by start and kind; ``low`` is the text in lower case."""
    found = [("access", match.start(), match.end()) for match in _ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", match.start(), match.end()) for match in _HEX.finditer(text)]
    if any(hint in low for hint in _ASSIGN_HINTS):
        found += [("assign", match.start(), match.end()) for match in _ASSIGN.finditer(text) if len(match[2]) >= 8]
    return sorted(found, key=lambda span: (span[1], KINDS.index(span[0])))


def credential_values(text: str, low: str, base: list[Span]) -> list[tuple[int, int]]:
    """Where values stand that a credential's name or a URL announces and that touch no base span."""
    matches = [*_CONTEXT.finditer(text)] if any(hint in low for hint in _HINTS) else []
    found: list[tuple[int, int]] = []
    for match in matches + ([*_URL.finditer(text)] if "://" in text else []):
        start, end = match.span("value")
        while end > start and text[end - 1] in _ENDS:
            end -= 1
        value = text[start:end]
        if len(value) < LEAST or any(s < end and start < e for _, s, e in base) or any(s < end and start < e for s, e in found):
            continue
        if match.re is _CONTEXT and match["verb"] and value.isalpha():  # after a verb, letters alone are prose
            continue
        found.append((start, end))
    return sorted(found)


def plain(value: str) -> str:
    """In lower case, sign by sign, so that places stay."""
    return "".join(one if len(one := sign.lower()) == 1 else sign for sign in value)


def stretches(value: str) -> set[str]:
    """What could be a word of the value: stretches of letters, and of signs read as letters."""
    low = plain(value)
    read = "".join(LETTERS.get(sign, sign) for sign in low)
    found = set()
    for text in {low, read}:
        for start in range(len(text)):
            for size in WORD:
                piece = text[start : start + size]
                if len(piece) < size or not piece[-1].isalpha():
                    break
                if piece.isalpha():
                    found.add(piece)
    return found


def _sign_bits(sign: str) -> float:
    return math.log2(10) if sign in "0123456789" else math.log2(26) if sign.isalpha() else math.log2(33)


def _word_bits(value: str, low: str, start: int, end: int, words: dict[str, float]) -> float | None:
    piece = low[start:end]
    bits, read = min(words.get(piece, math.inf), _COMMON.get(piece, math.inf)), "".join(LETTERS.get(sign, sign) for sign in piece)
    if read != piece:
        changed = sum(a != b for a, b in zip(piece, read))
        bits = min(bits, min(words.get(read, math.inf), _COMMON.get(read, math.inf)) + 1 + changed)
    if bits == math.inf:
        return None
    capitals = sum(sign.isupper() for sign in value[start:end])
    if not capitals:
        return bits
    if capitals == end - start or capitals == 1 and value[start].isupper():
        return bits + 1
    return bits + 1 + math.log2(math.comb(end - start, capitals))


def _walks(low: str, start: int) -> Iterator[tuple[int, float]]:
    """(end, bits) of walks over neighbouring keys, and of runs such as abc or 987, from ``start``."""
    turns, before, step = 0, None, 0
    running, walking = True, True
    for place in range(start + 1, len(low)):
        a, b = _AT.get(low[place - 1]), _AT.get(low[place])
        move = (b[0] - a[0], b[1] - a[1]) if a and b else None
        # The rows are half a key apart, so a key has two neighbours in the row above and two below.
        walking = walking and move in ((0, 1), (0, -1), (0, 0), (1, 0), (1, -1), (-1, 0), (-1, 1))
        turns, before = turns + (move != before), move
        run = ord(low[place]) - ord(low[place - 1])
        running = running and run in (1, -1) and (place == start + 1 or run == step) and low[place].isalnum()
        step = run
        if not walking and not running:
            return
        if place - start >= 2:
            length = place - start + 1
            yield place + 1, min(
                math.log2(47 * length) + 2.3 * turns if walking else math.inf, math.log2(26 * length) + (step < 0) if running else math.inf
            )


def guess_bits(value: str, words: dict[str, float], depth: int = 0) -> float:
    """Bits of the cheapest segmentation; ``words``: bits of the words that `stretches` names, where known."""
    size, low = len(value), plain(value)
    best, brute = [math.inf] * (size + 1), [math.inf] * (size + 1)  # brute: if the last segment is a brute-force span
    best[0] = 0.0
    for start in range(size):
        here = best[start] + (CUT if start else 0.0)

        def reach(end: int, bits: float, here: float = here) -> None:
            best[end] = min(best[end], here + bits)

        brute[start + 1] = min(here, brute[start]) + _sign_bits(value[start])
        best[start + 1] = min(best[start + 1], brute[start + 1])
        for length in WORD:
            if start + length > size:
                break
            bits = _word_bits(value, low, start, start + length, words)
            if bits is not None:
                reach(start + length, bits)
        for pattern, bits in _DATES:
            if match := pattern.match(low, start):
                reach(match.end(), bits)
        for end, bits in _walks(low, start):
            reach(end, bits)
        for length in range(1, min(16, (size - start) // 2) + 1 if depth < 2 else 1):
            once, times = low[start : start + length], 1
            while low.startswith(once, start + times * length):
                times += 1
            if times >= (3 if length == 1 else 2):
                bits = _sign_bits(once) if length == 1 else guess_bits(value[start : start + length], words, depth + 1)
                for count in range(2, times + 1):
                    reach(start + count * length, bits + math.log2(count))
    return best[size]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_VALUE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
_READ = (
    "doc_id bigint, row bigint, base array<struct<kind:string,start:int,end:int>>, "
    "found array<struct<start:int,end:int,value:string>>, word string, times bigint"
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text with its base spans and credential values, and rows with the counts of the words of many texts."""
    names = ["doc_id", "row", "base", "found", "word", "times"]
    row, counts = TaskContext.get().partitionId() << 40, Counter()

    def counted() -> pa.RecordBatch:
        rows = len(counts)
        columns = [pa.nulls(rows, kind) for kind in (pa.int64(), pa.int64(), _SPAN, _VALUE)]
        out = pa.RecordBatch.from_arrays([*columns, pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names)
        counts.clear()
        return out

    for batch in batches:
        base, found, rows = [], [], batch.num_rows
        for text in batch.column("text"):
            text = text.as_py()
            low = text.lower()
            spans = base_spans(text, low)
            values = credential_values(text, low, spans)
            base.append([{"kind": kind, "start": start, "end": end} for kind, start, end in spans])
            found.append([{"start": start, "end": end, "value": text[start:end]} for start, end in values])
            cuts = sorted([*values, *((start, end) for _, start, end in spans)])
            if cuts:  # words of secrets don't count
                parts, place = [], 0
                for start, end in cuts:
                    parts.append(text[place : max(place, start)])
                    place = max(place, end)
                low = " ".join([*parts, text[place:]]).lower()
            counts.update(_WORDS.findall(low))
            if len(counts) > HELD:
                yield counted()
        numbers = pa.array(range(row, row + rows), pa.int64())
        row += rows
        columns = [batch.column("doc_id"), numbers, pa.array(base, _SPAN), pa.array(found, _VALUE), pa.nulls(rows, pa.string()), pa.nulls(rows, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names)
    yield counted()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column("block").to_pylist():
            found = sorted(stretches(block))
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.string()), pa.array(found, pa.string())], ["block", "word"])


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known = [dict(one or ()) for one in batch.column("known").to_pylist()]
        bits = [guess_bits(block, words) for block, words in zip(batch.column("block").to_pylist(), known)]
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(bits, pa.float64())], ["block", "bits"])


def value_bits(values: DataFrame, words: DataFrame) -> DataFrame:
    """value and bits of every distinct value, from the counts of words (word, times)."""
    size = F.length("value")
    places = F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int"))
    cut = F.transform(places, lambda place: F.substring(F.col("value"), place * BLOCK + 1, F.lit(BLOCK)))
    blocks = written(values.select("value").distinct().select("value", F.explode(cut).alias("block")), "blocks")
    distinct = blocks.select("block").distinct()
    total = words.agg(F.sum("times")).first()[0] or 1
    costs = words.groupBy("word").agg(F.sum("times").alias("times")).select(
        "word", F.greatest(F.lit(1.0), F.least(F.lit(RAREST), F.log2(F.lit(float(total)) / F.col("times")))).alias("bits")
    )
    wanted = written(distinct.mapInArrow(_pieces, "block string, word string"), "stretches")
    met = attach(wanted, costs, "word", "block").where("bits is not null")
    known = met.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("known"))
    scored = distinct.join(known, "block", "left").mapInArrow(_scored, "block string, bits double")
    return attach(blocks, scored, "block", "value").groupBy("value").agg(F.sum("bits").alias("bits"))


def find(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) for every row."""
    read = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    both = written(read.mapInArrow(_read, _READ), "secrets")
    rows = both.where("row is not null").select("doc_id", "row", "base", "found")
    words = both.where("word is not null").where(F.length("word").between(WORD[0], WORD[-1])).select("word", "times")
    each = written(rows.select("row", F.explode("found").alias("one")).select("row", "one.*"), "values")
    strong = written(value_bits(each, words).where(F.col("bits") >= STRONG), "strong")
    guessed = F.struct(F.lit("guess").alias("kind"), "start", "end")
    added = attach(each, strong, "value", "row").where("bits is not null").groupBy("row").agg(F.collect_list(guessed).alias("added"))
    place = lambda span: F.struct(span["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), span["kind"]).alias("kind"))
    every = F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    ordered = F.transform(F.array_sort(F.transform(every, lambda span: F.struct(place(span).alias("place"), span.alias("span")))), lambda one: one["span"])
    return rows.join(added, "row", "left").select("doc_id", "base", ordered.alias("spans"))
