"""Toxicity by a weighted finite-state grammar over clauses.

Two kinds of machines are composed. The lexicon is a trie over letters: its arcs spell insult words and insult stems with weights
learned from labels, and the closed word classes of threats, targets, negations and reported speech. It rewrites a
word to one symbol with a weight. Five transducers over these symbols are then composed into one machine that reads a clause:
an insult or threat may be aimed at a target before or after it, turned by a negation that governs the next words,
or only reported after a verb of speech. The machine's final weights for a clause are added up in one register for each reading
(plain, aimed, denied, reported, threat, and strong insults by themselves). A document's registers go through a logistic function.

Learned from labelled rows, by a bounded and documented sample of at most `SAMPLE` rows of the training side (those
with the smallest hashes of doc_id), in which texts that repeat with the same label count once: the weights of insult arcs, by a Spark
aggregate of how many toxic and clean texts hold each word or stem; and the logistic weights, on registers of the sample. Texts are
dealt into `FOLDS` parts by their hash, and each part's registers are read with arcs learned from the other parts, so that the
logistic weights see registers as good as those of a new text and no better. Both models are of bounded size. Nothing but the text is read when
a text is scored, and the whole of it.

Defined results: a null or empty text has the score of a text without any match. Labels that are null, or rows labelled more
than once with different values, take no part in learning; without labels of both kinds no insult is known and
all scores are the same, 0. Repeated rows are scored alike. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import bounded_sample, whole_text, written

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
#: Words and stems of the lexicon, at most: those of the largest weight.
ARCS = 20_000
#: Toxic documents of the sample that must hold a word or stem.
LEAST = 4
STEMS = range(3, 9)
#: Words that a negation governs.
REACH = 3
#: Parts for cross-fitting.
FOLDS = 5
#: Distinct words whose symbols a task remembers, and entries whose counts it holds.
KNOWN = 50_000

CLASSES = {
    "threat": "kill hurt destroy beat burn shoot stab strangle töten umbringen schlagen vernichten verbrennen tuer frapper "
    "détruire brûler blesser matar golpear destruir quemar herir",
    "target": "you your yours yourself u he she they them those these people everyone du dich dir ihr euch sie diese tu toi te vous "
    "ils elles ces usted ustedes vosotros ti ellos ellas esos",
    "negation": "not no never neither nor without isn't aren't wasn't don't nicht kein keine nie niemals ohne pas jamais sans ni "
    "nunca jamás sin tampoco",
    "report": "said says told tells wrote writes claimed claims reported reports called quoted sagte sagt schrieb behauptet meldete "
    "disait déclare écrit affirme rapporte dijo dice escribió afirma informó",
}
SYMBOLS = ("other", "insult", "threat", "target", "negation", "report")
REGISTERS = ("plain", "aimed", "denied", "reported", "threat", "strong")
#: Log odds from which an arc counts as strong; a clause's strong insults are also added up by themselves.
STRONG = 2.5
#: How much a reading counts before anything is learned about it.
PRIOR = {"plain": 1.0, "aimed": 1.3, "denied": 0.3, "reported": 0.4, "threat": 1.0, "strong": 0.0}
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n\"]")
STOPS = frozenset(".!?;:\n\"")


@dataclass(frozen=True)
class Transducer:
    """A deterministic machine: (state, symbol) to (state, features); what isn't listed goes to ``fallback``."""

    start: object
    arcs: dict = field(hash=False)
    fallback: dict = field(hash=False)

    def step(self, state: object, symbol: str) -> tuple[object, tuple[str, ...]]:
        return self.arcs.get((state, symbol), self.fallback[state])


def _negation() -> Transducer:
    """Counts down the words that the last negation governs."""
    arcs, fallback = {}, {}
    for left in range(REACH + 1):
        out = ("denied",) if left else ()
        arcs[left, "negation"] = (REACH, ())
        fallback[left] = (max(0, left - 1), out)
    return Transducer(0, arcs, fallback)


def _report() -> Transducer:
    """From a verb of speech to the end of the clause, all is reported."""
    return Transducer(
        0, {(0, "report"): (1, ()), (1, "report"): (1, ("reported",))}, {0: (0, ()), 1: (1, ("reported",))}
    )


def _target() -> Transducer:
    return Transducer(0, {(0, "target"): (1, ()), (1, "target"): (1, ("aimed",))}, {0: (0, ()), 1: (1, ("aimed",))})


_TARGET = _target()


def _finder(symbol: str) -> Transducer:
    return Transducer(0, {(0, symbol): (0, (symbol,))}, {0: (0, ())})


def compose(*machines: Transducer) -> Transducer:
    """One machine whose states are those of all machines and whose features are joined."""
    start = tuple(machine.start for machine in machines)
    arcs, fallback, todo, seen = {}, {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in (*SYMBOLS, None):
            moves = [m.step(s, symbol) if symbol else m.fallback[s] for m, s in zip(machines, state, strict=True)]
            following = tuple(move[0] for move in moves)
            features = tuple(feature for move in moves for feature in move[1])
            if symbol:
                arcs[state, symbol] = (following, features)
            else:
                fallback[state] = (following, features)
            if following not in seen:
                seen.add(following)
                todo.append(following)
    return Transducer(start, arcs, fallback)


def grammar() -> Transducer:
    return compose(_finder("insult"), _finder("threat"), _target(), _negation(), _report())


def read_clause(machine: Transducer, symbols: list[tuple[str, float]]) -> dict[str, float]:
    """Weight in each register of a clause's insults and threats. The machine reads to the right and so sees targets that come before; a
    second pass of the target machine to the left sees those that come after."""
    behind, ahead = _TARGET.start, []
    for symbol, _ in reversed(symbols):
        behind, features = _TARGET.step(behind, symbol)
        ahead.append("aimed" in features)
    state, found = machine.start, []
    for (symbol, weight), after in zip(symbols, reversed(ahead)):
        state, features = machine.step(state, symbol)
        if symbol in ("insult", "threat"):
            found.append((symbol, weight, features, after or "aimed" in features))
    registers: dict[str, float] = {}
    for symbol, weight, features, aimed in found:
        if "reported" in features:
            reading = "reported"
        elif "denied" in features:
            reading = "denied"
        elif symbol == "threat":
            reading = "threat" if aimed else None
        else:
            reading = "aimed" if aimed else "plain"
        if reading:
            registers[reading] = registers.get(reading, 0.0) + weight
            if reading in ("plain", "aimed") and weight >= STRONG:
                registers["strong"] = registers.get("strong", 0.0) + weight
    return registers


class Lexicon:
    """A trie over letters; an arc ends at a word's end, a stem's arc also within it. The longest arc wins."""

    END = ""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.trie: dict = {}
        for name, listed in CLASSES.items():
            for word in listed.split():
                self._add(word + "$", name, 1.0)
        for stem, weight in stems.items():
            self._add(stem, "insult", weight)
        for word, weight in words.items():
            self._add(word + "$", "insult", weight)
        self.known: dict[str, tuple[str, float]] = {}

    def _add(self, path: str, symbol: str, weight: float) -> None:
        node = self.trie
        for letter in path:
            node = node.setdefault(letter, {})
        node[self.END] = (symbol, weight)

    def symbol(self, word: str) -> tuple[str, float]:
        found = self.known.get(word)
        if found is None:
            node, found = self.trie, ("other", 0.0)
            for letter in word + "$":
                node = node.get(letter)
                if node is None:
                    break
                found = node.get(self.END, found)
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[word] = found
        return found


def tokens(text: str) -> list[str]:
    return TOKEN.findall(unicodedata.normalize("NFC", text).lower())


class Reader:
    """Sums of a text's clauses by register, and its number of words."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.lexicon, self.machine = Lexicon(words, stems), grammar()

    def registers(self, text: str) -> list[float]:
        found = tokens(text)
        symbol = self.lexicon.symbol
        read = [*map(symbol, found)]
        total = dict.fromkeys(REGISTERS, 0.0)
        hits = [place for place, (kind, _) in enumerate(read) if kind == "insult" or kind == "threat"]
        done = -1
        for place in hits:
            if place < done:
                continue
            start = place
            while start > 0 and found[start - 1] not in STOPS:
                start -= 1
            done = place
            while done < len(found) and found[done] not in STOPS:
                done += 1
            for name, weight in read_clause(self.machine, read[start:done]).items():
                total[name] += weight
        return [total[name] for name in REGISTERS] + [float(len(found))]


@dataclass
class Model:
    """What scoring needs: the lexicon's insult arcs and the logistic weights."""

    words: dict[str, float]
    stems: dict[str, float]
    weights: list[float]
    bias: float

    def score(self, registers: np.ndarray) -> np.ndarray:
        """Scores from rows of registers and word counts."""
        if not self.words and not self.stems:
            return np.zeros(len(registers))
        return 1 / (1 + np.exp(-np.clip(_features(registers) @ np.array(self.weights) + self.bias, -30, 30)))


def _features(registers: np.ndarray) -> np.ndarray:
    """The weighed sum of readings and of strong insults: by themselves, against the length of the text, and if there are any."""
    counted = registers[:, : len(REGISTERS)]
    total = counted @ np.array([PRIOR[name] for name in REGISTERS])
    words = registers[:, len(REGISTERS)]
    strong = counted[:, REGISTERS.index("strong")]
    return np.column_stack([
        np.log1p(total), 100 * total / (words + 20), total > 0, np.log1p(counted),
        strong > 0, 100 * strong / (words + 20), np.log1p(words) * (strong > 0), np.log1p(words),
    ])


def _fit_logistic(features: np.ndarray, labels: np.ndarray) -> tuple[list[float], float]:
    """Weights and bias of the largest likelihood with a small ridge.

    The penalised likelihood is strictly concave. Newton steps are halved until they raise it enough, so they
    reach its one maximum from anywhere; a fit that ends away from it is an error, not a model.
    """
    spread = np.where(features.std(axis=0) > 1e-9, features.std(axis=0), 1.0)
    design = np.column_stack([(features - features.mean(axis=0)) / spread, np.ones(len(features))])
    ridge = np.full(design.shape[1], 0.3)
    ridge[-1] = 1e-6

    def likelihood(at: np.ndarray) -> float:
        line = design @ at
        return float(labels @ line - np.logaddexp(0, line).sum() - 0.5 * ridge @ at**2)

    beta, enough = np.zeros(design.shape[1]), 1e-9 * len(features)
    value = likelihood(beta)
    for _ in range(200):
        chance = np.exp(-np.logaddexp(0, -(design @ beta)))
        slope = design.T @ (labels - chance) - ridge * beta
        if np.abs(slope).max() <= enough:
            break
        curve = (design * (chance * (1 - chance))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while (reached := likelihood(beta + size * step)) < value + 1e-4 * size * (slope @ step) and size > 1e-12:
            size /= 2
        if size <= 1e-12:  # as near as doubles allow
            break
        beta, value = beta + size * step, reached
    chance = np.exp(-np.logaddexp(0, -(design @ beta)))
    left = np.abs(design.T @ (labels - chance) - ridge * beta).max()
    if not left <= 1e-5 * len(features):
        raise ArithmeticError(f"the fit of {len(features)} rows ended with a gradient of {left}")
    weights = beta[:-1] / spread
    return weights.tolist(), float(beta[-1] - weights @ features.mean(axis=0))


def held_out(doc_id: Column) -> Column:
    """True for rows that learning must not see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _entries(training: DataFrame) -> DataFrame:
    """entry, and toxic and clean as arrays by fold: the texts that hold each word ("word$") and stem, from (text, toxic, fold)."""
    sides = [f"{side}{fold}" for side in ("clean", "toxic") for fold in range(FOLDS)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def counted() -> pa.RecordBatch:
            keys = [*counts]
            table = np.array([counts[key] for key in keys], np.int64).reshape(-1, 2 * FOLDS)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(column) for column in table.T.copy())], ["entry", *sides])

        for batch in batches:
            for text, toxic, fold in zip(*(batch.column(name).to_pylist() for name in ("text", "toxic", "fold"))):
                words = {token for token in tokens(text) if token not in STOPS}
                held = {word + "$" for word in words}
                held.update(word[:size] for word in words for size in STEMS if size < len(word))
                for entry in held:
                    counts.setdefault(entry, [0] * (2 * FOLDS))[toxic * FOLDS + fold] += 1
                if len(counts) > KNOWN:
                    yield counted()
                    counts.clear()
        yield counted()

    found = training.mapInArrow(of, "entry string, " + ", ".join(f"{side} bigint" for side in sides)).groupBy("entry")
    summed = found.agg(*[F.sum(side).alias(side) for side in sides])
    return summed.select("entry", *[F.array(*[f"{side}{fold}" for fold in range(FOLDS)]).alias(side) for side in ("toxic", "clean")])


def _arcs(entries: DataFrame, sizes: dict[str, list[int]], but: int | None = None) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that speak for toxicity even at the lower end of their log odds' 95 % interval, in all folds but one."""
    folds = [fold for fold in range(FOLDS) if fold != but]
    toxic, clean = (sum((F.get(side, F.lit(fold)) for fold in folds), F.lit(0)) for side in ("toxic", "clean"))
    n_toxic, n_clean = (sum(sizes[side][fold] for fold in folds) for side in ("toxic", "clean"))
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    rest_a, rest_b = n_toxic - F.col("toxic") + 0.5, n_clean - F.col("clean") + 0.5
    odds = F.log(a / rest_a) - F.log(b / rest_b)
    low = odds - 1.96 * F.sqrt(1 / a + 1 / b + 1 / rest_a + 1 / rest_b)
    counted = entries.select("entry", toxic.alias("toxic"), clean.alias("clean"))
    chosen = counted.where(F.col("toxic") >= LEAST).select("entry", low.alias("weight")).where("weight > 0.7")
    rows = chosen.orderBy(F.desc("weight"), "entry").limit(ARCS).collect()
    words = {row["entry"][:-1]: float(row["weight"]) for row in rows if row["entry"].endswith("$")}
    weights = {row["entry"]: float(row["weight"]) for row in rows if not row["entry"].endswith("$")}
    # A stem that only repeats one word, or a longer stem no better than a shorter one, adds nothing.
    stems = {
        stem: weight for stem, weight in weights.items()
        if not any(weights.get(stem[:size], -1.0) >= weight - 0.5 for size in range(STEMS[0], len(stem)))
    }
    words = {
        word: weight for word, weight in words.items()
        if not any(stems.get(word[:size], -1.0) >= weight - 0.5 for size in range(STEMS[0], len(word)))
    }
    return words, stems


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from labelled rows outside the held-out side; at most `SAMPLE` of them."""
    known = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    chosen = bounded_sample(known, SAMPLE, "doc_id")
    read = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    # The sample's ids are bounded by SAMPLE, so they may be sent to all tasks.
    found = written(read.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", F.sha2("text", 256).alias("digest")), "toxic-labelled")
    firsts = found.groupBy("digest", "toxic").agg(F.min("doc_id").alias("doc_id"))
    fold = F.pmod(F.xxhash64("digest"), F.lit(FOLDS)).cast("int").alias("fold")
    once = found.join(F.broadcast(firsts), ["digest", "toxic", "doc_id"]).dropDuplicates(["digest", "toxic"])
    training = written(once.select("text", "toxic", fold), "toxic-sample")
    sizes = {side: [0] * FOLDS for side in ("toxic", "clean")}
    for row in training.groupBy("toxic", "fold").count().collect():
        sizes["toxic" if row["toxic"] else "clean"][row["fold"]] = row["count"]
    if not sum(sizes["toxic"]) or not sum(sizes["clean"]):
        return Model({}, {}, [], 0.0)
    known_often = F.aggregate("toxic", F.lit(0).cast("bigint"), lambda total, one: total + one) >= LEAST
    entries = written(_entries(training).where(known_often), "toxic-entries")
    words, stems = _arcs(entries, sizes)
    if not words and not stems:
        return Model({}, {}, [], 0.0)
    lexica = [_arcs(entries, sizes, part) for part in range(FOLDS)]
    rows = _read(training, lexica).collect()  # a few numbers for each row of the sample
    registers = np.array([row["registers"] for row in rows])
    weights, bias = _fit_logistic(_features(registers), np.array([row["toxic"] for row in rows], float))
    return Model(words, stems, weights, bias)


def _read(training: DataFrame, lexica: list[tuple[dict[str, float], dict[str, float]]]) -> DataFrame:
    """toxic and registers of each text, by the lexicon of its fold."""
    shared = training.sparkSession.sparkContext.broadcast(lexica)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, part = None, -1
        for batch in batches:
            found = []
            for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist()):
                if fold != part:
                    reader, part = Reader(*shared.value[fold]), fold
                found.append(reader.registers(text))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["toxic", "registers"])

    return training.sortWithinPartitions("fold").mapInArrow(of, "toxic int, registers array<double>")


def score(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and registers (see `REGISTERS`) for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        reader = Reader(fitted.words, fitted.stems)
        for batch in batches:
            found = np.array([reader.registers(text) for text in batch.column("text").to_pylist()]).reshape(-1, len(REGISTERS) + 1)
            columns = [batch.column("doc_id"), pa.array(fitted.score(found)), pa.array(found[:, :-1].tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "registers"])

    read = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    return read.mapInArrow(of, "doc_id bigint, score double, registers array<double>")


def keep_clean(documents: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """Rows of ``documents``, with all their columns, whose score is below ``limit``; nothing is shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        reader = Reader(fitted.words, fitted.stems)
        for batch in batches:
            found = [reader.registers(one or "") for one in batch.column(text).to_pylist()]
            scores = fitted.score(np.array(found).reshape(-1, len(REGISTERS) + 1))
            yield batch.filter(pa.array(scores < limit))

    return documents.mapInArrow(of, documents.schema)
