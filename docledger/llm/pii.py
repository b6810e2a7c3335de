"""Personal data: base patterns, and a semi-Markov conditional random field for what they miss.

The base finds spans of four kinds by fixed patterns and checks; these always stay. The field adds spans: wherever the text shows an
anchor (a run of digits and separators, or an address written out with words or brackets), the neighbourhood is cut into
units, and all stretches of up to `LONGEST` units are candidate segments of each kind. Features are taken from whole segments (number
of digits, checksum, groups, separators, written-out at and dot, words before), so a segment is scored as a whole and not unit by
unit. A dynamic programme over units, bounded by the longest segment, picks the segmentation of the largest
total score, so boundaries and kinds are chosen jointly. Segments of one text don't overlap one another or a base span.

The weights are trained by maximising the conditional likelihood of segmentations. There are no labels of
spans, so training material is made from the base's own findings: `fit` takes spans from a bounded sample of texts (at most
`SAMPLE` texts, those with the smallest hashes of doc_id, within the bounds stated there; the search itself reads all of every text) and rewrites them as people do (without plus, with other separators, with
written-out signs), between words of those texts; numbers of other lengths and failing checksums are the counterexamples.

Defined results: a null text counts as empty. Empty texts have no spans. Positions count code points, ends are exclusive.
Repeated rows are read alike; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import bounded_sample, whole_text

KINDS = ("email", "ip", "card", "phone")
#: Units of a segment, at most.
LONGEST = 24
#: Training material is taken from so many texts at most, of each text from so many spans, and words from so many of its first characters and
#: words; in all so many spans of a kind and words. Kinds with fewer than `FEW` spans get `SEED_SPANS` as well.
SAMPLE = 20_000
SPANS_OF_TEXT, HEAD, WORDS_OF_TEXT = 4, 400, 5
SPANS_OF_KIND, WORDS, FEW = 150, 2000, 20
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        total += value if place % 2 == 0 else value * 2 - 9 * (value > 4)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Every match has its one @, so the scan goes from @ to @: to the left as far as the name reaches, but not into the last
    match, and to the right as far as the domain does."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))
    return found


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that pass its check, by start and kind."""
    found = _emails(text) if "@" in text else []
    for match in _IP.finditer(text):
        if all(len(part) < 9 and int(part) <= 255 or len(part) >= 9 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
            found.append(("ip", match.start(), match.end()))
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 14:
            digits = match[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", match.start(), match.end()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", match[0])) <= 15:
                found.append(("phone", match.start(), match.end()))
    return sorted(found, key=lambda span: (span[1], KINDS.index(span[0])))


#: What a segment may be made of: words and numbers, and single signs.
_UNIT = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]|\s+")
#: Where the field looks: seven digits or four groups of them with any separators between, or an at and later a dot, written in any way.
_ANCHOR = re.compile(
    r"\(?\+?[0-9](?:[\x20()+./\\-]*[0-9]){6,}|[0-9]+(?:[\x20()+./\\-]+[0-9]+){3,}"
    r"|(?:@|(?<![A-Za-z])(?:at|AT|arroba)(?![A-Za-z]))[\sA-Za-z0-9_%+\[\](){}<>-]{1,60}?"
    r"(?:\.|(?<![A-Za-z])(?:dot|DOT|punkt|punto|point)(?![A-Za-z]))[\s\[\](){}<>]*[A-Za-z0-9]"
)
_HINTS = {
    "email": frozenset("email mail e-mail contact write correo courriel".split()),
    "ip": frozenset("ip host server address addr adresse".split()),
    "card": frozenset("card visa mastercard credit karte carte tarjeta cc".split()),
    "phone": frozenset("phone tel call mobile fax cell telefon téléphone teléfono ring".split()),
}
_AT = frozenset(("@", "at", "AT", "arroba"))
_DOT = frozenset((".", "dot", "DOT", "punkt", "punto", "point"))
#: Words that stand around an ordinary "at", not in an address.
_PLAIN = frozenset("a an and are die das der el he i in is it la le les of on our she the their they this to was we were you".split())
_OPEN = frozenset("[({<")
_CLOSE = frozenset("])}>")


def _shape(units: list[str]) -> str:
    """The parts of an address without blanks and brackets: w word, @ and . signs, else ?."""
    out = []
    for unit in units:
        if unit.isspace() or unit in _OPEN or unit in _CLOSE:
            continue
        out.append("@" if unit in _AT else "." if unit in _DOT else "w" if unit.isalnum() else "-" if unit in "_-%+" else "?")
    return "".join(out)


def _joints(units: list[str]) -> list[str]:
    """How an address' at and dots are written (each with the blanks and brackets around it), and ' ' for every other blank."""
    found, place = [], 0
    while place < len(units):
        end = place
        while end < len(units) and (units[end].isspace() or units[end] in _OPEN or units[end] in _CLOSE or units[end] in _AT or units[end] in _DOT):
            end += 1
        if end > place:
            joined = units[place:end]
            joins = any(unit in _AT or unit in _DOT for unit in joined)
            found.append("".join("w" if unit[0].isalpha() else " " if unit.isspace() else unit for unit in joined).replace("@", ".") if joins else " ")
        place = max(end, place + 1)
    return found


_ADDRESS = re.compile(r"w(?:[.-]?w)*@w(?:-?w)*(?:\.w(?:-?w)*)+\Z")


def features(units: list[str], start: int, end: int, kind: str) -> list[str]:
    """Features of units[start:end] as a segment of a kind; none if it can't be one."""
    part = units[start:end]
    first, last = part[0], part[-1]
    if first.isspace() or last.isspace():
        return []
    names = [f"{kind}:any"]
    if kind == "email":
        if not (first[0].isalnum() and last[0].isalnum()):
            return []
        shape = _shape(part)
        if not _ADDRESS.match(shape) or last.isdigit():
            return []
        signs = "".join(part)
        plain = "@" in part
        names.append(f"email:{'sign' if plain else 'word'}")
        names.append(f"email:brackets={sum(unit in _OPEN for unit in part) == sum(unit in _CLOSE for unit in part) > 0}")
        names.append(f"email:blanks={min(8, sum(unit.isspace() for unit in part))}")
        names.append(f"email:dots={min(4, shape.split('@')[1].count('.'))}")
        names.append(f"email:named={bool(re.search(r'[0-9_.]', signs.split('@')[0] if plain else part[0]))}")
        joints = _joints(part)
        names.append(f"email:gap={min(2, joints.count(' '))}")  # blanks between words that no sign joins
        names.append(f"email:plain={any(unit.lower() in _PLAIN for unit in part)}")
        joints = [joint for joint in joints if joint != " "]
        names.append(f"email:mixed={len(set(joints[1:])) > 1}")
        names.append(f"email:sentence={any(re.match('[.] +$', joint) for joint in joints)},{last[0].isupper() and last[1:].islower()}")
        ahead = units[start - 1] if start else " "
        names.append(f"email:cut={not ahead.isspace() and ahead not in _OPEN and ahead not in ':,;='}")
        names.append(f"email:top={min(7, len(last))}")
        tail = units[end : end + 1]
        names.append(f"email:more={bool(tail and tail[0] in ('.', '@') and len(units) > end + 1 and units[end + 1].isalnum())}")
    else:
        if any(unit[0].isalpha() for unit in part) or not last[0].isdigit() or not (first[0].isdigit() or first in "+("):
            return []
        signs = "".join(unit for unit in part if not unit.isdigit())
        if re.search(r"[^\x20()+./\\-]|\n", signs) or kind != "phone" and any(unit.isspace() and len(unit) > 1 for unit in part):
            return []
        groups = [unit for unit in part if unit.isdigit()]
        digits = "".join(groups)
        before, after = units[start - 1] if start else " ", units[end] if end < len(units) else " "
        names.append(f"{kind}:digits={len(digits) if len(digits) < 22 else 22}")
        names.append(f"{kind}:groups={min(6, len(groups))}")
        names.append(f"{kind}:sign={','.join(sorted(set(signs.replace(' ', '_'))))}")
        names.append(f"{kind}:edge={before[-1].isalnum() or before[-1] in '.-+/' and len(before) == 1},{after[0].isalnum()}")
        aside = ["".join(units[max(0, start - 2) : start]), "".join(units[end : end + 2])]
        names.append(f"{kind}:beside={bool(re.search(r'[0-9][^0-9]?$', aside[0]))},{bool(re.match(r'[^0-9]?[0-9]', aside[1]))}")
        if kind == "card":
            names.append(f"card:luhn={luhn(digits)}")
            names.append(f"card:fours={all(len(group) == 4 for group in groups[:-1])}")
        elif kind == "ip":
            names.append(f"ip:octets={len(groups) == 4 and all(len(group) <= 3 and int(group) <= 255 for group in groups)}")
        else:
            sizes = [min(8, len(group)) for group in groups]
            names += [f"phone:first={sizes[0]}", f"phone:last={sizes[-1]}", f"phone:least={min(sizes)}", f"phone:most={max(sizes)}"]
            names.append(f"phone:prefix={re.match('[+]|00?|1', digits)[0] if re.match('00?|1', digits) and first != '+' else first in '+('}")
            names.append(f"phone:open={first in '+('}{signs.count('(') == signs.count(')')}")
    near = [unit.lower() for unit in units[max(0, start - 5) : start] if unit[0].isalpha()]
    names.append(f"{kind}:hint={any(word in _HINTS[kind] for word in near)}")
    return names


def segments(units: list[str]) -> list[tuple[int, int, str, list[str]]]:
    """All candidate segments with their features."""
    found = []
    for end in range(1, len(units) + 1):
        for start in range(max(0, end - LONGEST), end):
            if units[start].isspace() or units[end - 1].isspace():
                continue
            digits = sum(len(unit) for unit in units[start:end] if unit.isdigit())
            for kind in KINDS:
                if kind != "email" and not 7 <= digits <= 21 and not (kind == "ip" and 4 <= digits <= 12):
                    continue
                named = features(units, start, end, kind)
                if named:
                    found.append((start, end, kind, named))
    return found


@dataclass
class Field:
    """Weights of features."""

    weights: dict[str, float]

    def value(self, names: list[str]) -> float:
        return sum(self.weights.get(name, -1.0) for name in names)

    def best(self, units: list[str]) -> list[tuple[int, int, str]]:
        """The segmentation of the largest score; a unit outside of segments scores 0."""
        by_end: dict[int, list] = {}
        for start, end, kind, names in segments(units):
            by_end.setdefault(end, []).append((start, kind, self.value(names)))
        score, back = [0.0] * (len(units) + 1), [None] * (len(units) + 1)
        for end in range(1, len(units) + 1):
            score[end] = score[end - 1]
            for start, kind, value in by_end.get(end, ()):
                if score[start] + value > score[end]:
                    score[end], back[end] = score[start] + value, (start, kind)
        found, end = [], len(units)
        while end > 0:
            if back[end]:
                start, kind = back[end]
                found.append((start, end, kind))
                end = start
            else:
                end -= 1
        return found[::-1]


def train(examples: list[tuple[list[str], list[tuple[int, int, str]]]], rounds: int = 30, rate: float = 0.5, ridge: float = 0.002) -> Field:
    """Gradient ascent on the conditional log likelihood, with exact sums over all segmentations."""
    prepared, index = [], {}
    for units, gold in examples:
        listed = segments(units)
        coded = [(start, end, [index.setdefault(name, len(index)) for name in names]) for start, end, _, names in listed]
        truth = {(start, end, kind) for start, end, kind in gold}
        right = [place for place, (start, end, kind, _) in enumerate(listed) if (start, end, kind) in truth]
        if len(right) == len(gold):
            prepared.append((len(units), coded, right))
    weights, spent = np.zeros(len(index)), np.full(len(index), 1e-3)
    for _ in range(rounds):
        slope = -ridge * len(prepared) * weights
        for size, coded, right in prepared:
            values = np.array([weights[names].sum() for _, _, names in coded])
            ahead, behind = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
            ahead[0] = behind[size] = 0.0
            by_end: dict[int, list[int]] = {}
            by_start: dict[int, list[int]] = {}
            for place, (start, end, _) in enumerate(coded):
                by_end.setdefault(end, []).append(place)
                by_start.setdefault(start, []).append(place)
            for end in range(1, size + 1):
                ahead[end] = np.logaddexp.reduce([ahead[end - 1], *(ahead[coded[p][0]] + values[p] for p in by_end.get(end, ()))])
            for start in range(size - 1, -1, -1):
                behind[start] = np.logaddexp.reduce([behind[start + 1], *(behind[coded[p][1]] + values[p] for p in by_start.get(start, ()))])
            for place, (start, end, names) in enumerate(coded):
                slope[names] -= np.exp(ahead[start] + values[place] + behind[end] - ahead[size])
            for place in right:
                slope[coded[place][2]] += 1.0
        spent += slope**2
        weights += rate * slope / np.sqrt(spent)
    return Field({name: float(weights[place]) for name, place in index.items()})


def _variants(kind: str, text: str, rng: random.Random) -> str:
    """A way in which people write the same thing that the base doesn't read, or does."""
    if kind == "email":
        if rng.random() < 0.1:
            return text
        name, _, domain = text.partition("@")
        name = name.replace("%", "").replace("+", "")
        if rng.random() < 0.4:
            name = re.split(r"[0-9._-]", name)[0] or name
        labels = domain.split(".")
        if len(labels) > 2 and rng.random() < 0.5:
            labels.pop(rng.randrange(len(labels) - 1))
        domain = ".".join(labels)
        at, dot = rng.choice(sorted(_AT)), rng.choice(sorted(_DOT))
        left, right = rng.choice([("", ""), ("", ""), ("[", "]"), ("(", ")"), ("{", "}"), ("<", ">")])
        blank = rng.choice(["", " "])

        def joint(sign: str) -> str:
            if sign in "@.":
                return blank + sign + blank
            return f"{blank}{left}{sign}{right}{blank}" if left else f" {sign} "

        form = rng.random()  # at and dots alike, or one of them plain
        return name + ("@" if form < 0.2 else joint(at)) + domain.replace(".", "." if 0.2 <= form < 0.4 else joint(dot))
    digits = _DIGITS.sub("", text)
    if kind == "card":
        sign = rng.choice(["", " ", "-", ".", "/"]) if rng.random() < 0.7 else f" {rng.choice('-./')} "
        return sign.join(digits[place : place + 4] for place in range(0, len(digits), 4))
    if kind == "ip":
        return text.replace(".", rng.choice([" . ", ". ", " .", "-"])) if rng.random() < 0.5 else text
    if rng.random() < 0.15:
        return text
    local, groups = digits[-10:], []
    if rng.random() < 0.5:
        groups = [local[:3], local[3:6], local[6:]]
    else:
        while local:
            size = rng.choice([2, 3, 3, 4])
            size = len(local) if len(local) - size < 2 or groups and rng.random() < 0.25 else size
            groups.append(local[:size])
            local = local[size:]
    sign = rng.choice(" -./")
    first, rest = groups[0], sign.join(groups[1:])
    start = rng.choice([f"({first}) ", f"({first})", first + sign, f"{first} ", f"{first}/"])
    return rng.choice(["", "", "1 ", "1-", f"00{digits[:-10] or 1} ", f"+{digits[:-10] or 1} "]) + start + rest


def material(spans: list[tuple[str, str]], words: list[str], seed: int = 7) -> list[tuple[list[str], list[tuple[int, int, str]]]]:
    """Training examples from (kind, text) of base spans and words to stand around them."""
    rng = random.Random(seed)
    words = words or ["word"]
    examples = []

    def around(inner: str, kind: str | None) -> None:
        hint = [rng.choice(sorted(_HINTS[kind])) + rng.choice(["", ":"])] if kind and rng.random() < 0.3 else []
        ahead = " ".join([rng.choice(words) for _ in range(rng.randint(1, 5))] + hint) + " "
        after = " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
        after = rng.choice([" ", ", ", " "]) + after if rng.random() < 0.7 else ". " + after.capitalize()
        units = _UNIT.findall(ahead + inner + after)
        if kind is None:
            examples.append((units, []))
            return
        places = np.cumsum([0] + [len(unit) for unit in units]).tolist()
        if len(ahead) in places and len(ahead) + len(inner) in places:
            examples.append((units, [(places.index(len(ahead)), places.index(len(ahead) + len(inner)), kind)]))

    for kind, text in spans:
        around(_variants(kind, text, rng), kind)
    for _ in range(max(50, len(spans))):
        number = "".join(rng.choice("0123456789") for _ in range(rng.randint(7, 21)))
        if len(number) > 12 and luhn(number):  # shorter ones are no cards, whatever their sum
            number = number[:-1] + str((int(number[-1]) + 1) % 10)
        around(rng.choice([number, f"{number[:4]}-{number[4:6]}-{number[6:8]}", ".".join(number[:9]), f"{number[:5]}.{number[5:7]}",
                           " ".join(number[p : p + 3] for p in range(0, len(number), 3)),
                           f"{rng.choice(words)} at {rng.choice(words)} dot", f"{rng.choice(words)} at {rng.choice(words)}",
                           f"{rng.choice(words)} (at) {rng.choice(words)}", f"{rng.choice(words)} at {rng.choice(words)} {rng.choice(words)} dot {rng.choice(words)}",
                           f"{rng.choice('ABDEFGNPS')}{rng.choice('EKLRT')}{number[:2]} " + " ".join(number[p : p + 4] for p in range(2, len(number), 4)),
                           f"{rng.choice(sorted(_PLAIN))} at {rng.choice(words)} dot {rng.choice(words)}", f"{rng.choice(words)} at {rng.choice(sorted(_PLAIN))} dot com",
                           f"{rng.choice(words)} at {rng.choice(words)}. {rng.choice(words).title()} {rng.choice(words)}"]), None)
    return examples


def fit(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Field:
    """Train on material from at most `SAMPLE` texts, those among them that hold an @, a plus or a long number."""
    read = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    chosen = bounded_sample(read, SAMPLE, "doc_id").where(r"text RLIKE '@|\\+[0-9]|[0-9]{7}|[0-9]\\.[0-9]'").select("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = [[{"kind": k, "text": x[s:e]} for k, s, e in base_spans(x)[:SPANS_OF_TEXT]] for x in texts]
            words = [re.findall(r"[^\W\d_]{2,12}", x[:HEAD])[:WORDS_OF_TEXT] for x in texts]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(spans, kind), pa.array(words, pa.list_(pa.string()))], ["spans", "words"])

    rows = chosen.mapInArrow(of, "spans array<struct<kind:string,text:string>>, words array<string>").collect()
    spans = [(span["kind"], span["text"]) for row in rows for span in row["spans"] if len(span["text"]) < 80]
    by_kind = {kind: [span for span in spans if span[0] == kind][:SPANS_OF_KIND] for kind in KINDS}
    taken = [span for kind in KINDS for span in by_kind[kind] + SEED_SPANS[kind] * (len(by_kind[kind]) < FEW)]
    return train(material(taken, [word for row in rows for word in row["words"]][:WORDS]))


#: Material for kinds that the texts hardly show.
SEED_SPANS = {
    "email": [("email", f"{name}.{number}@{host}.example.{top}") for number, (name, host, top) in
              enumerate([("ana", "mail", "org"), ("kim", "post", "com"), ("lee", "web", "net"), ("max", "box", "de")] * 10, 10)],
    "ip": [("ip", f"{a}.{a * 3 % 256}.{a * 7 % 256}.{a * 5 % 256}") for a in range(11, 91, 2)],
    "card": [("card", number) for number in ["4111111111111111", "5500005555555559", "340000000000009", "6011000000000004"] * 10],
    "phone": [("phone", f"+1 ({a}) 555-{a * 11 % 9000 + 1000}") for a in range(201, 241)],
}


def all_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Base spans and those that the field adds around anchors between them."""
    added: list[Span] = []
    taken = [(start, end) for _, start, end in base]
    done = 0
    begins, ends = sorted(start for start, _ in taken), sorted(end for _, end in taken)
    gaps = [(low, high) for low, high in zip([0, *ends], [*begins, len(text)]) if low < high]  # what no base span holds
    for gap, limit, anchor in ((low, high, anchor) for low, high in gaps for anchor in _ANCHOR.finditer(text, low, high)):
        if anchor.start() < done:
            continue
        low, high = max(done, gap, anchor.start() - 60), min(limit, anchor.end() + 60)
        while low > done and low > gap and low > anchor.start() - 80 and text[low - 1].isalnum() and text[low].isalnum():
            low -= 1
        matches = [match for match in _UNIT.finditer(text, low, high)]
        for start, end, kind in field.best([match[0] for match in matches]):
            span = (kind, matches[start].start(), matches[end - 1].end())
            if not any(s < span[2] and span[1] < e for s, e in taken):
                added.append(span)
                taken.append(span[1:])
                done = max(done, span[2])
    return sorted({*base, *added}, key=lambda span: (span[1], KINDS.index(span[0])))


def find(documents: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    named = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            base, spans = [], []
            for value in texts:
                one = value.as_py()
                found = base_spans(one)
                base.append(named(found))
                spans.append(named(all_spans(one, found, shared.value)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(spans, kind)], ["doc_id", "base", "spans"])

    span = "array<struct<kind:string,start:int,end:int>>"
    read = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    return read.mapInArrow(of, f"doc_id bigint, base {span}, spans {span}")
