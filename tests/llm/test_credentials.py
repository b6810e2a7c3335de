from __future__ import annotations

import hashlib
import math
import random
import re

from docledger.llm import credentials
from docledger.llm.queries import QUERIES

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text: str) -> list[tuple]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda span: (span[1], ("assign", "access", "hex").index(span[0])))


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def test_base_against_brute_force(spark, folder="/root/testdata/sf0.01"):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op11_secrets"](spark, folder).collect()
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0
    for r in rows:
        expected = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(expected).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(kind == one for one, *_ in expected) for kind in ("assign", "access", "hex")]
        spans = [tuple(one.split(":")) for one in r.spans.split(",") if one]
        assert [one for one in spans if one[0] != "guess"] == [tuple(map(str, one)) for one in expected]


def test_base_oddities():
    for text in ["token: secret: abcdefgh12", "PASSWORD='abcdefgh", "api_key = =abcdefg", "Apikey:short", "AKIAAKIA12345678", "AKIAAKIA1234567", "pasſword=abcdefgh1",
                 "toKen=abcdefgh1", "f" * 31 + "g" + "a" * 32, "x" + "0" * 70 + "İ token=abcdefgh9", "secret:   \"abc.def-ghi\"", "token=" + "a" * 40]:
        assert credentials.base_spans(text, text.lower()) == base(text)


def cheapest(value: str, words: dict, depth: int = 0) -> float:
    """Over all segmentations, one by one."""
    low = credentials.plain(value)

    def one(start: int, end: int) -> float:
        part, size = low[start:end], end - start
        found = [sum(map(credentials._sign_bits, part))]
        if size in credentials.WORD:
            found.append(credentials._word_bits(value, low, start, end, words) or math.inf)
        found += [bits for pattern, bits in credentials._DATES if (m := pattern.match(low, start)) and m.end() == end]
        found += [bits for stop, bits in credentials._walks(low, start) if stop == end]
        for length in range(1, size // 2 + 1):
            if size % length == 0 and part == part[:length] * (size // length) and (size // length > 2 or length > 1) and depth < 2:
                inner = credentials._sign_bits(part[0]) if length == 1 else cheapest(value[start : start + length], words, depth + 1)
                found.append(inner + math.log2(size // length))
        return min(found)

    best = math.inf
    for cuts in range(1 << (len(value) - 1)):
        places = [0, *(at + 1 for at in range(len(value) - 1) if cuts >> at & 1), len(value)]
        best = min(best, sum(one(a, b) for a, b in zip(places, places[1:])) + credentials.CUT * (len(places) - 2))
    return best


def test_guess_bits_against_all_segmentations():
    rng = random.Random(5)
    words = {"summer": 9.0, "sun": 5.0, "rain": 6.5, "mer": 7.0}
    parts = ["summer", "Sun", "r4in", "qwe", "asdf", "2019", "19991231", "aaa", "abc", "321", "xK", "9", "!", "zz", "sunsun", "Zq7"]
    for _ in range(120):
        value = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))[:11]
        assert math.isclose(credentials.guess_bits(value, words), cheapest(value, words)), value


def test_strength_in_order():
    words = {"correct": 12.0, "horse": 11.0}
    bits = lambda value: credentials.guess_bits(value, words)
    assert max(map(bits, ["password", "P4ssw0rd", "changeme123", "qwertyuiop", "aaaaaaaaaa", "20240131", "letmein!", "CorrectHorse", "abcdefgh", "passpasspass"])) < credentials.STRONG
    assert min(map(bits, ["x9$Lq2vT", "hG7#kP2z!m", "wvqkzjxbtr", "q7Zp0Lm4Xa9b"])) > credentials.STRONG


def test_added_spans(spark):
    prose = ["the summer house is required and the river runs"] * 40
    texts = [
        "db pwd: x9$Lq2vT! and more", "my passphrase is 'hG7#kP2z!m'.", "see https://joe:Zx81!qpLw@host.example/x", "login: summer", "pwd: summerhouse", "the pin is required",
        "clave=q7Zp0Lm4Xa9b;", "pwd=qwertyuiop", "token=abcdefgh12345678", "Kennwort: " + "vT5%" * 100, "", None, "mot de passe: wR8!zK3$pQ", "pwd: short", "passwordx9$Lq2vT!",
    ]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts + prose)], "doc_id bigint, text string")
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in credentials.find(docs).collect() if r.doc_id < len(texts)}
    assert {n: spans for n, spans in found.items() if spans} == {
        0: [("guess", "x9$Lq2vT")], 1: [("guess", "hG7#kP2z!m")], 2: [("guess", "Zx81!qpLw")], 6: [("guess", "q7Zp0Lm4Xa9b")],
        8: [("assign", "token=abcdefgh12345678")], 9: [("guess", "vT5%" * 100)], 12: [("guess", "wR8!zK3$pQ")],
    }


def test_copies_of_a_secret_stay_secrets(spark):
    made = [(n, f"note {n} pwd: wvqkzjxbtr end") for n in range(300)] + [(500 + n, "pwd: riverhouse and river house") for n in range(300)]
    rows = credentials.find(spark.createDataFrame(made, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in rows if r.spans} == set(range(300))


def test_odd_rows(spark):
    made = [(5, "pwd=hG7#kP2z!m", 1, "x"), (5, "pwd=hG7#kP2z!m", 1, "x"), (None, "pwd=hG7#kP2z!m", None, None), (None, None, None, None), (7, "", 1, "x"),
            (8, "pwd:" + "aB3$x" * 30_000, 1, "x"), (9, "token " * 50_000, 1, "x"), (10, "é😀 pwd: hG7#kP2z!m", 1, "x"), (11, "://a:" * 20_000, 1, "x")]
    docs = spark.createDataFrame(made, "doc_id int, text string, row int, value string")
    rows = credentials.find(docs).collect()
    assert sorted((r.doc_id or 0, joined(r.spans)) for r in rows) == sorted(
        [(5, "guess:4:14")] * 2 + [(0, "guess:4:14"), (0, ""), (7, ""), (8, "guess:4:150004"), (9, ""), (10, "guess:8:18"), (11, "")])
    assert credentials.find(docs.limit(0)).collect() == []
