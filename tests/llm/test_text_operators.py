from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import TABLES
from docledger.llm import byte_bpe, exact_dedup, mixing, neighbours, pii, simhash, suffixes, token_files, toxicity, warc
from docledger.llm.graph import components
from docledger.llm.queries import QUERIES, SQL
from docledger.session import work_folder

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "the quick brown fox jumps over it " * 4000
#: Nulls in every column, empty and blank texts, a long text, repeated rows, and columns that operators use themselves.
ODD = [
    (5, "same  text\there", "en", "a", 1, "x", 1), (2, "same text here", None, None, None, None, None), (2, "same text here", None, None, None, None, None),
    (None, "same text here", "en", "b", 1, "x", 1), (None, None, None, None, None, None, None), (7, "", "en", "a", 0, "x", 1),
    (8, " \n\t ", "en", "a", 3, "x", 1), (9, LONG, "en", "a", 1, "x", 1), (10, "é😀 ́ \x1c \x85x", "en", "", 1, "x", 1),
]
ODD_TYPE = f"{DOC}, digest string, score int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_TYPE)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


@pytest.fixture(scope="module")
def texts(small):
    return {row.doc_id: row.text or "" for row in small.select("doc_id", "text").collect()}


def none(spark, schema=ODD_TYPE):
    return spark.createDataFrame([], schema)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.sql(f"create view {table} as select * from '{TABLES}/{table}.parquet'")
    df = QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    expected = sorted(connection.sql(f"select {', '.join(columns)} from ({SQL[name]})").fetchall(), key=repr)
    assert sorted((tuple(row) for row in df.select(*columns).collect()), key=repr) == expected


def test_exact_dedup_odd_rows(spark, odd):
    rows = exact_dedup.deduplicate(odd).collect()
    assert len(rows) == len(ODD)
    same = [r for r in rows if r.group_size == 4]
    assert {r.doc_id for r in same} == {2, 5, None} and {r.keep_id for r in same} == {2}
    assert sum(r.kept for r in same) == 1  # repeated rows are kept once
    assert sum(r.kept for r in rows) == len({bytes(r.digest) for r in rows})
    assert exact_dedup.deduplicate(none(spark)).collect() == []


def test_index_lasts_over_batches(spark):
    index = exact_dedup.DigestIndex(spark, work_folder(spark, "index"), buckets=4)
    first = spark.createDataFrame([(3, "a"), (1, "b")], "doc_id bigint, text string")
    second = spark.createDataFrame([(0, "a"), (9, "c")], "doc_id bigint, text string")
    index.deduplicate(first).collect()
    for _ in range(2):  # a batch that is given again changes nothing
        got = {r.doc_id: (r.keep_id, r.kept) for r in index.deduplicate(second).collect()}
        assert got == {0: (3, False), 9: (9, True)}
    assert index.rows().count() == 3
    assert index.compact(work_folder(spark, "compact")).rows().count() == 3


def test_index_knows_its_buckets(spark):
    """Opened with other settings, by other sessions and after an append that failed half way, it keeps nothing again."""
    location = work_folder(spark, "layout")
    batch = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    kept = lambda index: index.deduplicate(batch).where("kept").count()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert kept(exact_dedup.DigestIndex(spark, location)) == 1000
        for partitions in ("8", "5", "200"):
            session = spark.newSession()
            session.conf.set("spark.sql.shuffle.partitions", partitions)
            again = exact_dedup.DigestIndex(session, location, name=f"opened_with_{partitions}")
            moved = session.range(1000).select((F.col("id") + 5000).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
            rows = again.deduplicate(moved).collect()
            assert again.buckets == int(before) and sum(r.kept for r in rows) == 0 and {r.keep_id for r in rows} == set(range(1000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, location, buckets=5)

    half = exact_dedup.DigestIndex(spark, work_folder(spark, "half"), buckets=4)
    digests = batch.select(exact_dedup.digest_of(F.col("text")).alias("digest"), F.col("doc_id").alias("keep_id"))
    halves = digests.repartition(4, "digest").withColumn("bucket", F.spark_partition_id()).where("bucket < 2").drop("bucket")
    half.append_new(halves)  # what an append leaves that fails after two of its four buckets
    assert 0 < half.rows().count() < 1000
    assert kept(half) == 1000 and half.rows().count() == 1000 == half.rows().select("digest").distinct().count()


def fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    grams = [b" ".join(words[p : p + 3]) for p in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(gram, 42) for gram in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def linked(prints: dict[int, int], radius: int = 3) -> dict[int, int]:
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for place, i in enumerate(ids):
        for j in ids[:place]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_against_all_pairs(spark, texts):
    prints = {i: fingerprint(t) for i, t in texts.items()}
    groups = linked(prints)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in QUERIES["op8_simhash"](spark, TABLES).collect()}
    assert got == {i: (prints[i], groups[i]) for i in texts}
    assert len(set(groups.values())) < len(groups)


@pytest.mark.parametrize("crowd", [2048, 3])
def test_links_of_crowded_keys(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 60)
    flips = (1 << rng.integers(0, 60, (60, 6))).astype(np.int64)
    prints = np.unique(np.concatenate([base, (base[:, None] ^ flips).ravel(), base ^ 7, base ^ (1 << 5 | 1 << 30 | 1 << 50)]))
    found = components(simhash.links(spark.createDataFrame([(int(p),) for p in prints], "fingerprint bigint"))).collect()
    got = dict.fromkeys(map(int, prints), None) | {r.node: r.root for r in found}
    groups = linked({int(p): int(p) & (1 << 64) - 1 for p in prints})
    assert {p: got[p] if got[p] is not None else p for p in got} == groups


@pytest.mark.parametrize("crowd", [2048, 3])
def test_links_over_all_bits(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(2)
    bases = rng.integers(0, 2**64, 80, np.uint64)
    flips = [1 << 63, 1 << 63 | 1, 1 << 63 | 1 << 62 | 1 << 61, 1 << 63 | 1 << 40 | 1 << 9, 1 << 63 | 7 << 60, 1 << 63 | 15, 1 << 62 | 1 << 2]
    flips += [sum(1 << int(bit) for bit in rng.choice(64, size, replace=False)) for size in (1, 2, 3, 3, 4)]
    prints = {int(base) ^ (flip if n % 12 == place else 0) for n, base in enumerate(bases) for place, flip in enumerate(flips)}
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    found = components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint bigint"))).collect()
    got = {p: p for p in signed} | {r.node: r.root for r in found}
    assert got == linked(signed)


def test_simhash_odd_rows(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    blank = [r for r in rows if r.fingerprint == 0]
    assert {r.doc_id for r in blank} == {None, 7, 8} and {r.component_id for r in blank} == {7}
    assert simhash.near_duplicates(none(spark)).collect() == []


def targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[place % 3] for place, s in enumerate(order)}
    full: set = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and rest * weight[s] / open_weight > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else rest * weight[s] / open_weight for s in sizes}
        full |= over


def test_mixing(spark, small, texts):
    rows = QUERIES["op10_mixing"](spark, TABLES).collect()
    words = {i: len(t.encode().split()) for i, t in texts.items()}
    sizes: dict = {}
    for row in small.select("doc_id", "source").collect():
        sizes[row.source] = sizes.get(row.source, 0) + words[row.doc_id]
    wanted, taken = targets(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        assert r["size"] == words[r.doc_id] and r.source_size == sizes[r.source] and abs(r.target - wanted[r.source]) < 1e-6
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[r.source] += r.taken
    assert len(rows) == len(texts)
    assert all(abs(taken[s] - wanted[s]) < max(words.values()) for s in sizes)
    assert sorted(rows) == sorted(QUERIES["op10_mixing"](spark, TABLES).collect())


def test_mixing_hot_source_and_mass(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    by_source = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"))
    assert all(abs(r.taken - r.target) <= 51 for r in by_source.collect())


def test_mixing_odd_rows(spark, odd):
    mixed = mixing.mix(odd)
    rows = mixed.collect()
    assert len(rows) == len(ODD) and {r.copies for r in rows if r["size"] == 0} == {0}
    again = mixing.repeat(odd, mixed)
    assert again.columns == odd.columns and again.count() == sum(r.copies for r in rows)
    assert mixing.mix(none(spark)).collect() == []


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, library, texts):
    for r in QUERIES["op6_byte_bpe"](spark, TABLES).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_byte_bpe_odd_texts(spark, odd, library):
    rng = random.Random(4)
    strange = ["x" * 1000, "ab" * 700, "aaaab" * 300, "a  b\n\n c \t", "'s'll don't", "".join(rng.choice("etaoin") for _ in range(5000))]
    strange += ["".join(rng.choice("ab \n'1.sé\x1c\x85") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    encoder = byte_bpe.Encoder(byte_bpe.Vocabulary(byte_bpe.read_ranks(RANKS)), public_tokenizers.PATTERN)
    ids, counts = encoder.encode(strange)
    assert [list(map(int, part)) for part in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode_ordinary(t) for t in strange]
    rows = byte_bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t[1] or "").encode() for t in ODD)
    apart = byte_bpe.decode(byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(map(repr, apart.collect())) == sorted(map(repr, rows))
    lost = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(lost, RANKS, public_tokenizers.PATTERN).collect()] == [b"", b""]
    assert byte_bpe.round_trip(none(spark), RANKS, public_tokenizers.PATTERN).collect() == []


def test_packing():
    rng = random.Random(2)
    for count in (0, 1, 3, 4, 5, 1000):
        numbers = np.array([rng.choice([rng.randrange(256), rng.randrange(2**16), rng.randrange(2**24), rng.randrange(2**32)]) for _ in range(count)], np.uint32)
        assert (token_files.unpack(*token_files.pack(numbers), count) == numbers).all()


def test_token_files(spark, texts, odd, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    monkeypatch.setattr(token_files, "BLOCK", 5000)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op9_token_files"](spark, TABLES).collect()}
    start, expected = 0, {}
    for doc_id in sorted(texts):
        ids = tokenizer.encode(texts[doc_id], add_special_tokens=False).ids + [2]
        expected[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == expected
    path = work_folder(spark, "odd-tokens")
    token_files.write(odd, public_tokenizers.path("word_bpe_49k.json"), path)
    rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert len(rows) == len(ODD) and [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert min(r.n_tokens for r in rows) == 1 and rows[0].doc_id is None
    path = work_folder(spark, "no-tokens")
    token_files.write(none(spark), public_tokenizers.path("word_bpe_49k.json"), path)
    assert token_files.read(spark, path).collect() == []


def test_added_tokens():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    strange = ["a <|endoftext|> b", "plain words", "", "<|startoftext|>x<|endoftext|>", "Not <|ENDOFTEXT|>, one.", "<|endoftext|>", "last. é"]
    with open(path, encoding="utf-8") as file:
        encoder = token_files.WordEncoder(file.read())
    for texts in (strange, strange[1:3], strange[:1]):
        ids, counts = encoder.encode(texts)
        assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_toxicity_readings():
    reader = toxicity.Reader({"blockhead": 2.0}, {"nasti": 3.0})
    read = lambda text: dict(zip((*toxicity.REGISTERS, "words"), reader.registers(text)))
    assert read("What a blockhead.")["plain"] == 2.0
    assert read("You are a blockhead!")["aimed"] == 2.0
    assert read("Blockhead that you are!")["aimed"] == 2.0
    assert read("You are not a blockhead.")["denied"] == 2.0 and read("You are not a blockhead.")["aimed"] == 0
    assert read("He said you were a blockhead.")["reported"] == 2.0
    assert read("He said it. You blockhead.")["aimed"] == 2.0  # the report ends with its clause
    assert read("I will hurt you")["threat"] == 1.0 and read("That may hurt")["threat"] == 0
    assert read("nastiest nasti")["strong"] == 6.0 and read("calm words")["words"] == 2.0
    assert read("")["words"] == 0


def test_toxicity_clauses_against_brute_force():
    """Readings by their definition: windows over the clause instead of machines."""
    rng = random.Random(4)
    machine = toxicity.grammar()
    for _ in range(2000):
        symbols = [(rng.choice(toxicity.SYMBOLS), round(rng.uniform(0.1, 4), 2)) for _ in range(rng.randint(0, 9))]
        kinds = [kind for kind, _ in symbols]
        expected: dict[str, float] = {}
        for at, (kind, weight) in enumerate(symbols):
            if kind not in ("insult", "threat"):
                continue
            aimed = "target" in kinds
            reading = (
                "reported" if "report" in kinds[:at] else "denied" if "negation" in kinds[max(0, at - toxicity.REACH) : at]
                else ("threat" if aimed else None) if kind == "threat" else "aimed" if aimed else "plain"
            )
            for name in [reading] + ["strong"] * (reading in ("plain", "aimed") and weight >= toxicity.STRONG):
                if name:
                    expected[name] = expected.get(name, 0.0) + weight
        assert toxicity.read_clause(machine, symbols) == expected


def test_toxicity_fit_converges():
    """Hundreds of samples, some of them separable; each fit has next to no gradient and is at the maximum that plain ascent reaches."""
    rng = np.random.default_rng(5)
    for case in range(300):
        rows, columns = int(rng.integers(20, 400)), 18
        x = rng.lognormal(0, 3, (rows, columns)) * (rng.random((rows, columns)) < 0.1)
        y = (x[:, 0] + x[:, 1] > (0 if case % 3 else 1)).astype(float)
        weights, bias = toxicity._fit_logistic(x, y)
        spread = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
        design = np.column_stack([(x - x.mean(axis=0)) / spread, np.ones(rows)])
        ridge = np.array([0.3] * columns + [1e-6])
        beta = np.append(np.array(weights) * spread, bias + np.array(weights) @ x.mean(axis=0))
        slope = design.T @ (y - 1 / (1 + np.exp(-design @ beta))) - ridge * beta
        assert np.abs(slope).max() < 1e-5 * rows
    other, rate = np.zeros(columns + 1), 1 / (0.25 * np.linalg.norm(design, 2) ** 2 + 0.3)
    ahead, pace = other, 1.0
    for _ in range(50_000):  # an independent solver: accelerated ascent with a fixed step
        after = ahead + rate * (design.T @ (y - 1 / (1 + np.exp(-design @ ahead))) - ridge * ahead)
        pace, before = (1 + (1 + 4 * pace**2) ** 0.5) / 2, pace
        other, ahead = after, after + (before - 1) / pace * (after - other)
    assert np.allclose(other[:-1], beta[:-1], rtol=1e-3, atol=1e-4)


def test_toxicity_copies_are_no_evidence(spark):
    """Ten copies of every labelled text learn the arcs that one learns."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    ten = spark.range(10).withColumnRenamed("id", "copy")
    moved = lambda df: df.join(ten).withColumn("doc_id", F.col("doc_id") * 10 + F.col("copy")).drop("copy")
    known = labels.where(~toxicity.held_out(F.col("doc_id")))
    once, copied = toxicity.fit(docs, known), toxicity.fit(moved(docs), moved(known))
    # The held-out side of the copies is another one: nearly all texts keep a copy outside of it.
    assert abs(len(once.words) + len(once.stems) - len(copied.words) - len(copied.stems)) <= 0.1 * (len(once.words) + len(once.stems)) + 2


def test_toxicity_held_out(spark):
    folder = TABLES.replace("0.001", "0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op2_toxicity"](spark, folder).collect()
    assert {r.held_out for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0} == {True}
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in judged) / len(judged) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1), (None, 1), (9, None), (9, 0), (2, 0), (2, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(odd, labels)
    assert {r.score for r in toxicity.score(odd, model).collect()} == {0.0}
    assert toxicity.keep_clean(odd, model).count() == len(ODD)
    assert toxicity.score(none(spark), toxicity.fit(none(spark), labels.limit(0))).collect() == []


def base_by_search(text: str) -> list:
    import re

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    found = []
    for place, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [d if n % 2 == 0 else sum(divmod(2 * d, 10)) for n, d in enumerate(reversed(digits))]
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                found.append((m.start(), place, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_pii(spark, texts):
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("12 5.-+@a()é_%") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == base_by_search(text)
    for r in QUERIES["op7_pii"](spark, TABLES).collect():
        base = base_by_search(texts[r.doc_id])
        joined = ["%s:%d:%d" % span for span in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == kind for s in base) for kind in pii.KINDS]
        assert set(joined) <= set(r.spans.split(",") if r.spans else [])


def test_pii_field(spark, odd):
    field = pii.fit(odd)  # no spans there: the fixed material alone
    cases = {
        "mail me at john.smith [at] mail7.example [dot] com please": [("email", "john.smith [at] mail7.example [dot] com")],
        "call (456) 555-2186 now": [("phone", "(456) 555-2186")], "it was at the dot com era": [], "order 12345678 and 2024-12-01": [],
        "card 4111-1111-1111-1111 ok": [("card", "4111-1111-1111-1111")],
    }
    for text, expected in cases.items():
        assert [(k, text[s:e]) for k, s, e in pii.all_spans(text, pii.base_spans(text), field)] == expected
    best = field.best(units := pii._UNIT.findall("ring (456) 555-2186 now"))
    every = pii.segments(units)

    def top(at: int) -> float:  # all segmentations, one by one
        if at >= len(units):
            return 0.0
        return max([top(at + 1)] + [field.value(names) + top(end) for start, end, _, names in every if start == at])

    assert abs(top(0) - sum(field.value(pii.features(units, s, e, k)) for s, e, k in best)) < 1e-9
    assert len(pii.find(odd, field).collect()) == len(ODD) and pii.find(none(spark), field).collect() == []


def told(rng):
    """(text, spans) of a sentence with personal data, or things that look like it, in forms drawn apart from the training material."""
    pick = rng.choice
    digits = lambda n: "".join(pick("0123456789") for _ in range(n))
    name = pick(["jane.doe", "m_keller", "bob42", "li-wei", "Ofelia", "x.y.zed"])
    host, top = pick(["acme", "uni-bonn", "post-box", "mail3"]), pick(["com", "fr", "info", "co.uk"])
    at, dot = pick([(" at ", " dot "), (" [at] ", "."), ("(at)", "(dot)"), ("{at}", "{dot}"), (" @ ", " . "), ("<at>", "<dot>"), ("@", " dot "), (" arroba ", " punto ")])
    number = digits(15)
    while not pii.luhn(number + "0"):
        number = digits(15)
    card = number + "0"
    a, b, c, d = pick("23456789") + digits(2), digits(3), digits(2), digits(2)
    octets = [str(rng.randrange(1, 256)) for _ in range(4)]
    kind, inner = pick([
        ("email", name + at + f"{host}.{top}".replace(".", dot)),
        ("phone", pick([f"{a}-{b}-{c}{d}", f"({a}) {b} {c}{d}", f"{a}.{b}.{c}{d}", f"1 ({a}) {b}-{c}{d}", f"{a}/{b}-{c}{d}", f"0049 {a} {b}{c}{d}", f"{a} {b} {c} {d}"])),
        ("card", pick([".", "/", " - "]).join(card[n : n + 4] for n in range(0, 16, 4))),
        ("ip", pick([" . ", ". ", " .", "-"]).join(octets)),
        (None, pick([
            f"20{c}-0{pick('123456789')}-1{pick('0123456789')}", f"1{pick('0123456789')}:{digits(2)}:{digits(2)}", f"order {digits(9)}", f"v{pick('123')}.{pick('0123')}.{digits(2)}",
            f"ISBN 978-3-16-{digits(6)}-{pick('0123456789')}", f"{digits(2)}.{digits(4)}, {digits(1)}.{digits(4)}", f"EUR {digits(1)},{digits(3)},{digits(3)}.{digits(2)}",
            "we met at noon. Then", "look at the dot on top", "at home. Dot came", f"tracking 1Z{digits(6)}AB{digits(4)}", f"pages {digits(3)}-{digits(3)}", f"{digits(3)} {digits(3)} {digits(3)} units",
            f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", f"from 19{c}-20{d} on"])),
    ])
    before, after = pick(["Please use", "so", "My", "it says:", "reach us via", "see", "Hinweis:"]) + " ", pick([" for now", ", thanks", ". Bye", "", " und dann", "; next"])
    if kind and rng.random() < 0.4:
        before += {"email": "mail", "phone": "phone", "card": "card", "ip": "server"}[kind] + pick([" ", ": "])
    return before + inner + after, [(kind, len(before), len(before) + len(inner))] if kind else []


def test_pii_added_spans_on_other_forms(spark, small):
    """Precision and recall of what the field adds, on sentences that its training material doesn't make."""
    field, rng = pii.fit(small), random.Random(12)
    right, added, planted = (dict.fromkeys(pii.KINDS, 0) for _ in range(3))
    for _ in range(2000):
        text, spans = told(rng)
        base = pii.base_spans(text)
        found = [span for span in pii.all_spans(text, base, field) if span not in base]
        for kind, *_ in (spans := [span for span in spans if span not in base]):
            planted[kind] += 1
        for span in found:
            added[span[0]] += 1
            right[span[0]] += span in spans
    precision = {kind: right[kind] / added[kind] for kind in pii.KINDS}
    recall = {kind: right[kind] / planted[kind] for kind in pii.KINDS}
    assert min(precision.values()) > 0.9, precision
    assert all(recall[kind] > least for kind, least in {"email": 0.7, "ip": 0.95, "card": 0.95, "phone": 0.7}.items()), recall


def test_pii_looks_at_every_variant():
    seen: list = []

    class Looks:
        def best(self, units):
            seen.append("".join(units))
            return []

    rng = random.Random(6)
    cases = [pii._variants(kind, text, rng) for kind in pii.KINDS for _, text in pii.SEED_SPANS[kind] * 5]
    cases += ["10 . 20 . 30 . 40", "10-0-0-1", "jane at example.com", "jane at mail.example dot org", "jane arroba mail punto org"]
    for case in cases:
        for text in (f"so it was {case} then", f"card 4111111111111111 {case} then"):
            base = pii.base_spans(text)
            seen.clear()
            pii.all_spans(text, base, Looks())
            at = text.index(case)
            if not any(start < at + len(case) and at < end for _, start, end in base):
                assert any(case in part for part in seen), text


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(1500, 16))
    vectors[300:700] = vectors[7]  # a vector that many rows repeat
    vectors[9] = 0
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)] + [(5000, None), (5100, [float("nan")] * 16), (5200, [1.0]), (None, [1.0] * 16), (40, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = neighbours.Index(df).search(F.col("vec_id") % 50 == 0).collect()
    vectors[40] = np.minimum(vectors[40].tolist(), [1.0] * 16) if vectors[40].tolist() < [1.0] * 16 else vectors[40]
    ids = np.array([i for i in range(1500) if i != 9])
    hits = total = 0
    for query in range(0, 1500, 50):
        away = np.sqrt(((vectors[ids] - vectors[query]) ** 2).sum(axis=1))
        order = [p for p in np.lexsort((ids, away)) if ids[p] != query][:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == query)
        assert [rank for rank, _, _ in mine] == list(range(1, 11))
        if query in range(300, 700):
            assert [v for _, v, _ in mine] == ids[order].tolist()
        hits, total = hits + len({v for _, v, _ in mine} & set(ids[order].tolist())), total + 10
    assert hits / total >= 0.9 and {r.query_id for r in got} == set(range(0, 1500, 50))
    assert neighbours.Index(none(spark, "vec_id bigint, embedding array<float>")).search(F.lit(True)).collect() == []
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.Index(few).search(F.lit(True)).orderBy("query_id").collect()] == [(1, 1, 2), (2, 1, 1)]


def test_repeats(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage, short = [word() for _ in range(130)], [word() for _ in range(45)]
    docs = {}
    for n in range(40):
        body = [word() for _ in range(rng.randint(60, 300))]
        if n % 4 == 0:
            begin = rng.randint(0, 60)
            place = rng.randint(0, len(body))
            body[place:place] = passage[begin : begin + rng.randint(50, 70)]
        elif n % 4 == 1:
            body[10:10] = short
        docs[n] = body
    docs[40] = ["for"] * 400  # repeats within itself only
    df = spark.createDataFrame([(n, " ".join(body)) for n, body in docs.items()], "doc_id bigint, text string")
    owners: dict = {}
    for n, body in docs.items():
        for p in range(len(body) - 49):
            owners.setdefault(tuple(body[p : p + 50]), set()).add(n)
    expected = {n: set() for n in docs}
    for n, body in docs.items():
        for p in range(len(body) - 49):
            if len(owners[tuple(body[p : p + 50])]) > 1:
                expected[n].update(range(p, p + 50))
    got = {n: set() for n in docs}
    for r in suffixes.repeats(df).collect():
        assert r.n_words == r.end - r.start >= 50 and r.partner != r.doc_id
        got[r.doc_id].update(range(r.start, r.end))
    assert got == expected and any(expected.values())


def covered(rows) -> dict:
    got: dict = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    return got


def test_repeats_around_a_frequent_line(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    footer = [word() for _ in range(30)]
    bodies = {n: [word() for _ in range(100)] + footer + [word() for _ in range(60)] for n in range(300)}
    for n in range(0, 300, 10):  # pairs that share 21 words ahead of the line, far from each other in any order of what follows
        bodies[n + 7][79:100] = bodies[n][79:100]
    df = spark.createDataFrame([(n, " ".join(body)) for n, body in bodies.items()], "doc_id bigint, text string")
    expected = {m: set(range(79, 130)) for n in range(0, 300, 10) for m in (n, n + 7)}
    assert covered(suffixes.repeats(df).collect()) == expected


def test_repeats_over_batches_and_tasks(spark):
    rng = random.Random(10)
    long = LONG * 3
    docs = [(9, long), (11, long), (12, " ".join(f"own{n}" for n in range(300))), (13, " ".join(rng.choice("ab") for _ in range(400)))]
    size, tasks = (spark.conf.get(name) for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions"))
    try:
        for batch, number in ((size, tasks), ("1000", "23")):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            spark.conf.set("spark.sql.shuffle.partitions", number)
            got = covered(suffixes.repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())
            assert got == {9: set(range(84000)), 11: set(range(84000))}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        spark.conf.set("spark.sql.shuffle.partitions", tasks)


def test_repeats_removable_by_part(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    a, b, bodies = [word() for _ in range(80)], [word() for _ in range(90)], [[word() for _ in range(70)] for _ in range(3)]
    docs = {5: bodies[0] + a, 100: a + b + bodies[1], 900: bodies[2] + b}
    rows = suffixes.repeats(spark.createDataFrame([(n, " ".join(body)) for n, body in docs.items()], "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.start, r.end, r.partner, r.removable) for r in rows} == {
        (5, 70, 150, 100, False), (100, 0, 80, 5, True), (100, 80, 170, 900, False), (900, 70, 160, 100, True)}


def test_repeats_odd_rows(spark, odd):
    twice = odd.unionByName(odd.where("doc_id = 9").withColumn("doc_id", F.lit(11).cast("bigint")))
    assert {r.doc_id: (r.start, r.end) for r in suffixes.repeats(twice).collect()} == {9: (0, 28000), 11: (0, 28000)}
    assert suffixes.repeats(none(spark)).collect() == []


def test_warc(spark):
    page = ('<!DOCTYPE html><html lang="de"><head><title>A &amp; B</title><meta charset="utf-8"><style>p{}</style><script>var t="</p>";</script></head><body>'
            '<!-- no --><p title="x > y">One<br>two &lt;3</p><a href="/rel">l</a><a href=\'http://o.example/\'>m</a> 1 < 2<div>end</body></html>')
    read = warc.read_page(page)
    assert (read["title"], read["lang"], read["charset"], read["links"]) == ("A & B", "de", "utf-8", ["/rel", "http://o.example/"])
    assert read["text"] == "One\ntwo <3\nlm 1 < 2\nend"
    pages = spark.createDataFrame([(1, "http://h.example/d/x", page, "k"), (2, None, None, None), (None, "u", "<p>un<!-- closed", "k"), (1, "http://h.example/d/x", page, "k")],
                                  "page_id bigint, url string, html string, kind string")
    records = warc.derive(warc.responses(pages))
    rows = records.collect()
    assert len(rows) == 8
    first = {r.kind: r for r in rows if r.key == 1}
    assert first["metadata"].outlinks == ["http://h.example/rel", "http://o.example/"]
    assert first["metadata"].refers_to == first["conversion"].refers_to and f"conversion: {first['conversion'].record_id}" in first["metadata"].block
    sha = "sha1:" + base64.b32encode(hashlib.sha1(page.encode()).digest()).decode()
    assert first["conversion"].source_digest == sha and dict(first["conversion"].source_headers)["Content-Length"] == str(len(page.encode()))
    assert {r.block for r in rows if r.key == 2 and r.kind == "conversion"} == {""}
    for r in warc.to_warc(records).collect():
        headers, block = warc.parse(bytes(r.record))
        named = dict(headers)
        assert named["WARC-Type"] == r.kind and named["WARC-Block-Digest"] == warc.digest(block)
        assert named["WARC-Refers-To"] in {x.refers_to for x in rows}
    assert warc.derive(warc.responses(pages.limit(0))).collect() == []


class Plain(HTMLParser):
    """A page's title, links, language and text by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.lang, self.parts, self.hidden, self.titles = None, [], None, [], None, False
        self.feed(page)
        self.close()
        lines = (" ".join(re.split(r"[^\S\n]+", line)).strip() for line in "".join(self.parts).split("\n"))
        self.text = "\n".join(line for line in lines if line)

    def handle_starttag(self, tag, attrs):
        if self.hidden == "head" and tag == "body":
            self.hidden = None
        if tag == "title":
            self.titles = True
        elif self.hidden is None:
            if tag == "a" and dict(attrs).get("href"):
                self.links.append(dict(attrs)["href"])
            elif tag == "html":
                self.lang = dict(attrs).get("lang")
            if tag in ("head", "script", "style", "noscript", "svg"):
                self.hidden = tag
            elif tag in ("p", "div", "br", "li", "h1", "td"):
                self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag == "title":
            self.titles = False
        elif self.hidden is not None:
            self.hidden = None if tag == self.hidden else self.hidden
        elif tag in ("p", "div", "li", "h1", "td"):
            self.parts.append("\n")

    def handle_data(self, data):
        if self.titles:
            self.title = (self.title or "") + data
        elif self.hidden is None:
            self.parts.append(data)


def made_page(rng):
    pieces = ["word", " ", "  \t", "\n", "&amp;", "&lt", "&#233;", "&nbsp;", "é😀", "1 < 2", "<3", ";", "&copy", "a&b", "<b>", "</b>", "<i title='a > b'>", "</i>", "<p>",
              "</p>", "<div class=x>", "</div>", "<br/>", "<BR>", "<li>", "<h1>T", "</h1>", "<!-- <p>no</p> -->", "<!---->", "<a href=\"/x?a=1&amp;b=2\">", "</a>", "<a name=q>",
              "<A HREF='http://o.example/y'>", "<a href=/bare>", "<script>if (a < b) { t = '<p>'; }</script>", "<STYLE>p > b {}</STYLE>", "<noscript>n<p>o</noscript>", "<svg><a href=/no>s</a></svg>", "<td>"]
    head = rng.choice(["", "<head><title>A &amp; B\n c</title><meta charset=utf-8><style>x</style></head>", "<head><script>1</script>lost<title>t</title>"])
    return f"<!DOCTYPE html><html lang='{rng.choice(['de', 'en'])}'>{head}<body>" + "".join(rng.choice(pieces) for _ in range(rng.randrange(60))) + rng.choice(["", "</body></html>"])


def test_warc_pages_against_another_parser(spark):
    rng = random.Random(4)
    pages = [made_page(rng) for _ in range(3000)]
    pages += [row.html for row in spark.read.parquet(f"{TABLES}/pages.parquet").select("html").collect() if row.html]
    for page in pages:
        read, plain = warc.read_page(page), Plain(page)
        assert (read["text"], read["links"], read["lang"]) == (plain.text, plain.links, plain.lang), page
        assert read["title"] == " ".join((plain.title or "").split()), page


def test_warc_repeated_headers(spark):
    sent = [("Set-Cookie", "a=1"), ("Via", "x"), ("Set-Cookie", "b=2; c"), ("Empty", None), (None, "lost"), ("via", " y\r\nInjected: z")]
    rows = [(1, "<urn:uuid:1>", "http://h.example/", "2026-01-01T00:00:00Z", sent, bytearray(b"<p>\xff</p>")), (2, None, None, None, None, None)]
    records = warc.derive(spark.createDataFrame(rows, f"key bigint, record_id string, target_uri string, date string, http_headers {warc.HEADERS}, payload binary"))
    found = {(r.key, r.kind): r for r in records.collect()}
    kept = [("Set-Cookie", "a=1"), ("Via", "x"), ("Set-Cookie", "b=2; c"), ("Empty", ""), ("via", " y\r\nInjected: z")]
    for kind in ("metadata", "conversion"):
        assert [tuple(header) for header in found[1, kind].source_headers] == kept and found[2, kind].source_headers == []
    fields = [line for line in found[1, "metadata"].block.split("\r\n") if line.startswith("http-")]
    assert fields == ["http-set-cookie: a=1", "http-via: x", "http-set-cookie: b=2; c", "http-via: y Injected: z"]
    for r in warc.to_warc(records).collect():
        headers, block = warc.parse(bytes(r.record))
        assert headers == [tuple(header) for header in found[r.key, r.kind].warc_headers] and block.decode() == found[r.key, r.kind].block
    assert found[1, "conversion"].block == "\ufffd"
