from __future__ import annotations

import hashlib
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import TABLES
from docledger.llm import mixing, toxicity
from docledger.llm.common import written

ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, _copy int, size string"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found.append(written(stage(spark, found[-1], TABLES), name))
        assert found[-1].columns == docs.columns
    return found


def rows(df):
    return [tuple(row) for row in df.collect()]


def test_toxicity_stage(spark, stages):
    assert set(rows(stages[1])) <= set(rows(stages[0]))
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, folder).select("doc_id").collect()}
    unseen = labels.where(toxicity.held_out(F.col("doc_id"))).where("toxic is not null").join(docs.select("doc_id"), "doc_id").collect()
    toxic, clean = ([r.doc_id in kept for r in unseen if r.toxic == side] for side in (1, 0))
    assert len(toxic) > 50 and sum(toxic) < 0.15 * len(toxic) and sum(clean) > 0.98 * len(clean)


def test_exact_dedup_stage(stages):
    before, after = map(rows, stages[1:3])
    least: dict = {}
    for doc_id, text, *_ in before:
        key = " ".join((text or "").replace("\v", " ").split(" "))
        key = hashlib.sha256(b" ".join(p for p in (text or "").encode().split())).digest() if key else b""
        least[key] = min(doc_id, least.get(key, doc_id))
    assert {r[0] for r in after} >= set(least.values()) and len({r[0] for r in after}) == len(after)
    assert set(after) <= set(before)


def prints(text: str) -> int:
    words = text.encode().lower().split()
    grams = [b" ".join(words[p : p + 3]) for p in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(gram, 42) for gram in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_simhash_stage(stages):
    """Against all pairs."""
    before, after = rows(stages[2]), rows(stages[3])
    by_print = {r[0]: prints(r[1] or "") for r in before}
    root = {i: i for i in by_print}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in combinations(sorted(by_print), 2):
        if (by_print[a] ^ by_print[b]).bit_count() <= 3:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert sorted(after) == sorted(r for r in before if find(r[0]) == r[0])


def test_rows_by_identity(spark):
    """Null and repeated ids, and columns with the names that stages use themselves, go through with their values."""
    kind = "doc_id int, text string, lang string, source string, n_chars bigint, _key int, _copy int, _time string, size string, key string, row int, `a.b` int, m map<string,int>"
    texts = [" ".join(f"{word}{n}" for word in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for n in range(6)]
    extra = (77, 78, "t", "s", "k", 79, 80, {"a": 1})
    made = [(None, texts[0], "en", "s", 1, *extra), (None, texts[1], "en", "s", 1, *extra), (5, texts[2], "en", "s", 1, *extra), (5, texts[3], "en", "s", 1, *extra),
            (7, texts[2], "de", "s", 1, *extra), (3, texts[4], None, None, None, *[None] * 8), (8, texts[4].replace(" ", "  "), "en", "s", 1, *extra)]
    docs = spark.createDataFrame(made, kind)
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        docs = written(stage(spark, docs, TABLES), "identity")
        assert sorted(map(repr, rows(docs))) == sorted(repr(made[place]) for place in (0, 1, 2, 3, 5))
        assert docs.schema == spark.createDataFrame(made, kind).schema
    mixed = corpus_pipeline.mix_sources(spark, docs, TABLES)
    assert mixed.columns == docs.columns and {repr(r) for r in rows(mixed)} <= {repr(r) for r in rows(docs)}
    assert {repr(made[place]) for place in (0, 1, 2, 3)} == {repr(r) for r in rows(mixed) if r[3] == "s"}


def test_mixing_stage(stages):
    before, after = rows(stages[3]), rows(stages[4])
    copies = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect()}
    assert sorted(after) == sorted(r for r in before for _ in range(copies[r[0]]))


def test_last_stage_and_run(spark, stages):
    got = corpus_pipeline.run(spark, TABLES).collect()
    expected = sorted((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows(stages[4]))
    assert sorted((r.doc_id, r.decoded_sha256) for r in got) == expected
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_odd_tables(spark):
    made = [(1, None, None, None, None, 1, "x"), (1, None, None, None, None, 1, "x"), (None, "a b c", "en", "s", 1, None, None),
            (None, "a b c", "en", "s", 1, None, None), (3, "", "en", "s", 0, 1, ""), (4, "word " * 50000, "en", "t", 1, 1, "x")]
    for count in (len(made), 0):
        docs = spark.createDataFrame(made[:count], ODD)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, TABLES), "odd")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, TABLES).count() == docs.count()
