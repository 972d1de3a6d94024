from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from curatrix.llm import neardup as N


def _texts(seed: int = 4) -> list[str]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(3):
        base = [rng.choice(vocabulary) for _ in range(90)]
        for _ in range(30):
            t = list(base)
            for _ in range(rng.randrange(5)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(" ".join(t))
    return out


def _classes(rows: list[tuple]) -> dict:
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, s), (j, t) in combinations(rows, 2):
        if (s is not None and s == t and N.shingles(s).size) or N.similarity(s, t) >= N.THRESHOLD:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def test_similarity_counts_repetitions():
    assert N.similarity("a b c d e f", "a b c d e f") == 1
    assert N.similarity("a b c d e", "a b c d x") == 0
    assert N.similarity("x x x x x x", "x x x x x") == 1 / 2
    assert N.similarity(None, "") == 0 and N.similarity("one", "ONE!") == 1


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 300).astype(np.uint64)
    w = rng.integers(1, 5, 300)
    v = np.where(rng.random(300) < 0.5, w, rng.integers(1, 5, 300))
    want = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    got = []
    for k in range(12):
        s = N.signatures([(N.mix(x + np.uint64(k)), w), (N.mix(x + np.uint64(k)), v)])
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - want) < 0.04


def test_similar_roots_finds_every_link():
    texts = _texts()
    got = N.similar_roots(np.arange(len(texts)), texts)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {i: find(i) for i in range(len(texts))} == _classes(list(enumerate(texts)))


def test_classes_equal_brute_force(spark, monkeypatch):
    rows = list(enumerate(_texts(9), 10))
    rows += [(i, rows[0][1]) for i in range(500, 530)] + [(600, ""), (601, None), (602, "!!"), (603, "short one"), (604, "Short, one"), (605, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS class_id", "'k' AS key", "2 AS row")
    got = N.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == _classes(rows)
    kept = [r.doc_id for r in got if r.kept]
    assert sorted(kept) == sorted(set(_classes(rows).values()))
    assert sorted(r.doc_id for r in N.keep_one(docs).collect()) == sorted(kept)


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET_BLOCK", 7)
    rows = list(enumerate(_texts(11)))
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == _classes(rows)


def test_null_ids_repeated_rows_and_empty(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(None, text), (3, text), (3, text), (None, "alone here")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.class_id is None, r.kept) for r in N.near_duplicates(docs).collect())
    assert got == [(False, False, False), (False, False, True), (True, False, False), (True, True, True)]
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
