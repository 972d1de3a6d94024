from __future__ import annotations

import math
from collections import Counter

import numpy as np

from curatrix.llm import ctw, lm

TEXTS = ["abracadabra", "abab", "xyz", "", "ababc é"]


def _tree(depth, keep=10**9):
    codes, at, _ = ctw.coded(TEXTS, depth)
    keys = ctw.gram_keys(codes, at, depth).tolist()
    seen = Counter((d, (k >> 8) & ((1 << (8 * d)) - 1)) for k in keys for d in range(depth + 1))
    kept = sorted(seen, key=lambda c: (-seen[c], c))[:keep]
    place = {c: i for i, c in enumerate(kept)}
    rows = Counter((place[c], k & 255) for k in keys for d in range(depth + 1) if (c := (d, (k >> 8) & ((1 << (8 * d)) - 1))) in place)
    d, c = (np.array(x, np.int64) for x in zip(*kept, strict=True))
    s, b, n = (np.array(x, np.int64) for x in zip(*[(s, b, n) for (s, b), n in rows.items()], strict=True))
    return ctw.ContextTree(d, c, (s, b, n)), keys, set(kept)


def _naive(text, keys, kept, depth):
    def counts(test, prefix):
        z = o = 0
        for k in keys:
            bits = format(k & 255, "08b")
            if bits.startswith(prefix) and test(k >> 8):
                z, o = (z, o + 1) if bits[len(prefix)] == "1" else (z + 1, o)
        return z, o

    log_kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    low = lambda c, d: c & ((1 << (8 * d)) - 1)

    def children(d, c):
        return [x for e, x in kept if e == d + 1 and low(x, d) == c]

    def node(d, c, prefix):
        a = counts(lambda h: low(h, d) == c, prefix)
        kids = children(d, c)
        if not kids:
            return a, log_kt(*a), None
        rest = counts(lambda h: low(h, d) == c and low(h, d + 1) not in kids, prefix)
        split = sum(node(d + 1, k, prefix)[1] for k in kids) + log_kt(*rest)
        return a, math.log(0.5) + np.logaddexp(log_kt(*a), split), rest

    def predict(d, c, history, prefix):
        a, log_w, rest = node(d, c, prefix)
        own = (a[1] + 0.5) / (sum(a) + 1)
        if rest is None:
            return own
        w = math.exp(math.log(0.5) + log_kt(*a) - log_w)
        below = low(history, d + 1)
        p = predict(d + 1, below, history, prefix) if below in children(d, c) else (rest[1] + 0.5) / (sum(rest) + 1)
        return w * own + (1 - w) * p

    codes, at, _ = ctw.coded([text], depth)
    total = 0.0
    for k in ctw.gram_keys(codes, at, depth).tolist():
        bits = format(k & 255, "08b")
        for i in range(8):
            p = predict(0, 0, k >> 8, bits[:i])
            total += math.log10(p if bits[i] == "1" else 1 - p)
    return total


def test_tree_equals_recursion():
    for depth, keep in ((2, 10**9), (2, 9), (1, 4), (0, 1)):
        tree, keys, kept = _tree(depth, keep)
        scorer = ctw.Scorer(tree.depth, tree.edges, tree.table)
        for text, got in zip(["abra", "q", ""], scorer.score(["abra", "q", ""]), strict=True):
            assert abs(got - _naive(text, keys, kept, depth)) < 1e-4, (depth, keep, text)
        assert np.allclose((10.0 ** tree.table.astype(float)).sum(1), 1, atol=1e-5)


def test_base_and_edges(spark):
    rows = [(1, "The cat\tsat. THE cat"), (2, "the Été"), (3, None), (4, ""), (None, "dog dog"), (2, "the Été"), (6, "cat " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "coalesce(doc_id = 2, false) AS held_out", "1 AS score")
    train = docs.where("not held_out")
    counts = Counter(w for i, t in rows if i != 2 for w in [*(x.replace("É", "É") for x in lm.words_of(t)), "\n"])
    n, v = sum(counts.values()), len(counts)
    for frequent in (2, 1000):
        got = lm.score(docs, train, depth=2, frequent=frequent).collect()
        assert len(got) == len(rows)
        for r in got:
            texts = [t for i, t in rows if i == r.doc_id]
            words = [*lm.words_of(texts[0]), "\n"]
            assert (r.n_tokens, r.train_tokens, r.n_known) == (len(words), n, sum(counts[w] > 0 for w in words))
            assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)) < 1e-9
            assert r.score < 0
    assert lm.score(docs.limit(0), train, depth=1).collect() == []
    uniform = lm.score(docs, docs.limit(0), depth=1).collect()
    assert abs(next(r.score for r in uniform if r.doc_id == 4) - math.log10(1 / 256)) < 1e-6


def test_every_context_counts(spark, monkeypatch):
    """More contexts than any fixed cap held: scores are those of the whole tree, dealt in parts, and rare contexts are known."""
    rng = np.random.default_rng(3)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 400)) for _ in range(120)]
    rows = [(i, t, i % 7 == 2) for i, t in enumerate([*texts, "", None, "é" * 50])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    train = [t for _, t, out in rows if not out]
    codes, at, _ = ctw.coded(train, 5)
    g, n = np.unique(ctw.gram_keys(codes, at, 5), return_counts=True)
    d = np.concatenate([np.full(g.size, k) for k in range(6)])
    ctx = np.concatenate([(g >> 8) & ((1 << 8 * k) - 1) for k in range(6)])
    kept, state = np.unique(d << 40 | ctx, return_inverse=True)
    assert kept.size > 65536
    tree = ctw.ContextTree(kept >> 40, kept & ((1 << 40) - 1), (state, np.tile(g & 255, 6), np.tile(n, 6)))
    want = ctw.Scorer(tree.depth, tree.edges, tree.table).score([t for _, t, _ in rows])
    for held in (lm.HELD_GRAMS, 1000):
        monkeypatch.setattr(lm, "HELD_GRAMS", held)
        monkeypatch.setattr(lm, "FIT_GRAMS", 9000)
        got = {r.doc_id: r.score for r in lm.score(docs, docs.where("not held_out"), unseen=docs.where("held_out")).collect()}
        assert max(abs(got[i] - want[i]) for i in got) < 1e-2 and len(got) == len(rows)
