from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from curatrix.llm import ann


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "DATA_BLOCK", 900)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 32)) * rng.uniform(0.5, 1, (3000, 1))
    docs = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(docs, F.col("vec_id") % 20 == 0).collect()
    found: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r)
    recall = []
    for q, rows in found.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.argsort(-s)[:20].tolist())
        recall.append(len(best & {r.vec_id for r in rows}) / 20)
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert all(abs(r.score - x[q] @ x[r.vec_id]) < 1e-12 for r in rows)
        assert all(a.score > b.score or (a.score == b.score and a.vec_id < b.vec_id) for a, b in zip(rows, rows[1:]))
    assert len(found) == 150 and np.mean(recall) >= 0.9


def test_invalid_ties_and_few(spark):
    v = [1.0, 0.0]
    rows = [(0, v), (7, v), (3, v), (20, [0.0, 0.0]), (40, None), (60, [float("nan"), 1.0]), (80, [1.0, None]), (100, []), (None, [0.5, 0.0]), (120, [1.0, 2.0, 3.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(docs, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 1.0), (0, 2, 7, 1.0), (0, 3, None, 0.5)]
    assert ann.nearest(docs.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_recall_with_unequal_norms():
    """One long vector, or norms of heavy tails, take nothing from the other rows."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    outlier = x.copy()
    outlier[7] *= 10
    rows, queries = np.arange(len(x)), np.arange(0, len(x), 40)
    for y in (outlier, x * rng.lognormal(0, 0.7, (len(x), 1)), x * (1 + rng.pareto(1.5, (len(x), 1)))):
        i, j, _ = ann.search_block(queries, y[queries], rows, rows.astype(float), y, k=20)
        s = y[queries] @ y.T
        s[np.arange(len(queries)), queries] = -np.inf
        best = np.argsort(-s, axis=1)[:, :20]
        assert np.mean([len(set(best[q]) & set(j[i == q])) / 20 for q in range(len(queries))]) >= 0.95


def test_repeated_rows_are_candidates_of_each_other(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(docs, F.col("vec_id") % 20 == 0).collect())
    assert got == sorted([(20, 1, 20, 1.0), (20, 2, 5, 0.5), (20, 3, 5, 0.5)] * 2)


def test_only_some_rows_are_candidates():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((8000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    share = [len(rows) / len(x) for rows in ann.Tables(x).candidates(x[::200], 20)]
    assert 0.2 < np.mean(share) < 0.75
