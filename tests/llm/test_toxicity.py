from __future__ import annotations

import random

import numpy as np

from curatrix.llm import toxicity as T


def _corpus(n=900, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        t = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                t.insert(rng.randrange(len(t)), rng.choice(["vilest", "grotty", "scoundr" + rng.choice(words)]))
        docs.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = _corpus()
    rows = [*docs, (5000, ""), (5001, None), (None, "vilest grotty vilest"), (0, docs[0][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS terms")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None), (3, 0)], "doc_id long, toxic int")
    got = T.toxicity(d, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[5000].predicted == by[5001].predicted == 0 and by[None].predicted == 1 and by[None].neighbours[0].label == 1
    kept = T.reject(d, lab)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_reject_neither_joins_nor_shuffles_documents(spark):
    """Whatever the columns' names, a document goes through its scoring row."""
    d = spark.createDataFrame([(1, "a b", 5, "x y"), (None, None, 6, "z")], "doc_id long, text string, score int, `odd name` string")
    lab = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    kept = T.reject(d, lab)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert kept.dtypes == d.dtypes and sorted(map(str, kept.collect())) == sorted(map(str, d.collect()))


def test_no_labels_and_empty(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.toxicity(d, none).collect()] == [0.0]
    assert T.toxicity(d.limit(0), none).collect() == []


def test_block_max_is_exact():
    rng = np.random.default_rng(3)
    examples = [(i, int(rng.random() < 0.4), {int(t): int(rng.integers(1, 4)) for t in rng.choice(200, rng.integers(0, 30), replace=False)}) for i in range(400)]
    m = T.Model([str(i) for i in range(200)], rng.random(200) + 0.5, examples)
    held = {i: c for i, _, c in examples}
    v = np.zeros((len(m.ids), 200))
    for k, i in enumerate(m.ids):
        at, w = T.weigh(held[i], m.idf)
        v[k, at] = w
    for _ in range(100):
        at, w = T.weigh({int(t): 1 for t in rng.choice(200, 10, replace=False)}, m.idf)
        q = np.zeros(200)
        q[at] = w
        _, cos = m.index.nearest(at, w, 15)
        assert np.allclose(cos, np.sort(v @ q)[::-1][:15])


def test_scores_equal_dense_cosines_end_to_end(spark):
    """Votes over all examples by dense products, with the same terms and knots; ties and very long texts included."""
    docs, labels = _corpus(300, 9)
    docs += [(900, docs[0][1]), (901, docs[0][1]), (902, " ".join([docs[1][1]] * 400))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model, found = T.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in T.score(found, model).collect()}
    reader = T.Vectors(model.vocabulary)
    examples = np.zeros((len(model.ids), len(model.vocabulary)))
    texts = dict(docs)
    for k, i in enumerate(model.ids):
        at, w = T.weigh(reader.counts(texts[i]), model.idf)
        examples[k, at] = w
    for i, t in docs:
        counts = reader.counts(t)
        if not counts:
            assert got[i] == model.bare
            continue
        at, w = T.weigh(counts, model.idf)
        q = np.zeros(len(model.vocabulary))
        q[at] = w
        cos = examples @ q
        best = np.lexsort((np.arange(len(cos)), -np.round(cos, 12)))[: T.K]
        best = best[cos[best] > 0]
        want = float(np.interp(T.vote(cos[best], model.labels[best]), *model.knots))
        assert abs(got[i] - want) < 0.05 or abs(np.sort(cos)[::-1][T.K - 1] - np.sort(cos)[::-1][T.K]) < 1e-9
    assert got[900] == got[901] == got[docs[0][0]]
