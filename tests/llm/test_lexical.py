from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from curatrix.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, top=L.TOP):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for place, (i, c) in enumerate(counted):
            length, score = sum(c.values()), 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + (25 * length * n) // total
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, (i is not None, i or 0), place, i))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def found(spark, tmp_path, docs, items, name="index", extra=False):
    d = spark.createDataFrame([(i, t, 7, 1.0) for i, t in docs], "id long, text string, term int, block double")
    q = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, score int")
    index = L.index(d.repartition(3), f"{tmp_path}/{name}")
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in L.search(index, q).collect()), key=str)


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    words = ["the", "of", "a1", "Éclair", "éclair", "ÉCLAIR", "naïve", "日本", "x", "R2", "snake"] + [f"w{k}" for k in range(60)]

    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", ", ", "-", "_", "\n", " ", "."]) for _ in range(n))

    docs = [(k, text(rng.randrange(0, 40))) for k in range(120)]
    docs += [(500, None), (501, ""), (502, " .,-"), (503, "the " * 30_000 + "w1"), (504, docs[5][1]), (None, docs[5][1]), (5, docs[5][1]), (5, docs[5][1])]
    docs += [(600 + k, "tie of the tie") for k in range(30)]
    items = [(k, text(rng.randrange(1, 15))) for k in range(12)] + [(50, None), (51, ""), (52, "unknownword"), (53, "tie TIE Tie"), (53, "tie TIE Tie"), (None, "w1 w2")]
    assert found(spark, tmp_path, docs, items) == brute(docs, items)


@pytest.mark.parametrize("size", [(100, 4096), (8 << 20, 3)])
def test_results_do_not_depend_on_blocks(spark, tmp_path, monkeypatch, size):
    """Frequent terms over many blocks; closures read the sizes when they run in this process, so blocks are cut here."""
    import pyarrow as pa

    monkeypatch.setattr(L, "BLOCK_BYTES", size[0])
    monkeypatch.setattr(L, "BLOCK_DOCS", size[1])
    texts = ["the cat", None, "the " * 60, "", "a dog and the cat"] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(25)), pa.array(texts)], names=["id", "text"])
    blocks = list(L._blocks(batch))
    assert len(blocks) > 1 and [i for ids, _ in blocks for i in ids.to_pylist()] == list(range(25))
    rows = [r for b, (ids, t) in enumerate(blocks) if (m := L._inverted(b, ids, t)) is not None for r in m.to_pylist()]
    own = {r["block"]: r for r in rows if r["term"] is None}
    held = sorted((own[r["block"]]["ids"][p >> 32], r["term"], p & 0xFFFFFFFF, own[r["block"]]["lens"][p >> 32]) for r in rows if r["term"] is not None for p in r["posts"])
    assert held == sorted((k, t, c, len(terms(x))) for k, x in enumerate(texts) for t, c in Counter(terms(x)).items())


def test_empty_tables(spark, tmp_path):
    assert found(spark, tmp_path, [], [(1, "x")], "a") == []
    assert found(spark, tmp_path, [(1, "x")], [], "b") == []
    assert found(spark, tmp_path, [(1, None)], [(1, None)], "c") == []
    one = found(spark, tmp_path, [(1, "x")], [(1, "x")], "d")
    assert one == brute([(1, "x")], [(1, "x")])
