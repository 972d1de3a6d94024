from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from curatrix.llm import decontaminate as D


def _brute(text, items, size=10):
    words = D.words_of(text)
    hit, found = set(), set()
    for item_id, t in items:
        w = D.words_of(t)
        n = min(size, len(w))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == w[i : i + n]:
                    hit.update(range(k, k + n))
                    if item_id is not None:
                        found.add(str(item_id))
    return len(words), len(hit), sorted(found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("a b c A é - aa".split()), max_size=40), st.lists(st.lists(st.sampled_from("a b c é aa".split()), max_size=14), max_size=4))
def test_scan_equals_brute_force(doc, items):
    rows = [(str(i), " ".join(t)) for i, t in enumerate(items)]
    words = D.words_of(" ".join(doc))
    merged, ids = D.Index(rows, 10).scan(words)
    assert (len(words), sum(b - a + 1 for a, b in merged), sorted(ids)) == _brute(" ".join(doc), rows)


def test_spark_with_shards_and_offsets(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25)))) for i in range(30)] + [(None, "unique words here"), (31, None), (32, "!!"), (3, "second text of three")]
    docs = []
    for i in range(60):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        if i % 3 == 0:
            t[5:5] = rng.choice(items[:30])[1].upper().split()
        docs.append((i, ", ".join(t)))
    docs += [(100, None), (101, ""), (102, "Ünïque -- unique WORDS: here!"), (0, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_hit", "2 AS spans")
    b = spark.createDataFrame(items, "item_id long, text string")
    for max_chars in (50, 10**6):
        for r in D.decontaminate(d, b, max_chars=max_chars).collect():
            want = _brute(r.text, items)
            assert (r.n_words, r.n_hit, r.item_ids) == want
            assert r.n_items == len(want[2]) and sum(s.last_word - s.first_word + 1 for s in r.spans) == want[1]
            for s in r.spans:
                assert len(D.words_of(r.text.encode()[s.byte_start : s.byte_end].decode())) == s.last_word - s.first_word + 1
    assert D.decontaminate(d.limit(0), b).collect() == []
    assert {r.n_hit for r in D.decontaminate(d, b.limit(0)).collect()} == {0}
