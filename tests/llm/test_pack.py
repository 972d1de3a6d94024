from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

from curatrix.llm import pack as P


@pytest.fixture(scope="module")
def path():
    return P.tokenizer_path()


def test_chunk_encoder_equals_tokenizer(path):
    enc = P.ChunkEncoder(path)
    for t in ["", " ", "Hello, world. hello, it's DON'T", "Σίσυφος ΟΔΟΣ x", "a\x1cb\u0085c d", "<|endoftext|> 12.5 é", "x" * 5000, "ª º ¹²³ ½ µ ß É", "th, th. th,, .,"]:
        want = np.asarray(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert enc.ids(t) == want, t


def test_knapsack_is_exact():
    value = np.full(18, -np.inf)
    value[[3, 5, 7]] = 3.0, 5.5, 7.0
    best, piece = P.knapsack(value, 17)
    want = max(a * 3.0 + b * 5.5 + c * 7.0 for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 17)
    assert best[17] == pytest.approx(want)
    who, length, copies = P.configurations(np.asarray([3, 5, 7]), piece, 17)
    for k, n in enumerate((3, 5, 7)):
        mine = dict(zip(length[who == k].tolist(), copies[who == k].tolist(), strict=True))
        assert mine[n] >= 1 and sum(a * b for a, b in mine.items()) <= 17
        assert sum(value[a] * b for a, b in mine.items()) == pytest.approx(value[n] + best[17 - n])


def _all_configurations(lengths, capacity):
    def more(k, room):
        if k == len(lengths):
            yield ()
            return
        for c in range(room // lengths[k] + 1):
            for rest in more(k + 1, room - c * lengths[k]):
                yield (c, *rest)

    return np.asarray(list(more(0, capacity)))


@pytest.mark.parametrize("lengths,counts,capacity", [([7, 9, 11, 16, 20], [30, 17, 44, 25, 31], 40), ([34, 35, 51], [90, 60, 75], 100), ([3], [10], 10), ([1, 13, 27, 40], [5, 8, 9, 7], 40)])
def test_linear_program_is_optimal_within_its_gap(lengths, counts, capacity):
    """Certificates checked against every configuration: the plan covers, the prices are feasible, and both values meet."""
    lengths, counts = np.asarray(lengths), np.asarray(counts)
    plan, value, bound, dual = P.covering_lp(lengths, counts, capacity, rounds=60)
    assert (plan.covered(lengths.size) >= counts - 1e-6).all()
    assert (np.add.reduceat(lengths[plan.which] * plan.copies, plan.start[:-1]) <= capacity).all()
    assert plan.x.sum() == pytest.approx(value) and (_all_configurations(lengths.tolist(), capacity) @ dual).max() <= 1 + 1e-9
    assert bound == pytest.approx(counts @ dual) and bound <= value + 1e-9 and value <= 1.01 * bound
    chosen, figures = P.whole_plan(lengths, counts, capacity)
    held = np.zeros(lengths.size, np.int64)
    for ids, each, n in chosen:
        assert lengths[ids] @ each <= capacity
        np.add.at(held, ids, each * n)
    assert (held == counts).all() and figures["sequences"] <= np.ceil(bound) + 2


@pytest.mark.parametrize("kind", ["documents", "flat"])
def test_the_linear_plan_makes_the_result(kind):
    rng = np.random.default_rng(2)
    sizes = np.clip(rng.lognormal(6, 1.2, 20000).astype(int) + 1, 1, 4096) if kind == "documents" else rng.integers(1, 4096, 40000)
    lengths, counts = np.unique(sizes, return_counts=True)
    _, figures = P.whole_plan(lengths, counts, 4096)
    assert figures["linear"] >= 0.95 * figures["sequences"]
    assert figures["sequences"] <= 1.01 * figures["bound"] + 1


def test_slots_place_every_piece_once():
    rng = np.random.default_rng(5)
    lengths = np.unique(rng.integers(1, 400, 120))
    counts = rng.integers(1, 50, lengths.size)
    s = P.plan_slots(lengths, counts, 400)
    used = defaultdict(list)
    keys = s["length"] * 10**9 + s["first"]
    for n, c in zip(lengths, counts, strict=True):
        for rank in range(c):
            k = np.searchsorted(keys, n * 10**9 + rank, side="right") - 1
            r = rank - s["first"][k]
            used[int(s["base"][k] + r // s["each"][k])].append((int(s["offset"][k] + r % s["each"][k] * n), int(n)))
    for places in used.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= 400
    assert len(used) <= sum(n for *_, n in P.best_fit(lengths, counts, 400))


def test_linear_program_beats_best_fit_where_volume_misleads():
    lengths, counts = np.unique(np.random.default_rng(1).integers(1000, 2100, 20000), return_counts=True)
    s = P.plan_slots(lengths, counts, 4096)
    assert s["base"].max() + 1 < 0.96 * sum(n for *_, n in P.best_fit(lengths, counts, 4096))


def test_pack_small(spark, path):
    rows = [(1, "alpha beta gamma"), (2, None), (3, ""), (None, "one two"), (1, "alpha beta gamma"), (5, "word " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS sequence_id", "'x' AS piece")
    out = P.pack(P.pieces(docs, path, keep_ids=True)).collect()
    enc = P.ChunkEncoder(path)
    want = sorted((-1 if d is None else d, zlib.crc32(enc.ids(t or "") + b"\1\0\0\0")) for d, t in rows if d != 5)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in out if r.doc_id != 5) == want
    long = sorted((r for r in out if r.doc_id == 5), key=lambda r: r.piece)
    assert b"".join(bytes(r.ids) for r in long) == enc.ids("word " * 9000) + b"\1\0\0\0"
    assert [r.length for r in long[:-1]] == [4096] * (len(long) - 1) and [r.start for r in long] == [4096 * i for i in range(len(long))]
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= 4096


def test_pack_empty(spark, path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(P.pieces(docs, path)).collect() == []
