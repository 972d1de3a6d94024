from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from curatrix.llm import repair as R

GRAMMAR = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, pos string, start int"


def faults(rows):
    """(role, text, fault) of one conversation's ordered rows."""
    seen, out = set(), []
    for role, text in rows:
        chars = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying every string of edits in order of cost, then of letters."""
    best = None
    n = len(rows)
    for inserts in range(n + 3):
        for letters in itertools.product("DIKR", repeat=n + inserts):
            if letters.count("I") != inserts:
                continue
            for lead in (True, False):
                got = applied(rows, letters, lead)
                if got and (best is None or (got[0], "".join(letters)) < best[:2]):
                    best = (got[0], "".join(letters), got[1])
    return best


def applied(rows, letters, lead):
    cost, out, left = 0, [], list(rows)
    for letter in letters:
        place = len(out) + (0 if lead else 1)
        role = "user" if place % 2 else "assistant"
        if letter == "I":
            cost += 3
            out.append((role, ""))
            continue
        own, text, fault = left.pop(0)
        if letter == "D":
            cost += 4
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += 3 * (fault == "truncated") + 3 * (letter == "R")
        out.append((own if letter == "K" else role, text))
    return (cost, out) if GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in out)) else None


def expected(table):
    out = []
    for conv in {r[0] for r in table}:
        own = sorted((r for r in table if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
        rows = faults([(" " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in own])
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit, repaired = cheapest(rows)
        count = [sum(f == k for *_, f in rows) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in repaired).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, illegal, cost, audit, sha))
    return sorted(out, key=str)


def found(spark, table):
    df = spark.createDataFrame([(*r, "p", 3) for r in table], SCHEMA).repartition(3)
    rows = R.report(df).collect()
    return sorted(((r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows), key=str)


def conversations(seed, count, longest):
    rng = random.Random(seed)
    table = []
    for conv in range(count):
        for turn in range(rng.randrange(1, longest + 1)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"])
            table.append((None if conv == 1 else conv, rng.choice([turn, turn, turn, 2 * turn, None]), role, rng.choice(["Hi.", "no end", "Why?", "", None, " \t", "Sure! ", f"t{turn}.", "x. "])))
    return table


@pytest.mark.parametrize("bits", [16, 1])
def test_equals_trying_every_string_of_edits(spark, monkeypatch, bits):
    """Segments of two rows give what whole conversations give."""
    monkeypatch.setattr(R, "SEGMENT_BITS", bits)
    table = conversations(3, 60, 4)
    assert found(spark, table) == expected(table)


def test_long_conversation_is_cut_in_segments(spark, monkeypatch):
    table = [(7, k, ["user", "assistant", "system"][k % 7 % 3], f"text {k % 50}" + "." * (k % 3)) for k in range(900)]
    whole = found(spark, table)
    monkeypatch.setattr(R, "SEGMENT_BITS", 3)
    assert found(spark, table) == whole
    codes = [r for *_, r in whole]
    assert len(codes) == 1 and whole[0][6] > 100 and len(whole[0][7]) >= 900


def test_walks_are_least_among_cheapest_for_every_short_row_of_codes():
    """Against the suffix strings of the SQL's rule, without Spark."""
    def solve(codes):
        best = {q: (R.END[q], "I" * (R.END[q] // 3)) for q in range(4)}
        for code in reversed(codes):
            over = {q: min((c + best[t][0], letter + best[t][1]) for letter, c, t in R.row_arcs(code, q)) for q in range(4)}
            one = {q: min(over[q], (3 + over[R.NEXT[q]][0], "I" + over[R.NEXT[q]][1])) for q in range(4)}
            best = {q: min(over[q], (3 + one[R.NEXT[q]][0], "I" + one[R.NEXT[q]][1])) for q in range(4)}
        return best[0]

    for n in range(4):
        for codes in itertools.product(range(16), repeat=n):
            codes = bytes(codes)
            start = [0, R.FAR, R.FAR, R.FAR]
            letters, _ = R.walk(codes, start, list(R.END), 0, True)
            assert (min(a + b for a, b in zip(R.after(start, R.segment_costs(codes)), R.END, strict=True)), letters) == solve(codes)


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, None if c == 3 else "assistant", None if t == 2 else "One. Two! Three?") for c in (0, 3, None) for t in (*range(12), None)]
    want = []
    for conv, turn, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            one = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            want += [one] * (2 if kind == 3 else 1)
    got = [tuple(r) for r in R.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) != len(rows)


def test_long_texts_empty_table_and_conversations_without_rows(spark, tmp_path):
    table = [(1, 0, "user", "x" * 400_000), (1, 1, "assistant", "y" * 400_000 + ".")]
    assert found(spark, table) == expected(table)
    assert found(spark, []) == []
    gone = next(t for t in range(10_000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    spark.createDataFrame([(5, gone, "user", "Hi."), (6, gone, "user", "Hi.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in R.op11_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {5, 6} and tuple(got[5])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
