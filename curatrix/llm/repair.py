"""Repair of conversations at the least cost: a bidirectional DAG of tight arcs over rows and states.

The roles of a repaired conversation are an optional system turn and then pairs
of user and assistant turns, or nothing.  A node is a place between rows and a
state of that grammar; arcs keep (K), relabel (R) or delete (D) the next row or
insert (I) an empty one.  Forward and backward least costs mark the arcs that lie
on some cheapest path; from the set of states reached, the least letter with such
an arc is taken at each step, which gives the least audit string of all cheapest
ones.

Rows are sorted by conversation and turn with a range partitioning, so a
conversation of any length is spread over tasks.  Segments of at most
``SEGMENT`` rows, a byte a row, are reduced to the costs from each state to each
state; a fold over the segments of a conversation gives the costs at their ends,
each segment is then walked from every state that a cheapest path may enter it
by, and a second fold picks the walks.  Folds stream over segments in order and
hold one.  Only the digest of a repaired conversation reads its texts in one
task, as SHA-256 has to, row after row.

Defined cases: a null role or text is one space; nulls of turn come first, rows of
one turn are ordered by role and text; a null conversation id is a conversation;
texts of any length (they are never in memory together); a repeated row is a
duplicate; a role counts by its first character, an empty or other one can only
be relabelled or deleted; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import stored

#: Rows of a segment, as a power of two.
SEGMENT_BITS = 16
BLANKS = " \t\n\x0b\x0c\r"
#: What a row and an edit cost.
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 60
INITIALS, FAULTS = "sua", ("", "truncated", "blank", "duplicate")
LEGAL = {"su", "ua", "au"}
#: Rows that are handed on at once.
ROWS = 512
# states: nothing yet, system, user, assistant
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
END = (0, 6, 3, 0)


def kept_state(state: int, initial: str) -> int | None:
    """The state after a kept row, None if the grammar forbids it."""
    if state == 0 and initial == "s":
        return 1
    return NEXT[state] if initial == ROLE[state][0] else None


@lru_cache(None)
def row_arcs(code: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, state after) of the arcs over a row, in ASCII order."""
    initial, fault = "sua-"[code // 4], FAULTS[code % 4]
    arcs = [("D", DELETE, state)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED * (fault == "truncated")
        if (to := kept_state(state, initial)) is not None:
            arcs.append(("K", more, to))
        arcs.append(("R", RELABEL + more, NEXT[state]))
    return tuple(arcs)


#: Least cost of inserts from state to state.
INSERTS = tuple(tuple(min((INSERT * k for k, p in enumerate((q, NEXT[q], NEXT[NEXT[q]])) if p == r), default=FAR) for r in range(4)) for q in range(4))


@lru_cache(None)
def row_costs(code: int) -> tuple[tuple[int, ...], ...]:
    """Least cost from each state before a row, inserts included, to each state after it."""
    arc = [[min((c for _, c, to in row_arcs(code, q) if to == r), default=FAR) for r in range(4)] for q in range(4)]
    return tuple(tuple(min(min(INSERTS[q][p] + arc[p][r] for p in range(4)), FAR) for r in range(4)) for q in range(4))


def after(costs: list[int], matrix: list[list[int]]) -> list[int]:
    return [min(min(costs[q] + matrix[q][r] for q in range(4)), FAR) for r in range(4)]


def before(costs: list[int], matrix: list[list[int]]) -> list[int]:
    return [min(min(matrix[q][r] + costs[r] for r in range(4)), FAR) for q in range(4)]


def segment_costs(codes: bytes) -> list[list[int]]:
    rows = [[0 if q == r else FAR for r in range(4)] for q in range(4)]
    for code in codes:
        rows = [after(r, row_costs(code)) for r in rows]
    return rows


def walk(codes: bytes, forward: list[int], backward: list[int], entry: int, last: bool) -> tuple[str, int]:
    """The letters of the least audit through a segment entered by ``entry``, and the state it leaves by.

    ``forward`` are the least costs at its begin, ``backward`` those from its end
    on; inserts at a place belong to the row after it, or to the last segment.
    """
    back = [backward]
    for code in reversed(codes):
        back.append(before(back[-1], row_costs(code)))
    back.reverse()
    fore, total = forward, min(f + b for f, b in zip(forward, back[0], strict=True))
    frontier, out = {entry}, []
    for k, code in enumerate(codes):
        reach = after(fore, INSERTS)
        while True:
            found: dict[str, set[int]] = {}
            for q in frontier:
                for letter, cost, to in row_arcs(code, q):
                    if reach[q] + cost + back[k + 1][to] == total:
                        found.setdefault(letter, set()).add(to)
                if reach[q] + INSERT + back[k][NEXT[q]] == total:
                    found.setdefault("I", set()).add(NEXT[q])
            letter = min(found)
            frontier = found[letter]
            out.append(letter)
            if letter != "I":
                break
        fore = after(fore, row_costs(code))
    while last and not any(END[q] == 0 for q in frontier):
        frontier = {NEXT[q] for q in frontier if after(fore, INSERTS)[q] + END[q] == total}
        out.append("I")
    return "".join(out), min(frontier)


def _mapped(df: DataFrame, schema: str, rows: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """What ``rows`` makes of the rows of each partition, in their order."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = rows(r for b in batches for r in b.to_pylist())
        while part := list(islice(made, ROWS)):
            yield pa.RecordBatch.from_pylist(part, kinds)

    return df.mapInArrow(run, schema)


def damage(rows: DataFrame) -> DataFrame:
    """The contract's faults, put into (conv_id, turn, role, text) by a checksum of conversation and turn."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    got = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.pmod(F.crc32(key), F.lit(20)).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return got.where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """The rows with ``pos``, which numbers them by conversation, turn, role and text; stored.

    Rows of one turn that begin with the same characters stay in one partition; all others are dealt by range.
    """
    kept = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    begin = F.substring(F.concat("role", F.lit("\0"), "text"), 1, 64)
    placed = kept.repartitionByRange("conv_id", "turn", begin).sortWithinPartitions("conv_id", "turn", "role", "text")
    return stored(placed.withColumn("pos", F.monotonically_increasing_id()), "repair-rows")


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, start, codes: the segments of ordered rows, a byte (initial * 4 + fault) for each row."""
    end = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    key = F.sha2(F.encode(F.concat(F.length("role"), F.lit(":"), "role", "text"), "UTF-8"), 256)
    facts = rows.select("conv_id", "pos", F.substring("role", 1, 1).alias("initial"), end.alias("end"), F.when(end != "", F.unhex(key)).alias("key"))
    facts = stored(facts, "repair-facts")
    again = facts.where("key is not null").groupBy("conv_id", "key").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("_conv"), F.col("key").alias("_key"), "first")
    seen = facts.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")), "left")
    fault = F.when(F.col("end") == "", 2).when(F.col("pos") > F.col("first"), 3).when(~F.col("end").isin(".", "!", "?"), 1).otherwise(0)
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    rows = seen.select("conv_id", "pos", F.struct("pos", (initial * 4 + fault).alias("code")).alias("at"))
    listed = rows.groupBy("conv_id", F.shiftright("pos", SEGMENT_BITS).alias("chunk")).agg(F.min("pos").alias("start"), F.sort_array(F.collect_list("at")).alias("rows"))
    return listed.select("conv_id", "start", F.unhex(F.array_join(F.transform("rows", lambda r: F.lpad(F.hex(r["code"]), 2, "0")), "")).alias("codes"))


def _in_order(segments: DataFrame, schema: str, rows: Callable[[Iterator[dict]], Iterator[dict]], *, ascending: bool = True) -> DataFrame:
    order = F.col("start").asc() if ascending else F.col("start").desc()
    return _mapped(segments.repartition("conv_id").sortWithinPartitions("conv_id", order), schema, rows)


def _costed(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        counts = {f: sum(c % 4 == k for c in r["codes"]) for k, f in enumerate(FAULTS) if f}
        yield r | counts | {"costs": [c for row in segment_costs(r["codes"]) for c in row]}


def _square(flat: list[int]) -> list[list[int]]:
    return [flat[k : k + 4] for k in range(0, 16, 4)]


def _forward(rows: Iterator[dict]) -> Iterator[dict]:
    """The least costs up to each segment, and its pairs of roles that can't follow one another."""
    for _, own in groupby(rows, key=lambda r: r["conv_id"]):
        costs, last = [0, FAR, FAR, FAR], None
        for r in own:
            codes = r["codes"] if last is None else bytes([last]) + r["codes"]
            illegal = sum("sua-"[a // 4] + "sua-"[b // 4] not in LEGAL for a, b in zip(codes, codes[1:], strict=False))
            yield r | {"forward": costs, "illegal": illegal}
            costs, last = after(costs, _square(r["costs"])), codes[-1]


def _backward(rows: Iterator[dict]) -> Iterator[dict]:
    for _, own in groupby(rows, key=lambda r: r["conv_id"]):
        costs, last = list(END), True
        for r in own:
            yield r | {"backward": costs, "last": last}
            costs, last = before(costs, _square(r["costs"])), False


def _walked(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        begin = before(r["backward"], _square(r["costs"]))
        total = min(f + b for f, b in zip(r["forward"], begin, strict=True))
        walks = [walk(r["codes"], r["forward"], r["backward"], q, r["last"]) if f + b == total else None for q, (f, b) in enumerate(zip(r["forward"], begin, strict=True))]
        yield r | {"cost": total, "walks": [w and w[0] for w in walks], "exits": [w and w[1] for w in walks]}


def _chosen(rows: Iterator[dict]) -> Iterator[dict]:
    for _, own in groupby(rows, key=lambda r: r["conv_id"]):
        state = 0
        for r in own:
            yield r | {"letters": r["walks"][state]}
            state = r["exits"][state]


def edits(segments: DataFrame) -> DataFrame:
    """Segments (conv_id, start, codes) with blank, duplicate, truncated, illegal, cost of the conversation and letters, their part of the audit; stored."""
    schema = "conv_id long, start long, codes binary, truncated long, blank long, duplicate long, costs array<long>"
    costed = _mapped(segments, schema, _costed)
    schema += ", forward array<long>, illegal long"
    forward = _in_order(costed, schema, _forward)
    schema += ", backward array<long>, last boolean"
    backward = _in_order(forward, schema, _backward, ascending=False)
    counts = "conv_id long, start long, truncated long, blank long, duplicate long, illegal long, cost long"
    walked = _mapped(backward, f"{counts}, walks array<string>, exits array<int>", _walked)
    return stored(_in_order(walked, f"{counts}, letters string", _chosen), "repair-edits")


def _repaired(rows: Iterator[dict]) -> Iterator[dict]:
    for conv, own in groupby(rows, key=lambda r: r["conv_id"]):
        state, n, at, whole = 0, 0, 0, ""

        def line(role: str, text: str, conv=conv) -> dict:
            nonlocal n
            n += 1
            return {"conv_id": conv, "n": n, "role": role, "text": text}

        for r in own:
            if r["letters"] is not None:  # a segment, before its rows
                at, whole = 0, r["letters"]
                continue
            while whole[at] == "I":
                yield line(ROLE[state], "")
                state, at = NEXT[state], at + 1
            if whole[at] == "K":
                yield line(r["role"], r["text"])
                state = kept_state(state, r["role"][:1])
            elif whole[at] == "R":
                yield line(ROLE[state], r["text"])
                state = NEXT[state]
            at += 1
        for _ in whole[at:]:
            yield line(ROLE[state], "")
            state = NEXT[state]


def repaired(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """The repaired conversations of ordered rows: conv_id, n (from 1), role, text; each conversation in order in one partition."""
    parts = edited.select("conv_id", F.col("start").alias("pos"), F.lit(0).alias("kind"), F.lit("").alias("role"), F.lit("").alias("text"), "letters")
    both = parts.unionByName(rows.select("conv_id", "pos", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("string").alias("letters")))
    return _mapped(both.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind"), "conv_id long, n long, role string, text string", _repaired)


def _hashed(rows: Iterator[dict]) -> Iterator[dict]:
    for conv, own in groupby(rows, key=lambda r: r["conv_id"]):
        found = hashlib.sha256()
        for r in own:
            found.update(("\n" if r["n"] > 1 else "").encode() + f"{r['role']}:{r['text']}".encode())
        yield {"conv_id": conv, "repaired_sha256": found.hexdigest()}


def report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of (conv_id, turn, role, text)."""
    placed = ordered(rows)
    edited = edits(coded(placed))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "letters"))), lambda s: s["letters"]), "")
    found = edited.groupBy("conv_id").agg(*sums, F.min("cost").alias("cost"), audit.alias("audit"))
    turns = placed.where("turn is not null").groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    hashes = _mapped(repaired(placed, edited), "conv_id long, repaired_sha256 string", _hashed)
    for other in (turns, hashes):
        other = other.withColumnRenamed("conv_id", "_conv")
        found = found.join(other, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return found.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (("gaps", 0), ("repaired_sha256", hashlib.sha256().hexdigest()))})


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    found = report(damage(rows)).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    nothing = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return every.select("conv_id", *[F.coalesce(c, F.lit(v)).cast("string" if isinstance(v, str) else "long").alias(c) for c, v in nothing.items()])


def _sql() -> str:
    """The same rows by suffix strings: for each state the least 'cost in nine digits, then letters' from a row on."""
    blanks = r"\x20\x09-\x0D"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(key, ''), lambda c: ord(c)::UBIGINT)), "
        "lambda h, b: list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT)))), 4294967295::UBIGINT)"
    )

    def add(cost: str, letter: str, then: str) -> str:
        return f"printf('%09d', {cost} + {then}[1:9]::INT) || '{letter}' || {then}[10:]"

    def over_row(q: int) -> str:
        """The least way on from state q (list position q + 1) that begins with an edit of the row r = [initial, fault]."""
        more = "(CASE WHEN r[2] = 'truncated' THEN 3 ELSE 0 END)"
        here, then = f"s[{q + 1}]", f"s[{NEXT[q] + 1}]"
        keep = f"CASE WHEN r[1] = '{ROLE[q][0]}' THEN {add(more, 'K', then)}" + (f" WHEN r[1] = 's' THEN {add(more, 'K', 's[2]')}" if q == 0 else "") + " ELSE '~' END"
        return f"least({add('4', 'D', here)}, CASE WHEN r[2] IN ('blank', 'duplicate') THEN '~' ELSE least({keep}, {add(f'3 + {more}', 'R', then)}) END)"

    base = ", ".join(over_row(q) for q in range(4))
    insert = "list_transform([1, 2, 3, 4], lambda q: least(b[q], " + add("3", "I", "g[[3, 3, 4, 3][q]]") + "))"
    step = f"list_transform([[{base}]], lambda b: list_reduce([b, b, b], lambda g, z: {insert}))[1]"
    return f"""
WITH keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT *, {crc} % 20 AS kind FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
faulty AS (SELECT conv_id, turn, role, text, i, role[1:1] AS initial, CASE WHEN NOT regexp_matches(text, '[^{blanks}]') THEN 'blank'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][{blanks}]*$') THEN 'truncated' ELSE '' END AS fault,
  lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM placed),
solved AS (SELECT conv_id, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  list_reduce(list([initial, fault] ORDER BY i DESC), lambda s, r: {step}, ['000000000', '000000006II', '000000003I', '000000000'])[1] AS found FROM faulty GROUP BY conv_id),
letters AS (SELECT conv_id, generate_subscripts(string_split(found[10:], ''), 1) AS k, unnest(string_split(found[10:], '')) AS letter FROM solved WHERE length(found) > 9),
counted AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
lines AS (SELECT c.conv_id, k, place, letter, role, text,
  bool_or(letter = 'K' AND place = 1 AND initial = 's') OVER (PARTITION BY c.conv_id) AS led
  FROM counted c LEFT JOIN faulty f ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.i = f.i WHERE letter <> 'D'),
hashes AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place % 2 = 1) = led THEN 'assistant' ELSE 'user' END
  || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(found[1:9], '0')::BIGINT AS cost, coalesce(found[10:], '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN solved s ON o.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN hashes h ON o.conv_id IS NOT DISTINCT FROM h.conv_id
"""


OP11_SQL = _sql()
