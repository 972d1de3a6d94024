"""Best-fit packing by the configuration linear program.

Documents become token ids plus one end id; longer ones are cut into pieces of
``capacity`` tokens.  The length histogram (at most ``capacity`` entries, a size
bound independent of the corpus) is counted by Spark and solved on the driver:

1. The configuration LP (fewest sequences covering the histogram) is solved by
   multiplicative weights with prices for all lengths and a knapsack dynamic
   program that prices configurations; its prices also give a proven lower
   bound (see ``covering_lp``).
2. The fractional plan is rounded: whole copies first, then one more of what
   has the largest fraction, as long as a configuration is worth (nearly) a
   sequence at the bound's prices.  The program is solved again for what is
   left, with growing slack.
3. Best fit decreasing places the few pieces that rounding leaves.

A configuration with its number of copies is one row of a slot table, so the
plan's size follows the histogram too.  Pieces get their rank within their
length without any task seeing a whole length: counts per (length, salt), a
prefix sum over those counts, and a rank within (length, salt).  The rank picks
configuration copy and place by one search in the broadcast slot table.

Defined cases: null or empty text is the single end id; documents with equal or
null doc_id are packed as separate documents; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CAPACITY = 4096
END_ID = 1
#: Gap between the plan and its proven bound at which the linear program ends; most rounds for all pieces and for what
#: rounding left, (few lengths, many lengths): a round's work grows with the lengths.
GAP, ROUNDS, ROUNDS_LEFT, FEW = 0.002, (60, 24), (20, 8), 500
#: Softness of the weights at first, its factor a round, its least value; steps a round.
SOFTEST, SOFTER, HARDEST, STEPS = 0.05, 0.6, 0.001, 30
#: How near to their demand all but the outer lengths must be covered before the weights harden.
SETTLED = 0.35
#: What a configuration that rounding takes may lack in worth, at first and at last.
SLACK, SLACKEST = 0.001, 0.1
#: Part of what is left that solving again must settle; otherwise the slack grows.
SETTLES = 0.05
SEED = 6
#: Pieces for each salt, of all lengths.
SALT_ROWS = 500_000
#: Chunks remembered by a Python worker in each of two generations.
CACHE = 350_000
#: Unseen chunks encoded in one call.
PART = 64
#: Characters for which lower-casing, NFC and white space agree in both libraries.
_PLAIN = re.compile(r"[\t\n\r -~¡-¬®-ÿ]*")


class ChunkEncoder:
    """Token ids of whole texts, encoding each blank-separated chunk once.

    The tokenizer's splits never cross white space, so a text's ids are its
    chunks' ids in order.  Texts with characters outside a plain Latin range go
    to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: For chunks of letters only, lower-cased already: the same model without the general splitter.
        self.words = Tokenizer.from_file(path)
        self.words.encode_special_tokens = True
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, chunks: set[str]) -> None:
        """Ids of unseen chunks; a word with one mark behind it is looked up as word and mark."""
        new, marked, words = self.new, [], []
        for c in chunks:
            if c[-1] in ",." and c[:-1].isalpha():
                marked.append(c)
                if c[:-1] not in new:
                    words.append(c[:-1])
            else:
                words.append(c)
        self._encode(list(dict.fromkeys(words)))
        for c in marked:
            if c[-1] not in new:
                self._encode([c[-1]])
            new[c] = new[c[:-1]] + new[c[-1]]

    def _encode(self, chunks: list[str]) -> None:
        for words, tokenizer in (([c for c in chunks if c.isalpha()], self.words), ([c for c in chunks if not c.isalpha()], self.tokenizer)):
            for i in range(0, len(words), PART):
                part = words[i : i + PART]
                enc = tokenizer.encode(" ".join(part), add_special_tokens=False)
                ids = np.asarray(enc.ids, "<u4").tobytes()
                starts = np.cumsum([0, *[len(c) + 1 for c in part]])
                cuts = (4 * np.searchsorted(np.asarray([o[0] for o in enc.offsets], np.int64), starts)).tolist()
                for c, a, b in zip(part, cuts[:-1], cuts[1:], strict=True):
                    self.new[c] = ids[a:b]

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, without the end id."""
        if not text:
            return b""
        if not _PLAIN.fullmatch(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks = text.lower().split()
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = set(chunks).difference(new)
        if missing:
            unseen = set()
            for c in missing:
                if c in old:
                    new[c] = old[c]
                else:
                    unseen.add(c)
            self._learn(unseen)
        return b"".join(map(new.__getitem__, chunks))


_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, if kept)."""
    end = int(END_ID).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, value in enumerate(batch.column(1)):
                data = encoder.ids(value.as_py() or "") + end
                for p, i in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[i : i + 4 * capacity]
                    at.append(k)
                    piece.append(p)
                    start.append(i // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(part)
            cols = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary())] if keep_ids else cols, names=[*names, "ids"] if keep_ids else names)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Dynamic program over capacity: the most value of pieces of at most c tokens in all, and the piece that completes it.

    ``value[n]`` is the price of a piece of n tokens, -inf where there is none.
    Of equal values the longest piece is taken; a piece of 0 leaves one token empty.
    """
    best, piece = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        total = value[c:0:-1] + best[:c]  # a piece of c, c - 1, ... 1 tokens over what fits before it
        k = int(total.argmax())
        best[c] = best[c - 1]
        if total[k] > best[c]:
            best[c], piece[c] = total[k], c - k
    return best, piece


def configurations(first: np.ndarray, piece: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each first length the best configuration that holds it, as rows (which, length, copies) sorted by which."""
    ends = np.maximum.accumulate(np.where(piece > 0, np.arange(capacity + 1), 0))
    who, at = np.arange(first.size), ends[capacity - first]
    owners, lengths = [who], [first]
    while (at > 0).any():
        who, at = who[at > 0], at[at > 0]
        owners.append(who)
        lengths.append(piece[at])
        at = ends[at - piece[at]]
    key, copies = np.unique(np.concatenate(owners) * (capacity + 1) + np.concatenate(lengths), return_counts=True)
    return key // (capacity + 1), key % (capacity + 1), copies


class Plan:
    """Configurations in sparse form with a number of sequences each: ``start[i]:start[i + 1]`` are the rows (which length, copies) of the i-th."""

    def __init__(self, start: np.ndarray, which: np.ndarray, copies: np.ndarray, x: np.ndarray):
        self.start, self.which, self.copies, self.x = start, which, copies, x

    def covered(self, n: int) -> np.ndarray:
        return np.bincount(self.which, self.copies * np.repeat(self.x, np.diff(self.start)), minlength=n)

    @staticmethod
    def merged(parts: list[Plan], n: int) -> Plan:
        """Equal configurations (by two sums of random numbers of their rows) become one."""
        sizes = np.concatenate([np.diff(p.start) for p in parts])
        which, copies, x = (np.concatenate([getattr(p, f) for p in parts]) for f in ("which", "copies", "x"))
        start = np.concatenate([[0], np.cumsum(sizes)])
        marks = np.random.default_rng(SEED).integers(1, 2**62, (2, n), np.int64)[:, which] * copies
        names = np.add.reduceat(marks, start[:-1], axis=1).T
        _, first, group = np.unique(names, axis=0, return_index=True, return_inverse=True)
        rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in first])
        return Plan(np.concatenate([[0], np.cumsum(sizes[first])]), which[rows], copies[rows], np.bincount(group.ravel(), x))


def covering_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, *, gap: float = GAP, rounds: int = ROUNDS[0]) -> tuple[Plan, float, float, np.ndarray]:
    """The configuration LP, min sum x with every length covered: (plan, its value, a lower bound of the optimum, the bound's prices).

    Multiplicative weights: every length has a price, at first its share of a
    sequence, and a configuration worth w at these prices has weight
    exp((w - 1) / e).  A step moves the prices of all lengths by the logarithm of
    demand over cover, so weights change by factors, and e falls from round to
    round.  Each round the knapsack program prices configurations, exactly and
    at slightly shaken prices, and the best one with each length joins the pool.
    Prices over the best exact value are feasible for the dual, so demand times
    prices bounds the optimum from below; the weights, scaled so that the
    demand is covered (single-length sequences cover what lags), are a plan.
    Rounds end when plan and bound differ by no more than ``gap``.
    """
    n, demand, rng = lengths.size, counts.astype(np.float64), np.random.default_rng(SEED)
    price, bound, dual = lengths / capacity, 0.0, np.zeros(n)
    alone = capacity // lengths
    place = np.full(capacity + 1, -1, np.int64)
    place[lengths] = np.arange(n)
    singles = Plan(np.arange(n + 1), np.arange(n), alone, np.ones(n))
    held_over = [singles]
    best_plan: tuple[float, Plan] = (float((demand / alone).sum()), Plan(np.arange(n + 1), np.arange(n), alone, demand / alone))
    soft = SOFTEST
    for _ in range(rounds):
        fresh = []
        for shaken in (0.0, soft):
            value = np.full(capacity + 1, -np.inf)
            value[lengths] = price * (1 + shaken * rng.standard_normal(n))
            best, piece = knapsack(value, capacity)
            if not shaken:
                if (low := float(demand @ price / best[capacity])) > bound:
                    bound, dual = low, price / best[capacity]
            who, length, copies = configurations(lengths, piece, capacity)
            fresh.append(Plan(np.searchsorted(who, np.arange(n + 1)), place[length], copies, np.ones(n)))
        pool = Plan.merged([singles, *held_over, *fresh], n)
        sizes = np.diff(pool.start)
        row_of, pieces = np.repeat(np.arange(sizes.size), sizes), np.add.reduceat(pool.copies, pool.start[:-1])
        order = np.argsort(pool.which, kind="stable")
        held, firsts = np.unique(pool.which[order], return_index=True)
        by_length = held, order, firsts
        for _ in range(STEPS):
            worth = np.add.reduceat(price[pool.which] * pool.copies, pool.start[:-1])
            x = np.exp(np.clip((worth - 1) / soft, -50, 50))
            used = pool.copies * x[row_of]
            cover = np.bincount(pool.which, used, minlength=n)
            around = np.bincount(pool.which, used * pieces[row_of], minlength=n)
            ratio = np.clip(cover / demand, 1e-9, 1e9)
            step = -soft * np.log(ratio) * np.maximum(cover, 1e-300) / np.maximum(around, 1e-300)
            step = np.where(around > 0, step, soft)
            change = np.abs(np.add.reduceat(step[pool.which] * pool.copies, pool.start[:-1])) / soft
            fast = np.ones(n)
            fast[by_length[0]] = np.maximum.reduceat(np.where(worth > 1 - 15 * soft, np.maximum(change / 2, 1.0), 1.0)[row_of][by_length[1]], by_length[2])
            price = price + step / fast
        scale = np.quantile(cover / demand, [0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5])
        for s in scale[scale > 1e-3]:
            lag = np.maximum(0, demand - cover / s)
            full = float(x.sum() / s + (lag / alone).sum())
            if full < best_plan[0]:
                kept = x > 1e-9 * x.max()
                rows = kept[row_of]
                more = np.flatnonzero(lag > 1e-9 * demand)
                mine = Plan(np.concatenate([[0], np.cumsum(sizes[kept])]), pool.which[rows], pool.copies[rows], x[kept] / s)
                best_plan = (full, Plan.merged([mine, Plan(np.arange(more.size + 1), more, alone[more], lag[more] / alone[more])], n) if more.size else mine)
        if best_plan[0] <= bound * (1 + gap):
            break
        if (np.abs(np.quantile(cover / demand, [0.05, 0.95]) - 1) < SETTLED).all():
            soft = max(soft * SOFTER, HARDEST)
        kept = worth > 1 - 8 * soft
        rows = kept[row_of]
        held_over = [Plan(np.concatenate([[0], np.cumsum(sizes[kept])]), pool.which[rows], pool.copies[rows], x[kept])]
    return best_plan[1], best_plan[0], bound, dual


def rounded(plan: Plan, left: np.ndarray, dual: np.ndarray, lengths: np.ndarray, capacity: int, slack: float) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Whole copies of the plan's configurations, taken from ``left`` (lowered in place): the whole parts, then one more by largest fraction.

    A configuration of which pieces are missing is mended with the longest ones
    there are.  Only those worth 1 - ``slack`` at the bound's prices are taken; by
    complementary slackness an optimal plan has no others.
    """
    out: dict[tuple[bytes, bytes], list] = {}
    there = np.flatnonzero(left).tolist()  # ascending lengths with pieces left, cleaned now and then
    sizes = lengths[there].tolist()
    whole = np.floor(plan.x + 1e-9).astype(np.int64)
    worth = np.add.reduceat(dual[plan.which] * plan.copies, plan.start[:-1])
    good = np.flatnonzero(worth >= 1 - slack)
    turns = [(i, int(whole[i])) for i in good[whole[good] > 0]] + [(i, 1) for i in good[np.argsort((whole - plan.x)[good], kind="stable")]]
    for turn, (i, wanted) in enumerate(turns):
        rows = slice(plan.start[i], plan.start[i + 1])
        ids, each = plan.which[rows], plan.copies[rows]
        n = min(wanted, int((left[ids] // each).min()))
        if n == 0:
            content = {k: c for k, c in zip(ids.tolist(), np.minimum(each, left[ids]).tolist(), strict=True) if c}
            gap = capacity - sum(int(lengths[k]) * c for k, c in content.items())
            at, value = bisect_right(sizes, gap) - 1, sum(float(dual[k]) * c for k, c in content.items())
            while gap and at >= 0:
                k = there[at]
                c = min(int(left[k]) - content.get(k, 0), gap // sizes[at])
                if c > 0:
                    content[k] = content.get(k, 0) + c
                    gap -= c * sizes[at]
                    value += c * float(dual[k])
                at = min(at - 1, bisect_right(sizes, gap) - 1)
            if value < 1 - slack:
                continue
            ids, each, n = np.fromiter(content.keys(), np.int64, len(content)), np.fromiter(content.values(), np.int64, len(content)), 1
        left[ids] -= n * each
        out.setdefault((ids.tobytes(), each.tobytes()), [ids, each, 0])[2] += n
        if turn % 256 == 255:
            there = [k for k in there if left[k]]
            sizes = lengths[there].tolist()
    return [(ids, each, n) for ids, each, n in out.values()]


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int, begun: list[tuple[np.ndarray, np.ndarray, int]] = ()) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Best fit decreasing on a histogram, into the gaps of ``begun`` sequences first: (which lengths, copies, sequences).

    Equal sequences are one entry with a number, so the work follows the number
    of distinct lengths and fills.
    """
    by_gap: dict[int, list[tuple[dict[int, int], int]]] = {}
    gaps: list[int] = []

    def add(gap: int, content: dict[int, int], bins: int) -> None:
        if gap not in by_gap:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append((content, bins))

    for ids, each, bins in begun:
        add(capacity - int(lengths[ids] @ each), dict(zip(ids.tolist(), each.tolist(), strict=True)), bins)
    for k in np.argsort(-lengths, kind="stable").tolist():
        size, left = int(lengths[k]), int(counts[k])
        while left:
            i = bisect_left(gaps, size)
            if i == len(gaps):
                gap, content, there = capacity, {}, left // min(capacity // size, left)
            else:
                gap = gaps[i]
                content, there = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap]
                    gaps.pop(i)
            each = min(gap // size, left)
            bins = min(there, left // each)
            if bins < there:
                add(gap, content, there - bins)
            add(gap - each * size, content | {k: content.get(k, 0) + each}, bins)
            left -= each * bins
    return [(np.fromiter(c.keys(), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c)), bins) for groups in by_gap.values() for c, bins in groups]


def whole_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], dict[str, float]]:
    """Configurations in whole numbers for the histogram, and figures: value and bound of the linear program, sequences from it and in all.

    The linear program is solved and rounded, then solved again for what is
    left; when that settles too little of it, with more slack.  Best fit places
    the rest, in the gaps of the sequences begun first.
    """
    slack = SLACK
    left, chosen, figures = counts.astype(np.int64).copy(), [], {"value": 0.0, "bound": 0.0}
    while (open_ := np.flatnonzero(left)).size:
        before = int(left[open_] @ lengths[open_])
        rounds = (ROUNDS_LEFT if chosen else ROUNDS)[open_.size > FEW]
        plan, value, bound, dual = covering_lp(lengths[open_], left[open_], capacity, rounds=rounds)
        if not chosen:
            figures = {"value": value, "bound": bound}
        part = left[open_]
        chosen += [(open_[ids], each, n) for ids, each, n in rounded(plan, part, dual, lengths[open_], capacity, slack)]
        left[open_] = part
        if int(left @ lengths) > (1 - SETTLES) * before:
            slack *= 4
            if slack > SLACKEST:
                break
    figures["linear"] = float(sum(n for _, _, n in chosen))
    chosen = best_fit(lengths, left, capacity, chosen)
    return chosen, figures | {"sequences": float(sum(n for _, _, n in chosen))}


def plan_slots(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Slot table sorted by (length, first rank): length, first, base, each, offset."""
    rows: list[tuple[int, int, int, int, int]] = []
    ranks = np.zeros(lengths.size, np.int64)
    base = 0
    for ids, each, n in whole_plan(lengths, counts, capacity)[0]:
        offset = 0
        for k, c in zip(ids.tolist(), each.tolist(), strict=True):
            rows.append((int(lengths[k]), int(ranks[k]), base, c, offset))
            ranks[k] += c * n
            offset += c * int(lengths[k])
        base += n
    rows.sort()
    table = np.asarray(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "base", "each", "offset"), table.T, strict=True))


def pack(parts: DataFrame, *, capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """``parts`` (any rows with ``length``, 1..capacity) with sequence_id and offset appended.

    salts: groups that pieces of one length are dealt to for ranking; by default they grow with the pieces.
    """
    spark = parts.sparkSession
    names = parts.columns
    held = stored(parts.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    salts = salts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held.count() // SALT_ROWS))
    held = held.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))
    per_salt = held.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    hist = sorted((r["length"], r["n"]) for r in per_salt.groupBy("length").agg(F.sum("n").alias("n")).collect())  # at most `capacity` rows
    slots = plan_slots(np.asarray([h[0] for h in hist], np.int64), np.asarray([h[1] for h in hist], np.int64), capacity)
    before = per_salt.select("length", "_salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = held.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")) - 1).join(before, ["length", "_salt"])
    out = ranked.select(*names, (F.col("_rank") + F.col("_before")).alias("_rank"))
    table = spark.sparkContext.broadcast(slots)
    at = names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = table.value
        big = np.int64(1) << np.int64(48)
        keys = s["length"] * big + s["first"]
        for batch in batches:
            n = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            k = np.searchsorted(keys, n * big + rank, side="right") - 1
            r = rank - s["first"][k]
            seq = s["base"][k] + r // s["each"][k]
            off = s["offset"][k] + (r % s["each"][k]) * n
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return out.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def op6_pack(spark, sf_dir: str) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(pieces(docs, tokenizer_path()))
