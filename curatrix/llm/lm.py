"""Language-model scores of whole texts: context-tree weighting, and a word unigram base.

Training counts every ``DEPTH + 1`` bytes of every training text (see ctw) and
every word, merged per task before the shuffle.  Every context of every depth is
kept, so the model grows with the corpus.  It is a stored table of the log
probability of each distinct gram (also of those only scored texts have), dealt
by the newest ``SHARED`` bytes of the context: what lies below such a context is
fitted in one task, and only sums over shorter contexts, of which bytes allow no
more than 65,793, meet on the driver.  Scoring looks the grams of a batch up in
one part of the table after the other, or holds all parts if they are small.

The base needs the training count of every word.  The most frequent words,
``FREQUENT`` at most, are broadcast; a text's other words are joined to the full table
of counts, and the two parts of each sum are added.

Words: A-Z lower-cased, maximal runs without the six ASCII white-space
characters; an end token follows each text's words.  Base per token:
log10((c + 1) / (N + V + 1)).

Defined cases: null texts are empty texts (an end only); without training texts
the model is uniform over bytes; rows with a null id are scored and train only
if the caller's condition says so; repeated rows are each scored; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ctw
from .common import stored
from .toxicity import remainder

DEPTH, FREQUENT = 5, 65536
#: Newest context bytes that decide the task of a gram, and grams a task fits.
SHARED, FIT_GRAMS = 3, 500_000
#: Grams of the table a worker holds; of a larger table it holds a part at a time.
HELD_GRAMS = 8_000_000
#: Characters handled at once, and distinct entries held before they are passed on.
CHUNK, HELD = 1_000_000, 2_000_000
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: The end token; no word holds a line feed.
END_WORD = "\n"


def words_of(text: str | None) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()]


def _chunks(texts: Iterator[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "") + 1
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _values(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[str | None]:
    for batch in batches:
        for v in batch.column(column):
            yield v.as_py()


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def count_grams(train: DataFrame, depth: int = DEPTH, unseen: DataFrame | None = None) -> DataFrame:
    """g, n: counts of ``depth + 1`` bytes (as one number) over (text); with 0 those that only ``unseen`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        out = lambda p: pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], names=["g", "n"])
        for texts in _chunks(_values(batches)):
            codes, at, _ = ctw.coded(texts, depth)
            parts.append(np.unique(ctw.gram_keys(codes, at, depth), return_counts=True))
            if sum(len(p[0]) for p in parts) > HELD:
                parts = [_merged(parts)]
                if len(parts[0][0]) > HELD // 2:
                    yield out(parts.pop())
        if parts:
            yield out(_merged(parts))

    grams = train.select("text").mapInArrow(run, "g long, n long")
    if unseen is not None:
        grams = grams.union(unseen.select("text").mapInArrow(run, "g long, n long").select("g", F.lit(0).cast("long").alias("n")))
    return grams.groupBy("g").agg(F.sum("n").alias("n"))


def count_words(train: DataFrame) -> DataFrame:
    """w, c: training count of every token of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda c: pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["w", "c"])
        for text in _values(batches):
            held.update(words_of(text))
            held[END_WORD] += 1
            if len(held) > 250_000:
                yield out(held)
                held.clear()
        if held:
            yield out(held)

    return train.select("text").mapInArrow(run, "w string, c long").groupBy("w").agg(F.sum("c").alias("c"))


def at_most(df: DataFrame, count: str, bound: int) -> DataFrame:
    """The rows of the highest counts, ``bound`` at most, cut where the count's logarithm (in 64ths) changes.

    Only a histogram of those logarithms is collected, a few thousand rows at
    most, where a sorted limit would send ``bound`` rows of every task.
    """
    level = F.floor(F.log2(F.col(count).cast("double")) * 64).cast("int")
    left, cut = bound, 64 * 64
    for r in sorted(df.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        left -= r["n"]
        if left < 0:
            break
        cut = r["level"]
    return df.where(level >= cut)


def fit_table(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """g, p: log10 probability of each gram's last byte after the others, by all contexts of (g, n); each part sorted by g."""
    low = min(SHARED, depth)
    parts = max(1, -(-grams.count() // FIT_GRAMS))
    dealt = grams.repartition(parts, F.shiftright("g", 8).bitwiseAND(F.lit((1 << 8 * low) - 1)))

    def whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        g, n = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, np.int64),) * 2
        by = np.argsort(g)
        return g[by], n[by]

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in ctw.sums_above(*whole(batches), depth, low):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "zeros", "ones", "split"])

    if low:
        sums = dealt.mapInArrow(below, "node long, zeros double, ones double, split double").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "split")])
        top = ctw.mix_above(*(c.to_numpy() for c in sums.toArrow().combine_chunks().columns), low)  # contexts of two bytes at most
    else:
        top = (np.empty(0, np.int64), np.empty(0), np.empty(0))
    above = grams.sparkSession.sparkContext.broadcast(top)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n = whole(batches)
        if g.size:
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(ctw.gram_logs(g, n, depth, low, above.value).astype(np.float32))], names=["g", "p"])

    return stored(dealt.mapInArrow(fit, "g long, p float"), "lm-table")


def _part(uri: str) -> tuple[np.ndarray, np.ndarray]:
    system, path = fs.FileSystem.from_uri(uri)
    t = pq.read_table(path, filesystem=system, columns=["g", "p"])
    return t["g"].to_numpy(), t["p"].to_numpy()


class Lookup:
    """Log10 probabilities of texts from the stored table's parts."""

    def __init__(self, files: list[str], grams: int, depth: int):
        self.files, self.depth, self.table = files, depth, None
        if grams <= HELD_GRAMS:
            self.table = self._sorted([_part(f) for f in files])

    @staticmethod
    def _sorted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        g, p = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.float32))
        by = np.argsort(g)
        return g[by], p[by]

    def _keys(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        codes, at, firsts = ctw.coded(texts, self.depth)
        return ctw.gram_keys(codes, at, self.depth), firsts

    def of(self, batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
        """The table, or as much of it as the batch's texts need."""
        if self.table is not None:
            return self.table
        need = np.empty(0, np.int64)
        for texts in _chunks(_values([batch], column)):
            need = np.union1d(need, self._keys(texts)[0])
        found = []
        for f in self.files:
            g, p = _part(f)
            if g.size:
                at = np.minimum(np.searchsorted(g, need), g.size - 1)
                hit = g[at] == need
                found.append((need[hit], p[at[hit]]))
        return self._sorted(found)

    def score(self, texts: list[str | None], table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        keys, firsts = self._keys(texts)
        if not keys.size:
            return np.empty(0)
        g, p = table
        distinct, place = np.unique(keys, return_inverse=True)
        at = np.searchsorted(g, distinct)
        if at[-1] >= g.size or (g[at] != distinct).any():
            raise ValueError("a scored text has bytes that neither train nor unseen has; pass its row in unseen")
        return np.add.reduceat(p[at].astype(np.float64)[place], firsts)


_SCORERS: dict[str, tuple] = {}


def score(docs: DataFrame, train: DataFrame, *, unseen: DataFrame | None = None, depth: int = DEPTH, frequent: int = FREQUENT) -> DataFrame:
    """``docs`` (doc_id, held_out, text) without the text, with n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    unseen: the rows of ``docs`` that are not in ``train``, if the caller knows them.
    """
    spark = docs.sparkSession
    grams = stored(count_grams(train, depth, docs if unseen is None else unseen), "lm-grams")
    logs_of = fit_table(grams, depth)
    files, n_grams = logs_of.inputFiles(), logs_of.count()
    words = stored(count_words(train), "lm-words")
    head = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, floor = int(head["n"]), math.log10(head["n"] + head["v"] + 1)
    top = {r["w"]: r["c"] for r in at_most(words, "c", frequent).collect()}
    held = spark.sparkContext.broadcast({w: (math.log10(c + 1) - floor) for w, c in top.items()})
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[token] = (Lookup(files, n_grams, depth), held.value)
        scorer, logs = _SCORERS[token]
        for batch in batches:
            done, table = 0, scorer.of(batch, 2)
            for texts in _chunks(_values([batch], 2)):  # small batches out: rare words are many objects
                part, done = batch.slice(done, len(texts)), done + len(texts)
                n_tokens, n_known, base, words, counts, offsets = [], [], [], [], [], [0]
                for text in texts:
                    found = Counter(words_of(text))
                    found[END_WORD] += 1
                    known, sum_ = 0, 0.0
                    for w, n in found.items():
                        x = logs.get(w)
                        if x is None:
                            words.append(w)
                            counts.append(n)
                        else:
                            known += n
                            sum_ += n * x
                    n_tokens.append(found.total())
                    n_known.append(known)
                    base.append(sum_)
                    offsets.append(len(words))
                n_bytes = [len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts]
                rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["w", "n"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *[pa.array(x, pa.int64()) for x in (n_tokens, n_known, n_bytes)], pa.array(base, pa.float64()), pa.array(scorer.score(texts, table), pa.float64()), rare],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "base", "score", "rare"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, n_bytes long, base double, score double, rare array<struct<w:string,n:long>>"
    partial = stored(docs.select("doc_id", "held_out", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-partial")
    rare = partial.select("row", F.explode("rare").alias("x")).select("row", "x.w", "x.n").join(words, "w", "left")
    c = F.coalesce("c", F.lit(0))
    rest = rare.groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * (F.log10(c + 1.0) - floor)).alias("more"))
    out = partial.drop("rare").join(rest, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op7_lm(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.coalesce(remainder("doc_id", 7) == 2, F.lit(False)).alias("held_out"))
    return score(docs, docs.where(~F.col("held_out")), unseen=docs.where("held_out"))
