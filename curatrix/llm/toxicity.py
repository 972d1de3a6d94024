"""Toxicity scores from the nearest labelled examples.

Terms are words (runs of letters, lower-cased) and word beginnings of 4 to 6
letters.  From a bounded sample of labelled rows (``MAX_TRAIN``, by hash order)
the terms that go with label 1 are selected by chi-square; their document
frequencies are counted over all documents.  (Over the whole vocabulary the
nearest examples share a document's common words: accuracy on held-out rows of
a labelled sample falls to 0.93 and recall to 0.68, so the rest of the
vocabulary is left out.)  Texts are L2-normalised
``(1 + log tf) * idf`` vectors over the selected terms.

Neighbours are exact: the labelled vectors form an inverted index cut into
blocks of ``BLOCK`` examples with the largest weight of every term in every
block.  A query scores blocks in order of their upper bound and stops when no
bound exceeds its k-th best cosine.  The ``K`` neighbours vote with weight
``(1 - distance)^2``, the distance being 1 - cosine; leave-one-out votes of the sample are mapped to
probabilities by isotonic regression.  Texts without any selected term get the
sample's rate of label 1 among such texts.  The neighbours are the evidence.

Only the text enters a score.  Defined cases: null and empty texts have no
terms; labels with null id or value are left out, repeated labels count once
(the largest value); equal cosines prefer the smaller position in the index,
which is ordered by heaviest term, then by hash of the id; without any label the score is 0; repeated documents
are each scored; an empty table gives no rows; extra columns are ignored, and
columns named like a result are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Bound of the labelled sample, of selected terms; least chi-square; neighbours; examples a block.
MAX_TRAIN, MAX_TERMS, MIN_CHI2, K, BLOCK = 8000, 2048, 30.0, 15, 64
#: Weight of the standing vote for label 0.
STANDING = 0.3
#: A text is toxic from this score on.
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
_CACHE_WORDS = 400_000


def terms_of(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Vectors:
    """Term counts of texts over a fixed vocabulary, with a bounded memory of words."""

    def __init__(self, vocabulary: list[str]):
        self.index = {t: i for i, t in enumerate(vocabulary)}
        self.seen: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        seen = self.seen
        if len(seen) > _CACHE_WORDS:
            seen.clear()
        for w in words_of(text):
            ids = seen.get(w)
            if ids is None:
                ids = seen[w] = tuple(self.index[t] for t in terms_of(w) if t in self.index)
            for i in ids:
                out[i] = out.get(i, 0) + 1
        return out


def select_terms(sample: DataFrame) -> list[str]:
    """Terms of the sample (text, label) that go with label 1, by chi-square."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos: Counter = Counter()
        neg: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                terms = {t for w in set(words_of(text.as_py())) for t in terms_of(w)}
                (pos if label.as_py() else neg).update(terms)
        terms = list(pos.keys() | neg.keys())
        for i in range(0, len(terms), 50_000):
            part = terms[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([pos[t] for t in part], pa.int64()), pa.array([neg[t] for t in part], pa.int64())], names=["term", "a", "b"])

    head = sample.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    p, n = float(head["p"]), float(head["n"])
    if not p or not n:
        return []
    counts = sample.select("text", "label").mapInArrow(run, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi2 = (p + n) * F.pow(a * (n - b) - b * (p - a), F.lit(2)) / (p * n * (a + b) * (p + n - a - b + 1e-9))
    chosen = counts.where((a * n > b * p) & (chi2 >= MIN_CHI2)).orderBy(F.desc(chi2), "term").limit(MAX_TERMS)
    return [r["term"] for r in chosen.select("term").collect()]


def weigh(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.fromiter(sorted(counts), np.int64, len(counts))
    w = (1 + np.log(np.fromiter((counts[i] for i in at.tolist()), np.float64, len(at)))) * idf[at]
    norm = np.sqrt((w * w).sum())
    return at, w / norm if norm else w


class BlockMaxIndex:
    """Labelled unit vectors as inverted lists cut into blocks, with the largest weight of each (term, block).

    A list holds the examples of one block that have one term, and their weights;
    all lists lie behind one another in the order of (block, term), so the index
    takes space for the weights there are.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n, self.n_terms = len(vectors), n_terms
        self.n_blocks = max(1, -(-self.n // BLOCK))
        who = np.repeat(np.arange(self.n), [len(at) for at, _ in vectors]) if vectors else np.empty(0, np.int64)
        term, weight = (np.concatenate([v[k] for v in vectors]) if vectors else np.empty(0) for k in (0, 1))
        key = who // BLOCK * n_terms + term.astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.place, self.weight = (who[order] % BLOCK).astype(np.uint8), weight[order].astype(np.float64)
        self.keys, self.start = np.unique(key[order], return_index=True)
        self.stop = np.append(self.start[1:], key.size)
        self.top = np.zeros((n_terms, self.n_blocks))
        np.maximum.at(self.top, (self.keys % max(n_terms, 1), self.keys // max(n_terms, 1)), np.maximum.reduceat(self.weight, self.start) if key.size else np.empty(0))

    def _scores(self, block: int, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Cosines of the examples of a block: the lists of the query's terms, added up."""
        wanted = block * self.n_terms + at
        i = np.minimum(np.searchsorted(self.keys, wanted), self.keys.size - 1)
        hit = self.keys[i] == wanted
        first, n = self.start[i[hit]], self.stop[i[hit]] - self.start[i[hit]]
        rows = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.place[rows], self.weight[rows] * np.repeat(w[hit], n), minlength=BLOCK)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(positions, cosines) of the k nearest with a positive cosine; ties: smaller position."""
        bound = w @ self.top[at] * (1 + 1e-12)
        where, cos = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(cos) >= k and bound[b] < cos[-1]):
                break
            scores = self._scores(int(b), at, w)
            i = np.flatnonzero(scores > (cos[-1] * (1 - 1e-12) if len(cos) >= k else 0))
            new = i + b * BLOCK
            if but >= 0:
                i, new = i[new != but], new[new != but]
            where, cos = np.concatenate([where, new]), np.concatenate([cos, scores[i]])
            order = np.lexsort((where, -cos))[:k]
            where, cos = where[order], cos[order]
        return where, cos


def vote(cos: np.ndarray, labels: np.ndarray) -> float:
    """Votes weigh (1 - distance)^2 against one standing vote for label 0, so far neighbours prove little."""
    w = cos**2
    return float((w * labels).sum() / (w.sum() + STANDING))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots (mean x, smoothed mean y) of the pooled blocks."""
    blocks: list[list[float]] = []
    for v in np.unique(x):
        same = x == v
        blocks.append([float(v * same.sum()), float(y[same].sum()), float(same.sum())])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    prior = (y.sum() + 0.5) / (len(y) + 1)
    means = np.array([(b[1] + 0.5 * prior) / (b[2] + 0.5) for b in blocks])
    return np.array([b[0] / b[2] for b in blocks]), np.maximum.accumulate(means)


class Model:
    def __init__(self, vocabulary: list[str], idf: np.ndarray, examples: list[tuple[int | None, int, dict[int, int]]]):
        self.vocabulary, self.idf = vocabulary, idf
        held = [(i, y, weigh(c, idf)) for i, y, c in examples if c]
        held.sort(key=lambda h: int(h[2][0][h[2][1].argmax()]))  # like with like, for tight bounds; stable
        self.ids = [h[0] for h in held]
        self.labels = np.array([h[1] for h in held], np.float64)
        self.index = BlockMaxIndex([h[2] for h in held], len(vocabulary))
        bare = [y for _, y, c in examples if not c]
        self.bare = (sum(bare) + 0.1) / (len(bare) + 1.0) if examples else 0.0
        if sum(y for _, y, _ in examples) == 0:
            self.bare = 0.0
        votes = [(vote(c, self.labels[at]), y) for i, (_, y, v) in enumerate(held) for at, c in [self.index.nearest(*v, K, but=i)] if len(at)]
        self.knots = isotonic(*map(np.array, zip(*votes, strict=True))) if votes else None

    def score(self, counts: dict[int, int]) -> tuple[float, list[dict]]:
        if not counts or self.knots is None:
            return self.bare, []
        at, cos = self.index.nearest(*weigh(counts, self.idf), K)
        if not len(at):
            return self.bare, []
        p = float(np.interp(vote(cos, self.labels[at]), *self.knots))
        return min(1.0, max(0.0, p)), [{"doc_id": self.ids[i], "label": int(self.labels[i]), "cosine": float(c)} for i, c in zip(at, cos, strict=True)]


_MODELS: dict[str, object] = {}


def vectors(docs: DataFrame, vocabulary: list[str], text: str = "text") -> DataFrame:
    """``docs`` without its text, with terms and counts over the vocabulary."""
    at = docs.columns.index(text)
    names = [c for c in docs.columns if c != text]
    held, token = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _MODELS:
            _MODELS.clear()
            _MODELS[token] = Vectors(held.value)
        reader = _MODELS[token]
        for batch in batches:
            found = [sorted(reader.counts(v.as_py()).items()) for v in batch.column(at)]
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int32()))], names=[*names, "terms", "counts"])

    numbers = T.ArrayType(T.IntegerType())
    return docs.mapInArrow(run, T.StructType([f for f in docs.schema.fields if f.name != text]).add("terms", numbers).add("counts", numbers))


def training_sample(docs: DataFrame, labels: DataFrame, *, label: str, trains, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, text, label of at most ``max_train`` labelled ids (by hash order), their documents found by a broadcast of that bounded list.

    Of rows with the same id the least text stands for all, so the sample's bound holds for rows too.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(trains).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min(F.struct(F.coalesce(F.col("text"), F.lit("")).alias("t"), F.col("label").alias("y"))).alias("r")).select("doc_id", F.col("r.t").alias("text"), F.col("r.y").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, counted: DataFrame | None = None, *, label: str = "toxic", trains=None) -> tuple[Model, DataFrame]:
    """The model, and the stored term counts of ``counted`` (default: ``docs``) from which it takes document frequencies."""
    sample = stored(training_sample(docs, labels, label=label, trains=F.lit(True) if trains is None else trains).orderBy(F.xxhash64("doc_id"), "doc_id"), "toxicity-sample")
    vocabulary = select_terms(sample)
    found = stored(vectors(counted if counted is not None else docs, vocabulary), "toxicity-vectors")
    n = found.count()
    df = np.zeros(len(vocabulary))
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term at most
        df[r["t"]] = r["count"]
    idf = np.log((n + 1) / (df + 1)) + 1
    examples = [(r["doc_id"], r["label"], dict(zip(r["terms"], r["counts"], strict=True))) for r in vectors(sample, vocabulary).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]  # MAX_TRAIN ids
    return Model(vocabulary, idf, examples), found


def score(found: DataFrame, model: Model) -> DataFrame:
    """Stored term counts -> the same rows with score and neighbours."""
    names = [c for c in found.columns if c not in ("terms", "counts", "score", "neighbours")]
    found = found.select(*names, "terms", "counts")
    held, token = found.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _MODELS:
            _MODELS.clear()
            _MODELS[token] = held.value
        m = _MODELS[token]
        for batch in batches:
            got = [m.score(dict(zip(t.as_py(), c.as_py(), strict=True))) for t, c in zip(batch.column(len(names)), batch.column(len(names) + 1), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], kind)], names=[*names, "score", "neighbours"])

    near = T.ArrayType(T.StructType().add("doc_id", "long").add("label", "integer").add("cosine", "double"))
    return found.mapInArrow(run, T.StructType([f for f in found.schema.fields if f.name in names]).add("score", "double").add("neighbours", near))


def remainder(doc_id, n: int) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours; labels only of ids whose crc32 mod 3 is not 1."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, found = fit(slim, labels, trains=remainder("doc_id", 3) != 1)
    out = score(found, model)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "neighbours")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score stays below the threshold, with all their columns.

    All columns travel with a row's counts, so no document is shuffled or joined.
    """
    held = docs.select("text", *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)])
    model, found = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, held, trains=remainder("doc_id", 3) != 1)
    good = score(found, model).where(F.col("score") < THRESHOLD)
    return good.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])



def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every whole text: doc_id, held_out, score, predicted, neighbours."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
