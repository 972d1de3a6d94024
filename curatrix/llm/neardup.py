"""Near-duplicate documents by DartMinHash over weighted five-word shingles.

A document is the weighted set of its five-word shingles (weight: occurrences;
a text of one to four words is one shingle of all its words).  Words are runs of
letters, digits and underscores, lower-cased.  Two documents are linked if their
weighted Jaccard similarity (sum of minima over sum of maxima) is at least
``THRESHOLD``; classes are the connected components.

Signature (DartMinHash): hashed darts fall on the plane of an element's weight
and a rank, one on average per unit of area, the same darts for every document.
A document keeps the darts under its weight with rank below ``t / total
weight``, t being large enough to fill all coordinates but rarely, and doubled
for documents it doesn't.  A dart's hash names one of ``COORDS`` coordinates,
each keeps its dart of least rank.  Two documents agree in a coordinate with
probability equal to their weighted Jaccard similarity.

Candidates: bands of ``ROWS`` coordinates (at 0.8: missed with probability
7e-5).  Exact copies are one node.  Every member of a bucket is checked exactly
against the bucket's least node; components of the verified links follow.  Then
the buckets that still hold several components are compared exactly between
components, as matrix products within a task, which returns a link for each two
components it joins; components follow again.  No pairs of a bucket are listed,
and large buckets are cut into pairs of blocks.

Defined cases: null, empty and wordless texts have no shingles and are classes
of their own, one per row; equal texts form a class with or without words in
common otherwise; rows with a null id take part, and the class id is the
smallest non-null id (null if there is none); repeated rows belong to one
class; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, free_name, stored

THRESHOLD, WORDS = 0.8, 5
BANDS, ROWS = 24, 5
COORDS = BANDS * ROWS
#: Members and characters of a block of an unresolved bucket; a task compares two blocks.
BUCKET_BLOCK, BUCKET_CHARS = 2000, 8_000_000
_WORD = re.compile(r"\w+")
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Cumulative Poisson(1) probabilities as 64-bit thresholds; more than 12 darts in a cell don't occur.
_POISSON = (np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1, *range(1, 13)]).astype(float)]) * 2.0**63).astype(np.uint64)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's shingles, in order, with repetitions."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = mix(out * _M3 + h[k : len(words) - size + 1 + k])
    return out


def similarity(a: str | None, b: str | None) -> float:
    """Weighted Jaccard similarity of the shingle sets; 0 if both are empty."""
    (x, n), (y, m) = (np.unique(shingles(t), return_counts=True) for t in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = np.minimum(n[i], m[j]).sum()
    total = n.sum() + m.sum() - least
    return float(least / total) if total else 0.0


def _darts(element: np.ndarray, weight: np.ndarray, theta: np.ndarray):
    """(row, rank, hash) of the darts under each row's weight and rank bound.

    The plane is cut into unit cells; a cell (i, j) of an element holds a
    Poisson(1) number of darts at hashed places.
    """
    cols, rows = np.ceil(weight).astype(np.int64), np.ceil(theta).astype(np.int64)
    per = cols * rows
    row = np.repeat(np.arange(element.size), per)
    k = np.arange(row.size) - np.repeat(np.cumsum(per) - per, per)
    i, j = k // rows[row], k % rows[row]
    cell = mix(element[row] ^ mix(i.astype(np.uint64) * _M3 + j.astype(np.uint64) * _M1 + _M2))
    n = np.searchsorted(_POISSON, cell >> np.uint64(1), side="right")
    at = np.repeat(np.arange(row.size), n)
    q = np.arange(at.size) - np.repeat(np.cumsum(n) - n, n)
    dart = mix(cell[at] + (q.astype(np.uint64) + np.uint64(1)) * _M3)
    unit = 2.0**-53
    w = i[at] + (mix(dart ^ _M1) >> np.uint64(11)).astype(np.float64) * unit
    r = j[at] + (mix(dart ^ _M2) >> np.uint64(11)).astype(np.float64) * unit
    row = row[at]
    keep = (w < weight[row]) & (r < theta[row])
    return row[keep], r[keep], dart[keep]


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """[len(sets), COORDS] dart hashes for weighted sets of (elements, weights); none may be empty."""
    out = np.zeros((len(sets), COORDS), np.uint64)
    todo, t = np.arange(len(sets)), COORDS * (np.log(COORDS) + 3)
    while todo.size:
        size = np.array([len(sets[d][0]) for d in todo])
        element = np.concatenate([sets[d][0] for d in todo])
        weight = np.concatenate([sets[d][1] for d in todo]).astype(np.float64)
        doc = np.repeat(np.arange(todo.size), size)
        theta = t / np.bincount(doc, weight)
        row, rank, dart = _darts(element, weight, theta[doc])
        slot = doc[row] * COORDS + (mix(dart ^ _M3) % np.uint64(COORDS)).astype(np.int64)
        order = np.lexsort((rank, slot))
        first = np.ones(order.size, bool)
        first[1:] = slot[order][1:] != slot[order][:-1]
        order = order[first]
        filled = np.bincount(slot[order] // COORDS, minlength=todo.size) == COORDS
        good = order[filled[slot[order] // COORDS]]
        out[todo[slot[good] // COORDS], slot[good] % COORDS] = dart[good]
        todo, t = todo[~filled], t * 2
    return out


def _batches(texts: list, limit: int = 400_000) -> Iterator[list[int]]:
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(i)
        size += len(t or "")
        if size > limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, key (of the text), row, n_chars, bands array<long>; no bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            bands: list = [[] for _ in texts]
            same: dict[str, int] = {}
            copies = []
            for part in _batches(texts):
                fresh, sets = [], []
                for i in part:
                    if texts[i] is None:
                        continue
                    if texts[i] in same:
                        copies.append((i, same[texts[i]]))
                        continue
                    same[texts[i]] = i
                    x = shingles(texts[i])
                    if x.size:
                        fresh.append(i)
                        sets.append(np.unique(x, return_counts=True))
                if not sets:
                    continue
                s = signatures(sets)
                folded = np.zeros((len(sets), BANDS), np.uint64) + (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * _M3
                for k in range(ROWS):
                    folded = mix(folded * _M1 + s[:, k::ROWS])
                for i, b in zip(fresh, folded.view(np.int64).tolist(), strict=True):
                    bands[i] = b
            for i, j in copies:
                bands[i] = bands[j]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "row", "n_chars", "bands"])

    row = F.col("row") if "row" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", text_key("text").alias("key"), "text", row.alias("row")).mapInArrow(run, "doc_id long, key string, row long, n_chars long, bands array<long>")


def text_key(text: str) -> F.Column:
    return F.substring(F.sha2(F.col(text), 256), 1, 32)


def node_texts(ids: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Stored (id, text) of the wanted nodes, from the one document that stands for each."""
    wanted = nodes.join(ids, "id", "left_semi").select("id", "key", F.col("first_doc").alias("doc_id"))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).withColumn("key", text_key("text"))
    return stored(rows.join(wanted, (rows["key"] == wanted["key"]) & rows["doc_id"].eqNullSafe(wanted["doc_id"])).select("id", "text").dropDuplicates(["id"]), "neardup-texts")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of node ids whose texts are similar enough.

    The side with many partners is joined second, as the split side, so a
    popular node's pairs spread over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([similarity(x.as_py(), y.as_py()) >= THRESHOLD for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = left.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def weighted_elements(text: str | None) -> np.ndarray:
    """Elements whose common number is a sum of minima: the k-th occurrence of a shingle is an element of its own."""
    x, n = np.unique(shingles(text), return_counts=True)
    each = np.repeat(x, n)
    nth = np.arange(each.size) - np.repeat(np.cumsum(n) - n, n)
    return mix(each ^ (nth.astype(np.uint64) * _M3))


def similar_roots(roots: np.ndarray, texts: list[str], elements_of: Callable[[str], np.ndarray] = weighted_elements) -> list[tuple[int, int]]:
    """Links between the components of a block: every pair of its texts is compared exactly, as products of set rows.

    Elements that the same texts hold are one column with a weight.  A link that
    joins nothing new is not returned.
    """
    elements = [elements_of(t) for t in texts]
    rows, sizes = [np.full(e.size, i) for i, e in enumerate(elements)], [e.size for e in elements]
    element, row, size = np.concatenate(elements), np.concatenate(rows), np.array(sizes, np.float64)
    _, column, count = np.unique(element, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(count.size, -1, np.int64)
    place[shared] = np.arange(shared.size)
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    held = mix(np.arange(len(texts), dtype=np.uint64) + _M1)  # a column's pattern: the sum of its texts' marks
    marks = np.zeros(shared.size, np.uint64)
    np.add.at(marks, column, held[row])
    _, first, pattern = np.unique(marks, return_index=True, return_inverse=True)
    weight = np.bincount(pattern, minlength=first.size).astype(np.float32)
    chosen = np.zeros(shared.size, bool)
    chosen[first] = True
    row, column = row[chosen[column]], pattern[column[chosen[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(texts), len(texts)), np.float32)
    for c in range(0, first.size, 4096):
        i, j = np.searchsorted(column, [c, c + 4096])
        x = np.zeros((len(texts), 4096), np.float32)
        x[row[i:j], column[i:j] - c] = 1
        common += (x * np.pad(weight[c : c + 4096], (0, max(0, c + 4096 - first.size)))) @ x.T
    parent = {int(r): int(r) for r in roots}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    out = []
    for i in range(len(texts)):
        both = common[i].astype(np.float64)
        for j in np.flatnonzero((both >= THRESHOLD * (size[i] + size - both) - 1e-9) & (roots != roots[i]) & (np.arange(len(texts)) > i)):
            a, b = find(int(roots[i])), find(int(roots[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((a, b))
    return out


def between_components(members: DataFrame, elements_of: Callable[[str], np.ndarray] = weighted_elements, block: int = 0, chars: int = 0) -> DataFrame:
    """Links (a, b) between the components that a bucket still holds, every pair of its texts compared.

    members: bucket, root, text, n and size (members and characters of the
    bucket).  A bucket beyond ``BUCKET_BLOCK`` members or ``BUCKET_CHARS``
    characters (or ``block`` and ``chars``) is cut into blocks, and each pair of blocks is a group of its own,
    so no task holds more than two blocks.
    """
    blocks = F.greatest(F.ceil(F.col("n") / (block or BUCKET_BLOCK)), F.ceil(F.col("size") / (chars or BUCKET_CHARS))).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    spread = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("bucket", "root", "text", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))

    def run(table: pa.Table) -> pa.Table:
        found = similar_roots(table["root"].to_numpy(), table["text"].to_pylist(), elements_of)
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return spread.groupBy("bucket", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row, doc_id, class_id (the smallest doc_id of the class), kept (one row of each class), for every row of (doc_id, text).

    ``row``: a column of unique numbers that names the rows; without it they are numbered here.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.col(row).alias("row")] if row else []))
    signed = sign(slim)
    signed = stored(signed if row else signed.drop("row").withColumn("row", F.monotonically_increasing_id()), "neardup-signed")
    worded = F.size("bands") > 0
    nodes = stored(
        signed.where(worded).groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.min_by(F.struct("bands", "n_chars"), "row").alias("s")).select(F.monotonically_increasing_id().alias("id"), "key", "first_doc", "s.bands", "s.n_chars"),
        "neardup-nodes",
    )
    buckets = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = stored(buckets.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1"), "neardup-buckets")
    members = stored(buckets.join(shared, "bucket"), "neardup-members")
    pairs = stored(members.where("id <> a").select("a", F.col("id").alias("b")).distinct(), "neardup-pairs")
    texts = node_texts(members.select("id").distinct(), nodes, slim)
    first = roots = components(verified(pairs, texts), "neardup")
    placed = members.where("n > 2").join(roots.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    placed = stored(placed.join(nodes.select("id", "n_chars"), "id"), "neardup-placed")
    mixed = stored(placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n"), F.sum("n_chars").alias("size")).where("x < y").select("bucket", "n", "size"), "neardup-mixed")
    more = between_components(placed.join(mixed, "bucket").join(texts, "id").select("bucket", "id", "root", "text", "n", "size"))
    above = components(more, "neardup-more").toDF("root", "above")
    roots = roots.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")).union(above.join(roots.select(F.col("node").alias("root")), "root", "left_anti"))
    named = nodes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", F.coalesce("root", "id").alias("root"))
    labelled = stored(
        signed.where(worded).select("row", "doc_id", "key").join(named, "key").select("row", "doc_id", "root"),
        "neardup-labelled",
    )
    discard(nodes, shared, members, pairs, texts, placed, mixed, first)
    classes = stored(labelled.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select("root", "class_id", F.col("first.row").alias("first_row")), "neardup-classes")
    joined = labelled.join(classes, "root").select("row", "doc_id", "class_id", (F.col("row") == F.col("first_row")).alias("kept"))
    alone = signed.where(~worded).select("row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return joined.unionByName(alone)


def op3_neardup(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, class_id (smallest doc_id of its class), kept (the one row of the class that stays)."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class (the one with the smallest id), with all its columns."""
    row = free_name(docs, "_row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "neardup-docs")
    gone = near_duplicates(numbered, row=row).where(~F.col("kept")).select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
