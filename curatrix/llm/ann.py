"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are put in bands of norms, ``BANDS`` a doubling, scaled by the upper end M of
their own band and given one more coordinate, ``sqrt(1 - |x|^2 / M^2)``
(queries: 0), which turns the largest inner product of a band into the smallest
Euclidean distance; so a long vector changes nothing for the others, and the
bands, all of which are visited, can share directions and probes.  Each of ``TABLES`` tables hashes by
``floor((a . v + b) / width)`` for ``HASHES`` Gaussian directions.  A query
visits its own bucket and perturbed ones (each hash -1, 0 or +1) in order of
estimated success, the sum of squared distances to the crossed bucket borders,
``PROBES`` buckets a table.  Candidates of all tables are merged and reranked by
exact double-precision inner products, with rows long enough to be among the best at a cosine of ``WIDE``.

Layout: rows get a running number and go to blocks of at most about
``DATA_BLOCK`` rows; queries to blocks of ``QUERY_BLOCK``.  One task joins one
query block to one data block, sorts the rows of its block by bucket for every
table, and scores the rows of the visited buckets only; so memory is bounded
whatever the buckets hold, and a bucket with a third of all rows is spread over
all data blocks.  Each pair of blocks returns ``k`` rows a query; a window keeps
the best.  A query that meets fewer than ``k`` rows in a block goes on through
all buckets.

Recall against brute force is tested (at least 0.9); the defaults are set for
vectors without cluster structure, the worst case for hashing: 0.9 of the 20
nearest of 51,282 isotropic unit vectors (the 20th at a cosine of 0.42) take
about half of all rows as candidates, whatever the tables.

Defined cases: null vectors, vectors of zero length or norm, or with null or
non-finite components take no part; vectors are compared only with vectors of
the same dimension; a row is never its own candidate, but a repeated row is a
candidate; null ids are candidates (sorted last on ties), not queries; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TABLES, HASHES, WIDTH, PROBES = 12, 6, 1.2, 150
DATA_BLOCK, QUERY_BLOCK = 16384, 4096
#: Bands of norms for each doubling.
BANDS = 4
#: Cosine at which hashing is not relied on: rows that reach the best found so far with it are candidates.
WIDE = 0.3
SEED = 20240229
_STEPS = np.array(list(itertools.product((0, -1, 1), repeat=HASHES)), dtype=np.int64)
_WHICH = np.where(_STEPS == 0, 0, np.where(_STEPS < 0, 1, 2))
_BASE = np.int64(512) ** np.arange(HASHES, dtype=np.int64)


def valid(vectors: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0)).where(F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0))


def _directions(dim: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, table])
    return rng.standard_normal((dim, HASHES)), rng.uniform(0, WIDTH, HASHES)


class Tables:
    """The hash tables of a block of rows: rows sorted by bucket, and where each bucket begins."""

    def __init__(self, data: np.ndarray):
        norms = np.linalg.norm(data, axis=1)
        x = data / np.maximum(np.exp2(np.ceil(np.log2(norms) * BANDS) / BANDS), norms)[:, None]
        x = np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]])
        self.n, self.tables = len(x), []
        for t in range(TABLES):
            a, b = _directions(x.shape[1], t)
            key = ((np.floor((x @ a + b) / WIDTH).astype(np.int64) + 256) * _BASE).sum(1)
            order = np.argsort(key, kind="stable")
            buckets, start = np.unique(key[order], return_index=True)
            self.tables.append((a, b, order, buckets, start, np.append(start[1:], self.n)))

    def candidates(self, queries: np.ndarray, k: int, probes: int = PROBES) -> Iterator[np.ndarray]:
        """For each query the rows of the buckets it visits in all tables, merged and sorted.

        A table's buckets are visited in order of estimated success; a query that
        meets fewer than ``k`` rows goes on through all buckets of its tables.
        """
        q = np.hstack([queries / np.linalg.norm(queries, axis=1)[:, None], np.zeros((len(queries), 1))])
        seen = [self._visits(q, table, probes) for table in self.tables]
        for i in range(len(q)):
            mark = np.zeros(self.n, bool)
            for (_, _, order, _, start, stop), (found, hit) in zip(self.tables, seen, strict=True):
                at = found[i, hit[i]]
                first, n = start[at], stop[at] - start[at]
                mark[order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
            rows = np.flatnonzero(mark)
            yield rows if len(rows) > k else np.arange(self.n)

    @staticmethod
    def _visits(q: np.ndarray, table: tuple, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket number, is there such a bucket) of each query's probes, in order of estimated success."""
        a, b, _, buckets, _, _ = table
        at = (q @ a + b) / WIDTH
        home = np.floor(at).astype(np.int64)
        frac = at - home
        cost = np.stack([np.zeros_like(frac), frac**2, (1 - frac) ** 2], axis=2)
        found, hit = [], []
        for i in range(0, len(q), 256):
            total = cost[i : i + 256][:, np.arange(HASHES), _WHICH].sum(2)
            order = np.argsort(total, axis=1, kind="stable")[:, :probes]
            probe = ((home[i : i + 256, None, :] + _STEPS[order] + 256) * _BASE).sum(2)
            place = np.minimum(np.searchsorted(buckets, probe), len(buckets) - 1)
            found.append(place)
            hit.append(buckets[place] == probe)
        return np.concatenate(found), np.concatenate(hit)


def search_block(q_rows, q_vec, d_rows, d_ids, d_vec, k: int):
    """Best k of a data block for each query of a query block: (query index, data index, score); candidates only are scored."""
    out_q, out_d, out_s = [], [], []
    tables, norms = Tables(d_vec), np.linalg.norm(d_vec, axis=1)
    longest = np.argsort(-norms, kind="stable")
    id_order = np.where(np.isnan(d_ids), np.inf, d_ids)

    def best_of(j: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[d_rows[rows] != q_rows[j]]
        rough = d_vec[rows] @ q_vec[j]
        if len(rows) > k:
            limit = np.partition(rough, len(rows) - k)[len(rows) - k]
            rows = rows[rough >= limit - 1e-9 * max(1.0, abs(limit))]
        exact = np.einsum("ij,ij->i", np.broadcast_to(q_vec[j], (len(rows), q_vec.shape[1])), d_vec[rows])
        best = np.lexsort((id_order[rows], -exact))[:k]
        return rows[best], exact[best]

    for i in range(0, len(q_vec), 512):
        for j, rows in enumerate(tables.candidates(q_vec[i : i + 512], k), i):
            found, exact = best_of(j, rows)
            if len(found) == k and exact[-1] > 0:  # rows so long that a wide angle is enough are candidates whatever their bucket
                least = exact[-1] / (np.linalg.norm(q_vec[j]) * WIDE)
                more = longest[: np.searchsorted(-norms[longest], -least, side="right")]
                if len(more := np.setdiff1d(more, rows)):
                    found, exact = best_of(j, np.union1d(found, more))
            elif len(found) == k:
                found, exact = best_of(j, np.arange(len(d_vec)))
            out_q.append(np.full(len(found), j))
            out_d.append(found)
            out_s.append(exact)
    cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
    return cat(out_q, np.int64), cat(out_d, np.int64), cat(out_s, np.float64)


def nearest(vectors: DataFrame, is_query, *, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for each row where ``is_query`` holds."""
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = stored(valid(named, "v").withColumn("row", F.monotonically_increasing_id()), "vectors")
    head = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("nq")).first()
    data_blocks, query_blocks = max(1, -(-head["n"] // DATA_BLOCK)), max(1, -(-head["nq"] // QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("row", "vec_id", "v", block(data_blocks).alias("db"), spread(query_blocks).alias("qb"))
    queries = rows.where("is_query").select("row", "vec_id", "v", block(query_blocks).alias("qb"), spread(data_blocks).alias("db"))

    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        parts = []
        q_len, d_len = (np.asarray(pc.list_value_length(t["v"])) for t in (q, d))
        for dim in np.intersect1d(q_len, d_len):
            qs, xs = q.filter(pa.array(q_len == dim)), d.filter(pa.array(d_len == dim))
            mat = lambda t, n=int(dim): t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            ids = xs["vec_id"].cast(pa.float64(), safe=False).to_numpy()
            i, j, s = search_block(qs["row"].to_numpy(), mat(qs), xs["row"].to_numpy(), ids, mat(xs), k)
            parts.append(pa.table({"row": qs["row"].take(pa.array(i)), "query_id": qs["vec_id"].take(pa.array(i)), "vec_id": xs["vec_id"].take(pa.array(j)), "score": pa.array(s)}))
        return pa.concat_tables(parts) if parts else pa.table({"row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    found = queries.groupBy("qb", "db").cogroup(data.groupBy("qb", "db")).applyInArrow(run, "row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 20 against all rows: query_id, rank, vec_id, score."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
