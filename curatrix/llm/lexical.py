"""Ranked lexical search: integer scores of whole documents for query items.

Postings are a DataFrame bucketed by term.  Tasks invert their documents in
blocks of bounded size, so a row is one term's postings in one block: the places
of the documents that hold it and its occurrences; one more row a block holds its
documents' ids and lengths.  A term that every document holds is thus as many rows
as there are blocks, dealt over tasks and files by size.  ``search`` reads the buckets of the items' terms, joins the terms,
weighs each match in 64-bit integers, sums by item and document inside the block
(no row is shuffled for that but the matched lists) and ranks with a window whose
limit Spark applies before its shuffle.

Terms: maximal runs of code points other than ASCII white space, punctuation and
controls, A-Z lower-cased.  ``weight`` and ``impact`` state the score.

Defined cases: null and empty texts have no terms and count nowhere; texts of any
length (a longer one is a block of its own); ties go to the smaller id, null ids
first; a repeated row is a document (or an item) of its own; items without known
terms, and empty tables, give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, fresh_path, stored

TOP = 20
BUCKETS = 64
#: Bytes of text and documents of a block.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 4096
#: Items of a term that stand in one row.
ITEMS = 1024
#: Sums of item and document that a task holds, as long as it has more than one block.
SUMS = 500_000
_KEPT = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
#: What each byte of UTF-8 counts as: itself, its lower case, or a blank.
BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 32 for b in range(256))

#: ``posts``: place in the block and occurrences, 32 bits each; the block's own row has no term, but ids and lens.
POSTINGS = "block long, term string, posts array<long>, ids array<long>, lens array<int>"


def terms(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes | None]]]:
    """(ids, texts) of at most BLOCK_BYTES and BLOCK_DOCS, or of one document."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        end = min(max(at + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, "right"))), at + BLOCK_DOCS, batch.num_rows)
        part = batch.slice(at, end - at)
        yield part.column(0), part.column(1).cast(pa.binary()).to_pylist()
        at = end


def _inverted(block: int, ids: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch | None:
    """The block's postings, a row a term."""
    found = [terms(t) if t else [] for t in texts]
    lens = np.array([len(f) for f in found], np.int64)
    if not lens.sum():
        return None
    coded = pa.array([t for f in found for t in f], pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    keys, tfs = np.unique(codes * len(texts) + np.repeat(np.arange(len(texts)), lens), return_counts=True)
    of, places = keys // len(texts), keys % len(texts)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    posts = pa.ListArray.from_arrays(pa.array(np.append(starts, of.size).astype(np.int32)), pa.array(places << 32 | tfs))
    n = starts.size
    one = [pa.array([block]), pa.nulls(1, pa.string()), pa.nulls(1, posts.type), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int32()))]
    rows = [pa.array(np.full(n, block)), coded.dictionary.cast(pa.string()), posts, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(pair) for pair in zip(one, rows, strict=True)], names=["block", "term", "posts", "ids", "lens"])


def postings(docs: DataFrame) -> DataFrame:
    """(id, text) -> the postings: a row for each block and for each term of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, texts in _blocks(batch):
                made = _inverted(block, ids, texts)
                block += 1
                if made is not None:
                    yield made

    return docs.select("id", F.col("text").cast("string").alias("text")).mapInArrow(run, POSTINGS)


def bucket(term: F.Column) -> F.Column:
    return F.when(term.isNull(), -1).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS))).cast("int")


def index(docs: DataFrame, path: str) -> DataFrame:
    """Write the postings of (id, text) to ``path``, in folders by bucket and files sorted by term, and read them back."""
    dealt = postings(docs).withColumn("bucket", bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
    dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(path)
    return docs.sparkSession.read.schema(f"{POSTINGS}, bucket int").parquet(path)


def query_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, text) -> item, item_id, term, repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, q, t.decode()) for i, q, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t in terms((text or "").encode())]
            yield pa.RecordBatch.from_pylist([{"item": i, "item_id": q, "term": t} for i, q, t in rows], pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("term", pa.string())]))

    found = items.select("item", "item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "item long, item_id long, term string")
    return found.groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("repeats"))


def weight(n: F.Column, df: F.Column) -> F.Column:
    """floor(1000 ln((2N + 2) / (2df + 1)))"""
    return F.floor(F.lit(1000.0) * F.ln((n * 2 + 2).cast("double") / (df * 2 + 1).cast("double")))


def impact(tf: F.Column, length: F.Column, n: int, total: int) -> F.Column:
    """1e9 tf div (1000 tf + 12 m), where m is 75 + 25 times the length over the mean length."""
    m = F.call_function("div", length.cast("long") * F.lit(25 * n).cast("long"), F.lit(total).cast("long")) + 75
    return F.call_function("div", tf.cast("long") * F.lit(1_000_000_000), tf.cast("long") * 1000 + m * 12)


def search(found: DataFrame, items: DataFrame, *, top: int = TOP) -> DataFrame:
    """The ``top`` documents of each row (item_id, text): item_id, rank, doc_id, score."""
    blocks = found.where("bucket = -1").select("block", "ids", "lens")
    lengths = blocks.select(F.size(F.filter("lens", lambda x: x > 0)).alias("n"), F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("l"))
    n, total, n_blocks = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0)), F.count(F.lit(1))).first()
    rows = stored(items.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("item", F.monotonically_increasing_id()), "lexical-items")
    asked = stored(query_terms(rows), "lexical-terms")
    buckets = [r[0] for r in asked.select(bucket(F.col("term")).alias("b")).distinct().collect()]  # BUCKETS at most
    read = found.where(F.col("bucket").isin(buckets))
    df = read.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum(F.size("posts")).alias("df"))
    weighed = asked.join(df, "term").withColumn("w", weight(F.lit(n), F.col("df")) * F.col("repeats")).where("w > 0")
    n_items = rows.count()
    pieces = -(-n_items // ITEMS) or 1  # of a term's items, so that no list grows with the items
    tasks = max(1, min(n_blocks, n * n_items // SUMS))
    weighed = weighed.groupBy("term", F.pmod(F.xxhash64("item"), F.lit(pieces)).alias("piece"))
    hits = stored(weighed.agg(F.collect_list(F.struct("item", "item_id", "w")).alias("hits")).drop("piece"), "lexical-hits")
    matched = read.join(hits, "term").select("block", "hits", "posts").repartition(tasks, "block").join(blocks, "block")
    # no list is empty; the outer forms spare a filter that reads the lists once more
    each = matched.select("block", "hits", "ids", "lens", F.explode_outer("posts").alias("p")).withColumn("place", F.shiftright("p", 32).cast("int"))
    tf = F.col("p").bitwiseAND(F.lit(0xFFFFFFFF))
    each = each.select("block", "place", F.get("ids", F.col("place")).alias("id"), impact(tf, F.get("lens", F.col("place")), n, total or 1).alias("impact"), F.explode_outer("hits").alias("h"))
    sums = each.groupBy("block", "place", "h.item").agg(F.sum(F.col("impact") * F.col("h.w")).alias("score"), F.max("id").alias("doc_id"), F.max("h.item_id").alias("item_id"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"), "block", "place")
    ranked = sums.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    discard(asked)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item: item_id, rank, doc_id, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("id"), "text")
    return search(index(docs, fresh_path(spark, "lexical-index")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH tokens AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents WHERE text IS NOT NULL),
lens AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
whole AS (SELECT count(*) AS nn, coalesce(sum(n), 0)::BIGINT AS l FROM lens),
posts AS (SELECT term, doc_id, count(*) AS tf FROM tokens GROUP BY term, doc_id),
asked AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
dfs AS (SELECT term, count(*) AS df FROM posts WHERE term IN (SELECT term FROM asked) GROUP BY term),
weights AS (SELECT item_id, term, (repeats * floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)))::BIGINT AS w FROM asked JOIN dfs USING (term), whole),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))))::BIGINT AS score
  FROM weights JOIN posts USING (term) JOIN lens USING (doc_id), whole GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
