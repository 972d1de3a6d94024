"""Exact deduplication by a stateful stream over the files of a table.

The stream groups rows by the SHA-256 of their normalised text.  Its keyed state
lies on disk (RocksDB, with snapshots in the shared folder), never expires, and
holds for each digest the number of rows and, for the row that stays, its stable
identifier and the place of its content (file and row in it).  New files are
taken up by running it again over the same state.  Every row whose digest met
another is then compared with the content at that place, byte by byte; digests
with different contents are grouped again by their whole texts.

Normalised: A-Z lower-cased, nothing else; null counts as empty.  Of equal texts
the row with the largest id stays; a null id is less than any other, and of rows
with equal ids the one in the last place of the last file stays.

Everything is DataFrame and Structured Streaming; Python only starts the runs.
A text that fills a third of all rows is merged to one row a task before it is
shuffled, and is compared in as many tasks as the join's skew handling makes.

Defined cases: null and empty texts form one group; texts of any length; rows
repeated with their id are rows like any other, one of them stays; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh_path, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of files that a micro-batch takes up.
BATCH_BYTES = 64 << 30
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition's store takes megabytes of disk in advance
}
Digest = Callable[[F.Column], F.Column]


def normalised(text: F.Column) -> F.Column:
    """A-Z lower-cased; texts of ASCII alone take Spark's faster function."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(text: F.Column) -> F.Column:
    return F.coalesce(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)), F.lit(b""))  # never null, which spares a filter that computes it again


@contextmanager
def _on_disk(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _placed(files: DataFrame, id_col: str, text_col: str, digest: Digest) -> DataFrame:
    """id, text, digest and place {file, row} of every row."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    read = files.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("text"), at.alias("place"))
    return read.select("id", "text", digest(F.col("text")).alias("digest"), "place")


class Deduplication:
    """The state of one table's deduplication, kept in ``folder`` (shared by driver and executors)."""

    def __init__(self, spark: SparkSession, folder: str, *, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256):
        self.spark, self.folder, self.id_col, self.text_col, self.digest = spark, folder.rstrip("/"), id_col, text_col, digest

    def _read(self, path: str, reader, pattern: str | None = None) -> DataFrame:
        kinds = self.spark.read.parquet(path).schema
        wanted = T.StructType([kinds[self.id_col], kinds[self.text_col]])
        return _placed(reader.schema(wanted).parquet(pattern or path), self.id_col, self.text_col, self.digest)

    def take_up(self, path: str, *, batch_bytes: int = BATCH_BYTES, files: int | None = None) -> None:
        """Run the stream over the files of ``path`` that the state hasn't seen, in batches of ``batch_bytes`` (or ``files``)."""
        source = self.spark.readStream.option("maxFilesPerTrigger", files) if files else self.spark.readStream.option("maxBytesPerTrigger", batch_bytes)
        keeper = F.max(F.struct(F.col("id"), F.col("place"))).alias("keeper")
        pattern = f"{path[:-1]}[{path[-1]}]"  # since a plain path must be a folder
        groups = self._read(path, source, pattern).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), keeper)

        def emit(changed: DataFrame, batch: int) -> None:  # a batch that is run again writes the same folder again
            changed.write.mode("overwrite").parquet(f"{self.folder}/changed/batch={batch}")

        with _on_disk(self.spark):
            run = groups.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/state").foreachBatch(emit).trigger(availableNow=True).start()
            run.awaitTermination()

    def groups(self) -> DataFrame:
        """digest, n, keeper {id, place}: what the state holds; counts and keepers only grow, so the largest is the last."""
        place = "struct<file: string, row: bigint>"
        changed = self.spark.read.schema(f"digest binary, n long, keeper struct<id: bigint, place: {place}>, batch int").parquet(f"{self.folder}/changed")
        return changed.groupBy("digest").agg(F.max("n").alias("n"), F.max("keeper").alias("keeper"))

    def decisions(self, path: str) -> DataFrame:
        """id, keep_id, group_size, kept and text_sha256 for every row of ``path``, all of whose files have been taken up."""
        groups = stored(self.groups(), "exact-groups")
        rows = self._read(path, self.spark.read)
        hits = rows.join(groups.where("n > 1").select("digest", F.col("keeper.place").alias("first")), "digest")
        hits = stored(hits.select("digest", "id", "place", "text", (F.col("place") == F.col("first")).alias("first")), "exact-hits")
        content = hits.where("first").select("digest", F.col("text").alias("content"))
        collided = stored(hits.where("not first").join(content, "digest").where("text <> content").select("digest").distinct(), "exact-collided")
        sha = F.lower(F.hex(F.col("digest"))) if self.digest is sha256 else F.sha2(F.encode("text", "UTF-8"), 256)
        facts = rows.select("id", "digest", "place", sha.alias("text_sha256"))
        apart = None
        if not collided.isEmpty():  # texts that share a digest: grouped by digest and text
            own = hits.join(collided, "digest", "left_semi")
            by_text = own.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "place")).alias("keeper"))
            found = own.select("digest", "text", "id", "place").join(by_text, ["digest", "text"])
            apart = found.select("id", "keeper", "n", "place", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))
            facts, groups = facts.join(collided, "digest", "left_anti"), groups.join(collided, "digest", "left_anti")
        out = facts.join(groups, "digest").select("id", "keeper", "n", "place", "text_sha256")
        if apart is None:
            discard(hits, collided)
        else:
            out = out.unionByName(apart)
        return out.select("id", F.col("keeper.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("place") == F.col("keeper.place")).alias("kept"), "text_sha256")


def op13_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays: doc_id, keep_id, group_size, kept, text_sha256."""
    path = f"{sf_dir}/documents.parquet"
    work = Deduplication(spark, fresh_path(spark, "exact"))
    work.take_up(path)
    return work.decisions(path).withColumnRenamed("id", "doc_id")


OP13_SQL = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
