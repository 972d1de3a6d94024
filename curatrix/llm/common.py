"""Shared plumbing: durable intermediate tables, components, text helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stage import shuffles_removed


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (master ``local``) gets a fresh
    temporary folder, removed at its end; a cluster session raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, for readers that don't know Spark's default one."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    full = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, and lost executors cost only a reread."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove tables that ``stored`` wrote and that nothing still to be run reads."""
    for t in tables:
        if (path := getattr(t, "stored_at", None)) is not None:
            context = t.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a small table that one task writes in a round of components().
ROWS_A_TASK = 100_000


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Distributed union-find: (a, b) links -> (node, root), root the smallest node of its component.

    Rounds of contraction: every node with a smaller neighbour hooks to the
    smallest one (a forest, since parents are smaller), pointer jumping takes
    all to their roots, and links are relabelled until none joins two roots.
    Only per-key minima and equi joins run, so no node's neighbours are ever
    gathered; nodes without a link are absent.  Null ends and loops are ignored.
    The number of tasks of a round follows the number of links left.
    """
    ends = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    links = stored(ends.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), f"{name}-links")
    labels: DataFrame | None = None
    while left := links.count():
        tasks = max(8, -(-2 * left // ROWS_A_TASK))
        written = stored(links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")).coalesce(tasks), f"{name}-hooks")
        while True:  # three levels a pass
            hooks = written.select("node", "root")
            one, two = (hooks.toDF(f"_n{k}", f"_r{k}") for k in (1, 2))
            jumped = hooks.join(one, F.col("root") == F.col("_n1"), "left").join(two, F.col("_r1") == F.col("_n2"), "left")
            before, written = written, stored(jumped.select("node", F.coalesce("_r2", "_r1", "root").alias("root"), F.col("_r2").isNotNull().alias("moved")).coalesce(tasks), f"{name}-jump")
            discard(before)
            if written.where("moved").isEmpty():
                break
        hooks = written.select("node", "root")
        old = labels
        if labels is None:
            first = links.select(F.col("lo").alias("node")).union(links.select("hi")).distinct()
            labels = stored(first.join(hooks, "node", "left").select("node", F.coalesce("root", "node").alias("root")).coalesce(tasks), f"{name}-labels")
        else:
            labels = stored(labels.join(hooks.toDF("root", "above"), "root", "left").select("node", F.coalesce("above", "root").alias("root")).coalesce(tasks), f"{name}-labels")
        lo, hi = hooks.toDF("lo", "lo_root"), hooks.toDF("hi", "hi_root")
        ends = links.join(lo, "lo", "left").join(hi, "hi", "left").select(F.coalesce("lo_root", "lo").alias("a"), F.coalesce("hi_root", "hi").alias("b")).where("a <> b")
        used, links = links, stored(ends.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct().coalesce(tasks), f"{name}-links")
        discard(used, written, old)
    return links.toDF("node", "root") if labels is None else labels


def joined_components(first: DataFrame, more: DataFrame, name: str) -> DataFrame:
    """``first`` (node, root) continued with links (a, b) between roots: the same columns, for old and new nodes."""
    above = components(more, name).toDF("root", "above")
    moved = first.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return stored(moved.union(above.join(first.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("above").alias("root"))), f"{name}-all")
