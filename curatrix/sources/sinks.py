"""Sinks: ordered canonical lines, content-addressed blobs, refusal of secrets, all-or-nothing folders."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import text


class SecretFound(ValueError):
    """A payload holds a secret; nothing was written."""


def refuse_secrets(lines: DataFrame, column: str, secrets: list[str]) -> None:
    hit = F.lit(False)
    for s in secrets:
        if s:
            hit = hit | F.col(column).contains(s)
    if not lines.where(hit).isEmpty():
        raise SecretFound("the output holds a secret; nothing was written")


def redact(c: Column, secrets: list[str], mark: str = "***") -> Column:
    """Longest first, so no secret hides behind a part of it."""
    for s in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
        c = F.replace(c, F.lit(s), F.lit(mark))
    return c


def canonical_lines(df: DataFrame, order: list, ignore_nulls: bool = False) -> DataFrame:
    """One canonical JSON object a row, in total order."""
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": str(ignore_nulls).lower()})
    return df.orderBy(*order).select(text.canonical_json(body).alias("value"))


def write_lines(lines: DataFrame, path: str, *, secrets: list[str] | None = None, single: bool = False) -> None:
    """Text lines to a folder that appears whole or not at all: written beside it and renamed."""
    spark = lines.sparkSession
    if secrets:
        refuse_secrets(lines, "value", secrets)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stage = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    (lines.coalesce(1) if single else lines).write.text(stage)
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (stage, path))
    system = target.getFileSystem(conf)
    if system.exists(target) or not system.rename(source, target):
        system.delete(source, True)
        raise FileExistsError(f"{path} exists; choose another folder or remove it")


def put_blobs(spark: SparkSession, content: DataFrame, path: str) -> int:
    """Append (content binary) rows that are not stored yet, by sha256; how many were new."""
    rows = content.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        rows = rows.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def digest_of(lines: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """sha256 and bytes of each group's lines in order, each ended by a line feed.

    A secondary sort: partitions hold whole groups in order, and a digest takes
    line after line, so a group of any size needs no more memory than a line.
    """
    kinds = to_arrow_schema(StructType([lines.schema[g] for g in group] + [StructField("sha256", StringType()), StructField("bytes", LongType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(key, found, n):
            return pa.RecordBatch.from_pylist([dict(zip(group, key, strict=True)) | {"sha256": found.hexdigest(), "bytes": n}], kinds)

        last, found, n = None, hashlib.sha256(), 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(len(group))]
            for *key, value in zip(*columns, batch.column(len(group)).cast(pa.binary()), strict=True):
                key = tuple(key)
                if last is not None and key != last:
                    yield finished(last, found, n)
                    found, n = hashlib.sha256(), 0
                last, line = key, (value.as_py() or b"") + b"\n"
                found.update(line)
                n += len(line)
        if last is not None:
            yield finished(last, found, n)

    dealt = lines.repartition(*group).sortWithinPartitions(*group, *order).select(*group, "value")
    schema = StructType([*[lines.schema[g] for g in group], StructField("sha256", StringType()), StructField("bytes", LongType())])
    return dealt.mapInArrow(run, schema)
