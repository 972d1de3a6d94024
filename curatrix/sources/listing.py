"""Paged listings of a library: stored by section and page, read with a projection profile.

A page is a folder, so a filter on section or page prunes files and a profile
prunes columns; ``crawl`` reads a listing only after every page of it is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import key_order, total_order
from ..operators.stage import stored

#: Columns of each profile; core leaves out what needs another request.
STUB = ("item_key", "media_kind", "title", "year")
LEFT_OUT = {"stub": None, "core": ("parts", "locked_fields"), "files": ("locked_fields",), "full": ()}


class IncompleteListing(ValueError):
    """Pages are missing, or disagree on how much there is."""


def write_pages(items: DataFrame, path: str, size: int, *, order: list | None = None) -> None:
    """Items in listing order by section, ``size`` to a page, each with its place and the section's total.

    Places come from one range-partitioned sort; a section of any size is dealt over tasks.
    """
    if size < 1:
        raise ValueError("a page holds at least one item; pass 1 or more")
    placed = stored(total_order(items, [F.col("section_id").asc(), *(order or key_order(F.col("item_key")))], "_place"), "listing")
    sections = placed.groupBy("section_id").agg(F.min("_place").alias("_first"), F.count("*").alias("total"))
    rows = placed.join(sections, "section_id").withColumn("place", F.col("_place") - F.col("_first")).drop("_place", "_first")
    rows = rows.withColumn("page", F.floor(F.col("place") / size).cast("int"))
    rows.repartition("section_id", "page").sortWithinPartitions("section_id", "page", "place").write.partitionBy("section_id", "page").parquet(path)


def read_pages(spark: SparkSession, path: str, profile: str = "full") -> DataFrame:
    """The listing's rows with the profile's columns and ``fetched``; section_id and page are partitions."""
    if profile not in LEFT_OUT:
        raise ValueError(f"no profile {profile!r}; use one of {', '.join(LEFT_OUT)}")
    rows = spark.read.option("basePath", path).parquet(path)
    out = LEFT_OUT[profile]
    own = STUB if out is None else [c for c in rows.columns if c not in (*out, "section_id", "page", "place", "total", "fetched")]
    fetched = "stub" if out is None else profile
    return rows.select(F.col("section_id").cast("string").alias("section_id"), "page", "place", "total", *own, F.lit(fetched).alias("fetched"))


def missing_pages(listing: DataFrame) -> DataFrame:
    """section_id, found, total of the sections whose places aren't exactly 0 to total - 1."""
    per = listing.groupBy("section_id").agg(F.count("*").alias("found"), F.count_distinct("place").alias("_d"), F.min("place").alias("_lo"), F.max("place").alias("_hi"), F.max("total").alias("total"), F.min("total").alias("_t"))
    whole = (F.col("found") == F.col("total")) & (F.col("_d") == F.col("total")) & (F.col("_lo") == 0) & (F.col("_hi") == F.col("total") - 1) & (F.col("_t") == F.col("total"))
    return per.where(~whole).select("section_id", "found", "total")


def crawl(spark: SparkSession, path: str, profile: str = "full") -> DataFrame:
    """All items of a listing; a page that is missing or doubled raises."""
    rows = read_pages(spark, path, profile)
    bad = missing_pages(rows).orderBy("section_id").limit(5).collect()
    if bad:
        raise IncompleteListing("; ".join(f"section {r.section_id}: {r.found} of {r.total}" for r in bad))
    return rows
