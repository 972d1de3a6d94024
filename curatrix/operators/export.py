"""Choosing a slice of a catalogue: quotas by section, members by hash rank, whole families within a budget of records.

Membership is by hash rank per section, so it depends on neither order nor
partitioning, and another section changes nothing.  (A pseudo-random draw over a
sorted listing would need the listing in one place.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import allocate, greedy_budget, rank_key

MAX_ROOTS, MAX_RECORDS, SEED = 200, 5000, 1518


def chosen_roots(roots: DataFrame, total: int = MAX_ROOTS, seed: int = SEED) -> DataFrame:
    """section_id, item_key, rn of the roots within their section's quota."""
    quotas = F.broadcast(allocate(roots.groupBy("section_id").agg(F.count("*").alias("n")), "section_id", "n", total).select("section_id", "quota"))  # a row a section
    w = Window.partitionBy("section_id").orderBy(rank_key(F.col("item_key"), seed), "item_key")
    return roots.select("section_id", "item_key").withColumn("rn", F.row_number().over(w)).join(quotas, "section_id").where("rn <= quota").select("section_id", "item_key", "rn")


def families(items: DataFrame, chosen: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """root_key, section_id, size, complete: a family lacks a member if a listed child (item_key, root_key) has no record."""
    size = items.groupBy("root_key").agg(F.count("*").alias("size"))
    out = chosen.select("section_id", F.col("item_key").alias("root_key")).join(size, "root_key", "left")
    if listed is None:
        return out.select("root_key", "section_id", F.coalesce("size", F.lit(0)).alias("size"), F.col("size").isNotNull().alias("complete"))
    lost = listed.join(items.select("item_key"), "item_key", "left_anti").select("root_key").distinct().withColumn("_lost", F.lit(True))
    return out.join(lost, "root_key", "left").select("root_key", "section_id", F.coalesce("size", F.lit(0)).alias("size"), (F.col("size").isNotNull() & F.col("_lost").isNull()).alias("complete"))


def within_budget(found: DataFrame, max_records: int = MAX_RECORDS) -> tuple[list[str], list[tuple[str, str]]]:
    """(root keys kept, (root key, reason) dropped): families in order of section and key, skipping what would overflow.

    The rows are chosen roots, at most the quota of all sections together.
    """
    rows = found.orderBy("section_id", "root_key").collect()
    lost = [(r["root_key"], "member_missing") for r in rows if not r["complete"]]
    kept, over = greedy_budget([(r["root_key"], r["size"]) for r in rows if r["complete"]], max_records)
    return kept, lost + [(k, "max_records") for k in over]


def export(items: DataFrame, roots: DataFrame, *, total: int = MAX_ROOTS, max_records: int = MAX_RECORDS, seed: int = SEED, listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records of the kept families, dropped families with their reason)."""
    spark = items.sparkSession
    kept, dropped = within_budget(families(items, chosen_roots(roots, total, seed), listed), max_records)
    keys = F.broadcast(spark.createDataFrame([(k,) for k in kept], "root_key string"))  # at most ``total`` rows
    return items.join(keys, "root_key", "left_semi"), spark.createDataFrame(dropped, "root_key string, reason string")
