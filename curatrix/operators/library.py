"""Can a set of records be served as one library?  Eight rules, each a set of violations (rule, subject, path)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels of live servers, and the kinds a section type can hold.
LIVE = ("plex",)
SECTION_KINDS = {"movie": ("movie",), "show": ("show", "season", "episode"), "artist": ("author", "audiobook", "audiobook_part")}


def snapshot_violations(items: DataFrame, sections: DataFrame, provider: str, profile: str = "full") -> DataFrame:
    """(rule, subject, path) for records to be served under ``provider``.

    items: item_key ``provider:section:key``, parent_key, grandparent_key,
    section_id, media_kind, fetched.  sections: section_id, section_type.
    """
    types = F.create_map(*[x for t, ks in SECTION_KINDS.items() for x in (F.lit(t), F.array(*map(F.lit, ks)))])
    own = lambda c: F.col(c).isNotNull() & (F.substring_index(c, ":", 1) != provider)
    held = F.broadcast(sections.groupBy("section_id").agg(F.max("section_type").alias("_type")).withColumnRenamed("section_id", "_sid"))  # a row a section
    rows = items.join(held, F.col("section_id") == F.col("_sid"), "left")
    holds = F.coalesce(F.array_contains(F.try_element_at(types, F.col("_type")), F.col("media_kind")), F.lit(False))
    rules = {
        ("provider_label", "/item_id"): own("item_key"),
        ("provider_label", "/parent"): own("parent_key"),
        ("provider_label", "/grandparent"): own("grandparent_key"),
        ("unknown_section", "/section"): F.col("_sid").isNull(),
        ("section_kind", "/media_kind"): F.col("_sid").isNotNull() & ~holds,
        ("profile", "/fetched"): ~F.col("fetched").eqNullSafe(F.lit(profile)),
    }
    broken = F.filter(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(p).alias("path"))) for (r, p), c in rules.items()]), lambda x: x.isNotNull())
    of_items = rows.select("item_key", F.explode(broken).alias("v")).select("v.rule", F.col("item_key").alias("subject"), "v.path")
    counts = sections.groupBy("section_id").agg(F.count("*").alias("n")).where("n > 1")
    twice = counts.select("section_id", F.explode(F.sequence(F.lit(2).cast("long"), "n"))).select(F.lit("duplicate_section").alias("rule"), F.col("section_id").alias("subject"), F.lit("").alias("path"))  # one for each listing after the first
    odd = sections.where(~F.coalesce(F.col("section_type").isin(*SECTION_KINDS), F.lit(False))).select(F.lit("unmodelled_section"), "section_id", F.lit(""))
    key = F.element_at(F.split("item_key", ":"), -1)
    spread = items.groupBy(key.alias("k")).agg(F.min("section_id").alias("a"), F.max("section_id").alias("b")).where("a < b").select(F.lit("duplicate_rating_key"), "k", F.lit(""))
    out = of_items.union(twice).union(odd).union(spread)
    if provider in LIVE:
        out = out.union(items.sparkSession.createDataFrame([("live_provider", provider, "")], "rule string, subject string, path string"))
    return out


def first_violations(violations: DataFrame, cap: int = 10) -> DataFrame:
    """The first ``cap`` violations in order, with the number of all."""
    total = violations.agg(F.count("*").alias("total"))
    return violations.orderBy("rule", "subject", "path").limit(cap).crossJoin(F.broadcast(total))  # one row
