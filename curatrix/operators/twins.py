"""Duplicate and near-name detection by grouping and blocking, never by raw pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import rank_key


def twin_groups(df: DataFrame, keys: list[Column], member: str) -> DataFrame:
    """Rows that share all keys with another row (nulls equal nulls and nothing else), with the size of their group.

    Groups are counted with merged partial counts and joined back, so a large
    group is split by adaptive execution, not windowed in one task.
    """
    named = df.select(member, F.to_json(F.array(*[k.cast("string") for k in keys])).alias("_keys"))  # a null is no text there
    ks = ["_keys"]
    sizes = named.groupBy(*ks).agg(F.count("*").alias("group_size")).where("group_size > 1")
    return named.join(sizes, ks).drop(*ks)


def remake_pairs(df: DataFrame, title: str, year: str, member: str) -> DataFrame:
    """Rows with another row of the same title and a different, known year."""
    years = df.where(F.col(title).isNotNull() & F.col(year).isNotNull()).groupBy(title).agg(F.min(year).alias("_lo"), F.max(year).alias("_hi")).where("_lo < _hi")
    return df.where(F.col(year).isNotNull()).join(years, title).select(member, title, year)


def donors(df: DataFrame, group: list[str], title: str, member: str) -> DataFrame:
    """For each row the best-ranked row of its group with another title.

    Two minima per group suffice: the best row, and the best row whose title is
    not the best row's; no pairs are formed.
    """
    ranked = df.select(*group, title, member, rank_key(F.col(member)).alias("_rank"))
    per_title = ranked.groupBy(*group, title).agg(F.min(F.struct("_rank", F.col(member).alias("m"))).alias("best"))
    entry = F.struct("best._rank", "best.m", F.col(title).alias("t"))
    first = per_title.groupBy(*group).agg(F.min(entry).alias("one"))
    second = per_title.join(first, group).where(F.col(title) != F.col("one.t")).groupBy(*group).agg(F.min(entry).alias("two"))
    both = first.join(second, group, "left")
    return df.select(*group, title, member).join(both, group).select(member, F.when(F.col(title) == F.col("one.t"), F.col("two.m")).otherwise(F.col("one.m")).alias("donor")).where("donor is not null")


def blocked_pairs(df: DataFrame, member: str, keys: Column) -> DataFrame:
    """Candidate pairs (lo, hi) of rows sharing a blocking key, each once.

    A block's pairs are its rows' comparisons, so keys must be selective; the
    join on the key lets adaptive execution split a large block.  A pair comes
    from the first key that both rows have, so pairs are never shuffled: what
    moves is one row a member and key.
    """
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: the rows are few for their pairs, and would be merged into a few tasks
    exploded = _blocks_of(df, member, keys).select("m", "ks", F.explode("ks").alias("block")).repartition(spread, "block")
    l, r = (exploded.select(F.col("m").alias(m), F.col("ks").alias(f"_{m}"), "block") for m in ("lo", "hi"))  # noqa: E741
    first = F.get(F.array_intersect("_lo", "_hi"), F.lit(0)) == F.col("block")
    return l.join(r, "block").where(F.col("lo") < F.col("hi")).where(first).select("lo", "hi")


def _blocks_of(df: DataFrame, member: str, keys: Column) -> DataFrame:
    """m, ks: every member once, with its distinct keys in order."""
    each = df.where(F.col(member).isNotNull()).select(F.col(member).alias("m"), F.filter(F.array_distinct(keys), lambda k: k.isNotNull()).alias("ks"))
    return each.groupBy("m").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ks")))).alias("ks"))  # a member's keys


#: Keys of a member up to which its pairs are counted by sets of keys, 2^n - 1 of them.
MOST_KEYS = 8


def count_pairs(df: DataFrame, member: str, keys: Column) -> DataFrame:
    """One row, pairs_resolved: how many pairs blocked_pairs has, without making them.

    For every set of keys the members that have all of them are counted; the
    pairs of a set of odd size are added, those of even size taken away.
    Members with more than MOST_KEYS keys are paired as blocked_pairs does it.
    """
    owned = _blocks_of(df, member, keys).where(F.size("ks") > 0)
    grown = F.aggregate("ks", F.array(F.array().cast("array<string>")), lambda acc, k: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(k.cast("string"))))))
    few = F.size("ks") <= MOST_KEYS
    sets = owned.where(few).select(F.explode(grown).alias("s")).where(F.size("s") > 0).groupBy("s").agg(F.count("*").alias("n"))
    sign = F.when(F.size("s") % 2 == 1, F.lit(1)).otherwise(F.lit(-1))
    counted = sets.agg(F.coalesce(F.sum(sign * F.expr("n * (n - 1) div 2")), F.lit(0)).alias("n"))
    many = owned.where(~few).select("m", "ks", F.explode("ks").alias("block"))
    other = owned.select(F.col("m").alias("o"), F.col("ks").alias("_o"), F.explode("ks").alias("block"))
    first = F.get(F.array_intersect("ks", "_o"), F.lit(0)) == F.col("block")
    rest = many.join(other, "block").where(first & ((F.size("_o") <= MOST_KEYS) | (F.col("m") < F.col("o")))).agg(F.count("*").alias("n"))
    return counted.union(rest).agg(F.sum("n").alias("pairs_resolved"))


def blocking_stats(df: DataFrame, member: str, keys: Column, pairs: DataFrame | None = None) -> DataFrame:
    """population, buckets, pairs_possible, pairs_resolved, pairs_skipped; ``pairs``: those of blocked_pairs, if at hand."""
    n = df.agg(F.count("*").alias("population"))
    exploded = df.select(F.explode(F.array_distinct(keys)).alias("block")).where("block is not null")
    buckets = exploded.agg(F.count_distinct("block").alias("buckets"))
    resolved = count_pairs(df, member, keys) if pairs is None else pairs.agg(F.count("*").alias("pairs_resolved"))
    possible = F.expr("population * (population - 1) div 2")
    return n.crossJoin(buckets).crossJoin(resolved).select("population", "buckets", possible.alias("pairs_possible"), "pairs_resolved", (possible - F.col("pairs_resolved")).alias("pairs_skipped"))  # three rows of one


def collateral(df: DataFrame, changed: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Outside rows that share a key with a changed row's old or new values."""
    touched = changed.select(member).distinct()
    return df.join(touched, member, "left_anti").join(changed.select(*keys).distinct(), keys, "left_semi").select(member, *keys)
