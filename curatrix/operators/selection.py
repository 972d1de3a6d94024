"""Exact order statistics and samples a group, merged before any shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import rank_key
from .stage import discard, stored

#: Bins of a round; a group's range shrinks by this factor at least.
BINS = 1024


def percentiles(df: DataFrame, group: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """``group`` and, for each name, the exact percentile (interpolated between neighbours) of the values that aren't null.

    Rounds of histograms: the rows are counted in bins between the least and the
    largest value that a wanted rank can still have, and the bin that holds the
    rank becomes the next range, until it is a single value.  A task sends a row a
    bin, never the values; a group without values has nulls.
    """
    keys = [F.coalesce(F.to_json(F.struct(*group)), F.lit("")) if group else F.lit("")]
    rows = df.select(*group, keys[0].alias("_g"), F.col(value).cast("double").alias("_v"))
    named = stored(rows.groupBy("_g", *group).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "percentile-groups")
    place = {n: (F.col("_n") - 1) * F.lit(float(p)) for n, p in wanted.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in place.values()])))
    state = stored(named.where("_n > 0").select("_g", F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_below"), F.col("_lo").alias("_from"), F.col("_hi").alias("_to")), "percentile-state")
    while not (left := state.where("_from < _to")).isEmpty():
        inside = rows.where("_v is not null").join(left, "_g").where("_v >= _from and _v <= _to")
        step = F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from")) * BINS)).cast("int")
        counted = inside.groupBy("_g", "_rank", "_below", step.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        upto = F.sum("_c").over(Window.partitionBy("_g", "_rank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))  # BINS rows
        found = counted.withColumn("_upto", F.col("_below") + upto).where("_upto > _rank and _upto - _c <= _rank")
        narrowed = found.select("_g", "_rank", (F.col("_upto") - F.col("_c")).alias("_below"), "_from", "_to")
        state, was = stored(state.where("_from >= _to").unionByName(narrowed), "percentile-state"), state
        discard(was)
    values = state.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_from"))).alias("_at"))  # two ranks a percentile
    at = lambda x: F.try_element_at(F.col("_at"), x)

    def between(x):
        low, high = F.floor(x), F.ceil(x)
        return F.when(low == high, at(low)).otherwise((high - x) * at(low) + (x - low) * at(high))

    return named.join(values, "_g", "left").select(*group, *[F.when(F.col("_n") > 0, between(x)).alias(n) for n, x in place.items()])


def bottom_k(df: DataFrame, group: list[str], subject: str, k: int) -> DataFrame:
    """The ``k`` rows of each group with the least hash rank of their subject: the same however the rows are dealt.

    The window's limit runs in each task before the shuffle, so a group sends ``k`` rows a task.
    """
    order = Window.partitionBy(*group).orderBy("_rank", F.col(subject).cast("string"))
    ranked = df.withColumn("_rank", rank_key(F.col(subject))).withColumn("_rn", F.row_number().over(order))
    return ranked.where(F.col("_rn") <= k).drop("_rank", "_rn")


#: What tells sections of audiobooks from music.
SAMPLE, SHARE, LONG_MS = 40, 0.5, 600_000.0


def sampled_types(tracks: DataFrame, section: str, subject: str, packaged, duration, marked) -> DataFrame:
    """Per section: sampled, population, share, median, matches, from ``SAMPLE`` tracks; a marked agent decides alone, else both signals must fire."""
    whole = tracks.groupBy(section).agg(F.count("*").alias("population"), F.bool_or(marked).alias("marked"))
    some = bottom_k(tracks.withColumns({"_packaged": packaged, "_duration": duration}), [section], subject, SAMPLE)
    seen = some.groupBy(section).agg(F.count("*").alias("sampled"), F.avg(F.coalesce("_packaged", F.lit(False)).cast("double")).alias("share"), F.coalesce(F.median("_duration"), F.lit(0.0)).alias("median"))  # SAMPLE values
    return whole.join(seen, section).withColumn("matches", F.col("marked") | ((F.col("share") >= SHARE) & (F.col("median") >= LONG_MS)))
