"""Deterministic selection: hash ranks, caps, windows of attempts, apportionment, keys, pages."""

from __future__ import annotations

import math
import random
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import stored

SEED, CASES_PER_SUBJECT, OVERSAMPLE, MIN_WINDOW = 1518, 3, 3, 8
#: Rows that a fold appends to one list.
FOLD = 512


def rank_key(subject: Column, seed: int = SEED, label: Column | None = None) -> Column:
    """sha256 of the canonical JSON of seed, subject and label, for values that need no JSON escape."""
    head = [F.lit("{")] + ([F.lit('"label":"'), label, F.lit('",')] if label is not None else [])
    return F.sha2(F.concat(*head, F.lit(f'"seed":{seed},"subject":"'), subject.cast("string"), F.lit('"}')), 256)


def pick_by_rank(df: DataFrame, group: list[str], subject: str, *taken: str, seed: int = SEED) -> DataFrame:
    """The row of each group with the least (hash rank, subject): an arg-min, merged before the shuffle."""
    row = F.struct(rank_key(F.col(subject), seed).alias("rank"), F.col(subject).cast("string").alias("_s"), F.col(subject), *taken)
    return df.groupBy(*group).agg(F.min(row).alias("r")).select(*group, "r.rank", f"r.{subject}", *[f"r.{t}" for t in taken])


def top_per_group(df: DataFrame, group: list[str], order: list[Column], cap: int, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= cap)


def attempt_window(target: int) -> int:
    return max(math.ceil(OVERSAMPLE * target), MIN_WINDOW)


def attempt_until(df: DataFrame, group: list[str], order: list[Column], success: Column, target: int) -> DataFrame:
    """Rows attempted in order until ``target`` succeed, within the attempt window; ``rn`` and ``ok`` appended."""
    w = Window.partitionBy(*group).orderBy(*order)
    first = df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= attempt_window(target)).withColumn("ok", success)
    done = F.coalesce(F.sum(F.col("ok").cast("int")).over(Window.partitionBy(*group).orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("_done", done).where(F.col("_done") < target).drop("_done")


def apportion(cells: list[tuple[str, Fraction | int]], seats: int) -> dict[str, int]:
    """Sequential Webster on exact fractions; ties to the earlier cell.  At most a few hundred cells."""
    held = {name: 0 for name, _ in cells}
    for _ in range(seats):
        best = max(range(len(cells)), key=lambda i: (Fraction(cells[i][1]) / (2 * held[cells[i][0]] + 1), -i))
        if cells[best][1] <= 0:
            break
        held[cells[best][0]] += 1
    return held


def apportion_rows(cells: DataFrame, name: str, share: str, seats: int) -> DataFrame:
    """The same for integer shares as a top-k of the priorities share / (2k + 1).

    Two different priorities differ by at least 1 / (2 * seats)^2, so quotients of
    eleven decimal places order them exactly up to 100,000 seats.
    """
    if seats > 100_000:
        raise ValueError("more seats than priorities can be told apart for")
    steps = cells.select(name, share, F.explode(F.sequence(F.lit(0), F.lit(seats - 1))).alias("k"))
    priority = F.col(share).cast("decimal(19,0)") / (2 * F.col("k") + 1).cast("decimal(10,0)")
    won = steps.where(F.col(share) > 0).orderBy(F.desc(priority), name).limit(seats).groupBy(name).agg(F.count("*").alias("seats"))
    return cells.select(name, share).join(won, name, "left").select(name, share, F.coalesce("seats", F.lit(0)).alias("seats"))


def allocate(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Largest remainder: whole parts, then one more by falling fraction (ties: key as text), capped by the count."""
    whole = Window.partitionBy(F.lit(0))  # the rows are sections: a handful
    t = F.sum(n).over(whole)
    part = (F.col(n) * total / t).alias("exact")
    with_part = counts.select(key, n, part).withColumn("base", F.floor("exact"))
    left = F.lit(total) - F.sum("base").over(whole)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("exact") - F.col("base")), F.col(key).cast("string")))
    return with_part.withColumn("left", left).withColumn("r", rank).select(key, n, F.least(F.col(n), F.col("base") + F.when(F.col("r") <= F.col("left"), 1).otherwise(0)).alias("quota"))


def sample_members(stubs: list, seed: int, section: str, quota: int) -> list:
    """Seeded membership sample in the given order (the standard library's generator)."""
    if quota >= len(stubs):
        return list(stubs)
    chosen = set(random.Random(f"{seed}:{section}").sample(range(len(stubs)), quota))
    return [s for i, s in enumerate(stubs) if i in chosen]


def greedy_budget(sizes: list[tuple[str, int]], budget: int) -> tuple[list[str], list[str]]:
    """(taken, skipped) in order; a family that would overflow is skipped, later smaller ones may fit."""
    taken, skipped, used = [], [], 0
    for name, n in sizes:
        if used + n <= budget:
            taken.append(name)
            used += n
        else:
            skipped.append(name)
    return taken, skipped


def greedy_budget_rows(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """The same fold per group, in one array expression; a group's list must fit a row.

    Its list is folded in pieces of FOLD rows: appending to one list would copy
    all rows before each row.
    """
    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("l"))
    entries = "array<struct<o:bigint,s:bigint,taken:boolean>>"
    none = F.array().cast(entries)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{entries}>").alias("out"))

    def step(acc, x):
        fits = acc["used"] + x["s"] <= budget
        return F.struct((acc["used"] + F.when(fits, x["s"]).otherwise(0)).alias("used"), F.concat(acc["out"], F.array(F.struct(x["o"].cast("long").alias("o"), x["s"].alias("s"), fits.alias("taken")))).alias("out"))

    def piece(acc, xs):
        # the piece's fold once, then its list behind the others
        done = F.transform(F.array(F.aggregate(xs, F.struct(acc["used"].alias("used"), none.alias("out")), step)), lambda f: F.struct(f["used"].alias("used"), F.concat(acc["out"], F.array(f["out"])).alias("out")))
        return F.element_at(done, 1)

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / FOLD).cast("int")), lambda i: F.slice("l", i * FOLD + 1, F.lit(FOLD)))
    folded = rows.select(group, F.flatten(F.aggregate(pieces, start, piece)["out"]).alias("out"))
    return folded.select(group, F.explode("out").alias("x")).select(group, F.col("x.o").alias(order), F.col("x.s").alias(size), "x.taken")


def variant(rank: Column, n: int) -> Column:
    """First eight hex digits of a rank, modulo n."""
    return F.conv(F.substring(rank, 1, 8), 16, 10).cast("long") % n


def surrogate_keys(df: DataFrame, group: list[str], order: list[Column], start: Column) -> DataFrame:
    return df.withColumn("new_key", start + F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def total_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place from 1 in the whole order: sorted in ranges, whose row counts before are added.

    The sorted rows are written to the shared folder, so both reads see the same ranges.
    """
    spark = df.sparkSession
    placed = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "order")  # range number << 33 | place in the range
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    before, starts = 0, []
    for r in sorted(placed.groupBy("_range").agg(F.count("*").alias("n")).collect()):  # a row a range
        starts.append((r["_range"], before))
        before += r["n"]
    offsets = spark.createDataFrame(starts, "_range long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(offsets), "_range").withColumn(name, place).drop("_range", "_at", "_before")


def free_position(df: DataFrame, group: str, taken: Column, most: int = 98) -> DataFrame:
    """Smallest number of 1..most that the group does not use (null if none is free)."""
    used = df.groupBy(group).agg(F.collect_set(F.when(taken.between(1, most), taken)).alias("used"))
    return used.select(group, F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(most)), F.col("used").cast("array<int>"))).alias("free"))


def key_order(key: Column) -> list[Column]:
    """Decimal keys first by number, others after by text."""
    decimal = key.rlike("^[0-9]+$")
    digits = F.when(decimal, F.regexp_replace(key, "^0+(?=.)", ""))
    return [(~decimal).asc(), F.length(digits).asc_nulls_last(), digits.asc_nulls_last(), key.asc()]


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A window of a totally ordered listing with the listing's total on each row; limit 0 gives no rows."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative; pass 0 or more")
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))
