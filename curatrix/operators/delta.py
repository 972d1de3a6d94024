"""Row-level deltas: diff of two row sets, application with preconditions, reversal.

A change is (key, kind, path, before, after); values are compared as strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leaves(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, path, value) for each column; one projection and explode, no reshuffle."""
    rows = F.array(*[F.struct(F.lit(f"/{c}").alias("path"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.col(key).alias("key"), F.explode(rows).alias("x")).select("key", "x.path", "x.value")


def row_delta(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer join on the key: remove, add, and one modify per column that differs (null-safe)."""
    b = before.select(F.col(key).alias("_b"), *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    a = after.select(F.col(key).alias("_a"), *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    both = b.join(a, F.col("_b") == F.col("_a"), "full_outer")
    kind = F.when(F.col("_a").isNull(), "remove").when(F.col("_b").isNull(), "add").otherwise("modify")
    entry = lambda path, x, y: F.struct(F.lit(path).alias("path"), x.alias("before"), y.alias("after"))
    none = F.lit(None).cast("string")
    fields = F.filter(F.array(*[F.when(~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}")), entry(f"/{c}", F.col(f"b_{c}"), F.col(f"a_{c}"))) for c in columns]), lambda x: x.isNotNull())
    whole = F.array(entry("", none, none))
    return both.select(F.coalesce("_b", "_a").alias("key"), kind.alias("kind"), F.explode(F.when(kind == "modify", fields).otherwise(whole)).alias("x")).select("key", "kind", "x.path", "x.before", "x.after")


def _apply(rows: DataFrame, changes: DataFrame, added: DataFrame, key: str, columns: list[str], old: str, new: str, remove: str, add: str, removed: DataFrame | None) -> DataFrame:
    """One full outer join of the rows with one row of changes a key; what a change presumes and doesn't find raises."""
    own = changes.groupBy(F.col("key").alias("_key")).agg(
        F.bool_or(F.col("kind") == remove).alias("_remove"),
        F.bool_or(F.col("kind") == add).alias("_add"),
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == "modify", F.struct("path", F.struct(F.col(old).alias("o"), F.col(new).alias("n")))))).alias("_m"),
    )
    named = {c: f"_row{i}" for i, c in enumerate(rows.columns)}
    at = lambda c: F.col(named[c])
    base = rows.select(*[F.col(c).alias(n) for c, n in named.items()], F.lit(True).alias("_there"))
    fresh = added.select(F.col(key).alias("_newkey"), F.struct(*[F.col(c) for c in rows.columns]).alias("_new"))
    # records join the changes, whose keys are never null: after the outer join all unchanged rows would meet in one task
    own = own.join(fresh, F.col("_add") & (F.col("_key") == F.col("_newkey")), "left")
    if removed is not None:
        gone = removed.select(F.col(key).alias("_oldkey"), F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("_old"))
        own = own.join(gone, F.col("_remove") & (F.col("_key") == F.col("_oldkey")), "left")
    both = base.join(own, at(key) == F.col("_key"), "full_outer")
    there, what = F.coalesce("_there", F.lit(False)), F.coalesce(F.col("_key").cast("string"), at(key).cast("string"))
    wrong = F.when(F.col("_add") & there, F.concat(F.lit("already there, can't be added: "), what)).when(F.col("_add") & F.col("_newkey").isNull(), F.concat(F.lit("added without a record: "), what))
    wrong = wrong.when(F.col("_remove") & ~there, F.concat(F.lit("not there, can't be removed: "), what)).when(F.col("_key").isNotNull() & ~F.col("_add") & ~F.col("_remove") & ~there, F.concat(F.lit("not there, can't be changed: "), what))
    if removed is not None:
        same = F.struct(*[at(c).cast("string").alias(c) for c in columns]).eqNullSafe(F.col("_old"))
        wrong = wrong.when(F.col("_remove") & F.col("_oldkey").isNotNull() & ~same, F.concat(F.lit("another record than the one to remove: "), what))

    def value(c: str):
        kind, hit = rows.schema[c].dataType, F.try_element_at(F.col("_m"), F.lit(f"/{c}"))
        found = F.when(hit.isNull(), at(c)).when(~at(c).cast("string").eqNullSafe(hit["o"]), F.raise_error(F.concat(F.lit(f"precondition failed at /{c} of "), what)).cast(kind)).otherwise(hit["n"].cast(kind))
        return F.when(F.col("_add"), F.col(f"_new.{c}")).otherwise(found if c in columns else at(c))

    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(~F.coalesce("_remove", F.lit(False)))
    return both.where(checked).select(*[value(c).alias(c) for c in rows.columns])


def apply_delta(before: DataFrame, changes: DataFrame, after_rows: DataFrame, key: str, columns: list[str], removed: DataFrame | None = None) -> DataFrame:
    """``before`` with the changes applied; ``after_rows`` holds the records of added keys, ``removed`` (if given) those to take away.

    Raises where a value is another than the recorded one, where a key to change
    or remove is missing or a key to add is there, where an added key has no
    record, and where a removed record differs from the recorded one.
    """
    return _apply(before, changes, after_rows, key, columns, "before", "after", "remove", "add", removed)


def reverse_delta(after: DataFrame, changes: DataFrame, before_rows: DataFrame, key: str, columns: list[str], removed: DataFrame | None = None) -> DataFrame:
    return _apply(after, changes, before_rows, key, columns, "after", "before", "add", "remove", removed)


def invalid_changes(changes: DataFrame) -> DataFrame:
    """Changes that are malformed: wildcard or unparsable path, no-op, wrong shape for the kind, a path twice."""
    path = F.col("path")
    own = changes.withColumn("reason", F.when(path.rlike(r"(^|/)\*(/|$)"), "wildcard").when((path != "") & ~path.startswith("/"), "pointer").when((F.col("kind") == "modify") & F.col("before").eqNullSafe(F.col("after")), "no_op").when((F.col("kind") != "modify") & (path != ""), "shape"))
    twice = changes.where("kind = 'modify'").groupBy("key", "path").agg(F.count("*").alias("n")).where("n > 1").select("key", "path", F.lit("path_twice").alias("reason"))
    return own.where("reason is not null").select("key", "path", "reason").union(twice)
