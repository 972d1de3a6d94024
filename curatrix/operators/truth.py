"""What a repair must achieve: expectations derived from edits, and their evaluation.

All as long tables: a postcondition is (case_id, item_key, path, op, value,
excludes, tier).  Values are JSON texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pointer, text

# Fields a repair is judged by, and fields derived after it.
HARD = ("/title", "/title_sort", "/year", "/guids", "/index", "/parent_index", "/series", "/series_position", "/edition_title", "/content_rating", "/studio")
SOFT = ("/summary", "/parent", "/parent_title", "/grandparent", "/grandparent_title", "/child_count", "/leaf_count", "/album_count", "/part_count", "/parts/*/path", "/has_thumb", "/has_art")
FLOOR = ("/parts/*/path",)


def tier(path: Column) -> Column:
    """hard or soft by the generalised path; a path in neither list is an error."""
    g = pointer.generalize(path)
    return F.when(path == "", "soft").when(g.isin(*HARD), "hard").when(g.isin(*SOFT), "soft").otherwise(F.raise_error(F.concat(F.lit("no tier for "), path)).cast("string"))


_GUIDS = "array<struct<namespace:string,value:string,season:int,episode:int>>"


def _labels(json: Column) -> Column:
    number = lambda c: F.coalesce(F.concat(F.lit("/"), c.cast("string")), F.lit(""))
    return F.transform(F.coalesce(F.from_json(json, _GUIDS), F.array().cast(_GUIDS)), lambda g: F.concat(g["namespace"], F.lit("://"), g["value"], number(g["season"]), F.when(g["season"].isNotNull(), number(g["episode"])).otherwise("")))


def postconditions(edits: DataFrame) -> DataFrame:
    """Modified fields of existing items are back to the truth; removed items are present again; added items ask nothing."""
    guids, none = F.col("path") == "/guids", F.lit(None).cast("string")
    op = F.when(F.col("kind") == "remove", "non_empty").when(guids, "contains").when(F.col("before") == "null", "absent").when(F.col("before").startswith('"'), "normalized_equals").otherwise("equals")
    value = F.when(guids, F.to_json(_labels(F.col("before")))).when(op.isin("absent", "non_empty"), none).otherwise(F.col("before"))
    excludes = F.when(guids, F.array_sort(F.array_except(_labels(F.col("after")), _labels(F.col("before"))))).otherwise(F.array().cast("array<string>"))
    rows = edits.where("kind in ('modify', 'remove')")
    return rows.select("case_id", "item_key", "path", op.alias("op"), value.alias("value"), excludes.alias("excludes"), tier(F.col("path")).alias("tier"))


def must_not_change(edits: DataFrame, witness: DataFrame) -> DataFrame:
    """Per case the witness's pointers and the floor, without what the edits touched or a kept selector covers."""
    touched = edits.where("kind = 'modify'").groupBy("case_id").agg(F.collect_set("path").alias("touched"))
    seen = witness.groupBy("case_id").agg(F.collect_set("pointer").alias("pointers"))
    both = seen.join(touched, "case_id", "full_outer").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("touched", "pointers")})
    floor = F.filter(F.array(*map(F.lit, FLOOR)), lambda s: ~F.exists(F.col("touched"), lambda t: pointer.generalize(t) == s))
    kept = F.filter(F.array_except("pointers", "touched"), lambda p: ~F.array_contains(F.col("_floor"), pointer.generalize(p)))
    return both.withColumn("_floor", floor).select("case_id", F.array_sort(F.array_union(kept, F.col("_floor"))).alias("must_not_change"))


def resolution(edits: DataFrame, members: DataFrame) -> DataFrame:
    """Per case the only touched item that existed before (the keeper), null if there is more than one or duplicates are the problem."""
    old = edits.select("case_id", "item_key", "problem_class").distinct().join(members.select("item_key").distinct(), "item_key", "left_semi")
    per = old.groupBy("case_id", "problem_class").agg(F.count("*").alias("n"), F.min("item_key").alias("only"))
    return per.select("case_id", F.when((F.col("n") == 1) & (F.col("problem_class") != "duplicate_quality"), F.col("only")).alias("keeper"))


def required_items(edits: DataFrame, derived: tuple[str, ...] = ("/parent_title", "/grandparent", "/grandparent_title", "/child_count", "/leaf_count", "/album_count", "/part_count")) -> DataFrame:
    """Items a finding must name: roots, and items with any change that is not a derived copy."""
    own = edits.where((F.col("kind") != "modify") | ~F.col("path").isin(*derived) | (F.col("item_key") == F.col("root_key")))
    return own.groupBy("case_id").agg(F.array_sort(F.collect_set("item_key")).alias("item_keys"))


def evaluate(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``expected`` with ok; actual: case_id, item_key, path, value (JSON text; no row: the item is gone)."""
    x = expected.join(actual.withColumnRenamed("value", "found"), ["case_id", "item_key", "path"], "left")
    plain = lambda c: F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")
    blank = F.col("found").isNull() | F.col("found").isin("null", '""', "[]", "{}")
    labels = _labels(F.col("found"))
    want = F.from_json("value", "array<string>")
    ok = (
        F.when(F.col("op") == "equals", F.col("found") == F.col("value"))
        .when(F.col("op") == "normalized_equals", text.fold(plain(F.col("found"))) == text.fold(plain(F.col("value"))))
        .when(F.col("op") == "contains", (F.size(F.array_except(want, labels)) == 0) & (F.size(F.array_intersect(labels, F.col("excludes"))) == 0))
        .when(F.col("op") == "absent", blank)
        .otherwise(~blank)
    )
    return x.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("found")


def outcome(evaluated: DataFrame) -> DataFrame:
    """Per case: all hard conditions hold, and the part of soft ones that do."""
    hard = F.col("tier") == "hard"
    return evaluated.groupBy("case_id").agg(F.coalesce(F.bool_and(F.when(hard, F.col("ok"))), F.lit(True)).alias("passed"), F.avg(F.when(~hard, F.col("ok").cast("double"))).alias("soft_share"))
