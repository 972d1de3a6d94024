from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators.stage import stored


def test_a_stored_table_is_not_broadcast_by_the_size_of_its_files(spark, tmp_path):
    rows = lambda name: stored(spark.range(200_000).select(F.concat(F.lit("case|"), F.col("id") % 1000).alias("k"), F.lit("x" * 100).alias("v")), name)
    a, b = rows("a"), rows("b")
    for joined in (a.join(b.select("k"), "k"), a.join(b.where("v <> ''").select("k").distinct(), "k", "left_anti"), b.groupBy("k").count().join(a, "k")):
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
