"""Rates over scored runs (an extension: the reference specifies them without code).

runs: case_id, media_kind, problem_class, slice, passed, findings (reported
items), expected (items that had to be reported), steps, cost, escalated,
should_escalate, confidence, tools, expected_tools.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import selection


def _share(condition, of=None) -> F.Column:
    return F.avg(condition.cast("double")) if of is None else F.avg(F.when(of, condition.cast("double")))


def rates(runs: DataFrame, *by: str) -> DataFrame:
    """n, pass_rate, fp_rate_snt, collateral_fp_rate, escalation_rate, silence_rate per group, and over each part of the grouping (cube)."""
    extra = F.size(F.array_except("findings", "expected")) > 0
    snt = F.col("slice") == "should_not_touch"
    agg = [
        F.count("*").alias("n"), _share(F.col("passed")).alias("pass_rate"), _share(F.size("findings") > 0, snt).alias("fp_rate_snt"), _share(extra).alias("collateral_fp_rate"),
        _share(F.col("escalated"), F.col("should_escalate")).alias("escalation_rate"), _share((F.size("findings") == 0) & ~F.col("escalated"), ~snt).alias("silence_rate"),
    ]
    return (runs.cube(*by) if by else runs.groupBy()).agg(*agg)


def effort(runs: DataFrame, *by: str) -> DataFrame:
    """Exact median and 95th percentile of steps and cost, and cost of a hundred cases."""
    out = runs.groupBy(*by).agg((F.avg("cost") * 100).alias("cost_per_100"))
    for value in ("steps", "cost"):
        found = selection.percentiles(runs, list(by), value, {f"median_{value}": 0.5, f"p95_{value}": 0.95}).withColumnsRenamed({b: f"_{b}" for b in by})
        same = F.lit(True)
        for b in by:
            same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
        out = (out.join(found, same) if by else out.crossJoin(found)).drop(*[f"_{b}" for b in by])  # without groups: one row each
    return out.select(*by, "median_steps", "p95_steps", "median_cost", "p95_cost", "cost_per_100")


def auto_apply(runs: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """floor, applied (share of runs at least so confident), right (share of those that passed)."""
    rows = [F.struct(F.lit(f).alias("floor"), F.avg((F.col("confidence") >= f).cast("double")).alias("applied"), F.avg(F.when(F.col("confidence") >= f, F.col("passed").cast("double"))).alias("right")) for f in floors]
    return runs.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def component(runs: DataFrame) -> DataFrame:
    """case_id, used_expected (share of the expected tools that were used), in_phase (no tool beyond the allowed ones, where those are given)."""
    overlap = F.size(F.array_intersect("tools", "expected_tools")) / F.greatest(F.size(F.array_distinct("expected_tools")), F.lit(1))
    allowed = F.size(F.array_except("tools", "allowed_tools")) == 0 if "allowed_tools" in runs.columns else F.lit(True)
    return runs.select("case_id", F.when(F.size("expected_tools") == 0, 1.0).otherwise(overlap).alias("used_expected"), allowed.alias("in_phase"))


def agreement(labels: DataFrame) -> DataFrame:
    """n, observed, expected, kappa of two labellers (case_id, first, second), from one contingency table."""
    table = labels.groupBy("first", "second").agg(F.count("*").alias("c"))
    n = table.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("first") == F.col("second"), F.col("c")).otherwise(0)).alias("same"))
    a, b = (table.groupBy(F.col(k).alias("label")).agg(F.sum("c").alias(k)) for k in ("first", "second"))
    chance = a.join(b, "label").agg(F.coalesce(F.sum(F.col("first").cast("double") * F.col("second")), F.lit(0.0)).alias("x"))
    observed, expected = F.col("same") / F.col("n"), F.col("x") / (F.col("n").cast("double") * F.col("n"))
    one = n.crossJoin(chance)  # single rows
    return one.select("n", observed.alias("observed"), expected.alias("expected"), F.when(expected < 1, (observed - expected) / (1 - expected)).otherwise(1.0).alias("kappa"))
