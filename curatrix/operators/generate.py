"""Evaluation sets: cells, tickets, attempts and shortfalls over surveyed edits."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .ranking import CASES_PER_SUBJECT, apportion, attempt_window, rank_key

# Slices, media and problem classes in declared order (also the order of ties).
SLICES = ("synthetic", "should_not_touch", "curated", "adversarial")


def cells(composition: dict, seats: int, slice_name: str = "synthetic") -> list[tuple[str, str, int]]:
    """(media kind, problem class, target) of a slice by sequential apportionment on exact shares."""
    named = [(f"{m}/{c}", Fraction(composition["media"][m]).limit_denominator(10**9) * Fraction(s).limit_denominator(10**9)) for m, classes in composition["classes"].items() for c, s in classes.items()]
    return [(*k.split("/"), n) for k, n in apportion(named, seats).items()]


def subjects(items: DataFrame) -> DataFrame:
    """root_key, subject: the first resolvable id, or hashed title and year; subjects of two families are left out."""
    root = items.where(F.col("item_key") == F.col("root_key"))
    ids = F.filter("guids", lambda g: ~g["namespace"].isin("unknown", "local", "plex"))
    by_id = F.get(F.transform(ids, lambda g: F.concat(g["namespace"], F.lit("://"), g["value"])), F.lit(0))
    by_title = F.concat(F.lit("title:"), F.sha2(F.concat_ws("|", text.fold(F.col("title")), F.col("year").cast("string")), 256))
    named = root.select("root_key", "media_kind", F.coalesce(by_id, by_title).alias("subject"))
    clash = named.groupBy("subject").agg(F.count("*").alias("n")).where("n > 1").select("subject")
    return named.join(clash, "subject", "left_anti")


def _quoted(c) -> F.Column:
    """A text as canonical JSON: short escapes, non-ASCII as it is; null is null."""
    t = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, short in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = F.replace(t, F.lit(raw), F.lit(short))
    return F.coalesce(F.concat(F.lit('"'), t, F.lit('"')), F.lit("null"))


def case_id(slice_name, problem_class, media_kind, subject, variant) -> F.Column:
    """case- and 12 hex digits over the canonical object of five fields; absent ones are null, never left out."""
    fields = {"corruption_variant": variant, "media_kind": media_kind, "problem_class": problem_class, "slice": slice_name, "subject_key": subject}
    body = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), _quoted(v)) for k, v in fields.items()]), F.lit("}"))
    return F.concat(F.lit("case-"), F.substring(F.sha2(body, 256), 1, 12))


def run_group(subject) -> F.Column:
    """grp- and 12 hex digits of the subject's rank: what one run must see together."""
    return F.concat(F.lit("grp-"), F.substring(rank_key(subject), 1, 12))


def tickets(subject_rows: DataFrame, labels: list[str], cap: int = CASES_PER_SUBJECT) -> DataFrame:
    """subject, label of the first ``cap`` labels of each subject by hash, issued before targets exist."""
    rows = subject_rows.select("subject", "root_key", F.explode(F.array(*map(F.lit, labels))).alias("label"))
    w = Window.partitionBy("subject").orderBy(rank_key(F.col("subject"), label=F.col("label")), "label")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).drop("rn")


def synthetic_cases(items: DataFrame, edits: DataFrame, reasons: DataFrame, targets: list[tuple[str, str, int]]) -> tuple[DataFrame, DataFrame]:
    """(cases, shortfalls): candidates with a ticket in hash order, attempted within the window until the target is met.

    edits: the attempts of ``accept.attempt`` (with their refusals), or plain edits, each of which then counts as a success.
    """
    spark = items.sparkSession
    cell = F.broadcast(spark.createDataFrame([(m, c, n, attempt_window(n)) for m, c, n in targets], "media_kind string, problem_class string, target int, window int"))
    who = subjects(items)
    issued = tickets(who, sorted({c for _, c, _ in targets}))
    candidates = who.join(issued.select("subject", F.col("label").alias("problem_class")), "subject").join(cell, ["media_kind", "problem_class"])
    order = Window.partitionBy("media_kind", "problem_class").orderBy(rank_key(F.col("subject")), "subject")
    if "refusal" in edits.columns:  # what accept.attempt returns: only cases that passed every check succeed
        made = edits.where("refusal is null").select("problem_class", "root_key").distinct().withColumn("ok", F.lit(True))
        reasons = reasons.select("problem_class", "root_key", "reason").union(edits.where("refusal is not null").select("problem_class", "root_key", "refusal"))
    else:
        made = edits.select("problem_class", "root_key").distinct().withColumn("ok", F.lit(True))
    tried = candidates.withColumn("rn", F.row_number().over(order)).where("rn <= window").join(made, ["problem_class", "root_key"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    before = F.coalesce(F.sum(F.col("ok").cast("int")).over(Window.partitionBy("media_kind", "problem_class").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    attempted = tried.withColumn("done", before).where("done < target")
    variant = F.lit(None).cast("string")
    own_id = case_id(F.lit("synthetic"), F.col("problem_class"), F.col("media_kind"), F.col("subject"), variant)
    cases = attempted.where("ok").select(own_id.alias("case_id"), run_group(F.col("subject")).alias("run_group"), "media_kind", "problem_class", "subject", "root_key", "rn")
    got = attempted.groupBy("media_kind", "problem_class").agg(F.count("*").alias("attempted"), F.count_if("ok").alias("accepted"))
    why = attempted.where(~F.col("ok")).join(reasons, ["problem_class", "root_key"], "left").groupBy("media_kind", "problem_class").agg(F.mode("reason").alias("common_reason"))
    short = cell.join(got, ["media_kind", "problem_class"], "left").join(why, ["media_kind", "problem_class"], "left").fillna(0, ["attempted", "accepted"])
    reason = F.when(F.col("attempted") == 0, "no_candidates").when(F.col("attempted") >= F.col("window"), "window_exhausted").otherwise("candidates_exhausted")
    return cases, short.where("accepted < target").select("media_kind", "problem_class", "target", "attempted", "accepted", reason.alias("reason"), "common_reason")


def untouched_cases(screened: DataFrame, who: DataFrame, target: int) -> DataFrame:
    """Guarded roots in hash order: a repair must leave them alone."""
    rows = who.join(screened.where("verdict = 'guarded'").select(F.col("item_key").alias("root_key")), "root_key", "left_semi")
    w = Window.partitionBy("media_kind").orderBy(rank_key(F.col("subject")), "subject")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= target)


def assert_unique(cases: DataFrame) -> None:
    twice = cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"case ids occur twice: {', '.join(r['case_id'] for r in twice)}")


def tallies(cases: DataFrame) -> DataFrame:
    return cases.groupBy("media_kind", "problem_class").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"))
