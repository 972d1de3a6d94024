"""Profiling aggregates: ordered counts, presence, capped examples, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import selection

#: Examples shown for a finding; the rest is counted.
EXAMPLES = 5


def counts_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Counts per key, most frequent first, ties by key."""
    return df.groupBy(*keys).agg(F.count("*").alias(name)).orderBy(F.desc(name), *keys)


def population(df: DataFrame, *, section: str, kind: str, agent: str) -> DataFrame:
    """Items and roots per (section, kind, agent); an empty agent is ``<none>``."""
    label = F.coalesce(F.nullif(F.col(agent), F.lit("")), F.lit("<none>"))
    return df.groupBy(section, kind, label.alias(agent)).agg(F.count("*").alias("n"), F.count_if(F.col("is_root")).alias("n_roots"))


def presence(df: DataFrame, **present: Column) -> DataFrame:
    """One row a named condition: field, present, absent (of all rows)."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(c).alias(k) for k, c in present.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("present"), (F.col("_n") - F.col(k)).alias("absent")) for k in present])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def capped_examples(df: DataFrame, group: str, value: str, cap: int = EXAMPLES) -> DataFrame:
    """Per group the first ``cap`` distinct values in order, and how many more there are.

    A window limit keeps at most ``cap`` values a group and task before the
    shuffle; nothing collects a group's values.
    """
    from pyspark.sql import Window

    distinct = df.where(F.col(value).isNotNull()).select(group, value).distinct()
    totals = distinct.groupBy(group).agg(F.count("*").alias("total"))
    first = distinct.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(value))).where(F.col("_rn") <= cap)
    shown = first.groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("examples"))
    return shown.join(totals, group).select(group, "examples", F.greatest(F.col("total") - cap, F.lit(0)).alias("dropped"))


def classify_sections(df: DataFrame, section: str, packaged: Column, duration: Column, *, share: float = 0.5, least: float = 600_000.0, marked: Column | None = None) -> DataFrame:
    """Sections whose items are mostly packaged and long at the median (or marked by their agent)."""
    agg = df.groupBy(section).agg(F.avg(packaged.cast("double")).alias("share"), F.bool_or(marked if marked is not None else F.lit(False)).alias("marked"))
    middle = selection.percentiles(df.select(section, duration.alias("_duration")), [section], "_duration", {"median": 0.5}).withColumnRenamed(section, "_section")
    agg = agg.join(middle, F.col(section).eqNullSafe(F.col("_section"))).select(section, "share", "median", "marked")
    return agg.withColumn("matches", F.col("marked") | ((F.col("share") >= share) & (F.col("median") >= least)))


def readiness(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Named counts in declared order: rank, name, n (rows of each part)."""
    out = None
    for i, (name, df) in enumerate(parts):
        row = df.agg(F.count("*").alias("n")).select(F.lit(i).alias("rank"), F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def duplicated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


# -- records of an export ------------------------------------------------------------------------


def file_census(items: DataFrame) -> DataFrame:
    """field (container, video_resolution), value, n: per file, lower-cased; files without a value don't count."""
    parts = items.select(F.explode("parts").alias("p"))
    named = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f"p.{f}")).alias("value")) for f in ("container", "video_resolution")])
    return parts.select(F.explode(named).alias("x")).select("x.*").where("value <> ''").groupBy("field", "value").agg(F.count("*").alias("n"))


def namespace_census(items: DataFrame) -> DataFrame:
    """namespace, items, ids, distinct_forms (of unknown ones), examples, dropped."""
    ids = items.select("item_key", F.explode("guids").alias("g")).select("item_key", "g.namespace", F.when(F.col("g.namespace") == "unknown", F.col("g.raw")).alias("form"))
    per_item = ids.groupBy("namespace", "item_key").agg(F.count("*").alias("_n"))
    counts = per_item.groupBy("namespace").agg(F.count("*").alias("items"), F.sum("_n").alias("ids"))
    shown = capped_examples(ids, "namespace", "form")
    forms = ids.where("form is not null").select("namespace", "form").distinct().groupBy("namespace").agg(F.count("*").alias("distinct_forms"))
    out = counts.join(forms, "namespace", "left").join(shown, "namespace", "left")
    return out.select("namespace", "items", "ids", F.coalesce("distinct_forms", F.lit(0)).alias("distinct_forms"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"), F.coalesce("dropped", F.lit(0)).alias("dropped"))


def locked_fields(items: DataFrame) -> DataFrame:
    return items.select(F.explode("locked_fields").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def without_guids(items: DataFrame) -> DataFrame:
    return items.where(F.coalesce(F.size("guids"), F.lit(0)) <= 0).groupBy("media_kind").agg(F.count("*").alias("n"))


#: Problem classes in the order their readiness is shown.
READY = (
    "wrong_match", "year_collision_remake", "foreign_title_variant", "alternate_cut", "missing_metadata", "duplicate_quality", "episode_wrong_season", "absolute_vs_seasonal",
    "filename_unmatchable", "series_order_broken", "author_name_variant", "narrator_as_author", "multi_file_split", "missing_series", "anthology_omnibus",
)
LONG_SEASON = 30


def crude_title(c: Column) -> Column:
    """Case folded and white space collapsed, nothing more."""
    from ..functions import text

    return text.crude(c)


def export_readiness(items: DataFrame) -> DataFrame:
    """rank, problem_class, eligible: how many records (or groups) each class could use.

    One pass counts what a record shows by itself; children and title groups are
    aggregates of their own, joined as single rows.
    """
    from ..functions import parse

    kind = F.col("media_kind")
    children = items.where("parent_key is not null").groupBy(F.col("parent_key").alias("_pk")).agg(F.count("*").alias("_kids"))
    df = items.join(children, F.col("item_key") == F.col("_pk"), "left").withColumn("_kids", F.coalesce("_kids", F.lit(0)))
    resolvable = F.coalesce(parse.has_resolvable_id(F.col("guids")), F.lit(False))
    series = (kind == "audiobook") & ((F.coalesce("series", F.lit("")) != "") | F.col("index").isNotNull())
    books = (kind == "author") & (F.col("_kids") > 1)
    own = df.agg(
        F.count_if(kind.isin("movie", "show") & resolvable).alias("wrong_match"),
        F.count_if((kind == "movie") & resolvable).alias("foreign_title_variant"),
        F.count_if((kind == "movie") & (F.coalesce("edition_title", F.lit("")) != "")).alias("alternate_cut"),
        F.count_if(F.coalesce("summary", F.lit("")) != "").alias("missing_metadata"),
        F.count_if((kind == "season") & (F.col("_kids") > LONG_SEASON)).alias("absolute_vs_seasonal"),
        F.count_if(F.coalesce(F.size("parts"), F.lit(0)) > 0).alias("filename_unmatchable"),
        F.count_if(series).alias("series_order_broken"), F.count_if(series).alias("missing_series"),
        F.count_if(books).alias("author_name_variant"), F.count_if(books).alias("narrator_as_author"),
        F.count_if((kind == "audiobook") & (F.greatest(F.col("_kids"), F.coalesce("part_count", F.lit(0))) > 1)).alias("multi_file_split"),
        F.lit(0).cast("long").alias("anthology_omnibus"),
    )
    films = items.where("media_kind = 'movie'").select("section_id", crude_title(F.col("title")).alias("_t"), "year")
    per_year = films.groupBy("section_id", "_t", "year").agg(F.count("*").alias("_n"))
    twins = per_year.where("_n > 1").agg(F.count("*").alias("duplicate_quality"))
    remakes = per_year.where("year is not null").groupBy("section_id", "_t").agg(F.count("*").alias("_y")).where("_y > 1").agg(F.count("*").alias("year_collision_remake"))
    seasons = df.where("media_kind = 'season' and parent_key is not null").groupBy("parent_key").agg(F.count("*").alias("_n"), F.max("_kids").alias("_most")).where("_n > 1 and _most > 0")
    shows = seasons.join(items.where("media_kind = 'show'").select(F.col("item_key").alias("parent_key")), "parent_key", "left_semi").agg(F.count("*").alias("episode_wrong_season"))
    one = own.crossJoin(twins).crossJoin(remakes).crossJoin(shows)  # four single rows
    rows = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(c).alias("problem_class"), F.col(c).alias("eligible")) for i, c in enumerate(READY)])
    return one.select(F.explode(rows).alias("r")).select("r.*")
