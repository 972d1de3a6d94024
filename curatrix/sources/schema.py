"""The wide item record: common columns and the union of the kinds' columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ID = "struct<provider:string,section_id:string,rating_key:string>"
ITEM = f"""
item_id {_ID}, media_kind string, fetched string, title string, title_sort string, summary string,
guids array<struct<namespace:string,value:string,raw:string,season:int,episode:int>>, locked_fields array<string>,
has_thumb boolean, has_art boolean, added_at timestamp, updated_at timestamp,
year int, index int, parent_index int, child_count int, leaf_count int, album_count int, part_count int, duration_ms bigint,
rating double, audience_rating double, originally_available_at date, parent {_ID}, grandparent {_ID},
parent_title string, grandparent_title string, edition_title string, original_title string, content_rating string, studio string,
tagline string, network string, show_ordering string, series string, series_position string,
parts array<struct<media_id:string,part_id:string,path:string,container:string,video_resolution:string,size_bytes:bigint,duration_ms:bigint>>
""".replace("\n", " ")

# Kinds, their place in a family, and which hold files.
KIND_RANK = {"movie": 0, "show": 0, "author": 0, "season": 1, "audiobook": 1, "episode": 2, "audiobook_part": 2}
ROOT_KINDS = ("movie", "show", "author")


def key_of(item_id: Column) -> Column:
    """provider:section:key; an empty component or one with a colon is an error."""
    parts = [item_id[f] for f in ("provider", "section_id", "rating_key")]
    bad = F.lit(False)
    for p in parts:
        bad = bad | F.coalesce((p == "") | p.contains(":"), F.lit(True))
    return F.when(item_id.isNull(), F.lit(None)).when(bad, F.raise_error(F.lit("an id component is empty or holds ':'")).cast("string")).otherwise(F.concat_ws(":", *parts))


def with_keys(items: DataFrame) -> DataFrame:
    """item_key, parent_key, grandparent_key and section_id as plain join columns."""
    return items.withColumns({"item_key": key_of(F.col("item_id")), "parent_key": key_of(F.col("parent")), "grandparent_key": key_of(F.col("grandparent")), "section_id": F.col("item_id.section_id")})


def normalized(items: DataFrame) -> DataFrame:
    """Ingest rules: empty texts null, locked fields sorted and distinct, kinds known."""
    texts = [f.name for f in items.schema.fields if f.dataType.simpleString() == "string" and f.name not in ("media_kind", "fetched")]
    known = F.col("media_kind").isin(*KIND_RANK)
    out = items.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in texts})
    return out.withColumn("locked_fields", F.sort_array(F.array_distinct(F.coalesce("locked_fields", F.array().cast("array<string>"))))).withColumn("media_kind", F.when(known, F.col("media_kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce("media_kind", F.lit("null")))).cast("string")))


def stubs(items: DataFrame) -> DataFrame:
    return items.select("item_id", "media_kind", "title", "year")


def record_order(root_key: Column) -> list[Column]:
    from ..operators.ranking import key_order

    rank = F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv])
    return [*key_order(F.col("section_id")), *key_order(root_key), rank[F.col("media_kind")].asc(), *key_order(F.col("item_id.rating_key"))]
