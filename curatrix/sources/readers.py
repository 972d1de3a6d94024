"""Sources: item and root files, verified reads, change logs read by case, XML elements, TOML targets, blobs."""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from .schema import ITEM, normalized, with_keys


class DigestMismatch(ValueError):
    """The bytes read are not the bytes recorded."""


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Item records, one JSON object a line; a malformed line or an unknown kind fails the job."""
    return with_keys(normalized(spark.read.schema(ITEM).option("mode", "FAILFAST").json(path)))


def read_roots(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The population of roots; None (unavailable, never empty) where the file is absent."""
    if path is None:
        return None
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return read_items(spark, path)


def unknown_fields(spark: SparkSession, path: str) -> DataFrame:
    """Field names that are not of the closed schema, with their number of lines."""
    known = [x.split()[0] for x in ITEM.replace("<", " ").split(", ") if x] + ["item_id"]
    names = spark.read.text(path).select(F.explode(F.json_object_keys("value")).alias("field"))
    return names.where(~F.col("field").isin(*known)).groupBy("field").agg(F.count("*").alias("n"))


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length")


def verify(spark: SparkSession, folder: str, recorded: dict[str, str]) -> None:
    """Refuse a folder whose files' digests differ from the recorded ones."""
    want = spark.createDataFrame(list(recorded.items()), "name string, want string")
    bad = want.join(file_digests(spark, folder), "name", "left").where(~F.col("want").eqNullSafe(F.col("sha256"))).select("name").limit(5).collect()
    if bad:
        raise DigestMismatch(f"changed or missing: {', '.join(r['name'] for r in bad)}; export again or restore the files")


CHANGE = "struct<case_id:string,kind:string,item_id:struct<provider:string,section_id:string,rating_key:string>,fields:array<struct<path:string,before:string,after:string>>,record:string>"


def read_changes(spark: SparkSession, path: str, case_id: str | None = None) -> DataFrame:
    """Change records; only lines of the asked case are parsed."""
    lines = spark.read.text(path)
    if case_id is not None:
        lines = lines.where(F.get_json_object("value", "$.case_id") == case_id)
    return lines.select(F.from_json("value", CHANGE, {"mode": "FAILFAST"}).alias("c")).select("c.*")


#: Element types and the kinds they become.
XML_KINDS = {"movie": "movie", "show": "show", "season": "season", "episode": "episode", "artist": "author", "album": "audiobook", "track": "audiobook_part"}
XML_SCHEMA = """_ratingKey string, _type string, _title string, _titleSort string, _summary string, _guid string, _thumb string, _art string, _year int, _index int,
_parentIndex int, _childCount int, _leafCount int, _duration bigint, _rating double, _audienceRating double, _originallyAvailableAt date, _addedAt bigint, _updatedAt bigint,
_parentRatingKey string, _grandparentRatingKey string, _parentTitle string, _grandparentTitle string, _editionTitle string, _originalTitle string, _contentRating string,
_studio string, _tagline string, Guid array<struct<_id:string>>, Field array<struct<_name:string,_locked:string>>,
Media array<struct<_id:string,_container:string,_videoResolution:string,_duration:bigint,Part:array<struct<_id:string,_file:string,_size:bigint,_container:string,_duration:bigint>>>>"""


def read_xml(spark: SparkSession, path: str, provider: str, section: str, row_tag: str = "Video") -> DataFrame:
    """Server elements as item records (columns that apply), identifiers normalised, locks and parts nested."""
    x = spark.read.format("xml").option("rowTag", row_tag).schema(XML_SCHEMA.replace("\n", " ")).load(path)
    kind = F.create_map(*[F.lit(v) for kv in XML_KINDS.items() for v in kv])[F.col("_type")]
    address = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.lit(provider).alias("provider"), F.lit(section).alias("section_id"), F.col(c).alias("rating_key")))
    parts = F.flatten(F.transform("Media", lambda m: F.transform(m["Part"], lambda p: F.struct(m["_id"].alias("media_id"), p["_id"].alias("part_id"), p["_file"].alias("path"), F.coalesce(p["_container"], m["_container"]).alias("container"), m["_videoResolution"].alias("video_resolution"), p["_size"].alias("size_bytes"), F.coalesce(p["_duration"], m["_duration"]).alias("duration_ms")))))
    locks = F.array_sort(F.array_distinct(F.transform(F.filter("Field", lambda f: f["_locked"].isin("1", "true")), lambda f: f["_name"])))
    same = {"title": "_title", "title_sort": "_titleSort", "summary": "_summary", "year": "_year", "index": "_index", "parent_index": "_parentIndex", "child_count": "_childCount", "leaf_count": "_leafCount", "duration_ms": "_duration", "rating": "_rating", "audience_rating": "_audienceRating", "originally_available_at": "_originallyAvailableAt", "parent_title": "_parentTitle", "grandparent_title": "_grandparentTitle", "edition_title": "_editionTitle", "original_title": "_originalTitle", "content_rating": "_contentRating", "studio": "_studio", "tagline": "_tagline"}
    return x.where(kind.isNotNull()).select(
        address("_ratingKey").alias("item_id"), kind.alias("media_kind"), F.lit("full").alias("fetched"), *[F.col(v).alias(k) for k, v in same.items()],
        parse.normalize_guids(F.col("_guid"), F.transform("Guid", lambda g: g["_id"])).alias("guids"), F.coalesce(locks, F.array().cast("array<string>")).alias("locked_fields"),
        F.col("_thumb").isNotNull().alias("has_thumb"), F.col("_art").isNotNull().alias("has_art"), F.timestamp_seconds("_addedAt").alias("added_at"), F.timestamp_seconds("_updatedAt").alias("updated_at"),
        address("_parentRatingKey").alias("parent"), address("_grandparentRatingKey").alias("grandparent"), F.coalesce(parts, F.array().cast("array<struct<media_id:string,part_id:string,path:string,container:string,video_resolution:string,size_bytes:bigint,duration_ms:bigint>>")).alias("parts"),
    )


def _shares(table: dict[str, float], where: str) -> dict[str, float]:
    import math

    if any(v < 0 for v in table.values()):
        raise ValueError(f"{where}: a share is negative; use shares of 0 or more")
    total = math.fsum(table.values())
    if total <= 0:
        raise ValueError(f"{where}: the shares add up to nothing; give at least one above 0")
    return {k: v / total for k, v in table.items()}


def read_composition(text: str) -> dict:
    """Normalised shares of slices, media and classes from TOML text."""
    raw = tomllib.loads(text)
    media = raw["media"]
    return {
        "slices": _shares(raw["slices"], "slices"),
        "media": _shares({k: v["share"] for k, v in media.items()}, "media"),
        "classes": {k: _shares(v["classes"], f"media.{k}.classes") for k, v in media.items() if "classes" in v},
    }


def read_curated(text: str) -> list[dict]:
    cases = tomllib.loads(text).get("cases", [])
    for c in cases:
        if not c.get("item_ids"):
            raise ValueError("a curated case names no item; add item_ids")
    return cases


def settings(defaults: dict[str, str], toml_text: str | None = None, prefix: str = "CATALOGUE_") -> dict[str, str]:
    """Environment over TOML over defaults."""
    file = tomllib.loads(toml_text) if toml_text else {}
    return {k: os.environ.get(prefix + k.upper(), file.get(k, v)) for k, v in defaults.items()}


def read_blob(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("sha256") == sha256)
