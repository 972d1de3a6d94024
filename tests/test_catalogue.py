from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from curatrix.operators import corrupt, delta, generate, hierarchy, screen, truth, world
from curatrix.sources import readers, schema, sinks
from curatrix.sources.provider import Catalogue, Correctable

from .catalogue import RECORDS, write


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("items")
    hierarchy.with_root(readers.read_items(spark, write(folder / "items.jsonl"))).coalesce(1).write.parquet(f"{folder}/parquet")
    return spark.read.parquet(f"{folder}/parquet")


@pytest.fixture(scope="module")
def roots(items):
    return items.where("item_key = root_key")


@pytest.fixture(scope="module")
def surveyed(spark, items, roots, tmp_path_factory):
    """Stored, as a stage boundary would be: later plans start from two small tables."""
    folder = str(tmp_path_factory.mktemp("survey"))
    for name, df in zip(("edits", "reasons"), corrupt.survey(items, roots), strict=True):
        df.coalesce(1).write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/edits"), spark.read.parquet(f"{folder}/reasons")


def test_reading_and_structure(items):
    assert items.count() == len(RECORDS)
    assert {r.root_key for r in items.where("media_kind = 'episode'").collect()} == {"p:2:201"}
    assert items.first().locked_fields == ["art", "title"]
    assert hierarchy.structural_violations(items).collect() == []
    assert hierarchy.derived_violations(items).collect() == []
    broken = items.withColumn("child_count", F.lit(9)).withColumn("parent_key", F.when(F.col("media_kind") == "season", F.lit("p:2:999")).otherwise(F.col("parent_key")))
    assert {r.rule for r in hierarchy.structural_violations(broken).collect()} == {"orphan", "grandparent"}
    assert {r.path for r in hierarchy.derived_violations(broken).collect()} >= {"/child_count"}


def test_screen(items, roots):
    checked = screen.catalogue_checks(items, roots).cache()
    by = {r.item_key: r for r in checked.collect()}
    assert by["p:1:105"].no_title_year_twin == by["p:1:106"].no_title_year_twin == "fail"
    assert by["p:1:102"].no_title_year_twin == "pass" and by["p:1:107"].summary_present == "fail"
    assert by["p:1:101"].filename_matches_metadata == "pass" and by["p:1:107"].filename_matches_metadata == "unavailable"
    assert by["p:2:2111"].filename_matches_metadata == by["p:2:2111"].season_membership_coherent == "pass"
    assert by["p:2:201"].episode_numbering_contiguous == "pass" and by["p:4:411"].single_part == "fail" and by["p:4:412"].single_part == "pass"
    assert by["p:4:401"].no_author_name_twin == "fail" and by["p:1:101"].title_matches_authority == "unavailable"
    verdicts = {r.item_key: r.verdict for r in screen.item_screen(checked).collect()}
    assert verdicts["p:1:101"] == "guarded" and verdicts["p:1:105"] == "failed" and verdicts["p:4:421"] == "insufficient"
    without = screen.catalogue_checks(items, None)
    assert {r[0] for r in without.where("media_kind = 'movie'").select("no_title_year_twin").collect()} == {"unavailable"}


def test_authority(spark, items, roots):
    authority = spark.createDataFrame([("imdb", "TT1", "Le Fabuleux Destin", ["amelie"], 2001, None), ("tmdb", "2", "Solaris", [], 1973, None)], "namespace string, value string, title string, aliases array<string>, year int, series_position string")
    by = {r.item_key: r for r in screen.catalogue_checks(items, roots, authority).collect()}
    assert by["p:1:101"].title_matches_authority == "pass" and by["p:1:102"].year_matches_authority == "fail" and by["p:1:103"].title_matches_authority == "unavailable"


def test_every_class_applies_somewhere(surveyed):
    edits, reasons = surveyed
    done = {r.problem_class for r in edits.select("problem_class").distinct().collect()}
    assert done == set(corrupt.REGISTRY)
    why = {(r.problem_class, r.root_key): r.reason for r in reasons.collect()}
    assert why["duplicate_quality", "p:1:105"] == "already_duplicated" and why["year_collision_remake", "p:1:103"] is not None if ("year_collision_remake", "p:1:103") in why else True
    assert why["alternate_cut", "p:1:101"] == "no_edition" and why["author_name_variant", "p:4:402"] == "too_few_books"


def test_edits_of_single_classes(surveyed):
    edits, _ = surveyed
    rows = {(r.problem_class, r.root_key, r.item_key, r.path): (r.before, r.after) for r in edits.where("kind = 'modify'").collect()}
    assert rows["alternate_cut", "p:1:104", "p:1:104", "/edition_title"] == ('"Final Cut"', "null")
    assert rows["year_collision_remake", "p:1:102", "p:1:102", "/year"] == ("1972", "2002")
    assert rows["missing_series", "p:4:401", "p:4:411", "/series"][1] == "null" if ("missing_series", "p:4:401", "p:4:411", "/series") in rows else True
    index = {k[2]: v[1] for k, v in rows.items() if k[0] == "absolute_vs_seasonal" and k[3] == "/index"}
    assert index == {"p:2:2121": "3", "p:2:2122": "4"}


def test_worlds_and_truth(spark, items, roots, surveyed, tmp_path):
    edits, _ = surveyed
    cases = edits.withColumn("case_id", F.concat_ws("/", "problem_class", "root_key"))
    world.build(items, cases).coalesce(1).write.parquet(str(tmp_path / "worlds"))
    built = spark.read.parquet(str(tmp_path / "worlds"))
    bad = world.integrity(built, items).where("rule not in ('derived_copy', 'grandparent')").collect()
    assert bad == []
    flat = built.where("case_id = 'absolute_vs_seasonal/p:2:201'")
    assert flat.where("media_kind = 'season'").count() == 1
    served = world.served(built)
    assert served.where("served_item_key is null or not served_item_key rlike '^[0-9]+$'").count() == 0
    a = world.addresses(built)
    assert a.count() == a.select("case_id", "served_key").distinct().count()
    expected = truth.postconditions(cases).cache()
    assert {r.op for r in expected.collect()} == {"equals", "normalized_equals", "contains", "non_empty"} | ({"absent"} if expected.where("op = 'absent'").count() else set())
    mods = cases.where("kind = 'modify'")
    repaired = mods.select("case_id", "item_key", "path", F.col("before").alias("value")).union(cases.where("kind = 'remove'").select("case_id", "item_key", "path", F.lit('"there"')))
    assert truth.outcome(truth.evaluate(expected, repaired)).where("not passed or soft_share < 1").count() == 0
    left = mods.select("case_id", "item_key", "path", F.col("after").alias("value"))
    assert truth.evaluate(expected.where("tier = 'hard'"), left).where("ok").count() == 0


def test_generate(items, surveyed):
    edits, reasons = surveyed
    cases, short = generate.synthetic_cases(items, edits, reasons, [("movie", "wrong_match", 2), ("movie", "alternate_cut", 1), ("show", "wrong_match", 1)])
    rows = cases.collect()
    generate.assert_unique(cases)
    assert 0 < len(rows) <= 4 and len({r.case_id for r in rows}) == len(rows)
    got = {(r.media_kind, r.problem_class): r.accepted for r in short.collect()}
    assert ("show", "wrong_match") in got
    more, _ = generate.synthetic_cases(items, edits, reasons, [("movie", "wrong_match", 4), ("movie", "alternate_cut", 1), ("show", "wrong_match", 1)])
    assert {r.case_id for r in rows} <= {r.case_id for r in more.collect()}


def test_provider(items):
    c = Catalogue(items, [("1", "movie"), ("2", "show"), ("4", "artist")])
    page = c.list_items("1", 1, 3)
    assert page.total == 7 and page.returned == 3 and [r.title for r in page.rows] == ["Blade Runner", "Nothing", "Solaris"]
    assert c.list_items("1", 0, 0).rows == [] and [r["index"] for r in c.get_children("p:2:202", 0, 10).rows] == [1, 2]
    assert [r.title for r in c.find_similar("1", "SOLAR", 5)] == ["Solaris", "Solaris"] and len(c.get_files("p:1:101")) == 1
    for bad in (lambda: c.list_items("9", 0, 1), lambda: c.list_items("1", -1, 1), lambda: c.get_item("x:1:101"), lambda: c.find_similar("1", " ", 1)):
        with pytest.raises(Correctable):
            bad()


def test_sinks(spark, items, tmp_path):
    rows = items.select("item_key", "title", "year")
    lines = sinks.canonical_lines(rows, ["item_key"])
    out = str(tmp_path / "out")
    sinks.write_lines(lines, out, single=True)
    first = spark.read.text(out).first().value
    assert first == '{"item_key":"p:1:101","title":"Amélie","year":2001}'
    with pytest.raises(FileExistsError):
        sinks.write_lines(lines, out)
    with pytest.raises(sinks.SecretFound):
        sinks.write_lines(lines, str(tmp_path / "no"), secrets=["Solaris"])
    blobs = spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "content binary")
    store = str(tmp_path / "blobs")
    assert (sinks.put_blobs(spark, blobs, store), sinks.put_blobs(spark, blobs, store)) == (2, 0)
    digests = {r.name: r.sha256 for r in readers.file_digests(spark, out).collect() if r.name.startswith("part")}
    readers.verify(spark, out, digests)
    with pytest.raises(readers.DigestMismatch):
        readers.verify(spark, out, {k: "0" for k in digests})
    assert schema.stubs(items).columns == ["item_id", "media_kind", "title", "year"]


def test_reasons_of_predicates(items, roots):
    got = {(r.item_key, c.predicate): (c.status, c.reason) for r in screen.catalogue_checks(items, roots).collect() for c in r.checks}
    assert got["p:1:107", "summary_present"] == ("fail", "summary_empty") and got["p:1:107", "resolvable_id_present"] == ("fail", "no_resolvable_id")
    assert got["p:1:103", "filename_matches_metadata"] == ("fail", "title_mismatch") and got["p:1:107", "filename_matches_metadata"] == ("unavailable", "no_file_parts")
    assert got["p:4:411", "single_part"] == ("fail", "multiple_parts") and got["p:1:105", "no_title_year_twin"] == ("fail", "title_year_twin")
    assert got["p:4:401", "no_author_name_twin"] == ("fail", "author_name_twin") and got["p:1:101", "title_matches_authority"] == ("unavailable", "no_authority")
    assert got["p:2:2111", "season_membership_coherent"] == ("pass", None) and got["p:1:101", "single_part"] == ("not_applicable", None)
    odd = items.withColumn("parent_key", F.when(F.col("item_key") == "p:2:2111", "gone").when(F.col("item_key") == "p:2:2112", F.lit(None)).otherwise(F.col("parent_key")))
    odd = odd.withColumn("parent_index", F.when(F.col("item_key") == "p:2:2121", F.lit(None)).when(F.col("item_key") == "p:2:2122", 7).otherwise(F.col("parent_index"))).withColumn("index", F.when(F.col("item_key") == "p:2:2122", F.lit(None)).otherwise(F.col("index")))
    got = {(r.item_key, c.predicate): (c.status, c.reason) for r in screen.catalogue_checks(odd, None).collect() for c in r.checks}
    assert [got[f"p:2:21{k}", "season_membership_coherent"][1] for k in ("11", "12", "21", "22")] == ["parent_not_exported", "no_parent", "season_index_missing", "season_mismatch"]
    assert got["p:2:202", "season_membership_coherent"] == ("unavailable", "no_episodes_exported") and got["p:2:203", "season_membership_coherent"] == ("fail", "season_mismatch")
    assert got["p:2:2122", "filename_matches_metadata"] == ("unavailable", "episode_numbering_missing") and got["p:1:101", "no_title_year_twin"] == ("unavailable", "no_population_index")


def test_propagation_leaves_null_copies_alone(items):
    season = F.col("media_kind") == "season"
    held = items.withColumn("parent_title", F.when(F.col("item_key") == "p:2:203", F.lit(None)).otherwise(F.col("parent_title")))
    new = held.where("item_key = 'p:2:203'").withColumn("item_key", F.lit("new"))
    stale = held.where("item_key = 'p:2:202'").withColumn("item_key", F.lit("new2")).withColumn("parent_title", F.lit("old"))
    renamed = held.withColumn("title", F.when(F.col("media_kind") == "show", "Renamed").otherwise(F.col("title"))).union(new).union(stale)
    got = {r.item_key: r.parent_title for r in hierarchy.propagate(held, renamed).where(season).collect()}
    assert got == {"p:2:202": "Renamed", "p:2:203": None, "new": None, "new2": "Renamed"}


def test_delta_preconditions(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    change = lambda *r: spark.createDataFrame(list(r), "key long, kind string, path string, before string, after string")
    base, none = rows((1, "a"), (2, "b")), rows()
    assert sorted(map(tuple, delta.apply_delta(base, change((1, "modify", "/v", "a", "x"), (2, "remove", "", None, None), (3, "add", "", None, None)), rows((3, "n")), "k", ["v"], rows((2, "b"))).collect())) == [(1, "x"), (3, "n")]
    for changes, added, removed in [
        (change((1, "modify", "/v", "z", "x")), none, None), (change((9, "modify", "/v", "z", "x")), none, None), (change((9, "remove", "", None, None)), none, None),
        (change((1, "add", "", None, None)), rows((1, "q")), None), (change((3, "add", "", None, None)), none, None), (change((2, "remove", "", None, None)), none, rows((2, "other"))),
    ]:
        with pytest.raises(Exception, match="precondition|already there|not there|without a record|another record"):
            delta.apply_delta(base, changes, added, "k", ["v"], removed).collect()
