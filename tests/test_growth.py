"""What grows with the input must not grow faster: steps that once did."""

from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from curatrix.functions import text
from curatrix.operators import delta, hierarchy, ranking, screen, twins
from curatrix.plans import queries as Q

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plain(spark):
    """Fixed partitions and no broadcasts, so that a step's spread shows."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("false", "-1", "8"), strict=True):
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def share(df) -> float:
    """Share of the rows in the partition that has most."""
    n = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(n) / sum(n)


def test_each_pair_of_names_is_compared_once(spark):
    parts = spark.createDataFrame([(i, "b", 1, n) for i, n in enumerate(["x", "y", "x", None])], "p_partkey long, p_brand string, p_size int, p_name string")
    assert sorted(map(str, Q._name_pairs(parts.where("p_name is not null")).collect())) == sorted(f"Row(l_name='{a}', r_name='{b}')" for a in "xy" for b in "xy")
    assert "ArrowEvalPython" not in plan(Q.QUERIES["similarity_ratio"](spark, SF))


def test_ratios_of_repeated_names_come_from_lists_of_keys(spark, tmp_path, monkeypatch):
    """Names that many parts share, some null: every pair once, listed behind the last shuffle."""
    monkeypatch.setattr(Q, "KEYS", 3, raising=False)
    r = random.Random(2)
    rows = [(i // 2, f"b{i % 2}", r.choice([1, 1, 1, None]), r.choice(["oak chair", "oak table", "tin chair", None])) for i in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    ratio = lambda x, y: None if x is None or y is None else round(difflib.SequenceMatcher(None, x, y, autojunk=False).ratio(), 4)
    want = [(a[0], b[0], ratio(a[3], b[3])) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] == b[2] == 1]
    found = Q.QUERIES["similarity_ratio"](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    tree = plan(found)
    assert "Generate" in tree and tree.index("Generate") < tree.index("Exchange")


def _members(n: int, most: int):
    r = random.Random(7)
    return [(f"m{i % (n - 3)}", [r.choice("abcdefghijklmno") for _ in range(r.randint(0, most))] + [None]) for i in range(n)] + [(None, ["a"])]


def test_a_pair_comes_from_its_first_key_without_a_shuffle_of_pairs(spark):
    rows = _members(40, 4)
    df = spark.createDataFrame(rows, "m string, ks array<string>")
    keys = {}
    for m, ks in rows:
        keys.setdefault(m, set()).update(k for k in ks if k)
    want = sorted((a, b) for a in keys for b in keys if a and b and a < b and keys[a] & keys[b])
    found = twins.blocked_pairs(df, "m", F.col("ks"))
    assert sorted(map(tuple, found.collect())) == want
    assert "keys=[lo" not in plan(found)


@pytest.mark.parametrize("most", [1, 4, 14])
def test_pairs_are_counted_without_being_made(spark, most):
    df = spark.createDataFrame(_members(40, most), "m string, ks array<string>")
    assert twins.count_pairs(df, "m", F.col("ks")).first().pairs_resolved == twins.blocked_pairs(df, "m", F.col("ks")).count()


@pytest.mark.parametrize("n", [1, 4, 5, 23])
def test_a_fold_in_pieces_is_the_plain_loop(spark, monkeypatch, n):
    monkeypatch.setattr(ranking, "FOLD", 4)
    sizes = [(i, random.Random(i).randint(0, 9)) for i in range(n)]
    got = ranking.greedy_budget_rows(spark.createDataFrame([("g", i, s) for i, s in sizes], "g string, i long, s int"), "g", "i", "s", 30).collect()
    assert [r.i for r in sorted(got, key=lambda r: r.i) if r.taken] == ranking.greedy_budget(sizes, 30)[0]
    assert len(got) == n


def test_folding_keeps_a_slice_of_a_batch_as_objects(spark, monkeypatch):
    values = ["ＡB  c", None, "", "Straße　x"] * 50
    seen = [r.f for r in spark.createDataFrame([(v,) for v in values], "v string").coalesce(1).select(text.fold(F.col("v")).alias("f")).collect()]
    assert seen == [None if v is None else text.fold_value(v) for v in values]
    assert text.SLICE < len(values)


def test_unchanged_rows_of_a_delta_do_not_meet_in_one_task(plain):
    before = plain.range(4000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    after = before.withColumn("v", F.when(F.col("k") % 50 == 0, "w").otherwise(F.col("v"))).union(plain.createDataFrame([(9001, "new")], "k long, v string"))
    changes = delta.row_delta(before, after, "k", ["v"])
    done = delta.apply_delta(before, changes, after, "k", ["v"])
    assert share(done) < 0.5
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, after.collect()))


def _item(key, kind, parent, title="t"):
    return (key, kind, parent, None, title, None, None, None, None, None, None)


ITEM = "item_key string, media_kind string, parent_key string, grandparent_key string, title string, parent_title string, grandparent_title string, child_count int, leaf_count int, album_count int, part_count int"


def test_items_without_a_parent_do_not_meet_in_one_task(plain):
    rows = [_item(f"f{i}", "movie", None) for i in range(2000)] + [_item("s", "show", None, "S"), _item("a", "season", "s", "A"), _item("e", "episode", "a"), _item("x", "episode", "gone")]
    found = hierarchy.derive_copies(plain.createDataFrame(rows, ITEM))
    assert share(found) < 0.5
    told = {r.item_key: r for r in found.where("media_kind <> 'movie'").collect()}
    assert (told["e"].d_grandparent_title, told["e"].d_grandparent_key, told["e"].d_parent_title) == ("S", "s", "A")
    assert (told["s"].d_child_count, told["s"].d_leaf_count, told["x"].d_parent_title) == (1, 1, None)


def test_screening_folds_titles_of_roots_alone(spark):
    """Titles of films and shows go through Python, those of seasons and episodes don't."""
    from curatrix.plans import catalogue

    items = catalogue.records(spark, SF).where("media_kind in ('season', 'episode')")
    assert "ArrowEvalPython" not in plan(screen.file_claims(items).limit(1)) or screen.file_claims(items).isEmpty()
    checked = screen.catalogue_checks(items, None).where("media_kind = 'episode'")
    assert "ArrowEvalPython" not in plan(checked.select("item_key", "checks"))
