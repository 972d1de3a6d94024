from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import common
from curatrix.operators import selection, stage
from curatrix.sources import listing, sinks
from curatrix.sources.bundle import Bundle, BundleChanged, BundleTaken


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_listing_prunes_pages_and_columns_and_is_read_whole(spark, tmp_path):
    rows = [(str(k), f"s{k % 3}", "movie", f"t{k}", 2000 + k, "words", ["a"], ["title"]) for k in range(50)]
    items = spark.createDataFrame(rows, "item_key string, section_id string, media_kind string, title string, year int, summary string, parts array<string>, locked_fields array<string>")
    path = f"{tmp_path}/pages"
    listing.write_pages(items, path, 4)
    own = sorted((r for r in rows if r[1] == "s1"), key=lambda r: int(r[0]))
    page = listing.read_pages(spark, path, "stub").where("section_id = 's1' and page = 2")
    assert [(r.item_key, r.place, r.total, r.fetched) for r in page.orderBy("place").collect()] == [(r[0], 8 + k, 17, "stub") for k, r in enumerate(own[8:12])]
    text = plan(page)
    assert "PartitionFilters" in text and "page" in text.split("PartitionFilters")[1].split("\n")[0] and "summary" not in text and "parts" not in text
    assert "locked_fields" not in listing.read_pages(spark, path, "files").columns and "parts" not in listing.read_pages(spark, path, "core").columns
    assert sorted(r.item_key for r in listing.crawl(spark, path).collect()) == sorted(r[0] for r in rows)
    doubled = listing.read_pages(spark, path)
    assert listing.missing_pages(doubled.union(doubled.where("page = 0 and section_id = 's0'"))).first().section_id == "s0"
    gone = next((tmp_path / "pages").glob("section_id=s2/page=1"))
    gone.rename(tmp_path / "page")
    with pytest.raises(listing.IncompleteListing, match="s2: 12 of 16"):
        listing.crawl(spark, path)
    with pytest.raises(ValueError, match="no profile"):
        listing.read_pages(spark, path, "most")


def test_digests_stream_over_a_hot_group(spark):
    rows = [("hot" if k % 3 else f"g{k}", k, None if k == 4 else "é" * (k % 7)) for k in range(400)]
    rows += [(None, 1, "null group"), ("big", 1, "x" * 3_000_000)]
    got = {r.g: (r.sha256, r.bytes) for r in sinks.digest_of(spark.createDataFrame(rows, "g string, n int, value string").repartition(5), ["g"], ["n"]).collect()}
    want = {g: b"".join((v or "").encode() + b"\n" for h, _, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1])) for g in {r[0] for r in rows}}
    assert got == {g: (hashlib.sha256(b).hexdigest(), len(b)) for g, b in want.items()}


def test_percentiles_are_exact(spark, monkeypatch):
    rng = random.Random(2)
    groups = {"normal": [rng.gauss(0, 1) for _ in range(501)], "ties": [rng.choice([1.0, 2.0, 2.0, 1e300]) for _ in range(200)], "one": [7.5], "tiny": [1 + k * 2**-52 for k in range(40)], "wide": [10.0 ** rng.randrange(-300, 300) for _ in range(77)], "none": [None, None]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(4)
    wanted = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for bins in (1024, 2):
        monkeypatch.setattr(selection, "BINS", bins)
        got = {r.g: r for r in selection.percentiles(df if bins > 2 else df.where("g in ('normal', 'ties', 'one')"), ["g"], "v", wanted).collect()}
        for g, r in got.items():
            if g == "none":
                assert all(r[n] is None for n in wanted)
            else:
                assert np.allclose([r[n] for n in wanted], np.percentile(np.array(groups[g]), [100 * p for p in wanted.values()]), rtol=1e-12, atol=0), g
    whole = selection.percentiles(df.where("g = 'normal'"), [], "v", {"m": 0.5}).first().m
    assert whole == sorted(groups["normal"])[250]


def test_a_sample_does_not_depend_on_partitions(spark):
    rows = [(k, "big" if k % 5 else "small") for k in range(300)]
    taken = [{(r.k, r.g) for r in selection.bottom_k(spark.createDataFrame(rows, "k int, g string").repartition(n), ["g"], "k", 40).collect()} for n in (1, 7)]
    assert taken[0] == taken[1] and len(taken[0]) == 80
    rank = lambda k: hashlib.sha256(f'{{"seed":1518,"subject":"{k}"}}'.encode()).hexdigest()
    assert {k for k, g in taken[0] if g == "big"} == set(sorted((k for k, g in rows if g == "big"), key=rank)[:40])


def test_a_bundle_is_put_in_force_whole_and_names_what_changed(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "bundle")
    bundle = Bundle(spark, root)
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "v string").coalesce(1)
    assert bundle.commit({"one": df("a", "b"), "two": df("c")}) == 1
    real = Bundle._swap
    monkeypatch.setattr(Bundle, "_swap", lambda self, *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):  # both tables are written, the manifest isn't
        bundle.commit({"one": df("x"), "two": df("y")})
    monkeypatch.setattr(Bundle, "_swap", real)

    class Broken:
        schema = df("z").schema

        @property
        def write(self):
            raise RuntimeError("killed between two tables")

    with pytest.raises(RuntimeError):
        bundle.commit({"one": df("x"), "two": Broken()})
    there = Bundle(spark, root).bind()
    assert sorted(r.v for r in there["one"].collect()) == ["a", "b"] and [r.v for r in there["two"].collect()] == ["c"]
    assert bundle.commit({"two": df("d")}) == 2 and [r.v for r in bundle.bind("two")["two"].collect()] == ["d"] and bundle.bind("one")["one"].count() == 2
    with pytest.raises(BundleTaken):
        bundle.commit({"two": df("e")}, expected=1)
    folder = tmp_path / "bundle" / bundle.manifest()["tables"]["one"]["folder"]
    name = next(folder.glob("part-*")).name
    spark.createDataFrame([("a",), ("B",)], "v string").coalesce(1).write.parquet(str(tmp_path / "other"))
    next((tmp_path / "other").glob("part-*")).replace(folder / name)
    (folder / f".{name}.crc").unlink(missing_ok=True)
    with pytest.raises(BundleChanged, match=f"one: {name} changed"):
        bundle.bind()
    (folder / name).unlink()
    with pytest.raises(BundleChanged, match="missing"):
        bundle.bind("one")
    assert [r.v for r in bundle.bind("two")["two"].collect()] == ["d"]


def test_stored_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, setting = disk.getAllBlocks().size(), spark.conf.get(stage.CLEANUP, None)
    for store in (stage.stored, common.stored):
        assert store(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count(), "kept").count() == 97
        assert disk.getAllBlocks().size() <= before + 2 and spark.conf.get(stage.CLEANUP, None) == setting  # of the count
        before = disk.getAllBlocks().size()
