"""Listings, digests, bundles, samples and order statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection
from ..operators.stage import fresh_path, stored
from ..sources import listing, sinks
from ..sources.bundle import Bundle
from .queries import _RANK, query, table


def _catalogue(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").cast("string").alias("item_key"), F.col("p_brand").alias("section_id"), F.lit("movie").alias("media_kind"), F.col("p_name").alias("title"), (F.col("p_size") + 1950).alias("year"), F.col("p_type").alias("summary"), F.array(F.lit("title")).alias("locked_fields"), F.array("p_name").alias("parts"))


@query("listing_page", "SELECT section_id, page, place, total, item_key, title, year, 'stub' AS fetched FROM (SELECT p_brand AS section_id, CAST(p_partkey AS VARCHAR) AS item_key, p_name AS title, p_size + 1950 AS year, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 30 AS INT) AS page, count(*) OVER (PARTITION BY p_brand) AS total FROM part) WHERE page = 1")
def listing_page(spark, d):
    """The second page of every section as stubs: a partition filter and four columns."""
    path = fresh_path(spark, "listing")
    listing.write_pages(_catalogue(spark, d), path, 30)
    return listing.read_pages(spark, path, "stub").where("page = 1").drop("media_kind")


@query("listing_crawl", "SELECT p_brand AS section_id, count(*) AS n, max(p_partkey) AS last, CAST(ceil(count(*) / 30.0) AS BIGINT) AS pages FROM part GROUP BY 1")
def listing_crawl(spark, d):
    """All pages of every section, checked to be complete."""
    path = fresh_path(spark, "listing")
    listing.write_pages(_catalogue(spark, d), path, 30)
    return listing.crawl(spark, path, "core").groupBy("section_id").agg(F.count("*").alias("n"), F.max(F.col("item_key").cast("long")).alias("last"), F.count_distinct("page").alias("pages"))


@query("family_digests", "SELECT l_orderkey, sha256(string_agg(line, '' ORDER BY l_linenumber, line)) AS sha256, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM (SELECT l_orderkey, l_linenumber, l_partkey || '|' || l_suppkey || '|' || l_returnflag || chr(10) AS line FROM lineitem) GROUP BY 1")
def family_digests(spark, d):
    """The bytes of every order's lines in order, by a streaming digest."""
    line = F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_returnflag")
    return sinks.digest_of(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", line.alias("value")), ["l_orderkey"], ["l_linenumber", "value"])


@query("exact_percentiles", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.95) AS p95, quantile_cont(l_extendedprice, 0.0) AS least, quantile_cont(l_extendedprice, 1.0) AS most FROM lineitem GROUP BY 1")
def exact_percentiles(spark, d):
    """Exact percentiles of every line's price by three groups, by refining histograms."""
    return selection.percentiles(table(spark, d, "lineitem", "l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", {"median": 0.5, "p95": 0.95, "least": 0.0, "most": 1.0})


@query(
    "sampled_types",
    f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {_RANK % 'event_id'}, CAST(event_id AS VARCHAR)) AS rn FROM events), s AS (SELECT event_type, count(*) AS sampled, round(avg(CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 9) AS share, round(median(value * 20000), 6) AS median FROM r WHERE rn <= 40 GROUP BY 1), p AS (SELECT event_type, count(*) AS population, bool_or(value > 1e9) AS marked FROM events GROUP BY 1) SELECT event_type, population, sampled, share, median, marked OR (share >= 0.5 AND median >= 600000) AS matches FROM p JOIN s USING (event_type)",
)
def sampled_types(spark, d):
    """What kind of section each event type is, from forty of its events by hash rank."""
    e = table(spark, d, "events", "event_id", "event_type", "user_id", "value")
    out = selection.sampled_types(e, "event_type", "event_id", F.col("user_id") % 3 == 0, F.col("value") * 20000, F.col("value") > 1e9)
    return out.select("event_type", "population", "sampled", F.round("share", 9).alias("share"), F.round("median", 6).alias("median"), "matches")


@query("bundle_tables", "SELECT 'orders' AS name, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders UNION ALL SELECT 'lines', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem")
def bundle_tables(spark, d):
    """Two tables put in force together, checked against their manifest and read through it."""
    bundle = Bundle(spark, fresh_path(spark, "bundle"))
    bundle.commit({"orders": table(spark, d, "orders"), "lines": table(spark, d, "lineitem")})
    found = bundle.bind()
    count = lambda n, k: found[n].agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum(k).alias("keys"))
    return stored(count("orders", "o_orderkey").unionByName(count("lines", "l_orderkey")).select("name", "n", "keys"), "bundle-counts")
