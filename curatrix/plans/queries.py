"""Catalogue operators on the driver's tables, each with the SQL that states the same rows."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse, pointer, text
from ..operators import census, delta, hierarchy, ranking, screen, truth, twins

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


_RANK = "sha256('{\"seed\":1518,\"subject\":\"' || %s || '\"}')"


# -- screen --------------------------------------------------------------------------------


def _checks(spark: SparkSession, d: str) -> DataFrame:
    """kind, item, predicate, status for customers, orders and lines."""
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    custs = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_name")
    num = screen.numbering(lines, "l_orderkey", "l_linenumber")
    o = orders.join(num.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    per = orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    c = custs.join(per, custs["c_custkey"] == per["o_custkey"], "left")
    st = screen.status
    return screen.checks(
        ("customer", "c_custkey", c, {"balance": st(F.col("c_acctbal") >= 0), "has_orders": st(F.col("n_orders") >= 5, available=F.col("n_orders").isNotNull()), "named": st(F.col("c_name") != "")}),
        ("order", "o_orderkey", o, {"contiguous": st(F.col("contiguous"), available=F.col("contiguous").isNotNull()), "priced": st(F.col("o_totalprice") > 0), "closed": st(F.col("o_orderstatus") != "O")}),
        ("line", "l_orderkey", lines, {"quantity": st(F.col("l_quantity") <= 45), "discount": st(F.col("l_discount") <= 0.09), "taxed": st(F.col("l_tax") > 0, available=F.col("l_discount") > 0)}),
    )


_CHECKS_SQL = """
num AS (SELECT l_orderkey, count(*) = count(DISTINCT l_linenumber) AND max(l_linenumber) - min(l_linenumber) + 1 = count(DISTINCT l_linenumber) AND min(l_linenumber) <= 1 AS ok FROM lineitem GROUP BY 1),
per AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
wide AS (
  SELECT 'customer' AS kind, c_acctbal >= 0 AS p1, n >= 5 AS p2, c_name <> '' AS p3, 'balance' AS n1, 'has_orders' AS n2, 'named' AS n3, n IS NULL AS u2, FALSE AS u3 FROM customer LEFT JOIN per ON o_custkey = c_custkey
  UNION ALL SELECT 'order', o_totalprice > 0, ok, o_orderstatus <> 'O', 'priced', 'contiguous', 'closed', ok IS NULL, FALSE FROM orders LEFT JOIN num ON l_orderkey = o_orderkey
  UNION ALL SELECT 'line', l_quantity <= 45, l_discount <= 0.09, l_tax > 0, 'quantity', 'discount', 'taxed', FALSE, NOT l_discount > 0 FROM lineitem),
s AS (SELECT kind, n1, n2, n3, CASE WHEN p1 THEN 'pass' ELSE 'fail' END AS s1, CASE WHEN u2 THEN 'unavailable' WHEN p2 THEN 'pass' ELSE 'fail' END AS s2, CASE WHEN u3 THEN 'unavailable' WHEN p3 THEN 'pass' ELSE 'fail' END AS s3 FROM wide),
long AS (SELECT kind, n1 AS predicate, s1 AS status FROM s UNION ALL SELECT kind, n2, s2 FROM s UNION ALL SELECT kind, n3, s3 FROM s)
"""


@query("screen_verdict_by_kind", f"WITH {_CHECKS_SQL} SELECT kind, CASE WHEN 'fail' IN (s1, s2, s3) THEN 'failed' WHEN 'unavailable' IN (s1, s2, s3) THEN 'insufficient' ELSE 'guarded' END AS verdict, count(*) AS n FROM s GROUP BY ALL")
def screen_verdict_by_kind(spark, d):
    """Verdict of every item (any fail: failed; three applicable: guarded) counted by kind; no shuffle before the counts."""
    return screen.verdicts(_checks(spark, d)).groupBy("kind", "verdict").agg(F.count("*").alias("n"))


@query("predicate_summary", f"WITH {_CHECKS_SQL} SELECT kind, predicate, status, count(*) AS n FROM long GROUP BY ALL")
def predicate_summary(spark, d):
    return screen.summary(_checks(spark, d))


@query(
    "numbering_contiguous",
    """SELECT 'lineitem' AS family, l_orderkey AS parent, count(*) AS n, CASE WHEN count(*) > count(DISTINCT l_linenumber) THEN 'duplicate' WHEN max(l_linenumber) - min(l_linenumber) + 1 > count(DISTINCT l_linenumber) THEN 'gap' WHEN min(l_linenumber) > 1 THEN 'start' ELSE 'ok' END AS outcome FROM lineitem GROUP BY 2
    UNION ALL SELECT 'conversations', conv_id, count(*), CASE WHEN count(*) > count(DISTINCT turn) THEN 'duplicate' WHEN max(turn) - min(turn) + 1 > count(DISTINCT turn) THEN 'gap' WHEN min(turn) > 1 THEN 'start' ELSE 'ok' END FROM conversations GROUP BY 2""",
)
def numbering_contiguous(spark, d):
    out = [("lineitem", "l_orderkey", "l_linenumber"), ("conversations", "conv_id", "turn")]
    parts = [screen.numbering(table(spark, d, t, p, i), p, i).select(F.lit(t).alias("family"), F.col(p).cast("long").alias("parent"), "n", "outcome") for t, p, i in out]
    return parts[0].union(parts[1])


@query(
    "guard_coverage",
    """WITH x AS (SELECT d.lang, l.quality, l.toxic, length(d.text) >= 200 AS long FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)),
    g AS (SELECT lang, cls, CASE WHEN cls = 'a' THEN [CASE WHEN quality IS NULL THEN 'u' WHEN quality = 1 THEN 'p' ELSE 'f' END, CASE WHEN long THEN 'p' ELSE 'f' END] ELSE [CASE WHEN toxic IS NULL THEN 'u' WHEN toxic = 0 THEN 'p' ELSE 'f' END] END AS s FROM x, (SELECT unnest(['a', 'b']) AS cls))
    SELECT lang, cls AS class, count(*) AS in_scope, count(*) FILTER (WHERE NOT list_contains(s, 'f') AND NOT list_contains(s, 'u')) AS guarded, count(*) FILTER (WHERE list_contains(s, 'f')) AS failed, count(*) FILTER (WHERE NOT list_contains(s, 'f') AND list_contains(s, 'u')) AS blocked FROM g GROUP BY ALL""",
)
def guard_coverage(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    x = table(spark, d, "documents", "doc_id", "lang", "text").join(labels, "doc_id", "left")
    quality = screen.status(F.col("quality") == 1, available=F.col("quality").isNotNull())
    toxic = screen.status(F.col("toxic") == 0, available=F.col("toxic").isNotNull())
    return screen.coverage(x, ["lang"], {"a": [quality, screen.status(F.length("text") >= 200)], "b": [toxic]})


@query("reason_histogram", "SELECT event_type, CASE WHEN value IS NULL THEN 'no_value' WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'middle' ELSE 'high' END AS reason, count(*) AS n FROM events GROUP BY ALL")
def reason_histogram(spark, d):
    v = F.col("value")
    reason = F.when(v.isNull(), "no_value").when(v < 10, "low").when(v < 50, "middle").otherwise("high")
    return table(spark, d, "events", "event_type", "value").groupBy("event_type", reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    "threshold_sweep",
    "SELECT f AS floor, count(*) FILTER (WHERE ratio >= f) AS n FROM (SELECT CAST(length(replace(text, ' ', '')) AS DOUBLE) / greatest(length(text), 1) AS ratio FROM documents), (SELECT CAST(unnest([0.8, 0.85, 0.9, 0.95]) AS DOUBLE) AS f) GROUP BY 1",
)
def threshold_sweep(spark, d):
    ratio = F.length(F.replace("text", F.lit(" "), F.lit(""))).cast("double") / F.greatest(F.length("text"), F.lit(1))
    rows = table(spark, d, "documents", "text").select(ratio.alias("ratio"))
    return screen.sweep(rows, F.col("ratio"), screen.FLOORS)


# -- hierarchy -----------------------------------------------------------------------------


@query("parent_lookup", "SELECT o_orderkey, o_custkey, c_name AS parent_title FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def parent_lookup(spark, d):
    return hierarchy.with_parent(table(spark, d, "orders", "o_orderkey", "o_custkey"), table(spark, d, "customer"), "o_custkey", "c_custkey", parent_title="c_name")


@query("orphans", "SELECT 'lineitem' AS child, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'customer', count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphans(spark, d):
    pairs = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id"), ("customer", "c_custkey", "orders", "o_custkey")]
    out = [hierarchy.orphans(table(spark, d, c, k), table(spark, d, p, pk), k, pk).agg(F.count("*").alias("n")).select(F.lit(c).alias("child"), "n") for c, k, p, pk in pairs]
    return out[0].union(out[1]).union(out[2])


@query("grandparent", "SELECT c_custkey, n_name AS parent_title, r_name AS grandparent_title FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def grandparent(spark, d):
    one = hierarchy.with_parent(table(spark, d, "customer", "c_custkey", "c_nationkey"), table(spark, d, "nation"), "c_nationkey", "n_nationkey", parent_title="n_name", up="n_regionkey")
    return hierarchy.with_parent(one, table(spark, d, "region"), "up", "r_regionkey", grandparent_title="r_name").select("c_custkey", "parent_title", "grandparent_title")


@query("derived_count_violations", "SELECT o_orderkey, o_orderkey % 7 AS stored, coalesce(n, 0) AS derived FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 7 <> coalesce(n, 0)")
def derived_count_violations(spark, d):
    parents = table(spark, d, "orders", "o_orderkey").withColumn("stored", F.col("o_orderkey") % 7)
    return hierarchy.derived_count_violations(parents, table(spark, d, "lineitem", "l_orderkey"), "o_orderkey", "l_orderkey", "stored").select("o_orderkey", "stored", "derived")


# -- twins ---------------------------------------------------------------------------------


@query("title_kind_twins", "SELECT p_partkey, n AS group_size FROM part JOIN (SELECT lower(p_name) AS t, p_size AS s, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1) g ON lower(p_name) = t AND p_size IS NOT DISTINCT FROM s")
def title_kind_twins(spark, d):
    return twins.twin_groups(table(spark, d, "part"), [F.lower("p_name"), F.col("p_size")], "p_partkey").select("p_partkey", "group_size")


@query("remake_partners", "SELECT p_partkey, p_name, p_size FROM part p WHERE EXISTS (SELECT 1 FROM part q WHERE q.p_name = p.p_name AND q.p_size <> p.p_size)")
def remake_partners(spark, d):
    return twins.remake_pairs(table(spark, d, "part"), "p_name", "p_size", "p_partkey")


@query(
    "donor_other_title",
    f"""WITH r AS (SELECT p_brand, p_name, p_partkey, {_RANK % "p_partkey"} AS k FROM part),
    best AS (SELECT p_brand, p_name, min({{'k': k, 'm': p_partkey}}) AS b FROM r GROUP BY 1, 2)
    SELECT p_partkey, d.m AS donor FROM (SELECT r.p_partkey, (SELECT min(b) FROM best WHERE best.p_brand = r.p_brand AND best.p_name <> r.p_name) AS d FROM r) WHERE d IS NOT NULL""",
)
def donor_other_title(spark, d):
    return twins.donors(table(spark, d, "part"), ["p_brand"], "p_name", "p_partkey")



_PEOPLE_SQL = "p AS (SELECT 'c' || c_custkey AS id, c_name AS name, c_nationkey AS nk FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, s_nationkey FROM supplier), e AS (SELECT id, 'n' || right(name, 2) || nk AS block FROM p UNION SELECT id, 'k' || right(name, 3) FROM p), pairs AS (SELECT DISTINCT a.id AS lo, b.id AS hi FROM e a JOIN e b USING (block) WHERE a.id < b.id)"


def _people(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nk"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), "s_name", "s_nationkey")
    return c.union(s), F.array(F.concat(F.lit("n"), F.right("name", F.lit(2)), F.col("nk").cast("string")), F.concat(F.lit("k"), F.right("name", F.lit(3))))


@query("blocked_pairs", f"WITH {_PEOPLE_SQL} SELECT lo, hi FROM pairs")
def blocked_pairs(spark, d):
    people, keys = _people(spark, d)
    return twins.blocked_pairs(people, "id", keys)


@query("twin_blocking_stats", f"WITH {_PEOPLE_SQL} SELECT (SELECT count(*) FROM p) AS population, (SELECT count(DISTINCT block) FROM e) AS buckets, CAST((SELECT count(*) * (count(*) - 1) / 2 FROM p) AS BIGINT) AS pairs_possible, (SELECT count(*) FROM pairs) AS pairs_resolved, CAST((SELECT count(*) * (count(*) - 1) / 2 FROM p) AS BIGINT) - (SELECT count(*) FROM pairs) AS pairs_skipped")
def twin_blocking_stats(spark, d):
    people, keys = _people(spark, d)
    return twins.blocking_stats(people, "id", keys)


@query("collateral_semi", "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 50 <> 0 AND (p_name, p_size) IN (SELECT p_name, p_size FROM part WHERE p_partkey % 50 = 0 UNION SELECT p_name, p_size + 1 FROM part WHERE p_partkey % 50 = 0)")
def collateral_semi(spark, d):
    part = table(spark, d, "part", "p_partkey", "p_name", "p_size")
    old = part.where("p_partkey % 50 = 0")
    return twins.collateral(part, old.union(old.withColumn("p_size", F.col("p_size") + 1)), ["p_name", "p_size"], "p_partkey").select("p_partkey", "p_name", "p_size")


@query("authority_first_match", "WITH k AS (SELECT doc_id, pos, k FROM (SELECT doc_id, unnest([doc_id % 97, doc_id % 41, doc_id % 13]) AS k, unnest([0, 1, 2]) AS pos FROM documents)) SELECT doc_id, first(item_id ORDER BY pos) AS item_id, CAST(min(pos) AS INT) AS pos FROM k JOIN benchmark ON item_id = k GROUP BY 1")
def authority_first_match(spark, d):
    keys = table(spark, d, "documents", "doc_id").select("doc_id", F.posexplode(F.array(*[F.col("doc_id") % n for n in (97, 41, 13)])).alias("pos", "k"))
    hit = keys.join(table(spark, d, "benchmark", "item_id"), F.col("k") == F.col("item_id"))
    return hit.groupBy("doc_id").agg(F.min_by("item_id", "pos").alias("item_id"), F.min("pos").alias("pos"))


# -- census --------------------------------------------------------------------------------


@query("count_desc_key_asc", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def count_desc_key_asc(spark, d):
    return census.counts_by(table(spark, d, "events", "event_type"), "event_type")


@query("presence", "SELECT 'value' AS field, count(*) FILTER (WHERE value > 0) AS present, count(*) - count(*) FILTER (WHERE value > 0) AS absent FROM events UNION ALL SELECT 'props', count(*) FILTER (WHERE props <> ''), count(*) - count(*) FILTER (WHERE props <> '') FROM events UNION ALL SELECT 'even_user', count(*) FILTER (WHERE user_id % 2 = 0), count(*) - count(*) FILTER (WHERE user_id % 2 = 0) FROM events")
def presence(spark, d):
    return census.presence(table(spark, d, "events", "value", "props", "user_id"), value=F.col("value") > 0, props=F.col("props") != "", even_user=F.col("user_id") % 2 == 0)


@query("capped_examples", "SELECT lang, array_to_string(list_sort(list(DISTINCT source))[1:5], ',') AS examples, greatest(count(DISTINCT source) - 5, 0) AS dropped FROM documents GROUP BY 1")
def capped_examples(spark, d):
    return census.capped_examples(table(spark, d, "documents", "lang", "source"), "lang", "source").select("lang", F.array_join("examples", ",").alias("examples"), "dropped")


@query("section_classification", "SELECT event_type, round(avg(CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS share, round(median(value), 6) AS median, avg(CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 0.0 END) >= 0.3 AND median(value) >= 10 AS matches FROM events GROUP BY 1")
def section_classification(spark, d):
    out = census.classify_sections(table(spark, d, "events", "event_type", "user_id", "value"), "event_type", F.col("user_id") % 3 == 0, F.col("value"), share=0.3, least=10.0)
    return out.select("event_type", F.round("share", 6).alias("share"), F.round("median", 6).alias("median"), "matches")


@query(
    "readiness_counts",
    """SELECT 0 AS rank, 'large_orders' AS name, (SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS n
    UNION ALL SELECT 1, 'long_orders', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 6))
    UNION ALL SELECT 2, 'remakes', (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1))
    UNION ALL SELECT 3, 'twins', (SELECT count(*) FROM (SELECT p_name, p_size FROM part GROUP BY 1, 2 HAVING count(*) > 1))""",
)
def readiness_counts(spark, d):
    part = table(spark, d, "part", "p_name", "p_size")
    return census.readiness(
        ("large_orders", table(spark, d, "orders", "o_totalprice").where("o_totalprice > 100000")),
        ("long_orders", table(spark, d, "lineitem", "l_orderkey").groupBy("l_orderkey").count().where("count > 6")),
        ("remakes", part.groupBy("p_name").agg(F.count_distinct("p_size").alias("n")).where("n > 1")),
        ("twins", census.duplicated(part, "p_name", "p_size")),
    )


@query("population", "SELECT c_mktsegment AS section, n_name AS agent, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS n_roots FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def population(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.col("c_mktsegment").alias("section"), F.lit("customer").alias("kind"), F.col("n_name").alias("agent"), (F.col("c_acctbal") > 0).alias("is_root"))
    return census.population(rows, section="section", kind="kind", agent="agent").drop("kind")


# -- ranking -------------------------------------------------------------------------------


@query("pick_by_hash_rank", f"SELECT p_brand, min(k) AS rank, arg_min(p_partkey, k) AS p_partkey FROM (SELECT p_brand, p_partkey, {_RANK % 'p_partkey'} AS k FROM part) GROUP BY 1")
def pick_by_hash_rank(spark, d):
    return ranking.pick_by_rank(table(spark, d, "part", "p_brand", "p_partkey"), ["p_brand"], "p_partkey")


@query("ticket_cap", f"SELECT c_mktsegment, c_custkey, rn FROM (SELECT c_mktsegment, c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_RANK % 'c_custkey'}, c_custkey) AS INT) AS rn FROM customer) WHERE rn <= 3")
def ticket_cap(spark, d):
    c = table(spark, d, "customer", "c_mktsegment", "c_custkey")
    return ranking.top_per_group(c, ["c_mktsegment"], [ranking.rank_key(F.col("c_custkey")), F.col("c_custkey")], ranking.CASES_PER_SUBJECT)


@query(
    "attempt_until_n",
    f"""WITH r AS (SELECT o_orderpriority, o_orderkey, o_orderstatus = 'F' AS ok, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_RANK % 'o_orderkey'}, o_orderkey) AS INT) AS rn FROM orders),
    s AS (SELECT *, coalesce(sum(CAST(ok AS INT)) OVER (PARTITION BY o_orderpriority ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM r WHERE rn <= 15)
    SELECT o_orderpriority, o_orderkey, rn, ok FROM s WHERE done < 5""",
)
def attempt_until_n(spark, d):
    o = table(spark, d, "orders", "o_orderpriority", "o_orderkey", "o_orderstatus")
    return ranking.attempt_until(o, ["o_orderpriority"], [ranking.rank_key(F.col("o_orderkey")), F.col("o_orderkey")], F.col("o_orderstatus") == "F", 5).select("o_orderpriority", "o_orderkey", "rn", "ok")


@query("apportion_webster", "WITH c AS (SELECT n_name, CAST(n_nationkey AS BIGINT) * 3 + 1 AS share FROM nation), p AS (SELECT n_name, row_number() OVER (ORDER BY CAST(share AS DOUBLE) / (2 * k + 1) DESC, n_name) AS r FROM c, range(0, 138) t(k)) SELECT c.n_name, share, count(r) AS seats FROM c LEFT JOIN p ON p.n_name = c.n_name AND r <= 138 GROUP BY 1, 2")
def apportion_webster(spark, d):
    cells = table(spark, d, "nation").select("n_name", (F.col("n_nationkey").cast("long") * 3 + 1).alias("share"))
    return ranking.apportion_rows(cells, "n_name", "share", 138)


@query(
    "allocate_remainder",
    """WITH s AS (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), e AS (SELECT *, n * 200 / CAST((SELECT sum(n) FROM s) AS DOUBLE) AS exact FROM s),
    b AS (SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, n_name) AS r FROM e)
    SELECT n_name, n, CAST(least(n, base + CASE WHEN r <= 200 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM b""",
)
def allocate_remainder(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return ranking.allocate(c.groupBy("n_name").agg(F.count("*").alias("n")), "n_name", "n", 200)


@query("surrogate_keys", "SELECT s_nationkey, s_suppkey, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS new_key FROM supplier")
def surrogate_keys(spark, d):
    s = table(spark, d, "supplier", "s_nationkey", "s_suppkey")
    top = s.agg(F.max("s_suppkey").alias("top"))
    return ranking.surrogate_keys(s.crossJoin(F.broadcast(top)), ["s_nationkey"], [F.col("s_suppkey")], F.col("top")).drop("top")


@query("renumber", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position FROM lineitem")
def renumber(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return ranking.surrogate_keys(li, ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")], F.lit(0).cast("long")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("new_key").alias("position"))


@query("round_robin_split", "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 3 AS part FROM orders")
def round_robin_split(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderkey")
    return o.withColumn("part", ((F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) % 3).cast("long"))


@query("free_position", "SELECT l_orderkey, list_min(list_filter(range(1, 99), lambda x: NOT list_contains(used, x))) AS free FROM (SELECT l_orderkey, list(DISTINCT CAST(l_linenumber AS BIGINT)) AS used FROM lineitem GROUP BY 1)")
def free_position(spark, d):
    return ranking.free_position(table(spark, d, "lineitem", "l_orderkey", "l_linenumber"), "l_orderkey", F.col("l_linenumber")).select("l_orderkey", F.col("free").cast("long").alias("free"))


@query("page_slice", "SELECT doc_id, source, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY source, doc_id LIMIT 20 OFFSET 100")
def page_slice(spark, d):
    return ranking.page(table(spark, d, "documents", "doc_id", "source"), ["source", "doc_id"], 100, 20)


def _item_keys(customers: DataFrame) -> DataFrame:
    """key, place: customers in the order of their item keys."""
    key = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("sw"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string"))
    return ranking.total_order(customers.select(key.alias("key")), ranking.key_order(F.col("key")), "place")


@query("item_key_order", "SELECT key, row_number() OVER (ORDER BY NOT regexp_matches(key, '^[0-9]+$'), try_cast(key AS HUGEINT), key) AS place FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'sw' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS key FROM customer)")
def item_key_order(spark, d):
    return _item_keys(table(spark, d, "customer", "c_custkey"))


@query("variant_choice", f"SELECT p_partkey, CAST(('0x' || substr({_RANK % 'p_partkey'}, 1, 8)) AS BIGINT) % 3 AS variant FROM part")
def variant_choice(spark, d):
    return table(spark, d, "part", "p_partkey").select("p_partkey", ranking.variant(ranking.rank_key(F.col("p_partkey")), 3).alias("variant"))


@query(
    "greedy_budget",
    """WITH RECURSIVE r AS (SELECT p_brand, p_partkey, CAST(p_size AS BIGINT) AS p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part),
    f AS (SELECT p_brand, p_partkey, p_size, rn, p_size <= 500 AS taken, CASE WHEN p_size <= 500 THEN p_size ELSE 0 END AS used FROM r WHERE rn = 1
      UNION ALL SELECT r.p_brand, r.p_partkey, r.p_size, r.rn, f.used + r.p_size <= 500, f.used + CASE WHEN f.used + r.p_size <= 500 THEN r.p_size ELSE 0 END FROM f JOIN r ON r.p_brand = f.p_brand AND r.rn = f.rn + 1)
    SELECT p_brand, p_partkey, p_size, taken FROM f""",
)
def greedy_budget(spark, d):
    """The order-dependent fold per brand; a test also compares with the plain loop."""
    part = table(spark, d, "part", "p_brand", "p_partkey", "p_size")
    return ranking.greedy_budget_rows(part, "p_brand", "p_partkey", "p_size", 500)


# -- deltas --------------------------------------------------------------------------------

_COLS = ["o_orderstatus", "o_orderpriority", "o_totalprice"]


def _worlds(spark, d):
    before = table(spark, d, "orders", "o_orderkey", *_COLS)
    k = F.col("o_orderkey")
    kept = before.where(k % 11 != 0).withColumn("o_orderstatus", F.when(k % 5 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")))
    added = before.where(k % 13 == 0).withColumn("o_orderkey", k + 10_000_000)
    return before, kept.union(added)


_AFTER_SQL = "a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey + 10000000, o_orderstatus, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 13 = 0)"


@query(
    "row_delta",
    f"""WITH {_AFTER_SQL}, j AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS key, b.o_orderkey IS NULL AS isnew, a.o_orderkey IS NULL AS gone, b.o_orderstatus AS b1, a.o_orderstatus AS a1, b.o_orderpriority AS b2, a.o_orderpriority AS a2 FROM orders b FULL JOIN a USING (o_orderkey))
    SELECT key, 'add' AS kind, '' AS path, NULL AS before, NULL AS after FROM j WHERE isnew UNION ALL SELECT key, 'remove', '', NULL, NULL FROM j WHERE gone
    UNION ALL SELECT key, 'modify', '/o_orderstatus', b1, a1 FROM j WHERE NOT isnew AND NOT gone AND b1 IS DISTINCT FROM a1 UNION ALL SELECT key, 'modify', '/o_orderpriority', b2, a2 FROM j WHERE NOT isnew AND NOT gone AND b2 IS DISTINCT FROM a2""",
)
def row_delta(spark, d):
    before, after = _worlds(spark, d)
    return delta.row_delta(before, after, "o_orderkey", _COLS)


@query("apply_delta", f"WITH {_AFTER_SQL} SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM a")
def apply_delta(spark, d):
    before, after = _worlds(spark, d)
    return delta.apply_delta(before, delta.row_delta(before, after, "o_orderkey", _COLS), after, "o_orderkey", _COLS)


@query("reverse_delta", "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders")
def reverse_delta(spark, d):
    before, after = _worlds(spark, d)
    return delta.reverse_delta(after, delta.row_delta(before, after, "o_orderkey", _COLS), before, "o_orderkey", _COLS)


@query("must_not_change", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(['/brand', '/name', '/size', '/parts/0/path'], lambda x: NOT list_contains(CASE WHEN p_size % 2 = 0 THEN ['/name', '/size'] WHEN p_size % 3 = 0 THEN ['/brand', '/parts/0/path'] ELSE ['/parts/0/path'] END, x) AND (x <> '/parts/0/path')) || CASE WHEN p_size % 2 = 0 THEN ['/parts/*/path'] ELSE [] END)), ',') AS fixed FROM part")
def must_not_change(spark, d):
    """What a repair must leave alone: the places that a witness cites and all files, but for what the edits touched."""
    p, even = table(spark, d, "part", "p_partkey", "p_size"), F.col("p_size") % 2 == 0
    paths = F.when(even, F.array(F.lit("/name"), F.lit("/size"))).when(F.col("p_size") % 3 == 0, F.array(F.lit("/brand"), F.lit("/parts/0/path"))).otherwise(F.array(F.lit("/parts/0/path")))
    edits = p.select(F.col("p_partkey").alias("case_id"), F.lit("modify").alias("kind"), F.explode(paths).alias("path"))
    cited = p.select(F.col("p_partkey").alias("case_id"), F.explode(F.array(*map(F.lit, ("/brand", "/name", "/size", "/parts/0/path")))).alias("pointer"))
    return truth.must_not_change(edits, cited).select(F.col("case_id").alias("p_partkey"), F.array_join("must_not_change", ",").alias("fixed"))


@query(
    "ci_diff",
    "WITH b AS (SELECT o_orderkey AS k, o_totalprice > 50000 AS ok FROM orders WHERE o_orderkey % 9 <> 0), a AS (SELECT o_orderkey AS k, o_totalprice > 60000 OR o_orderkey % 17 = 0 AS ok FROM orders WHERE o_orderkey % 8 <> 0) SELECT CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'gone' WHEN b.ok AND NOT a.ok THEN 'regressed' WHEN a.ok AND NOT b.ok THEN 'fixed' ELSE 'same' END AS change, count(*) AS n FROM b FULL JOIN a USING (k) GROUP BY 1",
)
def ci_diff(spark, d):
    """Extension: outcomes of two runs compared by case."""
    o, k = table(spark, d, "orders", "o_orderkey", "o_totalprice"), F.col("o_orderkey")
    b = o.where(k % 9 != 0).select(k.alias("bk"), (F.col("o_totalprice") > 50000).alias("b_ok"))
    a = o.where(k % 8 != 0).select(k.alias("ak"), ((F.col("o_totalprice") > 60000) | (k % 17 == 0)).alias("a_ok"))
    kind = F.when(F.col("bk").isNull(), "new").when(F.col("ak").isNull(), "gone").when(F.col("b_ok") & ~F.col("a_ok"), "regressed").when(F.col("a_ok") & ~F.col("b_ok"), "fixed").otherwise("same")
    return b.join(a, F.col("bk") == F.col("ak"), "full_outer").groupBy(kind.alias("change")).agg(F.count("*").alias("n"))


# -- scalar functions ----------------------------------------------------------------------


@query("fold_text")
def fold_text(spark, d):
    """Folding on every document; no SQL states casefold and NFKC, a test compares with plain Python."""
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("folded"))


@query("path_parse", "SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/')[1] AS host, regexp_replace(list_last(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), lambda x: x <> '')), '\\.[A-Za-z0-9]{2,4}$', '') AS leaf, CAST(len(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), lambda x: x <> '')) AS INT) AS depth FROM pages")
def path_parse(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    segments = parse.raw_segments(path)
    return table(spark, d, "pages", "page_id", "url").select("page_id", F.get(segments, F.lit(0)).alias("host"), F.regexp_replace(F.element_at(segments, -1), "\\.[A-Za-z0-9]{2,4}$", "").alias("leaf"), F.size(segments).alias("depth"))


@query("json_pointer", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_pointer(spark, d):
    return table(spark, d, "events", "event_id", "props").select("event_id", pointer.get(F.col("props"), "/k").cast("long").alias("k"))


@query("guid_parse", "SELECT page_id, CASE WHEN contains(url, '://') AND regexp_extract(url, '://([^?]*)', 1) <> '' THEN CASE WHEN regexp_extract(url, '^(.*?)://', 1) IN ('imdb', 'tmdb', 'tvdb', 'plex', 'asin', 'mbid', 'local') THEN regexp_extract(url, '^(.*?)://', 1) ELSE 'unknown' END ELSE 'unknown' END AS namespace, CASE WHEN contains(url, '://') AND regexp_extract(url, '://([^?]*)', 1) <> '' THEN regexp_extract(url, '://([^?]*)', 1) ELSE url END AS value, url AS raw FROM pages")
def guid_parse(spark, d):
    """Page addresses as identifiers: of no known scheme, so they keep their text."""
    return table(spark, d, "pages", "page_id", "url").withColumn("g", parse.parse_guid(F.col("url"))).select("page_id", "g.namespace", "g.value", "g.raw")


@query("uri_parts", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS value, nullif(regexp_extract(url, '[?](.*?)(#.*)?$', 1), '') AS query FROM pages")
def uri_parts(spark, d):
    g = parse.split_uri(F.col("url"))
    return table(spark, d, "pages", "page_id", "url").select("page_id", g["scheme"].alias("scheme"), g["value"].alias("value"), g["query"].alias("query"))


@query("content_hash", "SELECT doc_id, 'sha256:' || sha256(lang || '|' || source || '|' || sha256(text)) AS evidence_id FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents", "doc_id", "lang", "source", "text").select("doc_id", text.evidence_id(F.col("lang"), F.col("source"), F.sha2("text", 256)).alias("evidence_id"))


@query("similarity_ratio")
def similarity_ratio(spark, d):
    """Ratcliff-Obershelp ratio between part names of one brand and size; no SQL equals it, a test compares with difflib."""
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_size", "p_name")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _block_ratios(p, _name_pairs(p), n).select("l_key", "r_key", "ratio")


#: Keys of one name that go through the joins of a block as one row.
KEYS = 4096


def _block_ratios(parts: DataFrame, met: DataFrame, n: int) -> DataFrame:
    """l_key, r_key, ratio of all pairs of a brand and size; ``met``: the different pairs of names.

    The keys of a name are lists, of ``KEYS`` at most: what is shuffled are pairs of lists and their names, and the
    pairs of keys are listed behind the last join.
    """
    block = ["p_brand", "p_size"]
    nth = F.row_number().over(Window.partitionBy(*block, "p_name").orderBy("p_partkey")) - 1
    numbered = parts.where("p_partkey is not null").withColumn("_nth", F.floor(nth / KEYS))
    lists = numbered.groupBy(*block, "p_name", "_nth").agg(F.sort_array(F.collect_list("p_partkey")).alias("keys"))
    dealt = lists.repartition(n, *block)  # by number: the rows are few for their pairs
    l, r = (dealt.select(*block, F.col("p_name").alias(f"{k}_name"), F.col("keys").alias(f"{k}_keys")) for k in "lr")  # noqa: E741
    pairs = l.join(r, block).where(F.get("l_keys", F.lit(0)) < F.element_at("r_keys", -1)).drop(*block)
    scored = text.with_ratio(pairs, met, "l_name", "r_name", "ratio").select("l_keys", F.explode("r_keys").alias("r_key"), "ratio")
    return scored.select(F.explode("l_keys").alias("l_key"), "r_key", "ratio").where("l_key < r_key")


def _name_pairs(parts: DataFrame) -> DataFrame:
    """l_name, r_name: which two names meet in a brand and size, each such pair once, in either order."""
    names = parts.select("p_brand", "p_size", "p_name").distinct()
    l, r = (names.select("p_brand", "p_size", F.col("p_name").alias(f"{k}_name")) for k in "lr")  # noqa: E741
    return l.join(r, ["p_brand", "p_size"]).select("l_name", "r_name").distinct()


def apportion_exact(counts: list[tuple[str, int]], seats: int) -> dict[str, int]:
    return ranking.apportion([(n, Fraction(c)) for n, c in counts], seats)


from . import cases as _cases, catalogue as _records, storage as _storage  # noqa: E402, F401  register their queries
