"""The catalogue's own operators on records made of the driver's tables: customers as shows, orders as seasons, lines as episodes, parts as films.

``_CAT`` states the same records in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import census, export, generate, hierarchy, library, scoring, screen
from .queries import query, table

_CAT = """cat AS (
  SELECT 'c' || c_custkey AS item_key, 'show' AS media_kind, CASE WHEN c_custkey % 53 = 0 THEN 's2' ELSE 's1' END AS section_id, NULL AS parent_key, NULL AS grandparent_key, c_name AS title, NULL AS year,
    NULL AS index, NULL AS parent_index, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 12 END AS child_count, NULL AS parent_title, 'imdb' AS ns, c_mktsegment AS summary, NULL AS path FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'season', 's1', CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'none' ELSE 'c' || o_custkey END, NULL, o_orderpriority, NULL,
    CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderkey % 4 END, NULL, NULL, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'x' ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END, NULL, NULL, NULL FROM orders
  UNION ALL SELECT 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS INT), 'episode', 's1', CASE WHEN l_partkey % 101 = 0 THEN 'c1' ELSE 'o' || l_orderkey END, CASE WHEN l_suppkey % 10 = 0 THEN 'c0' WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'none' ELSE 'c' || o_custkey END, l_shipmark, NULL,
    CASE WHEN l_quantity = 13 THEN NULL ELSE l_linenumber END, l_orderkey % 4 + CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END, NULL, NULL, CASE WHEN l_partkey % 4 = 0 THEN 'tvdb' ELSE 'local' END, 'words', CASE WHEN l_quantity = 7 THEN NULL WHEN l_quantity = 8 THEN '/t/x.mkv' ELSE '/t/x.S0' || l_orderkey % 4 || 'E0' || l_linenumber || '.mkv' END
    FROM (SELECT *, CAST(l_linenumber AS VARCHAR) AS l_shipmark FROM lineitem) JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT 'm' || p_partkey, 'movie', p_brand, NULL, NULL, p_name, 1950 + p_size, NULL, NULL, NULL, NULL, CASE p_partkey % 5 WHEN 0 THEN 'imdb' WHEN 1 THEN 'local' WHEN 2 THEN NULL WHEN 3 THEN 'tmdb' ELSE 'tvdb' END,
    CASE WHEN p_partkey % 7 = 0 THEN '  ' ELSE p_type END, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE '/m/' || CASE WHEN p_partkey % 9 = 0 THEN 'zzz' ELSE replace(p_name, ' ', '.') END || '.(' || (1950 + p_size + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END) || ').1080p.mkv' END FROM part)"""


def _text(c: str) -> F.Column:
    return F.col(c).cast("string")


def records(spark, d: str) -> DataFrame:
    """The wide record of every customer, order, line and part."""
    show, season = table(spark, d, "customer"), table(spark, d, "orders")
    line = table(spark, d, "lineitem").join(season.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    film = table(spark, d, "part")
    key = F.col("o_orderkey")
    owner = F.when(key % 97 == 0, F.lit(None)).when(key % 89 == 0, "none").otherwise(F.concat(F.lit("c"), _text("o_custkey")))
    none = F.lit(None)
    order = ("item_key", "media_kind", "section_id", "parent_key", "grandparent_key", "title", "year", "index", "parent_index", "child_count", "parent_title", "guid", "summary", "path")
    kinds = dict.fromkeys(("year", "index", "parent_index", "child_count"), "int")

    def rows(df: DataFrame, **made) -> DataFrame:
        return df.select(*[made.get(c, none).cast(kinds.get(c, "string")).alias(c) for c in order])

    year = F.col("p_size") + 1950
    k = F.col("p_partkey")
    film_guid = F.when(k % 5 == 0, F.concat(F.lit("imdb://tt"), _text("p_partkey"))).when(k % 5 == 1, F.concat(F.lit("local://"), _text("p_partkey"))).when(k % 5 == 3, F.concat(F.lit("com.plexapp.agents.themoviedb://"), _text("p_partkey"), F.lit("?lang=en"))).when(k % 5 == 4, F.concat(F.lit("com.plexapp.agents.hama://tvdb-"), _text("p_partkey")))
    film_path = F.concat(F.lit("/m/"), F.when(k % 9 == 0, "zzz").otherwise(F.replace("p_name", F.lit(" "), F.lit("."))), F.lit(".("), (year + F.when(k % 4 == 0, 1).otherwise(0)).cast("string"), F.lit(").1080p.mkv"))
    episode_path = F.when(F.col("l_quantity") == 7, none).when(F.col("l_quantity") == 8, "/t/x.mkv").otherwise(F.concat(F.lit("/t/x.S0"), (F.col("l_orderkey") % 4).cast("string"), F.lit("E0"), _text("l_linenumber"), F.lit(".mkv")))
    parts = [
        rows(show, item_key=F.concat(F.lit("c"), _text("c_custkey")), media_kind=F.lit("show"), section_id=F.when(F.col("c_custkey") % 53 == 0, "s2").otherwise("s1"), title=F.col("c_name"), child_count=F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 12), guid=F.concat(F.lit("imdb://"), _text("c_custkey")), summary=F.col("c_mktsegment")),
        rows(season, item_key=F.concat(F.lit("o"), _text("o_orderkey")), media_kind=F.lit("season"), section_id=F.lit("s1"), parent_key=owner, title=F.col("o_orderpriority"), index=F.when(key % 31 != 0, key % 4), parent_title=F.when(key % 7 == 0, none).when(key % 5 == 0, "x").otherwise(F.concat(F.lit("Customer#"), F.lpad(_text("o_custkey"), 9, "0")))),
        rows(line, item_key=F.concat_ws("-", F.concat(F.lit("l"), _text("l_orderkey")), _text("l_linenumber"), _text("l_partkey"), _text("l_suppkey"), F.col("l_quantity").cast("int").cast("string")), media_kind=F.lit("episode"), section_id=F.lit("s1"), parent_key=F.when(F.col("l_partkey") % 101 == 0, "c1").otherwise(F.concat(F.lit("o"), _text("l_orderkey"))), grandparent_key=F.when(F.col("l_suppkey") % 10 == 0, "c0").otherwise(owner), title=_text("l_linenumber"), index=F.when(F.col("l_quantity") != 13, F.col("l_linenumber")), parent_index=F.col("l_orderkey") % 4 + F.when(F.col("l_suppkey") % 9 == 0, 1).otherwise(0), guid=F.concat(F.when(F.col("l_partkey") % 4 == 0, "tvdb://").otherwise("local://"), _text("l_partkey")), summary=F.lit("words"), path=episode_path),
        rows(film, item_key=F.concat(F.lit("m"), _text("p_partkey")), media_kind=F.lit("movie"), section_id=F.col("p_brand"), title=F.col("p_name"), year=year, guid=film_guid, summary=F.when(k % 7 == 0, "  ").otherwise(F.col("p_type")), path=F.when(k % 11 != 0, film_path)),
    ]
    all_ = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    null = F.lit(None).cast("string")
    file = F.struct(null.alias("media_id"), null.alias("part_id"), F.col("path").alias("path"), F.when(F.length("path") % 2 == 0, "MKV").otherwise("mp4").alias("container"), F.when(F.length("path") % 3 == 0, "1080").alias("video_resolution"))
    return all_.select(
        "*", F.lit("full").alias("fetched"), null.alias("grandparent_title"), null.alias("series_position"), null.alias("series"), null.alias("edition_title"), F.array(F.lit("title"), F.when(F.col("year") > 1975, "year").otherwise("summary")).alias("locked_fields"), *[F.lit(None).cast("int").alias(c) for c in ("leaf_count", "album_count", "part_count")],
        parse.normalize_guids(F.col("guid"), F.lit(None).cast("array<string>")).alias("guids"), F.filter(F.array(file), lambda p: p["path"].isNotNull()).alias("parts"),
    ).drop("guid", "path")


_UP = "up AS (SELECT item_key AS pk, media_kind AS pkind, section_id AS psection, parent_key AS pgrand, title AS ptitle, index AS pindex FROM cat WHERE media_kind IN ('show', 'season'))"


@query(
    "structural_violations",
    f"""WITH {_CAT}, {_UP}, l AS (SELECT * FROM cat LEFT JOIN up ON pk = parent_key WHERE media_kind IN ('season', 'episode')), v AS (
    SELECT 'duplicate_id' AS rule, '/item_id' AS path FROM cat WHERE media_kind = 'movie' AND CAST(substr(item_key, 2) AS BIGINT) % 20 = 0
    UNION ALL SELECT 'duplicate_id', '/item_id' FROM cat GROUP BY item_key HAVING count(*) > 1
    UNION ALL SELECT 'missing_parent', '/parent' FROM l WHERE parent_key IS NULL
    UNION ALL SELECT 'orphan', '/parent' FROM l WHERE parent_key IS NOT NULL AND pk IS NULL
    UNION ALL SELECT 'parent_kind', '/parent' FROM l WHERE pkind <> CASE media_kind WHEN 'season' THEN 'show' ELSE 'season' END
    UNION ALL SELECT 'parent_section', '/parent' FROM l WHERE psection <> section_id
    UNION ALL SELECT 'grandparent', '/grandparent' FROM l WHERE media_kind = 'episode' AND pk IS NOT NULL AND grandparent_key IS DISTINCT FROM pgrand)
    SELECT rule, path, count(*) AS n FROM v GROUP BY ALL""",
)
def structural_violations(spark, d):
    """All rules but shared part ids; every twentieth film is there twice."""
    items = records(spark, d)
    again = items.where((F.col("media_kind") == "movie") & (F.substring("item_key", 2, 20).try_cast("long") % 20 == 0))
    return hierarchy.structural_violations(items.union(again)).groupBy("rule", "path").agg(F.count("*").alias("n"))


@query(
    "derived_violations",
    f"""WITH {_CAT}, {_UP}, kids AS (SELECT parent_key AS k, count(*) AS n FROM cat WHERE parent_key IS NOT NULL GROUP BY 1), v AS (
    SELECT '/parent_title' AS path FROM cat JOIN up ON pk = parent_key WHERE media_kind = 'season' AND parent_title <> ptitle
    UNION ALL SELECT '/grandparent' FROM cat JOIN up ON pk = parent_key WHERE media_kind = 'episode' AND grandparent_key <> pgrand
    UNION ALL SELECT '/child_count' FROM cat LEFT JOIN kids ON k = item_key WHERE media_kind = 'show' AND child_count <> coalesce(n, 0))
    SELECT path, count(*) AS n FROM v GROUP BY 1""",
)
def derived_violations(spark, d):
    return hierarchy.derived_violations(records(spark, d)).groupBy("path").agg(F.count("*").alias("n"))


@query(
    "propagate_copies",
    f"""WITH {_CAT}, {_UP}
    SELECT item_key, CASE WHEN parent_title = ptitle AND CAST(substr(pk, 2) AS BIGINT) % 10 = 0 THEN ptitle || ' (new)' ELSE parent_title END AS parent_title FROM cat LEFT JOIN up ON pk = parent_key WHERE media_kind = 'season'
    UNION ALL SELECT 'n' || substr(item_key, 2), CASE WHEN parent_title IS NULL OR pk IS NULL THEN parent_title WHEN CAST(substr(pk, 2) AS BIGINT) % 10 = 0 THEN ptitle || ' (new)' ELSE ptitle END FROM cat LEFT JOIN up ON pk = parent_key WHERE media_kind = 'season' AND CAST(substr(item_key, 2) AS BIGINT) % 40 = 0""",
)
def propagate_copies(spark, d):
    """Every tenth show is renamed and some seasons are added: held copies that agreed, and those of new seasons, are refreshed; null ones stay null."""
    before = records(spark, d).where("media_kind in ('show', 'season')")
    number = F.substring("item_key", 2, 20).cast("long")
    after = before.withColumn("title", F.when((F.col("media_kind") == "show") & (number % 10 == 0), F.concat("title", F.lit(" (new)"))).otherwise(F.col("title")))
    added = before.where((F.col("media_kind") == "season") & (number % 40 == 0)).withColumn("item_key", F.concat(F.lit("n"), F.substring("item_key", 2, 20)))
    return hierarchy.propagate(before, after.union(added)).where("media_kind = 'season'").select("item_key", "parent_title")


_SCREENED = f"""{_CAT}, {_UP},
off AS (SELECT anc, count(*) AS eps, count(*) FILTER (WHERE known) AS known, count(*) FILTER (WHERE bad) AS bad FROM (
  SELECT unnest([pk, pgrand]) AS anc, pindex IS NOT NULL AND e.parent_index IS NOT NULL AS known, pindex <> e.parent_index AS bad FROM cat e JOIN up ON pk = e.parent_key AND pkind = 'season' WHERE e.media_kind = 'episode') WHERE anc IS NOT NULL GROUP BY 1),
num AS (SELECT parent_key AS s, count(index) > 0 AND count(index) = count(DISTINCT index) AND max(index) - min(index) + 1 = count(DISTINCT index) AND min(index) <= 1 AS ok FROM cat WHERE media_kind = 'episode' AND parent_key IS NOT NULL GROUP BY 1),
cont AS (SELECT anc, bool_and(coalesce(ok, FALSE)) AS ok FROM (SELECT unnest([s, pgrand]) AS anc, ok FROM num JOIN up ON pk = s AND pkind = 'season') WHERE anc IS NOT NULL GROUP BY 1),
same AS (SELECT section_id AS a, media_kind AS b, lower(title) AS c, year AS y, count(*) AS n FROM cat WHERE media_kind IN ('movie', 'show') GROUP BY ALL),
w AS (SELECT cat.*, up.*, eps, known, bad, cont.ok AS cont, n FROM cat LEFT JOIN up ON pk = parent_key LEFT JOIN off ON off.anc = item_key LEFT JOIN cont ON cont.anc = item_key LEFT JOIN same ON a = section_id AND b = media_kind AND c = lower(title) AND y IS NOT DISTINCT FROM year),
r AS (SELECT item_key, media_kind,
  CASE WHEN media_kind = 'season' THEN '-' WHEN ns IN ('imdb', 'tmdb', 'tvdb') THEN 'pass' ELSE 'fail no_resolvable_id' END AS resolvable_id_present,
  CASE WHEN media_kind = 'season' THEN '-' WHEN trim(coalesce(summary, '')) = '' THEN 'fail summary_empty' ELSE 'pass' END AS summary_present,
  CASE WHEN media_kind = 'movie' THEN '-' WHEN media_kind = 'episode' THEN CASE WHEN parent_key IS NULL THEN 'unavailable no_parent' WHEN pk IS NULL THEN 'unavailable parent_not_exported' WHEN pindex IS NULL OR parent_index IS NULL THEN 'unavailable season_index_missing' WHEN pindex = parent_index THEN 'pass' ELSE 'fail season_mismatch' END
    ELSE CASE WHEN eps IS NULL THEN 'unavailable no_episodes_exported' WHEN bad > 0 THEN 'fail season_mismatch' WHEN known = 0 THEN 'unavailable season_index_missing' ELSE 'pass' END END AS season_membership_coherent,
  CASE WHEN media_kind NOT IN ('show', 'season') THEN '-' WHEN cont IS NULL THEN 'unavailable no_episodes_exported' WHEN cont THEN 'pass' ELSE 'fail numbering_broken' END AS episode_numbering_contiguous,
  CASE WHEN media_kind NOT IN ('movie', 'show') THEN '-' WHEN n > 1 THEN 'fail title_year_twin' ELSE 'pass' END AS no_title_year_twin,
  CASE WHEN media_kind NOT IN ('movie', 'episode') THEN '-' WHEN path IS NULL THEN 'unavailable no_file_parts'
    WHEN media_kind = 'episode' THEN CASE WHEN index IS NULL THEN 'unavailable episode_numbering_missing' WHEN path = '/t/x.mkv' THEN 'fail no_season_episode_marker' WHEN CAST(regexp_extract(path, 'S0([0-9]+)E', 1) AS INT) = parent_index AND CAST(regexp_extract(path, 'E0([0-9]+)', 1) AS INT) = index THEN 'pass' ELSE 'fail season_episode_mismatch' END
    WHEN contains(path, 'zzz') THEN 'fail title_mismatch' WHEN CAST(regexp_extract(path, '\\(([0-9]+)\\)', 1) AS INT) <> year THEN 'fail year_mismatch' ELSE 'pass' END AS filename_matches_metadata
  FROM w)"""
_PREDICATES = ("resolvable_id_present", "summary_present", "season_membership_coherent", "episode_numbering_contiguous", "no_title_year_twin", "filename_matches_metadata")


@query(
    "catalogue_reasons",
    f"WITH {_SCREENED}, long AS ({' UNION ALL '.join(f'''SELECT '{p}' AS predicate, {p} AS s FROM r''' for p in _PREDICATES)}) SELECT predicate, split_part(s, ' ', 1) AS status, nullif(split_part(s, ' ', 2), '') AS reason, count(*) AS n FROM long WHERE s <> '-' GROUP BY ALL",
)
def catalogue_reasons(spark, d):
    """Status and reason of six of the eleven predicates (the others need authors, audiobooks or an authority)."""
    items = records(spark, d)
    checked = screen.catalogue_checks(items, items.where("media_kind in ('movie', 'show')"))
    return screen.predicate_reasons(checked).where(F.col("predicate").isin(*_PREDICATES) & (F.col("status") != "not_applicable"))


@query("item_verdicts", f"WITH {_SCREENED} SELECT media_kind, CASE WHEN len(list_filter(l, lambda x: x LIKE 'fail%')) > 0 THEN 'failed' WHEN len(list_filter(l, lambda x: x = 'pass')) >= 3 THEN 'guarded' ELSE 'insufficient' END AS verdict, count(*) AS n FROM (SELECT media_kind, [{', '.join(_PREDICATES)}] AS l FROM r) GROUP BY ALL")
def item_verdicts(spark, d):
    items = records(spark, d)
    return screen.verdict_counts(screen.item_screen(screen.catalogue_checks(items, items.where("media_kind in ('movie', 'show')"))))


_BLOCKS = "n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) FROM part UNION SELECT DISTINCT upper(left(p_name, 1)) || '. ' || split_part(p_name, ' ', 2) FROM part), t AS (SELECT name, list_sort(list_filter(string_split(regexp_replace(lower(name), '[.,]', ' ', 'g'), ' '), lambda x: x <> '')) AS words, string_split(lower(name), ' ') AS w FROM n), b AS (SELECT name, 'w' || array_to_string(words, ' ') AS k FROM t UNION SELECT name, 'i' || left(w[1], 1) || ' ' || w[-1] FROM t)"


@query(
    "author_blocking",
    f"WITH {_BLOCKS}, p AS (SELECT DISTINCT x.name AS l, y.name AS r FROM b x JOIN b y USING (k) WHERE x.name < y.name) SELECT (SELECT count(*) FROM n) AS population, (SELECT count(DISTINCT k) FROM b) AS buckets, CAST((SELECT count(*) * (count(*) - 1) / 2 FROM n) AS BIGINT) AS pairs_possible, (SELECT count(*) FROM p) AS pairs_resolved, CAST((SELECT count(*) * (count(*) - 1) / 2 FROM n) AS BIGINT) - (SELECT count(*) FROM p) AS pairs_skipped",
)
def author_blocking(spark, d):
    """Names of two words, also inverted and abbreviated, as authors: what the two blocking keys compare."""
    first, last = (F.split_part("p_name", F.lit(" "), F.lit(k)) for k in (1, 2))
    part = table(spark, d, "part", "p_name").distinct()
    names = part.select(F.col("p_name").alias("title")).union(part.select(F.concat(last, F.lit(", "), first))).union(part.select(F.concat(F.upper(F.left(first, F.lit(1))), F.lit(". "), last))).distinct()
    roots = names.select(F.col("title").alias("item_key"), "title", F.lit("author").alias("media_kind"))
    return screen.author_blocking(roots).select("population", "buckets", "pairs_possible", "pairs_resolved", "pairs_skipped")


@query("case_ids", "SELECT p_partkey, 'case-' || substr(sha256('{\"corruption_variant\":' || CASE WHEN p_size % 2 = 0 THEN 'null' ELSE '\"v' || p_size || '\"' END || ',\"media_kind\":\"movie\",\"problem_class\":' || CASE WHEN p_size % 3 = 0 THEN 'null' ELSE '\"wrong_match\"' END || ',\"slice\":\"' || p_brand || '\",\"subject_key\":\"m' || p_partkey || '\"}'), 1, 12) AS case_id FROM part")
def case_ids(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_size", "p_brand")
    size = F.col("p_size")
    own = generate.case_id(F.col("p_brand"), F.when(size % 3 != 0, "wrong_match"), F.lit("movie"), F.concat(F.lit("m"), _text("p_partkey")), F.when(size % 2 != 0, F.concat(F.lit("v"), _text("p_size"))))
    return p.select("p_partkey", own.alias("case_id"))


@query(
    "external_ids",
    """SELECT p_partkey, CASE k WHEN 0 THEN 'imdb' WHEN 1 THEN 'tvdb' WHEN 2 THEN 'tvdb' WHEN 3 THEN 'unknown' WHEN 4 THEN 'unknown' ELSE 'tmdb' END AS namespace,
    CASE k WHEN 0 THEN 'tt' || p_partkey WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 2 THEN CAST(p_partkey AS VARCHAR) WHEN 3 THEN 'x/' || p_partkey WHEN 4 THEN 'plain ' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS value,
    CASE WHEN k IN (1, 2) THEN p_size END AS season, CASE WHEN k = 1 THEN p_size % 10 END AS episode FROM (SELECT *, p_partkey % 6 AS k FROM part)""",
)
def external_ids(spark, d):
    """Identifiers of six forms taken apart: a scheme, two older agents with numbers, an unknown scheme, plain text, another name of a scheme."""
    k, own = F.col("p_partkey") % 6, _text("p_partkey")
    raw = (
        F.when(k == 0, F.concat(F.lit("imdb://tt"), own)).when(k == 1, F.concat(F.lit("com.plexapp.agents.thetvdb://"), own, F.lit("/"), _text("p_size"), F.lit("/"), (F.col("p_size") % 10).cast("string"), F.lit("?lang=en")))
        .when(k == 2, F.concat(F.lit("com.plexapp.agents.hama://tvdb-"), own, F.lit("/"), _text("p_size"))).when(k == 3, F.concat(F.lit("foo://x/"), own)).when(k == 4, F.concat(F.lit("plain "), own)).otherwise(F.concat(F.lit("themoviedb://"), own, F.lit("?lang=de")))
    )
    return table(spark, d, "part", "p_partkey", "p_size").withColumn("g", parse.parse_guid(raw)).select("p_partkey", "g.namespace", "g.value", "g.season", "g.episode")


@query("release_names", f"WITH {_CAT} SELECT item_key, CASE WHEN media_kind = 'movie' THEN CASE WHEN contains(path, 'zzz') THEN 'zzz' ELSE title END ELSE 'x' END AS title, CASE WHEN media_kind = 'movie' THEN CAST(regexp_extract(path, '\\(([0-9]+)\\)', 1) AS INT) END AS year, CASE WHEN path LIKE '%.S0%' THEN CAST(regexp_extract(path, 'S0([0-9]+)E', 1) AS INT) END AS season, CASE WHEN path LIKE '%.S0%' THEN CAST(regexp_extract(path, 'E0([0-9]+)', 1) AS INT) END AS episode, CASE WHEN media_kind = 'movie' THEN '1080p' ELSE '' END AS tags FROM cat WHERE path IS NOT NULL")
def release_names(spark, d):
    files = records(spark, d).select("item_key", F.explode("parts").alias("p")).withColumn("c", parse.parse_release_name(F.col("p.path")))
    return files.select("item_key", "c.title", "c.year", "c.season", "c.episode", F.array_join("c.tags", ",").alias("tags"))


@query("shared_namespaces", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND p_size % 2 = 0 THEN 'imdb,tmdb' WHEN p_partkey % 4 = 0 THEN 'imdb' WHEN p_size % 2 = 0 THEN 'tmdb' ELSE '' END AS shared FROM part")
def shared_namespaces(spark, d):
    own = _text("p_partkey")
    ids = lambda *raws: parse.normalize_guids(F.lit(None).cast("string"), F.array(*raws))
    one = ids(F.concat(F.lit("imdb://TT"), own), F.concat(F.lit("tmdb://"), own), F.lit("local://1"))
    two = ids(F.concat(F.when(F.col("p_partkey") % 4 == 0, "imdb://tt").otherwise("imdb://no"), own), F.concat(F.when(F.col("p_size") % 2 == 0, "themoviedb://").otherwise("tvdb://"), own), F.lit("local://1"))
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", F.array_join(parse.shared_namespaces(one, two), ",").alias("shared"))


@query("file_census", f"WITH {_CAT}, p AS (SELECT CASE WHEN length(path) % 2 = 0 THEN 'mkv' ELSE 'mp4' END AS c, CASE WHEN length(path) % 3 = 0 THEN '1080' END AS v FROM cat WHERE path IS NOT NULL) SELECT 'container' AS field, c AS value, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'video_resolution', v, count(*) FROM p WHERE v IS NOT NULL GROUP BY 2")
def file_census(spark, d):
    return census.file_census(records(spark, d))


@query("locked_fields", f"WITH {_CAT} SELECT f AS field, count(*) AS n FROM (SELECT unnest(['title', CASE WHEN year > 1975 THEN 'year' ELSE 'summary' END]) AS f FROM cat) GROUP BY 1")
def locked_fields(spark, d):
    return census.locked_fields(records(spark, d))


@query("without_guids", f"WITH {_CAT} SELECT media_kind, count(*) AS n FROM cat WHERE ns IS NULL GROUP BY 1")
def without_guids(spark, d):
    return census.without_guids(records(spark, d))


@query("namespace_census", "SELECT n AS namespace, count(DISTINCT page_id) AS items, count(*) AS ids, count(DISTINCT f) AS distinct_forms, coalesce(array_to_string(list_sort(list(DISTINCT f) FILTER (WHERE f IS NOT NULL))[1:5], ','), '') AS examples, greatest(count(DISTINCT f) - 5, 0) AS dropped FROM (SELECT page_id, 'unknown' AS n, url AS f FROM pages WHERE url IS NOT NULL AND url <> '' UNION ALL SELECT page_id, 'imdb', NULL FROM pages UNION ALL SELECT page_id, 'imdb', NULL FROM pages WHERE page_id % 2 = 0) GROUP BY 1")
def namespace_census(spark, d):
    """Addresses (of no known scheme) and one or two identifiers of every page."""
    own = F.concat(F.lit("imdb://tt"), _text("page_id"))
    more = F.when(F.col("page_id") % 2 == 0, F.concat(own, F.lit("b")))
    rows = table(spark, d, "pages", "page_id", "url").select(_text("page_id").alias("item_key"), parse.normalize_guids(F.col("url"), F.array(own, more)).alias("guids"))
    return census.namespace_census(rows).withColumn("examples", F.array_join("examples", ","))


@query(
    "export_readiness",
    f"""WITH {_CAT}, kids AS (SELECT parent_key AS k, count(*) AS n FROM cat WHERE parent_key IS NOT NULL GROUP BY 1), y AS (SELECT section_id, lower(title) AS t, year, count(*) AS n FROM cat WHERE media_kind = 'movie' GROUP BY ALL)
    SELECT 0 AS rank, 'wrong_match' AS problem_class, (SELECT count(*) FROM cat WHERE media_kind IN ('movie', 'show') AND ns IN ('imdb', 'tmdb', 'tvdb')) AS eligible
    UNION ALL SELECT 1, 'year_collision_remake', (SELECT count(*) FROM (SELECT 1 FROM y WHERE year IS NOT NULL GROUP BY section_id, t HAVING count(*) > 1))
    UNION ALL SELECT 2, 'foreign_title_variant', (SELECT count(*) FROM cat WHERE media_kind = 'movie' AND ns IN ('imdb', 'tmdb', 'tvdb'))
    UNION ALL SELECT 3, 'alternate_cut', 0 UNION ALL SELECT 4, 'missing_metadata', (SELECT count(*) FROM cat WHERE summary <> '')
    UNION ALL SELECT 5, 'duplicate_quality', (SELECT count(*) FROM y WHERE n > 1)
    UNION ALL SELECT 6, 'episode_wrong_season', (SELECT count(*) FROM (SELECT parent_key FROM cat LEFT JOIN kids ON k = item_key WHERE media_kind = 'season' AND parent_key IN (SELECT item_key FROM cat WHERE media_kind = 'show') GROUP BY 1 HAVING count(*) > 1 AND max(n) > 0))
    UNION ALL SELECT 7, 'absolute_vs_seasonal', (SELECT count(*) FROM cat JOIN kids ON k = item_key WHERE media_kind = 'season' AND n > 30)
    UNION ALL SELECT 8, 'filename_unmatchable', (SELECT count(*) FROM cat WHERE path IS NOT NULL)
    UNION ALL SELECT 9, 'series_order_broken', 0 UNION ALL SELECT 10, 'author_name_variant', 0 UNION ALL SELECT 11, 'narrator_as_author', 0 UNION ALL SELECT 12, 'multi_file_split', 0 UNION ALL SELECT 13, 'missing_series', 0 UNION ALL SELECT 14, 'anthology_omnibus', 0""",
)
def export_readiness(spark, d):
    return census.export_readiness(records(spark, d))


@query(
    "snapshot_violations",
    "WITH i AS (SELECT CASE WHEN p_partkey % 13 = 0 THEN 'old' ELSE 'new' END || ':' || p_size || ':' || p_partkey % 700 AS k, CAST(p_size AS VARCHAR) AS s, CASE WHEN p_partkey % 4 = 0 THEN 'show' ELSE 'movie' END AS kind, CASE WHEN p_partkey % 17 = 0 THEN 'stub' ELSE 'full' END AS f, p_partkey % 700 AS r FROM part) SELECT 'provider_label' AS rule, count(*) AS n FROM i WHERE k LIKE 'old%' HAVING count(*) > 0 UNION ALL SELECT 'unknown_section', count(*) FROM i WHERE CAST(s AS INT) > 40 HAVING count(*) > 0 UNION ALL SELECT 'section_kind', count(*) FROM i WHERE CAST(s AS INT) <= 40 AND CASE WHEN CAST(s AS INT) % 10 = 0 THEN TRUE WHEN CAST(s AS INT) % 2 = 0 THEN kind <> 'show' ELSE kind <> 'movie' END HAVING count(*) > 0 UNION ALL SELECT 'profile', count(*) FROM i WHERE f <> 'full' HAVING count(*) > 0 UNION ALL SELECT 'duplicate_rating_key', count(*) FROM (SELECT r FROM i GROUP BY 1 HAVING count(DISTINCT s) > 1) HAVING count(*) > 0 UNION ALL SELECT 'unmodelled_section', (SELECT count(DISTINCT p_size) FROM part WHERE p_size <= 40 AND p_size % 10 = 0)",
)
def snapshot_violations(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_size")
    k, size, null = F.col("p_partkey"), F.col("p_size"), F.lit(None).cast("string")
    key = F.concat_ws(":", F.when(k % 13 == 0, "old").otherwise("new"), _text("p_size"), (k % 700).cast("string"))
    items = p.select(key.alias("item_key"), null.alias("parent_key"), null.alias("grandparent_key"), _text("p_size").alias("section_id"), F.when(k % 4 == 0, "show").otherwise("movie").alias("media_kind"), F.when(k % 17 == 0, "stub").otherwise("full").alias("fetched"))
    sections = p.where(size <= 40).select(_text("p_size").alias("section_id"), F.when(size % 10 == 0, "photo").when(size % 2 == 0, "show").otherwise("movie").alias("section_type")).distinct()
    return library.snapshot_violations(items, sections, "new").groupBy("rule").agg(F.count("*").alias("n"))


@query("chosen_roots", "WITH s AS (SELECT c_mktsegment AS section_id, count(*) AS n FROM customer GROUP BY 1), e AS (SELECT *, n * 60 / CAST((SELECT sum(n) FROM s) AS DOUBLE) AS x FROM s), q AS (SELECT section_id, least(n, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, section_id) <= 60 - (SELECT sum(floor(x)) FROM e) THEN 1 ELSE 0 END) AS quota FROM e), r AS (SELECT c_mktsegment AS section_id, 'c' || c_custkey AS item_key, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('{\"seed\":1518,\"subject\":\"c' || c_custkey || '\"}'), 'c' || c_custkey) AS rn FROM customer) SELECT r.section_id, item_key, CAST(rn AS INT) AS rn FROM r JOIN q USING (section_id) WHERE rn <= quota")
def chosen_roots(spark, d):
    return export.chosen_roots(table(spark, d, "customer").select(F.col("c_mktsegment").alias("section_id"), F.concat(F.lit("c"), _text("c_custkey")).alias("item_key")), 60)


_RUNS = "r AS (SELECT o_orderkey, o_orderstatus AS media_kind, o_orderpriority AS problem_class, CASE WHEN o_orderkey % 4 = 0 THEN 'should_not_touch' ELSE 'synthetic' END AS slice, o_totalprice > 100000 AS passed, o_orderkey % 3 AS nf, o_orderkey % 5 = 0 AS escalated, o_orderkey % 10 = 0 AS should, o_custkey % 50 AS steps, o_totalprice AS cost FROM orders)"


def _runs(spark, d) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    few = lambda n: F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), n.cast("int"))
    return o.select(_text("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("media_kind"), F.col("o_orderpriority").alias("problem_class"), F.when(k % 4 == 0, "should_not_touch").otherwise("synthetic").alias("slice"), (F.col("o_totalprice") > 100000).alias("passed"), few(k % 3).alias("findings"), F.array(F.lit("a")).alias("expected"), (k % 5 == 0).alias("escalated"), (k % 10 == 0).alias("should_escalate"), (F.col("o_custkey") % 50).alias("steps"), F.col("o_totalprice").alias("cost"))


@query("scoring_rates", f"WITH {_RUNS} SELECT media_kind, problem_class, count(*) AS n, round(avg(CAST(passed AS INT)), 9) AS pass_rate, round(avg(CAST(nf > 0 AS INT)) FILTER (WHERE slice = 'should_not_touch'), 9) AS fp_rate_snt, round(avg(CAST(nf > 1 AS INT)), 9) AS collateral_fp_rate, round(avg(CAST(escalated AS INT)) FILTER (WHERE should), 9) AS escalation_rate, round(avg(CAST(nf = 0 AND NOT escalated AS INT)) FILTER (WHERE slice <> 'should_not_touch'), 9) AS silence_rate FROM r GROUP BY CUBE (media_kind, problem_class)")
def scoring_rates(spark, d):
    """Extension: rates of runs by kind and class, and over all of either."""
    out = scoring.rates(_runs(spark, d), "media_kind", "problem_class")
    return out.select(*[F.round(c, 9).alias(c) if c.endswith(("rate", "snt")) else c for c in out.columns])


@query("scoring_effort", f"WITH {_RUNS} SELECT media_kind, round(quantile_cont(steps, 0.5), 6) AS median_steps, round(quantile_cont(steps, 0.95), 6) AS p95_steps, round(quantile_cont(cost, 0.5), 4) AS median_cost, round(quantile_cont(cost, 0.95), 4) AS p95_cost, round(avg(cost) * 100, 2) AS cost_per_100 FROM r GROUP BY 1")
def scoring_effort(spark, d):
    """Extension: steps and cost by kind."""
    out = scoring.effort(_runs(spark, d), "media_kind")
    return out.select("media_kind", *[F.round(c, n).alias(c) for c, n in (("median_steps", 6), ("p95_steps", 6), ("median_cost", 4), ("p95_cost", 4), ("cost_per_100", 2))])
