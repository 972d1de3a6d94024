from __future__ import annotations

import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from curatrix.functions import parse, pointer, text
from curatrix.plans import queries as Q


def test_ladder_values():
    assert text.rungs_of("The  Straße: Amélie!") == ("the strasse: amélie!", "the strasse amélie", "strasse amélie", "strasse amelie")
    assert text.fold_value("ﬁn  X") == "fin x"


def test_ratio_is_asymmetric_and_without_junk():
    assert text.ratio_of("tide", "diet") != text.ratio_of("diet", "tide")
    assert text.ratio_of("a" * 300, "a" * 300) == 1.0


def test_comparators(spark):
    rows = [("a", "a"), ("The Café", "cafe"), ("Sanderson, Brandon", "Brandon Sanderson"), ("abc", "abd"), ("", "x"), (None, "x"), ("xyz", "abc")]
    df = spark.createDataFrame(rows, "o string, a string")
    title = [r.s for r in df.select(text.compare_title(F.col("o"), F.col("a")).alias("s")).collect()]
    assert [(s.strength, s.rule) for s in title] == [("exact", "identity"), ("normalized", "strip_diacritics"), ("fuzzy", "ratio"), ("fuzzy", "ratio"), ("none", "empty"), ("none", "empty"), ("none", "no_match")]
    assert title[3].score == text.ratio_of("abc", "abd") and title[0].score is None
    person = df.select(text.compare_person(F.col("o"), F.col("a")).alias("s")).collect()[2].s
    assert (person.strength, person.rule, person.matched) == ("alias", "token_set", "Brandon Sanderson")
    aliased = spark.createDataFrame([("Foo", "Bar", ["foo", "Foo"]), ("FOO!", "Bar", [None, "foo"]), ("Bar.", "bar", ["zzz"])], "o string, a string, n array<string>")
    got = [(r.s.strength, r.s.rule, r.s.matched) for r in aliased.select(text.compare_title(F.col("o"), F.col("a"), F.col("n")).alias("s")).collect()]
    assert got == [("alias", "alias_identity", "Foo"), ("alias", "alias_strip_punctuation", "foo"), ("normalized", "strip_punctuation", None)]
    year = spark.createDataFrame([(2001, 2001), (2001, 2002), (1972, 2002), (None, 1)], "o int, a int").select(text.compare_year(F.col("o"), F.col("a")).alias("y")).collect()
    assert [(r.y.support.strength, r.y.delta) for r in year] == [("exact", 0), ("fuzzy", -1), ("none", -30), ("none", None)]


def test_positions(spark):
    values = ["0", "00", "3.50", "03", "0.5", " 2.0 ", "", "1.25"]
    got = [r.p for r in spark.createDataFrame([(v,) for v in values], "v string").select(text.normalize_position(F.col("v")).alias("p")).collect()]
    assert got == ["0", "0", "3.5", "3", "0.5", "2", "", "1.25"]


def test_guids(spark):
    cases = {
        "imdb://tt1": ("imdb", "tt1", None, None), "themoviedb://5?lang=en": ("tmdb", "5", None, None), "plex://movie/abc": ("plex", "movie/abc", None, None),
        "com.plexapp.agents.thetvdb://7/1/2?lang=en": ("tvdb", "7", 1, 2), "com.plexapp.agents.hama://tvdb-9/3": ("tvdb", "9", 3, None), "com.plexapp.agents.none://x": ("local", "x", None, None),
        "com.plexapp.agents.other://x/1": ("unknown", "x/1", None, None), "nothing": ("unknown", "nothing", None, None), "imdb://": ("unknown", "imdb://", None, None), "com.plexapp.agents.imdb://tt/a": ("imdb", "tt/a", None, None),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select(parse.parse_guid(F.col("raw")).alias("g")).collect()
    assert {r.g.raw: (r.g.namespace, r.g.value, r.g.season, r.g.episode) for r in rows} == cases
    many = spark.createDataFrame([("plex://b", ["tmdb://2", "imdb://t", "tmdb://2", ""])], "p string, c array<string>").select(parse.normalize_guids(F.col("p"), F.col("c")).alias("g")).first().g
    assert [(g.namespace, g.value) for g in many] == [("imdb", "t"), ("plex", "b"), ("tmdb", "2")]


def test_release_names(spark):
    names = [
        "/x/Blade.Runner.2049.2017.1080p.WEB-DL.mkv", "Show.Name.S01E02.720p.mkv", "2001 A Space Odyssey (1968) [1080p].mkv", "Spider-Man.2002.x264-GRP.mkv", "a_b - [c].mkv", "", "/d/.mkv", "1984.mkv", "Film 12001 x.mkv", "Über Straße 2010 - Extended.avi", None,
    ]
    df = spark.createDataFrame(list(enumerate(names)), "i int, v string").coalesce(1)
    got = [r.c for r in df.select("i", parse.parse_release_name(F.col("v")).alias("c")).orderBy("i").collect()]
    assert (got[0].title, got[0].year, got[0].tags, got[0].source) == ("Blade Runner 2049", 2017, ["1080p"], "Blade.Runner.2049.2017.1080p.WEB-DL.mkv") or got[0].tags == ["1080p", "web"]
    assert (got[1].title, got[1].season, got[1].episode, got[1].tags) == ("Show Name", 1, 2, ["720p"])
    assert (got[2].title, got[2].year) == ("2001 A Space Odyssey", 1968) and (got[3].title, got[3].year, got[3].tags) == ("Spider-Man", 2002, ["x264"])
    assert [g.title for g in got[4:10]] == ["a b - c", "", "", "", "Film 12001 x", "Über Straße"] and got[7].year == 1984 and got[8].year is None and got[9].tags == ["extended"]
    assert got[10] is None
    paths = {"/m/Amelie (2001)/movie.mkv": ("Amelie", 2001, None), "/t/Cowboy Bebop/Season 1/S01E02.mkv": ("Cowboy Bebop", None, 1), "": ("", None, None), "/b/Book/CD1.m4b": ("Book", None, None), "/x/Other 1990/A.Film.1972.720p.mkv": ("A Film", 1972, None)}
    rows = spark.createDataFrame([(k,) for k in paths], "v string").coalesce(1).select("v", parse.parse_release_path(F.col("v")).alias("c")).collect()
    assert {r.v: (r.c.title, r.c.year, r.c.season) for r in rows} == paths
    assert {r.v: r.c.source for r in rows}["/m/Amelie (2001)/movie.mkv"] == "Amelie (2001)"


def test_strongest_place_in_a_path(spark):
    rows = [("/m/Solaris (1972)/x [Final Cut].mkv", "final cut"), ("/a/b.mkv", "Nothing"), (None, "x"), ("/a/b.mkv", None)]
    got = [r.s for r in spark.createDataFrame(rows, "p string, w string").coalesce(1).select(text.find_in_path(F.col("p"), F.col("w")).alias("s")).collect()]
    assert (got[0].strength, got[0].matched) == ("normalized", "Final Cut") and got[1].strength in ("none", "fuzzy") and got[2].strength == got[3].strength == "none"


def test_pointers():
    doc = {"a": [{"b": 1}, {"b": 2}], "x/y": {"~": 3}}
    assert pointer.parse("/x~1y/~0") == ["x/y", "~"] and pointer.build(["x/y", "~"]) == "/x~1y/~0"
    assert pointer.resolve(doc, "/a/1/b") == 2 and list(pointer.select(doc, "/a/*/b")) == [("/a/0/b", 1), ("/a/1/b", 2)]
    assert pointer.matches("/a/*/b", "/a/0/b") and not pointer.matches("/a/*", "/a/0/b")
    assert pointer.set_at(doc, "/a/0/b", 9)["a"][0]["b"] == 9 and doc["a"][0]["b"] == 1
    for bad in (lambda: pointer.resolve(doc, "/a/01"), lambda: pointer.resolve(doc, "/q"), lambda: pointer.parse("a"), lambda: pointer.parse("/~2"), lambda: pointer.set_at(doc, "/new", 1), lambda: pointer.matches("/a", "/*")):
        with pytest.raises(pointer.PointerError):
            bad()


def test_every_document_is_folded(spark, tmp_path):
    """All languages, characters outside ASCII and nulls take part; plain Python states the same."""
    texts = ["The  CAT\tsat", "Straße ﬁn", "İSTANBUL ẞ", "ΣΊΣΥΦΟΣ ς", "Café Ü", "ＦＵＬＬ width", "Привет\nМИР", "", None, "東京 ｶﾞ"]
    rows = [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    fold = lambda v: " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFKC", v).casefold()).split())
    want = {i: None if t is None else hashlib.sha256(fold(t).encode()).hexdigest() for i, t, _ in rows}
    assert {r.doc_id: r.folded for r in Q.QUERIES["fold_text"](spark, str(tmp_path)).collect()} == want
