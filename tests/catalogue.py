"""A small catalogue: films with a remake pair and twins, a show of two seasons, an author with books."""

from __future__ import annotations

import json


def _id(key):
    return {"provider": "p", "section_id": key[0], "rating_key": key}


def item(key, kind, title, parent=None, grandparent=None, **more):
    guid = more.pop("guid", None)
    files = more.pop("files", [])
    parts = [{"media_id": f"m{key}{i}", "part_id": f"f{key}{i}", "path": p, "container": "mkv"} for i, p in enumerate(files)]
    guids = [{"namespace": guid.split("://")[0], "value": guid.split("://")[1], "raw": guid}] if guid else []
    return {"item_id": _id(key), "media_kind": kind, "fetched": "full", "title": title, "guids": guids, "parts": parts, "locked_fields": ["title", "title", "art"], "parent": _id(parent) if parent else None, "grandparent": _id(grandparent) if grandparent else None, "summary": more.pop("summary", "words"), **more}


RECORDS = [
    item("101", "movie", "Amélie", year=2001, guid="imdb://tt1", files=["/m/Amelie (2001)/Amelie.2001.1080p.mkv"]),
    item("102", "movie", "Solaris", year=1972, guid="tmdb://2", files=["/m/Solaris (1972)/Solaris (1972).mkv"]),
    item("103", "movie", "Solaris", year=2002, guid="tmdb://3", files=["/m/Solaris (2002)/movie.mkv"]),
    item("104", "movie", "Blade Runner", year=1982, guid="tmdb://4", edition_title="Final Cut", files=["/m/Blade Runner (1982) [Final Cut]/br.mkv"]),
    item("105", "movie", "Twin", year=1990, files=["/m/Twin (1990)/t.mkv"]),
    item("106", "movie", "twin ", year=1990, files=["/m/Twin (1990)/t2.mkv"]),
    item("107", "movie", "Nothing", summary=" \t"),
    item("201", "show", "Cowboy", year=1998, guid="tvdb://5", child_count=2, leaf_count=4),
    item("202", "season", "Season 1", "201", index=1, parent_title="Cowboy"),
    item("203", "season", "Season 2", "201", index=2, parent_title="Cowboy"),
    *[item(f"21{s}{e}", "episode", f"E{e}", f"20{s + 1}", "201", index=e, parent_index=s, parent_title=f"Season {s}", grandparent_title="Cowboy", files=[f"/t/Cowboy/Season {s}/Cowboy S0{s}E0{e}.mkv"]) for s in (1, 2) for e in (1, 2)],
    item("401", "author", "Brandon Sanderson", album_count=3),
    item("402", "author", "Sanderson, Brandon", album_count=0),
    item("411", "audiobook", "The Way of Kings", "401", index=1, parent_title="Brandon Sanderson", series="Stormlight", series_position="1", part_count=2, guid="asin://B1"),
    item("412", "audiobook", "Stormlight: Words", "401", index=2, parent_title="Brandon Sanderson", series="Stormlight", series_position="2", part_count=1, guid="asin://B2"),
    item("413", "audiobook", "Oathbringer", "401", index=3, parent_title="Brandon Sanderson", series="Stormlight", series_position="3", part_count=1, guid="asin://B3"),
    item("421", "audiobook_part", "one", "411", "401", index=1, files=["/b/Stormlight/Book 1 - The Way of Kings/CD1.m4b"]),
    item("422", "audiobook_part", "two", "411", "401", index=2, files=["/b/Stormlight/Book 1 - The Way of Kings/CD2.m4b"]),
    item("423", "audiobook_part", "one", "412", "401", index=1, files=["/b/Stormlight/Book 2 - Words/w.m4b"]),
    item("424", "audiobook_part", "one", "413", "401", index=1, files=["/b/Stormlight/Oathbringer/CD3.m4b"]),
]


def write(path, records=RECORDS):
    path.write_text("".join(json.dumps(r) + "\n" for r in records), encoding="utf-8")
    return str(path)
