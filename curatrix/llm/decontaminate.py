"""Benchmark decontamination with one Aho-Corasick automaton.

Words are maximal runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII
characters.  A window is 10 consecutive words of an item; an item with fewer
words (but some) is one window.  Words of the benchmark are numbered, and all
windows of all items, as runs of word numbers, go into a single automaton; the
text, as word numbers too, is scanned once.  A match is a range of word numbers,
taken back to byte offsets of the original text.

Size: the automaton is built in every Python worker, so the benchmark's size is
measured first.  A benchmark over ``max_chars`` is dealt to shards by hash, and
the text is scanned once a shard, in jobs of their own whose hits (few rows)
are stored and joined; driver and workers hold one shard at a time.

Defined cases: null or wordless texts have no words and no hits; null or
wordless items have no windows; null ids are dropped from item lists (they name
nothing) but their windows still hit; repeated documents are each scored;
repeated items count once by id; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

WINDOW = 10
#: Characters of a shard; an automaton takes about 120 bytes for each (measured on half a million characters of random words).
MAX_CHARS = 3_000_000
#: The automaton a Python worker has built.
_BUILT: dict[str, Index] = {}
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Byte table: A-Z to a-z, word bytes kept, everything else to a blank.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> Iterator[bytes]:
    """The item's windows, padded; an item of 1..size words is one window."""
    for i in range(max(1, len(words) - size + 1) if words else 0):
        yield b" " + b" ".join(words[i : i + size]) + b" "


class Index:
    """Numbers of the benchmark's words, and the automaton of its windows; None without windows."""

    def __init__(self, items: list[tuple], size: int = WINDOW):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set] = {}
        for item_id, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for i in range(max(1, len(words) - size + 1) if words else 0):
                windows.setdefault(tuple(words[i : i + size]), set()).add(item_id)
        self.automaton = None
        if windows:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for w, ids in windows.items():
                self.automaton.add_word(w, (len(w), tuple(i for i in ids if i is not None)))
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(merged hit ranges of word numbers, item ids); words of no item are number 0."""
        ranges: list[tuple[int, int]] = []
        ids: set = set()
        if words and self.automaton is not None:
            get = self.numbers.get
            for end, (length, items) in self.automaton.iter(tuple([get(w, 0) for w in words])):
                ranges.append((end - length + 1, end))
                ids.update(items)
        return merged(ranges), ids


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlaps; adjacent ones are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _original_spans(text: str, hit_words: list[tuple[int, int]]) -> list[dict]:
    """Word ranges -> byte offsets in the original UTF-8 text (the table maps byte to byte)."""
    flat = text.encode("utf-8", "surrogatepass").translate(TABLE)
    starts, ends, inside = [], [], False
    for i, b in enumerate(flat):
        if b != 0x20 and not inside:
            starts.append(i)
            inside = True
        elif b == 0x20 and inside:
            ends.append(i)
            inside = False
    if inside:
        ends.append(len(flat))
    return [{"first_word": a, "last_word": b, "byte_start": starts[a], "byte_end": ends[b]} for a, b in hit_words]


SPAN = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64())])
_SCHEMA = "n_words long, n_hit long, n_items long, item_ids array<string>, spans array<struct<first_word:long,last_word:long,byte_start:long,byte_end:long>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_chars: int = MAX_CHARS) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, item_ids (sorted as strings) and spans appended.

    Columns of ``docs`` with one of those names are replaced.
    """
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).distinct()
    shards = max(1, -(-(items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]) // max_chars))
    new = ("n_words", "n_hit", "n_items", "item_ids", "spans")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    if shards == 1:
        return _scanned(kept, _shard(items, 0, 1), text, window)
    row = free_name(kept, "_row")
    held = stored(kept.withColumn(row, F.monotonically_increasing_id()), "decontaminate-docs")
    hits = None
    for k in range(shards):
        found = _scanned(held.select(row, text), _shard(items, k, shards), text, window).where("n_hit > 0").select(row, "item_ids", "spans")
        found = stored(found, "decontaminate-hits")
        hits = found if hits is None else hits.union(found)
    per = hits.groupBy(row).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.flatten(F.collect_list("spans")).alias("spans"))  # a row a shard
    return _merged_hits(held.join(per, row, "left"), text).drop(row)


def _shard(items: DataFrame, k: int, shards: int) -> list[tuple]:
    """(id, text) of a shard, whose size is bounded: the only rows that come to the driver at once."""
    return [(r["id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k).collect()]


def _with_columns(kept: DataFrame, run) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, {_SCHEMA}")


def _columns(rows: list[tuple]) -> list[pa.Array]:
    """n_words, n_hit, n_items, item_ids, spans of (text, words, ranges, ids)."""
    return [
        pa.array([len(w) for _, w, _, _ in rows], pa.int64()), pa.array([sum(b - a + 1 for a, b in r) for _, _, r, _ in rows], pa.int64()), pa.array([len(i) for *_, i in rows], pa.int64()),
        pa.array([sorted(i) for *_, i in rows], pa.list_(pa.string())), pa.array([_original_spans(t, r) if r else [] for t, _, r, _ in rows], pa.list_(SPAN)),
    ]


def _scanned(kept: DataFrame, items: list[tuple], text: str, window: int) -> DataFrame:
    """One pass of the texts through the automaton of these items."""
    at, names = kept.columns.index(text), [*kept.columns, "n_words", "n_hit", "n_items", "item_ids", "spans"]
    held, token = kept.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _BUILT:
            _BUILT.clear()
            _BUILT[token] = Index(held.value, window)
        index = _BUILT[token]
        for batch in batches:
            rows = []
            for value in batch.column(at):
                words = words_of(value.as_py())
                rows.append((value.as_py(), words, *index.scan(words)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *_columns(rows)], names=names)

    return _with_columns(kept, run)


def _merged_hits(found: DataFrame, text: str) -> DataFrame:
    """Rows with the item_ids and spans of all shards -> the columns of one pass."""
    names = [c for c in found.columns if c not in ("item_ids", "spans")]
    at = names.index(text)
    rest = found.select(*[F.col(f"`{c}`") for c in names], "item_ids", F.col("spans.first_word").alias("firsts"), F.col("spans.last_word").alias("lasts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, ids, first, last in zip(*[batch.column(i) for i in (at, len(names), len(names) + 1, len(names) + 2)], strict=True):
                t = value.as_py()
                rows.append((t, words_of(t), merged(list(zip(first.as_py() or [], last.as_py() or [], strict=True))), ids.as_py() or []))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *_columns(rows)], names=[*names, "n_words", "n_hit", "n_items", "item_ids", "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields if f.name in names)
    return rest.mapInArrow(run, f"{fields}, {_SCHEMA}")


def items_digest(ids) -> F.Column:
    return F.sha2(F.array_join(ids, ","), 256)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate(docs, bench)
    return out.select("doc_id", "n_words", "n_hit", "n_items", items_digest(F.col("item_ids")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: DuckDB: words with numbers, all runs of as many words as some window has, equi-joined to the windows.
OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, i, runs.n, item_id FROM runs JOIN win ON win.s = runs.s AND win.n = runs.n),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS k FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""
