"""Main-text extraction by consensus host paths.

1. Each page is parsed into block-level containers and text blocks.  A container
   is boilerplate by its tag, or by a word of its class, id or role; but one that
   holds more than half of the page's running text is no boilerplate by such a
   word, unless it is the readers' comments.  A container is scored by the text
   below it that is neither boilerplate nor mostly links; the page has one vote
   for the deepest container that holds all of it.  Lists and tables are parts of
   a text and never such a container.
2. A container's path is generalised: tags and classes with digits replaced.
   Spark adds the votes per (host, path) before the shuffle and ranks the paths
   of each host.
3. Every page is read again.  Paths voted for by a fifth of the host's pages
   win; a page's own vote stands if it wins, otherwise all containers on winning
   paths are extracted, without boilerplate below them.  A page without any, or
   whose larger part stands in an article, main element or under a first-level
   heading outside them, uses its own vote.

Text: character references decoded, white space inside a block made one space
and trimmed, blocks joined by two line feeds, in page order.

Defined cases: null or empty html gives empty text; a null or host-less url
votes with all such pages under an empty host; pages of only boilerplate give
empty text; repeated pages are each extracted (and each vote); broken markup is
read leniently (unclosed elements end with their parents); an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A path wins with this part of its host's votes.
SHARE = 0.2
#: Part of a page's running text above which a container is kept whatever its name, and an article outside the winning paths counts.
MOST = 0.5
#: Blocks with a larger part of link text are not good text.
MAX_LINKS = 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_BLOCK = frozenset(
    "html body div section article main nav header footer aside ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset p h1 h2 h3 h4 h5 h6 "
    "blockquote pre figure figcaption address details summary hgroup dialog menu center noscript template head".split()
)
_RAW = frozenset("script style textarea title noembed noframes xmp iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BREAKS = frozenset(["hr"])
_DROPPED_TAGS = frozenset("head nav footer aside form menu dialog noscript template button select svg canvas object audio video math".split())
#: Elements whose start ends an open element of the named kinds.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: With headings, what no text is ever narrowed down to.
_PARTS = frozenset("p pre ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote figure figcaption".split())
_SCOPE = frozenset("ul ol dl table td th div section article main body blockquote".split())
#: Words of class, id and role names that mark boilerplate.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner banners menu menubar nav navbar navigation breadcrumb breadcrumbs "
    "header masthead topbar toolbar footer foot bottom copyright legal sidebar side aside rail widget widgets related recommended recommendations more share sharing social "
    "comment comments commentlist discussion replies reply respond disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe subscription newsletter "
    "signup login search searchbox form pagination pager tags taglist toc skip hidden complementary contentinfo".split()
)
#: Words whose containers are dropped even if they hold most of a page.
_COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


class Page:
    """Containers (parent, path, dropped) and text blocks (text, link characters, container) of a page."""

    __slots__ = ("parent", "path", "dropped", "blocks", "named")

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.path: list[str] = [""]
        self.dropped: list[bool] = [False]
        self.blocks: list[tuple[str, int, int]] = []
        #: Containers that a word of their names calls boilerplate.
        self.named: set[int] = set()
        self._read(source)
        if self.named:
            self._drop_named()

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        text: list[str] = []
        link_chars = links = 0
        skip: list[str] = []  # open inline elements whose content is not text

        def flush() -> None:
            nonlocal link_chars
            joined = " ".join("".join(text).split())
            if joined:
                self.blocks.append((joined, link_chars, stack[-1][1]))
            text.clear()
            link_chars = 0

        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            part = source[at : m.start()] if m else source[at:]
            if part and not skip:
                part = _html.unescape(part) if "&" in part else part
                text.append(part)
                if links:
                    link_chars += len(part.strip())
            if not m:
                break
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if skip and tag == skip[-1]:
                    skip.pop()
                elif tag == "a":
                    links = max(0, links - 1)
                elif tag in _BLOCK and any(t == tag for t, _ in stack):
                    flush()
                    while stack.pop()[0] != tag:
                        pass
                continue
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else n
                continue
            if tag in _VOID:
                if tag in _BREAKS:
                    flush()
                else:
                    text.append(" " if tag == "br" else "")
                continue
            if tag in _DROPPED_TAGS and tag not in _BLOCK:
                if not m[3].endswith("/"):
                    skip.append(tag)
                continue
            if tag == "a":
                links += 1
                continue
            if tag not in _BLOCK:
                continue
            flush()
            self._close_implied(stack, tag)
            if m[3].endswith("/"):
                continue
            self._open(stack, tag, m[3])
        flush()

    @staticmethod
    def _close_implied(stack: list[tuple[str, int]], tag: str) -> None:
        """A block start ends an open paragraph; items, cells and rows end their like."""
        if stack[-1][0] == "p" or (stack[-1][0][:1] == "h" and stack[-1][0][1:].isdigit() and tag[:1] == "h" and tag[1:].isdigit()):
            stack.pop()
        ends = _CLOSES.get(tag, ())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in ends:
                del stack[i:]
                break
            if stack[i][0] in _SCOPE:
                break
        if tag == "body" and stack[-1][0] == "head":
            stack.pop()

    def _open(self, stack: list[tuple[str, int]], tag: str, attributes: str) -> None:
        above = stack[-1][1]
        name, dropped, named = tag, self.dropped[above] or tag in _DROPPED_TAGS, False
        if attributes:
            found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attributes)}
            classes = found.get("class", "").split()
            if classes:
                name = f"{tag}.{'.'.join(sorted(re.sub('[0-9]+', '#', c) for c in classes))}"
            if tag not in ("html", "body", "article", "main") and not dropped:
                words = {w.lower() for v in (*classes, found.get("id", ""), found.get("role", "")) for w in _SPLIT.split(v) if w} if classes or "id" in found or "role" in found else set()
                named = bool(words & _NAMES) and not words & _COMMENTS
                dropped = bool(words & _COMMENTS) or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        if tag == "header" and not any(t in ("article", "main") for t, _ in stack):
            dropped = True
        self.parent.append(above)
        self.path.append(f"{self.path[above]}/{name}")
        self.dropped.append(dropped)
        if named and not dropped:
            self.named.add(len(self.parent) - 1)
        stack.append((tag, len(self.parent) - 1))

    def _drop_named(self) -> None:
        """Containers with a boilerplate name are dropped, with all below, unless they hold most of the running text."""
        size = self.good()
        for k in range(1, len(self.parent)):  # a child comes after its parent
            self.dropped[k] = self.dropped[k] or self.dropped[self.parent[k]] or (k in self.named and size[k] <= MOST * size[0])

    def good(self) -> list[int]:
        """Characters of good text at and below each container."""
        out = [0] * len(self.parent)
        for text, links, k in self.blocks:
            if not self.dropped[k] and links <= MAX_LINKS * len(text):
                out[k] += len(text)
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out

    def vote(self) -> tuple[str, int]:
        """(path, good text) of the deepest container with all of the page's good text."""
        good = self.good()
        at = 0
        for k in range(1, len(good)):  # a child comes after its parent
            if self.parent[k] == at and good[k] == good[0] > 0 and not self._leaf(k):
                at = k
        return self.path[at], good[at]

    def _leaf(self, k: int) -> bool:
        tag = self.path[k].rpartition("/")[2].partition(".")[0]
        return tag in _PARTS or (tag[:1] == "h" and tag[1:].isdigit())

    def _inside(self, paths: tuple[str, ...]) -> list[bool]:
        inside = [False] * len(self.parent)
        for k in range(len(self.parent)):
            inside[k] = self.path[k] in paths or (k > 0 and inside[self.parent[k]])
        return inside

    def elsewhere(self, *paths: str) -> int:
        """Characters of good text outside all containers on ``paths`` in articles, main elements and containers with a first-level heading."""
        inside, marked = self._inside(paths), [False] * len(self.parent)
        for k, path in enumerate(self.path):
            tag = path.rpartition("/")[2].partition(".")[0]
            if tag in ("article", "main"):
                marked[k] = True
            elif tag == "h1" and not inside[k]:
                marked[self.parent[k]] = marked[self.parent[k]] or self.parent[k] > 0
        for k in range(1, len(marked)):
            marked[k] = marked[k] or marked[self.parent[k]]
        return sum(len(t) for t, links, k in self.blocks if marked[k] and not inside[k] and not self.dropped[k] and links <= MAX_LINKS * len(t))

    def text(self, *paths: str) -> str:
        """Blocks of all containers on ``paths``, without dropped ones below."""
        inside = self._inside(paths)
        return "\n\n".join(t for t, _, k in self.blocks if inside[k] and not self.dropped[k])


def extract_page(source: str | None, winning: list[str] | None) -> str:
    """Main text of a page, given its host's winning paths."""
    page = Page(source or "")
    own, there = page.vote()[0], set(page.path)
    found = [p for p in winning or [] if p in there]
    if own in found or not found or page.elsewhere(*found) > MOST * page.good()[0]:
        return page.text(own)
    return page.text(*found)


def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """host, paths: the host's winning container paths, most votes first (ties: by path); five at most."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [Page(v.as_py() or "").vote() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v[0] for v in votes], pa.string()), pa.array([int(v[1] > 0) for v in votes], pa.int64())], names=["host", "path", "votes"])

    votes = rows.mapInArrow(run, "host string, path string, votes long").where("votes > 0").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    all_votes = votes.groupBy("host").agg(F.sum("votes").alias("all"))
    won = votes.join(all_votes, "host").where(F.col("votes") >= SHARE * F.col("all"))
    return won.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("rank"), "path"))), lambda s: s["path"]).alias("paths"))


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    best = stored(host_paths(pages, url=url, html=html), "host-paths")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    joined = rows.join(best, "host", "left").select("page_id", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_page(h.as_py(), p.as_py()) for h, p in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[page_id].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op10_extract(spark, sf_dir: str) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
