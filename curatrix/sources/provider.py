"""Read-only serving of a fixed record set: sections, paged listings, point reads, search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.ranking import key_order, page
from .schema import ROOT_KINDS


class ProviderError(Exception):
    """Base of the provider's errors."""


class Retryable(ProviderError):
    """The same call may work later."""


class Correctable(ProviderError):
    """Another call will work; the message names it."""


class Terminal(ProviderError):
    """No call will work."""


@dataclass(frozen=True)
class Page:
    rows: list
    total: int
    offset: int

    @property
    def returned(self) -> int:
        return len(self.rows)


class Catalogue:
    """Seven read methods over an item table; the table is only ever filtered, ordered and limited."""

    def __init__(self, items: DataFrame, sections: list[tuple[str, str]]):
        self.items, self._sections = items, sections

    def sections(self) -> list[tuple[str, str]]:
        return list(self._sections)

    def _page(self, rows: DataFrame, order: list, offset: int, limit: int) -> Page:
        if offset < 0 or limit < 0:
            raise Correctable("offset and limit must not be negative; pass 0 or more")
        if limit == 0:
            return Page([], rows.count(), offset)
        got = page(rows, order, offset, limit).collect()
        return Page(got, got[0]["total"] if got else rows.count(), offset)

    def _listing(self, rows: DataFrame) -> tuple[DataFrame, list]:
        named = rows.withColumn("_fold", text.fold(F.coalesce("title_sort", "title")))
        return named, [F.col("_fold").asc(), *key_order(F.col("item_id.rating_key"))]

    def _section(self, section_id: str) -> DataFrame:
        if section_id not in {s for s, _ in self._sections}:
            raise Correctable(f"no section {section_id!r}; call sections() for the known ones")
        return self.items.where(F.col("section_id") == section_id)

    def list_items(self, section_id: str, offset: int, limit: int, media_kind: str | None = None) -> Page:
        rows = self._section(section_id)
        rows = rows.where(F.col("media_kind") == media_kind) if media_kind else rows.where(F.col("media_kind").isin(*ROOT_KINDS))
        return self._page(*self._listing(rows), offset, limit)

    def get_item(self, item_key: str):
        found = self.items.where(F.col("item_key") == item_key).limit(2).collect()
        if not found:
            other = self.items.where(F.col("item_id.rating_key") == item_key.rpartition(":")[2]).select("item_key").limit(1).collect()
            raise Correctable(f"no item {item_key!r}" + (f"; use {other[0][0]!r}" if other else "; list the section for its items"))
        return found[0]

    def get_children(self, item_key: str, offset: int, limit: int) -> Page:
        self.get_item(item_key)
        return self._page(self.items.where(F.col("parent_key") == item_key), [F.col("index").asc_nulls_last(), *key_order(F.col("item_id.rating_key"))], offset, limit)

    def get_files(self, item_key: str) -> list:
        return list(self.get_item(item_key)["parts"] or [])

    def find_similar(self, section_id: str, title: str, limit: int) -> list:
        if not title.strip():
            raise Correctable("the title is blank; pass the words to look for")
        rows, order = self._listing(self._section(section_id).where(F.col("media_kind").isin(*ROOT_KINDS)))
        return rows.where(text.fold(F.col("title")).contains(text.fold_value(title))).orderBy(*order).limit(limit).collect()
