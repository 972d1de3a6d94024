"""JSON pointers: column access for fixed pointers, plain functions for generic ones."""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class PointerError(ValueError):
    """The pointer is malformed or names nothing."""


def parse(pointer: str) -> list[str]:
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise PointerError(f"{pointer!r} must be empty or start with '/'")
    out = []
    for part in pointer[1:].split("/"):
        if "~" in part.replace("~0", "").replace("~1", ""):
            raise PointerError(f"{pointer!r} has a '~' that is not '~0' or '~1'")
        out.append(part.replace("~1", "/").replace("~0", "~"))
    return out


def build(parts: list[str]) -> str:
    return "".join("/" + p.replace("~", "~0").replace("/", "~1") for p in parts)


def has_wildcard(pointer: str) -> bool:
    return "*" in parse(pointer)


def matches(selector: str, pointer: str) -> bool:
    """Same length, each segment equal or ``*`` in the selector; a wildcard pointer is an error."""
    if has_wildcard(pointer):
        raise PointerError(f"{pointer!r} is a selector, not a pointer")
    a, b = parse(selector), parse(pointer)
    return len(a) == len(b) and all(x in ("*", y) for x, y in zip(a, b, strict=True))


def _index(part: str, size: int, pointer: str) -> int:
    if not part.isascii() or not part.isdigit() or (part != "0" and part[0] == "0") or int(part) >= size:
        raise PointerError(f"{pointer!r}: {part!r} is no index of an array of {size}")
    return int(part)


def _step(node, part: str, pointer: str):
    if isinstance(node, list):
        return node[_index(part, len(node), pointer)]
    if isinstance(node, dict) and part in node:
        return node[part]
    raise PointerError(f"{pointer!r}: nothing at {part!r}")


def resolve(document, pointer: str):
    for part in parse(pointer):
        document = _step(document, part, pointer)
    return document


def select(document, selector: str) -> Iterator[tuple[str, object]]:
    """All (pointer, value) the selector reaches; object keys in order; a key named ``*`` is an error."""

    def walk(node, done: list[str], left: list[str]):
        if not left:
            yield build(done), node
            return
        if left[0] != "*":
            try:
                below = _step(node, left[0], selector)
            except PointerError:
                return
            yield from walk(below, [*done, left[0]], left[1:])
        elif isinstance(node, dict):
            if "*" in node:
                raise PointerError(f"{selector!r}: a key is named '*'")
            for k in sorted(node):
                yield from walk(node[k], [*done, k], left[1:])
        elif isinstance(node, list):
            for i, v in enumerate(node):
                yield from walk(v, [*done, str(i)], left[1:])

    yield from walk(document, [], parse(selector))


def set_at(document, pointer: str, value):
    """A copy with the existing place replaced; nothing is created."""
    parts = parse(pointer)
    if not parts:
        return copy.deepcopy(value)
    out = copy.deepcopy(document)
    node = out
    for part in parts[:-1]:
        node = _step(node, part, pointer)
    _step(node, parts[-1], pointer)
    node[_index(parts[-1], len(node), pointer) if isinstance(node, list) else parts[-1]] = value
    return out


def get(c: Column, pointer: str) -> Column:
    """The text at a fixed pointer of a JSON column, or null."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parse(pointer))
    return F.get_json_object(c, "$" + steps)


def generalize(path: Column) -> Column:
    """Array positions replaced by ``*``."""
    return F.regexp_replace(path, "/[0-9]+(?=/|$)", "/*")


def replace_at(c: Column, pointer: Column, value: Column) -> Column:
    """JSON text with the place at a per-row pointer replaced by a JSON value."""

    @F.pandas_udf("string")
    def run(d: pd.Series, p: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(set_at(json.loads(x), y, json.loads(z)), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x, y, z in zip(d, p, v, strict=True)], dtype="object")

    return run(c, pointer, value)
