"""JSON documents: paths, reading, setting and merging."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 128


class PathError(ValueError):
    """A path that isn't one, or that a document has no place for."""


def parse_path(path: str) -> list[str | int]:
    """Fields and indices of a path such as $, $.a.b[2] or a.b."""
    rest, out = path.removeprefix("$"), []
    while rest:
        if len(out) >= MAX_DEPTH:
            raise PathError("ERR JSON path too deep")
        if rest[0] == "[":
            index, closed, rest = rest[1:].partition("]")
            if not closed:
                raise PathError("ERR invalid JSON path: unterminated index")
            if not (index.removeprefix("+").isascii() and index.removeprefix("+").isdigit()):
                raise PathError("ERR invalid JSON path: bad index")
            out.append(int(index))
            continue
        named = rest.removeprefix(".")
        end = min((k for k in (named.find("."), named.find("[")) if k >= 0), default=len(named))
        if end == 0 and rest[0] == ".":
            raise PathError("ERR invalid JSON path: empty field")
        out.append(named[:end])
        rest = named[end:]
    return out


def variant_path(path: str) -> str:
    """The same path as Spark's variant functions write it; these have no way to write a field that holds both kinds of quotes."""

    def quoted(field: str) -> str:
        mark = '"' if "'" in field else "'"
        if mark in field:
            raise PathError("ERR invalid JSON path: both kinds of quotes in a field")
        return f"[{mark}{field}{mark}]"

    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f".{s}" if s.isidentifier() else quoted(s) for s in parse_path(path))


def read_path(document: Column, path: str = "$") -> Column:
    """The JSON text at a path of a JSON text, object fields sorted; JSON null is `null`, a missing place is null."""
    return F.to_json(F.try_variant_get(F.try_parse_json(document), variant_path(path), "variant"))


def dumps(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def get_at(document: object, path: str) -> tuple[bool, object]:
    """(whether the place exists, what is there)."""
    for step in parse_path(path):
        if isinstance(step, int) and isinstance(document, list) and step < len(document) or isinstance(step, str) and isinstance(document, dict) and step in document:
            document = document[step]
        else:
            return False, None
    return True, document


def set_at(document: object, path: str, value: object) -> tuple[object, str | None]:
    """(document with the value set, error). Null places become objects on the way to a field, and stay so if a later step fails."""
    steps = parse_path(path)
    if not steps:
        return value, None
    root = [document]
    holder, slot = root, 0
    for step in steps:
        here = holder[slot]
        if isinstance(step, str):
            if here is None:
                here = holder[slot] = {}
            if not isinstance(here, dict):
                return root[0], f"ERR path segment '.{step}' is not an object"
            here.setdefault(step, None)
        else:
            if not isinstance(here, list):
                return root[0], f"ERR path segment '[{step}]' is not an array"
            if step >= len(here):
                return root[0], f"ERR index {step} out of bounds (len {len(here)})"
        holder, slot = here, step
    holder[slot] = value
    return root[0], None


def merged(target: object, patch: object) -> object:
    """RFC 7386: objects merge, null removes a field, anything else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merged(out.get(k), v)
    return out


def size_of(value: object) -> int:
    """Accounting bytes: 8 for null and booleans, 16 for numbers, text bytes + 8, containers 8 and what they hold."""
    if value is None or isinstance(value, bool):
        return 8
    if isinstance(value, (int, float)):
        return 16
    if isinstance(value, str):
        return len(value.encode()) + 8
    if isinstance(value, list):
        return 8 + sum(map(size_of, value))
    return 8 + sum(len(k.encode()) + size_of(v) for k, v in value.items())
