"""Glob patterns with `*` (any bytes) and `?` (one byte); everything else, brackets too, is literal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest pattern accepted, in bytes.
MAX_PATTERN_BYTES = 1024


def as_bytes_text(text: Column) -> Column:
    """The UTF-8 bytes of a text, one character each."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def glob(text: Column, pattern: str) -> Column:
    """Whether text matches a fixed pattern. Prefix, suffix and infix patterns become predicates that Catalyst pushes to Parquet."""
    if len(pattern.encode()) > MAX_PATTERN_BYTES:
        raise ValueError("pattern is too long")
    if "?" in pattern:
        return F.rlike(as_bytes_text(text), F.lit(regex(pattern)))
    parts = pattern.split("*")
    if len(parts) == 1:
        return text == pattern
    if not any(parts):
        return text.isNotNull()
    if len(parts) == 2:
        head, tail = parts
        if not tail:
            return text.startswith(head)
        if not head:
            return text.endswith(tail)
    if len(parts) == 3 and not parts[0] and not parts[2]:
        return text.contains(parts[1])
    escaped = "%".join(p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for p in parts)
    return text.like(escaped)


def regex(pattern: str) -> str:
    """A Java regular expression over as_bytes_text() for a fixed pattern."""
    out = []
    for c in pattern.encode().decode("latin-1"):
        out.append(".*" if c == "*" else "." if c == "?" else c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):x}}}")
    return "(?s)\\A" + "".join(out) + "\\z"


def glob_column(text: Column, pattern: Column) -> Column:
    """Whether text matches a pattern that is a column, as in a join of keys and subscriptions."""
    quoted = F.regexp_replace(as_bytes_text(pattern), r"([^A-Za-z0-9*?])", r"\\$1")
    expression = F.concat(F.lit("(?s)\\A"), F.replace(F.replace(quoted, F.lit("?"), F.lit(".")), F.lit("*"), F.lit(".*")), F.lit("\\z"))
    return F.rlike(as_bytes_text(text), expression)
