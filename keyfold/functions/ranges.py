"""Index arithmetic of range commands: negative positions count from the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x: Column | int) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else x


def bounds(start: Column | int, stop: Column | int, length: Column) -> tuple[Column, Column]:
    """First and last position (from 0, inclusive) of an element range; first > last where it is empty."""
    start, stop, length = _column(start), _column(stop), length.cast("long")
    first = F.greatest(F.when(start < 0, length + start).otherwise(start), F.lit(0))
    last = F.least(F.when(stop < 0, length + stop).otherwise(stop), length - 1)
    return first, last


def position(index: Column | int, length: Column) -> Column:
    """Position from 0 of an index; null where there is none."""
    index, length = _column(index), length.cast("long")
    at = F.when(index < 0, length + index).otherwise(index)
    return F.when((at >= 0) & (at < length), at)


def byte_range(value: Column, start: Column | int, end: Column | int) -> Column:
    """The bytes start..end of a text or binary value as binary; empty outside it, and for null."""
    value = F.coalesce(value.cast("binary"), F.lit(b""))
    length = F.octet_length(value).cast("long")
    start, end = _column(start), _column(end)
    first = F.greatest(F.when(start < 0, start + length).otherwise(start), F.lit(0))
    last = F.greatest(F.when(end < 0, end + length).otherwise(end), F.lit(0))
    last = F.least(last, length - 1)
    return F.when((length == 0) | (first > last), F.lit(b"")).otherwise(F.substring(value, F.least(first, length).cast("int") + 1, F.greatest(last - first + 1, F.lit(0)).cast("int")))


def page(rank: Column, cursor: int, count: int = 10) -> Column:
    """Whether the row of this rank (from 0) is on the page that starts at the cursor."""
    return (rank >= cursor) & (rank < cursor + max(1, count))


def next_cursor(total: Column, cursor: int, count: int = 10) -> Column:
    """Where the next page starts; 0 after the last."""
    end = cursor + max(1, count)
    return F.when(total > end, F.lit(end)).otherwise(F.lit(0)).cast("long")
