"""JSON documents: logs of JSET and JMERGE folded in order, all keys at once."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from keyfold.functions.documents import PathError, dumps, merged, parse_path, set_at

_NONE = object()


def fold(log: DataFrame) -> DataFrame:
    """JSET, JMERGE: key, doc (JSON text, fields sorted) and errors, the refused commands, after a log.

    log: key, seq, path (null: value is a merge patch) and value, JSON text. A null patch removes the
    document; a first step that is an index makes no document; what a later failed step made on its way
    stays. Documents nest to any depth, so each key's rows are walked in order; the walk streams over
    sorted rows and holds one document.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, errors, out = _NONE, _NONE, 0, []

        def closed() -> list[dict]:
            return [] if key is _NONE else [{"key": key, "doc": None if doc is _NONE else dumps(doc), "errors": errors}]

        for batch in batches:
            for now, path, text in zip(*(batch.column(c).to_pylist() for c in ("key", "path", "value"))):
                if key is _NONE or now != key:
                    out += closed()
                    key, doc, errors = now, _NONE, 0
                try:
                    value = json.loads(text, parse_constant=lambda c: 1 / 0)
                    if path is None:
                        doc = _NONE if value is None else merged(None if doc is _NONE else doc, value)
                        continue
                    steps = parse_path(path)
                    if steps and isinstance(steps[0], int) and doc is _NONE:
                        raise PathError
                    doc, error = set_at(None if doc is _NONE else doc, path, value)
                    errors += error is not None
                except (ValueError, TypeError, ZeroDivisionError):
                    errors += 1
            if len(out) >= 1_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out + closed(), schema)

    picked = log.select("key", "seq", "path", "value")
    kind = picked.schema["key"].dataType.simpleString()
    schema = pa.schema([("key", {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())), ("doc", pa.string()), ("errors", pa.int64())])
    return picked.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(walk, f"key {kind}, doc string, errors long")
