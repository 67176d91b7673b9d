"""The keyspace as tables: one row for each key, and element tables of every type, out of one state table.

State rows are (key, kind, payload, expires_at_ms). A payload is the bytes of a string, or JSON: hashes
{field: base64}, lists [base64], sets [member], sorted sets [[member, score]], documents as they are,
limiters {limit, window_ms}. Attempts of limiters are not kept.
"""

from __future__ import annotations

import base64
import json
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.functions.documents import dumps, size_of
from keyfold.operators import keys as keyops
from keyfold.operators.limiter import Limiter


def payload_of(kind: str, value: object) -> bytes:
    code = lambda b: base64.b64encode(b).decode()
    if kind == "string":
        return value
    if kind == "hash":
        plain = {f: code(v) for f, v in value.items()}
    elif kind == "list":
        plain = [code(v) for v in value]
    elif kind == "set":
        plain = sorted(value)
    elif kind == "zset":
        plain = [[m, str(s) if math.isinf(s) else repr(s)] for m, s in sorted(value.items(), key=lambda x: (x[1], x[0].encode()))]
    elif kind == "ratelimit":
        plain = {"limit": value.limit, "window_ms": value.window_ms}
    else:
        return dumps(value).encode()
    return json.dumps(plain, ensure_ascii=False).encode()


def value_of(kind: str, payload: bytes) -> object:
    if kind == "string":
        return bytes(payload)
    x = json.loads(payload)
    if kind == "hash":
        return {f: base64.b64decode(v) for f, v in x.items()}
    if kind == "list":
        return [base64.b64decode(v) for v in x]
    if kind == "set":
        return dict.fromkeys(x)
    if kind == "zset":
        return {m: float(s) for m, s in x}
    if kind == "ratelimit":
        return Limiter(x["limit"], x["window_ms"])
    return x


@dataclass
class Keyspace:
    """A state table at a point in time, as typed tables of live keys."""

    state: DataFrame
    now_ms: int

    @property
    def live(self) -> DataFrame:
        return keyops.live(self.state, self.now_ms)

    def _of(self, kind: str) -> DataFrame:
        return self.live.where(F.col("kind") == kind).withColumn("text", F.col("payload").cast("string"))

    @property
    def keys(self) -> DataFrame:
        """key, type, expires_at_ms, bytes."""
        sizes = self._sizes()
        return self.live.join(sizes, "key").select("key", F.col("kind").alias("type"), "expires_at_ms", "bytes")

    @property
    def strings(self) -> DataFrame:
        return self._of("string").select("key", F.col("payload").alias("value"))

    @property
    def hashes(self) -> DataFrame:
        return self._of("hash").select("key", F.explode(F.from_json("text", "map<string,string>")).alias("field", "value")).withColumn("value", F.unbase64("value"))

    @property
    def lists(self) -> DataFrame:
        return self._of("list").select("key", F.posexplode(F.from_json("text", "array<string>")).alias("pos", "value")).withColumns({"pos": F.col("pos").cast("long"), "value": F.unbase64("value")})

    @property
    def sets(self) -> DataFrame:
        return self._of("set").select("key", F.explode(F.from_json("text", "array<string>")).alias("member"))

    @property
    def zsets(self) -> DataFrame:
        pairs = self._of("zset").select("key", F.explode(F.from_json("text", "array<array<string>>")).alias("p"))
        text = F.replace(F.col("p")[1], F.lit("inf"), F.lit("Infinity"))
        return pairs.select("key", F.col("p")[0].alias("member"), text.cast("double").alias("score"))

    @property
    def documents(self) -> DataFrame:
        return self._of("json").select("key", F.col("text").alias("doc"))

    @property
    def limiters(self) -> DataFrame:
        return self._of("ratelimit").select("key", F.from_json("text", "struct<limit:bigint,window_ms:bigint>").alias("l")).select("key", "l.*")

    def _sizes(self) -> DataFrame:
        """Accounting bytes of each key, from its elements."""
        octets = F.octet_length
        parts = [
            self.strings.select("key", octets("value").alias("bytes")),
            self.hashes.select("key", (octets("field") + octets("value")).alias("bytes")),
            self.lists.select("key", octets("value").alias("bytes")),
            self.sets.select("key", octets("member").alias("bytes")),
            self.zsets.select("key", (octets("member") + 8).alias("bytes")),
            self.documents.select("key", _document_bytes(F.col("doc")).alias("bytes")),
            self.limiters.select("key", F.lit(16).alias("bytes")),
            self.live.select("key", F.lit(0).alias("bytes")),  # keys without elements
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return keyops.memory_usage(out)

    def info(self) -> DataFrame:
        """INFO keyspace and memory: keys, volatile_keys, memory_bytes."""
        return keyops.sample(self.keys, self.now_ms)


def _document_bytes(doc):
    """functions.documents.size_of() by Python, a batch at a time: documents nest to any depth."""
    @F.pandas_udf("int")
    def sizes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: size_of(json.loads(t)))

    return sizes(doc)
