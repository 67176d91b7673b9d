"""URL allow and block lists as one trie over reversed host labels, then path segments.

A rule is (verdict, host, path). It fits its host and every subdomain, if the url's path starts with
the rule's path. Of the rules that fit, the one of the longest host wins, then that of the longest
path; block wins over allow for the same rule. The rules are an argument, at most MAX_RULES of them,
so the trie that goes to every executor has a known bound; larger lists are refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyfold.llm.runtime import apart, bounded_batches, numbered

MAX_RULES = 1_000_000


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end; without :// both are empty."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class UrlTrie:
    """Each node: [children by host label, children by path segment, path tails that end rules within a segment, rule]."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: list = [{}, {}, {}, None]
        for k, (verdict, host, path) in enumerate(rules):
            if k >= MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            if verdict not in ("allow", "block"):
                raise ValueError(f"no verdict: {verdict}")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")) if host else []:
                node = node[0].setdefault(label, [{}, {}, {}, None])
            *whole, tail = path.split("/")
            for segment in whole:
                node = node[1].setdefault(segment, [{}, {}, {}, None])
            found = node[2].get(tail)
            if found is None or found[1] == "allow":
                node[2][tail] = (host + path, verdict)

    def _paths(self, node: list, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for k, segment in enumerate(segments):
            if node[2]:  # tails of rules that end in this segment
                if len(node[2]) <= len(segment):
                    fits = [t for t in node[2] if segment.startswith(t)]
                else:
                    fits = [segment[:i] for i in range(len(segment) + 1) if segment[:i] in node[2]]
                if fits:
                    best = node[2][max(fits, key=len)]
            if k == len(segments) - 1 or (node := node[1].get(segment)) is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits, or None."""
        node, best, segments = self.root, None, path.split("/")
        nodes = [node]
        for label in reversed(host.split(".")) if host else []:
            if (node := node[0].get(label)) is None:
                break
            nodes.append(node)
        for node in reversed(nodes):
            if (best := self._paths(node, segments)) is not None:
                return best
        return best


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default page_id) of every row, with host, path, rule and verdict (`default` where no rule fits).

    A null or empty url, or one without ://, has an empty host and path, which a rule of empty host, one
    for all hosts, fits if its path is empty too. Very long urls are judged whole. Repeated rows are judged
    one by one. No rows: no rows. Nothing is shuffled and only `keep` and url are read; a kept column that
    has the name of a result gets underscores behind it.
    """
    bounded_batches(pages.sparkSession)
    keep = keep or ["page_id"]
    results = ("host", "path", "rule", "verdict")
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(list(rules)))
    schema = T.StructType([T.StructField(n, pages.schema[c].dataType) for c, n in zip(keep, apart(results, keep))] + [T.StructField(c, T.StringType()) for c in results])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            parts = [host_and_path(u) for u in batch.column(batch.num_columns - 1).to_pylist()]
            found = [match(h, p) for h, p in parts]
            columns = [[h for h, _ in parts], [p for _, p in parts], [f and f[0] for f in found], [f[1] if f else default for f in found]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.string()) for c in columns)], names=schema.names)

    return numbered(pages, [*keep, url]).mapInArrow(judge, schema)


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """The rows that may stay, with their own columns."""
    renamed = [f"__{k}" for k in range(len(pages.columns))]
    inner = pages.toDF(*renamed)
    judged = judge_urls(inner, rules, renamed[pages.columns.index(url)], default, keep=renamed)
    return judged.where("verdict = 'allow'").select(*(F.col(r).alias(c) for r, c in zip(renamed, pages.columns)))
