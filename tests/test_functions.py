"""Globs, ranges, numbers and documents: literal cases and brute force."""

import itertools

import pytest
from pyspark.sql import functions as F

from keyfold.functions.documents import PathError, dumps, get_at, merged, parse_path, read_path, set_at, size_of
from keyfold.functions.glob import glob, glob_column
from keyfold.functions.numbers import format_score, score_between, strict_long
from keyfold.functions.ranges import bounds, byte_range, next_cursor, position
from keyfold.plans.machine import matcher, score_text


def slow_glob(p: bytes, t: bytes) -> bool:
    if not p:
        return not t
    if p[:1] == b"*":
        return any(slow_glob(p[1:], t[k:]) for k in range(len(t) + 1))
    return bool(t) and (p[:1] == b"?" or p[:1] == t[:1]) and slow_glob(p[1:], t[1:])


def test_glob_against_brute_force(spark):
    texts = ["".join(x) for n in range(4) for x in itertools.product("ab", repeat=n)] + ["a/b\nc", "a[b]c", "a%_b", "é", "a\\b", "(a)"]
    patterns = ["".join(x) for n in range(5) for x in itertools.product("a*?", repeat=n)] + ["*é", "??", "[ab]*", "a%_*", "*\n*", "a\\*", "(a)", "*b*c*", "a[b]?"]
    expected = {(p, t): slow_glob(p.encode(), t.encode()) for p in patterns for t in texts}
    t = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = t.crossJoin(spark.createDataFrame([(p,) for p in patterns], "p string")).select("p", "t", glob_column(F.col("t"), F.col("p")).alias("m")).collect()
    assert {(r.p, r.t): r.m for r in rows} == expected
    for p in patterns[::7] + patterns[-9:]:
        assert {r.t: r.m for r in t.select("t", glob(F.col("t"), p).alias("m")).collect()} == {x: expected[p, x] for x in texts}, p
    assert all(matcher(p.encode())(x.encode()) == m for (p, x), m in expected.items())


def test_prefix_globs_are_pushed_down(spark, tmp_path):
    spark.range(10).select(F.concat(F.lit("k"), "id").alias("key")).write.parquet(str(tmp_path / "k"))
    plan = spark.read.parquet(str(tmp_path / "k")).where(glob(F.col("key"), "k1*"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,k1)" in plan


SPANS = [(0, 5), (2, 2), (-4, -2), (-90, 3), (4, 90), (6, 2), (50, 60), (0, -1), (-(1 << 40), 1 << 40)]


def bytes_between(data: bytes, start: int, end: int) -> bytes:
    """Positions counted one by one: negative ones from the end, ends inclusive."""
    n = len(data)
    first, last = (max(0, x + n if x < 0 else x) for x in (start, end))
    return bytes(c for i, c in enumerate(data) if first <= i <= last)


@pytest.mark.parametrize("text,start,end,part", [(t, a, b, bytes_between((t or "").encode(), a, b)) for t in ("keyfold bytes", "größe", "x", "", None) for a, b in SPANS])
def test_byte_range(spark, text, start, end, part):
    df = spark.createDataFrame([(text,)], "t string")
    assert bytes(df.select(byte_range(F.col("t"), start, end)).first()[0]) == part


def test_bounds_as_slices(spark):
    cases = [(a, b, n) for a in range(-5, 6) for b in range(-5, 6) for n in range(4)]
    df = spark.createDataFrame(cases, "a long, b long, n long")
    for r in df.select("a", "b", "n", *(c.alias(x) for c, x in zip(bounds(F.col("a"), F.col("b"), F.col("n")), "sf")), position(F.col("a"), F.col("n")).alias("p")).collect():
        items = list(range(r.n))
        a, b = max(0, r.a + r.n if r.a < 0 else r.a), min(r.n - 1, r.b + r.n if r.b < 0 else r.b)
        assert [i for i in items if r.s <= i <= r.f] == items[a : max(a, b + 1)]
        assert r.p == (r.a % r.n if -r.n <= r.a < r.n else None)


def test_next_cursor(spark):
    df = spark.createDataFrame([(5,), (10,), (11,)], "n long")
    assert [r[0] for r in df.select(next_cursor(F.col("n"), 0, 10)).collect()] == [0, 0, 10]


SCORES = [0.0, 1.0, -1.0, 0.1, 0.3, 1e-7, -2.5e-9, 1e14, 1e15, 123456789.125, 1.5e20, 1.7976931348623157e308, 3.0000000000000004, 0.1 + 0.2, 100.5, -1e-5, 12345678.9]


def test_score_text(spark):
    texts = {s: score_text(s).decode() for s in SCORES}
    assert all(float(t) == s and "e" not in t for s, t in texts.items())
    df = spark.createDataFrame([(s,) for s in SCORES] + [(float("inf"),), (float("-inf"),)], "s double")
    got = {r[0]: r[1] for r in df.select("s", format_score(F.col("s"))).collect()}
    assert got == texts | {float("inf"): "inf", float("-inf"): "-inf"}


@pytest.mark.parametrize("low,high,found", [("1", "2", "ab"), ("(1", "+inf", "bc"), ("-inf", "2", "ab"), ("+inf", "+inf", ""), ("-inf", "-inf", ""), ("3", "1", ""), ("-inf", "inf", "abc"), ("(3", "inf", "")])
def test_score_bounds(spark, low, high, found):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "m string, s double")
    assert "".join(sorted(r.m for r in df.where(score_between(F.col("s"), low, high)).collect())) == found


def test_strict_long(spark):
    df = spark.createDataFrame([("12",), (" 12",), ("+3",), ("-9223372036854775808",), ("9223372036854775808",), ("1.0",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(strict_long(F.col("t"))).collect()] == [12, None, 3, -(1 << 63), None, None, None, None]


def test_document_paths(spark):
    doc = {"shop": {"city": "Ulm"}, "stock": [40, 50, 60]}
    assert parse_path("$.a.b[2].c") == ["a", "b", 2, "c"] == parse_path("a.b[2].c") and parse_path("$") == []
    for bad in ("$..a", "$[x]", "$[1", "$" + ".a" * 129):
        with pytest.raises(PathError):
            parse_path(bad)
    assert get_at(doc, "$.stock[2]") == (True, 60) and get_at(doc, "$.stock[3]") == (False, None)
    for depth in range(1, 6):
        names = [f"n{k}" for k in range(depth)]
        built, error = set_at(None, "$." + ".".join(names), depth)
        assert error is None and get_at(built, "$." + ".".join(names)) == (True, depth) and len(dumps(built)) == 7 * depth + 1
    assert set_at({"a": [1]}, "$.a[3]", 1)[1] == "ERR index 3 out of bounds (len 1)"
    for k in range(8):  # a patch of every choice of kept, changed and removed fields at two levels
        old = {"x": k, "in": {"p": 1, "q": 2}}
        patch = ({"x": None} if k & 1 else {}) | {"in": ({"p": None} if k & 2 else {}) | ({"q": 7} if k & 4 else {})}
        expected = ({} if k & 1 else {"x": k}) | {"in": ({} if k & 2 else {"p": 1}) | {"q": 7 if k & 4 else 2}}
        assert merged(old, patch) == expected
    assert size_of({"a": [1, "xy", None]}) == 8 + 1 + 8 + 16 + 10 + 8
    df = spark.createDataFrame([(dumps(doc | {"none": None, "o d'd": 5}),)], "d string")
    read = lambda p: df.select(read_path(F.col("d"), p)).first()[0]
    assert (read("$.shop.city"), read("$.stock[1]"), read("$.absent"), read("$.none"), read("$.o d'd")) == ('"Ulm"', "50", None, "null", "5")
