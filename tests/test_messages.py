import pytest

from keyfold.operators import messages
from keyfold.operators.limiter import Limiter, checks, surely_allowed, upkeep


def test_tokens():
    t = messages.sign_token("secret", ["user:*", "a"], 100)
    assert messages.verify_token("secret", t, 99) == ["user:*", "a"] and messages.verify_token("s", messages.sign_token("s", ["x"]), 1 << 40) == ["x"]
    for secret, token, now, said in (("secret", t, 100, "expired"), ("other", t, 0, "signature"), ("secret", "nodot", 0, "malformed token"), ("secret", "a.!", 0, "signature"), ("s", messages.sign_token("s", [""]), 0, "no patterns"), ("s", messages.sign_token("s", ["x" * 2000]), 0, "over-long")):
        with pytest.raises(ValueError, match=said):
            messages.verify_token(secret, token, now)


def test_flush_tells_every_pattern(spark):
    rows = messages.flush_notices(spark.createDataFrame([("a*",), ("b",)], "pattern string"), 9).collect()
    assert {(r.seq, r.key, r.value) for r in rows} == {(9, "a*", None), (9, "b", None)}


def test_limits_are_the_walk(spark):
    import random

    r = random.Random(5)
    rows = [(r.choice("ab"), r.randrange(0, 5000), k) for k in range(600)]
    df = spark.createDataFrame(rows, "key string, ts_ms long, seq long")
    got = {x.seq: (x.allowed, x.remaining, x.retry_after_ms) for x in checks(df, 5, 640).collect()}
    walk, expected = {}, {}
    for k, t, s in sorted(rows, key=lambda x: (x[1], x[2])):
        expected[s] = walk.setdefault(k, Limiter(5, 640)).check(t)
    assert got == expected
    assert all(expected[x.seq][0] for x in surely_allowed(df, 5, 640).where("sure").collect())
    assert upkeep(spark.createDataFrame([("k", 1, 2, 0), ("k", 3, 4, 1)], "key string, limit long, window_s long, seq long")).first() == ("k", 3, 4000)
