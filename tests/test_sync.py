"""Outboxes, change values, live queries, documents and compaction against plain Python."""

import json
import random
import time

from keyfold.functions.documents import dumps, merged, set_at
from keyfold.operators import documents, messages, strings, sync
from keyfold.plans.machine import Machine, Refused


def test_outbox_drops_the_oldest(spark):
    rows = [("c", k, k in (1, 4)) for k in range(8)] + [("d", 3, False)]
    got = {(x.client, x.seq): (x.number, x.wire_id, x.pending) for x in sync.outbox(spark.createDataFrame(rows, "client string, seq long, acked boolean"), 2, most=3).collect()}
    assert got["c", 7] == (7, (2 << 32) | 7, True) and [k for (c, k), x in sorted(got.items()) if c == "c" and x[2]] == [5, 6, 7]
    assert got["d", 3] == (0, 2 << 32, True)


def test_changes_round_trip(spark):
    empty = lambda s: spark.createDataFrame([], s)
    values = sync.change_values(
        spark.createDataFrame([("s", 'q"uo,te')], "key string, value string"), spark.createDataFrame([("h", "b", "2"), ("h", "a", "1")], "key string, field string, value string"),
        spark.createDataFrame([("l", 2, "y"), ("l", 1, "x")], "key string, pos long, value string"), spark.createDataFrame([("t", "m")], "key string, member string"),
        spark.createDataFrame([("z", "b", 1.0), ("z", "a", 1.5)], "key string, member string, score double"), empty("key string, doc string"),
    )
    assert {x.key: x.payload for x in values.collect()} == {"s": 'q"uo,te', "h": '["hash","a","1","b","2"]', "l": '["list","x","y"]', "t": '["set","m"]', "z": '["zset","b","1","a","1.5"]'}
    got = sorted((x.key, x.type, x.element, x.value) for x in sync.elements(values).collect())
    assert got == [("h", "hash", "a", "1"), ("h", "hash", "b", "2"), ("l", "list", "0", "x"), ("l", "list", "1", "y"), ("s", "string", "", 'q"uo,te'), ("t", "set", "m", ""), ("z", "zset", "a", "1.5"), ("z", "zset", "b", "1")]


def test_elements_of_large_and_odd_payloads(spark):
    n = 100_000
    rows = [("z", json.dumps(["zset", *(str(x) for k in range(n) for x in (f"m{k}", k))])), ("h", '["hash","a","1","b"]'), ("e", '["hash"]'), ("o", '["zset","a",null]'), ("x", '["hash","a"]')]
    sync.elements(spark.createDataFrame(rows[1:], "key string, payload string")).collect()
    start = time.monotonic()
    got = sync.elements(spark.createDataFrame(rows, "key string, payload string")).collect()
    assert time.monotonic() - start < 15  # minutes, where each pair is taken out of a new copy of all
    assert sorted((x.element, x.value) for x in got if x.key == "z") == sorted((f"m{k}", str(k)) for k in range(n))
    assert sorted((x.key, x.type, x.element, x.value) for x in got if x.key != "z") == [("h", "hash", "a", "1"), ("o", "zset", "a", None)]


def test_expiring_writes_are_the_machines(spark):
    r = random.Random(3)
    rows = []
    for k in range(400):
        option = r.choice([None, "EX", "PX", "EXAT", "PXAT", "KEEPTTL"])
        now = 1_000_000 + k * 700
        amount = {None: None, "KEEPTTL": None, "EX": r.randrange(-1, 9), "PX": r.randrange(0, 9_000), "EXAT": now // 1000 + r.randrange(-5, 9), "PXAT": now + r.randrange(-5_000, 9_000)}[option]
        rows.append((r.choice("abcde"), f"v{k}", k, now, option, amount))
    got = {x.key: (x.value, x.expires_at_ms) for x in strings.set_with_expiry(spark.createDataFrame(rows, "key string, value string, seq long, ts_ms long, option string, amount long")).collect()}
    machine = Machine()
    for key, value, seq, now, option, amount in rows:
        try:
            machine.run("SET", [x.encode() for x in (key, value, *([option] if option else []), *([str(amount)] if amount is not None else []))], now, seq)
        except Refused:
            pass
    assert got == {k: (c.value.decode(), c.expires) for k, c in machine.cells.items()}


def test_documents_are_folded_in_order(spark):
    r = random.Random(4)
    rows, docs, errors = [], {}, {}
    for k in range(300):
        key = r.choice(["a", "b", "c"])
        if r.random() < 0.5:
            path, value = r.choice(["$.x", "$.y.z", "$.x[0]", "$[0]", "$.y", "$..bad"]), r.choice(["1", "null", "[1,2]", '{"z":null}', "{"])
        else:
            path, value = None, r.choice(['{"x":{"p":1}}', '{"x":null}', '{"y":{"z":null,"w":2}}', "3", "null"] if k % 9 else ["null"])
        rows.append((key, k, path, value))
        try:
            v = json.loads(value)
            if path is None:
                if v is None:
                    docs.pop(key, None)
                else:
                    docs[key] = merged(docs.get(key), v)
            elif path == "$..bad" or path == "$[0]" and key not in docs:
                raise ValueError
            else:
                docs[key], error = set_at(docs.get(key), path, v)
                errors[key] = errors.get(key, 0) + (error is not None)
        except ValueError:
            errors[key] = errors.get(key, 0) + 1
    got = {x.key: (x.doc, x.errors) for x in documents.fold(spark.createDataFrame(rows, "key string, seq long, path string, value string").repartition(3)).collect()}
    assert got == {k: (dumps(docs[k]) if k in docs else None, errors.get(k, 0)) for k in "abc"}
    assert documents.fold(spark.createDataFrame([], "key string, seq long, path string, value string")).count() == 0


def test_commits_against_every_write(spark):
    r = random.Random(6)
    writes = [(r.choice("abc"), s, r.choice([None, 1, 2, 3])) for s in range(0, 60, 2)]
    txns = [(t, r.randrange(20, 80), t == 7) for t in range(1, 10)]
    watches = [(t, k, r.randrange(1, 40, 2)) for t, *_ in txns for k in "abc" if r.random() < 0.5]
    off = [(t, r.choice([None, "a"]), r.randrange(1, 60, 2)) for t, *_ in txns if t % 3 == 0]
    got = {x.txn_id: x.committed for x in messages.commits(*(spark.createDataFrame(x, s) for x, s in ((txns, "txn_id int, exec_seq long, discarded boolean"), (watches, "txn_id int, key string, watch_seq long"), (writes, "key string, seq long, txn_id int"), (off, "txn_id int, key string, seq long")))).collect()}
    held = [(t, k, s) for t, k, s in watches if not any(u == t and (n is None or n == k) and e > s for u, n, e in off)]
    assert got == {t: not gone and not any(u == t and k == n and s < at < end and by != t for u, k, s in held for n, at, by in writes) for t, end, gone in txns}
