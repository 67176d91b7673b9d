"""The keyspace queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfold.functions.documents import read_path
from keyfold.functions.glob import glob
from keyfold.functions.numbers import format_score
from keyfold.functions.ranges import next_cursor, page
from keyfold.operators import documents, hashes, keys, limiter, lists, messages, sets, strings, sync, zsets
from keyfold.plans.catalog import COMMANDS, REPLAYABLE, catalog
from keyfold.plans.checkpoints import shared_path
from keyfold.plans.keyspace import Keyspace
from keyfold.plans.replay import command_stats, final_state, normalised, rebuilt, replies
from keyfold.sources import snapshot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: The clock of all queries that need one: 2024-01-16, in the middle of the events.
NOW_MS = 1_705_363_200_000
DAY_MS = 86_400_000


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a command log: key is the user."""
    e = table(spark, sf_dir, "events")
    ts = (micros("ts") / 1000).cast("long")
    return e.select(F.col("user_id").alias("key"), F.struct(micros("ts").alias("t"), F.col("event_id").alias("e")).alias("seq"), "event_id", "event_type", "value", "props", ts.alias("ts_ms"), F.get_json_object("props", "$.k").cast("long").alias("k"))


_E = "SELECT *, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ts_ms, json_extract(props, '$.k')::BIGINT AS k FROM events"


# ---- strings


@query(f"SELECT user_id AS key, arg_max(event_type, (us, event_id)) AS value FROM ({_E}) GROUP BY user_id")
def s_set_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings.set_last(events(spark, sf_dir).select("key", "seq", F.col("event_type").alias("value")))


@query(f"""SELECT user_id AS key, event_id, event_type AS value,
  CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) = 1 AND user_id % 10 <> 0 THEN 1 ELSE 0 END AS reply FROM ({_E})""")
def s_setnx_fww(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    there = log.where(F.col("key") % 10 == 0).select("key")
    return strings.set_first(log.select("key", "seq", "event_id", F.col("event_type").alias("value")), there).drop("seq")


@query(f"SELECT user_id AS key, arg_max(event_type, (us, event_id)) AS value FROM ({_E}) WHERE user_id % 3 = 0 GROUP BY user_id")
def s_set_xx(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    return strings.set_existing(log.select("key", "seq", F.col("event_type").alias("value")), log.where(F.col("key") % 3 == 0))


@query(f"SELECT user_id AS key, event_id, event_type AS value, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS old FROM ({_E})")
def s_getset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings.get_set(events(spark, sf_dir).select("key", "seq", "event_id", F.col("event_type").alias("value"))).drop("seq")


@query(f"SELECT user_id AS key, string_agg(event_type, '' ORDER BY us, event_id) AS value, sum(strlen(event_type))::BIGINT AS length FROM ({_E}) GROUP BY user_id")
def s_append_strlen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings.append(events(spark, sf_dir).select("key", "seq", F.col("event_type").alias("value")))


RANGES = ((0, 3), (-3, -1), (0, -1), (10, 100), (3, 1), (-100, 1), (5, 5))


@query(f"""SELECT p_partkey AS key, s AS start, e AS "end", CASE WHEN a > b THEN '' ELSE substr(p_name, (a + 1)::BIGINT, (b - a + 1)::BIGINT) END AS part
FROM (SELECT p_partkey, p_name, s, e, greatest(0, CASE WHEN s < 0 THEN s + n ELSE s END) AS a, least(n - 1, greatest(0, CASE WHEN e < 0 THEN e + n ELSE e END)) AS b
  FROM (SELECT p_partkey, p_name, strlen(p_name) AS n FROM part), (VALUES {", ".join(map(str, RANGES))}) r(s, e))""")
def s_getrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"), F.explode(F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in RANGES))).alias("r"))
    out = strings.get_range(parts.select("key", "value", "r.*"), F.col("start").cast("long"), F.col("end").cast("long"))
    return out.select("key", "start", "end", F.col("part").cast("string").alias("part"))


@query("""SELECT c_custkey AS pos, 'nation:' || (c_custkey % 40) AS key, n_name AS value
FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 40""")
def s_mget(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey")).alias("key"), F.col("n_name").alias("value"))
    named = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("nation:"), F.col("c_custkey") % 40).alias("key"))
    return strings.get(stored, named)


@query("""SELECT key, arg_max(value, (b, seq)) AS value FROM (
  SELECT 'k' || n_nationkey AS key, n_name AS value, 0 AS b, n_nationkey AS seq FROM nation
  UNION ALL SELECT 'k' || (r_regionkey * 2), r_name, 1, r_regionkey FROM region) GROUP BY key""")
def s_mset(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey")).alias("key"), F.col("n_name").alias("value"), F.col("n_nationkey").alias("seq"))
    two = table(spark, sf_dir, "region").select(F.concat(F.lit("k"), F.col("r_regionkey") * 2).alias("key"), F.col("r_name").alias("value"), F.col("r_regionkey").alias("seq"))
    return strings.set_many(one, two)


@query(f"SELECT user_id AS key, event_id, sum(k) OVER (PARTITION BY user_id ORDER BY us, event_id)::BIGINT AS total FROM ({_E})")
def s_incrby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings.increments(events(spark, sf_dir).select("key", "seq", "event_id", F.col("k").alias("delta"))).select("key", "event_id", "total")


@query(f"SELECT event_type AS key, -count(*) AS total FROM ({_E}) GROUP BY event_type")
def s_decr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings.counter_totals(events(spark, sf_dir).select(F.col("event_type").alias("key"), F.lit(-1).alias("delta")))


@query(f"""SELECT user_id AS key, event_id, (sum(CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, g ORDER BY us, event_id)
  + CASE WHEN g > 0 THEN first_value(k) OVER (PARTITION BY user_id, g ORDER BY us, event_id) ELSE 0 END)::BIGINT AS total
FROM (SELECT *, count(CASE WHEN event_type = 'signup' THEN 1 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS g FROM ({_E}))""")
def s_incr_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).withColumn("set_to", F.when(F.col("event_type") == "signup", F.col("k").cast("string"))).withColumn("delta", F.when(F.col("set_to").isNull(), 1).otherwise(0))
    return strings.increments(log, "set_to").select("key", "event_id", "total")


# ---- keys and expiry


def _expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key for each event; every seventh of the users' keys have no expiry."""
    e = events(spark, sf_dir)
    days = F.col("key") % 7
    return e.select(F.concat(F.lit("event:"), F.col("event_id")).alias("key"), F.when(days > 0, F.col("ts_ms") + days * DAY_MS).alias("expires_at_ms"), F.col("key").alias("user_id"), "event_type", "ts_ms")


_X = f"SELECT 'event:' || event_id AS key, CASE WHEN user_id % 7 > 0 THEN ts_ms + user_id % 7 * {DAY_MS} END AS exp, user_id, event_type, ts_ms FROM ({_E})"


@query(f"SELECT event_type, count(*) AS live, count(exp) AS volatile FROM ({_X}) WHERE exp IS NULL OR exp > {NOW_MS} GROUP BY event_type")
def x_expire_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.live(_expiring(spark, sf_dir), NOW_MS).groupBy("event_type").agg(F.count("*").alias("live"), F.count("expires_at_ms").alias("volatile"))


@query(f"""SELECT key, CASE WHEN exp <= {NOW_MS} THEN -2 WHEN exp IS NULL THEN -1 ELSE (exp - {NOW_MS} + 500) // 1000 END AS ttl,
  CASE WHEN exp <= {NOW_MS} THEN -2 WHEN exp IS NULL THEN -1 ELSE exp - {NOW_MS} END AS pttl FROM ({_X})""")
def x_ttl_pttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("expires_at_ms")
    return _expiring(spark, sf_dir).select("key", keys.ttl(e, NOW_MS).alias("ttl"), keys.pttl(e, NOW_MS).alias("pttl"))


@query(f"""SELECT user_id AS key, arg_max({{'e': CASE event_type WHEN 'click' THEN ts_ms + k * 1000 WHEN 'view' THEN ts_ms + k WHEN 'purchase' THEN ts_ms // 1000 * 1000 ELSE NULL END}}, (us, event_id)).e AS expires_at_ms
FROM ({_E}) GROUP BY user_id""")
def x_expire_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("event_type") == "click", "s").when(F.col("event_type") == "view", "ms").when(F.col("event_type") == "purchase", "at_s").otherwise("persist")
    log = events(spark, sf_dir).select("key", "seq", "ts_ms", unit.alias("unit"), F.when(F.col("event_type") == "purchase", F.expr("ts_ms div 1000")).otherwise(F.col("k")).alias("amount"))
    return keys.expire_at(log)


@query(f"SELECT count(*) AS n FROM (SELECT unnest([event_id, event_id, event_id + 1000000000]) AS id FROM events) JOIN ({_X}) ON key = 'event:' || id WHERE (exp IS NULL OR exp > {NOW_MS})")
def k_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "events").select(F.explode(F.array(F.col("event_id"), F.col("event_id"), F.col("event_id") + 1_000_000_000)).alias("id"))
    return keys.exists(_expiring(spark, sf_dir), named.select(F.concat(F.lit("event:"), F.col("id")).alias("key")), NOW_MS)


@query("SELECT url AS key, 'prefix' AS p FROM pages WHERE url LIKE 'https://m.%' UNION ALL SELECT url, 'infix' FROM pages WHERE url LIKE '%example.org%' UNION ALL SELECT url, 'mixed' FROM pages WHERE regexp_full_match(url, '(?s)https://.*[.]example[.]..t/.*')")
def k_keys_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("key"))
    found = [keys.matching(urls, p).withColumn("p", F.lit(n)) for n, p in (("prefix", "https://m.*"), ("infix", "*example.org*"), ("mixed", "https://*.example.??t/*"))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""SELECT key, rank, 60 AS next FROM (SELECT 'customer:' || c_custkey AS key, row_number() OVER (ORDER BY 'customer:' || c_custkey) - 1 AS rank FROM customer WHERE ('customer:' || c_custkey) LIKE 'customer:1%') WHERE rank >= 40 AND rank < 60""")
def k_scan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("key"))
    return keys.scan(names, 40, 20, "customer:1*")


@query("""WITH k AS (SELECT 'customer:' || c_custkey AS key, 'hash' AS type FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'zset' FROM supplier),
d AS (SELECT * FROM k WHERE NOT (starts_with(key, 'customer:') AND substr(key, 10)::BIGINT % 5 = 0)),
r AS (SELECT 'supplier:' || s_suppkey AS old, 'customer:' || s_suppkey AS new FROM supplier WHERE s_suppkey % 2 = 1)
SELECT coalesce(r.new, d.key) AS key, d.type FROM d LEFT JOIN r ON r.old = d.key
WHERE d.key NOT IN (SELECT new FROM r WHERE old IN (SELECT key FROM d))""")
def k_rename_type_del(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("key"), F.lit("hash").alias("type"))
    s = table(spark, sf_dir, "supplier")
    all_keys = c.unionByName(s.select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("key"), F.lit("zset").alias("type"))).withColumn("expires_at_ms", F.lit(None).cast("long"))
    gone = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("key"))
    left, _ = keys.delete(all_keys, gone, NOW_MS)
    renames = s.where("s_suppkey % 2 = 1").select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("old"), F.concat(F.lit("customer:"), F.col("s_suppkey")).alias("new"))
    return keys.rename_all(left, renames).select("key", "type")


@query("SELECT coalesce(k.type, 'none') AS type, n.key FROM (SELECT 'customer:' || (c_custkey * 2) AS key FROM customer) n LEFT JOIN (SELECT 'customer:' || c_custkey AS key, 'hash' AS type FROM customer) k ON k.key = n.key")
def k_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    name = lambda x: F.concat(F.lit("customer:"), x).alias("key")
    return keys.type_of(c.select(name(F.col("c_custkey")), F.lit("hash").alias("type")), c.select(name(F.col("c_custkey") * 2)))


@query("""SELECT key, (64 + strlen(key) + sum(b))::BIGINT AS bytes FROM (
  SELECT 'doc:' || doc_id AS key, strlen(text) AS b FROM documents
  UNION ALL SELECT 'conv:' || conv_id, strlen(text) FROM conversations
  UNION ALL SELECT 'seg:' || c_mktsegment, strlen(c_name) + 8 FROM customer) GROUP BY key""")
def k_memory_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("key"), F.octet_length("text").alias("bytes"))
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv:"), F.col("conv_id")).alias("key"), F.octet_length("text").alias("bytes"))
    z = table(spark, sf_dir, "customer").select(F.concat(F.lit("seg:"), F.col("c_mktsegment")).alias("key"), (F.octet_length("c_name") + 8).alias("bytes"))
    return keys.memory_usage(d.unionByName(c).unionByName(z))


# ---- hashes


def _customer_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    return c.unpivot("key", ["name", "segment", "nation"], "field", "value")


_H = "SELECT 'customer:' || c_custkey AS key, unnest(['name', 'segment', 'nation']) AS field, unnest([c_name, c_mktsegment, c_nationkey::VARCHAR]) AS value, c_custkey FROM customer"


@query(f"SELECT key, array_to_string(list(field ORDER BY field), ',') AS fields, array_to_string(list(value ORDER BY field), ',') AS vals, count(*) AS length FROM ({_H}) GROUP BY key")
def h_hgetall(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hashes.get_all(_customer_hash(spark, sf_dir))
    return out.select("key", F.array_join("fields", ",").alias("fields"), F.array_join("vals", ",").alias("vals"), "length")


@query(f"""SELECT n.key, n.field, h.value, h.key IS NOT NULL AS present
FROM (SELECT 'customer:' || (c_custkey * 3) AS key, unnest(['name', 'absent', 'nation']) AS field FROM customer) n LEFT JOIN ({_H}) h ON h.key = n.key AND h.field = n.field""")
def h_hmget_hexists(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey") * 3).alias("key"), F.explode(F.array(F.lit("name"), F.lit("absent"), F.lit("nation"))).alias("field"))
    return hashes.get_fields(_customer_hash(spark, sf_dir), named).select("key", "field", "value", "present")


@query(f"SELECT key, field, value FROM ({_H}) WHERE NOT (c_custkey % 3 = 0 AND field = 'nation')")
def h_hdel(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("key"), F.lit("nation").alias("field"))
    return hashes.delete_fields(_customer_hash(spark, sf_dir), named).select("key", "field", "value")


@query(f"SELECT user_id AS key, event_type AS field, arg_max(k, (us, event_id)) AS value, 'last' AS kind FROM ({_E}) GROUP BY ALL UNION ALL SELECT user_id, event_type, arg_min(k, (us, event_id)), 'first' FROM ({_E}) WHERE event_type <> 'view' GROUP BY ALL")
def h_hset_hsetnx(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).select("key", F.col("event_type").alias("field"), F.col("k").alias("value"), "seq")
    there = log.where("field = 'view'")
    return hashes.set_fields(log).withColumn("kind", F.lit("last")).unionByName(hashes.set_new_fields(log, there).withColumn("kind", F.lit("first")))


@query(f"SELECT user_id AS key, event_type AS field, sum(k)::BIGINT AS total, round(sum(value), 2) AS float_total FROM ({_E}) GROUP BY ALL")
def h_hincr(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).select("key", "seq", F.col("event_type").alias("field"), "k", F.col("value").alias("x"))
    whole = hashes.increment_fields(log.select("key", "seq", "field", F.col("k").alias("delta"), F.lit(None).cast("string").alias("value")))
    real = hashes.increment_float_fields(log.select("key", "field", F.col("x").alias("delta"))).withColumnRenamed("total", "float_total")
    return whole.join(real, ["key", "field"]).withColumn("float_total", F.round("float_total", 2))


@query(f"""SELECT key, field, rank // 2 * 2 AS cursor, CASE WHEN n > rank // 2 * 2 + 2 THEN rank // 2 * 2 + 2 ELSE 0 END AS next
FROM (SELECT key, field, row_number() OVER (PARTITION BY key ORDER BY field) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n FROM ({_H}) WHERE field LIKE '%n%')""")
def h_hscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.pages(hashes.scan_fields(_customer_hash(spark, sf_dir), "*n*", values=False), "field", 2)


# ---- lists


def _orders_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("key"), F.struct(micros("o_orderdate").alias("d"), F.col("o_orderkey").alias("o")).alias("pos"), F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderstatus").alias("status"))


_L = "SELECT o_custkey AS key, o_orderkey::VARCHAR AS value, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders"


@query(f"SELECT key, value, i AS index, n AS length FROM ({_L}) WHERE i >= 2 AND i <= n - 2")
def l_lrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.in_range(_orders_list(spark, sf_dir), 2, -2).select("key", "value", "index", "length")


@query(f"SELECT key, value FROM ({_L}) WHERE i = n - 3")
def l_lindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.element(_orders_list(spark, sf_dir), -3).select("key", "value")


@query(f"SELECT key, value, i AS rank, 'left' AS side FROM ({_L}) WHERE i < 2 UNION ALL SELECT key, value, n - 1 - i, 'right' FROM ({_L}) WHERE n - 1 - i < 3 UNION ALL SELECT key, value, i, 'trim' FROM ({_L}) WHERE i >= 1 AND i <= 3")
def l_pop_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders_list(spark, sf_dir)
    left = lists.pop(o, 2).where("popped").select("key", "value", "rank", F.lit("left").alias("side"))
    right = lists.pop(o, 3, "right").where("popped").select("key", "value", "rank", F.lit("right").alias("side"))
    return left.unionByName(right).unionByName(lists.in_range(o, 1, 3).select("key", "value", F.col("index").alias("rank"), F.lit("trim").alias("side")))


@query("""WITH l AS (SELECT o_custkey AS key, o_orderkey, o_orderstatus AS value,
  row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS z FROM orders)
SELECT key, o_orderkey, value, 'head' AS kind FROM l WHERE NOT (value = 'F' AND a <= 2) UNION ALL SELECT key, o_orderkey, value, 'tail' FROM l WHERE NOT (value = 'F' AND z <= 1) UNION ALL SELECT key, o_orderkey, value, 'all' FROM l WHERE value <> 'F'""")
def l_lrem(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders_list(spark, sf_dir).select("key", "pos", F.col("status").alias("value"))
    parts = [lists.remove(o, n, "F").select("key", F.col("pos.o").alias("o_orderkey"), "value", F.lit(kind).alias("kind")) for n, kind in ((2, "head"), (-1, "tail"), (0, "all"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT key, i AS index, CASE WHEN i = 1 THEN 'new' ELSE value END AS value FROM ({_L})")
def l_lset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.set_element(_orders_list(spark, sf_dir), 1, F.lit("new")).select("key", "index", "value")


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id, s ORDER BY us, event_id) AS r FROM (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'left' ELSE 'right' END AS s FROM ({_E})))
SELECT user_id AS key, CASE WHEN s = 'left' THEN -r ELSE r - 1 END AS pos, event_type AS value FROM p""")
def l_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("event_type").isin("view", "click"), "left").otherwise("right")
    return lists.push(events(spark, sf_dir).select("key", "seq", F.col("event_type").alias("value"), side.alias("side")))


@query(f"""SELECT o_custkey AS key, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::BIGINT AS pos, o_orderkey::VARCHAR AS value FROM orders
UNION ALL SELECT user_id, (-row_number() OVER (PARTITION BY user_id ORDER BY us, event_id))::BIGINT, event_type FROM ({_E}) WHERE user_id IN (SELECT o_custkey FROM orders)""")
def l_pushx(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = lists.indexed(_orders_list(spark, sf_dir)).select("key", F.col("index").alias("pos"), "value")
    return lists.push_existing(there, events(spark, sf_dir).select("key", "seq", F.col("event_type").alias("value"), F.lit("left").alias("side")))


# ---- sets


def _event_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return sets.add(e.select(F.col("event_type").alias("key"), F.col("user_id").alias("member")))


def _supplier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.add(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("key"), F.col("l_partkey").alias("member")))


@query("SELECT event_type AS key, count(DISTINCT user_id) AS size, array_to_string(list(DISTINCT user_id ORDER BY user_id), ',') AS members FROM events GROUP BY event_type")
def t_sadd_smembers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sets.members(_event_sets(spark, sf_dir))
    return out.select("key", "size", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("SELECT n.key, n.member, CASE WHEN s.user_id IS NULL THEN 0 ELSE 1 END AS present FROM (SELECT 'click' AS key, unnest([c_custkey, c_custkey + 1000000]) AS member FROM customer) n LEFT JOIN (SELECT DISTINCT event_type, user_id FROM events) s ON s.event_type = n.key AND s.user_id = n.member")
def t_sismember(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").select(F.lit("click").alias("key"), F.explode(F.array(F.col("c_custkey"), F.col("c_custkey") + 1_000_000)).alias("member"))
    return sets.contains(_event_sets(spark, sf_dir), named).select("key", "member", "present")


@query("SELECT l_partkey AS member FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey = 2")
def t_sinter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.intersection(_supplier_parts(spark, sf_dir), ["1", "2"])


@query("SELECT l_partkey AS member FROM lineitem WHERE l_suppkey = 1 UNION SELECT l_partkey FROM lineitem WHERE l_suppkey = 3")
def t_sunion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union(_supplier_parts(spark, sf_dir), ["1", "3"])


@query("SELECT l_partkey AS member FROM lineitem WHERE l_suppkey = 1 EXCEPT SELECT l_partkey FROM lineitem WHERE l_suppkey IN (2, 3)")
def t_sdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.difference(_supplier_parts(spark, sf_dir), ["1", "2", "3"])


_STORED = """SELECT DISTINCT l_suppkey::VARCHAR AS key, l_partkey AS member FROM lineitem WHERE l_suppkey <> 4 UNION ALL
(SELECT '4', l_partkey FROM lineitem WHERE l_suppkey = 1 {how} SELECT '4', l_partkey FROM lineitem WHERE l_suppkey = 3)"""


@query(_STORED.format(how="INTERSECT"))
def t_sinterstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _supplier_parts(spark, sf_dir)
    return sets.store(s, "4", sets.intersection(s, ["1", "3"]))


@query(_STORED.format(how="UNION"))
def t_sunionstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _supplier_parts(spark, sf_dir)
    return sets.store(s, "4", sets.union(s, ["1", "3"]))


@query(_STORED.format(how="EXCEPT"))
def t_sdiffstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _supplier_parts(spark, sf_dir)
    return sets.store(s, "4", sets.difference(s, ["1", "3"]))


@query("""SELECT DISTINCT key, member FROM (
  SELECT CASE WHEN event_type = 'view' AND user_id % 2 = 0 THEN 'click' ELSE event_type END AS key, user_id AS member FROM events) WHERE NOT (key = 'signup' AND member % 3 = 0)""")
def t_smove_srem(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _event_sets(spark, sf_dir)
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("member")).distinct()
    moved = sets.move(s, users.where("member % 2 = 0").select(F.lit("view").alias("source"), F.lit("click").alias("target"), "member"))
    return sets.remove(moved, users.where("member % 3 = 0").select(F.lit("signup").alias("key"), "member"))


@query("""SELECT key, member, r // 25 * 25 AS cursor, CASE WHEN n > r // 25 * 25 + 25 THEN r // 25 * 25 + 25 ELSE 0 END AS next
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS r, count(*) OVER (PARTITION BY key) AS n FROM (SELECT DISTINCT event_type AS key, user_id AS member FROM events))""")
def t_sscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.pages(_event_sets(spark, sf_dir), "member", 25)


_DRAWN = "('0x' || substr(md5('1/' || {parts}), 1, 15))::BIGINT"


@query(f"""SELECT key, member, rank FROM (SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY {_DRAWN.format(parts="key || '/' || member")}, member) AS rank FROM (SELECT DISTINCT event_type AS key, user_id AS member FROM events)) WHERE rank <= 10""")
def t_spop_srand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.sample(_event_sets(spark, sf_dir), 10, seed=1)


@query(f"""WITH s AS (SELECT DISTINCT event_type AS key, user_id AS member FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS rank FROM s),
d AS (SELECT key, count(*) AS n, unnest(range(20))::INTEGER AS draw FROM s GROUP BY key)
SELECT d.key, d.draw, r.member FROM d JOIN r ON r.key = d.key AND r.rank = {_DRAWN.format(parts="d.key || '/' || draw")} % n""")
def t_srandmember_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.sample_with_repeats(_event_sets(spark, sf_dir), 20, seed=1)


# ---- sorted sets


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_mktsegment").alias("key"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("member"), F.col("c_acctbal").alias("score"))


_Z = "SELECT c_mktsegment AS key, lpad(c_custkey::VARCHAR, 8, '0') AS member, c_acctbal AS score FROM customer"


@query(f"SELECT key, member, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM ({_Z})) WHERE rank BETWEEN 3 AND 12")
def z_zrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zsets.by_rank(_segments(spark, sf_dir), 3, 12)


@query(f"SELECT key, member, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n FROM ({_Z})) WHERE rank >= n - 5 AND rank <= n - 2")
def z_zrevrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zsets.by_rank(_segments(spark, sf_dir), -5, -2, reverse=True)


@query(f"""SELECT key, member, score, rank, 'up' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM ({_Z}) WHERE score > 1000 AND score <= 5000) WHERE rank BETWEEN 2 AND 6
UNION ALL SELECT key, member, score, rank, 'down' FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM ({_Z}) WHERE score < 0) WHERE rank < 4""")
def z_byscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _segments(spark, sf_dir)
    return zsets.by_score(z, "(1000", "5000", 2, 5).withColumn("kind", F.lit("up")).unionByName(zsets.by_score(z, "-inf", "(0", 0, 4, reverse=True).withColumn("kind", F.lit("down")))


@query(f"SELECT key, count(*) AS size, count(CASE WHEN score >= 0 AND score < 2500 THEN 1 END) AS n FROM ({_Z}) GROUP BY key")
def z_zcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zsets.count(_segments(spark, sf_dir), "0", "(2500")


@query(f"SELECT a.key, a.member, a.rank, b.rank AS revrank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM ({_Z})) a JOIN (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM ({_Z})) b ON a.key = b.key AND a.member = b.member")
def z_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zsets.both_ranks(_segments(spark, sf_dir)).select("key", "member", "rank", "revrank")


@query(f"SELECT n.key, n.member, z.score FROM (SELECT c_mktsegment AS key, lpad((c_custkey * 2)::VARCHAR, 8, '0') AS member FROM customer) n LEFT JOIN ({_Z}) z ON z.key = n.key AND z.member = n.member")
def z_zmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.lpad((F.col("c_custkey") * 2).cast("string"), 8, "0").alias("member"))
    return zsets.scores(_segments(spark, sf_dir), named)


_W = f"SELECT event_type AS key, user_id AS member, value AS score, us, event_id FROM ({_E})"


@query(f"""SELECT key, member, arg_max(score, (us, event_id)) AS last, arg_min(score, (us, event_id)) AS first, max(score) AS greatest, min(score) AS least FROM ({_W}) GROUP BY key, member""")
def z_gt_lt_nx(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).select(F.col("event_type").alias("key"), F.col("key").alias("member"), F.col("value").alias("score"), "seq")
    out = zsets.add(log).withColumnRenamed("score", "last")
    for mode in ("first", "greatest", "least"):
        out = out.join(zsets.add(log, mode).withColumnRenamed("score", mode), ["key", "member"])
    return out


@query(f"""SELECT key, count(CASE WHEN old IS NULL THEN 1 END) AS added, count(CASE WHEN old IS NULL OR abs(score - old) > 2.220446049250313e-16 THEN 1 END) AS changed
FROM (SELECT *, lag(score) OVER (PARTITION BY key, member ORDER BY us, event_id) AS old FROM ({_W})) GROUP BY key""")
def z_zadd_ch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zsets.changes(events(spark, sf_dir).select(F.col("event_type").alias("key"), F.col("key").alias("member"), F.col("value").alias("score"), "seq"))


@query(f"SELECT c.key, c.member, coalesce(w.score, c.score) AS score FROM ({_Z}) c LEFT JOIN (SELECT lpad(user_id::VARCHAR, 8, '0') AS member, arg_max(value, (us, event_id)) AS score FROM ({_E}) GROUP BY user_id) w ON w.member = c.member AND c.key = 'BUILDING'")
def z_zadd_xx(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).select(F.lit("BUILDING").alias("key"), F.lpad(F.col("key").cast("string"), 8, "0").alias("member"), F.col("value").alias("score"), "seq")
    return zsets.add_existing(_segments(spark, sf_dir), log)


@query(f"SELECT event_type AS key, user_id AS member, round(sum(value), 2) AS score FROM ({_E}) WHERE user_id % 4 <> 0 GROUP BY ALL")
def z_zincrby_zrem(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).select(F.col("event_type").alias("key"), F.col("key").alias("member"), F.col("value").alias("score"), "seq")
    gone = log.where("member % 4 = 0").select("key", "member")
    return zsets.remove(zsets.add(log, "sum"), gone).withColumn("score", F.round("score", 2))


@query(f"""SELECT key, member, score, r // 50 * 50 AS cursor, CASE WHEN n > r // 50 * 50 + 50 THEN r // 50 * 50 + 50 ELSE 0 END AS next
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS r, count(*) OVER (PARTITION BY key) AS n FROM ({_Z}))""")
def z_zscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.pages(_segments(spark, sf_dir), "member", 50)


@query("SELECT c_custkey AS key, CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR ELSE c_acctbal::DECIMAL(18, 2)::DOUBLE::VARCHAR END AS text FROM customer")
def z_score_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), format_score(F.col("c_acctbal")).alias("text"))


@query("""SELECT event_type AS key, user_id AS member, total, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY total DESC, user_id DESC) - 1 AS rank FROM (
    SELECT event_type, user_id, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY ALL)) WHERE rank < 10""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increments summed into sorted sets, and their first ten: the path from a log to a top-k."""
    log = events(spark, sf_dir).select(F.col("event_type").alias("key"), F.col("key").alias("member"), F.col("k").alias("score"))
    return zsets.by_rank(zsets.add(log, "sum"), 0, 9, reverse=True).select("key", "member", F.col("score").alias("total"), "rank")


# ---- documents


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def j_jget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", read_path(F.col("props"), "$.k").cast("long").alias("k"), read_path(F.col("props"), "$.absent").alias("absent"))


@query(f"""SELECT user_id AS key, '{{' || string_agg('"' || event_type || '":' || k, ',' ORDER BY event_type) || '}}' AS doc
FROM (SELECT user_id, event_type, arg_max(k, (us, event_id)) AS k FROM ({_E}) GROUP BY ALL) WHERE k >= 10 GROUP BY user_id""")
def j_jmerge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge patches {event_type: k}, null where k < 10, folded field by field; a document without fields is left out."""
    log = events(spark, sf_dir).select("key", F.col("event_type").alias("field"), F.when(F.col("k") >= 10, F.col("k")).alias("value"), "seq")
    kept = hashes.set_fields(log).where("value is not null")
    return kept.groupBy("key").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value"))))).alias("doc"))


# ---- limiter, messages, transactions


_STEP_MS = DAY_MS // 64


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, ts_ms, ts_ms - ts_ms % {_STEP_MS} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS r FROM ({_E})),
w AS (
  SELECT key, event_id, ts_ms, r, [{{'s': s, 'n': 1}}] AS b, 1::BIGINT AS allowed, 2::BIGINT AS remaining, 0::BIGINT AS retry_after_ms FROM e WHERE r = 1
  UNION ALL
  SELECT key, event_id, ts_ms, r,
    CASE WHEN used >= 3 THEN live WHEN len(live) > 0 AND live[-1].s = s THEN list_append(live[:-2], {{'s': s, 'n': live[-1].n + 1}}) ELSE list_append(live, {{'s': s, 'n': 1}}) END,
    CASE WHEN used >= 3 THEN 0 ELSE 1 END, CASE WHEN used >= 3 THEN 0 ELSE 2 - used END,
    CASE WHEN used >= 3 THEN least(greatest(0, live[1].s + {_STEP_MS} + {DAY_MS} - ts_ms), {DAY_MS}) ELSE 0 END
  FROM (SELECT *, coalesce(list_sum(list_transform(live, lambda x: x.n)), 0)::BIGINT AS used FROM (
    SELECT e.*, list_filter(w.b, lambda x: x.s + {_STEP_MS} > greatest(0, e.ts_ms - {DAY_MS})) AS live FROM w JOIN e ON e.key = w.key AND e.r = w.r + 1))
)
SELECT key, ts_ms, event_id, allowed, remaining, retry_after_ms FROM w""")
def r_rlcheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = limiter.checks(events(spark, sf_dir).select("key", "ts_ms", F.col("event_id").alias("seq")), limit=3, window_ms=DAY_MS)
    return out.withColumnRenamed("seq", "event_id")


@query(f"""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts_ms RANGE BETWEEN {DAY_MS + DAY_MS // 64} PRECEDING AND CURRENT ROW) <= 3 AS sure FROM ({_E})""")
def r_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = limiter.surely_allowed(events(spark, sf_dir).select("key", "ts_ms", "event_id"), limit=3, window_ms=DAY_MS)
    return out.select("event_id", "sure")


#: conn_id, kind, pattern, from_seq, to_seq
SUBSCRIPTIONS = [(1, "exact", "click", 0, None), (1, "pattern", "cl*", 0, None), (2, "exact", "view", 100, 5000), (3, "pattern", "*i?w", 0, None), (4, "pattern", "*", 2000, None), (5, "exact", "nothing", 0, None), (6, "pattern", "[ab]*", 0, None), (7, "exact", "click", 0, None)]
_S = "SELECT * FROM (VALUES " + ", ".join(f"({c}, '{k}', '{p}', {a}, {b if b is not None else 'NULL::INTEGER'})" for c, k, p, a, b in SUBSCRIPTIONS) + ") s(conn_id, kind, pattern, from_seq, to_seq)"
_GLOB = "regexp_full_match({text}, '(?s)' || replace(replace(regexp_replace({pattern}, '([^A-Za-z0-9*?])', '\\\\\\1', 'g'), '?', '.'), '*', '.*'))"


def _subscriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUBSCRIPTIONS, "conn_id int, kind string, pattern string, from_seq long, to_seq long")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("channel"), F.col("props").alias("payload"))


@query(f"""SELECT e.event_id AS seq, e.event_type AS channel, count(s.conn_id) AS receivers FROM events e LEFT JOIN ({_S}) s
ON e.event_id >= s.from_seq AND (s.to_seq IS NULL OR e.event_id < s.to_seq) AND CASE WHEN s.kind = 'exact' THEN e.event_type = s.pattern ELSE {_GLOB.format(text="e.event_type", pattern="s.pattern")} END GROUP BY ALL""")
def p_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.publish(_messages(spark, sf_dir), _subscriptions(spark))


@query(f"SELECT pattern AS channel, count(DISTINCT conn_id) AS subscribers, (SELECT count(DISTINCT pattern) FROM ({_S}) WHERE kind = 'pattern' AND to_seq IS NULL) AS patterns FROM ({_S}) WHERE kind = 'exact' AND to_seq IS NULL GROUP BY pattern")
def p_pubsub(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _subscriptions(spark)
    return messages.channels(s).crossJoin(messages.pattern_count(s).withColumnRenamed("n", "patterns"))


@query(f"SELECT event_id, coalesce(k <= max(k) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS duplicate FROM ({_E})")
def d_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).select(F.col("key").alias("client"), F.col("k").alias("id"), "seq", "event_id")
    return messages.once(log).select("event_id", "duplicate")


@query(f"SELECT user_id AS client, max(k) AS mark FROM ({_E}) GROUP BY user_id")
def d_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.high_water(events(spark, sf_dir).select(F.col("key").alias("client"), F.col("k").alias("id")))


@query("""WITH t AS (SELECT o_orderkey AS txn_id, o_custkey AS key, o_orderkey AS watch_seq, o_orderkey + 200 AS exec_seq FROM orders)
SELECT t.txn_id, t.exec_seq, NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = t.key AND o.o_orderkey + 100 > t.watch_seq AND o.o_orderkey + 100 < t.exec_seq AND o.o_orderkey <> t.txn_id) AS committed FROM t""")
def w_watch_exec(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    txns = o.select(F.col("o_orderkey").alias("txn_id"), (F.col("o_orderkey") + 200).alias("exec_seq"))
    watches = o.select(F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("watch_seq"))
    writes = o.select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") + 100).alias("seq"), F.col("o_orderkey").alias("txn_id"))
    return messages.commits(txns, watches, writes)


@query("""WITH s AS (SELECT 'user:' || user_id AS key, arg_max(event_type, event_id) AS value FROM events WHERE event_id <= 500 GROUP BY user_id)
SELECT 'state' AS kind, 500 AS seq, key, value FROM s WHERE key LIKE 'user:1%' UNION ALL
SELECT 'change', event_id, 'user:' || user_id, event_type FROM events WHERE event_id > 500 AND 'user:' || user_id LIKE 'user:1%'""")
def q_qsub_keychange(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.concat(F.lit("user:"), F.col("user_id")).alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return messages.live_query(strings.set_last(log.where("seq <= 500")), log, "user:1*", 500)


SCOPES = [("a", "user:1*"), ("a", "user:2?"), ("b", "user:?"), ("c", "*")]


@query(f"""WITH scopes(client, pattern) AS (VALUES {", ".join(map(str, SCOPES))}), keys AS (SELECT DISTINCT 'user:' || user_id AS key FROM events UNION ALL SELECT NULL)
SELECT DISTINCT client, key FROM keys, scopes WHERE key IS NULL OR {_GLOB.format(text="key", pattern="pattern")}""")
def y_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "events").select(F.concat(F.lit("user:"), F.col("user_id")).alias("key")).distinct()
    rows = names.unionByName(spark.createDataFrame([(None,)], "key string"))
    return messages.visible(rows, spark.createDataFrame(SCOPES, "client string, pattern string"))


@query(f"""WITH c AS (SELECT user_id % 40 AS key, arg_max({{'v': event_type, 'o': k, 's': event_id}}, event_id) AS x FROM ({_E}) GROUP BY ALL),
d AS (SELECT k AS conn, max(event_id) AS e FROM ({_E}) WHERE event_type = 'signup' GROUP BY k)
SELECT key, x.v AS value, x.o AS owner FROM c LEFT JOIN d ON d.conn = x.o WHERE d.e IS NULL OR d.e < x.s""")
def e_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    claims = e.select((F.col("key") % 40).alias("key"), F.col("event_type").alias("value"), F.col("k").alias("conn_id"), F.col("event_id").alias("seq"))
    closed = e.where("event_type = 'signup'").select(F.col("k").alias("conn_id"), F.col("event_id").alias("seq"))
    return messages.presence(claims, closed)


# ---- eviction


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key for each user: when it was last used, 65 bytes and one for each event, and an expiry for some."""
    e = events(spark, sf_dir).groupBy("key").agg(F.max("ts_ms").alias("last_access_ms"), (64 + F.count("*")).alias("bytes"))
    return e.select(F.concat(F.lit("user:"), F.col("key")).alias("key"), "last_access_ms", "bytes", F.when(F.col("key") % 3 > 0, F.lit(NOW_MS) + F.col("key") * 1_000_003 % 86_400_007).alias("expires_at_ms"))


_C = f"SELECT 'user:' || user_id AS key, max(ts_ms) AS last_access_ms, (64 + count(*))::BIGINT AS bytes, CASE WHEN user_id % 3 > 0 THEN {NOW_MS} + user_id * 1000003 % 86400007 END AS exp FROM ({_E}) GROUP BY user_id"
_EVICT = """WITH c AS ({c}), t AS (SELECT sum(bytes)::BIGINT AS total, 10000 AS lim FROM c)
SELECT key, weight, bytes FROM (SELECT *, coalesce(sum(bytes) OVER (ORDER BY weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM (SELECT key, {w} AS weight, bytes FROM c WHERE {ok})), t
WHERE total > lim AND run < total - (lim - lim // 16)"""


@query(_EVICT.format(c=_C, w="last_access_ms", ok="true"))
def e_evict_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.victims(_cached(spark, sf_dir), "allkeys-lru", 10_000, NOW_MS)


@query(_EVICT.format(c=_C, w="exp", ok=f"exp > {NOW_MS}"))
def e_evict_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.victims(_cached(spark, sf_dir), "volatile-ttl", 10_000, NOW_MS)


@query(f"WITH c AS ({_C}) SELECT count(*) AS keys, count(exp) AS volatile_keys, sum(bytes)::BIGINT AS memory_bytes FROM c WHERE exp IS NULL OR exp > {NOW_MS + 40_000_000}")
def i_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.sample(_cached(spark, sf_dir), NOW_MS + 40_000_000)


# ---- logs


def _command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command for each event, of a family that its type chooses; the keys are the users'."""
    e = events(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("seq")))
    user, k = F.col("key").cast("string"), F.col("k").cast("string")
    kinds = {
        "view": ("INCRBY", [F.concat(F.lit("c:"), user), k]),
        "click": ("SADD", [F.concat(F.lit("s:"), user), F.concat(F.lit("m"), k)]),
        "purchase": ("HSET", [F.concat(F.lit("h:"), user), F.concat(F.lit("f"), F.col("k") % 5), F.col("event_id").cast("string")]),
        "signup": ("RPUSH", [F.concat(F.lit("l:"), user), k]),
    }
    cmd, args = F.lit("ZADD"), F.array(F.concat(F.lit("z:"), user), k, F.concat(F.lit("m"), F.col("event_id") % 7))
    for kind, (name, parts) in kinds.items():
        cmd, args = F.when(F.col("event_type") == kind, name).otherwise(cmd), F.when(F.col("event_type") == kind, F.array(*parts)).otherwise(args)
    # Keys of different users never meet, so an order within each user is an order of the log.
    return e.select((F.col("n") * 1_000_000 + F.col("key")).cast("long").alias("seq"), "ts_ms", cmd.alias("cmd"), args.cast("array<binary>").alias("args"), F.lit(None).cast("long").alias("txn_id"))


def _elements(space: Keyspace) -> DataFrame:
    """key, element and value of all types, as text."""
    none = F.lit("")
    parts = [
        space.strings.select("key", none.alias("element"), F.col("value").cast("string").alias("value")),
        space.hashes.select("key", F.col("field").alias("element"), F.col("value").cast("string").alias("value")),
        space.lists.select("key", F.col("pos").cast("string").alias("element"), F.col("value").cast("string").alias("value")),
        space.sets.select("key", F.col("member").alias("element"), none.alias("value")),
        space.zsets.select("key", F.col("member").alias("element"), format_score(F.col("score")).alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_STATE = f"""WITH e AS ({_E})
SELECT 'c:' || user_id AS key, '' AS element, sum(k)::BIGINT::VARCHAR AS value FROM e WHERE event_type = 'view' GROUP BY user_id
UNION ALL SELECT DISTINCT 's:' || user_id, 'm' || k, '' FROM e WHERE event_type = 'click'
UNION ALL SELECT 'h:' || user_id, 'f' || (k % 5), arg_max(event_id, (us, event_id))::VARCHAR FROM e WHERE event_type = 'purchase' GROUP BY ALL
UNION ALL SELECT 'l:' || user_id, (row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1)::VARCHAR, k::VARCHAR FROM e WHERE event_type = 'signup'
UNION ALL SELECT 'z:' || user_id, 'm' || (event_id % 7), arg_max(k, (us, event_id))::VARCHAR FROM e WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup') GROUP BY ALL"""


@query(_STATE)
def a_replay_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(Keyspace(final_state(_command_log(spark, sf_dir), NOW_MS), NOW_MS))


@query(_STATE)
def a_replay_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state out of the log of effects."""
    return _elements(Keyspace(final_state(normalised(_command_log(spark, sf_dir)), NOW_MS), NOW_MS))


@query(f"""SELECT CASE event_type WHEN 'view' THEN 'INCRBY' WHEN 'click' THEN 'SADD' WHEN 'purchase' THEN 'HSET' WHEN 'signup' THEN 'RPUSH' ELSE 'ZADD' END AS cmd, count(*) AS calls, 0::BIGINT AS errors FROM events GROUP BY 1""")
def i_command_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and errors of each command."""
    log = _command_log(spark, sf_dir)
    return log.join(replies(log), "seq").groupBy("cmd").agg(F.count("*").alias("calls"), F.count("error").alias("errors"))


@query("SELECT * FROM (VALUES " + ", ".join(str((n, c["family"], c["first"], c["last"], c["step"], c["writes"], c["fold"], c["scope"], n in REPLAYABLE)) for n, c in COMMANDS.items()) + ") c(name, family, first_key, last_key, step, writes, fold, scope, replayable)")
def i_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark)


# ---- expiries set with a value, and more of the keyspace


_OPT = f"""SELECT *, CASE event_type WHEN 'view' THEN 'EX' WHEN 'click' THEN 'PX' WHEN 'purchase' THEN 'EXAT' WHEN 'signup' THEN 'KEEPTTL' END AS opt,
  CASE event_type WHEN 'view' THEN (k - 3) * 86400 WHEN 'click' THEN (k - 3) * 86400007 WHEN 'purchase' THEN ts_ms // 1000 + k * 3600 END AS amount FROM ({_E})"""


@query(f"""SELECT key, value, CASE WHEN opt = 'KEEPTTL' AND last_ms >= kept.e THEN NULL ELSE kept.e END AS expires_at_ms FROM (
  SELECT user_id AS key, arg_max(event_type, (us, event_id)) AS value, max(ts_ms) AS last_ms, arg_max({{'o': opt}}, (us, event_id)).o AS opt,
    arg_max({{'e': CASE opt WHEN 'EX' THEN ts_ms + amount * 1000 WHEN 'PX' THEN ts_ms + amount WHEN 'EXAT' THEN amount * 1000 END}}, (us, event_id)) FILTER (WHERE opt IS NULL OR opt <> 'KEEPTTL') AS kept
  FROM ({_OPT}) WHERE amount IS NULL OR amount > 0 GROUP BY user_id)""")
def s_set_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET with EX, PX, EXAT, KEEPTTL or nothing; amounts of 0 and below are refused."""
    kind, k = F.col("event_type"), F.col("k")
    option = F.when(kind == "view", "EX").when(kind == "click", "PX").when(kind == "purchase", "EXAT").when(kind == "signup", "KEEPTTL")
    amount = F.when(kind == "view", (k - 3) * 86_400).when(kind == "click", (k - 3) * 86_400_007).when(kind == "purchase", F.expr("ts_ms div 1000") + k * 3_600)
    return strings.set_with_expiry(events(spark, sf_dir).select("key", "seq", "ts_ms", kind.alias("value"), option.alias("option"), amount.alias("amount")))


@query(f"""SELECT user_id % 2 || ':' || user_id AS key, arg_max(event_type, (us, event_id)) AS value, max_by(ts_ms + k * CASE WHEN user_id % 2 = 0 THEN 1000 ELSE 1 END, (us, event_id)) AS expires_at_ms FROM ({_E}) WHERE k > 0 GROUP BY user_id""")
def s_setex_psetex(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("key") % 2
    log = events(spark, sf_dir).select(F.concat(even, F.lit(":"), F.col("key")).alias("key"), "seq", "ts_ms", F.col("event_type").alias("value"), F.when(even == 0, "EX").otherwise("PX").alias("option"), F.col("k").alias("amount"))
    return strings.set_with_expiry(log)


@query(f"SELECT user_id AS key, event_id, -sum(k) OVER (PARTITION BY user_id ORDER BY us, event_id)::BIGINT AS total FROM ({_E})")
def s_decrby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings.increments(events(spark, sf_dir).select("key", "seq", "event_id", (-F.col("k")).alias("delta"))).select("key", "event_id", "total")


@query(f"SELECT user_id AS key, arg_max({{'e': CASE WHEN event_type <> 'view' THEN ts_ms + k END}}, (us, event_id)).e AS expires_at_ms FROM ({_E}) GROUP BY user_id")
def x_pexpireat(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("event_type") == "view", "persist").otherwise("at_ms")
    return keys.expire_at(events(spark, sf_dir).select("key", "seq", "ts_ms", unit.alias("unit"), (F.col("ts_ms") + F.col("k")).alias("amount")))


@query(f"SELECT 'before' AS at, count(*) AS n FROM ({_X}) WHERE exp IS NULL OR exp > {NOW_MS} UNION ALL SELECT 'after', 0")
def k_dbsize_flushdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _expiring(spark, sf_dir)
    return keys.size(rows, NOW_MS).withColumn("at", F.lit("before")).unionByName(keys.size(keys.flush(rows), NOW_MS).withColumn("at", F.lit("after")))


@query(f"""SELECT o_custkey AS key, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::BIGINT AS pos, o_orderkey::VARCHAR AS value FROM orders
UNION ALL SELECT user_id, (n + row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1)::BIGINT, event_type FROM ({_E}) JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = user_id""")
def l_rpushx(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = lists.indexed(_orders_list(spark, sf_dir)).select("key", F.col("index").alias("pos"), "value")
    return lists.push_existing(there, events(spark, sf_dir).select("key", "seq", F.col("event_type").alias("value"), F.lit("right").alias("side")))


@query(f"""WITH f AS (SELECT user_id, event_type, arg_max(k, (us, event_id)) AS k FROM ({_E}) GROUP BY ALL)
SELECT user_id AS key, '{{"t":{{' || string_agg('"' || event_type || '":{{"k":' || k || '}}', ',' ORDER BY event_type) || '}}}}' AS doc, 0::BIGINT AS errors FROM f GROUP BY user_id""")
def j_jset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values set at paths whose objects are made on the way."""
    path = F.concat(F.lit("$.t."), F.col("event_type"), F.lit(".k"))
    return documents.fold(events(spark, sf_dir).select("key", "seq", path.alias("path"), F.col("k").cast("string").alias("value")))


@query(f"""WITH f AS (SELECT user_id, event_type, arg_max(k, (us, event_id)) AS k FROM ({_E}) GROUP BY ALL), l AS (SELECT user_id, arg_max(event_id, (us, event_id)) AS id FROM ({_E}) GROUP BY user_id)
SELECT user_id AS key, '{{"a":{{' || coalesce(string_agg('"' || event_type || '":{{"k":' || k || '}}', ',' ORDER BY event_type) FILTER (WHERE k >= 10), '') || '}},"last":' || any_value(id) || '}}' AS doc, 0::BIGINT AS errors
FROM f JOIN l USING (user_id) GROUP BY user_id""")
def j_jmerge_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested merge patches, in which null removes a field."""
    inner = F.when(F.col("k") >= 10, F.concat(F.lit('{"k":'), F.col("k"), F.lit("}"))).otherwise("null")
    patch = F.concat(F.lit('{"a":{"'), F.col("event_type"), F.lit('":'), inner, F.lit('},"last":'), F.col("event_id"), F.lit("}"))
    return documents.fold(events(spark, sf_dir).select("key", "seq", F.lit(None).cast("string").alias("path"), patch.alias("value")))


@query(f"""WITH c AS (SELECT user_id AS key, arg_max(k + 1, (us, event_id)) AS "limit", arg_max((k + 1) * 3600, (us, event_id)) * 1000 AS window_ms FROM ({_E}) GROUP BY user_id), m AS (SELECT user_id, max(ts_ms) AS t FROM ({_E}) GROUP BY user_id)
SELECT key, "limit", window_ms, count(*) AS n FROM c JOIN m ON m.user_id = key JOIN ({_E}) e ON e.user_id = key AND e.ts_ms > t - window_ms GROUP BY ALL""")
def r_rlset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last configuration of each limiter, and the attempts within its window."""
    e = events(spark, sf_dir)
    configs = limiter.upkeep(e.select("key", "seq", (F.col("k") + 1).alias("limit"), ((F.col("k") + 1) * 3_600).alias("window_s")))
    return limiter.check_counts(configs, e.select("key", "ts_ms"))


# ---- snapshots, tokens, notices


@query(f"SELECT 'user:' || user_id AS key, 'string' AS kind, max(event_type) AS value, CASE WHEN user_id % 3 > 0 THEN {NOW_MS} + (user_id % 5 - 2) * {DAY_MS} END AS expires_at_ms, 77::BIGINT AS seq, {NOW_MS // 1000} AS saved_s FROM events WHERE user_id % 3 = 0 OR user_id % 5 > 2 GROUP BY user_id")
def k_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAVE, LASTSAVE and loading: what had expired is in no snapshot."""
    user = F.col("user_id")
    expires = F.when(user % 3 > 0, F.lit(NOW_MS) + (user % 5 - 2) * DAY_MS)
    state = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_type").alias("v")).select(F.concat(F.lit("user:"), user).alias("key"), F.lit("string").alias("kind"), F.col("v").cast("binary").alias("payload"), expires.cast("long").alias("expires_at_ms"))
    path = shared_path(spark, "snapshot")
    snapshot.save(state, path, 77, NOW_MS)
    rows, seq = snapshot.load(spark, path, NOW_MS)
    return rows.select("key", "kind", F.col("payload").cast("string").alias("value"), "expires_at_ms", F.lit(seq).cast("long").alias("seq"), F.lit(snapshot.last_save(spark, path)).cast("long").alias("saved_s"))


GRANTS = [("a", "secret", "user:1*,user:2?", 200), ("b", "secret", "user:?", None), ("late", "secret", "*", 100), ("forged", "other", "*", None), ("none", "secret", "", None)]


@query("SELECT client, 'user:' || user_id AS key FROM (SELECT DISTINCT user_id FROM events), (VALUES ('a', 'user:1%'), ('a', 'user:2_'), ('b', 'user:_')) g(client, p) WHERE 'user:' || user_id LIKE p GROUP BY ALL")
def y_token_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clients see whose scopes come from signed tokens; forged, ended and empty ones grant nothing."""
    scopes = []
    for client, secret, names, end in GRANTS:
        try:
            scopes += [(client, p) for p in messages.verify_token("secret", messages.sign_token(secret, names.split(","), end), 150)]
        except ValueError:
            continue
    names = table(spark, sf_dir, "events").select(F.concat(F.lit("user:"), F.col("user_id")).alias("key")).distinct()
    return messages.visible(names, spark.createDataFrame(scopes, "client string, pattern string"))


@query(f"SELECT DISTINCT 'change' AS kind, 99::BIGINT AS seq, pattern AS key, NULL::VARCHAR AS value FROM ({_S}) WHERE kind = 'pattern'")
def q_flush_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.flush_notices(_subscriptions(spark).where("kind = 'pattern'").select("pattern").distinct(), 99)


@query(f"""WITH w AS (SELECT event_id AS seq, 'user:' || user_id AS key FROM events), p(conn_id, kind, pattern) AS (VALUES (1, 'exact', 'user:7'), (1, 'pattern', 'user:?'), (2, 'pattern', 'user:1*'), (3, 'exact', 'nobody'))
SELECT DISTINCT seq, key, conn_id FROM w JOIN p ON CASE WHEN kind = 'exact' THEN key = pattern ELSE {_GLOB.format(text="key", pattern="pattern")} END""")
def n_watch_notify(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), F.col("user_id")).alias("key"))
    watchers = [(1, "exact", "user:7"), (1, "pattern", "user:?"), (2, "pattern", "user:1*"), (3, "exact", "nobody")]
    return sync.notified(writes, spark.createDataFrame(watchers, "conn_id int, kind string, pattern string"))


@query("""WITH r AS (SELECT o_custkey AS conn, o_orderpriority AS pattern, o_orderkey AS seq, o_orderstatus = 'O' AS on_, o_orderstatus = 'P' AS all_ FROM orders),
c AS (SELECT conn, max(seq) AS cleared FROM r WHERE all_ GROUP BY conn), l AS (SELECT conn, pattern, arg_max({'on': on_, 'seq': seq}, seq) AS x FROM r WHERE NOT all_ GROUP BY ALL)
SELECT l.conn AS conn_id, pattern FROM l LEFT JOIN c ON c.conn = l.conn WHERE x.on AND (cleared IS NULL OR cleared < x.seq)""")
def q_qunsub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live queries that are left: requests that start one, end one, or end all of a connection."""
    o = table(spark, sf_dir, "orders")
    pattern = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return sync.subscribed(o.select(F.col("o_custkey").alias("conn_id"), pattern.alias("pattern"), (F.col("o_orderstatus") == "O").alias("on"), F.col("o_orderkey").alias("seq")))


_WATCHED = """WITH t AS (SELECT o_orderkey AS txn_id, o_custkey AS key, o_orderkey AS watch_seq, o_orderkey + 200 AS exec_seq, o_orderstatus = 'P' AS discarded, o_orderpriority LIKE '1%' AS unwatched FROM orders)
SELECT t.txn_id, t.exec_seq, t.discarded, NOT t.discarded AND (t.unwatched OR NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = t.key AND o.o_orderkey + 100 > t.watch_seq AND o.o_orderkey + 100 < t.exec_seq AND o.o_orderkey <> t.txn_id)) AS committed FROM t"""


@query(_WATCHED)
def w_discard_unwatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of which some are discarded and some give up their watches before EXEC."""
    o = table(spark, sf_dir, "orders")
    id_ = F.col("o_orderkey")
    txns = o.select(id_.alias("txn_id"), (id_ + 200).alias("exec_seq"), (F.col("o_orderstatus") == "P").alias("discarded"))
    watches = o.select(id_.alias("txn_id"), F.col("o_custkey").alias("key"), id_.alias("watch_seq"))
    writes = o.select(F.col("o_custkey").alias("key"), (id_ + 100).alias("seq"), id_.alias("txn_id"))
    ended = o.where("o_orderpriority LIKE '1%'").select(id_.alias("txn_id"), F.when(id_ % 2 == 0, F.col("o_custkey")).alias("key"), (id_ + 150).alias("seq"))
    return messages.commits(txns, watches, writes, ended)


# ---- replicas and clients


def _typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of keys of five types: nations, customers, orders of customers, users of event types, segments."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey")).alias("key"), F.col("n_name").alias("value"))
    prefixed = lambda df, p: df.withColumn("key", F.concat(F.lit(p), F.col("key")))
    lists_ = prefixed(_orders_list(spark, sf_dir).select("key", "pos", "value"), "l:")
    docs = table(spark, sf_dir, "events").select(F.concat(F.lit("e:"), F.col("event_id")).alias("key"), F.col("props").alias("doc"))
    return sync.change_values(n, _customer_hash(spark, sf_dir), lists_, prefixed(_event_sets(spark, sf_dir), "s:"), prefixed(_segments(spark, sf_dir), "z:"), docs)


_QUOTED = """'"' || {} || '"'"""
_VALUES = f"""SELECT 'n:' || n_nationkey AS key, n_name AS payload FROM nation
UNION ALL SELECT key, '["hash",' || string_agg('"' || field || '","' || value || '"', ',' ORDER BY field) || ']' FROM ({_H}) GROUP BY key
UNION ALL SELECT 'l:' || key, '["list",' || string_agg('"' || value || '"', ',' ORDER BY i) || ']' FROM ({_L}) GROUP BY key
UNION ALL SELECT 's:' || event_type, '["set",' || string_agg('"' || user_id || '"', ',' ORDER BY user_id) || ']' FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY event_type
UNION ALL SELECT 'z:' || key, '["zset",' || string_agg('"' || member || '","' || CASE WHEN score = floor(score) THEN score::BIGINT::VARCHAR ELSE score::DECIMAL(18, 2)::DOUBLE::VARCHAR END || '"', ',' ORDER BY score, member) || ']' FROM ({_Z}) GROUP BY key
UNION ALL SELECT 'e:' || event_id, '["json","' || replace(props, '"', '\\"') || '"]' FROM events"""


@query(_VALUES)
def c_change_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed_values(spark, sf_dir)


@query("""SELECT 'customer:' || c_custkey AS key, 'string' AS type, '' AS element, 'old' AS value FROM customer WHERE c_custkey > (SELECT max(c_custkey) / 2 FROM customer)
UNION ALL SELECT 'customer:' || c_custkey, 'hash', unnest(['name', 'segment', 'nation']), unnest([c_name, c_mktsegment, c_nationkey::VARCHAR]) FROM customer WHERE c_custkey <= (SELECT max(c_custkey) / 2 FROM customer) AND c_custkey % 3 <> 0
UNION ALL SELECT 'z:' || c_mktsegment, 'zset', lpad(c_custkey::VARCHAR, 8, '0'), CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR ELSE c_acctbal::DECIMAL(18, 2)::DOUBLE::VARCHAR END FROM customer""")
def c_apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replica that is pushed hashes for the first half of its keys, every third of them gone again, and sorted sets."""
    c = table(spark, sf_dir, "customer")
    key = F.concat(F.lit("customer:"), F.col("c_custkey")).alias("key")
    half = c.agg((F.max("c_custkey") / 2).alias("half"))
    first = c.crossJoin(F.broadcast(half)).where("c_custkey <= half")  # one row
    named = first.select(F.col("c_custkey").alias("seq"), key).unionByName(c.select(F.lit(0).cast("long").alias("seq"), F.concat(F.lit("z:"), F.col("c_mktsegment")).alias("key")).distinct())
    pushed = sync.changes(named, _typed_values(spark, sf_dir)).unionByName(first.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 1_000_000_000).alias("seq"), key, F.lit(None).cast("string").alias("payload")))
    return sync.elements(sync.apply_changes(c.select(key, F.lit("old").alias("payload")), pushed))


@query("SELECT key, CASE WHEN type = 'string' THEN value ELSE type END AS value, CASE WHEN type = 'string' THEN value END AS matching FROM (SELECT 'n:' || n_nationkey AS key, 'string' AS type, n_name AS value FROM nation UNION ALL SELECT 'n:c' || c_custkey, 'hash', NULL FROM customer) ORDER BY key LIMIT 100")
def q_state_and_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first state of a live query, at most 100 keys, next to what getMatching gives for these."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey")).alias("key"), F.lit("string").alias("type"), F.col("n_name").alias("value"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("n:c"), F.col("c_custkey")).alias("key"), F.lit("hash").alias("type"), F.lit(None).cast("string").alias("value"))
    both = n.unionByName(c)
    return sync.query_state(both, "n:*", 100).join(sync.get_matching(both, "n:*").select("key", F.col("value").alias("matching")), "key")


_OUT = f"SELECT user_id AS client, event_id AS seq, k < 5 AS acked, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS number FROM ({_E})"


@query(f"""WITH o AS ({_OUT}), p AS (SELECT *, count(CASE WHEN NOT acked THEN 1 END) OVER (PARTITION BY client ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM o)
SELECT client, seq, number, {3 << 32} + number AS wire_id, 1000 + row_number() OVER (PARTITION BY client ORDER BY number DESC) - 1 AS new_number FROM p WHERE NOT acked AND later < 10""")
def o_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client still has to send, at most ten writes, and its numbers in the next session."""
    writes = events(spark, sf_dir).select(F.col("key").alias("client"), F.col("event_id").alias("seq"), (F.col("k") < 5).alias("acked"))
    left = sync.outbox(writes, epoch=3, most=10).where("pending").select("client", "seq", "number", "wire_id")
    return sync.restored(left, 1_000)


@query(f"SELECT event_id, CASE WHEN event_type = 'view' THEN 'set' ELSE 'HSET' END AS cmd FROM events WHERE event_type IN ('view', 'purchase')")
def o_replayable(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    cmd = F.when(kind == "view", "set").when(kind == "purchase", "HSET").when(kind == "click", "APPEND").otherwise("CONFIG")
    return sync.replayable(table(spark, sf_dir, "events").select("event_id", cmd.alias("cmd")))


@query(f"SELECT k AS replica, max(event_id) AS acked, (SELECT max(event_id) FROM events) - max(event_id) AS lag FROM ({_E}) WHERE event_type = 'signup' GROUP BY k")
def o_replica_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return sync.lag(e.select(F.col("event_id").alias("seq")), e.where("event_type = 'signup'").select(F.col("k").alias("replica"), F.col("event_id").alias("seq")))


@query(f"SELECT user_id AS client, max(k) AS mark, max(ts_ms) AS last_ms FROM ({_E}) GROUP BY user_id HAVING max(ts_ms) > (SELECT max(ts_ms) FROM ({_E})) - {DAY_MS}")
def d_idle_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of clients that wrote within a day; the sweep starts above ten clients here."""
    e = events(spark, sf_dir)
    now = e.agg(F.max("ts_ms")).first()[0]
    return sync.swept_marks(e.groupBy(F.col("key").alias("client")).agg(F.max("k").alias("mark"), F.max("ts_ms").alias("last_ms")), now, most=10)


# ---- a log of many families


def _family_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commands for each event: one of moves, renames, expiring values and transactions, then a read or one that may be refused."""
    e = events(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("seq")))
    user, k, kind = F.col("key").cast("string"), F.col("k").cast("string"), F.col("event_type")
    named = lambda p: F.concat(F.lit(p), user)
    first = {
        "view": ("PSETEX", [named("e:"), (F.col("k") * 3_600_000 + 1).cast("string"), F.col("event_id").cast("string")]),
        "click": ("SADD", [named("s:"), F.concat(F.lit("m"), F.col("k") % 7)]),
        "purchase": ("SMOVE", [named("s:"), named("t:"), F.concat(F.lit("m"), F.col("k") % 7)]),
        "signup": ("RENAME", [named("a:"), named("b:")]),
    }
    cmd, args = F.lit("SET"), F.array(named("a:"), F.col("event_id").cast("string"))
    for name, (c, parts) in first.items():
        cmd, args = F.when(kind == name, c).otherwise(cmd), F.when(kind == name, F.array(*parts)).otherwise(args)
    second = F.when(kind == "view", F.struct(F.lit("LPUSH").alias("cmd"), F.array(named("e:"), k).alias("args"))).otherwise(F.struct(F.lit("GET").alias("cmd"), F.array(named("a:")).alias("args")))
    place = (F.col("n") * 1_000_000 + F.col("key")).cast("long") * 2
    both = e.select(place.alias("place"), "ts_ms", F.explode(F.array(F.struct(F.lit(0).alias("turn"), cmd.alias("cmd"), args.alias("args")), F.struct(F.lit(1).alias("turn"), second["cmd"].alias("cmd"), second["args"].alias("args")))).alias("x"), F.when(kind == "signup", F.col("event_id")).alias("txn_id"))
    return both.select((F.col("place") + F.col("x.turn")).alias("seq"), "ts_ms", "x.cmd", F.col("x.args").cast("array<binary>").alias("args"), "txn_id")


_OPS = f"""e AS ({_E}), m AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id, k % 7 ORDER BY us, event_id) AS before, lead(event_type) OVER (PARTITION BY user_id, k % 7 ORDER BY us, event_id) AS after FROM e WHERE event_type IN ('click', 'purchase')),
a AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before, lag(event_id) OVER (PARTITION BY user_id ORDER BY us, event_id) AS old, lead(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS after FROM e WHERE event_type NOT IN ('view', 'click', 'purchase'))"""
_FAMILIES = f"""WITH {_OPS}
SELECT 'e:' || user_id AS key, '' AS element, id::VARCHAR AS value FROM (SELECT user_id, arg_max(event_id, (us, event_id)) AS id, arg_max(ts_ms + k * 3600000 + 1, (us, event_id)) AS x FROM e WHERE event_type = 'view' GROUP BY user_id) WHERE x > {NOW_MS}
UNION ALL SELECT DISTINCT 's:' || user_id, 'm' || (k % 7), '' FROM m WHERE after IS NULL AND event_type = 'click'
UNION ALL SELECT DISTINCT 't:' || user_id, 'm' || (k % 7), '' FROM m WHERE event_type = 'purchase' AND before = 'click'
UNION ALL SELECT 'a:' || user_id, '', event_id::VARCHAR FROM a WHERE after IS NULL AND event_type <> 'signup'
UNION ALL SELECT 'b:' || user_id, '', arg_max(old, (us, event_id))::VARCHAR FROM a WHERE event_type = 'signup' AND before <> 'signup' GROUP BY user_id"""


@query(_FAMILIES)
def a_replay_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after moves, renames, expiring values, refused commands and transactions."""
    return _elements(Keyspace(final_state(_family_log(spark, sf_dir), NOW_MS), NOW_MS))


@query(_FAMILIES)
def a_families_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state out of the log of effects, in which relative times are absolute."""
    return _elements(Keyspace(final_state(normalised(_family_log(spark, sf_dir)), NOW_MS), NOW_MS))


@query(_FAMILIES)
def a_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state out of a log that was rewritten from it."""
    return _elements(Keyspace(final_state(rebuilt(final_state(_family_log(spark, sf_dir), NOW_MS)), NOW_MS), NOW_MS))


@query(f"""WITH {_OPS}, u AS (SELECT *, last_value(CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id) AS named FROM e)
SELECT 'LPUSH' AS cmd, count(*) AS calls, count(*) AS errors, 0::BIGINT AS hits, 0::BIGINT AS misses FROM u WHERE event_type = 'view'
UNION ALL SELECT 'GET', count(*), 0, count(CASE WHEN named <> 'signup' THEN 1 END), count(CASE WHEN named IS NULL OR named = 'signup' THEN 1 END) FROM u WHERE event_type <> 'view'
UNION ALL SELECT 'RENAME', count(*), count(CASE WHEN before IS NULL OR before = 'signup' THEN 1 END), 0, 0 FROM a WHERE event_type = 'signup'
UNION ALL SELECT CASE event_type WHEN 'view' THEN 'PSETEX' WHEN 'click' THEN 'SADD' WHEN 'purchase' THEN 'SMOVE' ELSE 'SET' END, count(*), 0, 0, 0 FROM e WHERE event_type <> 'signup' GROUP BY 1""")
def i_hits_and_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _family_log(spark, sf_dir)
    return command_stats(log, replies(log))
