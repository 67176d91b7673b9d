"""What is known of every command without running it: family, keys, kind of fold, scope class.

One line for each family, as text: names with the place of their first key, of their last key and the
step between keys (0 0 0: none; a last of -1: to the end), then r (reads) or w (writes) and the way a log of the
command alone can be folded: last, first, sum, order (only in order), multi (several keys at once), none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names and key positions of the commands.
_ROWS = """
string: SET 1 1 1 w last, GET 1 1 1 r none, ESET 1 1 1 w last, APPEND 1 1 1 w order, STRLEN 1 1 1 r none, GETRANGE 1 1 1 r none, GETSET 1 1 1 w last, MGET 1 -1 1 r none, MSET 1 -1 2 w last, SETNX 1 1 1 w first, SETEX 1 1 1 w last, PSETEX 1 1 1 w last, INCR 1 1 1 w sum, DECR 1 1 1 w sum, INCRBY 1 1 1 w sum, DECRBY 1 1 1 w sum
expiry: EXPIRE 1 1 1 w last, PEXPIRE 1 1 1 w last, EXPIREAT 1 1 1 w last, PEXPIREAT 1 1 1 w last, TTL 1 1 1 r none, PTTL 1 1 1 r none, PERSIST 1 1 1 w last
keys: DEL 1 -1 1 w multi, UNLINK 1 -1 1 w multi, EXISTS 1 -1 1 r none, KEYS 0 0 0 r none, SCAN 0 0 0 r none, DBSIZE 0 0 0 r none, FLUSHDB 0 0 0 w multi, RENAME 1 2 1 w multi, TYPE 1 1 1 r none, MEMORY 2 2 1 r none
hash: HSET 1 1 1 w last, HMSET 1 1 1 w last, HGET 1 1 1 r none, HGETALL 1 1 1 r none, HDEL 1 1 1 w last, HKEYS 1 1 1 r none, HVALS 1 1 1 r none, HLEN 1 1 1 r none, HINCRBY 1 1 1 w sum, HINCRBYFLOAT 1 1 1 w sum, HEXISTS 1 1 1 r none, HSETNX 1 1 1 w first, HMGET 1 1 1 r none, HSCAN 1 1 1 r none
list: LPUSH 1 1 1 w order, RPUSH 1 1 1 w order, LPUSHX 1 1 1 w order, RPUSHX 1 1 1 w order, LPOP 1 1 1 w order, RPOP 1 1 1 w order, LRANGE 1 1 1 r none, LLEN 1 1 1 r none, LINDEX 1 1 1 r none, LSET 1 1 1 w order, LREM 1 1 1 w order, LTRIM 1 1 1 w order
set: SADD 1 1 1 w last, SMEMBERS 1 1 1 r none, SREM 1 1 1 w last, SCARD 1 1 1 r none, SISMEMBER 1 1 1 r none, SMISMEMBER 1 1 1 r none, SINTER 1 -1 1 r none, SINTERSTORE 1 -1 1 w multi, SUNION 1 -1 1 r none, SUNIONSTORE 1 -1 1 w multi, SDIFF 1 -1 1 r none, SDIFFSTORE 1 -1 1 w multi, SPOP 1 1 1 w order, SRANDMEMBER 1 1 1 r none, SMOVE 1 2 1 w multi, SSCAN 1 1 1 r none
zset: ZADD 1 1 1 w last, ZRANGE 1 1 1 r none, ZREVRANGE 1 1 1 r none, ZRANGEBYSCORE 1 1 1 r none, ZREVRANGEBYSCORE 1 1 1 r none, ZSCORE 1 1 1 r none, ZMSCORE 1 1 1 r none, ZRANK 1 1 1 r none, ZREVRANK 1 1 1 r none, ZREM 1 1 1 w last, ZCARD 1 1 1 r none, ZINCRBY 1 1 1 w sum, ZCOUNT 1 1 1 r none, ZSCAN 1 1 1 r none
json: JSET 1 1 1 w order, JGET 1 1 1 r none, JMERGE 1 1 1 w order
limit: RLSET 1 1 1 w last, RLCHECK 1 1 1 w order
transaction: MULTI 0 0 0 r none, EXEC 0 0 0 r none, DISCARD 0 0 0 r none, WATCH 1 -1 1 r none, UNWATCH 1 -1 1 r none
messages: SUBSCRIBE 0 0 0 r none, UNSUBSCRIBE 0 0 0 r none, PSUBSCRIBE 0 0 0 r none, PUNSUBSCRIBE 0 0 0 r none, PUBLISH 0 0 0 r none, PUBSUB 0 0 0 r none
sync: SYNC 0 0 0 r none, DEDUP 0 0 0 r none, QSUB 0 0 0 r none, QUNSUB 0 0 0 r none
server: PING 0 0 0 r none, AUTH 0 0 0 r none, HELLO 0 0 0 r none, INFO 0 0 0 r none, QUIT 0 0 0 r none, CLIENT 0 0 0 r none, CONFIG 0 0 0 r none, COMMAND 0 0 0 r none, CLUSTER 0 0 0 r none, MODULE 0 0 0 r none, SAVE 0 0 0 r none, BGSAVE 0 0 0 r none, LASTSAVE 0 0 0 r none, REPLICAOF 0 0 0 r none
"""

#: What a scope-limited client may never run.
ADMIN = frozenset("AUTH HELLO CLIENT CONFIG CLUSTER MODULE SAVE BGSAVE REPLICAOF FLUSHDB KEYS SCAN DBSIZE INFO".split())

#: What a peer may push into a replica.
REPLAYABLE = frozenset("SET DEL UNLINK MSET INCR DECR INCRBY DECRBY EXPIRE PEXPIRE EXPIREAT PEXPIREAT PERSIST FLUSHDB RENAME HSET HDEL HSETNX LPUSH RPUSH LPOP RPOP LSET LREM LTRIM SADD SREM SMOVE SINTERSTORE SUNIONSTORE SDIFFSTORE ZADD ZREM ZINCRBY JSET JMERGE".split())


def commands() -> dict[str, dict]:
    """name -> family, first, last, step, writes, fold, scope."""
    out = {}
    for line in _ROWS.strip().splitlines():
        family, _, rest = line.partition(": ")
        for row in rest.split(", "):
            name, first, last, step, access, fold = row.split()
            scope = "admin" if name in ADMIN else "keys" if int(first) else "keyless"
            out[name] = {"family": family, "first": int(first), "last": int(last), "step": int(step), "writes": access == "w", "fold": fold, "scope": scope}
    return out


COMMANDS = commands()


def keys_of(name: str, args: list) -> list:
    """The arguments of a command that are keys."""
    c = COMMANDS.get(name.upper())
    if c is None or not c["first"]:
        return []
    end = len(args) if c["last"] == -1 else c["last"]
    return args[c["first"] - 1 : end : c["step"]]


def catalog(spark: SparkSession) -> DataFrame:
    """COMMAND: a row for each command."""
    rows = [(n, c["family"], c["first"], c["last"], c["step"], c["writes"], c["fold"], c["scope"], n in REPLAYABLE) for n, c in COMMANDS.items()]
    return spark.createDataFrame(rows, "name string, family string, first_key int, last_key int, step int, writes boolean, fold string, scope string, replayable boolean")
