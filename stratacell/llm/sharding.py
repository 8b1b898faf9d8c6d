"""Shards by a permutation-filled lookup table, with DataFrame functions only.

Each shard prefers the slots of a prime-sized table in the order of its own
permutation; the shards take turns, each claiming the first slot of its
preference that is still free. The table has a fixed number of rows (the prime)
and so is broadcast; placing a key is one hash and one lookup. When a shard is
added or removed, few keys move between the others.

Defined results: a null id is placed as the empty text; repeated ids go to the
same shard; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
#: Slots: a prime of over a hundred for each shard.
PRIME = 2039


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill(shards: tuple[str, ...] = SHARDS, prime: int = PRIME) -> list[int]:
    """The shard's number for each slot."""
    if not shards:
        raise ValueError("no shards")
    step = [(_number("offset:" + s) % prime, _number("skip:" + s) % (prime - 1) + 1) for s in shards]
    table, asked = [-1] * prime, [0] * len(shards)
    for turn in range(prime):
        k = turn % len(shards)
        offset, skip = step[k]
        while table[(offset + asked[k] * skip) % prime] >= 0:
            asked[k] += 1
        table[(offset + asked[k] * skip) % prime] = k
    return table


def slot(key: Column, prime: int = PRIME) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % prime


def lookup(spark: SparkSession, shards: tuple[str, ...] = SHARDS, prime: int = PRIME) -> DataFrame:
    """(slot, shard) of each slot."""
    numbers = ",".join(map(str, fill(shards, prime)))
    names = F.array(*[F.lit(s) for s in shards])
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(numbers), ",")).alias("slot", "k"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.get(names, F.col("k").cast("int")).alias("shard"))


def place(table: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, prime: int = PRIME) -> DataFrame:
    """(key, slot, shard) of each row."""
    rows = table.select(key, slot(F.col(key), prime).alias("slot"))
    return rows.join(F.broadcast(lookup(table.sparkSession, shards, prime)), "slot").select(key, "slot", "shard")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document with its shard, and the bytes of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", slot(F.col("doc_id")).alias("slot"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("text_bytes"))
    return rows.join(F.broadcast(lookup(spark)), "slot").select("doc_id", "slot", "shard", "text_bytes")


SQL = f"""
WITH RECURSIVE s AS (SELECT i AS k, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range({len(SHARDS)}) t(i)),
p AS (SELECT list(('0x' || md5('offset:' || name)[1:8])::BIGINT % {PRIME} ORDER BY k) AS o,
  list(('0x' || md5('skip:' || name)[1:8])::BIGINT % {PRIME - 1} + 1 ORDER BY k) AS j FROM s),
t AS (
  SELECT 0 AS turn, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS k
  UNION ALL
  SELECT turn + 1, list_append(taken, c), c, turn % {len(SHARDS)} FROM (
    SELECT turn, taken, list_filter([(o[turn % {len(SHARDS)} + 1] + a * j[turn % {len(SHARDS)} + 1]) % {PRIME} for a in range({PRIME})],
      lambda x: NOT list_contains(taken, x))[1] AS c FROM t, p WHERE turn < {PRIME}))
SELECT doc_id, d.slot AS slot, name AS shard, CAST(coalesce(strlen(text), 0) AS BIGINT) AS text_bytes
FROM (SELECT doc_id, text, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT % {PRIME} AS slot FROM documents) d
JOIN t ON t.slot = d.slot JOIN s ON s.k = t.k
"""
