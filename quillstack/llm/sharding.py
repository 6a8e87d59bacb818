"""Jump consistent hashing: stable keys to shards, without a table of the ring.

The generator of the published algorithm (Lamping and Veach, 2014) is kept, so the shard of a key is the one that any
other implementation gives. Everything is built-in Spark expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.llm.common import documents

#: The multiplier of the published generator, in four 16-bit parts from low to high, and its increment 1.
MULTIPLIER = 2862933555777941757
_A = [(MULTIPLIER >> s) & 0xFFFF for s in (0, 16, 32, 48)]
_LOW, _SHORT = 0xFFFFFFFF, 0xFFFF

#: About so many documents of a shard are numbered in one group.
ROWS_PER_BLOCK = 2048


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo), the two halves of key * MULTIPLIER + 1 modulo 2**64; no product or sum leaves 63 bits."""
    t, u = lo * _A[0] + 1, lo * _A[1]
    low = t.bitwiseAND(_LOW) + F.shiftleft(u.bitwiseAND(_SHORT), 16)
    high = (
        F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(t, 32) + F.shiftrightunsigned(u, 16)
        + lo * _A[2] + F.shiftleft((lo * _A[3]).bitwiseAND(_SHORT), 16)
        + hi * _A[0] + F.shiftleft((hi * _A[1]).bitwiseAND(_SHORT), 16)
    )
    return high.bitwiseAND(_LOW), low.bitwiseAND(_LOW)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a 64-bit key; a null key counts as 0.

    A key makes about ln(shards) jumps. So many rounds are made for all keys, with a wide margin; keys that are not
    through by then, which there may never be, go on for the at most `shards` rounds that are possible.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(
        long(0).alias("b"), long(0).alias("j"),
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_LOW).alias("lo"),
    )

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        step = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(hi, 1) + 1).cast("double")))
        moved = F.struct(s["j"].alias("b"), step.cast("long").alias("j"), hi.alias("hi"), lo.alias("lo"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    usual = min(shards, 16 + 4 * math.ceil(math.log(shards)))
    go = lambda s, rounds: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), s, jump)
    whole = lambda s: F.when(s["j"] < shards, go(s, shards)).otherwise(s) if usual < shards else s
    return F.aggregate(F.sequence(F.lit(1), F.lit(usual)), start, jump, lambda s: whole(s)["b"].cast("int"))


def with_slots(df: DataFrame, shard: str, key: str, more: list[str], rows: int) -> DataFrame:
    """df with `slot`: the place of the row in its shard, gapless from 0, by the MD5 of the key (as text; null as empty), then by `more`.

    A shard is numbered in blocks that ranges of the digest make, so no task holds a shard. Rows that agree on all
    columns are counted first and dealt out again, so that copies of one row don't meet in a task either.
    """
    counted = df.groupBy(shard, key, *more).agg(F.count("*").alias("_n"))
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    blocks = max(1, -(-rows // (ROWS_PER_BLOCK * 16)))
    block = F.floor(F.conv(F.substring("_md5", 1, 8), 16, 10).cast("long") * blocks / F.lit(float(1 << 32))).cast("long")
    counted = counted.withColumn("_md5", digest).withColumn("_block", block)
    sizes = counted.groupBy(shard, "_block").agg(F.sum("_n").alias("_size"))
    before = W.partitionBy(shard).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(shard, "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    inside = W.partitionBy(shard, "_block").orderBy("_md5", *more).rowsBetween(W.unboundedPreceding, -1)
    numbered = counted.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(sizes, [shard, "_block"])
    place = (F.col("_first") + F.col("_at")).cast("long")
    return numbered.select(shard, key, *more, F.explode(F.sequence(place, place + F.col("_n") - 1)).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: key, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: the key and the number of shards decide, and with one more shard (grown_shard) rows only move
    into that one. size is the UTF-8 bytes of the text plus 1. A null text is an empty one; a null key counts as 0.
    Rows that agree on key and text are told apart by slot alone. Other columns of docs are ignored, whatever their
    names. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"),
        jump_shard(F.col(key), shards).alias("shard"),
    )
    rows = docs.count()
    placed = with_slots(narrow, "shard", "doc_id", ["size", "text_crc32"], rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"))


def op8_jump_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), shards=16)


def _crc_table() -> list[int]:
    """The table of the CRC-32 polynomial for four bits at a time."""
    found = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        found.append(n)
    return found


OP8_SQL = f"""
WITH RECURSIVE jump(k, n, b, j, h) AS (
    SELECT k, n, 0::BIGINT, 0::BIGINT, (k::HUGEINT + 18446744073709551616) % 18446744073709551616
    FROM (SELECT DISTINCT coalesce(doc_id, 0) AS k FROM documents), (VALUES (16), (17)) AS s(n)
    UNION ALL
    SELECT k, n, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / (g // 8589934592 + 1)::DOUBLE))::BIGINT, g
    FROM (SELECT k, n, j, (h * {MULTIPLIER} + 1) % 18446744073709551616 AS g FROM jump WHERE j < n)
),
fell AS (SELECT k, n, b FROM jump WHERE j >= n),
bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS l FROM documents),
crc AS (
    SELECT doc_id, len(l)::BIGINT + 1 AS size, list_reduce(list_prepend(4294967295::BIGINT, l),
        lambda c, b: xor(xor(c >> 4, t[(xor(c, b) & 15) + 1]) >> 4, t[(xor(xor(c >> 4, t[(xor(c, b) & 15) + 1]), b >> 4) & 15) + 1])) AS c
    FROM bytes, (SELECT {_crc_table()}::BIGINT[] AS t)
),
placed AS (SELECT c.doc_id, size, xor(c, 4294967295::BIGINT)::BIGINT AS text_crc32, a.b::INTEGER AS shard, z.b::INTEGER AS grown_shard
    FROM crc c JOIN fell a ON a.k = coalesce(c.doc_id, 0) AND a.n = 16 JOIN fell z ON z.k = coalesce(c.doc_id, 0) AND z.n = 17)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(doc_id::VARCHAR, '')), size, text_crc32) - 1 AS slot, grown_shard
FROM placed
"""
