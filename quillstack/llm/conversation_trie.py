"""The trie of all prefixes of conversations, from mergeable partial tries.

A node is a sequence of turns from the start. It is known by its depth and 128 bits: the exclusive or, over its turns, of
hashes of place and turn, so that the key of every prefix is a running value and can be had block by block.

Rows are range-sorted by conversation, and each range makes a partial trie: a table of its nodes with members, least
member and the list of conversations that end there. Tables of neighbouring ranges are merged by node, a few at a time,
again and again, until there is one. A list stays in the pieces that the ranges made, in order, so no list grows with
the corpus.

The rollup goes from the leaves up. Nodes with the same least member are a chain, part of that conversation's path;
running sums along it give what is below within the chain. What a whole chain holds goes to each node above it, which
are on the same conversation's path, and is summed there by node. So nothing is repeated for each level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.llm.common import map_batches, n_words, stored

#: Bits of the number of a range that each round of merging drops.
ROUND_BITS, ROUNDS = 4, 2
#: Children of a node that may meet in a task.
CROWD = 10_000
#: Turns of a conversation that are joined together.
BLOCK = 4096
#: Conversations of an end list in a row.
PIECE = 512
#: Rows of a table that is broadcast; beyond, it is joined.
BROADCAST_ROWS = 200_000

_NODE = ["k1", "k2", "depth"]


def _dealt(df: DataFrame, key: str, *order: Column) -> tuple[DataFrame, DataFrame]:
    """(df sorted into ranges of key and order, with the range's number `pid`; the keys that may lie in several ranges)."""
    dealt = stored(df.repartitionByRange(F.col(key), *order).withColumn("pid", F.spark_partition_id()))
    # ranges are disjoint but for their first and last keys, so these are two for each range at most
    edges = dealt.groupBy("pid").agg(F.array(F.min(key), F.max(key)).alias("edges"))
    return dealt, F.broadcast(edges.select(F.explode("edges").alias(key)).distinct())


def _running(dealt: DataFrame, edges: DataFrame, key: str, order: list[Column], sums: dict[str, tuple[Callable, Column]], last: str | None = None) -> DataFrame:
    """dealt with running values of each key's rows, inclusive: new name -> (F.sum or F.bit_xor, what).

    Each range is worked apart, and what the ranges before it hold of the same key is added. last: the name of a column
    that says whether a row is its key's last.
    """
    inside = W.partitionBy("pid", key).orderBy(*order)
    here = inside.rowsBetween(W.unboundedPreceding, 0)
    totals = dealt.join(edges, key).groupBy(key, "pid").agg(*(f(x).alias(f"{n}_before") for n, (f, x) in sums.items()))
    ranges = W.partitionBy(key).orderBy("pid")
    before = ranges.rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(key, "pid", *(f(f"{n}_before").over(before).alias(f"{n}_before") for n, (f, _) in sums.items()), F.lead("pid").over(ranges).isNotNull().alias("_more"))
    out = dealt.withColumns({n: f(x).over(here) for n, (f, x) in sums.items()} | ({last: F.lead("pid").over(inside).isNull()} if last else {}))
    out = out.join(F.broadcast(totals), [key, "pid"], "left")  # a row for each edge and range
    added = {n: F.col(n) + F.coalesce(f"{n}_before", F.lit(0)) if f is F.sum else F.col(n).bitwiseXOR(F.coalesce(f"{n}_before", F.lit(0))) for n, (f, _) in sums.items()}
    if last:
        added[last] = F.col(last) & ~F.coalesce("_more", F.lit(False))
    return out.withColumns(added).drop("_more", *(f"{n}_before" for n in sums))


def turn_digests(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, digest, words) of each row: what the trie needs of a turn. Rows without a conversation are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    # the role's length keeps role and text apart
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), n_words(text).alias("words"))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, rank, digest, words): turns by number from 1, null turns first; turns of one number by digest."""
    # equal rows are told apart, as a conversation of equal rows must still be cut into ranges
    turns = turns.withColumn("_tie", F.monotonically_increasing_id())
    order = [F.col("turn").asc_nulls_first(), F.col("digest").asc(), F.col("_tie").asc()]
    dealt, edges = _dealt(turns, "conv_id", *order)
    return _running(dealt, edges, "conv_id", order, {"rank": (F.sum, F.lit(1))}).select("conv_id", "rank", "digest", "words")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Numbered turns in which each conversation c begins with the first h turns of conversation c - c % every, then goes on with its own.

    h is the CRC-32 of the decimal c modulo most. Ranks rise along the new conversations, with gaps.
    """
    c = F.col("conv_id")
    heads_of = F.crc32(c.cast("string").cast("binary")) % most
    lent = (c % every != 0) & (heads_of > 0)
    own = turns.where(~lent | (F.col("rank") > heads_of)).withColumn("rank", F.col("rank") + most)
    borrowers = turns.select("conv_id").distinct().where(lent).select("conv_id", heads_of.alias("h"), (c - c % every).alias("base"))
    heads = turns.where((c % every == 0) & (F.col("rank") < most)).withColumnRenamed("conv_id", "base")
    borrowed = borrowers.join(heads, "base").where("rank <= h")  # `every` borrowers of a conversation at most
    return own.unionByName(borrowed.select(*own.columns))


def _paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation and depth, from 0: conv_id, pid, the node's key, its parent's, words of its last turn, and whether the conversation ends there."""
    roots = convs.select("conv_id", F.lit(-1).cast("long").alias("rank"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("words"))
    rows = turns.select("conv_id", F.col("rank").cast("long").alias("rank"), "digest", "words").unionByName(roots)
    dealt, edges = _dealt(rows, "conv_id", F.col("rank"))
    placed = _running(dealt, edges, "conv_id", [F.col("rank")], {"depth": (F.sum, F.lit(1).cast("long"))}, last="ends").withColumn("depth", F.col("depth") - 1)
    own = {f"t{i}": F.when(F.col("digest").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(i), "depth", "digest")) for i in (1, 2)}
    placed = placed.withColumns(own)
    keyed = _running(placed, edges, "conv_id", [F.col("rank")], {"k1": (F.bit_xor, F.col("t1")), "k2": (F.bit_xor, F.col("t2"))})
    parent = {f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"t{i}")) for i in (1, 2)}
    return stored(keyed.withColumns(parent).select("conv_id", "pid", *_NODE, "p1", "p2", "words", "ends"))


def _merged(tables: DataFrame, sums: list[str], least: list[str], same: list[str]) -> DataFrame:
    """Partial node tables, told apart by pid, merged by node in rounds of neighbouring ranges."""
    merge = [*(F.sum(c).alias(c) for c in sums), *(F.min(c).alias(c) for c in least), *(F.first(c).alias(c) for c in same)]
    for _ in range(ROUNDS):
        tables = tables.groupBy(*_NODE, F.shiftright("pid", ROUND_BITS).alias("pid")).agg(*merge)
    return tables.groupBy(*_NODE).agg(*merge)


def _digests(lists: DataFrame) -> DataFrame:
    """(node, ends_sha256) of end lists (node, pid, ends): the decimal ids in order, comma-joined. Pieces of a list are hashed one after the other."""
    pieces = lists.select(*_NODE, "pid", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("ends") - 1) / PIECE).cast("int")), lambda i: F.array_join(F.slice("ends", i * PIECE + 1, PIECE), ","))).alias("piece", "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, hashlib.sha256()
        for b in batches:
            done: list[tuple] = []
            for *key, ids in zip(*(b.column(i).to_pylist() for i in range(4))):
                if key == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((*node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(ids.encode())
            if done:
                yield _batch(done)
        if node is not None:
            yield _batch([(*node, sha.hexdigest())])

    def _batch(done: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=[*_NODE, "ends_sha256"])

    ordered = pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "pid", "piece").select(*_NODE, "ids")
    return map_batches(ordered, run, "k1 long, k2 long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns are numbered turns (conv_id, rank, digest, words); convs (conv_id) names conversations that exist, with or
    without turns, those of turns by default. conv_id is the node's least member; parent_conv_id its parent's, null for
    the root. n_leaves and saved_tokens (members but one, times the words of the node's last turn) are summed over the
    subtree. ends_sha256 is the digest of the decimal ids, in order, of the conversations that end at the node. Without
    conversations there are no rows.
    """
    convs = turns.select("conv_id").distinct() if convs is None else convs.select("conv_id").distinct()
    paths = _paths(turns, convs)
    # a range's list is as long as the range at most
    partial = stored(
        paths.groupBy(*_NODE, "pid").agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("words").alias("words"), F.first("p1").alias("p1"), F.first("p2").alias("p2"),
            F.array_sort(F.collect_list(F.when(F.col("ends"), F.col("conv_id")))).alias("ends"),
        )
    )
    tries = _merged(partial.drop("ends"), ["n_convs"], ["conv_id"], ["words", "p1", "p2"])
    children = tries.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = stored(tries.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    # along each chain, from its end up
    chain, edges = _dealt(nodes.withColumn("_up", -F.col("depth")), "conv_id", F.col("_up"))
    leaf, saved = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    summed = _running(chain, edges, "conv_id", [F.col("_up")], {"n_leaves": (F.sum, leaf), "saved_tokens": (F.sum, saved)}, last="top")
    summed = stored(summed.select(*_NODE, "conv_id", "p1", "p2", "n_convs", "n_children", "n_leaves", "saved_tokens", "top"))

    # what a chain holds belongs to each node above its top
    tops = summed.where("top and depth > 0").select("conv_id", F.col("depth").alias("top_depth"), "n_leaves", "saved_tokens")
    block = lambda depth: F.floor(depth / BLOCK).cast("long")
    tops = tops.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), block(F.col("top_depth") - 1))))
    above = paths.select(*_NODE, "conv_id", "pid", block(F.col("depth")).alias("block")).join(tops, ["conv_id", "block"]).where("depth < top_depth")
    above = above.groupBy(*_NODE, "pid").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    below = _merged(above, ["n_leaves", "saved_tokens"], [], [])

    digests = _digests(partial.where(F.size("ends") > 0).select(*_NODE, "pid", "ends"))
    none = hashlib.sha256(b"").hexdigest()
    whole = summed.join(below.select(*_NODE, F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved")), _NODE, "left").join(digests, _NODE, "left")
    whole = whole.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.lit(none))})
    whole = stored(whole.drop("more_leaves", "more_saved"))

    # within a chain the parent has the same least member; of a top it is looked up, apart for those with very many children
    out = lambda df, parent: df.select("conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    parents = whole.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"), F.col("n_children").alias("siblings"))
    tops, crowds = whole.where("top and depth > 0"), parents.where(F.col("siblings") > CROWD)
    crowds = F.broadcast(crowds) if crowds.count() <= BROADCAST_ROWS else crowds  # no more than nodes / CROWD
    key = ["p1", "p2", "depth"]
    crowded = tops.join(crowds, key)
    rest = tops.join(crowds.select(*key), key, "left_anti").join(parents.where(F.col("siblings") <= CROWD), key)
    inside = whole.where("not top or depth = 0")
    found = out(inside, F.when(F.col("depth") > 0, F.col("conv_id")))
    return found.unionByName(out(crowded, F.col("parent"))).unionByName(out(rest, F.col("parent")))


def conversation_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """prefix_trie of conversations as they are: rows with conversation, turn, role and text.

    Null roles and texts are empty, null turns come first, turns of one number follow by digest, and rows that repeat
    are turns of their own. Rows without a conversation are left out. Other columns are ignored, whatever their names.
    """
    return prefix_trie(stored(numbered(turn_digests(rows, conv, turn, role, text))))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(numbered(turn_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    return prefix_trie(rebuilt(turns), turns.select("conv_id"))


def _crc_sql(value: str) -> str:
    """The CRC-32 of a short ASCII text, in SQL: bit by bit over its bytes."""
    step = "(CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: " + step + ")"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({value}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {bits}), 4294967295::BIGINT)"


OP13_SQL = f"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS rank, d, w
    FROM (SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS w FROM conversations WHERE conv_id IS NOT NULL)
),
convs AS (SELECT conv_id, {_crc_sql('conv_id::VARCHAR')} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM turns)),
built AS (
    SELECT c.conv_id, t.rank, d, w FROM convs c JOIN turns t ON t.conv_id = c.base AND t.rank <= c.h
    UNION ALL
    SELECT c.conv_id, t.rank + 4, d, w FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.rank > c.h
),
paths AS (
    SELECT conv_id, row_number() OVER s AS depth, string_agg(d, '') OVER s AS k, w FROM built WINDOW s AS (PARTITION BY conv_id ORDER BY rank)
    UNION ALL
    SELECT conv_id, 0, '', 0 FROM convs
),
ends AS (SELECT conv_id, arg_max(k, depth) AS k FROM paths GROUP BY conv_id),
ended AS (SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS e FROM ends GROUP BY k),
nodes AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w FROM paths GROUP BY k, depth),
children AS (SELECT left(k, length(k) - 32) AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT x.k, x.depth, x.conv_id, x.n, coalesce(c.n, 0) AS n_children, (x.n - 1) * w AS saved FROM nodes x LEFT JOIN children c ON c.k = x.k),
sums AS (
    SELECT p.k, sum((o.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(o.saved)::BIGINT AS saved
    FROM own o JOIN paths p ON p.conv_id = o.conv_id AND p.depth <= o.depth GROUP BY p.k
)
SELECT o.conv_id, o.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n AS n_convs, o.n_children::BIGINT AS n_children, s.n_leaves, s.saved AS saved_tokens,
    coalesce(e.e, '{hashlib.sha256(b"").hexdigest()}') AS ends_sha256
FROM own o JOIN sums s ON s.k = o.k LEFT JOIN ended e ON e.k = o.k LEFT JOIN own p ON o.depth > 0 AND p.k = left(o.k, length(o.k) - 32)
"""
