"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target, in words, and a schedule of its weight over training time 0 to 1. The integral of the schedule
is the source's cumulative demand; inverting it gives the time at which a given word of the source is due. Documents of
a source queue in the order of a hash of their key; the words before a document in the queue, over as many passes as the
target needs, give its positions. A range sort by position gives the training order.

Everything is built-in Spark expressions. No window holds a source: sums run inside blocks of a source, whose number
follows the source's rows, and over the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.llm.common import documents, n_words, stored

#: Weights of the sources in order of their names, repeating; passes over a source at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: How much a source's weight falls (first of three), stays or rises over training, repeating in the order of names.
SLOPES = (-0.5, 0.0, 0.5)
ROWS_PER_BLOCK = 1024
#: Sources whose table is broadcast: some tens of bytes each. Beyond, it is joined like any table.
BROADCAST_ROWS = 100_000


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with `rank` from 0 in the order of their names' code points, null last, without one task for all."""
    order = F.col("source").asc_nulls_last()
    parts = stored(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("inside", inside).join(sizes, "part").withColumn("rank", F.col("before") + F.col("inside")).drop("part", "before", "inside")


def _cycle(rank: Column, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size, …) with `rank` and `target`: shares by weight of all sizes, none above most times its size.

    What is above is shared again by weight among the others until none is above. Each round is one aggregate, of which
    the driver keeps three numbers.
    """
    ranked = stored(_ranked(sources).withColumn("weight", _cycle(F.col("rank"), weights)))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * most
    share, full = None, F.lit(False)
    while True:
        capped, left = ranked.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        left_words, now = total - (capped or 0), None
        if left:
            now = left_words / left
        if now == share or now is None:
            break
        share = now
        full = cap.cast("double") <= F.col("weight").cast("double") * F.lit(share)
    level = F.col("weight").cast("double") * F.lit(share if share is not None else 0.0)
    return ranked.withColumn("target", F.when(full, cap.cast("double")).otherwise(level))


def due(position: Column, slope: Column) -> Column:
    """The time t in 0 to 1 at which a share `position` of a source's words is due.

    The schedule is 1 + slope (2t - 1), whose integral is t + slope (t² - t); this solves it for t.
    """
    b = 1 - slope
    return F.when(slope == 0, position).otherwise((F.sqrt(b * b + 4 * slope * position) - b) / (2 * slope))


def _places(narrow: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Of rows (source, doc_id, size): the distinct ones with their number n, the source's figures and the words before them."""
    rows = stored(narrow.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")))
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("source_rows"))
    sources = stored(targets(sources, weights, most))
    if sources.count() <= BROADCAST_ROWS:
        sources = F.broadcast(sources)
    named = sources.withColumnRenamed("source", "_name")
    queued = rows.join(named, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    blocks = F.ceil(F.col("source_rows") / ROWS_PER_BLOCK)
    block = F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * blocks / F.lit(float(1 << 32))).cast("long")
    queued = queued.withColumn("md5", digest).withColumn("block", block)
    words = F.col("size") * F.col("n")
    sums = queued.groupBy("rank", "block").agg(F.sum(words).alias("words"))
    over = W.partitionBy("rank").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("rank", "block", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("first"))
    inside = W.partitionBy("rank", "block").orderBy("md5", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    queued = queued.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(sums, ["rank", "block"])
    return queued.withColumn("before", F.col("first") + F.col("inside"))


def _times(most: int) -> Column:
    """How often the mix takes a document: the whole passes of its source, and one more while half of it still fits the rest."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - passes * F.col("source_size")
    last = (F.col("before") + F.col("size") / 2 < rest) & (F.col("size") > 0)
    return F.least(passes + last.cast("long"), F.lit(most))


def _position(turn: Column) -> Column:
    """When the document is due in a pass over its source, counted from 0."""
    words = F.col("before") + turn * F.col("source_size") + F.col("size") / 2
    share = F.when(F.col("target") > 0, F.least(words / F.col("target"), F.lit(1.0))).otherwise(0.0)
    return due(share, _cycle(F.col("rank"), SLOPES))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each row of docs: key, size, source_size, target, taken, position, positions; in the order of position.

    size: words of the text, none for null. A source's first passes take all of it; the last takes documents, in the
    order of the MD5 of their key (as text; null as empty), then of their key and size, while half of one still fits the
    target. So the words taken of a source differ from its target by half a document at most, and no document is taken
    over `most` times. taken: its words over all passes. positions: the times, 0 to 1, at which each pass that takes it is
    due; position: the first of them, by which the rows are range-sorted, null and last if it isn't taken. Null is a source of its own, last in order. Rows that repeat queue one after another. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    each = _places(narrow, weights, most).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    each = each.withColumn("before", F.col("before") + F.col("copy") * F.col("size")).withColumn("times", _times(most))
    turns = F.sequence(F.lit(0).cast("long"), F.col("times") - 1)
    positions = F.when((F.col("times") > 0) & (F.col("size") > 0), F.transform(turns, _position)).otherwise(F.array().cast("array<double>"))
    each = each.withColumn("positions", positions).withColumn("position", F.get("positions", F.lit(0)))
    each = each.orderBy(F.col("position").asc_nulls_last(), "md5", "copy")  # the digest also spreads what isn't taken
    return each.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"), "position", "positions")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The training order: the rows of docs as often as the mix takes them, sorted by the time at which each turn is due.

    Columns are left as they are, whatever their names. Rows equal in key, source and size are taken alike.
    """
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    places = _places(keyed.drop("row"), weights, most).withColumn("times", _times(most)).where("times > 0")
    places = places.select(F.col("doc_id").alias("_id"), F.col("source").alias("_name"), F.col("size").alias("_size"), "md5", "source_size", "target", "rank", "before", "times")
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_name")) & (F.col("size") == F.col("_size"))
    turns = keyed.join(places, on).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return turns.withColumn("position", _position(F.col("turn"))).orderBy("position", "md5").select("row.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of documents, with the position of each of the passes in a column of its own."""
    turns = [F.get("positions", F.lit(i)).alias(f"position_{i + 1}") for i in range(1, MOST)]
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "position", *turns)


def _position_sql(turn: int) -> str:
    words = f"least((queued + {turn} * source_size + size::DOUBLE / 2) / target, 1::DOUBLE)"
    inverse = f"CASE WHEN slope = 0 THEN {words} ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * {words}) - (1 - slope)) / (2 * slope) END"
    return f"CASE WHEN times > {turn} AND size > 0 THEN {inverse} END AS position{f'_{turn + 1}' if turn else ''}"


# the level is that of the first source, by the words that its weight has to bear, which it leaves below its limit
OP10_SQL = f"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, list_extract({list(WEIGHTS)}, rank % {len(WEIGHTS)} + 1) AS weight, list_extract({list(SLOPES)}, rank % {len(SLOPES)} + 1)::DOUBLE AS slope, {MOST} * source_size AS most FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights, coalesce(sum(most) OVER b, 0) AS most_before, coalesce(sum(weight) OVER b, 0) AS weight_before
    FROM w WINDOW b AS (ORDER BY most::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - most_before)::DOUBLE / (weights - weight_before)::DOUBLE AS share FROM o),
level AS (SELECT arg_min(share, most::DOUBLE / weight) AS share FROM l WHERE most::DOUBLE > weight * share),
t AS (SELECT source, source_size, slope, CASE WHEN most::DOUBLE > weight * coalesce(level.share, 0) THEN weight * level.share ELSE most::DOUBLE END AS target FROM w, level),
q AS (SELECT d.doc_id, size, source_size, slope, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS queued
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM q),
n AS (SELECT *, least(passes + (queued + size::DOUBLE / 2 < target - passes * source_size AND size > 0)::BIGINT, {MOST}) AS times FROM p)
SELECT doc_id, size, source_size, target, (times * size)::BIGINT AS taken, {', '.join(map(_position_sql, range(MOST)))} FROM n
"""
