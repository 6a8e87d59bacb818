"""The inbox as a stream: files are found, hashed, told from known ones, routed and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstack.functions.scalars import text_too_short
from quillstack.sources.replies import classifications

SUFFIX_LIST = ["pdf", "jpg", "jpeg", "png", "tif", "tiff", "bmp", "txt"]
SUFFIXES = "*.{" + ",".join(SUFFIX_LIST) + "}"
FILE = "path string, modificationTime timestamp, length long, content binary"


def existing_files(spark: SparkSession, inbox: str) -> DataFrame:
    """The files that lie in the inbox, in the order of their paths."""
    return spark.read.format("binaryFile").option("pathGlobFilter", SUFFIXES).load(inbox).orderBy("path")


def new_files(spark: SparkSession, inbox: str, per_batch: int = 100) -> DataFrame:
    """The same as a stream, folders inside left out. Producers write elsewhere and move files in when they are whole."""
    return spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", SUFFIXES).option("recursiveFileLookup", "false").option("maxFilesPerTrigger", per_batch).load(inbox)


def hashed(files: DataFrame) -> DataFrame:
    return files.select("path", "modificationTime", "length", "content", F.sha2("content", 256).alias("content_hash"))


def split_known(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, duplicates): the first file of each content that known (content_hash, …) lacks, and all others.

    Within a batch the file of the least path is the first. Hashes are all that is shuffled; contents stay in new alone.
    """
    rows = hashed(files)
    first = rows.groupBy("content_hash").agg(F.min("path").alias("path"))
    fresh = first.join(known.select("content_hash").distinct(), "content_hash", "left_anti")
    new = rows.join(fresh.select("path"), "path", "left_semi")
    return new, rows.drop("content").join(fresh.select("path"), "path", "left_anti")


def ingest_batch(files: DataFrame, known: DataFrame, tree: dict[str, list[str]], provider: Callable[[str], str], min_confidence: float = 0.65) -> DataFrame:
    """Rows for the documents table: filed, review, failed (no text or no usable reply) and duplicate.

    Text is the content decoded as UTF-8; recognition of pictures belongs before. Duplicates take the metadata of the
    document that they repeat, when it is known already.
    """
    from quillstack.sources.replies import ask

    new, repeated = split_known(files, known)
    text = F.substring(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.lit("")), 1, 200_000)
    named = new.select("path", "content_hash", F.col("length").alias("file_size"), text.alias("extracted_text"))
    readable = named.where(~text_too_short(F.col("extracted_text"), 1)).withColumn("prompt", F.col("extracted_text"))
    done = classifications(ask(readable, provider), tree, min_confidence=min_confidence)
    columns = ["path", "content_hash", "file_size", "extracted_text", "category", "subcategory", "status"]
    filed = done.withColumn("status", F.col("route")).select(*columns)
    failed = named.where(text_too_short(F.col("extracted_text"), 1)).select("path", "content_hash", "file_size", "extracted_text", F.lit("").alias("category"), F.lit("").alias("subcategory"), F.lit("failed").alias("status"))
    original = known.groupBy("content_hash").agg(F.min(F.struct(*(c for c in ("path", "category", "subcategory")))).alias("o"))
    same = repeated.join(original, "content_hash", "left").select(
        "path", "content_hash", F.col("length").alias("file_size"), F.lit("").alias("extracted_text"), F.coalesce("o.category", F.lit("")).alias("category"), F.coalesce("o.subcategory", F.lit("")).alias("subcategory"), F.lit("duplicate").alias("status")
    )
    return filed.unionByName(failed).unionByName(same)


def run_inbox(spark: SparkSession, inbox: str, table: str, checkpoint: str, tree: dict[str, list[str]], provider: Callable[[str], str], once: bool = True, per_batch: int = 100) -> StreamingQuery:
    """The inbox into a Parquet table, partitioned by batch, so that a batch that is run again replaces itself."""
    schema = "path string, content_hash string, file_size long, extracted_text string, category string, subcategory string, status string, batch long"
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("batch").parquet(table)

    def append(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        known = spark.read.schema(schema).parquet(table).where(F.col("batch") != number)
        rows = ingest_batch(batch, known, tree, provider)
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")
        batch.unpersist()

    stream = new_files(spark, inbox, per_batch).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="5 seconds")).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Extension, not part of the archive: events by window and kind, with a watermark. Works on a stream and on a table."""
    # watermarks want timestamps with a zone; the session's is put on and taken off again
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    counts = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
