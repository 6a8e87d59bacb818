"""Files into the archive: looks at a folder, files whose size settled, contents seen for the first time, tables that change together.

Three steps, each a stream with a checkpoint of its own. What they remember (sizes by path, the first path of a content)
is keyed state in RocksDB, so a batch costs what the batch holds, whatever is stored already. State, timers and the
row-based operator are those of Spark 4.1; USE_ROCKSDB says what the session needs.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType

from quillstack.functions.rules import is_receipt
from quillstack.functions.scalars import text_too_short
from quillstack.sources.replies import ask, classifications, receipts
from quillstack.sources.versions import Store
from quillstack.streaming.inbox import SUFFIX_LIST

USE_ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
LOOK = "path string, length long"
DOCUMENT = "id long, path string, content_hash string, file_size long, extracted_text string, category string, subcategory string, status string"
RECEIPT = "id long, doc_id long, shop_name string, shop_type string, payment_method string, total_amount decimal(18,2), currency string, receipt_date string"
ITEM = "id long, receipt_id long, line_no int, name string, quantity double, unit_price double, total_price double, item_category string"
#: What is kept of a text.
MOST_TEXT = 200_000


def _opened(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class InboxLooks(DataSource):
    """A stream of looks at a folder: with each batch, path and size of every file that lies in it. Option `path`: the folder; `pause`: seconds between looks."""

    @classmethod
    def name(cls) -> str:
        return "inbox_looks"

    def schema(self) -> str:
        return LOOK

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Looks(self.options["path"], float(self.options.get("pause", 1)))


class _Looks(SimpleDataSourceStreamReader):
    def __init__(self, folder: str, pause: float):
        self.folder, self.pause, self.last = folder, pause, 0.0

    def initialOffset(self) -> dict:
        return {"look": 0}

    def _listed(self) -> Iterator[tuple]:
        from pyarrow import fs

        system, folder = _opened(self.folder)
        for f in system.get_file_info(fs.FileSelector(folder)):
            if f.type == fs.FileType.File and f.extension.lower() in SUFFIX_LIST:
                yield f.path if "://" not in self.folder else f"{self.folder.rstrip('/')}/{f.base_name}", f.size

    def read(self, start: dict):
        if time.monotonic() - self.last < self.pause:
            return iter(()), start
        self.last = time.monotonic()
        return iter(list(self._listed())), {"look": start["look"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(list(self._listed()))  # a batch that is run again looks again


def looks(spark: SparkSession, folder: str, pause: float = 1.0) -> DataFrame:
    spark.dataSource.register(InboxLooks)
    return spark.readStream.format("inbox_looks").option("path", folder).option("pause", pause).load()


class _Settles(StatefulProcessor):
    """Of one path: the size at the last look, how many looks have found it, and whether the file has passed."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("size", "length long, looks int, passed boolean")

    def _again(self, timers) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            held = self.state.get() if self.state.exists() else None
            if held is not None and held[2]:
                continue
            if held is None or held[0] != row.length:
                self.state.update((row.length, 1, False))
                self._again(timerValues)
            else:
                self.state.update((row.length, held[1] + 1, False))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        length, found, passed = self.state.get()
        if passed:
            return
        if found < 2:  # nobody has looked since
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
            return
        self.state.update((length, found, True))
        yield Row(path=key[0], length=length)

    def close(self) -> None:
        pass


def settled(seen: DataFrame, wait: float = 5.0) -> DataFrame:
    """path, length of each file once, when for `wait` seconds every look, two at least, found the same size. seen: a stream of looks."""
    return seen.groupBy("path").transformWithState(statefulProcessor=_Settles(int(wait * 1000)), outputStructType=LOOK, outputMode="Append", timeMode="ProcessingTime")


class _FirstOfContent(StatefulProcessor):
    """Of one content: the path that had it first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("first", "path string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: r.path):
            first = self.state.get()[0] if self.state.exists() else None
            if first is None:
                self.state.update((row.path,))
            if first != row.path:
                yield Row(path=row.path, length=row.length, content_hash=key[0], original=first)

    def close(self) -> None:
        pass


@F.pandas_udf(StringType())
def content_hash(paths: pd.Series) -> pd.Series:
    """SHA-256 of files, read by the executors a piece at a time; null for a file that is gone."""

    def one(path: str) -> str | None:
        system, at = _opened(path)
        digest = hashlib.sha256()
        try:
            with system.open_input_stream(at) as f:
                while piece := f.read(1 << 20):
                    digest.update(piece)
        except FileNotFoundError:
            return None
        return digest.hexdigest()

    return paths.map(one)


@F.pandas_udf(StringType())
def file_text(paths: pd.Series) -> pd.Series:
    """The text of files that are UTF-8, else an empty one. Pictures are recognised before."""

    def one(path: str) -> str:
        system, at = _opened(path)
        with system.open_input_stream(at) as f:
            raw = f.read()
        try:
            return raw.decode("utf-8")[:MOST_TEXT]
        except UnicodeDecodeError:
            return ""

    return paths.map(one)


def by_content(files: DataFrame) -> DataFrame:
    """path, length, content_hash, original of a stream of files (path, length): original is the first path with that content, null if it is this one."""
    hashed = files.withColumn("content_hash", content_hash("path")).where("content_hash IS NOT NULL")
    schema = "path string, length long, content_hash string, original string"
    return hashed.groupBy("content_hash").transformWithState(statefulProcessor=_FirstOfContent(), outputStructType=schema, outputMode="Append", timeMode="None")


def _id(path: str) -> Column:
    return F.xxhash64(F.col(path))


def take_in(store: Store, batch: DataFrame, number: int, tree: dict[str, list[str]], provider: Callable[[str], str], receipt_provider: Callable[[str], str], receipt_category: str = "Kassenzettel", shops: tuple[str, ...] = ()) -> bool:
    """A batch (path, length, content_hash, original) into the tables documents, receipts and receipt_items, which change together; whether it did.

    A batch that is in the tables already is left alone, so one that is delivered again changes nothing. Documents that a
    model files under receipt_category, or whose text looks like a receipt, are read a second time for the receipt.
    Copies take the metadata of the document that they repeat.
    """
    part, version = f"batch-{number}", store.current()
    if part in version.parts.get("documents", {}):
        return False
    spark = store.spark
    new = batch.where("original IS NULL").withColumn("extracted_text", file_text("path"))
    columns = [c.split()[0] for c in DOCUMENT.split(", ")]
    base = [_id("path").alias("id"), "path", "content_hash", F.col("length").alias("file_size"), "extracted_text"]
    readable = new.where(~text_too_short(F.col("extracted_text"), 1)).withColumn("prompt", F.col("extracted_text"))
    done = classifications(ask(readable, provider), tree).withColumn("status", F.col("route"))
    done = done.withColumn("category", F.when(is_receipt(F.col("extracted_text"), shops), receipt_category).otherwise(F.col("category")))
    failed = new.where(text_too_short(F.col("extracted_text"), 1)).withColumns({"category": F.lit(""), "subcategory": F.lit(""), "status": F.lit("failed")})
    folder = store.write("documents", done.select(*base, "category", "subcategory", "status").unionByName(failed.select(*base, "category", "subcategory", "status")).select(*columns), ("id",))
    fresh = spark.read.schema(DOCUMENT).parquet(f"{store.root}/{folder}")

    # as many originals as the batch has files, at most; files without them are told by their Bloom filters
    copies = batch.where("original IS NOT NULL")
    wanted = [r[0] for r in copies.select(_id("original")).distinct().collect()]
    known = store.read(version, "documents", DOCUMENT).where(F.col("id").isin(wanted)).unionByName(fresh.where(F.col("id").isin(wanted)))
    original = known.select(F.col("id").alias("of"), "category", "subcategory")
    same = copies.withColumn("of", _id("original")).join(original, "of", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("category", "subcategory")})
    same = same.withColumns({"status": F.lit("duplicate"), "extracted_text": F.lit("")}).select(*base, "category", "subcategory", "status").select(*columns)
    copied = store.write("documents", same, ("id",))

    read = receipts(ask(fresh.where((F.col("category") == receipt_category) & (F.col("status") != "failed")).withColumn("prompt", F.col("extracted_text")), receipt_provider)).where("parsed")
    rows = store.write("receipts", read.select("id", F.col("id").alias("doc_id"), "shop_name", "shop_type", "payment_method", "total_amount", "currency", "receipt_date", "items"), ("doc_id",))
    of = spark.read.schema(f"{RECEIPT}, items {dict(read.dtypes)['items']}").parquet(f"{store.root}/{rows}")
    items = of.select(F.col("id").alias("receipt_id"), F.posexplode("items").alias("line_no", "i")).select(F.xxhash64("receipt_id", "line_no").alias("id"), "receipt_id", "line_no", "i.*")
    lines = store.write("receipt_items", items, ("receipt_id",))
    store.commit(version, {"documents": {part: folder, f"{part}-copies": copied}, "receipts": {part: rows}, "receipt_items": {part: lines}})
    return True


def tables(store: Store) -> dict[str, DataFrame]:
    """documents, receipts and receipt_items as of the newest version."""
    version = store.current()
    return {t: store.read(version, t, ddl) for t, ddl in (("documents", DOCUMENT), ("receipts", RECEIPT), ("receipt_items", ITEM))}


def run_settling(spark: SparkSession, folder: str, settled_files: str, checkpoint: str, wait: float = 5.0, pause: float = 1.0, seen: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Looks at a folder into a Parquet table of the files that have settled. seen: looks from elsewhere."""
    files = settled(looks(spark, folder, pause) if seen is None else seen, wait)
    return files.writeStream.format("parquet").option("path", settled_files).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def run_intake(spark: SparkSession, settled_files: str, root: str, checkpoint: str, tree: dict[str, list[str]], provider: Callable[[str], str], receipt_provider: Callable[[str], str], per_batch: int = 100, **trigger) -> StreamingQuery:
    """Settled files into the archive's tables under root."""
    store = Store(spark, root)
    files = spark.readStream.schema(LOOK).option("maxFilesPerTrigger", per_batch).parquet(settled_files)

    def into(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        take_in(store, batch, number, tree, provider, receipt_provider)
        batch.unpersist()

    return by_content(files).writeStream.foreachBatch(into).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
