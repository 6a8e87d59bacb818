"""Tables in plain Parquet folders that change part by part, and one pointer that says what holds.

A table is a set of named parts, each a folder. A change writes new folders beside the old ones and then a new list of
parts, whose name is the next number. That name is given by a rename that fails if it is taken: so a change is seen whole
or not at all, a writer that was overtaken learns of it, and a reader keeps the version that it opened. What a writer
that died has written is in no list.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.plans.archive import SCHEMAS, Archive


class Overtaken(RuntimeError):
    """Another change was made since the version that this one started from."""


@dataclass(frozen=True)
class Version:
    number: int = -1
    parts: dict[str, dict[str, str]] = field(default_factory=dict)
    notes: dict[str, object] = field(default_factory=dict)


class Store:
    """Versions of tables under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._kept = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _file(self, name: str):
        return self._path(f"{self.root}/{name}")

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._file("versions")):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(self._file("versions")))

    def at(self, number: int) -> Version:
        text = self.spark.read.text(f"{self.root}/versions/{number:010d}.json", wholetext=True).first()[0]
        return Version(number, **json.loads(text))

    def current(self) -> Version:
        numbers = self.numbers()
        return self.at(numbers[-1]) if numbers else Version()

    def commit(self, before: Version, changes: dict[str, dict[str, str | None]], notes: dict[str, object] | None = None) -> Version:
        """The version after `before` with these parts changed (None: gone). An error if there is one already."""
        parts = {t: dict(p) for t, p in before.parts.items()}
        for table, changed in changes.items():
            parts.setdefault(table, {}).update({k: f for k, f in changed.items() if f is not None})
            for k in (k for k, f in changed.items() if f is None):
                parts[table].pop(k, None)
        after = Version(before.number + 1, parts, {**before.notes, **(notes or {})})
        draft, name = self._file(f"drafts/{uuid.uuid4().hex}"), self._file(f"versions/{after.number:010d}.json")
        self._fs.mkdirs(self._file("versions"))
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps({"parts": after.parts, "notes": after.notes}).encode()))
        out.close()
        try:
            self._context.rename(draft, name, self._kept)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if self._fs.exists(name):
                raise Overtaken(f"version {after.number} is there already") from e
            raise
        return after

    def write(self, table: str, rows: DataFrame, blooms: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> str:
        """rows in a new folder of the table, whose name is returned; part of nothing until it is committed."""
        folder = f"data/{table}/{uuid.uuid4().hex}"
        options = {"compression": "zstd"} | {f"parquet.bloom.filter.enabled#{c}": "true" for c in blooms}  # hashes in hex shrink to half
        rows.write.options(**options).parquet(f"{self.root}/{folder}", partitionBy=list(by) or None)
        return folder

    def folders_in(self, folder: str) -> list[str]:
        """Names of the folders in one that was written."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._file(folder)) if s.isDirectory())

    def read(self, version: Version, table: str, ddl: str, parts: list[str] | None = None) -> DataFrame:
        """A table as of a version, whole or some of its parts."""
        held = version.parts.get(table, {})
        folders = [f"{self.root}/{held[p]}" for p in (sorted(held) if parts is None else parts) if p in held]
        return self.spark.read.schema(ddl).parquet(*folders) if folders else self.spark.createDataFrame([], ddl)

    def prune(self, keep: int = 1) -> int:
        """Versions but the newest `keep` are forgotten, and folders that none of those has are deleted; how many. Not for when writers are at work."""
        numbers = self.numbers()
        held = {f for n in numbers[-keep:] for parts in self.at(n).parts.values() for f in parts.values()}
        for n in numbers[:-keep]:
            self._fs.delete(self._file(f"versions/{n:010d}.json"), False)
        gone = 0
        for table in self.folders_in("data") if self._fs.exists(self._file("data")) else ():
            for one in self.folders_in(f"data/{table}"):
                folder = f"data/{table}/{one}"
                if not any(f == folder or f.startswith(f"{folder}/") for f in held):
                    self._fs.delete(self._file(folder), True)
                    gone += 1
                    continue
                for inner in (i for i in self.folders_in(folder) if "=" in i):
                    if not any(f == folder or f == f"{folder}/{inner}" or f.startswith(f"{folder}/{inner}/") for f in held):
                        self._fs.delete(self._file(f"{folder}/{inner}"), True)
                        gone += 1
        return gone


# --- the archive's tables, in buckets of their keys

#: What a table's rows are dealt into buckets by, and what its files have Bloom filters for.
KEYS = {"documents": "id", "receipts": "doc_id", "receipt_items": "receipt_id", "accounts": "id", "statements": "id", "transactions": "id", "overrides": "tx_hash"}
BLOOMS = {"documents": ("id", "content_hash"), "statements": ("id", "file_hash"), "transactions": ("id", "tx_hash"), "overrides": ("tx_hash",)}


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _write_buckets(store: Store, table: str, rows: DataFrame, buckets: int) -> dict[str, str]:
    """bucket -> folder of what was written. A file's rows are sorted by key, so that its statistics and Bloom filters tell what it lacks.

    Each task writes its rows to all buckets: they aren't shuffled for it, and a large bucket isn't one task's to sort.
    """
    key = KEYS[table]
    dealt = rows.withColumn("in_bucket", _bucket(key, buckets)).sortWithinPartitions("in_bucket", key)
    folder = store.write(table, dealt, tuple(c for c in BLOOMS.get(table, ()) if c in rows.columns), ("in_bucket",))
    return {name.split("=")[1]: f"{folder}/{name}" for name in store.folders_in(folder)}


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def create_archive(store: Store, a: Archive, buckets: int = 16) -> Version:
    """The first version of an archive's tables. A bucket is what a change rewrites: some 100 MB is a good size."""
    tables = {t: getattr(a, t) for t in SCHEMAS}
    changes = {t: _write_buckets(store, t, rows, buckets) for t, rows in tables.items()}
    return store.commit(store.current(), changes, {"buckets": buckets, "columns": {t: _ddl(rows) for t, rows in tables.items()}})


def stored_archive(store: Store, version: Version | None = None, only: dict[str, list[str]] | None = None) -> Archive:
    """The tables as of a version, the newest by default; of the tables in `only` just those buckets."""
    version = version or store.current()
    columns = version.notes["columns"]
    return Archive(**{t: store.read(version, t, columns[t], (only or {}).get(t)) for t in SCHEMAS})


def change(store: Store, touched, op, version: Version | None = None) -> Version:
    """A new version in which `op` was applied to the buckets that hold the touched rows.

    touched: of an archive, the table names with the keys (in the table's key column) of rows that change, come or go.
    op: an archive to an archive; of the touched tables it sees the buckets concerned, of the others all. It is an error
    if another change came between.
    """
    version = version or store.current()
    buckets = int(version.notes["buckets"])
    keys = touched(stored_archive(store, version))
    # no more numbers than there are buckets
    only = {t: sorted(str(r[0]) for r in rows.select(_bucket(KEYS[t], buckets)).distinct().collect()) for t, rows in keys.items()}
    part = stored_archive(store, version, only)
    after = op(part)
    changes = {}
    for t, concerned in only.items():
        if concerned:
            written = _write_buckets(store, t, getattr(after, t).select(*getattr(part, t).columns), buckets)
            changes[t] = {**dict.fromkeys(concerned, None), **written}
    return store.commit(version, changes)


def lookup(store: Store, table: str, column: str, value, version: Version | None = None) -> DataFrame:
    """The rows of a table with a value in a column: of the key only its bucket is opened, of others the row groups that Bloom filters let through."""
    version = version or store.current()
    columns, parts = version.notes["columns"][table], None
    if column == KEYS[table]:
        kind = store.read(version, table, columns, []).schema[column].dataType
        one = store.spark.range(1).select(F.lit(value).cast(kind).alias(column))
        parts = [str(one.select(_bucket(column, int(version.notes["buckets"]))).first()[0])]
    return store.read(version, table, columns, parts).where(F.col(column) == value)
