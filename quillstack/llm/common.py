"""Shared pieces of the training-text operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in the sense of the contracts: a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"

_own_dir: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, one of our own if Spark runs on this machine alone; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="quillstack-"))
    return _own_dir[0]


_tracked: list[list[str]] = []


@contextmanager
def tracked(folders: list[str]) -> Iterator[None]:
    """The folders of tables that are stored meanwhile are put into a list, for `discard`."""
    _tracked.append(folders)
    try:
        yield
    finally:
        _tracked.pop()


def discard(spark: SparkSession, folders: list[str], but_for: DataFrame) -> None:
    """Deletes those of the folders that a table doesn't read from, and takes them off the list."""
    read = but_for.inputFiles()
    for folder in list(folders):
        name = folder.rsplit("/", 1)[1]
        if not any(f"/{name}/" in f for f in read):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            folders.remove(folder)


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: the lineage ends there, and every executor sees it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillstack/{uuid.uuid4().hex}"
    for folders in _tracked:
        folders.append(path)
    df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text, null for none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.size(words(text)).cast("long")


def kept(df: DataFrame, keep: tuple[str, ...], new: list[str]) -> list[str]:
    """Names to carry along: those of keep that df has. A result column of the same name takes its place."""
    return [c for c in keep if c in df.columns and c not in new]


_shipped: set[str] = set()


def map_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow, with this package sent to the executors first, so that they need not have it installed."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        path = f"{tempfile.mkdtemp(prefix='quillstack-')}/quillstack_py.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in [package / "__init__.py", *sorted((package / "llm").glob("*.py"))]:
                z.write(p, p.relative_to(package.parent))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return df.mapInArrow(function, schema)
