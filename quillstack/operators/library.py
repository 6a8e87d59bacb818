"""The document library: listings, counts, the tree, tags, neighbours and duplicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.functions.scalars import all_of, ascii_lower, blank_to
from quillstack.plans.archive import Archive

CONTAINER = "_csv_container"
DATE = lambda: F.coalesce(F.nullif(F.col("doc_date"), F.lit("")), F.col("created_at"))
#: What a listing can be sorted by.
ORDERS = {
    "doc_date": DATE, "created_at": lambda: F.col("created_at"), "category": lambda: ascii_lower(F.col("category")), "sender": lambda: ascii_lower(F.col("sender")),
    "page_count": lambda: F.col("page_count"), "subject": lambda: ascii_lower(F.col("subject")), "file_size": lambda: F.col("file_size"), "status": lambda: F.col("status"), "confidence": lambda: F.col("confidence"),
}


def library(a: Archive, trash: bool = False) -> DataFrame:
    return a.documents.where(F.col("deleted_at").isNotNull() if trash else F.col("deleted_at").isNull()).where(F.col("category") != CONTAINER)


@dataclass(frozen=True)
class DocumentFilter:
    category: str | None = None
    subcategory: str | None = None
    tag: str | None = None
    status: str | None = None
    year: str | None = None
    doc_from: str | None = None
    doc_to: str | None = None
    scan_from: str | None = None
    scan_to: str | None = None

    def test(self) -> Column:
        tests = [F.col(c) == v for c, v in (("category", self.category), ("subcategory", self.subcategory), ("status", self.status)) if v is not None]
        if self.tag is not None:
            tests.append(F.array_contains("tags", self.tag))
        if self.year == "unknown":
            tests.append(F.col("doc_date").isNull() | (F.col("doc_date") == ""))
        elif self.year is not None:
            tests.append(F.substring("doc_date", 1, 4) == self.year)
        scanned = F.substring("created_at", 1, 10)
        for c, low, high in ((F.col("doc_date"), self.doc_from, self.doc_to), (scanned, self.scan_from, self.scan_to)):
            tests += [c >= low] * (low is not None) + [c <= high] * (high is not None)
        return all_of(tests)


def sort_columns(order_by: str, direction: str) -> list[Column]:
    key = ORDERS.get(order_by, DATE)()
    return [key.asc() if direction == "asc" else key.desc(), F.desc("id")]


def listing(a: Archive, f: DocumentFilter = DocumentFilter(), trash: bool = False, order_by: str = "doc_date", direction: str = "desc", limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of the library. An order that isn't known is the date's; equals come newest id first."""
    return library(a, trash).where(f.test()).orderBy(*sort_columns(order_by, direction)).offset(offset).limit(limit)


def page_after(a: Archive, last: tuple | None, f: DocumentFilter = DocumentFilter(), trash: bool = False, order_by: str = "doc_date", direction: str = "desc", limit: int = 200) -> DataFrame:
    """The page that follows a row, with `page_key`: (page_key, id) of a page's last row is the next one's `last`; None is the first page.

    No rows are passed over: what comes before the key is filtered, so a page far back costs what the first one does.
    Pages join without gap or repeat, equal and null keys included.
    """
    key = ORDERS.get(order_by, DATE)()
    return after(library(a, trash).where(f.test()).withColumn("page_key", key), last, direction, limit)


def after(rows: DataFrame, last: tuple | None, direction: str, limit: int) -> DataFrame:
    """The first rows behind (page_key, id), by page_key in a direction and newest id first; nulls are least."""
    key = F.col("page_key")
    if last is not None:
        value, number = F.lit(last[0]), F.col("id") < last[1]
        if last[0] is None:
            rows = rows.where(key.isNull() & number if direction != "asc" else (key.isNull() & number) | key.isNotNull())
        elif direction != "asc":
            rows = rows.where((key < value) | ((key == value) & number) | key.isNull())
        else:
            rows = rows.where((key > value) | ((key == value) & number))
    return rows.orderBy(key.asc() if direction == "asc" else key.desc(), F.desc("id")).limit(limit)


def siblings(a: Archive, doc_id: int, f: DocumentFilter = DocumentFilter(), order_by: str = "doc_date", direction: str = "desc", limit: int = 5000) -> DataFrame:
    """position, total, prev_id (the older), next_id (the newer) of a document in the first rows of a listing."""
    return _among(listing(a, f, order_by=order_by, direction=direction, limit=limit), doc_id, order_by, direction)


def _among(rows: DataFrame, doc_id: int, order_by: str, direction: str) -> DataFrame:
    """A document's place and neighbours among rows, which are few."""
    kept = [c for c in ("category", "sender", "subject", "file_size", "status", "created_at", "doc_date", "page_count", "confidence") if c in rows.columns]
    w = W.orderBy(*sort_columns(order_by, direction))
    placed = rows.select("id", *kept).select("id", F.row_number().over(w).alias("position"), F.count("*").over(W.partitionBy()).alias("total"), F.lead("id").over(w).alias("prev_id"), F.lag("id").over(w).alias("next_id"))
    return placed.where(F.col("id") == doc_id)


def page(a: Archive, f: DocumentFilter = DocumentFilter(), order_by: str = "doc_date", direction: str = "desc", limit: int = 500) -> dict[str, DataFrame]:
    """What the library page shows: the documents of a filter, and years, tree and tags of all."""
    return {"documents": listing(a, f, order_by=order_by, direction=direction, limit=limit), "years": years(a), "tree": tree(a), "tags": tags(a)}


def document_page(a: Archive, doc_id: int, f: DocumentFilter | None = None, order_by: str = "doc_date", direction: str = "desc", limit: int = 5000) -> dict[str, DataFrame]:
    """What a document's page shows: the document, its neighbours, its receipts and its statements.

    Without a filter the neighbours are those of the document's own category and year; what it lacks doesn't restrict.
    """
    own = by_id(a, doc_id).select(F.nullif(F.col("category"), F.lit("")).alias("_category"), F.nullif(F.substring("doc_date", 1, 4), F.lit("")).alias("_year"))
    if f is None:
        alike = (F.col("_category").isNull() | (F.col("category") == F.col("_category"))) & (F.col("_year").isNull() | (F.substring("doc_date", 1, 4) == F.col("_year")))
        rows = library(a).join(F.broadcast(own), alike).drop("_category", "_year").orderBy(*sort_columns(order_by, direction)).limit(limit)  # one row
    else:
        rows = listing(a, f, order_by=order_by, direction=direction, limit=limit)
    return {"document": by_id(a, doc_id), "siblings": _among(rows, doc_id, order_by, direction), "receipts": a.receipts.where(F.col("doc_id") == doc_id), "statements": a.statements.where(F.col("doc_id") == doc_id)}


def _cost() -> Column:
    return F.coalesce(F.sum(F.col("cost_usd").cast("decimal(18,6)")), F.lit(0)).cast("double").alias("cost_usd")


def totals(a: Archive) -> DataFrame:
    tokens = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")]
    return library(a).agg(F.count("*").alias("n"), *tokens, _cost(), F.count(F.when(F.col("status") == "duplicate", 1)).alias("duplicates"))


def counts_by(a: Archive, column: str) -> DataFrame:
    """A row for each value, the most frequent first."""
    return library(a).groupBy(column).agg(F.count("*").alias("n"), _cost()).orderBy(F.desc("n"), column)


def by_month(a: Archive, months: int = 12) -> DataFrame:
    """The newest months, oldest first."""
    return library(a).groupBy(F.substring("created_at", 1, 7).alias("month")).agg(F.count("*").alias("n"), _cost()).orderBy(F.desc("month")).limit(months).orderBy("month")


def count(a: Archive, f: DocumentFilter = DocumentFilter(), trash: bool = False) -> DataFrame:
    return library(a, trash).where(f.test()).agg(F.count("*").alias("n"))


def years(a: Archive) -> DataFrame:
    """The years of documents, newest first."""
    return library(a).where("doc_date <> ''").select(F.substring("doc_date", 1, 4).alias("year")).distinct().orderBy(F.desc("year"))


def tree(a: Archive) -> DataFrame:
    """year ('—' without a date), category (null in a year's subtotal and in the total, whose year is null), n, cost_usd."""
    rows = library(a).withColumn("year", blank_to(F.substring("doc_date", 1, 4), "—"))
    return rows.rollup("year", "category").agg(F.count("*").alias("n"), _cost(), F.grouping_id().cast("int").alias("level"))


def placed(rows: DataFrame, key: str, block: Column, order: list[Column]) -> DataFrame:
    """rows with `place`, from 1, among those of their key in the given order, of which block is a coarser form.

    A key is numbered block by block, and the blocks' sizes are summed: no task holds all rows of a key.
    """
    rows = rows.withColumn("_block", block)
    sizes = rows.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy(F.col("_block").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(key).alias("_key"), F.col("_block").alias("_of"), before.alias("_before"))
    inside = F.row_number().over(W.partitionBy(key, "_block").orderBy(*order))
    joined = rows.withColumn("_inside", inside).join(sizes, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_of")))
    return joined.withColumn("place", (F.col("_before") + F.col("_inside")).cast("int")).drop("_block", "_key", "_of", "_before", "_inside")


def tags(a: Archive, trash: bool = False) -> DataFrame:
    """Tags with their counts, the most frequent first."""
    return library(a, trash).select(F.explode("tags").alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "tag")


def _by_age(block: Column | None = None) -> list[Column]:
    """How documents follow each other, the oldest first, or their blocks do; nulls come last."""
    keys = [F.col("created_at"), F.col("id")] if block is None else [block]
    return [c for key in keys for c in (key.isNull(), key)]


def duplicate_groups(a: Archive) -> DataFrame:
    """content_hash, n and all the ids, oldest first, of live documents with equal content.

    Tasks order the ids of a day, and the days' lists are strung together: a group's row, however long, is all that one
    task holds of it. duplicate_members has a row a document.
    """
    rows, day = _duplicates(a), F.substring("created_at", 1, 10)
    days = rows.groupBy("content_hash", "n", day.alias("day")).agg(F.sort_array(F.collect_list(F.struct(*_by_age()))).alias("docs"))
    ids = F.transform("docs", lambda d: d["id"]).alias("ids")
    listed = days.groupBy("content_hash", "n").agg(F.sort_array(F.collect_list(F.struct(*_by_age(F.col("day")), ids))).alias("days"))
    return listed.select("content_hash", "n", F.flatten(F.transform("days", lambda d: d["ids"])).alias("ids"))


def _duplicates(a: Archive) -> DataFrame:
    """Live documents with content that another has: content_hash, n (how many have it), id, created_at."""
    rows = library(a).where("content_hash <> ''")
    many = rows.groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(many, "content_hash").select("content_hash", "n", "id", "created_at")


def duplicate_members(a: Archive) -> DataFrame:
    """The same a row a document: content_hash, id, place (1: the one to keep), numbered by the day."""
    return placed(_duplicates(a), "content_hash", F.substring("created_at", 1, 10), _by_age()).select("content_hash", "n", "id", "place")


def duplicate_waste(a: Archive) -> DataFrame:
    """One row: groups, extras and the bytes that the extras waste, by the size of each group's first."""
    first = library(a).where("content_hash <> ''").groupBy("content_hash").agg(F.count("*").alias("n"), F.min_by("file_size", F.struct(*_by_age())).alias("size")).where("n > 1")
    return first.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("extras"), F.coalesce(F.sum(F.col("size") * (F.col("n") - 1)), F.lit(0)).cast("long").alias("wasted_bytes"))


def dashboard(a: Archive, today: str) -> DataFrame:
    """One row of counters over the library, and live statements without transactions."""
    when = lambda test: F.count(F.when(test, 1))
    day = F.substring("created_at", 1, 10)
    counts = library(a).agg(
        F.count("*").alias("total"), when(F.col("status") == "review").alias("review"), when(F.col("status") == "failed").alias("failed"), when(F.col("status") == "duplicate").alias("duplicates"),
        when(F.col("status") == "processing").alias("processing"), when(day == today).alias("today"),
    )
    live = a.documents.where("deleted_at IS NULL").select(F.col("id").alias("doc_id"))
    empty = a.statements.join(live, "doc_id", "left_semi").join(a.transactions.select(F.col("statement_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("empty_statements"))
    return counts.withColumn("k", F.lit(1)).join(empty.withColumn("k", F.lit(1)), "k").drop("k")


def feed(a: Archive, statuses: list[str] | None = None, limit: int = 20) -> DataFrame:
    """The newest documents by the moment they were scanned, of some statuses; those without a valid one last."""
    rows = library(a) if statuses is None else library(a).where(F.col("status").isin(statuses))
    return rows.orderBy(F.desc(F.col("created_at").try_cast("timestamp_ntz")), F.desc("id")).limit(limit).select("id", "filename", "status", "created_at")


def without_receipt(a: Archive, categories: list[str]) -> DataFrame:
    """Live documents of some categories without a receipt."""
    rows = library(a).where(F.col("category").isin(categories))
    # a document may have any number of receipts, and counts once in the join
    return rows.join(a.receipts.select(F.col("doc_id").alias("id")).distinct(), "id", "left_anti").select("id", "category")


def to_backfill(a: Archive, with_subcategories: list[str]) -> DataFrame:
    """Filed documents without tags, or without a subcategory where their category has some."""
    lacks = F.col("category").isin(with_subcategories) & (blank_to(F.col("subcategory"), "") == "")
    return library(a).where(F.col("status") == "filed").where(lacks | (F.size("tags") == 0)).select("id", "category")


def export_selection(a: Archive, f: DocumentFilter = DocumentFilter()) -> DataFrame:
    """One document for each path, the one of the least id."""
    return library(a).where(f.test()).groupBy("library_path").agg(F.min("id").alias("id"))


def latest_by_name(a: Archive, name: str) -> DataFrame:
    return a.documents.where(F.col("original_name") == name).orderBy(F.desc("id")).limit(1).select("id", "original_name", "status")


def latest_by_hash(a: Archive, digest: str) -> DataFrame:
    return a.documents.where((F.col("content_hash") == digest) & F.col("deleted_at").isNull()).orderBy(F.desc("id")).limit(1).select("id", "content_hash")


def latest_by_hashes(a: Archive, hashes: DataFrame) -> DataFrame:
    """The newest live document of each of the given hashes (content_hash): id, content_hash."""
    rows = a.documents.where("deleted_at IS NULL").join(hashes.select("content_hash").distinct(), "content_hash", "left_semi")
    return rows.groupBy("content_hash").agg(F.max("id").alias("id")).select("id", "content_hash")


def by_id(a: Archive, doc_id: int) -> DataFrame:
    """The document of an id, in the trash or not."""
    return a.documents.where(F.col("id") == doc_id)


def with_collision_suffix(rows: DataFrame, path: str = "library_path") -> DataFrame:
    """rows with `final_path`: the second and later holders of a path get -2, -3 before the suffix."""
    block = F.floor(F.col("id") / 10_000) if dict(rows.dtypes)["id"] in ("int", "bigint") else F.substring(F.col("id").cast("string"), 1, 2)
    numbered = F.regexp_replace(F.col(path), r"(\.[^./]*)?$", "")
    found = placed(rows, path, block, [F.col("id")])
    return found.withColumn("final_path", F.when(F.col("place") == 1, F.col(path)).otherwise(F.concat(numbered, F.lit("-"), F.col("place").cast("string"), F.regexp_extract(path, r"(\.[^./]*)?$", 1)))).drop("place")
