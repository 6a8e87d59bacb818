"""Receipts and their items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions.rules import BLOCKERS, signal_names, with_shops
from quillstack.functions.scalars import ascii_contains, ascii_lower
from quillstack.operators.finance import live_documents
from quillstack.plans.archive import Archive


def live_receipts(a: Archive) -> DataFrame:
    return a.receipts.join(live_documents(a).select(F.col("id").alias("doc_id")), "doc_id")


def live_items(a: Archive) -> DataFrame:
    r = live_receipts(a).select(F.col("id").alias("receipt_id"), "shop_name", "shop_type", "receipt_date", "doc_id")
    return a.receipt_items.join(r, "receipt_id")


def _money(c: str):
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def summary(a: Archive) -> DataFrame:
    """One row: receipt_count, total_spent, avg_receipt, item_count."""
    r = live_receipts(a).agg(F.count("*").alias("receipt_count"), _money("total_amount").alias("total_spent"), F.coalesce(_money("total_amount") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("avg_receipt"))
    i = live_items(a).agg(F.count("*").alias("item_count"))
    return r.withColumn("k", F.lit(1)).join(i.withColumn("k", F.lit(1)), "k").drop("k")


def by_shop_type(a: Archive) -> DataFrame:
    return live_receipts(a).where("shop_type <> ''").groupBy("shop_type").agg(F.count("*").alias("n"), _money("total_amount").alias("total"))


def by_item_category(a: Archive) -> DataFrame:
    return live_items(a).where("item_category <> ''").groupBy("item_category").agg(F.count("*").alias("n"), _money("total_price").alias("total"))


def monthly(a: Archive, months: int = 12) -> DataFrame:
    rows = live_receipts(a).where("receipt_date <> ''").groupBy(F.substring("receipt_date", 1, 7).alias("month")).agg(F.count("*").alias("receipts"), _money("total_amount").alias("total"))
    return rows.orderBy(F.desc("month")).limit(months).orderBy("month")  # the newest, oldest first


def _dates(rows: DataFrame, start: str | None, end: str | None) -> DataFrame:
    rows = rows.where(F.col("receipt_date") >= start) if start else rows
    return rows.where(F.col("receipt_date") <= end) if end else rows


def listing(a: Archive, shop_type: str | None = None, start: str | None = None, end: str | None = None, limit: int = 200) -> DataFrame:
    docs = live_documents(a).select(F.col("id").alias("doc_id"), F.col("subject").alias("doc_subject"), "library_path")
    rows = _dates(a.receipts if shop_type is None else a.receipts.where(F.col("shop_type") == shop_type), start, end).join(docs, "doc_id")
    return rows.orderBy(F.desc("receipt_date"), F.desc("id")).limit(limit).select("id", "doc_id", "shop_name", "shop_type", F.col("total_amount").cast("double").alias("total_amount"), "receipt_date", "doc_subject", "library_path")


def search_items(a: Archive, query: str | None = None, item_category: str | None = None, shop_type: str | None = None, start: str | None = None, end: str | None = None, limit: int = 200) -> DataFrame:
    rows = live_items(a)
    if query:
        rows = rows.where(ascii_contains(F.col("name"), query))
    if item_category is not None:
        rows = rows.where(F.col("item_category") == item_category)
    if shop_type is not None:
        rows = rows.where(F.col("shop_type") == shop_type)
    rows = _dates(rows, start, end).orderBy(F.desc("receipt_date"), F.desc("receipt_id"), "line_no").limit(limit)
    return rows.select("id", "receipt_id", "name", F.col("total_price").cast("double").alias("total_price"), "item_category", "line_no", "shop_name", "shop_type", "receipt_date", "doc_id")


def items_of_receipts(a: Archive) -> DataFrame:
    """receipt_id and its items in order, as an array; a receipt's lines are few."""
    return live_items(a).groupBy("receipt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "id", "name"))), lambda i: i["name"]).alias("items"))


def top_items(a: Archive, limit: int = 10) -> DataFrame:
    rows = live_items(a).where("name <> ''").groupBy(ascii_lower(F.col("name")).alias("key"))
    found = rows.agg(F.min("name").alias("name"), F.count("*").alias("times"), _money("total_price").alias("spent"), F.coalesce(F.sum("unit_price").cast("double") / F.count("unit_price"), F.lit(0.0)).alias("avg_unit"))
    return found.orderBy(F.desc("times"), F.desc("spent"), "key").limit(limit).drop("key")


def misfiled(a: Archive, promotable: list[str], limit: int = 200, least: int = 2, most_blockers: int = 2, shops: tuple[str, ...] = ()) -> DataFrame:
    """Documents of other categories whose text looks like a receipt, among the newest 5 * limit with a text: newest first.

    Those that have a receipt already are left out. A name of one of the shops counts as a signal.
    """
    rows = live_documents(a).where(F.col("category").isin(promotable)).where("extracted_text <> ''").orderBy(F.desc("id")).limit(5 * limit)
    rows = rows.join(a.receipts.select(F.col("doc_id").alias("id")).distinct(), "id", "left_anti")
    rows = rows.withColumn("signals", signal_names(F.col("extracted_text"), with_shops(shops))).withColumn("blockers", F.size(signal_names(F.col("extracted_text"), BLOCKERS)))
    rows = rows.withColumn("signal_count", F.size("signals")).where((F.col("signal_count") >= least) & (F.col("blockers") < most_blockers))
    return rows.orderBy(F.desc("id")).limit(limit).select("id", "category", "subject", "signals", "signal_count")


def page(a: Archive, query: str | None = None, shop_type: str | None = None, start: str | None = None, end: str | None = None) -> dict[str, DataFrame]:
    """What the receipts page shows: sums, months and top items of all, receipts and items of a filter."""
    return {
        "summary": summary(a), "by_shop_type": by_shop_type(a), "by_item_category": by_item_category(a), "monthly": monthly(a), "receipts": listing(a, shop_type, start, end, 50),
        "items": search_items(a, query, shop_type=shop_type, start=start, end=end), "top_items": top_items(a, 15),
    }
