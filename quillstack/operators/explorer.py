"""The transaction explorer: one filter, a page of rows and the aggregates over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.scalars import OTHER, TRANSFER, all_of, ascii_contains, ascii_lower, blank_to
from quillstack.operators.finance import MONTH, _in, _out, live_transactions
from quillstack.operators.library import after
from quillstack.plans.archive import Archive


@dataclass(frozen=True)
class TransactionFilter:
    """What to show. Parts that are None don't restrict; text is a comma-separated list of which one has to occur."""

    account_id: int | None = None
    category: str | None = None
    direction: str | None = None
    start: str | None = None
    end: str | None = None
    text: str | None = None
    amount_min: float | None = None
    amount_max: float | None = None
    exclude_transfers: bool = False

    def test(self) -> Column:
        size = F.abs("amount")
        tests = []
        if self.account_id is not None:
            tests.append(F.col("account_id") == self.account_id)
        if self.category is not None:
            tests.append(blank_to(F.col("category"), OTHER) == OTHER if self.category == OTHER else F.col("category") == self.category)
        if self.direction in ("expense", "income"):
            tests.append(F.col("amount") < 0 if self.direction == "expense" else F.col("amount") > 0)
        if self.start:
            tests.append(F.col("booking_date") >= self.start)
        if self.end:
            tests.append(F.col("booking_date") <= self.end)
        tokens = [t.strip() for t in (self.text or "").split(",") if t.strip()]
        if tokens:
            found = F.lit(False)
            for t in tokens:
                for c in ("counterparty", "purpose"):
                    found = found | F.coalesce(ascii_contains(F.col(c), t), F.lit(False))
            tests.append(found)
        if self.amount_min is not None:
            tests.append(size >= F.lit(self.amount_min).cast("decimal(18,2)"))
        if self.amount_max is not None:
            tests.append(size <= F.lit(self.amount_max).cast("decimal(18,2)"))
        if self.exclude_transfers:
            tests.append(F.col("category").isNull() | (F.col("category") != TRANSFER))
        return all_of(tests)


def number(text: str | float | None) -> float | None:
    """A request's number: a decimal comma will do; what is empty or no finite number is none."""
    try:
        found = float(str(text).replace(",", "."))
    except ValueError:
        return None
    return found if abs(found) < float("inf") else None


def integer(text: str | int | None) -> int | None:
    """A request's whole number; what is empty or none is none."""
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def page(a: Archive, f: TransactionFilter, limit: int = 200, offset: int = 0) -> DataFrame:
    """Newest first, with the account's display columns. The page is cut before the accounts are joined."""
    rows = live_transactions(a).where(f.test()).orderBy(F.desc("booking_date"), F.desc("id")).offset(offset).limit(limit)
    accounts = a.accounts.select(F.col("id").alias("account_id"), "bank_name", "iban_last4")
    return rows.join(accounts, "account_id", "left").orderBy(F.desc("booking_date"), F.desc("id")).select("id", "booking_date", F.col("amount").cast("double").alias("amount"), "counterparty", "purpose", "category", "account_id", "doc_id", "bank_name", "iban_last4")


def page_after(a: Archive, f: TransactionFilter, last: tuple | None, limit: int = 200) -> DataFrame:
    """The bookings that follow (booking_date, id), newest first; None is the first page. See library.page_after."""
    rows = after(live_transactions(a).where(f.test()).withColumn("page_key", F.col("booking_date")), last, "desc", limit)
    accounts = a.accounts.select(F.col("id").alias("account_id"), "bank_name", "iban_last4")
    return rows.join(accounts, "account_id", "left").orderBy(F.desc("booking_date"), F.desc("id")).select("id", "booking_date", F.col("amount").cast("double").alias("amount"), "counterparty", "purpose", "category", "account_id", "doc_id", "bank_name", "iban_last4")


def totals(a: Archive, f: TransactionFilter) -> DataFrame:
    return live_transactions(a).where(f.test()).agg(
        F.count("*").alias("count"), _in().alias("sum_in"), _out().alias("sum_out"), F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("sum_net"),
        F.coalesce(F.min("booking_date"), F.lit("")).alias("first_date"), F.coalesce(F.max("booking_date"), F.lit("")).alias("last_date"),
    )


def top(a: Archive, f: TransactionFilter, direction: str = "expense", n: int = 10) -> DataFrame:
    less = direction == "expense"
    rows = live_transactions(a).where(f.test()).where(F.col("amount") < 0 if less else F.col("amount") > 0)
    name = blank_to(F.col("counterparty"), "—")
    found = rows.groupBy(ascii_lower(name).alias("key")).agg(F.min(name).alias("counterparty"), F.count("*").alias("times"), F.sum("amount").cast("double").alias("total"))
    return found.orderBy(F.asc("total") if less else F.desc("total"), "key").limit(n).drop("key")


def months(a: Archive, f: TransactionFilter, limit: int = 36) -> DataFrame:
    """The newest months with bookings, oldest first, without filling gaps."""
    rows = live_transactions(a).where(f.test()).where("booking_date IS NOT NULL AND booking_date <> ''")
    return rows.groupBy(MONTH().alias("month")).agg(_in().alias("sum_in"), _out().alias("sum_out"), F.count("*").alias("n")).orderBy(F.desc("month")).limit(limit).orderBy("month")


def categories(a: Archive, f: TransactionFilter) -> DataFrame:
    rows = live_transactions(a).where(f.test())
    return rows.groupBy(blank_to(F.col("category"), OTHER).alias("cat")).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))
