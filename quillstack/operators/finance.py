"""Cash-flow queries over live transactions: those whose statement's document is not in the trash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.functions.scalars import OTHER, TRANSFER, ascii_lower, blank_to, real_date
from quillstack.plans.archive import Archive

MONTH = lambda: F.substring("booking_date", 1, 7)


def live_documents(a: Archive) -> DataFrame:
    return a.documents.where("deleted_at IS NULL")


def live_statements(a: Archive) -> DataFrame:
    """Statements of live documents, without the documents' columns."""
    return a.statements.join(live_documents(a).select(F.col("id").alias("doc_id")), "doc_id")


def live_transactions(a: Archive) -> DataFrame:
    """Transactions with doc_id; the document side carries its id alone, so scans read two columns of it."""
    return a.transactions.join(live_statements(a).select(F.col("id").alias("statement_id"), "doc_id"), "statement_id")


def with_overrides(a: Archive) -> DataFrame:
    """Transactions with manual labels in place of their own."""
    o = a.overrides.select("tx_hash", F.col("category").alias("_own"))
    return a.transactions.join(o, "tx_hash", "left").withColumn("category", F.coalesce("_own", "category")).drop("_own")


def _sum(test: Column, value: Column | None = None) -> Column:
    value = F.col("amount") if value is None else value
    return F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast("double")


def _in() -> Column:
    return _sum(F.col("amount") > 0)


def _out() -> Column:
    return _sum(F.col("amount") < 0)


def _spend() -> Column:
    return _sum(F.col("amount") < 0, -F.col("amount"))


def _own(df: DataFrame) -> DataFrame:
    """Without transfers between own accounts; a null category goes as well, as it always has here."""
    return df.where(F.col("category") != TRANSFER)


def _dated(df: DataFrame) -> DataFrame:
    return df.where(F.col("booking_date").isNotNull() & (F.col("booking_date") != ""))


def summary(a: Archive) -> DataFrame:
    """One row: income, expense, net, tx_count, statement_count, account_count, transfer_count, transfer_volume."""
    own, moved = F.col("category") != TRANSFER, F.col("category") == TRANSFER
    totals = live_transactions(a).agg(
        _sum(own & (F.col("amount") > 0)).alias("income"), _sum(own & (F.col("amount") < 0)).alias("expense"), _sum(own).alias("net"),
        F.count(F.when(own, 1)).alias("tx_count"), F.count(F.when(moved, 1)).alias("transfer_count"), _sum(moved).alias("transfer_volume"),
    )
    # three one-row aggregates side by side
    parts = [totals, live_statements(a).agg(F.count("*").alias("statement_count")), a.accounts.agg(F.count("*").alias("account_count"))]
    joined = parts[0].withColumn("k", F.lit(1))
    for p in parts[1:]:
        joined = joined.join(p.withColumn("k", F.lit(1)), "k")
    return joined.drop("k")


def by_category(a: Archive) -> DataFrame:
    return live_transactions(a).where("category <> ''").groupBy("category").agg(_in().alias("income"), _out().alias("expense"), F.count("*").alias("n"))


def monthly(a: Archive, months: int | None = None) -> DataFrame:
    """month, income, expense, n; months without bookings between the first and the last are zero rows. No bookings: no rows."""
    rows = _dated(_own(live_transactions(a))).groupBy(MONTH().alias("month")).agg(_in().alias("income"), _out().alias("expense"), F.count("*").alias("n"))
    if months is not None:
        rows = rows.orderBy(F.desc("month")).limit(months)
    day = F.try_to_date(F.concat("month", F.lit("-01")), "yyyy-MM-dd")
    ends = rows.agg(F.min(day).alias("first"), F.max(day).alias("last")).where("first IS NOT NULL")
    spine = ends.select(F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 MONTH"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    return spine.join(rows, "month", "left").na.fill({"income": 0.0, "expense": 0.0, "n": 0}).orderBy("month")


def top_counterparties(a: Archive, direction: str = "expense", limit: int = 15) -> DataFrame:
    less = direction == "expense"
    rows = _own(live_transactions(a)).where(F.col("amount") < 0 if less else F.col("amount") > 0).where("counterparty <> ''")
    found = rows.groupBy(ascii_lower(F.col("counterparty")).alias("key")).agg(F.min("counterparty").alias("counterparty"), F.count("*").alias("times"), F.sum("amount").cast("double").alias("total"))
    return found.orderBy(F.asc("total") if less else F.desc("total"), "key").limit(limit).select("counterparty", "times", "total")


def recurring(a: Archive, min_months: int = 3, tolerance: float = 0.15, limit: int = 30) -> DataFrame:
    """Counterparties seen in several months whose monthly means lie within a share of their mean."""
    rows = _dated(live_transactions(a).where("counterparty <> ''"))
    each = rows.groupBy(ascii_lower(F.col("counterparty")).alias("key"), MONTH().alias("month")).agg(F.min("counterparty").alias("counterparty"), (F.sum("amount").cast("double") / F.count("*")).alias("mean"))
    found = each.groupBy("key").agg(
        F.min("counterparty").alias("counterparty"), F.count("*").alias("months"),
        F.round(F.sum(F.col("mean").cast("decimal(28,8)")).cast("double") / F.count("*"), 4).alias("amount"), F.min("mean").alias("min_amount"), F.max("mean").alias("max_amount"),
    )
    found = found.where((F.col("months") >= min_months) & (F.abs(F.col("max_amount") - F.col("min_amount")) <= F.abs("amount") * tolerance))
    return found.orderBy(F.desc("months"), F.desc(F.abs("amount")), "key").limit(limit).drop("key")


def periods(a: Archive) -> DataFrame:
    """kind (year or month) and value of each period with bookings."""
    months = _dated(live_transactions(a)).select(MONTH().alias("value")).distinct()
    return months.select(F.explode(F.array(F.struct(F.lit("month").alias("kind"), "value"), F.struct(F.lit("year").alias("kind"), F.substring("value", 1, 4).alias("value")))).alias("p")).select("p.*").distinct()


def busiest_year(a: Archive) -> DataFrame:
    """One row, the year with most bookings, the later of equals; none if there are no bookings."""
    years = _dated(live_transactions(a)).groupBy(F.substring("booking_date", 1, 4).alias("year")).agg(F.count("*").alias("n"))
    return years.orderBy(F.desc("n"), F.desc("year")).limit(1).select("year")


def heatmap(a: Archive, year: str | None = None, month: str | None = None, transfers: bool = False) -> DataFrame:
    """date, spend, income, n of each day of a month or a year; by default of the busiest year, without transfers."""
    rows = _dated(live_transactions(a))
    rows = rows if transfers else _own(rows)
    if month:
        rows = rows.where(MONTH() == month[:7])
    elif year:
        rows = rows.where(F.substring("booking_date", 1, 4) == year)
    else:
        rows = rows.join(F.broadcast(busiest_year(a)), F.substring("booking_date", 1, 4) == F.col("year"))  # one row
    return rows.groupBy(F.col("booking_date").alias("date")).agg(_spend().alias("spend"), _in().alias("income"), F.count("*").alias("n"))


def calendar(a: Archive, year: str) -> DataFrame:
    """The heatmap of a year on a grid of whole weeks from Monday: week, dow, date, in_year, spend, n."""
    days = a.accounts.sparkSession.range(1).select(F.explode(F.sequence(F.date_trunc("week", F.lit(f"{year}-01-01").cast("date")).cast("date"), F.date_add(F.date_trunc("week", F.lit(f"{year}-12-31").cast("date")).cast("date"), 6))).alias("day"))
    grid = days.select(F.date_trunc("week", "day").cast("date").cast("string").alias("week"), F.weekday("day").alias("dow"), F.col("day").cast("string").alias("date"), (F.year("day") == int(year)).alias("in_year"))
    return grid.join(heatmap(a, year=year).select("date", "spend", "n"), "date", "left").na.fill({"spend": 0.0, "n": 0})


def heat_scale(a: Archive, year: str) -> DataFrame:
    """One row: the value at nine tenths of the days with spending, in order, and 1 at least."""
    # about 366 rows at most
    days = heatmap(a, year=year).where("spend > 0").select("spend", F.row_number().over(W.orderBy("spend")).alias("place"), F.count("*").over(W.partitionBy()).alias("days"))
    return days.agg(F.greatest(F.coalesce(F.max(F.when(F.col("place") == F.greatest(F.floor(F.col("days") * 0.9), F.lit(1)), F.col("spend"))), F.lit(1.0)), F.lit(1.0)).alias("scale"))


def _between(rows: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start:
        rows = rows.where(MONTH() >= start[:7])
    return rows.where(MONTH() <= end[:7]) if end else rows


def category_monthly(a: Archive, start: str | None = None, end: str | None = None) -> DataFrame:
    """month, category, spend, n, rank: the rank of the category by its spending over all months, from 1."""
    rows = _between(_dated(_own(live_transactions(a))).where("amount < 0"), start, end)
    cells = rows.groupBy(MONTH().alias("month"), blank_to(F.col("category"), OTHER).alias("category")).agg(F.sum(-F.col("amount")).alias("spend"), F.count("*").alias("n"))
    ranks = cells.groupBy("category").agg(F.sum("spend").alias("total")).select("category", F.row_number().over(W.orderBy(F.desc("total"), "category")).alias("rank"))  # one row a category
    return cells.join(ranks, "category").select("month", "category", F.col("spend").cast("double").alias("spend"), "n", "rank")


def category_matrix(a: Archive, categories: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """A row for each month, a column for each of the given categories."""
    return category_monthly(a, start, end).groupBy("month").pivot("category", categories).agg(F.sum("spend")).na.fill(0.0)


def statement_by_file(a: Archive, file_hash: str) -> DataFrame:
    """The statement that was read from a file, the newest of several."""
    return a.statements.where(F.col("file_hash") == file_hash).orderBy(F.desc("id")).limit(1)


def statements_by_files(a: Archive, files: DataFrame) -> DataFrame:
    """The statements that were read from files (file_hash), the newest of several of one file."""
    newest = a.statements.join(files.select("file_hash").distinct(), "file_hash", "left_semi").groupBy("file_hash").agg(F.max("id").alias("id"))
    return a.statements.join(newest.select("id"), "id", "left_semi")


def _spine(a: Archive, name: str, first: int, last: int) -> DataFrame:
    return a.accounts.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(name))


def by_weekday(a: Archive) -> DataFrame:
    """dow (0 Monday to 6), spend, avg_spend, n: seven rows. Dates that are none are left out."""
    rows = _dated(_own(live_transactions(a))).withColumn("dow", F.weekday(real_date(F.col("booking_date"))).cast("int")).where("dow IS NOT NULL")
    found = rows.groupBy("dow").agg(_spend().alias("spend"), F.coalesce(_spend() / F.nullif(F.count(F.when(F.col("amount") < 0, 1)), F.lit(0)), F.lit(0.0)).alias("avg_spend"), F.count("*").alias("n"))
    return _spine(a, "dow", 0, 6).join(found, "dow", "left").na.fill({"spend": 0.0, "avg_spend": 0.0, "n": 0})


def by_day_of_month(a: Archive) -> DataFrame:
    """dom (1 to 31), spend, n: 31 rows."""
    rows = _dated(_own(live_transactions(a))).withColumn("dom", F.day(real_date(F.col("booking_date"))).cast("int")).where("dom IS NOT NULL")
    return _spine(a, "dom", 1, 31).join(rows.groupBy("dom").agg(_spend().alias("spend"), F.count("*").alias("n")), "dom", "left").na.fill({"spend": 0.0, "n": 0})


def by_tx_type(a: Archive) -> DataFrame:
    rows = _own(live_transactions(a)).where("amount < 0")
    return rows.groupBy(blank_to(F.col("tx_type"), OTHER).alias("type")).agg(_spend().alias("spend"), F.count("*").alias("n")).withColumnRenamed("type", "tx_type")


def largest(a: Archive, limit: int = 15) -> DataFrame:
    top = _own(live_transactions(a)).orderBy(F.desc(F.abs("amount")), "id").limit(limit)
    accounts = a.accounts.select(F.col("id").alias("account_id"), "bank_name", "iban_last4")
    return top.join(accounts, "account_id", "left").orderBy(F.desc(F.abs("amount")), "id").select("id", "booking_date", F.col("amount").cast("double").alias("amount"), "counterparty", "category", "purpose", "doc_id", "bank_name", "iban_last4")


def anchors(a: Archive) -> DataFrame:
    """account_id, period_start, opening_balance of the earliest live statement with an opening balance."""
    rows = live_statements(a).where("opening_balance IS NOT NULL").groupBy("account_id")
    return rows.agg(F.min(F.struct("period_start", "id", "opening_balance")).alias("s")).select("account_id", "s.period_start", F.col("s.opening_balance").cast("double").alias("opening_balance"))


def balance_history(a: Archive, account_id: int | None = None) -> DataFrame:
    """account_id, date, balance: the anchor plus all nets up to the day. An account holds a row for each day at most."""
    rows = live_transactions(a).where("booking_date <> ''")
    if account_id is not None:
        rows = rows.where(F.col("account_id") == account_id)
    nets = rows.groupBy("account_id", F.col("booking_date").alias("date")).agg(F.sum("amount").alias("net"))
    running = F.sum("net").over(W.partitionBy("account_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    start = anchors(a).select(F.col("account_id").alias("_account"), F.col("opening_balance").cast("decimal(18,2)").alias("opening"))
    joined = nets.withColumn("running", running).join(start, F.col("account_id").eqNullSafe(F.col("_account")), "left")
    return joined.select("account_id", "date", (F.coalesce("opening", F.lit(0)) + F.col("running")).cast("double").alias("balance"))


def category_totals(a: Archive, start: str | None = None, end: str | None = None, direction: str = "spend") -> DataFrame:
    sign = -1 if direction == "spend" else 1
    rows = _between(_dated(_own(live_transactions(a))).where(F.col("amount") * sign > 0), start, end)
    return rows.groupBy(blank_to(F.col("category"), OTHER).alias("category")).agg(F.sum(F.col("amount") * sign).cast("double").alias("total"), F.count("*").alias("n"))


def treemap(a: Archive, limit: int = 25) -> DataFrame:
    rows = _own(live_transactions(a)).where("counterparty <> '' AND amount < 0")
    found = rows.groupBy(F.trim(ascii_lower(F.col("counterparty"))).alias("key")).agg(
        F.max("counterparty").alias("counterparty"), F.count("*").alias("times"), _spend().alias("spend"), F.max(blank_to(F.col("category"), OTHER)).alias("dominant_category")
    )
    return found.orderBy(F.desc("spend"), "key").limit(limit)


def kpis(a: Archive) -> DataFrame:
    """One row of single figures; ties go to the smaller id, the later month and the smaller name."""
    own = _own(live_transactions(a))
    daily = own.where("booking_date <> ''").groupBy("booking_date").agg(F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(0)).alias("spend"))
    first = lambda df, order, *cols: df.orderBy(*order).limit(1).select(*cols)
    parts = [
        daily.agg(F.coalesce(F.sum("spend").cast("double") / F.count("*"), F.lit(0.0)).alias("avg_daily_spend"), F.coalesce(F.max("spend").cast("double"), F.lit(0.0)).alias("peak_daily_spend")),
        first(own, [F.desc(F.abs("amount")), "id"], F.col("amount").cast("double").alias("biggest_amount"), F.col("counterparty").alias("biggest_counterparty")),
        first(own.where("booking_date <> ''").groupBy(MONTH().alias("busiest_month")).agg(F.count("*").alias("busiest_month_n")), [F.desc("busiest_month_n"), F.desc("busiest_month")], "*"),
        first(own.where("counterparty <> ''").groupBy(ascii_lower(F.col("counterparty")).alias("key")).agg(F.min("counterparty").alias("top_counterparty"), F.count("*").alias("top_counterparty_n")), [F.desc("top_counterparty_n"), "key"], "top_counterparty", "top_counterparty_n"),
    ]
    out = parts[0].withColumn("k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("k", F.lit(1)), "k", "left")
    return out.drop("k")


def accounts(a: Archive) -> DataFrame:
    """Accounts with statement_count, tx_count and net over their live statements."""
    s = live_statements(a).groupBy("account_id").agg(F.count("*").alias("statement_count"))
    t = live_transactions(a).groupBy("account_id").agg(F.count("*").alias("tx_count"), F.sum("amount").cast("double").alias("net"))
    out = a.accounts.withColumnRenamed("id", "account_id").join(s, "account_id", "left").join(t, "account_id", "left")
    return out.na.fill({"statement_count": 0, "tx_count": 0, "net": 0.0}).select("account_id", "bank_name", "iban_last4", "statement_count", "tx_count", "net")
