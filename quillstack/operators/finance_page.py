"""The finance page from one reading of the bookings: each row goes to all groupings at once, and results are cut from the sums.

A booking belongs to its month, its day, its category and so on; it is given out once for each, under the grouping's name
and key, and one aggregation sums all groupings. What the page shows is then a filter on that table, which holds a row
for each key and no bookings. Results are those of the single functions in `finance`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.functions.scalars import OTHER, TRANSFER, ascii_lower, blank_to, real_date
from quillstack.operators.finance import anchors, live_statements, live_transactions
from quillstack.plans.archive import Archive, scratch



def _memberships() -> Column:
    """The groupings of a booking: name, first key, second key."""
    own, dated, named = F.col("category") != TRANSFER, F.coalesce("booking_date", F.lit("")) != "", F.coalesce("counterparty", F.lit("")) != ""
    month, name, label = F.substring("booking_date", 1, 7), ascii_lower(F.col("counterparty")), blank_to(F.col("category"), OTHER)
    none = F.lit("")
    one = lambda test, grouping, a=none, b=none: F.when(test, F.struct(F.lit(grouping).alias("grouping"), a.cast("string").alias("a"), b.cast("string").alias("b")))
    return F.array_compact(F.array(
        one(own, "own"), one(F.col("category") == TRANSFER, "moved"), one(F.col("category") != "", "category", F.col("category")), one(own & dated, "month", month), one(dated, "any month", month),
        one(own & dated, "day", F.col("booking_date")), one(own & named, "name", name), one(dated & named, "name month", name, month), one(own & dated & (F.col("amount") < 0), "month label", month, label),
        one(own & dated, "label", label), one(own & (F.col("amount") < 0), "kind", blank_to(F.col("tx_type"), OTHER)), one(own & named & (F.col("amount") < 0), "trimmed", F.trim(name)), one(dated, "account day", F.col("account_id"), F.col("booking_date")),
        one(F.lit(True), "account", F.col("account_id")),
    ))


def groups(a: Archive) -> DataFrame:
    """grouping, a, b with the sums of all groupings, in a table of its own."""
    label = blank_to(F.col("category"), OTHER)
    rows = live_transactions(a).select("id", "account_id", "booking_date", "amount", "counterparty", "category", "tx_type", F.explode(_memberships()).alias("g"))
    came, went = F.col("amount") > 0, F.col("amount") < 0
    of = lambda test, value: F.sum(F.when(test, value))
    summed = rows.groupBy("g").agg(
        F.count("*").alias("n"), F.count(F.when(came, 1)).alias("n_in"), F.count(F.when(went, 1)).alias("n_out"), of(came, F.col("amount")).alias("s_in"), of(went, F.col("amount")).alias("s_out"), F.sum("amount").alias("net"),
        F.min("counterparty").alias("least"), F.min(F.when(came, F.col("counterparty"))).alias("least_in"), F.min(F.when(went, F.col("counterparty"))).alias("least_out"), F.max("counterparty").alias("most"), F.max(label).alias("label"),
        F.max(F.struct(F.abs("amount").alias("size"), (-F.col("id")).alias("first"), "amount", "counterparty")).alias("biggest"),
    )
    summed = summed.select("g.grouping", "g.a", "g.b", "*").drop("g")
    folder = scratch(a.accounts.sparkSession)
    summed.write.parquet(folder)
    return a.accounts.sparkSession.read.schema(summed.schema).parquet(folder)


def _money(c: str, sign: int = 1) -> Column:
    return F.coalesce(F.col(c) * sign, F.lit(0)).cast("double")


def page(a: Archive) -> dict[str, DataFrame]:
    """What the finance page shows, by the names of the functions in `finance`. The largest bookings are rows, not sums, and stay a query of their own."""
    g = groups(a)
    of = lambda name: g.where(F.col("grouping") == name)
    out: dict[str, DataFrame] = {}

    one = lambda df: df.withColumn("k", F.lit(1))
    pick = lambda name, c: F.max(F.when(F.col("grouping") == name, F.col(c)))
    totals = g.where("grouping IN ('own', 'moved')").agg(
        F.coalesce(pick("own", "s_in"), F.lit(0)).cast("double").alias("income"), F.coalesce(pick("own", "s_out"), F.lit(0)).cast("double").alias("expense"), F.coalesce(pick("own", "net"), F.lit(0)).cast("double").alias("net"),
        F.coalesce(pick("own", "n"), F.lit(0)).alias("tx_count"), F.coalesce(pick("moved", "n"), F.lit(0)).alias("transfer_count"), F.coalesce(pick("moved", "net"), F.lit(0)).cast("double").alias("transfer_volume"),
    )
    counts = live_statements(a).agg(F.count("*").alias("statement_count"))
    out["summary"] = one(totals).join(one(counts), "k").join(one(a.accounts.agg(F.count("*").alias("account_count"))), "k").drop("k")
    out["by_category"] = of("category").select(F.col("a").alias("category"), _money("s_in").alias("income"), _money("s_out").alias("expense"), "n")

    months = of("month").select(F.col("a").alias("month"), _money("s_in").alias("income"), _money("s_out").alias("expense"), "n")
    day = F.try_to_date(F.concat("month", F.lit("-01")), "yyyy-MM-dd")
    ends = months.agg(F.min(day).alias("first"), F.max(day).alias("last")).where("first IS NOT NULL")
    spine = ends.select(F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 MONTH"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    out["monthly"] = spine.join(months, "month", "left").na.fill({"income": 0.0, "expense": 0.0, "n": 0}).orderBy("month")

    for name, n, total, least, order in (("expense", "n_out", "s_out", "least_out", F.asc), ("income", "n_in", "s_in", "least_in", F.desc)):
        rows = of("name").where(F.col(n) > 0).select("a", F.col(least).alias("counterparty"), F.col(n).alias("times"), _money(total).alias("total"))
        out[f"top_counterparties_{name}"] = rows.orderBy(order("total"), "a").limit(15).drop("a")

    mean = F.col("net").cast("double") / F.col("n")
    each = of("name month").withColumn("mean", mean).groupBy("a").agg(
        F.min("least").alias("counterparty"), F.count("*").alias("months"), F.round(F.sum(F.col("mean").cast("decimal(28,8)")).cast("double") / F.count("*"), 4).alias("amount"), F.min("mean").alias("min_amount"), F.max("mean").alias("max_amount"),
    )
    again = each.where((F.col("months") >= 3) & (F.abs(F.col("max_amount") - F.col("min_amount")) <= F.abs("amount") * 0.15))
    out["recurring"] = again.orderBy(F.desc("months"), F.desc(F.abs("amount")), "a").limit(30).drop("a")

    values = of("any month").select(F.explode(F.array(F.struct(F.lit("month").alias("kind"), F.col("a").alias("value")), F.struct(F.lit("year").alias("kind"), F.substring("a", 1, 4).alias("value")))).alias("p"))
    out["periods"] = values.select("p.*").distinct()

    days = of("day").select(F.col("a").alias("date"), _money("s_out", -1).alias("spend"), _money("s_in").alias("income"), "n", "n_out", F.coalesce(F.col("s_out"), F.lit(0)).alias("out"))
    busiest = of("any month").groupBy(F.substring("a", 1, 4).alias("year")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("year")).limit(1).select("year")
    out["heatmap"] = days.join(F.broadcast(busiest), F.substring("date", 1, 4) == F.col("year")).select("date", "spend", "income", "n")  # one year

    real = days.withColumn("day", real_date(F.col("date"))).where("day IS NOT NULL")
    spent, n_out = -F.sum("out"), F.sum("n_out")
    number = lambda name, first, last: a.accounts.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(name))
    by = real.groupBy(F.weekday("day").cast("int").alias("dow")).agg(spent.cast("double").alias("spend"), F.coalesce(spent.cast("double") / F.nullif(n_out, F.lit(0)), F.lit(0.0)).alias("avg_spend"), F.sum("n").alias("n"))
    out["by_weekday"] = number("dow", 0, 6).join(by, "dow", "left").na.fill({"spend": 0.0, "avg_spend": 0.0, "n": 0})
    by = real.groupBy(F.day("day").cast("int").alias("dom")).agg(spent.cast("double").alias("spend"), F.sum("n").alias("n"))
    out["by_day_of_month"] = number("dom", 1, 31).join(by, "dom", "left").na.fill({"spend": 0.0, "n": 0})

    cells = of("month label").select(F.col("a").alias("month"), F.col("b").alias("category"), F.col("s_out"), "n")
    ranks = cells.groupBy("category").agg(F.sum(-F.col("s_out")).alias("total")).select("category", F.row_number().over(W.orderBy(F.desc("total"), "category")).alias("rank"))  # one row a category
    out["category_monthly"] = cells.join(ranks, "category").select("month", "category", _money("s_out", -1).alias("spend"), "n", "rank")
    for name, n, total, sign in (("spend", "n_out", "s_out", -1), ("income", "n_in", "s_in", 1)):
        out[f"category_totals_{name}"] = of("label").where(F.col(n) > 0).select(F.col("a").alias("category"), _money(total, sign).alias("total"), F.col(n).alias("n"))
    out["by_tx_type"] = of("kind").select(F.col("a").alias("tx_type"), _money("s_out", -1).alias("spend"), "n")
    tree = of("trimmed").select(F.col("a").alias("key"), F.col("most").alias("counterparty"), F.col("n").alias("times"), _money("s_out", -1).alias("spend"), F.col("label").alias("dominant_category"))
    out["treemap"] = tree.orderBy(F.desc("spend"), "key").limit(25)

    running = F.sum("net").over(W.partitionBy("account_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    nets = of("account day").select(F.col("a").cast("long").alias("account_id"), F.col("b").alias("date"), "net").withColumn("running", running)
    start = anchors(a).select(F.col("account_id").alias("_account"), F.col("opening_balance").cast("decimal(18,2)").alias("opening"))
    joined = nets.join(start, F.col("account_id").eqNullSafe(F.col("_account")), "left")
    out["balance_history"] = joined.select("account_id", "date", (F.coalesce("opening", F.lit(0)) + F.col("running")).cast("double").alias("balance"))
    s = live_statements(a).groupBy("account_id").agg(F.count("*").alias("statement_count"))
    t = of("account").select(F.col("a").cast("long").alias("account_id"), F.col("n").alias("tx_count"), _money("net").alias("net"))
    held = a.accounts.withColumnRenamed("id", "account_id").join(s, "account_id", "left").join(t, "account_id", "left")
    out["accounts"] = held.na.fill({"statement_count": 0, "tx_count": 0, "net": 0.0}).select("account_id", "bank_name", "iban_last4", "statement_count", "tx_count", "net")

    first = lambda df, order, *columns: one(df.orderBy(*order).limit(1).select(*columns))
    daily = of("day").agg(F.coalesce(-F.sum(F.coalesce("s_out", F.lit(0))).cast("double") / F.count("*"), F.lit(0.0)).alias("avg_daily_spend"), F.coalesce(F.max(-F.coalesce("s_out", F.lit(0))).cast("double"), F.lit(0.0)).alias("peak_daily_spend"))
    big = of("own").select(F.col("biggest.amount").cast("double").alias("biggest_amount"), F.col("biggest.counterparty").alias("biggest_counterparty"))
    month = first(of("month"), [F.desc("n"), F.desc("a")], F.col("a").alias("busiest_month"), F.col("n").alias("busiest_month_n"))
    name = first(of("name"), [F.desc("n"), "a"], F.col("least").alias("top_counterparty"), F.col("n").alias("top_counterparty_n"))
    out["kpis"] = one(daily).join(one(big), "k", "left").join(month, "k", "left").join(name, "k", "left").drop("k")
    return out
