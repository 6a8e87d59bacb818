"""Every query of the archive by name, over the stand-ins, with the same in SQL for the other engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import rules, scalars
from quillstack.operators import explorer, finance, finance_page, flows, library, receipts, search, search_index, writes
from quillstack.operators.explorer import TransactionFilter
from quillstack.operators.library import DocumentFilter
from quillstack.plans.archive import Archive, scratch, sql, stand_ins
from quillstack.sources import bank_csv, versions
from quillstack.streaming import inbox

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query: Callable[[Archive], DataFrame], body: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(stand_ins(spark, sf_dir))
    if body:
        ORACLE_SQL[name] = sql(body)


def _fold(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _matches(prefix: str) -> str:
    text = "lower(strip_accents(concat_ws(' | ', filename, sender, subject, '', extracted_text)))"
    return f"regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}]){prefix}')"


IN = "CAST(coalesce(sum(CASE WHEN amount > 0 THEN amount END), 0) AS DOUBLE)"
OUT = "CAST(coalesce(sum(CASE WHEN amount < 0 THEN amount END), 0) AS DOUBLE)"
SPEND = "CAST(coalesce(sum(CASE WHEN amount < 0 THEN -amount END), 0) AS DOUBLE)"
OWN = "category <> 'uebertrag'"
DATED = "booking_date IS NOT NULL AND booking_date <> ''"
COST = "CAST(coalesce(sum(CAST(cost_usd AS DECIMAL(18,6))), 0) AS DOUBLE)"

# --- cash flow

add("a13_finance_summary", finance.summary, f"""
SELECT CAST(coalesce(sum(amount) FILTER ({OWN} AND amount > 0), 0) AS DOUBLE) AS income, CAST(coalesce(sum(amount) FILTER ({OWN} AND amount < 0), 0) AS DOUBLE) AS expense,
       CAST(coalesce(sum(amount) FILTER ({OWN}), 0) AS DOUBLE) AS net, count(*) FILTER ({OWN}) AS tx_count, count(*) FILTER (category = 'uebertrag') AS transfer_count,
       CAST(coalesce(sum(amount) FILTER (category = 'uebertrag'), 0) AS DOUBLE) AS transfer_volume,
       (SELECT count(*) FROM st JOIN doc ON doc.id = st.doc_id WHERE deleted_at IS NULL) AS statement_count, (SELECT count(*) FROM acc) AS account_count FROM live""")
add("a13_finance_by_category", finance.by_category, f"SELECT category, {IN} AS income, {OUT} AS expense, count(*) AS n FROM live WHERE category <> '' GROUP BY category")
_MONTHLY = f"""
, m AS (SELECT substr(booking_date, 1, 7) AS month, {IN} AS income, {OUT} AS expense, count(*) AS n FROM live WHERE {DATED} AND {OWN} GROUP BY 1 %s),
spine AS (SELECT strftime(d, '%%Y-%%m') AS month FROM (SELECT unnest(generate_series(CAST(min(month) || '-01' AS DATE), CAST(max(month) || '-01' AS DATE), INTERVAL 1 MONTH)) AS d FROM m))
SELECT month, coalesce(income, 0.0) AS income, coalesce(expense, 0.0) AS expense, coalesce(n, 0) AS n FROM spine LEFT JOIN m USING (month)"""


def _monthly(limit: str) -> str:
    return sql("").rstrip() + (_MONTHLY % limit)


add("a14_monthly_cashflow", finance.monthly)
ORACLE_SQL["a14_monthly_cashflow"] = _monthly("")
add("a14_monthly_last_12", lambda a: finance.monthly(a, 12))
ORACLE_SQL["a14_monthly_last_12"] = _monthly("ORDER BY 1 DESC LIMIT 12")
for _d, _op, _o in (("expense", "<", "ASC"), ("income", ">", "DESC")):
    add(f"a15_top_counterparties_{_d}", lambda a, d=_d: finance.top_counterparties(a, d), f"""
SELECT min(counterparty) AS counterparty, count(*) AS times, CAST(sum(amount) AS DOUBLE) AS total FROM live
WHERE {OWN} AND amount {_op} 0 AND counterparty <> '' GROUP BY {_fold('counterparty')} ORDER BY sum(amount) {_o}, {_fold('counterparty')} LIMIT 15""")


def _recurring(live: str, months: int, tolerance: float) -> str:
    return f"""
SELECT counterparty, months, amount, min_amount, max_amount FROM (
  SELECT key, min(cp) AS counterparty, count(*) AS months, round(CAST(sum(CAST(mean AS DECIMAL(28,8))) AS DOUBLE) / count(*), 4) AS amount, min(mean) AS min_amount, max(mean) AS max_amount
  FROM (SELECT {_fold('counterparty')} AS key, substr(booking_date, 1, 7) AS month, min(counterparty) AS cp, CAST(sum(amount) AS DOUBLE) / count(*) AS mean FROM {live} WHERE counterparty <> '' AND {DATED} GROUP BY 1, 2) GROUP BY key)
WHERE months >= {months} AND abs(max_amount - min_amount) <= abs(amount) * {tolerance} ORDER BY months DESC, abs(amount) DESC, key LIMIT 30"""


#: Bookings that come again: an account pays one name, some of them amounts that vary too much.
_AGAIN = "SELECT booking_date, 'Abo ' || account_id AS counterparty, CAST(CASE WHEN account_id % 3 = 0 THEN -1 - id % 40 ELSE -10 - account_id - (id % 3) * 0.1 END AS DECIMAL(18,2)) AS amount"


def _paying_again(a: Archive) -> Archive:
    amount = F.when(F.col("account_id") % 3 == 0, -1 - F.col("id") % 40).otherwise(F.lit(-10) - F.col("account_id") - (F.col("id") % 3) * F.lit("0.1").cast("decimal(2,1)"))
    return replace(a, transactions=a.transactions.withColumn("counterparty", F.concat(F.lit("Abo "), F.col("account_id").cast("string"))).withColumn("amount", amount.cast("decimal(18,2)")))


add("a16_recurring_loose", lambda a: finance.recurring(a, 2, 0.9), _recurring("live", 2, 0.9))
add("a16_recurring", lambda a: finance.recurring(_paying_again(a)), _recurring(f"({_AGAIN} FROM live)", 3, 0.15))
add("a21_periods", finance.periods, f"SELECT DISTINCT kind, value FROM (SELECT 'month' AS kind, substr(booking_date, 1, 7) AS value FROM live WHERE {DATED} UNION ALL SELECT 'year', substr(booking_date, 1, 4) FROM live WHERE {DATED})")
_HEAT = f"SELECT booking_date AS date, {SPEND} AS spend, {IN} AS income, count(*) AS n FROM live WHERE {DATED} AND {OWN} AND %s GROUP BY 1"
add("a22_heatmap_busiest_year", finance.heatmap, _HEAT % f"substr(booking_date, 1, 4) = (SELECT substr(booking_date, 1, 4) AS y FROM live WHERE {DATED} GROUP BY 1 ORDER BY count(*) DESC, y DESC LIMIT 1)")
add("a22_heatmap_month", lambda a: finance.heatmap(a, month="1997-03"), _HEAT % "substr(booking_date, 1, 7) = '1997-03'")
add("w4_calendar_1997", lambda a: finance.calendar(a, "1997"), f"""
SELECT CAST(CAST(date_trunc('week', d) AS DATE) AS VARCHAR) AS week, CAST(isodow(d) - 1 AS INTEGER) AS dow, CAST(CAST(d AS DATE) AS VARCHAR) AS date, year(d) = 1997 AS in_year, coalesce(spend, 0.0) AS spend, coalesce(n, 0) AS n
FROM (SELECT unnest(generate_series(date_trunc('week', DATE '1997-01-01'), date_trunc('week', DATE '1997-12-31') + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS d)
LEFT JOIN ({_HEAT % "substr(booking_date, 1, 4) = '1997'"}) h ON h.date = CAST(CAST(d AS DATE) AS VARCHAR)""")
add("a37_heat_scale_1997", lambda a: finance.heat_scale(a, "1997"), f"""
SELECT greatest(coalesce(max(CASE WHEN place = greatest(floor(days * 0.9), 1) THEN spend END), 1.0), 1.0) AS scale
FROM (SELECT spend, row_number() OVER (ORDER BY spend) AS place, count(*) OVER () AS days FROM ({_HEAT % "substr(booking_date, 1, 4) = '1997'"}) WHERE spend > 0)""")
add("a23_category_monthly", finance.category_monthly, f"""
SELECT month, category, CAST(spend AS DOUBLE) AS spend, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT substr(booking_date, 1, 7) AS month, coalesce(nullif(category, ''), 'sonstiges') AS category, sum(-amount) AS spend, count(*) AS n FROM live WHERE {DATED} AND {OWN} AND amount < 0 GROUP BY 1, 2)
JOIN (SELECT coalesce(nullif(category, ''), 'sonstiges') AS category, row_number() OVER (ORDER BY sum(-amount) DESC, coalesce(nullif(category, ''), 'sonstiges')) AS rank FROM live WHERE {DATED} AND {OWN} AND amount < 0 GROUP BY 1) USING (category)""")
add("a23_category_matrix", lambda a: finance.category_matrix(a, ["building", "automobile"], "1996-01", "1997-12"), f"""
SELECT substr(booking_date, 1, 7) AS month, CAST(coalesce(sum(-amount) FILTER (category = 'building'), 0) AS DOUBLE) AS building, CAST(coalesce(sum(-amount) FILTER (category = 'automobile'), 0) AS DOUBLE) AS automobile
FROM live WHERE {DATED} AND {OWN} AND amount < 0 AND substr(booking_date, 1, 7) BETWEEN '1996-01' AND '1997-12' GROUP BY 1""")
add("a24_by_weekday", finance.by_weekday, f"""
SELECT dow, coalesce(spend, 0.0) AS spend, coalesce(avg_spend, 0.0) AS avg_spend, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(7)) AS INTEGER) AS dow)
LEFT JOIN (SELECT CAST(isodow(CAST(booking_date AS DATE)) - 1 AS INTEGER) AS dow, {SPEND} AS spend, {SPEND} / nullif(count(*) FILTER (amount < 0), 0) AS avg_spend, count(*) AS n FROM live WHERE {DATED} AND {OWN} GROUP BY 1) USING (dow)""")
add("a25_by_day_of_month", finance.by_day_of_month, f"""
SELECT dom, coalesce(spend, 0.0) AS spend, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(1, 32)) AS INTEGER) AS dom)
LEFT JOIN (SELECT CAST(day(CAST(booking_date AS DATE)) AS INTEGER) AS dom, {SPEND} AS spend, count(*) AS n FROM live WHERE {DATED} AND {OWN} GROUP BY 1) USING (dom)""")
add("a26_by_tx_type", finance.by_tx_type, f"SELECT coalesce(nullif(tx_type, ''), 'sonstiges') AS tx_type, {SPEND} AS spend, count(*) AS n FROM live WHERE {OWN} AND amount < 0 GROUP BY 1")
for _d, _op, _s in (("spend", "<", "-"), ("income", ">", "")):
    add(f"a27_category_totals_{_d}", lambda a, d=_d: finance.category_totals(a, "1996-02", "1999-01", d), f"""
SELECT coalesce(nullif(category, ''), 'sonstiges') AS category, CAST(sum({_s}amount) AS DOUBLE) AS total, count(*) AS n FROM live
WHERE {DATED} AND {OWN} AND amount {_op} 0 AND substr(booking_date, 1, 7) BETWEEN '1996-02' AND '1999-01' GROUP BY 1""")
add("a28_treemap", finance.treemap, f"""
SELECT trim({_fold('counterparty')}) AS key, max(counterparty) AS counterparty, count(*) AS times, {SPEND} AS spend, max(coalesce(nullif(category, ''), 'sonstiges')) AS dominant_category
FROM live WHERE {OWN} AND counterparty <> '' AND amount < 0 GROUP BY 1 ORDER BY spend DESC, key LIMIT 25""")
add("a29_kpis", finance.kpis, f"""
, own AS (SELECT * FROM live WHERE {OWN}), daily AS (SELECT sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS spend FROM own WHERE booking_date <> '' GROUP BY booking_date),
big AS (SELECT CAST(amount AS DOUBLE) AS biggest_amount, counterparty AS biggest_counterparty FROM own ORDER BY abs(amount) DESC, id LIMIT 1),
mon AS (SELECT substr(booking_date, 1, 7) AS busiest_month, count(*) AS busiest_month_n FROM own WHERE booking_date <> '' GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1),
cp AS (SELECT min(counterparty) AS top_counterparty, count(*) AS top_counterparty_n FROM own WHERE counterparty <> '' GROUP BY {_fold('counterparty')} ORDER BY 2 DESC, {_fold('counterparty')} LIMIT 1)
SELECT (SELECT CAST(sum(spend) AS DOUBLE) / count(*) FROM daily) AS avg_daily_spend, (SELECT CAST(max(spend) AS DOUBLE) FROM daily) AS peak_daily_spend, * FROM big, mon, cp""")
add("a35_accounts", finance.accounts, """
SELECT acc.id AS account_id, bank_name, iban_last4, coalesce(s.n, 0) AS statement_count, coalesce(t.n, 0) AS tx_count, coalesce(net, 0.0) AS net FROM acc
LEFT JOIN (SELECT account_id, count(*) AS n FROM st JOIN doc ON doc.id = st.doc_id WHERE deleted_at IS NULL GROUP BY 1) s ON s.account_id = acc.id
LEFT JOIN (SELECT account_id, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS net FROM live GROUP BY 1) t ON t.account_id = acc.id""")
add("o6_largest_transactions", finance.largest, f"""
SELECT t.id, booking_date, CAST(amount AS DOUBLE) AS amount, counterparty, category, purpose, doc_id, bank_name, iban_last4
FROM (SELECT * FROM live WHERE {OWN} ORDER BY abs(amount) DESC, id LIMIT 15) t LEFT JOIN acc ON acc.id = t.account_id""")
_ANCHOR = """SELECT account_id, period_start, CAST(opening_balance AS DOUBLE) AS opening_balance FROM (
  SELECT st.*, row_number() OVER (PARTITION BY account_id ORDER BY period_start, st.id) AS rn FROM st JOIN doc ON doc.id = st.doc_id WHERE deleted_at IS NULL AND opening_balance IS NOT NULL) WHERE rn = 1"""
add("w1_anchors", finance.anchors, _ANCHOR)
add("w2_balance_history", finance.balance_history, f"""
SELECT n.account_id, date, CAST(coalesce(CAST(opening_balance AS DECIMAL(18,2)), 0) + sum(net) OVER (PARTITION BY n.account_id ORDER BY date) AS DOUBLE) AS balance
FROM (SELECT account_id, booking_date AS date, sum(amount) AS net FROM live WHERE booking_date <> '' GROUP BY 1, 2) n LEFT JOIN ({_ANCHOR}) a ON a.account_id = n.account_id""")
add("j7_overrides", lambda a: finance.with_overrides(a).groupBy("category").agg(F.count("*").alias("n")), "SELECT CASE WHEN id % 50 = 0 THEN 'freizeit' ELSE category END AS category, count(*) AS n FROM tx GROUP BY 1")

# --- explorer

_FILTERS = {
    "all": (TransactionFilter(), "true"),
    "expense_text": (TransactionFilter(direction="expense", text="urgent, #00000001", start="1996-01-01", end="1998-12-31", exclude_transfers=True), f"amount < 0 AND booking_date BETWEEN '1996-01-01' AND '1998-12-31' AND (category IS NULL OR {OWN}) AND ({' OR '.join(f'contains({_fold(c)}, {v!r})' for v in ('urgent', '#00000001') for c in ('counterparty', 'purpose'))})"),
    "account_amount": (TransactionFilter(account_id=3, amount_min=1000, amount_max=150000.5), "account_id = 3 AND abs(amount) BETWEEN 1000 AND 150000.5"),
    "other": (TransactionFilter(category="sonstiges", direction="income"), "coalesce(nullif(category, ''), 'sonstiges') = 'sonstiges' AND amount > 0"),
}
for _n, (_f, _w) in _FILTERS.items():
    add(f"l4_transactions_{_n}", lambda a, f=_f: explorer.page(a, f, 200, 20), f"""
SELECT t.id, booking_date, CAST(amount AS DOUBLE) AS amount, counterparty, purpose, category, account_id, doc_id, bank_name, iban_last4
FROM (SELECT * FROM live WHERE {_w} ORDER BY booking_date DESC, id DESC LIMIT 200 OFFSET 20) t LEFT JOIN acc ON acc.id = t.account_id""")
    add(f"a17_totals_{_n}", lambda a, f=_f: explorer.totals(a, f), f"""
SELECT count(*) AS count, {IN} AS sum_in, {OUT} AS sum_out, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS sum_net, coalesce(min(booking_date), '') AS first_date, coalesce(max(booking_date), '') AS last_date FROM live WHERE {_w}""")
    add(f"a19_months_{_n}", lambda a, f=_f: explorer.months(a, f), f"SELECT substr(booking_date, 1, 7) AS month, {IN} AS sum_in, {OUT} AS sum_out, count(*) AS n FROM live WHERE {_w} AND {DATED} GROUP BY 1 ORDER BY 1 DESC LIMIT 36")
    add(f"a20_categories_{_n}", lambda a, f=_f: explorer.categories(a, f), f"SELECT coalesce(nullif(category, ''), 'sonstiges') AS cat, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM live WHERE {_w} GROUP BY 1")
    _f, _w = replace(_f, direction=None), _w.replace("amount < 0 AND ", "").replace(" AND amount > 0", "")  # the top lists have directions of their own
    for _d, _op, _o in (("expense", "<", "ASC"), ("income", ">", "DESC")):
        add(f"a18_top_{_d}_{_n}", lambda a, f=_f, d=_d: explorer.top(a, f, d), f"""
SELECT min(coalesce(nullif(counterparty, ''), '—')) AS counterparty, count(*) AS times, CAST(sum(amount) AS DOUBLE) AS total FROM live WHERE {_w} AND amount {_op} 0
GROUP BY {_fold("coalesce(nullif(counterparty, ''), '—')")} ORDER BY sum(amount) {_o}, {_fold("coalesce(nullif(counterparty, ''), '—')")} LIMIT 10""")

# --- library

_TOKENS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"))
add("a1_library_totals", library.totals, f"SELECT count(*) AS n, {_TOKENS}, {COST} AS cost_usd, count(*) FILTER (status = 'duplicate') AS duplicates FROM lib")
add("a2_by_category", lambda a: library.counts_by(a, "category"), f"SELECT category, count(*) AS n, {COST} AS cost_usd FROM lib GROUP BY 1")
add("a3_by_status", lambda a: library.counts_by(a, "status"), f"SELECT status, count(*) AS n, {COST} AS cost_usd FROM lib GROUP BY 1")
add("a4_by_month", library.by_month, f"SELECT substr(created_at, 1, 7) AS month, count(*) AS n, {COST} AS cost_usd FROM lib GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
add("a5_trash_count", lambda a: library.count(a, trash=True), "SELECT count(*) AS n FROM doc WHERE deleted_at IS NOT NULL AND category <> '_csv_container'")
add("a6_count", lambda a: library.count(a, DocumentFilter(category="src1", status="filed")), "SELECT count(*) AS n FROM lib WHERE category = 'src1' AND status = 'filed'")
add("a7_years", library.years, "SELECT DISTINCT substr(doc_date, 1, 4) AS year FROM lib WHERE doc_date <> ''")
add("a8_tree", library.tree, f"""
SELECT year, category, count(*) AS n, {COST} AS cost_usd, CAST(grouping(year) * 2 + grouping(category) AS INTEGER) AS level
FROM (SELECT coalesce(nullif(substr(doc_date, 1, 4), ''), '—') AS year, category, cost_usd FROM lib) GROUP BY ROLLUP (year, category)""")
add("a9_tags", library.tags, "SELECT tag, count(*) AS count FROM (SELECT unnest(tags) AS tag FROM lib) GROUP BY 1")
_COLUMNS = ["id", "filename", "category", "subcategory", "doc_date", "sender", "status", "created_at"]
_SORTED = "coalesce(nullif(doc_date, ''), created_at) DESC, id DESC"
_LISTINGS = {
    "default": ({}, DocumentFilter(), "true", _SORTED),
    "sender_asc": ({"order_by": "sender", "direction": "asc", "limit": 50, "offset": 10}, DocumentFilter(category="src2", subcategory="en"), "category = 'src2' AND subcategory = 'en'", "sender ASC, id DESC"),
    "year": ({"order_by": "file_size"}, DocumentFilter(year="2025", status="filed"), "substr(doc_date, 1, 4) = '2025' AND status = 'filed'", "file_size DESC, id DESC"),
    "unknown": ({}, DocumentFilter(year="unknown"), "(doc_date IS NULL OR doc_date = '')", _SORTED),
    "tag": ({}, DocumentFilter(tag="prüfen"), "list_contains(tags, 'prüfen')", _SORTED),
    "dates": ({}, DocumentFilter(doc_from="2024-06-01", doc_to="2026-06-30", scan_from="2024-03-01", scan_to="2025-01-31"), "doc_date BETWEEN '2024-06-01' AND '2026-06-30' AND substr(created_at, 1, 10) BETWEEN '2024-03-01' AND '2025-01-31'", _SORTED),
}
for _n, (_k, _f, _w, _o) in _LISTINGS.items():
    add(f"l1_listing_{_n}", lambda a, k=_k, f=_f: library.listing(a, f, **k).select(*_COLUMNS), f"SELECT {', '.join(_COLUMNS)} FROM lib WHERE {_w} ORDER BY {_o} LIMIT {_k.get('limit', 200)} OFFSET {_k.get('offset', 0)}")
add("f7_trash_listing", lambda a: library.listing(a, trash=True).select(*_COLUMNS), f"SELECT {', '.join(_COLUMNS)} FROM doc WHERE deleted_at IS NOT NULL ORDER BY {_SORTED} LIMIT 200")
add("w3_siblings", lambda a: library.siblings(a, 24), f"""
SELECT id, CAST(position AS INTEGER) AS position, total, prev_id, next_id FROM (SELECT id, row_number() OVER w AS position, count(*) OVER () AS total, lead(id) OVER w AS prev_id, lag(id) OVER w AS next_id
FROM (SELECT * FROM lib ORDER BY {_SORTED} LIMIT 5000) WINDOW w AS (ORDER BY {_SORTED})) WHERE id = 24""")
add("a30_duplicate_groups", library.duplicate_groups, "SELECT content_hash, count(*) AS n, list(id ORDER BY created_at, id) AS ids FROM lib WHERE content_hash <> '' GROUP BY 1 HAVING count(*) > 1")
add("a30_duplicate_members", library.duplicate_members, "SELECT content_hash, n, id, CAST(place AS INTEGER) AS place FROM (SELECT content_hash, count(*) OVER (PARTITION BY content_hash) AS n, id, row_number() OVER (PARTITION BY content_hash ORDER BY created_at, id) AS place FROM lib WHERE content_hash <> '') WHERE n > 1")
add("a32_duplicate_waste", library.duplicate_waste, """
SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extras, CAST(coalesce(sum(size * (n - 1)), 0) AS BIGINT) AS wasted_bytes
FROM (SELECT count(*) AS n, first(file_size ORDER BY created_at, id) AS size FROM lib WHERE content_hash <> '' GROUP BY content_hash HAVING count(*) > 1)""")
add("a33_dashboard", lambda a: library.dashboard(a, "2024-03-05"), """
SELECT count(*) AS total, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'processing') AS processing,
       count(*) FILTER (substr(created_at, 1, 10) = '2024-03-05') AS today, (SELECT count(*) FROM st WHERE doc_id IN (SELECT id FROM doc WHERE deleted_at IS NULL) AND id NOT IN (SELECT statement_id FROM tx)) AS empty_statements FROM lib""")
add("a34_queue", lambda a: library.count(a, DocumentFilter(status="review")), "SELECT count(*) AS n FROM lib WHERE status = 'review'")
add("o8_recent", library.feed, "SELECT id, filename, status, created_at FROM lib ORDER BY created_at DESC, id DESC LIMIT 20")
add("o8_problems", lambda a: library.feed(a, ["review", "failed"], 30), "SELECT id, filename, status, created_at FROM lib WHERE status IN ('review', 'failed') ORDER BY created_at DESC, id DESC LIMIT 30")
add("j6_without_receipt", lambda a: library.without_receipt(a, ["src0", "src1", "src2"]), "SELECT id, category FROM lib WHERE category IN ('src0', 'src1', 'src2') AND id NOT IN (SELECT doc_id FROM rc)")
add("l10_backfill", lambda a: library.to_backfill(a, ["src1"]), "SELECT id, category FROM lib WHERE status = 'filed' AND (len(tags) = 0 OR (category = 'src1' AND coalesce(subcategory, '') = ''))")
add("s15_export_selection", lambda a: library.export_selection(a, DocumentFilter(status="filed")), "SELECT library_path, min(id) AS id FROM lib WHERE status = 'filed' GROUP BY 1")
add("l9_latest_by_name", lambda a: library.latest_by_name(a, "scan-7.pdf"), "SELECT id, original_name, status FROM doc WHERE original_name = 'scan-7.pdf' ORDER BY id DESC LIMIT 1")
add("c21_collision_suffix", lambda a: library.with_collision_suffix(library.library(a).select("id", "library_path")), """
SELECT id, library_path, CASE WHEN place = 1 THEN library_path ELSE replace(library_path, '.pdf', '') || '-' || place || '.pdf' END AS final_path
FROM (SELECT id, library_path, row_number() OVER (PARTITION BY library_path ORDER BY id) AS place FROM lib)""")

# --- receipts

add("a10_receipt_summary", receipts.summary, "SELECT count(*) AS receipt_count, CAST(coalesce(sum(total_amount), 0) AS DOUBLE) AS total_spent, CAST(coalesce(sum(total_amount), 0) AS DOUBLE) / nullif(count(*), 0) AS avg_receipt, (SELECT count(*) FROM lit) AS item_count FROM lrc")
add("a10_by_shop_type", receipts.by_shop_type, "SELECT shop_type, count(*) AS n, CAST(sum(total_amount) AS DOUBLE) AS total FROM lrc WHERE shop_type <> '' GROUP BY 1")
add("a10_by_item_category", receipts.by_item_category, "SELECT item_category, count(*) AS n, CAST(sum(total_price) AS DOUBLE) AS total FROM lit WHERE item_category <> '' GROUP BY 1")
add("a11_receipts_monthly", receipts.monthly, "SELECT substr(receipt_date, 1, 7) AS month, count(*) AS receipts, CAST(sum(total_amount) AS DOUBLE) AS total FROM lrc WHERE receipt_date <> '' GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
add("f13_receipts_list", lambda a: receipts.listing(a, "1-URGENT", "1996-01-01", "1997-12-31"), """
SELECT rc.id, rc.doc_id, shop_name, shop_type, CAST(total_amount AS DOUBLE) AS total_amount, receipt_date, doc.subject AS doc_subject, doc.library_path FROM rc JOIN doc ON doc.id = rc.doc_id
WHERE deleted_at IS NULL AND shop_type = '1-URGENT' AND receipt_date BETWEEN '1996-01-01' AND '1997-12-31' ORDER BY receipt_date DESC, rc.id DESC LIMIT 200""")
add("f14_item_search", lambda a: receipts.search_items(a, query="Widget", start="1996-01-01"), f"""
SELECT id, receipt_id, name, CAST(total_price AS DOUBLE) AS total_price, item_category, line_no, shop_name, shop_type, receipt_date, doc_id FROM lit
WHERE contains({_fold('name')}, 'widget') AND receipt_date >= '1996-01-01' ORDER BY receipt_date DESC, receipt_id DESC, line_no LIMIT 200""")
add("j9_items_of_receipts", receipts.items_of_receipts, "SELECT receipt_id, list(name ORDER BY line_no, id, name) AS items FROM lit GROUP BY 1")
add("a12_top_items", receipts.top_items, f"""
SELECT min(name) AS name, count(*) AS times, CAST(sum(total_price) AS DOUBLE) AS spent, CAST(sum(unit_price) AS DOUBLE) / count(unit_price) AS avg_unit FROM lit WHERE name <> ''
GROUP BY {_fold('name')} ORDER BY times DESC, sum(total_price) DESC, {_fold('name')} LIMIT 10""")


#: What is put after the texts of some documents, so that some look like receipts, and some like invoices as well.
_TILL = ["Bon-Nr 12 Es bediente Sie Frau K. zu zahlen PFAND", "girocard Bonuspunkte: 3 Rechnungs-Nr: A1 zahlbar bis 1.1.", "Kasse 4 Laden Nord MwSt A 19,00 %", "kontaktlos", "Rechnungsnummer: 5 Rueckgeld 1,20 KASSENBON"]
_SHOPS = ("Laden Nord", "Kaufhaus")


def _with_till_texts(a: Archive) -> Archive:
    tail = F.element_at(F.array(*map(F.lit, _TILL)), F.expr("CAST((id DIV 3) % 5 + 1 AS INT)"))
    return replace(a, documents=a.documents.withColumn("extracted_text", F.concat("extracted_text", F.lit(" "), tail)), receipts=a.receipts.where("doc_id % 4 = 0"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _named(rules: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(till, {_quoted('(?i)' + p)}) THEN '{n}' END" for n, p in rules) + "], lambda x: x IS NOT NULL)"


add("c17_misfiled_receipts", lambda a: receipts.misfiled(_with_till_texts(a), ["src0", "src3"], shops=_SHOPS), f"""
SELECT id, category, subject, signals, CAST(len(signals) AS INTEGER) AS signal_count FROM (SELECT id, category, subject, {_named(rules.with_shops(_SHOPS))} AS signals, {_named(rules.BLOCKERS)} AS blockers FROM (
  SELECT *, extracted_text || ' ' || [{", ".join(map(_quoted, _TILL))}][(id // 3) % 5 + 1] AS till FROM doc WHERE deleted_at IS NULL AND category IN ('src0', 'src3') AND extracted_text <> '' ORDER BY id DESC LIMIT 1000)
  WHERE id NOT IN (SELECT doc_id FROM rc WHERE doc_id % 4 = 0)) WHERE len(signals) >= 2 AND len(blockers) < 2 ORDER BY id DESC LIMIT 200""")

# --- search

_indexes: dict[tuple[str, str], str] = {}


def _searched(query: Callable[[Archive, versions.Store], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that answers from the stored index of the library, which is built once for a session and folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, key = stand_ins(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
        if key not in _indexes:
            root = scratch(spark)
            search_index.update_index(versions.Store(spark, root), add=library.library(a).select("id", *(c for c in search.FIELDS if c in a.documents.columns)))
            _indexes[key] = root
        return query(a, versions.Store(spark, _indexes[key]))

    return run


def add_searched(name: str, query: Callable[[Archive, versions.Store], DataFrame], body: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = _searched(query), sql(body)


def _found(a: Archive, store: versions.Store, query: str) -> DataFrame:
    return library.library(a).select("id", "category").join(search_index.found(store, query), "id", "left_semi")


add_searched("x3_search_prefix", lambda a, i: _found(a, i, "the ent"), f"SELECT id, category FROM lib WHERE {_matches('the')} AND {_matches('ent')}")
add_searched("x3_search_umlaut", lambda a, i: _found(a, i, "Über"), f"SELECT id, category FROM lib WHERE {_matches('uber')}")
add("x3_search_scan", lambda a: search.match(a, "the ent"), f"SELECT id, category FROM lib WHERE {_matches('the')} AND {_matches('ent')}")


def _index_after_changes(a: Archive) -> DataFrame:
    """An index from which documents went, in which others have another text, and which is one segment again."""
    docs = library.library(a).select("id", *(c for c in search.FIELDS if c in a.documents.columns))
    store = versions.Store(a.accounts.sparkSession, scratch(a.accounts.sparkSession))
    search_index.update_index(store, add=docs)
    edited = docs.where("id % 7 = 1 AND id % 5 <> 0").withColumn("extracted_text", F.concat(F.lit("brandneu the entwurf "), F.col("id").cast("string")))
    search_index.update_index(store, add=edited, remove=docs.where("id % 5 = 0 OR id % 7 = 1"))
    before = store.current()
    search_index.compact(store)
    each = [search_index.found(store, q, v).select(F.lit(n).alias("step"), F.lit(q).alias("query"), "id") for n, v in (("changed", before), ("compacted", store.current())) for q in ("brandneu", "the ent")]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


_EDITED_TEXT = "CASE WHEN id % 7 = 1 THEN 'brandneu the entwurf ' || id ELSE extracted_text END"
add("x2_index_after_changes", _index_after_changes, f"""
SELECT step, query, id FROM (SELECT unnest(['changed', 'compacted']) AS step), (
  SELECT 'brandneu' AS query, id FROM (SELECT * REPLACE ({_EDITED_TEXT} AS extracted_text) FROM lib WHERE id % 5 <> 0) WHERE {_matches('brandneu')}
  UNION ALL SELECT 'the ent', id FROM (SELECT * REPLACE ({_EDITED_TEXT} AS extracted_text) FROM lib WHERE id % 5 <> 0) WHERE {_matches('the')} AND {_matches('ent')})""")


def _ranked(prefixes: list[str]) -> str:
    """bm25 over all fields of the documents that have a token with each prefix."""
    term = "CASE " + " ".join(f"WHEN starts_with(token, '{p}') THEN {i}" for i, p in enumerate(prefixes)) + " END"
    return f"""(WITH tok AS (SELECT id, unnest(regexp_extract_all(lower(strip_accents(body)), '[\\p{{L}}\\p{{N}}]+')) AS token FROM (SELECT id, unnest([filename, sender, subject, extracted_text]) AS body FROM lib)),
  len AS (SELECT id, count(*) AS length FROM tok GROUP BY 1), whole AS (SELECT count(*) AS docs, avg(length) AS mean FROM len),
  tf AS (SELECT id, {term} AS term, count(*)::DOUBLE AS tf FROM tok WHERE {term} IS NOT NULL GROUP BY 1, 2),
  idf AS (SELECT term, greatest(1e-6::DOUBLE, ln((docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE))) AS idf FROM (SELECT term, count(*) AS n FROM tf GROUP BY 1), whole)
  SELECT id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score FROM tf JOIN idf USING (term) JOIN len USING (id), whole GROUP BY id HAVING count(*) = {len(prefixes)})"""


add_searched("x4_search_ranked", lambda a, i: search_index.best(i, "thonre sender"), f"SELECT id, score FROM {_ranked(['thonre', 'sender'])} ORDER BY score DESC, id LIMIT 50")
add_searched("l1_listing_search", lambda a, i: search_index.listing(a, i, "the ent", DocumentFilter(status="filed"), order_by="sender", direction="asc", limit=50).select(*_COLUMNS), f"SELECT {', '.join(_COLUMNS)} FROM lib WHERE {_matches('the')} AND {_matches('ent')} AND status = 'filed' ORDER BY sender ASC, id DESC LIMIT 50")
add_searched("l1_listing_relevance", lambda a, i: search_index.listing(a, i, "thonre", DocumentFilter(status="filed"), order_by="relevance", limit=40).select("id", "status"), f"SELECT id, status FROM lib JOIN {_ranked(['thonre'])} USING (id) WHERE status = 'filed' ORDER BY score DESC, id DESC LIMIT 40")

# --- bank files: rows of a file built from the bookings, parsed, and parsed again


_BOOKED = ["Überweisung", "FOLGELASTSCHRIFT", "Kartenzahlung girocard", "Buchung"]


def _bank_rows(a: Archive) -> DataFrame:
    t = a.transactions
    day = F.concat_ws(".", F.substring("booking_date", 9, 2), F.substring("booking_date", 6, 2), F.when(F.col("id") % 2 == 0, F.substring("booking_date", 3, 2)).otherwise(F.substring("booking_date", 1, 4)))
    amount = F.translate(F.format_number(F.col("amount"), 2), ".,", ",.")
    blank = F.lit("")
    return t.select(
        F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("path"), F.col("id").cast("int").alias("line_no"), F.when(F.col("id") % 11 == 0, "").otherwise(F.concat(F.lit("de "), F.lpad(F.col("account_id").cast("string"), 4, "0"))).alias("account"),
        F.when(F.col("id") % 13 == 0, "31.13.2024").otherwise(day).alias("booking_date"), blank.alias("value_date"), F.element_at(F.array(*map(F.lit, _BOOKED)), (F.col("id") % 4 + 1).cast("int")).alias("booking_text"), F.col("purpose"), blank.alias("creditor_id"),
        F.col("counterparty"), blank.alias("counterparty_iban"), F.when(F.col("id") % 17 == 0, "abc").otherwise(amount).alias("amount"), blank.alias("currency"), blank.alias("info"), F.lit(None).cast("string").alias("problem"),
    )


_PARSED = """SELECT 'f' || CAST(id % 3 AS VARCHAR) AS path, CAST(id AS INTEGER) AS line_no, CASE WHEN id % 11 = 0 THEN 'skipped' WHEN id % 13 = 0 OR id % 17 = 0 THEN 'invalid' ELSE 'ok' END AS status,
  CASE WHEN id % 13 <> 0 THEN booking_date END AS booking_date, CASE WHEN id % 17 <> 0 THEN CAST(amount AS DOUBLE) END AS amount, ['ueberweisung', 'lastschrift', 'kartenzahlung', 'sonstiges'][id % 4 + 1] AS tx_type FROM tx"""
add("s5_bank_rows", lambda a: bank_csv.parse(_bank_rows(a)).select("path", "line_no", "status", "booking_date", F.col("amount").cast("double").alias("amount"), "tx_type"), _PARSED)
add("a38_import_report", lambda a: bank_csv.report(bank_csv.parse(_bank_rows(a)), bank_csv.parse(_bank_rows(a)).where("line_no % 5 = 0").select("tx_hash")), f"""
SELECT path, count(*) AS rows, count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'skipped') AS skipped, CAST(0 AS BIGINT) AS errors, count(*) FILTER (status = 'ok' AND line_no % 5 <> 0) AS imported,
       count(*) FILTER (status = 'ok' AND line_no % 5 = 0) AS duplicates, min(booking_date) FILTER (status = 'ok') AS first_date, max(booking_date) FILTER (status = 'ok') AS last_date FROM ({_PARSED}) GROUP BY path""")



def _kept(df: DataFrame) -> DataFrame:
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _csv_import(a: Archive) -> DataFrame:
    """Files are written, imported and imported again: the accounts and bookings that came of it."""
    headers = {"Auftragskonto": F.concat(F.lit("DE00 "), F.lpad(F.col("account_id").cast("string"), 4, "0")), "Buchungstag": F.date_format(F.col("booking_date").cast("date"), "dd.MM.yyyy"), "Buchungstext": F.lit("LASTSCHRIFT"), "Verwendungszweck": F.col("purpose"), "Beguenstigter/Zahlungspflichtiger": F.col("counterparty"), "Betrag": F.translate(F.format_number("amount", 2), ".,", ",."), "Waehrung": F.lit("EUR")}
    folder = scratch(a.accounts.sparkSession)
    a.transactions.select(*(c.alias(h) for h, c in headers.items())).write.csv(folder, header=True, sep=";")
    once, _ = bank_csv.import_files(a, [folder], "2026-01-01")
    once = replace(once, accounts=_kept(once.accounts), transactions=_kept(once.transactions))  # what is stored after an import
    twice, _ = bank_csv.import_files(replace(once, transactions=once.transactions.where("statement_id IS NULL")), [folder], "2026-01-02")
    own = twice.accounts.select(F.col("id").alias("account_id"), "iban_last4", "bank_name")
    rows = twice.transactions.where("statement_id IS NULL").join(own, "account_id")
    return rows.groupBy("iban_last4", "bank_name", "tx_type").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"), F.min("booking_date").alias("first_date"))


add("s7_csv_import", _csv_import, """SELECT lpad(CAST(account_id AS VARCHAR), 4, '0') AS iban_last4, 'Sparkasse' AS bank_name, 'lastschrift' AS tx_type, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, min(booking_date) AS first_date
FROM (SELECT DISTINCT account_id, booking_date, amount, counterparty, purpose FROM tx) GROUP BY account_id""")

# --- scalars over the documents

add("c9_dates", lambda a: a.documents.select("id", scalars.normalise_date(F.when(F.col("id") % 2 == 0, F.date_format(F.col("doc_date").cast("date"), "d.M.yy")).otherwise(F.date_format(F.col("doc_date").cast("date"), "yyyy/MM/dd"))).alias("date")), "SELECT id, doc_date AS date FROM doc")
add("c20_target_paths", lambda a: a.documents.select("id", scalars.target_path(F.col("doc_date"), F.col("category"), F.col("subcategory")).alias("path")), "SELECT id, coalesce(substr(doc_date, 1, 4), 'unknown') || '/' || category || '/' || subcategory AS path FROM doc")
add("c22_token_costs", lambda a: a.documents.select("id", F.round(scalars.token_cost(F.lit("anthropic"), F.when(F.col("id") % 3 == 0, "claude-haiku-4-5-20251001").otherwise("claude-sonnet-4-6"), F.col("input_tokens"), F.col("output_tokens"), F.col("cache_creation_tokens"), F.col("cache_read_tokens")), 9).alias("usd")), """
SELECT id, round((input_tokens * p + output_tokens * q + cache_creation_tokens * p * 1.25 + cache_read_tokens * p * 0.1) / 1e6, 9) AS usd
FROM (SELECT *, CAST(CASE WHEN id % 3 = 0 THEN 1.0 ELSE 3.0 END AS DOUBLE) AS p, CAST(CASE WHEN id % 3 = 0 THEN 5.0 ELSE 15.0 END AS DOUBLE) AS q FROM doc)""")

_PRICED = ", ".join(f"('{p}', '{m}', {i}, {o}, {n})" for n, (p, m, i, o) in enumerate(scalars.PRICES))
_MODELS = [m for _, m, _, _ in scalars.PRICES] + ["local"]
_MODEL_OF = f"{_MODELS}[CAST(id % {len(_MODELS)} AS INTEGER) + 1] || '-x'"


def _with_models(a: Archive) -> DataFrame:
    return a.documents.withColumn("model", F.concat(F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("id") % len(_MODELS) + 1).cast("int")), F.lit("-x")))


add("s16_pricing", lambda a: scalars.priced(_with_models(a).select("id", "model")), f"""
SELECT id, any_value(d.model) AS model, arg_min(v.provider, place) AS provider, CAST(arg_min(v.i, place) AS DOUBLE) AS input_per_mtok, CAST(arg_min(v.o, place) AS DOUBLE) AS output_per_mtok
FROM (SELECT id, {_MODEL_OF} AS model FROM doc) d LEFT JOIN (VALUES {_PRICED}) AS v(provider, model, i, o, place) ON starts_with(d.model, v.model) GROUP BY id""")


def _costs(a: Archive) -> DataFrame:
    rows = scalars.priced(_with_models(a).select("id", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"))
    tokens = (F.col(c) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"))
    return rows.select("id", F.round(scalars.token_cost(F.coalesce("provider", F.lit("local")), F.col("model"), *tokens), 9).alias("usd"))


add("c22_costs_of_all_providers", _costs, f"""
SELECT id, coalesce(round((input_tokens * i + output_tokens * o + cache_creation_tokens * i * CASE provider WHEN 'anthropic' THEN 1.25 WHEN 'openai' THEN 1.0 ELSE 0.0 END::DOUBLE + cache_read_tokens * i * CASE provider WHEN 'anthropic' THEN 0.1 WHEN 'openai' THEN 0.5 ELSE 0.0 END::DOUBLE) / 1e6, 9), 0.0) AS usd
FROM (SELECT d.*, p.provider, p.i, p.o FROM doc d LEFT JOIN (SELECT e.id AS of, arg_min(v.provider, place) AS provider, CAST(arg_min(v.i, place) AS DOUBLE) AS i, CAST(arg_min(v.o, place) AS DOUBLE) AS o
  FROM (SELECT id, {_MODEL_OF} AS model FROM doc) e JOIN (VALUES {_PRICED}) AS v(provider, model, i, o, place) ON starts_with(e.model, v.model) GROUP BY e.id) p ON p.of = d.id)""")
add("c23_display", lambda a: a.documents.select("id", scalars.display_size(F.col("file_size")).alias("size"), scalars.display_age(F.col("created_at"), F.lit("2025-07-01T12:00:00")).alias("age")), """
SELECT id, CASE WHEN file_size = 0 THEN '–' WHEN file_size < 1024 THEN file_size || ' B' ELSE printf('%.1f KB', round(file_size / 1024.0, 1)) END AS size, (date_diff('second', CAST(created_at AS TIMESTAMP), TIMESTAMP '2025-07-01 12:00:00') // 86400) || 'd' AS age FROM doc""")
add("c12_import_hashes", lambda a: a.transactions.join(a.accounts.select(F.col("id").alias("account_id"), "iban_hash"), "account_id").select("id", scalars.tx_hash(F.col("iban_hash"), F.col("booking_date"), F.col("amount"), F.col("counterparty"), F.col("purpose")).alias("hash")), "SELECT tx.id, sha256(iban_hash || '|' || booking_date || '|' || amount || '|' || counterparty || '|' || purpose) AS hash FROM tx JOIN acc ON acc.id = account_id")
add("c18_slugs", lambda a: a.documents.select("id", scalars.slug(F.concat(F.lit("Größe & "), F.col("filename"))).alias("slug")), "SELECT id, 'groesse-' || trim(regexp_replace(lower(filename), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM doc")
add("c28_decoded_tags", lambda a: a.documents.select("id", F.size(scalars.decode_tags(F.when(F.col("id") % 3 == 0, "[broken").otherwise(F.to_json("tags")))).alias("n")), "SELECT id, CASE WHEN id % 3 = 0 THEN 0 ELSE CAST(len(tags) AS INTEGER) END AS n FROM doc")
add("c29_last_month", lambda a: a.documents.where("doc_date IS NOT NULL").select("id", *(d.cast("string").alias(n) for n, d in zip(("first", "last"), scalars.date_preset(F.col("doc_date").cast("date"), "last_month")))), "SELECT id, CAST(CAST(date_trunc('month', CAST(doc_date AS DATE)) - INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS first, CAST(CAST(date_trunc('month', CAST(doc_date AS DATE)) - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS last FROM doc WHERE doc_date IS NOT NULL")
add("f1_by_id", lambda a: library.by_id(a, 24).select(*_COLUMNS), f"SELECT {', '.join(_COLUMNS)} FROM doc WHERE id = 24")
add("f1_by_hash", lambda a: library.latest_by_hashes(a, a.documents.where("id % 11 = 7")), "SELECT max(id) AS id, content_hash FROM doc WHERE content_hash IN (SELECT content_hash FROM doc WHERE id % 11 = 7) AND deleted_at IS NULL GROUP BY content_hash")
add("f15_statement_by_file", lambda a: finance.statements_by_files(a, a.statements.where("id % 7 = 3")).select("id", "account_id", "period_start"), "SELECT id, account_id, period_start FROM st WHERE id % 7 = 3")

# --- pages: after a key, and from one reading


def _third_page(a: Archive) -> DataFrame:
    last = None
    for _ in range(2):  # two rows to the driver
        row = library.page_after(a, last, order_by="status", direction="asc", limit=40).orderBy(F.desc("page_key"), "id").first()
        last = (row.page_key, row.id) if row else last
    return library.page_after(a, last, order_by="status", direction="asc", limit=40).select(*_COLUMNS)


add("o5_page_after_key", _third_page, f"SELECT {', '.join(_COLUMNS)} FROM lib ORDER BY status ASC, id DESC LIMIT 40 OFFSET 80")
add("o5_bookings_after_key", lambda a: explorer.page_after(a, TransactionFilter(direction="expense"), ("1998-03-04", 1000), 100), """
SELECT t.id, booking_date, CAST(amount AS DOUBLE) AS amount, counterparty, purpose, category, account_id, doc_id, bank_name, iban_last4
FROM (SELECT * FROM live WHERE amount < 0 AND (booking_date < '1998-03-04' OR (booking_date = '1998-03-04' AND id < 1000)) ORDER BY booking_date DESC, id DESC LIMIT 100) t LEFT JOIN acc ON acc.id = t.account_id""")
_ON_PAGE = {"by_category": "a13_finance_by_category", "monthly": "a14_monthly_cashflow", "top_counterparties_expense": "a15_top_counterparties_expense", "top_counterparties_income": "a15_top_counterparties_income", "periods": "a21_periods", "heatmap": "a22_heatmap_busiest_year", "category_monthly": "a23_category_monthly", "by_weekday": "a24_by_weekday", "by_day_of_month": "a25_by_day_of_month", "by_tx_type": "a26_by_tx_type", "treemap": "a28_treemap", "kpis": "a29_kpis", "accounts": "a35_accounts", "balance_history": "w2_balance_history"}
#: Of each result a name, a number and a sum of what it holds.
_NUMBERS = {"summary": "net", "by_category": "expense", "monthly": "income", "top_counterparties_expense": "total", "top_counterparties_income": "total", "periods": None, "heatmap": "spend", "category_monthly": "spend", "by_weekday": "avg_spend", "by_day_of_month": "spend", "by_tx_type": "spend", "treemap": "spend", "kpis": "biggest_amount", "accounts": "net", "balance_history": "balance"}


def _page(a: Archive) -> DataFrame:
    """A row for each result of the finance page: how many rows it has and the sum of one of its columns."""
    out = None
    for name, rows in finance_page.page(a).items():
        if name in _NUMBERS:
            total = F.round(F.sum(F.col(_NUMBERS[name]).cast("decimal(28,6)")), 2).cast("double") if _NUMBERS[name] else F.lit(0.0)
            one = rows.agg(F.lit(name).alias("result"), F.count("*").alias("n"), total.alias("total"))
            out = one if out is None else out.unionByName(one)
    return out


def _counted(parts: dict[str, DataFrame], numbers: dict[str, str | None]) -> DataFrame:
    """A row for each part of a page: how many rows it has and the sum of one of its columns."""
    out = None
    for name, c in numbers.items():
        one = parts[name].agg(F.lit(name).alias("part"), F.count("*").alias("n"), (F.round(F.sum(F.col(c).cast("decimal(28,6)")), 2).cast("double") if c else F.lit(0.0)).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


def _counted_sql(parts: dict[str, tuple[str, str | None]]) -> str:
    return " UNION ALL ".join(f"(SELECT '{name}' AS part, count(*) AS n, {f'CAST(round(sum(CAST({c} AS DECIMAL(28,6))), 2) AS DOUBLE)' if c else '0.0::DOUBLE'} AS total FROM ({body}))" for name, (body, c) in parts.items())


_LIBRARY_PAGE = {
    "documents": (f"SELECT id FROM lib WHERE status = 'filed' ORDER BY {_SORTED} LIMIT 500", "id"), "years": ("SELECT DISTINCT substr(doc_date, 1, 4) AS year FROM lib WHERE doc_date <> ''", "year"),
    "tree": ("SELECT coalesce(nullif(substr(doc_date, 1, 4), ''), '—') AS year, category, count(*) AS n FROM lib GROUP BY ROLLUP (year, category)", "n"), "tags": ("SELECT tag, count(*) AS count FROM (SELECT unnest(tags) AS tag FROM lib) GROUP BY 1", "count"),
}
add("l2_library_page", lambda a: _counted(library.page(a, DocumentFilter(status="filed")), {k: c for k, (_, c) in _LIBRARY_PAGE.items()}), _counted_sql(_LIBRARY_PAGE))
add("l3_document_page", lambda a: library.document_page(a, 24)["siblings"], f"""
SELECT id, CAST(position AS INTEGER) AS position, total, prev_id, next_id FROM (SELECT id, row_number() OVER w AS position, count(*) OVER () AS total, lead(id) OVER w AS prev_id, lag(id) OVER w AS next_id
FROM (SELECT * FROM lib WHERE category = (SELECT category FROM doc WHERE id = 24) AND substr(doc_date, 1, 4) = (SELECT substr(doc_date, 1, 4) FROM doc WHERE id = 24) ORDER BY {_SORTED} LIMIT 5000) WINDOW w AS (ORDER BY {_SORTED})) WHERE id = 24""")
_RECEIPTS_PAGE = {
    "summary": ("SELECT count(*) AS receipt_count FROM lrc", "receipt_count"), "by_shop_type": ("SELECT shop_type, sum(total_amount) AS total FROM lrc WHERE shop_type <> '' GROUP BY 1", "total"),
    "by_item_category": ("SELECT item_category, sum(total_price) AS total FROM lit WHERE item_category <> '' GROUP BY 1", "total"), "monthly": ("SELECT substr(receipt_date, 1, 7) AS month, sum(total_amount) AS total FROM lrc WHERE receipt_date <> '' GROUP BY 1 ORDER BY 1 DESC LIMIT 12", "total"),
    "receipts": ("SELECT id, total_amount FROM lrc WHERE shop_type = '1-URGENT' AND receipt_date >= '1996-01-01' ORDER BY receipt_date DESC, id DESC LIMIT 50", "total_amount"),
    "items": (f"SELECT total_price FROM lit WHERE contains({_fold('name')}, 'widget') AND shop_type = '1-URGENT' AND receipt_date >= '1996-01-01' ORDER BY receipt_date DESC, receipt_id DESC, line_no LIMIT 200", "total_price"),
    "top_items": (f"SELECT count(*) AS times FROM lit WHERE name <> '' GROUP BY {_fold('name')} ORDER BY times DESC, sum(total_price) DESC, {_fold('name')} LIMIT 15", "times"),
}
add("l6_receipts_page", lambda a: _counted(receipts.page(a, "Widget", "1-URGENT", "1996-01-01"), {k: c for k, (_, c) in _RECEIPTS_PAGE.items()}), _counted_sql(_RECEIPTS_PAGE))
add("l5_finance_page", _page)
ORACLE_SQL["l5_finance_page"] = "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(
    f"SELECT '{name}' AS result, count(*) AS n, {f'CAST(round(sum(CAST({c} AS DECIMAL(28,6))), 2) AS DOUBLE)' if c else '0.0::DOUBLE'} AS total FROM ({ORACLE_SQL['a13_finance_summary' if name == 'summary' else _ON_PAGE[name]]})" for name, c in _NUMBERS.items()
) + ")"

# --- changes: what the tables are afterwards


def _odd(a: Archive) -> DataFrame:
    return a.documents.where("id % 3 = 1").select("id")


_STATE = "SELECT (SELECT count(*) FROM {d}) AS documents, (SELECT count(*) FROM {s}) AS statements, (SELECT count(*) FROM {t}) AS transactions, (SELECT count(*) FROM {r}) AS receipts, (SELECT count(*) FROM {i}) AS receipt_items"


def _state(a: Archive) -> DataFrame:
    out = None
    for name in ("documents", "statements", "transactions", "receipts", "receipt_items"):
        one = getattr(a, name).agg(F.count("*").alias(name), F.lit(1).alias("k"))
        out = one if out is None else out.join(one, "k")
    return out.drop("k")


_GONE = "(SELECT id FROM doc WHERE deleted_at IS NOT NULL)"
add("m4_trash", lambda a: writes.to_trash(a.documents, _odd(a), "2026-01-01").select("id", "deleted_at"), "SELECT id, coalesce(deleted_at, CASE WHEN id % 3 = 1 THEN '2026-01-01' END) AS deleted_at FROM doc")
add("m4_restore", lambda a: writes.restore(a.documents, _odd(a)).select("id", "deleted_at"), "SELECT id, CASE WHEN id % 3 = 1 THEN NULL ELSE deleted_at END AS deleted_at FROM doc")
add("m4_empty_trash", lambda a: _state(writes.empty_trash(a)), _STATE.format(
    d="doc WHERE deleted_at IS NULL", s=f"st WHERE doc_id NOT IN {_GONE}", t=f"tx WHERE statement_id NOT IN (SELECT id FROM st WHERE doc_id IN {_GONE})", r=f"rc WHERE doc_id NOT IN {_GONE}", i=f"it WHERE receipt_id NOT IN (SELECT id FROM rc WHERE doc_id IN {_GONE})"))
add("m2_reclassify", lambda a: writes.reclassify(a.documents, a.documents.where("id % 4 = 0").select("id", F.lit("neu").alias("category"), F.lit(10).cast("long").alias("input_tokens"))).select("id", "category", "input_tokens"), "SELECT id, CASE WHEN id % 4 = 0 THEN 'neu' ELSE category END AS category, input_tokens + CASE WHEN id % 4 = 0 THEN 10 ELSE 0 END AS input_tokens FROM doc")
add("m8_insert_or_ignore", lambda a: writes.new_transactions(a.transactions.where("id % 2 = 0"), a.transactions.where("id % 3 = 0").unionByName(a.transactions.where("id % 9 = 0"))).select("id", "tx_hash"), "SELECT id, tx_hash FROM tx WHERE id % 3 = 0 AND id % 2 <> 0")
add("m9_recategorise", lambda a: writes.recategorise(a, a.transactions.where("id % 7 = 0").select("id"), "haushalt", "2026-01-01").overrides.groupBy("category").agg(F.count("*").alias("n")), "SELECT CASE WHEN id % 7 = 0 THEN 'haushalt' ELSE 'freizeit' END AS category, count(*) AS n FROM (SELECT o_orderkey AS id FROM orders) WHERE id % 7 = 0 OR id % 50 = 0 GROUP BY 1")
add("m11_delete_account", lambda a: writes.delete_account(a, 3).transactions.groupBy("account_id").agg(F.count("*").alias("n")), "SELECT CASE WHEN account_id <> 3 THEN account_id END AS account_id, count(*) AS n FROM tx GROUP BY 1")
add("m14_clean_duplicates", lambda a: writes.clean_duplicates(a.documents, "2026-01-01").select("id", "deleted_at"), """
SELECT id, CASE WHEN deleted_at IS NULL AND place > 1 THEN '2026-01-01' ELSE deleted_at END AS deleted_at
FROM (SELECT id, deleted_at, row_number() OVER (PARTITION BY content_hash, deleted_at IS NULL ORDER BY created_at, id) AS place FROM doc)""")
add("m13_promote", lambda a: writes.promote(a.documents, _odd(a), "Kassenzettel").groupBy("category", "status").agg(F.count("*").alias("n")), "SELECT CASE WHEN id % 3 = 1 THEN 'Kassenzettel' ELSE category END AS category, CASE WHEN id % 3 = 1 THEN 'review' ELSE status END AS status, count(*) AS n FROM doc GROUP BY 1, 2")

_NEW = "SELECT 'neu-' || lpad(CAST(id AS VARCHAR), 9, '0') AS filename FROM doc WHERE id % 5 = 0"
add("m1_insert_documents", lambda a: writes.insert_documents(a.documents.select("id", "filename"), a.documents.where("id % 5 = 0").select(F.concat(F.lit("neu-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("filename"))), f"""
SELECT id, filename FROM doc UNION ALL SELECT (SELECT max(id) FROM doc) + row_number() OVER (ORDER BY filename) AS id, filename FROM ({_NEW})""")


def _edits(a: Archive) -> DataFrame:
    """Every ninth booking: half with a category that is allowed, half with one that isn't."""
    return writes.checked_bookings(a.transactions.where("id % 9 = 0").select("id", F.lit(" 12.34").alias("amount"), F.when(F.col("id") % 2 == 0, "Haushalt ").otherwise("nope").alias("category")))


_EDITED = "id % 9 = 0 AND id % 2 = 0"
add("m10_edit_transactions", lambda a: writes.edit_transactions(a, _edits(a)).transactions.select("id", F.col("amount").cast("double").alias("amount"), "category", "tx_hash"), f"""
SELECT tx.id, CAST(CASE WHEN {_EDITED.replace('id', 'tx.id')} THEN 12.34 ELSE amount END AS DOUBLE) AS amount, CASE WHEN {_EDITED.replace('id', 'tx.id')} THEN 'haushalt' ELSE category END AS category,
       CASE WHEN {_EDITED.replace('id', 'tx.id')} THEN sha256(iban_hash || '|' || booking_date || '|12.34|' || purpose) ELSE tx_hash END AS tx_hash FROM tx JOIN acc ON acc.id = account_id""")
add("m10_delete_transactions", lambda a: writes.delete_transactions(a, a.transactions.where("id % 5 = 0").select("id")).transactions.groupBy("account_id").agg(F.count("*").alias("n")), "SELECT account_id, count(*) AS n FROM tx WHERE id % 5 <> 0 GROUP BY 1")
_ENTERED = [(-1, 3, "1.2.2026", "5", "Laden", "Brot", "lebensmittel"), (-2, 3, "2026-02-03", "abc", "Laden", "x", ""), (-3, 4, "", "7", "", "", ""), (-4, 99, "2026-01-01", "7", "", "", ""), (-5, 4, "2026-03-04", "-8.5", "", "", "")]
add("m10_add_transactions", lambda a: writes.add_transactions(a, writes.checked_bookings(a.accounts.sparkSession.createDataFrame(_ENTERED, "id long, account_id long, booking_date string, amount string, counterparty string, purpose string, category string"))).transactions.where("id < 0").select("id", "account_id", "booking_date", F.col("amount").cast("double").alias("amount"), "category", "tx_type", "currency", "tx_hash"), """
SELECT CAST(v.id AS BIGINT) AS id, CAST(v.a AS BIGINT) AS account_id, d AS booking_date, CAST(m AS DOUBLE) AS amount, c AS category, 'sonstiges' AS tx_type, 'EUR' AS currency, sha256(iban_hash || '|' || d || '|' || m || '|' || p) AS tx_hash
FROM (VALUES (-1, 3, '2026-02-01', '5.00', 'Brot', 'lebensmittel'), (-5, 4, '2026-03-04', '-8.50', '', 'sonstiges')) AS v(id, a, d, m, p, c) JOIN acc ON acc.id = v.a""")
_BY_HAND = [
    (10, "  Laden ", "Supermarkt", "bar", "12.5", "", "2026-01-02", [("Brot", "1", None, "2.5", "Lebensmittel"), (" ", None, None, None, None), ("Tüte", None, None, "10", "")]),
    (11, "Laden", "kiosk", "", "1", "EUR", "", []), (12, "Laden", "", "", "viel", "EUR", "", []), (-5, "Laden", "", "", "1", "EUR", "", []),
]
_BY_HAND_DDL = "doc_id long, shop_name string, shop_type string, payment_method string, total_amount string, currency string, receipt_date string, items array<struct<name:string,quantity:string,unit_price:string,total_price:string,item_category:string>>"


def _receipts_by_hand(a: Archive) -> DataFrame:
    after = writes.edit_receipts(a, writes.checked_receipts(a.accounts.sparkSession.createDataFrame(_BY_HAND, _BY_HAND_DDL)))
    items = after.receipt_items.groupBy(F.col("receipt_id").alias("id")).agg(F.count("*").alias("items"), F.sum("total_price").cast("double").alias("of_items"))
    return after.receipts.where("doc_id BETWEEN 9 AND 13").join(items, "id", "left").select("doc_id", "shop_name", F.col("total_amount").cast("double").alias("total_amount"), "items", "of_items")


add("m16_edit_receipts", _receipts_by_hand, """
SELECT doc_id, shop_name, CAST(total_amount AS DOUBLE) AS total_amount, items, of_items FROM rc LEFT JOIN (SELECT receipt_id, count(*) AS items, CAST(sum(total_price) AS DOUBLE) AS of_items FROM it GROUP BY 1) ON receipt_id = rc.id WHERE doc_id BETWEEN 9 AND 13 AND doc_id <> 10
UNION ALL SELECT 10, 'Laden', 12.5, 2, 12.5""")
add("m16_delete_receipts", lambda a: _state(writes.delete_receipts(a, _odd(a))), _STATE.format(d="doc", s="st", t="tx", r="rc WHERE doc_id NOT IN (SELECT id FROM doc WHERE id % 3 = 1)", i="it WHERE receipt_id NOT IN (SELECT id FROM rc WHERE doc_id IN (SELECT id FROM doc WHERE id % 3 = 1))"))
add("m12_reset_dry_run", lambda a: writes.finance_counts(writes.reset_finance(a, dry_run=True)), "SELECT (SELECT count(*) FROM tx) AS transactions, (SELECT count(*) FROM st) AS statements, (SELECT count(*) FROM acc) AS accounts")


def _meta(a: Archive) -> DataFrame:
    table = lambda rows: a.accounts.sparkSession.createDataFrame(rows, "key string, value string")
    once, meta = writes.reset_once(a, writes.put_meta(table([("lang", "de"), ("theme", "dark")]), table([("lang", "en"), ("new", "1")])))
    again, meta = writes.reset_once(a, meta)
    counts = writes.finance_counts(once).select("accounts").withColumn("again", F.lit(1)).join(writes.finance_counts(again).select(F.col("accounts").alias("kept"), F.lit(1).alias("again")), "again")
    return meta.withColumn("again", F.lit(1)).join(counts, "again").drop("again")


add("m18_meta", _meta, f"SELECT k AS key, v AS value, CAST(0 AS BIGINT) AS accounts, (SELECT count(*) FROM acc) AS kept FROM (VALUES ('lang', 'en'), ('theme', 'dark'), ('new', '1'), ('{writes.RESET_FLAG}', '1')) AS m(k, v)")
add("m18_set_overrides", lambda a: writes.set_overrides(a.overrides, a.transactions.where("id % 25 = 0").select("tx_hash", F.lit("bildung").alias("category")), "2026-01-01").groupBy("category", "set_at").agg(F.count("*").alias("n")), """
SELECT category, set_at, count(*) AS n FROM (SELECT 'bildung' AS category, '2026-01-01' AS set_at FROM tx WHERE id % 25 = 0 UNION ALL SELECT 'freizeit', '2025-01-01' FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey NOT IN (SELECT id FROM tx WHERE id % 25 = 0)) GROUP BY 1, 2""")



def _stored_changes(a: Archive) -> DataFrame:
    """Changes made to stored tables, one version after the other: reclassified, relabelled, deleted, the trash emptied."""
    store = versions.Store(a.accounts.sparkSession, scratch(a.accounts.sparkSession))
    first = versions.create_archive(store, a, buckets=4)
    updates = lambda x: x.documents.where("id % 4 = 0").select("id", F.lit("neu").alias("category"), F.lit(10).cast("long").alias("input_tokens"))
    versions.change(store, lambda x: {"documents": updates(x)}, lambda x: replace(x, documents=writes.reclassify(x.documents, updates(x))))
    labelled = lambda x: x.transactions.where("id % 7 = 0")
    versions.change(store, lambda x: {"overrides": labelled(x)}, lambda x: writes.recategorise(x, labelled(x).select("id"), "haushalt", "2026-01-01"))
    gone = lambda x: x.transactions.where("id % 5 = 0").select("id")
    versions.change(store, lambda x: {"transactions": gone(x)}, lambda x: writes.delete_transactions(x, gone(x)))

    def trash(x: Archive) -> dict[str, DataFrame]:
        docs = x.documents.where("deleted_at IS NOT NULL").select(F.col("id").alias("doc_id"))
        s, r = x.statements.join(docs, "doc_id", "left_semi"), x.receipts.join(docs, "doc_id", "left_semi")
        t = x.transactions.join(s.select(F.col("id").alias("statement_id")), "statement_id", "left_semi")
        return {"documents": docs.select(F.col("doc_id").alias("id")), "statements": s, "transactions": t, "receipts": r, "receipt_items": r.select(F.col("id").alias("receipt_id"))}

    last = versions.change(store, trash, writes.empty_trash)
    out = None
    for n, v in (("first", first), ("last", last)):  # a reader of the first version sees it still
        x = versions.stored_archive(store, v)
        for what, rows in (("documents", x.documents.groupBy("category")), ("overrides", x.overrides.groupBy("category")), ("transactions", x.transactions.groupBy(F.col("account_id").cast("string").alias("category"))), ("items", x.receipt_items.groupBy(F.lit("").alias("category")))):
            one = rows.agg(F.count("*").alias("n")).select(F.lit(n).alias("version"), F.lit(what).alias("what"), "category", "n")
            out = one if out is None else out.unionByName(one)
    return out


add("v_stored_changes", _stored_changes, f"""
SELECT 'first' AS version, 'documents' AS what, category, count(*) AS n FROM doc GROUP BY 3 UNION ALL SELECT 'first', 'overrides', 'freizeit', count(*) FROM orders WHERE o_orderkey % 50 = 0
UNION ALL SELECT 'first', 'transactions', CAST(account_id AS VARCHAR), count(*) FROM tx GROUP BY 3 UNION ALL SELECT 'first', 'items', '', count(*) FROM it
UNION ALL SELECT 'last', 'documents', CASE WHEN id % 4 = 0 THEN 'neu' ELSE category END, count(*) FROM doc WHERE deleted_at IS NULL GROUP BY 3
UNION ALL SELECT 'last', 'overrides', CASE WHEN o_orderkey % 7 = 0 THEN 'haushalt' ELSE 'freizeit' END, count(*) FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 50 = 0 GROUP BY 3
UNION ALL SELECT 'last', 'transactions', CAST(account_id AS VARCHAR), count(*) FROM tx WHERE id % 5 <> 0 AND statement_id NOT IN (SELECT id FROM st WHERE doc_id IN {_GONE}) GROUP BY 3
UNION ALL SELECT 'last', 'items', '', count(*) FROM it WHERE receipt_id NOT IN (SELECT id FROM rc WHERE doc_id IN {_GONE})""")

# --- flows, with a model that answers by the length of what it is asked

_TREE = {"src1": ["en", "fr"], "src2": [], "src3": ["de"]}


def _model(prompt: str) -> str:
    n = len(prompt) % 4
    return "no idea" if n == 0 else f'Sure: {{"category": "src{n}", "subcategory": "fr", "tags": ["Neu", "neu"], "confidence": {0.9 if n < 3 else 0.2}}}'


_ROUTE = "CASE length(filename) % 4 WHEN 0 THEN 'failed' WHEN 3 THEN 'review' ELSE 'filed' END"


def _till_model(prompt: str) -> str:
    return "" if len(prompt) % 4 == 0 else f'{{"shop_name": "Modell", "shop_type": "Cafe", "total_amount": "{len(prompt) / 2}", "items": [{{"name": "a", "total_price": 1}}]}}'


add("m20_retry_review", lambda a: flows.retry_review(a, _model, _TREE, text="filename").documents.select("id", "category", "status", "subcategory"), f"""
SELECT id, CASE WHEN again AND length(filename) % 4 > 0 THEN 'src' || length(filename) % 4 ELSE category END AS category, CASE WHEN again THEN {_ROUTE} ELSE status END AS status,
       CASE WHEN again AND length(filename) % 4 > 0 THEN CASE length(filename) % 4 WHEN 1 THEN 'fr' ELSE '' END ELSE subcategory END AS subcategory FROM (SELECT *, status = 'review' AND deleted_at IS NULL AS again FROM doc)""")
_LACKING = "status = 'filed' AND (len(tags) = 0 OR (category IN ('src1', 'src3') AND coalesce(subcategory, '') = ''))"
_MOVED = "length(filename) % 4 = 1 AND category = 'src1' AND subcategory <> 'fr'"
add("a39_backfill_report", lambda a: flows.backfill(a, _model, _TREE, 0.001, text="filename")[1], f"""
SELECT count(*) AS candidates, count(*) FILTER (length(filename) % 4 > 0) AS updated, count(*) FILTER (length(filename) % 4 = 0) AS skipped, count(*) FILTER ({_MOVED}) AS moved, round(count(*) * 0.001::DOUBLE, 4) AS cost_usd FROM lib WHERE {_LACKING}""")
add("m19_extract_receipts", lambda a: flows.extract_receipts(replace(a, documents=a.documents.withColumn("category", F.when(F.col("category") == "src1", flows.RECEIPTS).otherwise(F.col("category"))), receipts=a.receipts.where("doc_id % 3 = 0")), _till_model, text="filename")[0].receipts.where("shop_name = 'Modell'").select("id", "doc_id", F.col("total_amount").cast("double").alias("total_amount"), "shop_type"), """
SELECT id, id AS doc_id, CAST(length(filename) AS DOUBLE) / 2 AS total_amount, 'cafe' AS shop_type FROM lib WHERE category = 'src1' AND id NOT IN (SELECT doc_id FROM rc WHERE doc_id % 3 = 0) AND length(filename) % 4 > 0""")
add("l8_diagnostics", lambda a: flows.diagnostics(a, 24), """
SELECT id, status, category, CAST(length(extracted_text) AS INTEGER) AS n_chars, deleted_at IS NOT NULL AS in_trash, (SELECT count(*) FROM rc WHERE doc_id = 24) AS receipts, (SELECT count(*) FROM it WHERE receipt_id IN (SELECT id FROM rc WHERE doc_id = 24)) AS receipt_items,
       (SELECT count(*) FROM st WHERE doc_id = 24) AS statements, (SELECT count(*) FROM tx WHERE statement_id IN (SELECT id FROM st WHERE doc_id = 24)) AS transactions, (SELECT count(*) FROM doc e WHERE e.id <> 24 AND e.content_hash = doc.content_hash) AS copies FROM doc WHERE id = 24""")
add("l8_status_counts", flows.status_counts, "SELECT count(*) AS n, count(*) FILTER (coalesce(extracted_text, '') = '') AS without_text, count(*) FILTER (coalesce(doc_date, '') = '') AS without_date, count(*) FILTER (coalesce(category, '') = '') AS without_category FROM lib")
_WORDS = [("de", "cat.src1", "Eins"), ("en", "cat.src1", "One"), ("en", "cat.src2", "Two")]
add("c27_labels", lambda a: flows.labelled(library.library(a).select("id", "category"), a.accounts.sparkSession.createDataFrame(_WORDS, "lang string, key string, value string"), "de"), "SELECT id, category, CASE category WHEN 'src1' THEN 'Eins' WHEN 'src2' THEN 'Two' ELSE category END AS label FROM lib")
add("m15_bulk_update", lambda a: flows.bulk_update(a, _odd(a), "neu", "x/y.pdf").documents.select("id", "category", "library_path"), "SELECT id, CASE WHEN id % 3 = 1 THEN 'neu' ELSE category END AS category, CASE WHEN id % 3 = 1 THEN 'x/y.pdf' ELSE library_path END AS library_path FROM doc")

# --- extension: events by the hour, read as a stream


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))


QUERIES["t_events_by_hour"] = _events
ORACLE_SQL["t_events_by_hour"] = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"
