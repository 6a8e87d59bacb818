"""The archive's tables: their schemas, and views of the driver's tables that stand in for them, in Spark and in SQL."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
SCHEMAS = {
    "documents": "id long, filename string, original_name string, category string, doc_date string, sender string, subject string, confidence double, reasoning string, library_path string, processed_path string, file_size long, page_count int, ocr_used boolean, model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, content_hash string, cost_usd double, status string, extracted_text string, created_at string, deleted_at string, subcategory string, tags array<string>",
    "receipts": "id long, doc_id long, shop_name string, shop_type string, payment_method string, total_amount decimal(18,2), currency string, receipt_date string, extra_json string, created_at string",
    "receipt_items": "id long, receipt_id long, name string, quantity decimal(18,4), unit_price decimal(18,4), total_price decimal(18,2), item_category string, line_no int",
    "accounts": "id long, bank_name string, iban string, iban_last4 string, iban_hash string, account_holder string, currency string, created_at string",
    "statements": "id long, doc_id long, account_id long, period_start string, period_end string, statement_no string, opening_balance decimal(18,2), closing_balance decimal(18,2), currency string, file_hash string, privacy_mode string, extra_json string, created_at string, acknowledged_empty boolean, extraction_warning string",
    "transactions": "id long, statement_id long, account_id long, booking_date string, value_date string, amount decimal(18,2), currency string, counterparty string, counterparty_iban string, purpose string, tx_type string, category string, tx_hash string, line_no int",
    "overrides": "tx_hash string, category string, set_at string",
}


@dataclass(frozen=True)
class Archive:
    """The tables that queries read. Tables can be any DataFrames with the columns of SCHEMAS that a query needs."""

    documents: DataFrame
    receipts: DataFrame
    receipt_items: DataFrame
    accounts: DataFrame
    statements: DataFrame
    transactions: DataFrame
    overrides: DataFrame


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; where that is unset, on this machine if Spark runs here alone."""
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/archive/{uuid.uuid4().hex}"


def open_archive(spark: SparkSession, path: str) -> Archive:
    """The tables stored as Parquet under path, with explicit schemas; a missing table is an error."""
    return Archive(**{name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in SCHEMAS.items()})


def stand_ins(spark: SparkSession, sf_dir: str) -> Archive:
    """The archive that the driver's tables stand in for; VIEWS is the same in SQL."""
    for name in ("orders", "customer", "supplier", "nation", "lineitem", "part", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"in_{name}")
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("in_documents")
    t = spark.sql("""
        SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) * 1000000 + CAST(substr(CAST(o_orderdate AS STRING), 1, 4) AS BIGINT) * 100 + CAST(substr(CAST(o_orderdate AS STRING), 6, 2) AS BIGINT) AS statement_id,
               CAST(c_nationkey AS BIGINT) AS account_id, substr(CAST(o_orderdate AS STRING), 1, 10) AS booking_date, substr(CAST(o_orderdate AS STRING), 1, 10) AS value_date,
               CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2)) AS amount, 'EUR' AS currency,
               c_name AS counterparty, CAST(NULL AS STRING) AS counterparty_iban, concat(o_orderpriority, ' ', o_orderstatus) AS purpose, o_orderpriority AS tx_type,
               CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'uebertrag' WHEN 'MACHINERY' THEN '' ELSE lower(c_mktsegment) END AS category,
               sha2(CAST(o_orderkey AS STRING), 256) AS tx_hash, 0 AS line_no
        FROM in_orders JOIN in_customer ON o_custkey = c_custkey""")
    balance = spark.sql("SELECT CAST(s_nationkey AS BIGINT) AS nation, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS opening FROM in_supplier GROUP BY s_nationkey")
    s = t.groupBy("statement_id", "account_id").agg(F.min("booking_date").alias("period_start"), F.max("booking_date").alias("period_end"))
    s = s.join(balance, F.col("account_id") == F.col("nation"), "left").select(
        F.col("statement_id").alias("id"), (F.col("statement_id") % 200).alias("doc_id"), "account_id", "period_start", "period_end", F.col("opening").alias("opening_balance"),
        F.sha2(F.col("statement_id").cast("string"), 256).alias("file_hash"),
    )
    a = spark.sql("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS bank_name, right(sha2(n_name, 256), 4) AS iban_last4, sha2(n_name, 256) AS iban_hash, 'EUR' AS currency FROM in_nation")
    r = spark.sql("""
        SELECT o_orderkey AS id, o_orderkey % 200 AS doc_id, concat('shop ', CAST(o_custkey % 97 AS STRING)) AS shop_name, o_orderpriority AS shop_type,
               CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount, 'EUR' AS currency, substr(CAST(o_orderdate AS STRING), 1, 10) AS receipt_date FROM in_orders""")
    i = spark.sql("""
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS receipt_id, p_name AS name, CAST(l_quantity AS DECIMAL(18,4)) AS quantity, CAST(p_retailprice AS DECIMAL(18,4)) AS unit_price,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS total_price, p_type AS item_category, l_linenumber AS line_no FROM in_lineitem JOIN in_part ON l_partkey = p_partkey""")
    d = spark.sql("""
        SELECT d.doc_id AS id, concat(CAST(d.doc_id AS STRING), '-', d.source, '-', d.lang, '.pdf') AS filename, concat('scan-', CAST(d.doc_id % 400 AS STRING), '.pdf') AS original_name,
               d.source AS category, CASE WHEN d.doc_id % 23 = 0 THEN NULL ELSE CAST(date_add(DATE '2024-01-01', CAST((7 * d.doc_id) % 1400 AS INT)) AS STRING) END AS doc_date,
               concat('sender ', CAST(d.doc_id % 13 AS STRING)) AS sender, substr(d.text, 1, 40) AS subject, '' AS reasoning,
               concat(d.source, '/', CAST(d.doc_id % 900 AS STRING), '.pdf') AS library_path, d.n_chars AS file_size, d.n_chars div 4 AS input_tokens, 100 + d.doc_id % 50 AS output_tokens,
               d.doc_id % 7 AS cache_creation_tokens, d.doc_id % 5 AS cache_read_tokens, sha2(d.text, 256) AS content_hash, CAST(d.n_chars AS DOUBLE) / 1000000 AS cost_usd,
               CASE d.doc_id % 10 WHEN 0 THEN 'review' WHEN 1 THEN 'failed' WHEN 2 THEN 'duplicate' ELSE 'filed' END AS status, d.text AS extracted_text,
               concat(CAST(date_add(DATE '2024-02-01', CAST(d.doc_id % 500 AS INT)) AS STRING), 'T08:00:00') AS created_at,
               CASE WHEN d.doc_id % 17 = 0 THEN '2025-12-01T00:00:00' END AS deleted_at, d.lang AS subcategory,
               CASE WHEN l.doc_id IS NULL THEN array() ELSE array_compact(array(CASE WHEN l.quality = 1 THEN 'gut' ELSE 'schwach' END, CASE WHEN l.toxic = 1 THEN 'prüfen' END)) END AS tags
        FROM in_documents d LEFT JOIN in_labels l ON d.doc_id = l.doc_id""")
    o = spark.sql("SELECT sha2(CAST(o_orderkey AS STRING), 256) AS tx_hash, 'freizeit' AS category, '2025-01-01' AS set_at FROM in_orders WHERE o_orderkey % 50 = 0")
    return Archive(documents=d, receipts=r, receipt_items=i, accounts=a, statements=s, transactions=t, overrides=o)


#: The stand-ins for the other engine, as common table expressions.
VIEWS = """
tx AS (
  SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) * 1000000 + CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) AS statement_id, CAST(c_nationkey AS BIGINT) AS account_id,
         strftime(o_orderdate, '%Y-%m-%d') AS booking_date, CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2)) AS amount,
         c_name AS counterparty, o_orderpriority || ' ' || o_orderstatus AS purpose, o_orderpriority AS tx_type,
         CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'uebertrag' WHEN 'MACHINERY' THEN '' ELSE lower(c_mktsegment) END AS category, sha256(CAST(o_orderkey AS VARCHAR)) AS tx_hash
  FROM orders JOIN customer ON o_custkey = c_custkey),
opening AS (SELECT CAST(s_nationkey AS BIGINT) AS nation, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS opening FROM supplier GROUP BY 1),
st AS (
  SELECT statement_id AS id, statement_id % 200 AS doc_id, account_id, min(booking_date) AS period_start, max(booking_date) AS period_end, any_value(opening) AS opening_balance
  FROM tx LEFT JOIN opening ON account_id = nation GROUP BY statement_id, account_id),
acc AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS bank_name, right(sha256(n_name), 4) AS iban_last4, sha256(n_name) AS iban_hash FROM nation),
rc AS (
  SELECT o_orderkey AS id, o_orderkey % 200 AS doc_id, 'shop ' || CAST(o_custkey % 97 AS VARCHAR) AS shop_name, o_orderpriority AS shop_type, CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
         strftime(o_orderdate, '%Y-%m-%d') AS receipt_date FROM orders),
it AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS receipt_id, p_name AS name, CAST(l_quantity AS DECIMAL(18,4)) AS quantity, CAST(p_retailprice AS DECIMAL(18,4)) AS unit_price,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS total_price, p_type AS item_category, l_linenumber AS line_no FROM lineitem JOIN part ON l_partkey = p_partkey),
doc AS (
  SELECT d.doc_id AS id, CAST(d.doc_id AS VARCHAR) || '-' || d.source || '-' || d.lang || '.pdf' AS filename, 'scan-' || CAST(d.doc_id % 400 AS VARCHAR) || '.pdf' AS original_name,
         d.source AS category, CASE WHEN d.doc_id % 23 = 0 THEN NULL ELSE CAST(DATE '2024-01-01' + CAST((7 * d.doc_id) % 1400 AS INTEGER) AS VARCHAR) END AS doc_date,
         'sender ' || CAST(d.doc_id % 13 AS VARCHAR) AS sender, substr(d.text, 1, 40) AS subject, d.source || '/' || CAST(d.doc_id % 900 AS VARCHAR) || '.pdf' AS library_path,
         d.n_chars AS file_size, d.n_chars // 4 AS input_tokens, 100 + d.doc_id % 50 AS output_tokens, d.doc_id % 7 AS cache_creation_tokens, d.doc_id % 5 AS cache_read_tokens,
         sha256(d.text) AS content_hash, CAST(d.n_chars AS DOUBLE) / 1000000 AS cost_usd,
         CASE d.doc_id % 10 WHEN 0 THEN 'review' WHEN 1 THEN 'failed' WHEN 2 THEN 'duplicate' ELSE 'filed' END AS status, d.text AS extracted_text,
         CAST(DATE '2024-02-01' + CAST(d.doc_id % 500 AS INTEGER) AS VARCHAR) || 'T08:00:00' AS created_at, CASE WHEN d.doc_id % 17 = 0 THEN '2025-12-01T00:00:00' END AS deleted_at, d.lang AS subcategory,
         CASE WHEN l.doc_id IS NULL THEN [] ELSE list_filter([CASE WHEN l.quality = 1 THEN 'gut' ELSE 'schwach' END, CASE WHEN l.toxic = 1 THEN 'prüfen' END], lambda x: x IS NOT NULL) END AS tags
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
live AS (SELECT tx.*, st.doc_id FROM tx JOIN st ON tx.statement_id = st.id JOIN doc ON doc.id = st.doc_id WHERE doc.deleted_at IS NULL),
lib AS (SELECT * FROM doc WHERE deleted_at IS NULL AND category <> '_csv_container'),
lrc AS (SELECT rc.* FROM rc JOIN doc ON doc.id = rc.doc_id WHERE doc.deleted_at IS NULL),
lit AS (SELECT it.*, lrc.shop_name, lrc.shop_type, lrc.receipt_date, lrc.doc_id FROM it JOIN lrc ON lrc.id = it.receipt_id)
"""


def sql(body: str) -> str:
    return f"WITH {VIEWS.strip()}\n{body.strip()}"
