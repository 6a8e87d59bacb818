"""Changes to the archive's tables. Each gives the new version of a table as a DataFrame, to be written elsewhere."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.functions.rules import TX_CATEGORIES, TX_KINDS
from quillstack.functions.scalars import all_of, blank_to, normalise_date, statement_tx_hash
from quillstack.sources.replies import ITEM_CATEGORIES, PAYMENTS, SHOP_TYPES
from quillstack.plans.archive import Archive


def merge(old: DataFrame, new: DataFrame, key: str, columns: dict[str, Column] | None = None) -> DataFrame:
    """old with the rows of new in place of those of equal key, and new keys added. Rows of new have distinct keys.

    columns: what a matched column becomes, from `old.<c>` and `new.<c>`; by default the new value.
    """
    names = old.columns
    n = new.select(*(F.col(c).alias(f"new_{c}") for c in new.columns)).withColumn("_in", F.lit(True))
    o = old.select(*(F.col(c).alias(f"old_{c}") for c in names)).withColumn("_was", F.lit(True))
    joined = o.join(n, F.col(f"old_{key}") == F.col(f"new_{key}"), "full")
    pick = lambda c: (columns or {}).get(c, F.col(f"new_{c}")) if c in new.columns else F.col(f"old_{c}")
    both = lambda c: F.when(F.col("_was") & F.col("_in"), pick(c)).when(F.col("_in"), F.col(f"new_{c}") if c in new.columns else F.lit(None)).otherwise(F.col(f"old_{c}"))
    return joined.select(*(both(c).alias(c) for c in names))


def where_ids(df: DataFrame, ids: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns changed in the rows whose id is among ids."""
    marked = df.join(ids.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left")
    return marked.withColumns({c: F.when(F.col("_id").isNotNull(), v).otherwise(F.col(c)) for c, v in columns.items()}).select(*df.columns)


def reclassify(documents: DataFrame, results: DataFrame) -> DataFrame:
    """documents with new classifications by id; token counts and costs add up."""
    added = {c: F.coalesce(F.col(f"old_{c}"), F.lit(0)) + F.coalesce(F.col(f"new_{c}"), F.lit(0)) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "cost_usd") if c in results.columns}
    return merge(documents, results, "id", added)


def edit_documents(a: Archive, edits: DataFrame, statement_categories: list[str], receipt_categories: list[str]) -> Archive:
    """Metadata by id; a document that leaves a category of statements or receipts loses the one it has."""
    documents = merge(a.documents, edits, "id")
    left = lambda allowed: documents.join(edits.select("id"), "id", "left_semi").where(~F.col("category").isin(allowed)).select("id")
    return replace(_without(a, left(statement_categories), left(receipt_categories)), documents=documents)


def _without(a: Archive, statement_docs: DataFrame, receipt_docs: DataFrame) -> Archive:
    """Without the statements and receipts of some documents, and without their rows."""
    gone_s = a.statements.join(statement_docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("id").alias("statement_id"))
    gone_r = a.receipts.join(receipt_docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("id").alias("receipt_id"))
    anti = lambda df, gone, own, other: df.join(gone.select(F.col(other).alias(own)), own, "left_anti").select(*df.columns)
    return replace(
        a, statements=anti(a.statements, gone_s, "id", "statement_id"), transactions=anti(a.transactions, gone_s, "statement_id", "statement_id"),
        receipts=anti(a.receipts, gone_r, "id", "receipt_id"), receipt_items=anti(a.receipt_items, gone_r, "receipt_id", "receipt_id"),
    )


def to_trash(documents: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    return where_ids(documents, ids, {"deleted_at": F.coalesce("deleted_at", F.lit(now))})


def restore(documents: DataFrame, ids: DataFrame) -> DataFrame:
    return where_ids(documents, ids, {"deleted_at": F.lit(None).cast("string")})


def purge(a: Archive, ids: DataFrame) -> Archive:
    """Without some documents in the trash, and all that hangs on them."""
    gone = a.documents.where("deleted_at IS NOT NULL").join(ids.select("id"), "id", "left_semi").select("id")
    return replace(_without(a, gone, gone), documents=a.documents.join(gone, "id", "left_anti").select(*a.documents.columns))


def empty_trash(a: Archive) -> Archive:
    return purge(a, a.documents.select("id"))


def put_receipts(a: Archive, receipts: DataFrame, items: DataFrame) -> Archive:
    """Receipts by doc_id in place of older ones; items (receipt_id, …) replace those of these receipts."""
    old = a.receipts.join(receipts.select("doc_id"), "doc_id", "left_semi").select(F.col("id").alias("receipt_id"))
    keep = a.receipt_items.join(old, "receipt_id", "left_anti").select(*a.receipt_items.columns)
    kept = a.receipts.join(receipts.select("doc_id"), "doc_id", "left_anti").select(*a.receipts.columns)
    return replace(a, receipts=kept.unionByName(receipts, True), receipt_items=keep.unionByName(items, True))


def put_accounts(accounts: DataFrame, new: DataFrame) -> DataFrame:
    """Accounts by iban_hash; of a known one, what is not empty in the new row wins. New rows without a hash are no accounts and are left out."""
    new = new.where("iban_hash <> ''")
    text = [c for c in new.columns if c not in ("id", "iban_hash")]
    columns = {c: F.coalesce(F.nullif(F.col(f"new_{c}"), F.lit("")), F.col(f"old_{c}")) for c in text}
    return merge(accounts, new, "iban_hash", columns | {"id": F.col("old_id"), "created_at": F.col("old_created_at")})


def new_transactions(transactions: DataFrame, incoming: DataFrame) -> DataFrame:
    """What of incoming is to be appended: the first row of each hash that isn't stored, and all without a hash."""
    place = F.row_number().over(W.partitionBy("tx_hash").orderBy("path", "line_no") if "path" in incoming.columns else W.partitionBy("tx_hash").orderBy("line_no"))
    hashed = incoming.where("tx_hash IS NOT NULL").withColumn("_place", place).where("_place = 1").drop("_place")
    fresh = hashed.join(transactions.select("tx_hash"), "tx_hash", "left_anti").select(*incoming.columns)
    return fresh.unionByName(incoming.where("tx_hash IS NULL"))


def put_statement(a: Archive, statement: DataFrame, transactions: DataFrame) -> Archive:
    """A statement by doc_id in place of an older one and its bookings; bookings known elsewhere are left out, labels kept."""
    old = a.statements.join(statement.select("doc_id"), "doc_id", "left_semi").select(F.col("id").alias("statement_id"))
    kept = a.transactions.join(old, "statement_id", "left_anti").select(*a.transactions.columns)
    labels = a.overrides.select("tx_hash", F.col("category").alias("_own"))
    fresh = new_transactions(kept, transactions).join(labels, "tx_hash", "left").withColumn("category", F.coalesce("_own", "category")).select(*transactions.columns)
    others = a.statements.join(statement.select("doc_id"), "doc_id", "left_anti").select(*a.statements.columns)
    return replace(a, statements=others.unionByName(statement, True), transactions=kept.unionByName(fresh, True))


def recategorise(a: Archive, ids: DataFrame, category: str, now: str) -> Archive:
    """Transactions by id get a category, which is pinned to their hashes."""
    hashes = a.transactions.join(ids.select("id"), "id", "left_semi").where("tx_hash IS NOT NULL").select("tx_hash", F.lit(category).alias("category"), F.lit(now).alias("set_at")).distinct()
    return replace(a, transactions=where_ids(a.transactions, ids, {"category": F.lit(category)}), overrides=merge(a.overrides, hashes, "tx_hash"))


#: What can be edited of a booking, and amounts beyond which an edit is refused.
EDITABLE = ("booking_date", "value_date", "amount", "counterparty", "counterparty_iban", "purpose", "tx_type", "category")
MOST_AMOUNT = 10_000_000


def checked_bookings(edits: DataFrame) -> DataFrame:
    """edits (text columns of EDITABLE beside others) as values, with `problem`: null, or what is wrong with the row.

    A column that edits lack is not edited. Dates become ISO, or null; categories and kinds have to be allowed ones.
    """
    given = [c for c in EDITABLE if c in edits.columns]
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    number = F.col("amount").try_cast("double") if "amount" in given else F.lit(0.0)
    problem = F.when(number.isNull() | F.isnan(number), "amount is no number").when(F.abs(number) > MOST_AMOUNT, "amount out of range")
    for c, allowed in (("category", TX_CATEGORIES), ("tx_type", TX_KINDS)):
        if c in given:
            problem = problem.when(~F.lower(text(c)).isin("", *allowed), f"{c} is not allowed")
    value = {"amount": F.round(number, 2).try_cast("decimal(18,2)"), **{c: normalise_date(text(c)) for c in ("booking_date", "value_date")}, **{c: F.lower(text(c)) for c in ("category", "tx_type")}}
    rest = [c for c in edits.columns if c not in given and c != "problem"]
    return edits.select(*rest, *(value.get(c, F.substring(text(c), 1, 500)).alias(c) for c in given), problem.alias("problem"))


def _rehashed(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    own = accounts.select(F.col("id").alias("_account"), F.col("iban_hash").alias("_hash"))
    joined = transactions.join(own, F.col("account_id") == F.col("_account"), "left")
    return joined.withColumn("tx_hash", statement_tx_hash(F.col("_hash"), F.col("booking_date"), F.col("amount"), F.col("purpose"))).select(*transactions.columns)


def edit_transactions(a: Archive, edits: DataFrame) -> Archive:
    """Bookings by id with new values, and with new hashes, so that what is read again later meets the corrected row.

    edits: checked_bookings; rows with a problem change nothing, and so do ids that don't exist.
    """
    good = edits.where("problem IS NULL").drop("problem").join(a.transactions.select("id"), "id", "left_semi")
    changed = _rehashed(merge(a.transactions.join(good.select("id"), "id", "left_semi").select(*a.transactions.columns), good, "id"), a.accounts)
    return replace(a, transactions=a.transactions.join(good.select("id"), "id", "left_anti").select(*a.transactions.columns).unionByName(changed))


def delete_transactions(a: Archive, ids: DataFrame) -> Archive:
    return replace(a, transactions=a.transactions.join(ids.select("id"), "id", "left_anti").select(*a.transactions.columns))


def add_transactions(a: Archive, new: DataFrame) -> Archive:
    """Bookings entered by hand: (id, account_id) with checked_bookings; those with a problem, a date or account that is none are left out."""
    missing = {c: F.lit(None).cast("string") for c in EDITABLE if c not in new.columns}
    own = a.accounts.select(F.col("id").alias("account_id"), blank_to(F.col("currency"), "EUR").alias("currency"))
    rows = new.withColumns(missing).where("problem IS NULL AND booking_date IS NOT NULL AND amount IS NOT NULL").drop("problem", "currency").join(own, "account_id")
    rows = rows.withColumns({c: blank_to(F.col(c), "sonstiges") for c in ("tx_type", "category")}).withColumn("tx_hash", F.lit(None).cast("string"))
    fresh = _rehashed(rows, a.accounts).join(a.transactions.select("tx_hash"), "tx_hash", "left_anti").dropDuplicates(["tx_hash"])
    return replace(a, transactions=a.transactions.unionByName(fresh.select(*[c for c in fresh.columns if c in a.transactions.columns]), True))


def delete_account(a: Archive, account_id: int) -> Archive:
    """Without an account; its statements and bookings stay, without one."""
    clear = lambda df: df.withColumn("account_id", F.when(F.col("account_id") != account_id, F.col("account_id")))
    return replace(a, accounts=a.accounts.where(F.col("id") != account_id), statements=clear(a.statements), transactions=clear(a.transactions))


def finance_counts(a: Archive) -> DataFrame:
    """One row: how many transactions, statements and accounts a reset would delete."""
    out = None
    for name in ("transactions", "statements", "accounts"):
        one = getattr(a, name).agg(F.count("*").alias(name), F.lit(1).alias("k"))
        out = one if out is None else out.join(one, "k")
    return out.drop("k")


def reset_finance(a: Archive, dry_run: bool = False) -> Archive:
    """Without accounts, statements, bookings and labels; a dry run leaves all as it is."""
    if dry_run:
        return a
    none = lambda df: df.where(F.lit(False))
    return replace(a, accounts=none(a.accounts), statements=none(a.statements), transactions=none(a.transactions), overrides=none(a.overrides))


def put_meta(meta: DataFrame, values: DataFrame) -> DataFrame:
    """meta (key, value) with values in place of those of equal keys. Of a key that comes twice in values the greatest counts."""
    return merge(meta, values.groupBy("key").agg(F.max("value").alias("value")), "key")


def get_meta(meta: DataFrame, key: str) -> DataFrame:
    return meta.where(F.col("key") == key).select("value")


RESET_FLAG = "finance_reset_done"


def reset_once(a: Archive, meta: DataFrame) -> tuple[Archive, DataFrame]:
    """reset_finance where the flag isn't set in meta, and meta with the flag; else both as they are."""
    if not get_meta(meta, RESET_FLAG).where("value = '1'").isEmpty():
        return a, meta
    return reset_finance(a), put_meta(meta, meta.sparkSession.createDataFrame([(RESET_FLAG, "1")], "key string, value string"))


def set_overrides(overrides: DataFrame, labels: DataFrame, now: str) -> DataFrame:
    """overrides with labels (tx_hash, category) pinned; without a hash nothing is. Of a hash that comes twice the greatest label counts."""
    rows = labels.where("tx_hash <> ''").groupBy("tx_hash").agg(F.max("category").alias("category")).withColumn("set_at", F.lit(now))
    return merge(overrides, rows, "tx_hash")


def insert_documents(documents: DataFrame, new: DataFrame) -> DataFrame:
    """documents with new rows, which get the ids after the greatest, in the order of filename; columns that new lacks are null.

    The rows are numbered in ranges of the filename, so that no task holds them all.
    """
    last = documents.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"), F.lit(1).alias("k"))
    order = [F.col("filename"), F.col("content_hash")] if "content_hash" in new.columns else [F.col("filename")]
    ranged = new.drop("id").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).persist()
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lit(1).alias("k")).join(last, "k").drop("k")
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    numbered = ranged.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn("id", (F.col("last") + F.col("_before") + F.col("_place")).cast("long"))
    return documents.unionByName(numbered.select("id", *[c for c in new.columns if c in documents.columns and c != "id"]), True)


def checked_receipts(edits: DataFrame) -> DataFrame:
    """Receipts as edited by hand (doc_id, text fields, items), as values with `problem`: null, or what is not allowed.

    Items without a name are left out; kinds are lower-cased and may be empty; numbers may be empty, but not words.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    wrong = lambda c: (text(c) != "") & (c.try_cast("double").isNull() | F.isnan(c.try_cast("double")))
    items = F.filter(F.coalesce("items", F.array().cast("array<struct<name:string,quantity:string,unit_price:string,total_price:string,item_category:string>>")), lambda i: text(i["name"]) != "")
    problem = F.when(~F.lower(text(F.col("shop_type"))).isin("", *SHOP_TYPES), "shop_type is not allowed").when(~F.lower(text(F.col("payment_method"))).isin("", *PAYMENTS), "payment_method is not allowed")
    problem = problem.when(wrong(F.col("total_amount")), "total_amount is no number")
    problem = problem.when(F.exists(items, lambda i: ~F.lower(text(i["item_category"])).isin("", *ITEM_CATEGORIES)), "item_category is not allowed")
    problem = problem.when(F.exists(items, lambda i: wrong(i["quantity"]) | wrong(i["unit_price"]) | wrong(i["total_price"])), "an item's number is none")
    item = lambda i: F.struct(
        F.substring(text(i["name"]), 1, 200).alias("name"), i["quantity"].try_cast("decimal(18,4)").alias("quantity"), i["unit_price"].try_cast("decimal(18,4)").alias("unit_price"),
        i["total_price"].try_cast("decimal(18,2)").alias("total_price"), F.lower(text(i["item_category"])).alias("item_category"),
    )
    return edits.select(
        "doc_id", F.substring(text(F.col("shop_name")), 1, 200).alias("shop_name"), F.lower(text(F.col("shop_type"))).alias("shop_type"), F.lower(text(F.col("payment_method"))).alias("payment_method"),
        F.col("total_amount").try_cast("decimal(18,2)").alias("total_amount"), F.substring(blank_to(text(F.col("currency")), "EUR"), 1, 8).alias("currency"),
        F.substring(text(F.col("receipt_date")), 1, 10).alias("receipt_date"), F.transform(items, item).alias("items"), problem.alias("problem"),
    )


def edit_receipts(a: Archive, edits: DataFrame) -> Archive:
    """Receipts of existing documents replaced by checked_receipts, items and all; rows with a problem change nothing.

    A new receipt's id is its document's, as a document has one at most; those known keep theirs. Items are numbered in
    their order, and their ids follow from the receipt's.
    """
    good = edits.where("problem IS NULL").join(a.documents.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    known = a.receipts.groupBy("doc_id").agg(F.min("id").alias("_known"))
    rows = good.join(known, "doc_id", "left").withColumn("id", F.coalesce("_known", "doc_id")).withColumn("extra_json", F.lit("manual_edit"))
    receipts = rows.select(*[c for c in (*a.receipts.columns,) if c in rows.columns])
    items = rows.select(F.col("id").alias("receipt_id"), F.posexplode("items").alias("line_no", "i")).select("receipt_id", "line_no", "i.*").withColumn("id", F.col("receipt_id") * 10_000 + F.col("line_no"))
    return put_receipts(a, receipts, items.select(*[c for c in a.receipt_items.columns if c in items.columns]))


def delete_receipts(a: Archive, doc_ids: DataFrame) -> Archive:
    """Without the receipts of some documents (id), and without their items; the documents stay."""
    gone = a.receipts.join(doc_ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("id").alias("receipt_id"))
    return replace(a, receipts=a.receipts.join(gone.select(F.col("receipt_id").alias("id")), "id", "left_anti").select(*a.receipts.columns), receipt_items=a.receipt_items.join(gone, "receipt_id", "left_anti").select(*a.receipt_items.columns))


def promote(documents: DataFrame, ids: DataFrame, category: str) -> DataFrame:
    """Documents become receipts that are to be looked at; the count of rows that change is the caller's to take."""
    return where_ids(documents, ids, {"category": F.lit(category), "subcategory": F.lit(""), "status": F.lit("review")})


def clean_duplicates(documents: DataFrame, now: str) -> DataFrame:
    """All but the oldest of live documents with equal content go to the trash."""
    live = documents.where("deleted_at IS NULL AND content_hash <> ''")
    later = live.join(live.groupBy("content_hash").agg(F.min(F.struct("created_at", "id")).alias("first")), "content_hash").where(F.struct("created_at", "id") > F.col("first"))
    return to_trash(documents, later.select("id"), now)


def in_review(documents: DataFrame) -> DataFrame:
    """What a retry takes up."""
    return documents.where(all_of([F.col("status") == "review", F.col("deleted_at").isNull()]))
