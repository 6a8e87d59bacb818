"""A language model's replies: the first JSON object of a text, with values checked against what is allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillstack.functions.scalars import blank_to, clamp, normalise_date, to_number
from quillstack.sources import json_objects

# What a receipt may say (fixed values).
SHOP_TYPES = ["supermarkt", "drogerie", "baumarkt", "restaurant", "cafe", "tankstelle", "apotheke", "bekleidung", "elektronik", "buecher", "moebel", "versand", "sonstiges"]
ITEM_CATEGORIES = ["lebensmittel", "getraenke", "haushalt", "koerperpflege", "elektronik", "bekleidung", "buecher", "essen-trinken-aussehaus", "transport", "baumarkt", "tabak", "pfand", "rabatt", "sonstiges"]
PAYMENTS = ["bar", "girocard", "kreditkarte", "paypal", "sonstiges"]
ITEM = "array<struct<name:string,quantity:string,unit_price:string,total_price:string,item_category:string>>"
RECEIPT = f"shop_name string, shop_type string, payment_method string, total_amount string, currency string, receipt_date string, items {ITEM}"
CLASSIFICATION = "category string, subcategory string, tags array<string>, date string, sender string, subject string, confidence string, reasoning string"


@F.udf(StringType(), useArrow=False)  # row by row: a worker holds some replies, and needs neither pandas nor Arrow
def _first_object(text: str | None) -> str | None:
    return None if text is None else json_objects.first_object(text)


def first_object(reply: Column) -> Column:
    """The first JSON object of a reply: fences, prose before and text after are dropped. Null without one.

    The text from the first brace to its partner is tried; where it is no JSON, each later brace in turn. Replies come
    from Python and are read there, in time that grows with their length.
    """
    return _first_object(reply)


def receipts(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with the fields of a receipt and its items; `parsed` is false where there is no usable object."""
    r = F.from_json(first_object(F.col(reply)), RECEIPT)
    rows = replies.withColumn("_r", r)
    r = F.col("_r")
    item = lambda i: F.struct(
        F.substring(i["name"], 1, 200).alias("name"), to_number(i["quantity"]).alias("quantity"), to_number(i["unit_price"]).alias("unit_price"),
        to_number(i["total_price"]).alias("total_price"), F.when(blank_to(F.trim(i["item_category"]), "") == "", "").otherwise(clamp(F.lower(F.trim(i["item_category"])), ITEM_CATEGORIES, "sonstiges")).alias("item_category"),
    )
    named = lambda items: F.filter(items, lambda i: F.coalesce(F.trim(i["name"]), F.lit("")) != "")
    return rows.select(
        *replies.columns, r.isNotNull().alias("parsed"), F.substring(r["shop_name"], 1, 120).alias("shop_name"), clamp(F.lower(r["shop_type"]), SHOP_TYPES, "sonstiges").alias("shop_type"),
        clamp(F.lower(r["payment_method"]), PAYMENTS, "").alias("payment_method"), to_number(r["total_amount"]).cast("decimal(18,2)").alias("total_amount"),
        F.coalesce(F.nullif(r["currency"], F.lit("")), F.lit("EUR")).alias("currency"), normalise_date(r["receipt_date"]).alias("receipt_date"),
        F.transform(F.coalesce(named(r["items"]), F.array().cast(ITEM)), item).alias("items"),
    )


def classifications(replies: DataFrame, tree: dict[str, list[str]], reply: str = "reply", min_confidence: float = 0.65, other: str = "Sonstiges") -> DataFrame:
    """replies with category, subcategory, tags, date, sender, subject, confidence, reasoning and `route`.

    Categories that the tree doesn't have become `other`, subcategories that the category doesn't have are dropped; tags
    are lower-cased and keep the first of equals. route: filed, review (low confidence) or failed (no usable object).
    """
    rows = replies.withColumn("_c", F.from_json(first_object(F.col(reply)), CLASSIFICATION))
    c = F.col("_c")
    category = clamp(c["category"], list(tree), other)
    sub = F.lit("")
    for name, subs in tree.items():
        if subs:
            sub = F.when((category == name) & c["subcategory"].isin(subs), c["subcategory"]).otherwise(sub)
    tags = F.array_distinct(F.filter(F.transform(F.coalesce(c["tags"], F.array().cast("array<string>")), lambda t: F.trim(F.lower(t))), lambda t: t != ""))
    confidence = F.greatest(F.least(F.coalesce(to_number(c["confidence"]), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return rows.select(
        *replies.columns, category.alias("category"), sub.alias("subcategory"), tags.alias("tags"), normalise_date(c["date"]).alias("date"), c["sender"].alias("sender"),
        c["subject"].alias("subject"), confidence.alias("confidence"), c["reasoning"].alias("reasoning"),
        F.when(c.isNull(), "failed").when(confidence >= min_confidence, "filed").otherwise("review").alias("route"),
    )


def ask(documents: DataFrame, provider, prompt: str = "prompt", tries: int = 1, wait: float = 0.5) -> DataFrame:
    """documents with `reply`: a Python callable from prompts to replies runs in batches on the executors.

    A call that raises is tried again, `tries` times in all, after waits that double; then its reply is empty, and the
    rows after it go on. With one try an error ends the job.
    """
    schema = documents.withColumn("reply", F.lit("")).schema

    def answer(text: str) -> str:
        import time

        for n in range(tries):
            try:
                return provider(text)
            except Exception:
                if tries == 1:
                    raise
                if n + 1 < tries:
                    time.sleep(wait * 2**n)
        return ""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                columns = dict(zip(part.schema.names, part.columns))
                columns["reply"] = pa.array([answer(p) for p in columns[prompt].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return documents.mapInArrow(run, schema)
