"""Whole flows of the archive: retries and backfills with a model's replies, receipt extraction, diagnostics, labels.

A provider is a Python callable from a prompt to a reply; it runs on the executors, in batches, with retries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions.scalars import all_of, blank_to
from quillstack.operators import library, writes
from quillstack.plans.archive import Archive
from quillstack.sources import replies

Provider = Callable[[str], str]
#: The category of receipts, and of what is filed by none.
RECEIPTS, OTHER_CATEGORY = "Kassenzettel", "Sonstiges"


def category_tree(path: str) -> dict[str, list[str]]:
    """The categories of a configuration file and their subcategories, in order. JSON, or YAML where its reader is installed.

    Entries are names, or mappings with `name` and `subcategories` (names, or mappings with `name`).
    """
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            import json

            found = json.load(f)
        else:
            import yaml

            found = yaml.safe_load(f)
    name = lambda x: x["name"] if isinstance(x, dict) else str(x)
    return {name(c): [name(s) for s in (c.get("subcategories") or [])] if isinstance(c, dict) else [] for c in (found or {}).get("categories") or []}


def _asked(documents: DataFrame, provider: Provider, text: str, tries: int) -> DataFrame:
    """id and reply of documents: the model's answer to their text; an empty one where all tries failed."""
    return replies.ask(documents.select("id", F.coalesce(F.col(text), F.lit("")).alias("prompt")), provider, tries=tries).drop("prompt")


def retry_review(a: Archive, provider: Provider, tree: dict[str, list[str]], ids: DataFrame | None = None, text: str = "extracted_text", min_confidence: float = 0.65, tries: int = 3) -> Archive:
    """Documents in review, all or those of ids, are classified again and get the route of the reply as their status."""
    rows = writes.in_review(a.documents)
    rows = rows if ids is None else rows.join(ids.select("id"), "id", "left_semi")
    found = replies.classifications(_asked(rows, provider, text, tries), tree, min_confidence=min_confidence, other=OTHER_CATEGORY)
    results = found.select("id", "category", "subcategory", "tags", "confidence", F.col("route").alias("status"))
    results = results.select(*[c for c in results.columns if c in a.documents.columns])
    # one merge, as replies would be asked for again in each; where there is no reply all but the status stays
    kept = {c: F.when(F.col("new_status") == "failed", F.col(f"old_{c}")).otherwise(F.col(f"new_{c}")) for c in results.columns if c not in ("id", "status")}
    return replace(a, documents=writes.merge(a.documents, results, "id", kept))


def backfill(a: Archive, provider: Provider, tree: dict[str, list[str]], cost_per_call: float = 0.0, text: str = "extracted_text", tries: int = 3) -> tuple[Archive, DataFrame]:
    """(the archive afterwards, one row: candidates, updated, skipped, moved, cost_usd).

    Candidates are filed documents without tags, or without a subcategory where their category has some. The category
    stays; tags and subcategory come from the reply, and a new subcategory moves the document. A reply without an object
    skips it; every call costs.
    """
    wanted = library.to_backfill(a, [c for c, subs in tree.items() if subs]).select("id")
    rows = a.documents.join(wanted, "id", "left_semi")
    found = replies.classifications(_asked(rows, provider, text, tries), tree, other=OTHER_CATEGORY)
    found = found.join(rows.select("id", F.col("category").alias("own"), F.col("subcategory").alias("before")), "id")
    # a subcategory counts in its own category only
    kept = F.when((F.col("category") == F.col("own")) & (F.col("subcategory") != ""), F.col("subcategory")).otherwise(F.coalesce("before", F.lit("")))
    done = found.where("route <> 'failed'").select("id", kept.alias("subcategory"), "tags", "before")
    moved = blank_to(F.col("before"), "") != F.col("subcategory")
    counts = done.agg(F.count("*").alias("updated"), F.count(F.when(moved, 1)).alias("moved"), F.lit(1).alias("k"))
    calls = found.agg(F.count("*").alias("candidates"), F.lit(1).alias("k")).join(counts, "k")
    report = calls.select("candidates", "updated", (F.col("candidates") - F.col("updated")).alias("skipped"), "moved", F.round(F.col("candidates") * cost_per_call, 4).alias("cost_usd"))
    return replace(a, documents=writes.merge(a.documents, done.select("id", "subcategory", "tags"), "id")), report


def extract_receipts(a: Archive, provider: Provider, ids: DataFrame | None = None, again: bool = False, text: str = "extracted_text", tries: int = 3) -> tuple[Archive, DataFrame]:
    """(the archive afterwards, one row: asked, stored, failed): receipts of documents of the receipts' category.

    Those of ids, or all; without `again` only those that have none. A document has one receipt, with its own id unless
    it has one already. A reply without an object leaves what there is.
    """
    rows = library.library(a).where(F.col("category") == RECEIPTS)
    rows = rows if ids is None else rows.join(ids.select("id"), "id", "left_semi")
    rows = rows if again else rows.join(a.receipts.select(F.col("doc_id").alias("id")).distinct(), "id", "left_anti")
    found = replies.receipts(_asked(rows, provider, text, tries).withColumnRenamed("id", "doc_id"))
    known = a.receipts.groupBy("doc_id").agg(F.min("id").alias("_known"))
    good = found.where("parsed").join(known, "doc_id", "left").withColumn("id", F.coalesce("_known", "doc_id"))
    items = good.select(F.col("id").alias("receipt_id"), F.posexplode("items").alias("line_no", "i")).select("receipt_id", "line_no", "i.*").withColumn("id", F.col("receipt_id") * 10_000 + F.col("line_no"))
    after = writes.put_receipts(a, good.select(*[c for c in a.receipts.columns if c in good.columns]), items.select(*[c for c in a.receipt_items.columns if c in items.columns]))
    report = found.agg(F.count("*").alias("asked"), F.count(F.when(F.col("parsed"), 1)).alias("stored"), F.count(F.when(~F.col("parsed"), 1)).alias("failed"))
    return after, report


def diagnostics(a: Archive, doc_id: int) -> DataFrame:
    """What there is of a document, one row: its status and text, receipt and items, statement and bookings, and copies of it."""
    one = a.documents.where(F.col("id") == doc_id).select("id", "status", "category", F.length("extracted_text").alias("n_chars"), F.col("deleted_at").isNotNull().alias("in_trash"), "content_hash")
    count = lambda df, name: df.agg(F.count("*").alias(name), F.lit(doc_id).cast("long").alias("id"))
    receipts = a.receipts.where(F.col("doc_id") == doc_id)
    statements = a.statements.where(F.col("doc_id") == doc_id)
    items = a.receipt_items.join(receipts.select(F.col("id").alias("receipt_id")), "receipt_id", "left_semi")
    bookings = a.transactions.join(statements.select(F.col("id").alias("statement_id")), "statement_id", "left_semi")
    same = a.documents.where(F.col("id") != doc_id).join(one.select("content_hash"), "content_hash", "left_semi")
    for df, name in ((receipts, "receipts"), (items, "receipt_items"), (statements, "statements"), (bookings, "transactions"), (same, "copies")):
        one = one.join(count(df, name), "id", "left")
    return one.drop("content_hash")


def labelled(rows: DataFrame, translations: DataFrame, lang: str, column: str = "category", prefix: str = "cat.", fallback: str = "en") -> DataFrame:
    """rows with `label`: the translation (lang, key, value) of prefix + column, else the fallback language's, else the name itself."""
    of = lambda code, name: translations.where(F.col("lang") == code).groupBy("key").agg(F.min("value").alias(name))
    keyed = rows.withColumn("key", F.concat(F.lit(prefix), F.col(column)))
    joined = keyed.join(of(lang, "_own"), "key", "left").join(of(fallback, "_other"), "key", "left")
    return joined.withColumn("label", F.coalesce("_own", "_other", column, F.lit(""))).select(*rows.columns, "label")


def pick_language(cookie: str | None, accepted: str | None, supported: list[str], default: str = "de", fallback: str = "en") -> str:
    """The language of a request: the cookie's, the first accepted one that is supported, the default, or the fallback."""
    wanted = [cookie or ""] + [part.split(";")[0].strip().split("-")[0].lower() for part in (accepted or "").split(",")]
    return next((x for x in wanted if x in supported), default if default in supported else fallback)


def bulk_update(a: Archive, ids: DataFrame, category: str | None = None, library_path: str | None = None) -> Archive:
    """Documents by id get a category, a path, or both."""
    columns = {c: F.lit(v) for c, v in (("category", category), ("library_path", library_path)) if v is not None}
    return replace(a, documents=writes.where_ids(a.documents, ids, columns))


def status_counts(a: Archive) -> DataFrame:
    """One row: documents without a text, without a date, and without a category, of those that live."""
    live = library.library(a)
    when = lambda *tests: F.count(F.when(all_of(list(tests)), 1))
    blank = lambda c: blank_to(F.col(c), "") == ""
    return live.agg(F.count("*").alias("n"), when(blank("extracted_text")).alias("without_text"), when(blank("doc_date")).alias("without_date"), when(blank("category")).alias("without_category"))


def upload(files: DataFrame, inbox: str) -> DataFrame:
    """Files (name, content) into the inbox, as a table to be acted on: name and stored_as, null where the suffix isn't taken.

    Executors write each file beside its place and move it there when it is whole, so that a stream never sees half a
    file. A name that other content holds already gets a part of the content's digest; the same content again changes
    nothing, so a task may run twice. Of equal names in one table, the later ones get -2, -3.
    """
    from quillstack.streaming.inbox import SUFFIX_LIST

    marked = library.with_collision_suffix(files.select("name", "content", F.sha2("content", 256).alias("id")), "name")
    taken = F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1)).isin(SUFFIX_LIST)

    def run(frames):
        import uuid

        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(inbox if "://" in inbox else f"file://{inbox}")
        where.create_dir(f"{root}/.staged")
        for f in frames:
            stored = []
            for name, digest, content in zip(f["final_path"], f["id"], f["content"]):
                if name is None:
                    stored.append(None)
                    continue
                stem, _, suffix = name.rpartition(".")
                same = lambda n: where.get_file_info(f"{root}/{n}").type == fs.FileType.NotFound or where.open_input_file(f"{root}/{n}").read() == content
                name = name if same(name) else f"{stem}-{digest[:8]}.{suffix}"
                stage = f"{root}/.staged/{uuid.uuid4().hex}"
                with where.open_output_stream(stage) as out:
                    out.write(content)
                where.move(stage, f"{root}/{name}")
                stored.append(name)
            yield f[["name"]].assign(stored_as=stored)

    return marked.withColumn("final_path", F.when(taken, F.col("final_path"))).mapInPandas(run, "name string, stored_as string")
