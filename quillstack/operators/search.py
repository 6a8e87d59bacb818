"""Full-text search over a token table: prefix terms, all of which have to occur, and a bm25 rank."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.operators.library import ORDERS, DocumentFilter, library, sort_columns
from quillstack.plans.archive import Archive

FIELDS = ("filename", "sender", "subject", "reasoning", "extracted_text")


def _unmarked() -> dict[str, str]:
    """Latin letters with marks, in lower case, and the letters they are searched as: what Unicode decomposes them to, and those with strokes."""
    found = {"ø": "o", "ł": "l", "đ": "d"}
    for letter in map(chr, range(0xC0, 0x250)):
        plain = unicodedata.normalize("NFD", letter)
        if letter.islower() and len(plain) > 1 and plain[0].isascii():
            found[letter] = plain[0]
    return found


_MARKS = _unmarked()
_MARKED, _PLAIN = "".join(_MARKS), "".join(_MARKS.values())
_TOKEN = r"[\p{L}\p{N}]+"


def folded(c: Column) -> Column:
    """Lower case without marks, whether they are part of a letter or stand after it."""
    return F.regexp_replace(F.translate(F.lower(c), _MARKED, _PLAIN), r"\p{Mn}", "")


def fold(text: str) -> str:
    return "".join(c for c in text.lower().translate(str.maketrans(_MARKED, _PLAIN)) if not unicodedata.combining(c))


def terms(query: str) -> list[list[str]]:
    """The terms of a query; each is a phrase of adjacent tokens, of which the last is a prefix."""
    return [re.findall(r"[^\W_]+", fold(run)) for run in re.findall(r"[\w\u0300-\u036f]+", query) if re.search(r"[^\W_]", run)]


def tokens(a: Archive) -> DataFrame:
    """id, field, pos, token of every document in the library. Rebuilt from the batch; partition it by token to keep it."""
    columns = [c for c in FIELDS if c in a.documents.columns]
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.regexp_extract_all(folded(F.coalesce(F.col(c), F.lit(""))), F.lit(_TOKEN), F.lit(0)).alias("tokens")) for c in columns))
    each = library(a).select("id", F.explode(fields).alias("f")).select("id", "f.field", F.posexplode("f.tokens").alias("pos", "token"))
    return each


def _hits(index: DataFrame, term: list[str]) -> DataFrame:
    """(id, field, pos) at which a term begins."""
    out = index.where(F.startswith("token", F.lit(term[0])) if len(term) == 1 else F.col("token") == term[0]).select("id", "field", "pos")
    for i, t in enumerate(term[1:], 1):
        last = i == len(term) - 1
        step = index.where(F.startswith("token", F.lit(t)) if last else F.col("token") == t).select("id", "field", (F.col("pos") - i).alias("pos"))
        out = out.join(step, ["id", "field", "pos"], "left_semi")
    return out


def _in_text(text: Column, term: list[str]) -> Column:
    """Whether a term occurs in folded text, without a token table."""
    pattern = r"[^\p{L}\p{N}]+".join(map(re.escape, term))
    return text.rlike(rf"(?<![\p{{L}}\p{{N}}]){pattern}")


def match(a: Archive, query: str) -> DataFrame:
    """Documents with every term in some field, ids and categories; a query without terms finds all.

    A scan that tests the folded text in place: one pass, no shuffle. For many searches keep `tokens` and use `ranked`.
    """
    rows = library(a)
    columns = [folded(F.coalesce(F.col(c), F.lit(""))) for c in FIELDS if c in a.documents.columns]
    for term in terms(query):
        rows = rows.where(F.array_contains(F.array(*(_in_text(c, term) for c in columns)), True))
    return rows.select("id", "category")


def ranked(a: Archive, query: str, k1: float = 1.2, b: float = 0.75, limit: int = 50, index: DataFrame | None = None) -> DataFrame:
    """id, score: bm25 over all fields together, best first; every term has to occur. A query without terms finds nothing.

    index: `tokens` of the archive, stored; without one they are taken from the texts. Term and document counts of all
    terms come from one pass over it, lengths and their mean from another.
    """
    found = terms(query)
    if not found:
        return library(a).select("id", F.lit(0.0).alias("score")).limit(0)
    index = tokens(a) if index is None else index
    lengths = index.groupBy("id").agg(F.count("*").alias("length"))
    whole = lengths.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"), F.lit(1).alias("k"))
    single = [(i, term[0]) for i, term in enumerate(found) if len(term) == 1]
    which = F.filter(F.array(*(F.when(F.startswith("token", F.lit(t)), i) for i, t in single)), lambda i: i.isNotNull()) if single else F.array().cast("array<int>")
    hits = index.select("id", F.explode(which).alias("term"))
    for i, term in enumerate(found):
        if len(term) > 1:
            hits = hits.unionByName(_hits(index, term).select("id", F.lit(i).alias("term")))
    counts = hits.groupBy("id", "term").agg(F.count("*").alias("tf"))
    # a row a term: few
    rare = counts.groupBy("term").agg(F.count("*").alias("n"), F.lit(1).alias("k")).join(whole, "k")
    idf = F.greatest(F.lit(1e-6), F.ln((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    rare = rare.select("term", idf.alias("idf"), "mean")
    tf = F.col("tf").cast("double")
    each = counts.join(F.broadcast(rare), "term").join(lengths, "id")
    score = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    total = each.groupBy("id").agg(F.sum(score).alias("s"), F.count("*").alias("terms")).where(F.col("terms") == len(found))
    return total.select("id", F.round("s", 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def listing(a: Archive, query: str, f: DocumentFilter = DocumentFilter(), order_by: str = "doc_date", direction: str = "desc", limit: int = 200, offset: int = 0, index: DataFrame | None = None) -> DataFrame:
    """A page of the documents that a query finds and a filter lets through; by relevance or any order of the library's.

    Descending relevance is the best first. A query without terms is no restriction, and has no relevance: the date's
    order takes its place.
    """
    if order_by != "relevance" or not terms(query):
        rows = library(a).join(match(a, query).select("id"), "id", "left_semi").where(f.test())
        return rows.orderBy(*sort_columns(order_by if order_by in ORDERS else "doc_date", direction)).offset(offset).limit(limit)
    best = ranked(a, query, limit=2**31 - 1, index=index)
    score = F.desc("score") if direction != "asc" else F.asc("score")
    return library(a).where(f.test()).join(best, "id").orderBy(score, F.desc("id")).offset(offset).limit(limit).drop("score")
