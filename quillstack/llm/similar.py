"""Near-duplicates by the Jaccard similarity of word shingles, without a miss: the exact join gives the links.

A text is its set of five-word shingles, hashed to 64 bits. Texts with equal sets are one; of sets, `similar_links` finds
every pair that shares enough. Of each component of links one row stays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import map_batches, stored
from quillstack.llm.graph import components

SHINGLE = 5
#: The least similarity of a link.
PERCENT = 80
#: Sets, at some 500 elements, that a task compares with each other; more are dealt out in pairs of blocks.
HOT = 1 << 13
_SLICE = 1 << 15


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the shingles, sorted. A text of fewer words is one shingle, one without words has none.

    Words are runs of anything but ASCII white space, A-Z in lower case.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh3_64_intdigest
    if len(words) <= k:
        return np.array([digest(b" ".join(words))] if words else [], dtype=np.uint64)
    parts = []
    for at in range(0, len(words) - k + 1, _SLICE):
        few = words[at : at + _SLICE + k - 1]
        parts.append(np.fromiter(map(digest, map(b" ".join, zip(*(few[i:] for i in range(k))))), dtype=np.uint64))
    return np.unique(np.concatenate(parts))


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Bits of each hash that are independent of it and of other seeds' (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """docs with one row of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    The row of the least key stays, nulls last, then of the least hash of its text. All links are found and none is below
    the limit. Texts with equal sets, as those without words, are always linked. Of rows equal in key and text one stays.
    Null texts are empty. Keys are whole numbers. Columns are left as they are, whatever their names; an empty table
    gives no rows.
    """
    from quillstack.llm.jaccard_join import by_rare_elements, digested, similar_links  # which takes its sets from here

    body = F.coalesce(F.col(text), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("text"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    texts = keyed.select("doc_id", "th", "text")
    sets = map_batches(texts, digested(SHINGLE), "doc_id long, th long, digest string, size long")
    nodes = sets.groupBy("digest").agg(F.first("size").alias("size"), F.count("*").alias("weight"), F.min(place).alias("place"))
    nodes = stored(nodes.select("digest", "size", "weight", "place.doc_id", "place.th"))
    links = similar_links(texts, nodes, SHINGLE, PERCENT, hot * 512, by_rare_elements)
    roots = components(links.where("b is not null").select("a", "b"))
    classed = nodes.join(roots, nodes["digest"] == roots["node"], "left").withColumn("root", F.coalesce("root", "digest"))
    keepers = stored(classed.groupBy("root").agg(F.min(place).alias("kept")).select("kept"))
    # both sides are dealt by place, and so are the rows that repeat
    found = keyed.select(place.alias("place"), "row").join(keepers.hint("merge"), F.col("place") == F.col("kept"))
    return found.dropDuplicates(["place"]).select("row.*")
