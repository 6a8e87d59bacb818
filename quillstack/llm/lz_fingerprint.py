"""Lempel-Ziv phrase fingerprints: texts that compress each other have phrases, and so signatures, in common.

A text is parsed into dictionary phrases (Lempel and Ziv, 1978) over word-like symbols, each of which keeps its leading
space; a longer run of word characters than twelve is several symbols, so texts without spaces have phrases too, and
nothing is left out. A phrase is the shortest run of symbols that has not been a phrase before. The set of phrases is hashed, and the
least hash in each of BINS parts of the range is kept: one-permutation minimum hashing. The share of equal minima
estimates the likeness of the phrase sets. Of each minimum a byte is kept, so unequal ones agree once in 255 times: the
likeness of unlike texts is 0.004 too high on average, and less so the more they share.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.llm.common import documents, map_batches, stored

#: Parts of the range of hashes, a power of two, with a byte of the least hash of each.
BINS = 128
_EMPTY = 0xFF
_SYMBOL = re.compile(r" ?\w{1,12}|\W")


def phrases(text: str) -> set[str]:
    """The phrases of a text; what is left at its end counts as one."""
    seen: set[str] = set()
    add, phrase = seen.add, ""
    for symbol in _SYMBOL.findall(text):
        phrase += symbol
        if phrase not in seen:
            add(phrase)
            phrase = ""
    if phrase:
        add(phrase)
    return seen


def signature(text: str) -> np.ndarray:
    """BINS bytes, 255 for a part of the range without a phrase. No text: all of them so."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    hashes = np.sort(np.array([digest(p) for p in phrases(text)], dtype=np.uint64))
    out = np.full(BINS, _EMPTY, dtype=np.uint8)
    if len(hashes):
        parts, first = np.unique(hashes >> np.uint64(57), return_index=True)
        out[parts.astype(np.int64)] = hashes[first] % np.uint64(_EMPTY)
    return out


def to_hex(sig: np.ndarray) -> str:
    return sig.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of phrases in common, 0 to 1; of two texts without phrases, 1."""
    some = (a != _EMPTY) | (b != _EMPTY)
    n = int(some.sum())
    return float((a[some] == b[some]).sum()) / n if n else 1.0


def edited(text: str, following: str) -> str:
    """text with its last half, rounded down, replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id: int | None, text: str, sig: np.ndarray, following: str, following_sig: np.ndarray) -> tuple:
    changed = edited(text, following)
    changed_sig = signature(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, to_hex(sig), to_hex(changed_sig), likeness(sig, changed_sig), likeness(sig, following_sig)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: results of all rows but the last, and the texts of the first (`head`) and last row (`tail`)."""
    names, types = ["part", "role", "text", *_RESULT], [pa.int32(), pa.string(), pa.string(), *_RESULT.values()]
    part = TaskContext.get().partitionId()
    none = (None,) * (len(_RESULT) - 1)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    before = None  # doc_id, text, signature of the row before
    for b in batches:
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sig = before[2] if before and before[1] == text else signature(text)
            if before:
                rows.append((part, "row", None, *_row(*before, text, sig)))
            else:
                rows.append((part, "head", text, doc_id, *none))
            before = (doc_id, text, sig)
        if rows:
            yield batch(rows)
    if before:
        yield batch([(part, "tail", before[1], before[0], *none)])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text, following text): results."""
    for b in batches:
        rows = [_row(i, t, signature(t), f, signature(f)) for i, t, f in zip(*(c.to_pylist() for c in b.columns))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RESULT.values())], names=list(_RESULT))


def lz_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document of each is the one after it in descending order of key, nulls last, rows of one key in the order
    of a hash of their text; the first follows the last, and a lone row follows itself. Null texts are empty. Keys are
    whole numbers. Other
    columns are ignored, whatever their names. An empty table gives no rows.

    Texts move once, to ranges of (key, hash of the text), and each range is read row after row. Only the ends of
    ranges meet elsewhere: two texts for each partition.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    done = stored(map_batches(sorted_, _within, "part int, role string, text string, " + _DDL))
    heads = done.where("role = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    tails = done.where("role = 'tail'").select("part", "doc_id", "text")
    parts = tails.select("part")  # one row for each partition with rows
    first = parts.agg(F.min("part")).first()[0]
    following = parts.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.lit(first)).alias("next_part"))
    ends = tails.join(following, "part").join(heads, "next_part").select("doc_id", "text", "following")
    return done.where("role = 'row'").select(*_RESULT).union(map_batches(ends, _across, _DDL))


def op6_lz_fingerprints(spark, sf_dir: str) -> DataFrame:
    return lz_fingerprints(documents(spark, sf_dir))
