"""Exact token counts of whole texts, however long.

Ordinary texts go to the library as they are. A text beyond `chunk` characters is encoded in overlapping chunks with
offsets. Two neighbours are spliced inside their overlap at a boundary that both have and that the vocabulary proves
stable: two characters that stand side by side in no piece, so that no piece and no merge can cross it. Where an overlap
holds no such place it is widened; where the whole chunk holds none the chunk is doubled, so failures cost no more than
a constant multiple of the text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import documents, kept, map_batches

MODEL = "piece_bpe_32k.model"
CHUNK, OVERLAP, LIMIT = 16_384, 512, 4096


@dataclass(frozen=True)
class Boundaries:
    """What a vocabulary proves: the pairs of characters that some piece joins, and the characters that it has."""

    joined: frozenset[str]
    known: frozenset[str]
    #: Whether neighbouring unknown characters make one piece, as they do without pieces for bytes.
    fused: bool

    def last(self, text: str, low: int, high: int) -> int | None:
        """The last place in low..high-1 that nothing crosses. The text has marks for spaces."""
        for i in range(high - 1, max(low, 1) - 1, -1):
            if text[i - 1 : i + 1] not in self.joined and not (self.fused and text[i] not in self.known and text[i - 1] not in self.known):
                return i
        return None


@cache
def _library(model: str):
    """The processor, and the boundaries that its vocabulary proves, or none. Loaded once in a worker."""
    import os

    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = model if os.path.isabs(model) else public_tokenizers.path(model)
    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec, sp = proto.normalizer_spec, sentencepiece.SentencePieceProcessor(model_file=path)
    if spec.name != "identity" or spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or any(p.type in (4, 5) for p in proto.pieces):
        return sp, None
    pieces = [p.piece for p in proto.pieces if p.type == 1]
    joined = frozenset(p[i : i + 2] for p in pieces for i in range(len(p) - 1))
    return sp, Boundaries(joined, frozenset("".join(pieces)), not any(p.type == 6 for p in proto.pieces))


def _begins(sp, text: str) -> list[int]:
    return [b for b, _ in sp.encode(text, return_type="offset_mapping")["offsets"]]


def _has(places: list[int], at: int) -> bool:
    i = bisect_left(places, at)
    return i < len(places) and places[i] == at


def count_spliced(sp, proven: Boundaries, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """(tokens, chunks) of a long text."""
    marked, n = text.replace(" ", "▁"), len(text)
    start, end, cut, total, chunks = 0, min(n, chunk), 0, 0, 1
    begins = _begins(sp, text[:end])
    while end < n:
        back, at = overlap, None
        while True:
            after = max(start, end - back)
            at = proven.last(marked, max(after, cut) + 1, end)
            if at is not None or after == start:
                break
            back *= 2  # alignment failed: widen the overlap
        if at is not None:
            after_end = min(n, end + chunk)
            following = _begins(sp, text[after:after_end])
            if not (_has(begins, at - start) and _has(following, at - after)):
                at = None
        if at is None:  # nothing to align on in the whole chunk: make it longer
            end = min(n, start + 2 * (end - start))
            begins = _begins(sp, text[start:end])
            continue
        total += bisect_left(begins, at - start) - bisect_left(begins, cut - start)
        begins, start, end, cut, chunks = following, after, after_end, at, chunks + 1
    return total + len(begins) - bisect_left(begins, cut - start), chunks


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with n_bytes, n_tokens, over_limit and n_chunks, a row for each row.

    model: an absolute path that executors have, or the name of a file of the public vocabularies. Null is an empty
    text, with no bytes or tokens. Rows that repeat are counted alike; an empty table gives no rows. A kept column named
    as a result gives way to it.
    """
    new = ["n_bytes", "n_tokens", "over_limit", "n_chunks"]
    rest = kept(docs, keep, new)
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(*rest, F.octet_length(body).cast("long").alias("n_bytes"), body.alias("_text"))
    schema = source.drop("_text").withColumns({"n_tokens": F.lit(0).cast("long"), "over_limit": F.lit(True), "n_chunks": F.lit(1)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, proven = _library(model)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            counts, chunks = [0] * b.num_rows, [1] * b.num_rows
            short: list[int] = []
            lengths = pa.compute.utf8_length(texts).to_pylist()
            for i, n in enumerate(lengths):
                if proven and n > chunk:
                    counts[i], chunks[i] = count_spliced(sp, proven, texts[i].as_py(), chunk, overlap)
                else:
                    short.append(i)
            for at in range(0, len(short), 256):
                part = short[at : at + 256]
                for i, ids in zip(part, sp.encode([texts[i].as_py() for i in part], num_threads=1, return_type="numpy")):
                    counts[i] = len(ids)
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n, pa.compute.greater(n, limit), pa.array(chunks, pa.int32())], schema=pa.schema([*list(b.schema)[:-1], ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_chunks", pa.int32())]))

    return map_batches(source, run, schema)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
