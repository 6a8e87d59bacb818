"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is cut into marked words: a run of white-space marks with what follows it. No piece of the vocabulary holds a
mark after another character, so words are encoded apart. Control characters that no longer piece holds, such as line
ends, stand alone for the same reason. The distinct words of a batch are sorted, which is a
depth-first walk of their trie; the forward states of a prefix are kept while the walk is below it, so each edge of the
trie is worked once. Words seen in earlier batches come from a bounded cache.

A unigram vocabulary gives forward scores: the best sum of piece scores to each place, and the piece that it ends with.
Where two ways have the same sum, the library's choice hangs on how its single-precision sums from the start of the text
were rounded, and this one's doesn't.

A merge vocabulary (BPE) has no additive score. There the state of a prefix is the last piece of its encoding: of the
pieces that end a prefix exactly one follows the state before it as merging would leave the two. So the same forward
pass serves, with that test in place of a sum, and its results are the library's.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillstack.llm.common import documents, kept, map_batches

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Bytes of words and encodings that a worker keeps, and pairs of pieces that it has tested; either starts anew when it is full.
CACHED_BYTES, TESTED = 128_000_000, 1_000_000
#: What an entry takes beside its word and ids.
_ENTRY = 150
#: Characters of texts that are encoded together.
BATCH_CHARS = 4_000_000


class Codec:
    """Encodes and decodes with one model. One lives in each worker."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep texts as they are can be encoded word by word")
        if any(re.search(f"[^{MARK}]{MARK}", p.piece) or p.type in (4, 5) for p in proto.pieces):
            raise ValueError("a piece crosses the start of a word, or is user-defined or unused")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.bpe = proto.trainer_spec.model_type == 2
        self.pieces = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.scores = [p.score for p in proto.pieces]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self._score_of = {p: self.scores[i] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.lowest = min(self.scores) - 10
        inside = set().union(*(p for p in self.ids if len(p) > 1))
        # without pieces for bytes, unknown characters side by side are one piece, so they can't be cut apart
        alone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in inside) if self.bytes else ""
        if not self.bytes and MARK not in self.ids:
            raise ValueError("words can't be told apart where the mark is unknown")
        self._word = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+|[{alone}]" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self._ends: dict[str, int] = {}
        for piece in self.ids:
            self._ends[piece[-1]] = max(self._ends.get(piece[-1], 1), len(piece))
        self._fits: dict[str, dict[str, bool]] = {}
        self._fit_count = 0
        self._of_byte = {i: b for b, i in self.bytes.items()}
        self._is_byte = np.zeros(len(self.pieces), dtype=bool)
        self._is_byte[list(self._of_byte)] = True
        #: Pieces that merging their own characters gives.
        self.whole = {p for p in self.ids if self._merge(p) == (p,)} if self.bpe else set(self.ids)
        self._cache: dict[str, bytes] = {}
        self._cached = 0

    def _merge(self, text: str) -> tuple[str, ...]:
        """The merges of a piece or two, done one at a time: the best score first, the leftmost of equals."""
        parts, score, none = list(text), self._score_of.get, -float("inf")
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) > none:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], none)
        return tuple(parts)

    def _follows(self, left: str, right: str) -> bool:
        """Whether merging left + right leaves these two pieces."""
        if self._fit_count > TESTED:
            self._fits.clear()
            self._fit_count = 0
        self._fit_count += 1
        found = self._fits.setdefault(left, {})[right] = self._merge(left + right) == (left, right)
        return found

    def _forward_bpe(self, word: str, last: list[str], first: int) -> None:
        """Append to last, of which the first `first` hold, the last piece of the encoding of each longer prefix."""
        whole, fits, ends = self.whole, self._fits, self._ends
        for end in range(first, len(word) + 1):
            low = end - ends.get(word[end - 1], 1)
            for start in range(low if low > 0 else 0, end):
                piece = word[start:end]
                if piece in whole or start == end - 1:
                    if not start:
                        break
                    left = last[start]
                    found = fits[left].get(piece) if left in fits else None
                    if found or found is None and self._follows(left, piece):
                        break
            last.append(piece)

    def _forward_unigram(self, word: str, states: list[tuple[float, str]], first: int) -> None:
        """Append to states, of which the first `first` hold, the best score of each longer prefix and its last piece."""
        for end in range(first, len(word) + 1):
            best = None
            for start in range(max(0, end - self.longest), end):
                piece = word[start:end]
                i = self.ids.get(piece)
                if i is not None or len(piece) == 1:
                    score = states[start][0] + (self.scores[i] if i is not None else self.lowest)
                    if best is None or score > best[0]:
                        best = (score, piece)
            states.append(best)

    def _ids_of(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return struct.pack(f"<{len(out)}i", *out)

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """The cache, which then has the ids of each of these words, as little-endian 32-bit numbers."""
        if self._cached > CACHED_BYTES:
            self._cache, self._cached = {}, 0
        before, cache = "", self._cache
        step = self._forward_bpe if self.bpe else self._forward_unigram
        states: list = ["" if self.bpe else (0.0, "")]
        for word in sorted(words.difference(cache)):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :]
            step(word, states, shared + 1)
            pieces, end = [], len(word)
            while end:
                piece = states[end] if self.bpe else states[end][1]
                pieces.append(piece)
                end -= len(piece)
            cache[word] = ids = self._ids_of(pieces[::-1])
            self._cached += _ENTRY + 4 * len(word) + len(ids)
            before = word
        return cache

    def marked(self, text: str) -> list[str]:
        return self._word.findall(self.prefix + text.replace(" ", MARK)) if text else []

    def encode_raw(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        cut = [self.marked(t) for t in texts]
        known = self.encode_words(set().union(*cut)).__getitem__
        return [b"".join(map(known, words)) for words in cut]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(raw, dtype="<i4").tolist() for raw in self.encode_raw(texts)]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: pieces, with bytes put together, marks as spaces and without the mark put before the text."""
        ids = np.asarray(ids, dtype=np.int64)
        some_bytes = bool(self._is_byte[ids].any())
        ids = ids.tolist()
        if not some_bytes:
            text = "".join(map(self.pieces.__getitem__, ids))
        else:
            raw = b"".join([bytes((self._of_byte[i],)) if i in self._of_byte else self.pieces[i].encode() for i in ids])
            text = raw.decode("utf-8", "replace")
        return text.removeprefix(self.prefix).replace(MARK, " ")


@cache
def codec(model: str) -> Codec:
    import public_tokenizers

    return Codec(model if os.path.isabs(model) else public_tokenizers.path(model))


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """The columns `keep` of docs, with n_tokens, ids, ids_sha256 and round_trip, a row for each row.

    ids are the library's for the whole text, without special tokens; ids_sha256 is the digest of them as
    little-endian 32-bit numbers; round_trip tells whether decoding them gives the text (with marks read as spaces). A null text is an
    empty one, without ids. Rows that repeat get equal ids; an empty table gives no rows. A kept column named as a result
    gives way to it. Nothing is shuffled; a batch holds BATCH_CHARS characters, or one text.
    """
    new = ["n_tokens", "ids", "ids_sha256", "round_trip"]
    rest = kept(docs, keep, new)
    source = docs.select(*rest, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    added = {"n_tokens": F.lit(0).cast("long"), **({"ids": F.array().cast("array<int>")} if with_ids else {}), "ids_sha256": F.lit(""), "round_trip": F.lit(True)}
    schema = source.drop("_text").withColumns(added).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            start = 0
            while start < len(texts):
                end, chars = start, 0
                while end < len(texts) and (end == start or chars + len(texts[end]) <= BATCH_CHARS):
                    chars += len(texts[end])
                    end += 1
                part = texts[start:end]
                raw = c.encode_raw(part)
                digests = [hashlib.sha256(r).hexdigest() for r in raw]
                back = [c.decode(np.frombuffer(r, dtype="<i4")) == t.replace(MARK, " ") for r, t in zip(raw, part)]
                counts = np.array([len(r) // 4 for r in raw], dtype=np.int64)
                columns = [*(x.slice(start, end - start) for x in b.columns[:-1]), pa.array(counts)]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(raw), dtype="<i4")))
                columns += [pa.array(digests, pa.string()), pa.array(back, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                start = end

    return map_batches(source, run, schema)


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with `text`, the text of its ids; a column of that name is replaced.

    Null ids give null, no ids an empty text; ids beyond the vocabulary are an error. An empty table gives no rows.
    """
    rest = [c for c in encoded.columns if c not in (ids, text)]
    source = encoded.select(*rest, ids)
    schema = StructType([*encoded.select(*rest).schema.fields, StructField(text, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            texts = [None if i is None else c.decode(i) for i in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(texts, pa.string())], names=[*rest, text])

    return map_batches(source, run, schema)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), with_ids=False)
