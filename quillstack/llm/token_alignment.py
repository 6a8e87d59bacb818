"""Alignment of the tokens of two tokenizers, and corpus-wide counts of the token ids that end together.

The sorted ends of B's tokens are a static interval index. For each A token, bisection finds the B tokens that its bytes
overlap; the gaps between those are spanned. Gaps that no A token spans are where both tokenizers cut, and there the
tokens fall into groups. The last tokens of a group end together and are a link.

Texts are cut into cells where both vocabularies prove a cut: before a space or line end that follows other than white
space, and between a letter or digit and a mark that no piece of B joins. A cell is encoded and aligned once and then found in a bounded cache. Documents are worked in blocks: a block
keeps, packed, which linked pairs of ids each of its documents has, and hands on one row for each distinct pair. These
are summed over the corpus and come back to the block, so a pair that every document has costs a row for each block.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import documents, kept, map_batches, stored
from quillstack.llm.sentencepiece_codec import MARK, Codec

A_MODEL, B_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of the texts of a block.
BLOCK_CHARS = 4_000_000
#: Bytes of cells that a worker keeps, by estimate; then it starts anew.
CACHED_BYTES = 160_000_000
_ENTRY = 400
#: Letters and digits (the oldest blocks, on which all tables of characters agree), and marks: A never joins the former to a mark after them.
_KNOWN, _MARKS = "0-9A-Za-zÀ-ÖØ-öø-ʯΑ-Ωα-ωА-я", "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"


def groups(a_ends: Sequence[int], b_ends: Sequence[int]) -> list[tuple[int, int]]:
    """(A tokens, B tokens) up to each place where tokens of both end. Tokens are given by their ends, rising, from byte 0."""
    spanned = bytearray(len(b_ends))
    start = 0
    for end in a_ends:
        first, last = bisect_right(b_ends, start), bisect_left(b_ends, end)
        if first < last:  # this A token overlaps B tokens first..last and spans the gaps between
            spanned[first:last] = b"\1" * (last - first)
        start = end
    return [(bisect_left(a_ends, end) + 1, i + 1) for i, end in enumerate(b_ends) if not spanned[i]]


class _Pieces(Codec):
    """B's encoder, for parts of texts."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__(path)
        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        #: White space that no piece joins to what is before it.
        self.cuts = " \n" if self._word.findall("a\na") == ["a", "\n", "a"] else " "
        known = re.compile(f"[{_KNOWN}]")
        joined = {c for p in self.ids for x, c in zip(p, p[1:]) if c in _MARKS and known.match(x)}
        #: Marks that no piece joins to a letter or digit before them.
        self.marks = "".join(sorted(set(_MARKS) - joined))
        self.lengths = [1 if i in self._of_byte else len(p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]
        self.raw = [bytes((self._of_byte[i],)) if i in self._of_byte else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """The ids of each part, which starts where no piece goes across and has the mark before the text already.

        Parts after a space are what the library makes of them, as it puts that space; the others are encoded here.
        """
        spaced = [len(p) > 1 and p[0] == " " for p in parts]
        whole = iter(self._library.encode([p[1:] for p, s in zip(parts, spaced) if s], num_threads=1) if self.prefix else ())
        if not self.prefix:
            spaced = [False] * len(parts)
        cut = [self._word.findall(p.replace(" ", MARK)) for p, s in zip(parts, spaced) if not s]
        known = self.encode_words(set().union(*cut)).__getitem__
        rest = (np.frombuffer(b"".join(map(known, words)), dtype="<i4").tolist() for words in cut)
        out = [next(whole if s else rest) for s in spaced]
        self._cache, self._cached = {}, 0  # the cells are kept elsewhere
        return out


class _Bytes:
    """A's encoder: a byte-level vocabulary, whose entries stand for bytes one character each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # printable characters stand for themselves, the other bytes for characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.raw: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.raw[i] = bytes(map(byte.__getitem__, token))
        self.lengths = list(map(len, self.raw))

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


def _ends(ids: list[int], lengths: list[int]) -> list[int]:
    out, at = [], 0
    for i in ids:
        at += lengths[i]
        out.append(at)
    return out


class Aligner:
    """Cells that were encoded and aligned, numbered. One lives in each worker."""

    def __init__(self, a: str, b: str):
        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = (kind(m if os.path.isabs(m) else public_tokenizers.path(m)) for kind, m in ((_Bytes, a), (_Pieces, b)))
        cuts = re.escape(self.b.cuts)
        stop = f"(?![{re.escape(self.b.marks)}])" if self.b.marks else ""
        word = rf"(?=\S)(?:[^\s{_KNOWN}]*+[{_KNOWN}]++{stop})*+[^\s{_KNOWN}]*+[{_KNOWN}]*+"
        # a cell goes on over white space of other kinds
        self._cell = re.compile(rf"\s*+{word}(?:[^\S{cuts}]\s*+{word})*(?:[^\S{cuts}]\s*\Z)?|\s+")
        self.clear()

    def clear(self) -> None:
        self.id_of: dict[str, int] = {}
        self.text: list[bytes] = []
        self.n_a, self.n_b, self.n_links, self.bad, self.first = array("i"), array("i"), array("i"), array("b"), array("q", [0])
        self.links = array("i")
        self._pair_of: dict[int, int] = {}
        self.pairs = array("q")
        self.size = 0

    def cells(self, text: str | None) -> list[str]:
        return self._cell.findall(" " + text) if text else []

    def add(self, cells: list[str]) -> None:
        a_raw, b_raw = self.a.raw.__getitem__, self.b.raw.__getitem__
        for at in range(0, len(cells), 20_000):
            part = cells[at : at + 20_000]
            for cell, a_ids, b_ids in zip(part, self.a.encode_parts(part), self.b.encode_parts(part)):
                raw = cell.encode("utf-8", "surrogatepass")
                same = b"".join(map(a_raw, a_ids)) == raw == b"".join(map(b_raw, b_ids))
                if not same:
                    cut = []
                elif len(a_ids) == 1 or len(b_ids) == 1:
                    cut = [(len(a_ids), len(b_ids))]
                else:
                    cut = groups(_ends(a_ids, self.a.lengths), _ends(b_ids, self.b.lengths))
                text, i, j = [], 0, 0
                a_text, b_text = list(map(str, a_ids)), list(map(str, b_ids))
                for m, n in cut:
                    text.append(f"{','.join(a_text[i:m])}|{','.join(b_text[j:n])}")
                    i, j = m, n
                    pair = a_ids[m - 1] << 32 | b_ids[n - 1]
                    number = self._pair_of.setdefault(pair, len(self.pairs))
                    if number == len(self.pairs):
                        self.pairs.append(pair)
                    self.links.append(number)
                self.id_of[cell] = len(self.text)
                self.text.append(";".join(text).encode())
                self.n_a.append(len(a_ids))
                self.n_b.append(len(b_ids))
                self.n_links.append(len(cut))
                self.bad.append(not same)
                self.first.append(len(self.links))
                self.size += _ENTRY + 2 * len(raw) + len(self.text[-1])

    def block(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, bytes]:
        """Of each text n_a, n_b and n_links, and the digest of its groups; then the block's pairs, how often each is linked, and which texts have which."""
        if self.size > CACHED_BYTES:
            self.clear()
        cut = [self.cells(t) for t in texts]
        self.add(sorted(set().union(*cut).difference(self.id_of)))
        view = lambda values, kind: np.frombuffer(values, dtype=kind) if len(values) else np.empty(0, kind)
        sizes = np.array([len(c) for c in cut], dtype=np.int64)
        numbers = list(map(self.id_of.__getitem__, chain.from_iterable(cut)))
        del cut
        ids = np.array(numbers, dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        total = lambda values: np.bincount(owner, weights=values[ids], minlength=len(texts)).astype(np.int64)
        good = total(view(self.bad, np.int8)) == 0
        counts = [total(view(v, np.int32)) * good for v in (self.n_a, self.n_b, self.n_links)]
        text_of, ends = self.text.__getitem__, np.cumsum(sizes).tolist()
        digests = [hashlib.sha256(b";".join(map(text_of, numbers[e - n : e]))).hexdigest() if g and n else "" for e, n, g in zip(ends, sizes.tolist(), good.tolist())]
        del numbers
        use = good[owner]
        ids, owner = ids[use], owner[use]
        first = view(self.first, np.int64)
        n = first[ids + 1] - first[ids]
        at = np.repeat(first[ids] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        linked, owner = view(self.links, np.int32)[at].astype(np.int64), np.repeat(owner, n)
        del at, first
        distinct, local, times = np.unique(linked, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # small numbers for frequent pairs
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        packed, often = np.unique(owner << 32 | rank[local], return_counts=True)
        entries = np.bincount(packed >> 32, minlength=len(texts)).astype("<i4")
        payload = zlib.compress(np.concatenate([entries, (packed & 0xFFFFFFFF).astype("<i4"), often.astype("<i4")]).astype("<i4").tobytes(), 1)
        return counts, digests, view(self.pairs, np.int64)[distinct[order]].copy(), times[order].astype(np.int64), payload


@cache
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def _blocks(texts: list[str | None], chars: int) -> Iterator[slice]:
    start = 0
    while start < len(texts):
        end, n = start, 0
        while end < len(texts) and (end == start or n + len(texts[end] or "") <= chars):
            n += len(texts[end] or "")
            end += 1
        yield slice(start, end)
        start = end


_NEW = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def aligned_blocks(docs: DataFrame, a: str = A_MODEL, b: str = B_MODEL, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, docs, pairs, times, payload): documents by the block, with the linked pairs of ids (A's << 32 | B's) of the block, how often each is linked in it, and, packed, which of its documents have which."""
    rest = kept(docs, keep, _NEW + ["n_best", "count_sum"])
    source = docs.select(*rest, F.col(text).alias("_text"))
    item = source.select(*rest, *(F.lit(0).cast("long").alias(c) for c in _NEW[:-1]), F.lit("").alias(_NEW[-1])).schema
    schema = f"block long, docs array<{item.simpleString()}>, pairs array<long>, times array<long>, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, al = TaskContext.get().partitionId() << 32, aligner(a, b)
        for whole in batches:
            texts = whole.column(len(rest)).to_pylist()
            for part in _blocks(texts, chars):
                (n_a, n_b, n_links), digests, pairs, times, payload = al.block(texts[part])
                columns = [c.slice(part.start, part.stop - part.start) for c in whole.columns[:-1]]
                columns += [pa.array(n_a), pa.array(n_b), pa.array(n_links), pa.array(n_links), pa.array(digests, pa.string())]
                rows = pa.StructArray.from_arrays(columns, names=[*rest, *_NEW])
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (rows, pa.array(pairs), pa.array(times))]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([payload], pa.binary())], names=["block", "docs", "pairs", "times", "payload"])
                number += 1

    return map_batches(source, run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, b, count, best): how many links of the corpus hold each pair of ids, and whether no pair with that B id has more."""
    single = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = stored(single.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """docs, payload, values -> the documents with n_best and count_sum."""
    for whole in batches:
        for i in range(whole.num_rows):
            b = whole.slice(i, 1)
            rows, values, n = b.column(0).flatten(), b.column(2).flatten(), len(b.column(0)[0])
            count, best = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
            if len(values):
                at = values.field("at").to_numpy()
                count[at], best[at] = values.field("count").to_numpy(), values.field("best").to_numpy(zero_copy_only=False)
            packed = np.frombuffer(zlib.decompress(b.column(1)[0].as_py()), dtype="<i4")
            entries, (pair, often) = packed[:n], packed[n:].reshape(2, -1)
            owner = np.repeat(np.arange(n), entries)
            # sums of integers, not of floating-point weights
            sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
            for into, value in zip(sums, (best, count)):
                np.add.at(into, owner, value[pair] * often)
            yield pa.RecordBatch.from_arrays([*rows.flatten(), *map(pa.array, sums)], names=[*(f.name for f in rows.type), "n_best", "count_sum"])


def align(docs: DataFrame, a: str = A_MODEL, b: str = B_MODEL, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns `keep` of docs with n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum, a row for each row.

    A (a byte-level vocabulary of the tokenizers library) encodes a space and the text, B (a sentencepiece model) the
    text, before which it puts a space; special tokens are plain text. Null and empty texts, and those that either
    vocabulary can't give back byte by byte, have no tokens: zeros, and an empty digest. The count of a link is how many
    links of the corpus hold its pair of ids; n_best counts links with the highest count of their B id, ties included;
    count_sum sums counts. Rows that repeat count each. A kept column named as a result gives way to it. An empty table
    gives no rows.
    """
    blocks = stored(aligned_blocks(docs, a, b, text, keep, chars))
    places = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    values = places.join(pair_counts(blocks), "pair").groupBy("block").agg(F.collect_list(F.struct("at", "count", "best")).alias("values"))
    none = F.array().cast("array<struct<at:int,count:bigint,best:boolean>>")
    whole = blocks.select("block", "docs", "payload").join(values, "block", "left").select("docs", "payload", F.coalesce("values", none).alias("values"))
    item = blocks.schema["docs"].dataType.elementType.simpleString()
    return map_batches(whole, _scored, f"{item[7:-1]},n_best:bigint,count_sum:bigint")


def token_groups(docs: DataFrame, a: str = A_MODEL, b: str = B_MODEL, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with `groups`, the aligned groups as text (`a1,a2|b1;a3|b2,b3`), empty for texts without tokens."""
    rest = kept(docs, keep, ["groups"])
    source = docs.select(*rest, F.col(text).alias("_text"))
    schema = source.select(*rest, F.lit("").alias("groups")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a, b)
        for batch in batches:
            found = []
            for t in batch.column(len(rest)):
                if al.size > CACHED_BYTES:
                    al.clear()
                cells = al.cells(t.as_py())
                al.add(sorted(set(cells).difference(al.id_of)))
                ids = list(map(al.id_of.__getitem__, cells))
                found.append("" if any(al.bad[i] for i in ids) else b";".join(al.text[i] for i in ids).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=[*rest, "groups"])

    return map_batches(source, run, schema)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
