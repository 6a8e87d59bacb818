"""Near-duplicates by SimHash, found by fuzzy hashing with the Golay code.

A fingerprint is cut into segments of 23 bits at most, and each segment is decoded to the indices of the Golay codewords
nearby: one key or six. Pigeonhole on the segments' errors says which keys two close fingerprints must share. Rows with
a key in common meet in a shuffle; each bucket is verified there by Hamming distance, and gives links that connect
whatever is linked within it: a forest, not all pairs. Connected components finish the work.

Only distinct fingerprints are hashed and linked, so copies cost nothing beyond their fingerprint. A key with more than
HOT distinct fingerprints is dealt out again in pairs of blocks, which together hold every pair of the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm import golay
from quillstack.llm.common import documents, map_batches, stored
from quillstack.llm.graph import components

#: Distinct fingerprints of one key that a task compares; beyond, the key is dealt out in pairs of blocks of half that.
HOT = 1 << 15
#: Rows of one fingerprint that may meet in a task.
CROWD = 100_000
#: Hashes of a document that are unpacked to bits at once.
_SLICE = 1 << 16


@dataclass(frozen=True)
class Scheme:
    """How fingerprints are made and compared: shingles of so many words, 64 bits of each seed, linked at `radius` bits."""

    shingle: int
    seeds: tuple[int, ...]
    bits: int
    radius: int
    keys: Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def _exact_keys(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) so that any two 64-bit fingerprints at three bits or less share a key.

    Of three segments, either one agrees and another has one error at most, or each has one error. The first case keys
    on a whole segment and a codeword of another. In the second, one side spreads over the neighbours in the first and
    last segment and the other side in the middle one, so that each row is in few buckets.
    """
    v = prints[:, 0]
    seg = [(v & np.uint64(0x3FFFFF)).astype(np.int64), (v >> np.uint64(22) & np.uint64(0x1FFFFF)).astype(np.int64), (v >> np.uint64(43)).astype(np.int64)]
    rows = np.arange(len(v))
    one = [golay.decode(s).astype(np.int64) for s in seg]
    more = [golay.near(s) for s in seg]
    family = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                keys, valid = more[j]
                whole = (family << 40) | (seg[i] << 12)
                yield np.broadcast_to(rows[:, None], keys.shape)[valid], (whole[:, None] | keys)[valid]
                family += 1
    (k0, v0), (k1, v1), (k2, v2) = more
    wide = (family << 40) | (k0[:, :, None] << 24) | (one[1] << 12)[:, None, None] | k2[:, None, :]
    valid = v0[:, :, None] & v2[:, None, :]
    yield np.broadcast_to(rows[:, None, None], wide.shape)[valid], wide[valid]
    narrow = (family << 40) | (one[0] << 24)[:, None] | (k1 << 12) | one[2][:, None]
    valid = v1 & (k1 != one[1][:, None])  # the one left out is among the wide ones
    yield np.broadcast_to(rows[:, None], narrow.shape)[valid], narrow[valid]


#: The contract's: three words, 64 bits, three bits apart at most; every such link is found.
EXACT = Scheme(3, (42,), 64, 3, _exact_keys)


def fingerprint(text: str | None, scheme: Scheme) -> np.ndarray:
    """One word of 64 bits for each seed; a bit is set if it is set in over half the shingles' hashes. No words: zero."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only
    k = scheme.shingle
    if len(words) <= k:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(k)))))
    out = np.zeros(len(scheme.seeds), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for n, seed in enumerate(scheme.seeds):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(shingles), _SLICE):
            hashes = np.array([digest(s, seed) for s in shingles[at : at + _SLICE]], dtype="<u8")
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        bits = np.packbits(2 * ones > len(shingles), bitorder="little")
        out[n] = bits.view("<u8")[0]
    left = 64 * len(scheme.seeds) - scheme.bits
    if left:
        out[-1] &= np.uint64((1 << (64 - left)) - 1)
    return out


def with_fingerprint(docs: DataFrame, scheme: Scheme = EXACT, text: str = "text") -> DataFrame:
    """docs without its text, with `fingerprint`, 16 hex digits for each seed. A column of that name is replaced."""
    rest = [c for c in docs.columns if c not in (text, "fingerprint")]
    schema = docs.select(*rest, F.lit("").alias("fingerprint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = ["".join(f"{x:016x}" for x in fingerprint(t.as_py(), scheme)) for t in b.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(found, pa.string())], names=[*rest, "fingerprint"])

    return map_batches(docs.select(*rest, text), run, schema)


def _parse(hexes: pa.Array, words: int) -> np.ndarray:
    raw = bytes.fromhex("".join(hexes.to_pylist()))
    return np.frombuffer(raw, dtype=">u8").astype(np.uint64).reshape(-1, words)


def _emit(scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                prints = _parse(part.column(0), len(scheme.seeds))
                for rows, keys in scheme.keys(prints):
                    picked = prints[rows].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *(pa.array(picked[:, i]) for i in range(picked.shape[1]))], names=_names(scheme))

    return run


def _names(scheme: Scheme) -> list[str]:
    return ["key", *(f"p{i}" for i in range(len(scheme.seeds)))]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


def _forest(prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected at radius bits, at most one fewer than there are fingerprints."""
    left = np.arange(len(prints))
    todo: list[int] = []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
            continue
        at = todo.pop()
        hit = _distance(prints[left], prints[at]) <= radius
        if hit.any():
            found, left = left[hit], left[~hit]
            yield np.repeat(prints[at][None, :], len(found), axis=0), prints[found]
            todo.extend(found.tolist())


def _links(keys: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """Links among the rows of equal keys, as rows of two fingerprints; keys are sorted."""
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts = np.concatenate([[0], edges]).astype(np.int64)
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    small = np.repeat(sizes < 8, sizes)
    for d in range(1, 8):
        if d >= len(keys):
            break
        at = np.flatnonzero((keys[d:] == keys[:-d]) & small[:-d])
        if not len(at):
            break
        at = at[_distance(prints[at], prints[at + d]) <= radius]
        found.append((prints[at], prints[at + d]))
    for s, n in zip(starts[sizes >= 8].tolist(), sizes[sizes >= 8].tolist()):
        found += _forest(prints[s : s + n], radius)
    if not found:
        return np.empty((0, 2 * prints.shape[1]), dtype=np.uint64)
    a, b = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    return np.unique(np.concatenate([a, b], axis=1), axis=0)


def _hexes(prints: np.ndarray) -> pa.Array:
    w = prints.shape[1]
    text = prints.astype(">u8").tobytes().hex()
    return pa.array([text[i : i + 16 * w] for i in range(0, len(text), 16 * w)], pa.string())


def _scan(scheme: Scheme, hot: int):
    """Of rows sorted by key: (a, b, null) for a link, (null, null, key) for a key with more than `hot` rows."""
    w = len(scheme.seeds)

    def out(links: np.ndarray, over: list[int]) -> pa.RecordBatch:
        n = len(links)
        a = pa.concat_arrays([_hexes(links[:, :w]), pa.nulls(len(over), pa.string())])
        b = pa.concat_arrays([_hexes(links[:, w:]), pa.nulls(len(over), pa.string())])
        return pa.RecordBatch.from_arrays([a, b, pa.array([None] * n + over, pa.int64())], names=["a", "b", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints, skip, seen = np.empty(0, np.int64), np.empty((0, w), np.uint64), None, np.empty((0, 2 * w), np.uint64)

        def fresh(links: np.ndarray) -> np.ndarray:
            nonlocal seen
            if not len(links):
                return links
            both, at = np.unique(np.concatenate([seen, links]), axis=0, return_index=True)
            new = both[at >= len(seen)]
            seen = both if len(both) < 200_000 else links
            return new

        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            p = np.stack([b.column(1 + i).to_numpy(zero_copy_only=False) for i in range(w)], axis=1).view(np.uint64)
            if skip is not None:
                k, p = k[k != skip], p[k != skip]
            if not len(k):
                continue
            keys, prints = np.concatenate([keys, k]), np.concatenate([prints, p])
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                if len(links := fresh(_links(keys[:last], prints[:last], scheme.radius))):
                    yield out(links, [])
                keys, prints = keys[last:], prints[last:]
            if len(keys) > hot:
                skip = int(keys[0])
                yield out(np.empty((0, 2 * w), np.uint64), [skip])
                keys, prints = keys[:0], prints[:0]
        if len(keys) and len(links := fresh(_links(keys, prints, scheme.radius))):
            yield out(links, [])

    return run


_FOUND = "a string, b string, hot long"


def links_between(prints: DataFrame, scheme: Scheme = EXACT, hot: int = HOT) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints of prints as all links at `radius` bits would."""
    names = _names(scheme)
    rows = map_batches(prints, _emit(scheme), ", ".join(f"{n} long" for n in names))
    found = stored(map_batches(rows.repartition(F.col("key")).sortWithinPartitions("key"), _scan(scheme, hot), _FOUND))
    links, over = found.where("a is not null").select("a", "b"), found.where("hot is not null").select(F.col("hot").alias("key"))
    if over.isEmpty():
        return links
    crowded = stored(rows.join(over, "key"))
    blocks = crowded.groupBy("key").agg(F.ceil(F.count("*") * 2 / F.lit(float(hot))).cast("int").alias("blocks"))
    mine = crowded.join(blocks, "key").withColumn("mine", F.pmod(F.xxhash64(*names[1:]), F.col("blocks")).cast("int"))
    dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), *names[1:])
    again = map_batches(dealt.repartition(F.col("key")).sortWithinPartitions("key"), _scan(scheme, 1 << 62), _FOUND)
    return links.union(again.select("a", "b"))


def near_duplicates(docs: DataFrame, scheme: Scheme = EXACT, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """A row for each row of docs: key, fingerprint, component_id.

    component_id is the least key reachable over links, itself included; null keys count only where a component has no
    other. Null and empty texts, and texts without words, have fingerprint zero and are linked like any other. Rows that
    repeat are rows of one component. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    rows = stored(with_fingerprint(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), scheme))
    prints = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    links = links_between(prints.select("fingerprint"), scheme, hot)
    roots = components(links).withColumnRenamed("node", "fingerprint")
    classed = prints.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = stored(classed.join(least, "root").select("fingerprint", "n", "component_id"))
    out, crowds = ["doc_id", "fingerprint", "component_id"], by_print.where(F.col("n") > CROWD)
    if crowds.isEmpty():
        return rows.join(by_print, "fingerprint").select(*out)
    # rows of a fingerprint that many share, such as that of blank texts, are not dealt by it; these fingerprints are fewer than rows / CROWD
    crowds = F.broadcast(crowds.select("fingerprint", "component_id"))
    rest = rows.join(crowds, "fingerprint", "left_anti").join(by_print.where(F.col("n") <= CROWD), "fingerprint")
    return rows.join(crowds, "fingerprint").select(*out).unionByName(rest.select(*out))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), EXACT)
