"""The Jaccard join of word shingles, exact, by PartEnum signatures or by rare elements.

By signatures: sets are put into bands of size. Two similar sets of a band differ in few elements at most (k, from the band's largest
size). The elements are partitioned twice: into so many parts that one of them holds at most one difference, and each
part into three. Leaving out each of the three in turn, the rest of one choice has no difference at all. So a set's
signatures are, for each part and each of its three choices, the hash of the elements that lie there, and similar sets
share one (Arasu, Ganti and Kaushik, 2006). A set near the upper end of its band has signatures in the next band too.

By rare elements, for lower limits, where a signature holds so few elements that unlike sets share it: of n elements a
similar set lacks n - o at most (o, the least that they share), so the n - o + c least hashes of both hold c elements in
common at least. Of these, elements that stand in no other set go. A set that keeps fewer than c has no similar one; from
the others those c - 1 that most sets have can go too, and similar sets still share one (prefix filter, Chaudhuri, Ganti
and Kaushik, 2006). Sets that have one in common are tied to the next in size, if sizes allow.

Equal sets are one. Rows of a signature are combined in each task, so that a frequent one sends a row for each task;
then its sets are tied to one of them, not to each other. Sets that are tied together are compared with each other, all
that sizes allow, in one task, or where they are many in tasks for each two blocks of them. So all links are found and
counted, and what tasks give is a forest of links and a number for each set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.llm.common import documents, map_batches, stored
from quillstack.llm.graph import components
from quillstack.llm.similar import _mixed, shingle_set

SHINGLE, PERCENT = 3, 90
#: Each band's largest size is about so many times the one before.
BAND = 1.4
#: Elements of the sets that are compared in one task.
TOGETHER = 4_000_000
#: Rows of one set that may meet in a task, and rows of a table that is broadcast.
CROWD, BROADCAST_ROWS = 100_000, 200_000
#: Texts whose shuffle is spared where no more than so many hashes of those that are needed are broadcast.
BROADCAST_HASHES = 3_000_000
#: Signatures that a task combines before it sends them.
_HELD = 1 << 20
#: Sets that have an element are counted up to here.
OFTEN = 1_000


def band_of(size: int, percent: int = PERCENT) -> tuple[int, int]:
    """(number, largest size) of the band of a size."""
    number, top = 0, 4
    while top < size:
        number, top = number + 1, max(int(top * BAND), top * 100 // percent + 1)
    return number, top


def differences(top: int, percent: int = PERCENT) -> int:
    """In how many elements two similar sets of at most `top` elements can differ."""
    return 2 * top * (100 - percent) // (100 + percent)


def signatures(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a set of distinct hashes; none if only equal sets are similar to it."""
    size = len(hashes)
    if not size:
        return np.empty(0, np.uint64)
    number, top = band_of(size, percent)
    bands = [(number, top)]
    if size * 100 // percent > top:
        bands.append(band_of(top + 1, percent))
    out, place, weight = [], _mixed(hashes, 1) >> np.uint64(32), _mixed(hashes, 2)
    for number, top in bands:
        k = differences(top, percent)
        if not k:
            continue
        parts = (k + 2) // 2  # of so many, one has at most one of k differences
        third = (place * np.uint64(3 * parts) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(3 * parts, dtype=np.uint64)
        np.add.at(sums, third, weight)
        sums = sums.reshape(parts, 3)
        with np.errstate(over="ignore"):
            left = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums
        names = _mixed(np.arange(3 * parts, dtype=np.uint64) + np.uint64(number << 40), 3)
        out.append(_mixed(left.reshape(-1) ^ names, 4))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def digested(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (doc_id, th, text): doc_id, th, digest of the set, its size."""
        import xxhash

        for b in batches:
            sizes, digests = [], []
            for text in b.column(2):
                found = shingle_set(text.as_py(), shingle)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_hexdigest(found.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], names=["doc_id", "th", "digest", "size"])

    return run


def _short(digest: str) -> int:
    """64 bits of a digest; sets that share them are compared, so it needn't be unique."""
    return int.from_bytes(bytes.fromhex(digest[:16]), "big", signed=True)


def _tied(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of texts: (key, a, null), a set a for each signature that the task has seen, and (key, a, b), sets with one in common."""
        import xxhash

        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held, last = 0, ""

        def give() -> pa.RecordBatch:
            k, i = np.concatenate(keys), np.concatenate(ids)
            order = np.lexsort((i, k))
            k, i = k[order], i[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])])
            k, i = k[new], i[new]
            first = np.concatenate([[True], k[1:] != k[:-1]])
            least = i[np.flatnonzero(first)[np.cumsum(first) - 1]]
            pairs = np.unique(np.stack([least[~first], i[~first]], axis=1), axis=0)
            where = _mixed((pairs[:, 0] ^ pairs[:, 1]).view(np.uint64), 5).view(np.int64)
            a = np.concatenate([i[first], pairs[:, 0]])
            other = pa.concat_arrays([pa.nulls(int(first.sum()), pa.int64()), pa.array(np.ascontiguousarray(pairs[:, 1]))])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k[first].view(np.int64), where])), pa.array(a), other], names=["key", "a", "b"])

        for b in batches:
            for text in b.column(0):
                found = shingle_set(text.as_py(), shingle)
                digest = xxhash.xxh3_128_hexdigest(found.tobytes())
                if digest == last:
                    continue
                last, mine = digest, signatures(found, percent)
                keys.append(mine)
                ids.append(np.full(len(mine), _short(digest), dtype=np.int64))
                held += len(mine)
                if held >= _HELD:
                    yield give()
                    keys, ids, held = [], [], 0
        if held:
            yield give()

    return run


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, a, b) sorted by key: (a, b). What has one key is tied to the first of it."""
    key, least, seen = None, 0, np.empty((0, 2), np.int64)
    for batch in batches:
        k, a = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(k):
            continue
        known = batch.column(2)
        ready = np.asarray(known.is_valid())
        pairs = [np.stack([a[ready], known.drop_null().to_numpy(zero_copy_only=False)], axis=1)]
        k, a = k[~ready], a[~ready]
        if len(k):
            first = np.concatenate([[k[0] != key], k[1:] != k[:-1]])
            at = np.cumsum(first) - 1
            firsts = a[first]
            center = np.where(at >= 0, firsts[at], least) if len(firsts) else np.full(len(a), least)
            pairs.append(np.stack([center, a], axis=1)[~first])
            key, least = k[-1], center[-1]
        links = np.concatenate(pairs)
        links = np.sort(links[links[:, 0] != links[:, 1]], axis=1)
        if not len(links):
            continue
        both, at = np.unique(np.concatenate([seen, links]), axis=0, return_index=True)
        links = both[at >= len(seen)]
        seen = both if len(both) < 200_000 else links
        if len(links):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, i])) for i in (0, 1)], names=["a", "b"])


def least_shared(size: int, percent: int) -> int:
    """How many of its elements a set shares with a similar one, at least; and the least size of a similar set."""
    return (size * percent + 99) // 100


def common(size: int, percent: int) -> int:
    """How many elements, of those that are sent, similar sets of this size have in common at least; rises with the size."""
    return min(least_shared(size, percent), size // 8 + 1)


def _sent(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of texts: (element, node), the least hashes of each set that the task has not just seen."""
        import xxhash

        elements: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        held, seen = 0, set()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (elements, nodes)], names=["element", "node"])
        for b in batches:
            for text in b.column(0):
                found = shingle_set(text.as_py(), shingle)
                digest = xxhash.xxh3_128_hexdigest(found.tobytes())
                if not len(found) or digest in seen:
                    continue
                seen.add(digest)
                size = len(found)
                mine = found[: size - least_shared(size, percent) + common(size, percent)].view(np.int64)
                elements.append(mine)
                nodes.append(np.full(len(mine), _short(digest), dtype=np.int64))
                held += len(mine)
                if held >= _HELD:
                    yield give()
                    elements, nodes, held, seen = [], [], 0, set()
        if held:
            yield give()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (element, node) sorted by both: (node, element, often) of elements that several nodes have, and how many those are."""
    e, n, hot = np.empty(0, np.int64), np.empty(0, np.int64), None
    for b in chain(batches, [None]):
        if b is not None:
            e, n = (np.concatenate([x, b.column(i).to_numpy(zero_copy_only=False)]) for i, x in ((0, e), (1, n)))
        if not len(e):
            continue
        new = np.concatenate([[True], (e[1:] != e[:-1]) | (n[1:] != n[:-1])])
        e, n = e[new], n[new]
        first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
        sizes = np.diff(np.append(first, len(e)))
        often = np.minimum(sizes, OFTEN)
        if e[0] == hot:
            often[0] = OFTEN  # its first rows have gone out
        # the last element waits for its other rows, unless it is known to be frequent
        hot = e[-1] if often[-1] == OFTEN else None
        end = len(e) if b is None or hot is not None else int(first[-1])
        often = np.repeat(often, sizes)[:end]
        ok = often > 1
        if ok.any():
            yield pa.RecordBatch.from_arrays([pa.array(n[:end][ok]), pa.array(e[:end][ok]), pa.array(often[ok].astype(np.int32))], names=["node", "element", "often"])
        e, n = e[end:], n[end:]


def similar_pairs(sets: list[np.ndarray], sides: np.ndarray | None = None, percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """(i, places): the places after i, in order of size, of sets similar to the i-th; sets are given by size, rising.

    sides: if given, only sets of different sides are compared.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(flat.max()) + 1, dtype=np.int32)
    tops = np.searchsorted(sizes, sizes * 100 // percent, side="right")
    for i in range(len(sets) - 1):
        low, high = i + 1, int(tops[i])
        if low >= high:
            continue
        mine = flat[starts[i] : starts[i + 1]]
        mark[mine] = 1
        both = np.add.reduceat(mark[flat[starts[low] : starts[high]]], starts[low:high] - starts[low])
        mark[mine] = 0
        ok = 100 * both.astype(np.int64) >= percent * (sizes[i] + sizes[low:high] - both)
        if sides is not None:
            ok &= sides[low:high] != sides[i]
        if ok.any():
            yield i, low + np.flatnonzero(ok)


def _compared(percent: int):
    names = ["a", "b", "links"]

    def found(digests: list[str], weights: list[int], sides: list[int], sets: list[np.ndarray], cross: bool) -> pa.RecordBatch:
        """(a, b, null), links that connect what is connected, and (a, null, n): how many rows a set is linked with here."""
        order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        rows, degree = np.array([weights[i] for i in order], dtype=np.int64), np.zeros(len(sets), np.int64)
        root, forest = list(range(len(sets))), []

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, others in similar_pairs([sets[j] for j in order], np.array([sides[j] for j in order]) if cross else None, percent):
            degree[i] += rows[others].sum()
            degree[others] += rows[i]
            for j in others.tolist():
                if (x := top(i)) != (y := top(j)):
                    root[y] = x
                    forest.append((i, j))
        at = np.flatnonzero(degree)
        name = lambda places: [digests[order[i]] for i in places]
        a = pa.array(name([i for i, _ in forest]) + name(at.tolist()), pa.string())
        b = pa.array([*name([j for _, j in forest]), *[None] * len(at)], pa.string())
        return pa.RecordBatch.from_arrays([a, b, pa.array([*[None] * len(forest), *degree[at].tolist()], pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (root, low, high, side, digest, weight, shingles) in order of the first three."""
        group, held = None, ([], [], [], [])

        def give() -> Iterator[pa.RecordBatch]:
            if len(held[3]) > 1:
                out = found(*held, group[1] != group[2])
                if out.num_rows:
                    yield out

        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3))))
            values = [b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(3).to_pylist()]
            for i, key in enumerate(keys):
                if key != group:
                    yield from give()
                    group, held = key, ([], [], [], [])
                if held[0] and held[0][-1] == values[0][i]:
                    continue  # a row that repeats
                for into, v in zip(held, values):
                    into.append(v[i])
                held[3].append(b.column(6)[i].values.to_numpy(zero_copy_only=False).copy())
        yield from give()

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (root, blocks, mine, digest, weight, text): the same with the shingles for the text."""
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [shingle_set(t.as_py(), shingle).astype(np.int64) for t in part.column(5)]
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))], names=["root", "blocks", "mine", "digest", "weight", "shingles"])

    return run


def _bounded(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _id_of(digest: str) -> Column:
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("long")


def by_signatures(texts: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b), ties that connect all sets with a signature in common."""
    rows = map_batches(texts.select("text"), _tied(shingle, percent), "key long, a long, b long")
    return map_batches(rows.repartition(F.col("key")).sortWithinPartitions("key"), _ties, "a long, b long")


def by_rare_elements(texts: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b), ties that connect all similar sets: those with a rare element in common and sizes near enough."""
    rows = map_batches(texts.select("text"), _sent(shingle, percent), "element long, node long")
    shared = map_batches(rows.repartition(F.col("element")).sortWithinPartitions("element", "node"), _shared, "node long, element long, often int")
    held = shared.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("often", "element"))).alias("found"))
    least = f"((size * {percent} + 99) div 100)"  # common(least_shared(size))
    sizes = nodes.where("size > 0").select(_id_of("digest").alias("node"), "size", F.expr(f"least(({least} * {percent} + 99) div 100, {least} div 8 + 1)").alias("common"))
    rare = held.join(sizes, "node").where("size(found) >= common").select("node", "size", F.expr("explode(slice(found, 1, cast(size(found) - common + 1 AS int)))").alias("f"))
    last = F.lag(F.struct("size", "node")).over(W.partitionBy("f.element").orderBy("size", "node"))
    near = rare.select("node", "size", last.alias("last")).where(F.col("last.size") * 100 >= F.col("size") * percent)
    return near.where("last.node <> node").select(F.least("last.node", "node").alias("a"), F.greatest("last.node", "node").alias("b")).distinct()


def similar_links(texts: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, together: int = TOGETHER, tying: Callable = by_signatures) -> DataFrame:
    """(a, b, null) and (a, null, links): a forest of the links between sets, and how many rows of other sets each is linked with.

    texts (doc_id, th, text) has all texts; nodes the distinct sets: digest, size, weight (rows), and doc_id and th of a
    text that has the set. tying gives the ties that connect similar sets.
    """
    ties = stored(tying(texts, nodes, shingle, percent))
    roots = stored(components(ties))
    tied = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct())
    members = stored(nodes.where("size > 0").withColumn("node", _id_of("digest")).join(tied, "node").select("root", "digest", "size", "weight", F.col("doc_id").alias("of_id"), F.col("th").alias("of_th")))
    blocks = members.groupBy("root").agg(F.ceil(F.sum("size") * 2 / F.lit(float(together))).cast("int").alias("blocks")).where("blocks > 1")
    members = members.join(_bounded(blocks), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("mine", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    hashes = members.select(F.col("of_th").alias("th")).distinct()
    if hashes.count() <= BROADCAST_HASHES:  # else the texts are dealt out once
        texts = texts.join(F.broadcast(hashes), "th", "left_semi")
    found = texts.join(members.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th")))
    sets = map_batches(found.select("root", "blocks", "mine", "digest", "weight", "text"), _sets(shingle), "root long, blocks int, mine int, digest string, weight long, shingles array<long>")
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), F.col("mine").alias("side"), "digest", "weight", "shingles")
    ordered = dealt.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "digest")
    return stored(map_batches(ordered, _compared(percent), "a string, b string, links long"))


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, together: int = TOGETHER) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, n_links.

    Rows link if 100 times the shingles they share are at least `percent` times those that either has. component_id is
    the least key reachable over links, itself included; null keys count only where a component has no other. n_links is
    the number of other rows that a row is linked with, copies included. Null and empty texts, and texts without words,
    have no shingles and no links: component_id is their own key. Keys are whole numbers. Rows that repeat are rows of
    one class. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("text"))
    rows = stored(map_batches(texts, digested(shingle), "doc_id long, th long, digest string, size long"))
    nodes = rows.groupBy("digest").agg(F.first("size").alias("size"), F.count("*").alias("weight"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("of"))
    nodes = stored(nodes.select("digest", "size", "weight", "least", "of.doc_id", "of.th"))
    links = similar_links(texts, nodes, shingle, percent, together)
    roots = components(links.where("b is not null").select("a", "b")).withColumnRenamed("node", "digest")
    numbers = links.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    classed = stored(nodes.where("size > 0").join(roots, "digest", "left").join(numbers, "digest", "left").withColumn("root", F.coalesce("root", "digest")))
    least = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = stored(classed.join(least, "root").select("digest", "weight", "component_id", (F.coalesce("links", F.lit(0).cast("long")) + F.col("weight") - 1).alias("n_links")))
    out = ["doc_id", F.col("size").alias("n_shingles"), "component_id", "n_links"]
    empty = rows.where("size = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    some, crowds = rows.where("size > 0"), _bounded(by_set.where(F.col("weight") > CROWD))  # no more than rows / CROWD
    rest = some.join(crowds.select("digest"), "digest", "left_anti").join(by_set.where(F.col("weight") <= CROWD), "digest")
    return some.join(crowds, "digest").select(*out).unionByName(rest.select(*out)).unionByName(empty)


def op12_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))
