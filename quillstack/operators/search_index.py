"""The stored search index: postings by the first letters of the token, in segments, with bounds that let blocks be skipped.

Documents come in segments. A segment has, of each token, its documents in blocks: a block is a slot of some SLOT
documents of about the same length, so the greatest count and the least length in it bound what a document there can
score. Documents that go are named in a list of the gone, and what they counted is written as negative counts. All of it
is parts of a versioned store, so a change of the index is seen whole or not at all.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.operators.library import ORDERS, DocumentFilter, library, sort_columns
from quillstack.operators.search import _TOKEN, FIELDS, folded, terms
from quillstack.plans.archive import Archive
from quillstack.sources.versions import Store, Version

#: Documents of a slot, about, and letters of the longest prefix whose documents are counted in advance.
SLOT, LONGEST = 64, 12
#: Slots that are scored first, for a bar that the rest must reach; slots that are named in a filter and not joined.
FIRST, NAMED = 16, 1000
K1, B = 1.2, 0.75

#: Tokens of the documents that a task works on together.
TOGETHER = 2_000_000

_POSTINGS = "segment int, token string, slot long, n int, max_tf int, min_length int, ids array<bigint>, tfs array<int>, lengths array<int>"
#: A place: which of the block's ids it is in, the field (4 bits) and the position there (32).
_PLACES = "segment int, token string, ids array<bigint>, places array<bigint>"
_PREFIXES = "prefix string, n long"
_DOCS = "segment int, id long, length int, ends array<int>, body string"
_GONE = "segment int, id long"


def shard(token: Column) -> Column:
    """The folder of a token: its first two characters where they are ASCII letters or digits; else what stands for their block of characters."""
    first, second = F.substring(token, 1, 1), F.substring(token, 2, 1)
    plain = lambda c: c.rlike("^[a-z0-9]$")
    return F.when(~plain(first), F.concat(F.lit("_"), F.lower(F.hex(F.shiftright(F.ascii(first), 8))))).when(second == "", first).when(plain(second), F.concat(first, second)).otherwise(F.concat(first, F.lit("~")))


def shards_of(term: str, prefix: bool, known: set[str]) -> list[str]:
    """The folders, of those known, that can hold a token, or a token with this prefix."""
    plain = lambda c: bool(re.fullmatch("[a-z0-9]", c))
    if not plain(term[0]):
        wanted = {f"_{ord(term[0]) >> 8:x}"}
    elif len(term) == 1:
        wanted = {s for s in known if s.startswith(term)} if prefix else {term}
    else:
        wanted = {term[:2]} if plain(term[1]) else {f"{term[0]}~"}
    return sorted(wanted & known)


def _written_blocks(store: Store, blocks: DataFrame, number: int) -> dict[str, str]:
    """Parts `number/shard` of the postings. Ranges of shard, token and slot go to files, so a frequent shard is several files."""
    # the folder's name is made after the shuffle, and before the sort, which compares it often
    ranged = blocks.repartitionByRange(shard(F.col("token")), "token", "slot").withColumn("in_shard", shard(F.col("token"))).sortWithinPartitions("in_shard", "token", "slot")
    counts = F.size("ids").alias("n"), F.array_max("tfs").alias("max_tf"), F.array_min("lengths").alias("min_length")
    rows = ranged.select(F.lit(number).alias("segment"), "token", "slot", *counts, "ids", "tfs", "lengths", "places", "in_shard")
    folder = store.write("postings", rows, by=("in_shard",))
    return {f"{number}/{n.split('=', 1)[1]}": f"{folder}/{n}" for n in store.folders_in(folder)}


def _bodies(docs: DataFrame) -> DataFrame:
    """id, length, body and ends of documents: all tokens with a blank between them, field by field, and where each field ends."""
    fields = F.array(*(F.regexp_extract_all(folded(F.coalesce(F.col(c), F.lit(""))), F.lit(_TOKEN), F.lit(0)) if c in docs.columns else F.array().cast("array<string>") for c in FIELDS))
    sizes = F.transform("fields", lambda f: F.size(f))
    counted = docs.select("id", fields.alias("fields")).select("id", sizes.alias("sizes"), F.array_join(F.flatten("fields"), " ").alias("body"))
    ends = F.array(*(sum((F.get("sizes", F.lit(i)) for i in range(n + 1)), F.lit(0)) for n in range(len(FIELDS))))
    return counted.select("id", ends.alias("ends"), "body").select("id", F.element_at("ends", -1).alias("length"), "ends", "body")


def _pieces(together: int):
    """Of batches with a length: slices of so many tokens, or of one document."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for b in batches:
            sums = np.cumsum(b.column("length").to_numpy())
            at = 0
            while at < b.num_rows:
                end = max(int(np.searchsorted(sums, (sums[at - 1] if at else 0) + together, side="right")), at + 1)
                yield b.slice(at, end - at)
                at = end

    return run


def _blocks(together: int):
    """Of (slot, id, length, ends, body), slots together: the blocks of their tokens. What is one slot's can come in several."""
    pieces = _pieces(together)

    def block(slot: int, part):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, lengths = part.column("id").to_numpy(), part.column("length").to_numpy()
        by_id = np.argsort(ids, kind="stable")
        ids, lengths = ids[by_id], lengths[by_id]
        ends = part.column("ends").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[by_id]
        tokens = pc.list_flatten(pc.split_pattern(part.column("body").combine_chunks().take(pa.array(by_id)), " ")).dictionary_encode()
        doc = np.repeat(np.arange(len(ids)), lengths)
        pos = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        field = np.zeros(len(doc), np.int32)
        for f in range(ends.shape[1] - 1):
            field += pos >= ends[doc, f]
        pos = pos - np.concatenate([np.zeros((len(ids), 1), ends.dtype), ends[:, :-1]], axis=1)[doc, field]
        code = tokens.indices.to_numpy()
        order = np.argsort(code, kind="stable")  # then by id, field and place, as they are
        code, doc, field, pos = code[order], doc[order], field[order], pos[order]
        new = np.concatenate([[True], code[1:] != code[:-1]])
        pair = np.flatnonzero(new | np.concatenate([[True], doc[1:] != doc[:-1]]))
        tf, of = np.diff(np.append(pair, len(doc))).astype(np.int32), doc[pair]
        first, place = np.flatnonzero(new[pair]), np.flatnonzero(new)
        index = np.arange(len(pair)) - np.repeat(first, np.diff(np.append(first, len(pair))))  # of a document in its block
        places = (np.repeat(index, tf) << 36) | (field.astype(np.int64) << 32) | pos
        lists = lambda starts, values: pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values))
        return pa.RecordBatch.from_arrays([
            tokens.dictionary.take(pa.array(code[place])), pa.array(np.full(len(first), slot)), lists(first, ids[of]), lists(first, tf), lists(first, lengths[of].astype(np.int32)), lists(place, places),
        ], names=["token", "slot", "ids", "tfs", "lengths", "places"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in pieces(batches):
            slots = b.column("slot").to_numpy()
            starts = np.append(np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])), len(slots))
            table = pa.Table.from_batches([b])
            for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
                yield block(int(slots[start]), table.slice(start, end - start))

    return run


def _prefixed(longest: int, together: int):
    """Of (length, body): (prefix, n), in how many of the documents of a piece a token has each prefix."""
    pieces = _pieces(together)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in pieces(batches):
            tokens = pc.list_flatten(pc.split_pattern(b.column("body"), " ")).dictionary_encode()
            order = pc.sort_indices(tokens.dictionary)
            names, rank = tokens.dictionary.take(order), np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            doc = np.repeat(np.arange(b.num_rows), b.column("length").to_numpy())
            pairs = np.unique(doc * len(names) + rank[tokens.indices.to_numpy()])
            doc, token = np.divmod(pairs, len(names))
            sizes = pc.utf8_length(names).to_numpy()
            for size in range(1, longest + 1):
                # tokens are in order, so those of a document that have one prefix stand together
                prefixes = pc.utf8_slice_codeunits(names, 0, size).dictionary_encode()
                long = sizes[token] >= size
                which, of = prefixes.indices.to_numpy()[token[long]], doc[long]
                if not len(which):
                    break
                fresh = np.concatenate([[True], (which[1:] != which[:-1]) | (of[1:] != of[:-1])])
                counts = np.bincount(which[fresh], minlength=len(prefixes.dictionary))
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([prefixes.dictionary.take(pa.array(some)), pa.array(counts[some])], names=["prefix", "n"])

    return run


def _written_prefixes(store: Store, docs: DataFrame, sign: int = 1) -> str:
    """The folder of (prefix, n): in how many of the documents (length, body) a token has each prefix. Sorted, so that files tell what they lack."""
    rows = docs.where("length > 0").select("length", "body").mapInArrow(_prefixed(LONGEST, TOGETHER), _PREFIXES)
    counts = rows.groupBy("prefix").agg((F.sum("n") * sign).alias("n"))
    return store.write("prefixes", counts.repartitionByRange("prefix").sortWithinPartitions("prefix"))


def _added(store: Store, bodies: DataFrame, number: int) -> tuple[dict[str, dict[str, str | None]], list[int]]:
    """The parts of a new segment, and its documents and their total length. bodies: as `_bodies` has them.

    Texts are shuffled once, to their slots, where their blocks are made; blocks are shuffled once, to their folders.
    """
    name = str(number)
    folder = store.write("docs", bodies.select(F.lit(number).alias("segment"), "id", "length", "ends", "body"))
    held = store.spark.read.schema(_DOCS).parquet(f"{store.root}/{folder}")
    # documents without words have no length, and don't count: so has it the search by texts
    some = held.where("length > 0").withColumn("size", F.floor(F.log2(F.col("length") + 1.0) * 4).cast("long"))
    classes = some.groupBy("size").agg(F.ceil(F.count("*") / F.lit(float(SLOT))).cast("long").alias("parts"), F.count("*").alias("docs"), F.sum("length").alias("length")).collect()  # sizes are few: four for each doubling
    n, total = sum(r.docs for r in classes), sum(r.length for r in classes)
    parts = {"docs": {name: folder}, "prefixes": {name: _written_prefixes(store, held)}, "postings": {}}
    if classes:
        of = F.create_map(*(F.lit(x).cast("long") for r in classes for x in (r["size"], r.parts)))
        slot = F.shiftleft("size", 40).bitwiseOR(F.pmod(F.xxhash64("id"), F.element_at(of, F.col("size"))))
        slotted = some.select(slot.alias("slot"), "id", "length", "ends", "body").repartition("slot").sortWithinPartitions("slot")
        blocks = slotted.mapInArrow(_blocks(TOGETHER), "token string, slot long, ids array<bigint>, tfs array<int>, lengths array<int>, places array<bigint>")
        parts["postings"] = _written_blocks(store, blocks, number)
    return parts, [n, total]


def _live(store: Store, version: Version, *columns: str) -> DataFrame:
    return _without_gone(store, version, store.read(version, "docs", _DOCS).select(*columns))


def update_index(store: Store, add: DataFrame | None = None, remove: DataFrame | None = None, version: Version | None = None) -> Version:
    """A new version of the index, in one step: documents of `remove` (id) are gone, those of `add` (id and the searched fields) are a new segment.

    An edited document is in both. Without documents so far, `add` is the first segment.
    """
    version = version or store.current()
    number = int(version.notes.get("next", 0))
    changes: dict[str, dict[str, str | None]] = {}
    n, total = version.notes.get("docs", 0), version.notes.get("length", 0)
    if remove is not None and version.parts.get("docs"):
        gone = _live(store, version, "segment", "id", "length").join(remove.select("id").distinct(), "id", "left_semi")
        folder = store.write("gone", gone.select("segment", "id", "length"))
        taken = store.spark.read.schema(f"{_GONE}, length int").parquet(f"{store.root}/{folder}")
        changes["gone"] = {str(number): folder}
        bodies = store.read(version, "docs", _DOCS).join(taken.select("segment", "id"), ["segment", "id"], "left_semi")
        changes["prefixes"] = {f"-{number}": _written_prefixes(store, bodies, -1)}
        less = taken.where("length > 0").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        n, total = n - less[0], total - less[1]
    if add is not None:
        parts, more = _added(store, _bodies(add), number)
        for t, p in parts.items():
            changes.setdefault(t, {}).update(p)
        n, total = n + more[0], total + more[1]
    return store.commit(version, changes, {"next": number + 1, "docs": n, "length": total})


def compact(store: Store, version: Version | None = None) -> Version:
    """One segment of all live documents, from the index itself: what is gone takes no more room."""
    version = version or store.current()
    number = int(version.notes["next"])
    parts, (n, total) = _added(store, _live(store, version, "segment", "id", "length", "ends", "body"), number)
    old = {t: dict.fromkeys(version.parts.get(t, {}), None) for t in ("postings", "prefixes", "docs", "gone")}
    return store.commit(version, {t: {**old[t], **parts.get(t, {})} for t in old}, {"next": number + 1, "docs": n, "length": total})


# --- searching


def _parts(version: Version, table: str, term: str, prefix: bool) -> list[str]:
    held = version.parts.get(table, {})
    wanted = set(shards_of(term, prefix, {p.split("/", 1)[1] for p in held}))
    return sorted(p for p in held if p.split("/", 1)[1] in wanted)


def _postings(store: Store, version: Version, term: str) -> DataFrame:
    """The blocks of a prefix; no other letters' folders are opened."""
    rows = store.read(version, "postings", _POSTINGS, _parts(version, "postings", term, True))
    return rows.where(F.startswith("token", F.lit(term)))


def _phrase(store: Store, version: Version, term: list[str]) -> DataFrame:
    """(segment, id, tf) of documents with adjacent tokens, the last a prefix."""
    out = None
    for i, t in enumerate(term):
        last = i == len(term) - 1
        rows = store.read(version, "postings", _PLACES, _parts(version, "postings", t, last)).where(F.startswith("token", F.lit(t)) if last else F.col("token") == t)
        at = F.transform("places", lambda p: F.struct(F.get("ids", F.shiftright(p, 36).cast("int")).alias("id"), F.shiftright(p, 32).bitwiseAND(F.lit(15)).alias("field"), p.bitwiseAND(F.lit((1 << 32) - 1)).alias("pos")))
        step = rows.select("segment", F.explode(at).alias("p")).select("segment", "p.id", "p.field", (F.col("p.pos") - i).alias("pos"))
        out = step if out is None else out.join(step, ["segment", "id", "field", "pos"], "left_semi")
    return out.groupBy("segment", "id").agg(F.count("*").cast("int").alias("tf"))


def _without_gone(store: Store, version: Version, rows: DataFrame) -> DataFrame:
    if not version.parts.get("gone"):
        return rows
    return rows.join(store.read(version, "gone", _GONE), ["segment", "id"], "left_anti")


def found(store: Store, query: str, version: Version | None = None) -> DataFrame:
    """id of the documents that have every term of a query, from postings alone; a query without terms finds all."""
    version = version or store.current()
    wanted = terms(query)
    if not wanted:
        return _live(store, version, "segment", "id").select("id")
    hits = None
    for i, term in enumerate(wanted):
        rows = _postings(store, version, term[0]).select("segment", F.explode("ids").alias("id")) if len(term) == 1 else _phrase(store, version, term).select("segment", "id")
        rows = rows.distinct().withColumn("term", F.lit(i))
        hits = rows if hits is None else hits.unionByName(rows)
    every = hits.groupBy("segment", "id").agg(F.count("*").alias("terms")).where(F.col("terms") == len(wanted))
    return _without_gone(store, version, every.select("segment", "id")).select("id")


def document_counts(store: Store, version: Version, wanted: list[list[str]]) -> list[int]:
    """How many live documents each term is in. Short prefixes are counted in advance."""
    rows = None
    for i, term in enumerate(wanted):
        if len(term) == 1 and len(term[0]) <= LONGEST:
            one = store.read(version, "prefixes", _PREFIXES).where(F.col("prefix") == term[0])
        else:
            hits = _postings(store, version, term[0]).select("segment", F.explode("ids").alias("id")).distinct() if len(term) == 1 else _phrase(store, version, term).select("segment", "id")
            one = _without_gone(store, version, hits).select(F.lit(1).cast("long").alias("n"))
        one = one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("i", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    return [n for _, n in sorted((r.i, r.n) for r in rows.collect())]  # a row a term


def _gain(tf: Column, length: Column, mean: float) -> Column:
    tf = tf.cast("double")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _weights(store: Store, version: Version, wanted: list[list[str]]) -> tuple[list[float], float]:
    docs = version.notes["docs"]
    idf = [max(1e-6, math.log((docs - n + 0.5) / (n + 0.5))) for n in document_counts(store, version, wanted)]
    return idf, version.notes["length"] / max(docs, 1)


def _bounds(store: Store, version: Version, wanted: list[list[str]], idf: list[float], mean: float) -> DataFrame:
    """(segment, slot, bound, n): what a document of a slot can score at most, for slots that have every term; n postings are to be read there.

    A prefix of several tokens gains no more than its tokens apart, as the gain of a count grows ever less.
    """
    rows = None
    for i, term in enumerate(wanted):
        headers = _postings(store, version, term[0]) if len(term) == 1 else store.read(version, "postings", _POSTINGS, _parts(version, "postings", term[0], False)).where(F.col("token") == term[0])
        gain = F.least(F.sum(_gain(F.col("max_tf"), F.col("min_length"), mean)), F.lit(K1 + 1)) if len(term) == 1 else F.lit(K1 + 1)
        one = headers.groupBy("segment", "slot").agg((gain * idf[i]).alias("bound"), F.sum("n").alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("segment", "slot").agg(F.sum("bound").alias("bound"), F.sum("n").alias("n"), F.count("*").alias("terms")).where(F.col("terms") == len(wanted)).drop("terms")


def _scores(store: Store, version: Version, wanted: list[list[str]], idf: list[float], mean: float, slots: DataFrame | None) -> DataFrame:
    """(id, score) of documents with every term; slots (segment, slot), if given, are all that is looked at."""
    named = None
    if slots is not None:
        few = slots.limit(NAMED + 1).collect()
        if len(few) <= NAMED:  # then files tell by their statistics what they lack
            named = F.lit(False)
            for segment in sorted({r.segment for r in few}):
                named = named | ((F.col("segment") == segment) & F.col("slot").isin([r.slot for r in few if r.segment == segment]))
    hits = None
    for i, term in enumerate(wanted):
        if len(term) == 1:
            blocks = _postings(store, version, term[0])
            if named is not None:
                blocks = blocks.where(named)
            elif slots is not None:
                blocks = blocks.join(slots, ["segment", "slot"], "left_semi")
            rows = blocks.select("segment", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("d")).groupBy("segment", F.col("d.ids").alias("id")).agg(F.sum("d.tfs").alias("tf"), F.max("d.lengths").alias("length"))
        else:
            rows = _phrase(store, version, term).join(store.read(version, "docs", _DOCS).select("segment", "id", "length"), ["segment", "id"])
        one = rows.select("segment", "id", (_gain(F.col("tf"), F.col("length"), mean) * idf[i]).alias("s"))
        hits = one if hits is None else hits.unionByName(one)
    every = hits.groupBy("segment", "id").agg(F.sum("s").alias("s"), F.count("*").alias("terms")).where(F.col("terms") == len(wanted))
    return _without_gone(store, version, every).select("id", F.round("s", 6).alias("score"))


def scores(store: Store, query: str, version: Version | None = None) -> DataFrame:
    """id, score of every document that a query finds. A query without terms finds nothing."""
    version = version or store.current()
    wanted = terms(query)
    if not wanted or not version.notes.get("docs"):
        return store.spark.createDataFrame([], "id long, score double")
    return _scores(store, version, wanted, *_weights(store, version, wanted), None)


def _reaching(store: Store, version: Version, wanted: list[list[str]], idf: list[float], mean: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(slots, those that can hold one of the best k)."""
    slots = _bounds(store, version, wanted, idf, mean)
    first = slots.orderBy(F.desc("bound"), "segment", "slot").limit(FIRST).select("segment", "slot")
    best = _scores(store, version, wanted, idf, mean, first).orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("bar")).first()
    return slots, slots.where(F.col("bound") >= best.bar - 2e-6) if best.n >= k else slots


def best(store: Store, query: str, k: int = 50, version: Version | None = None) -> DataFrame:
    """id, score of the k documents that score highest, by score and then id, as `scores` has them.

    The slots with the highest bounds are scored first; then only those whose bound reaches the k-th score so far.
    """
    version = version or store.current()
    wanted = terms(query)
    if not wanted or not version.notes.get("docs"):
        return store.spark.createDataFrame([], "id long, score double")
    idf, mean = _weights(store, version, wanted)
    _, reaching = _reaching(store, version, wanted, idf, mean, k)
    return _scores(store, version, wanted, idf, mean, reaching.select("segment", "slot")).orderBy(F.desc("score"), "id").limit(k)


def share_read(store: Store, query: str, k: int = 50, version: Version | None = None) -> tuple[int, int]:
    """Of the postings of a query's terms, how many lie in slots that `best` reads, and how many there are."""
    version = version or store.current()
    wanted = terms(query)
    idf, mean = _weights(store, version, wanted)
    slots, reaching = _reaching(store, version, wanted, idf, mean, k)
    every = None
    for term in wanted:
        one = _postings(store, version, term[0]).agg(F.sum("n").alias("n"))
        every = one if every is None else every.unionByName(one)
    return reaching.agg(F.sum("n")).first()[0] or 0, every.agg(F.sum("n")).first()[0] or 0


def listing(a: Archive, store: Store, query: str, f: DocumentFilter = DocumentFilter(), order_by: str = "doc_date", direction: str = "desc", limit: int = 200, offset: int = 0, version: Version | None = None) -> DataFrame:
    """`search.listing` from the index: no text is read but the page's."""
    if order_by != "relevance" or not terms(query):
        rows = library(a).join(found(store, query, version), "id", "left_semi").where(f.test())
        return rows.orderBy(*sort_columns(order_by if order_by in ORDERS else "doc_date", direction)).offset(offset).limit(limit)
    scored = scores(store, query, version)
    score = F.desc("score") if direction != "asc" else F.asc("score")
    return library(a).where(f.test()).join(scored, "id").orderBy(score, F.desc("id")).offset(offset).limit(limit).drop("score")
