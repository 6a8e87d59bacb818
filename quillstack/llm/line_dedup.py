"""Line dedup by winnowing: runs of lines that stand earlier in the corpus are found by fingerprints and deleted.

A gram is the shortest run of lines from a line on that has NOISE words. Of the grams inside the shortest run from a line
on that has GUARANTEE words, the one with the least hash is a fingerprint (Schleimer, Wilkerson and Aiken, 2003, with
windows measured in words). What is chosen depends on the window's lines alone.

A gram's first place may stand in another passage than the one that two later places share, so each window is a
fingerprint too, by its gram and all its lines: the shortest from each line on, and the shortest up to each line. Every
line of a run with GUARANTEE words or more is in a window within the run, so all of a later equal run goes; and a match
under GUARANTEE words is left alone. So what is deleted is exact, not a matter of which fingerprints were chosen.

Each fingerprint's first place in the corpus is joined to its later places: as many rows as there are later places,
not pairs. From there the match is extended both ways while lines are equal, and the later run is deleted. Fingerprints
that stand in very many places are joined without dealing rows by them, and the lines of a document that very many
others repeat are dealt out in several copies. A long later document meets its sources in parts of LINES lines, each with
the lines of a window beyond it: a window lies whole in the part that it begins in, so no run is lost, and the work
grows with the lines and not with lines times sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import documents, map_batches, stored

#: Words of the least gram, and of the least run that is deleted.
NOISE, GUARANTEE = 4, 8
#: Places of one fingerprint that may meet in a task, and documents that may meet the lines of one source.
CROWD, TOGETHER = 50_000, 1024
#: Lines of a later document that meet its sources together; its other lines are in rows of their own.
LINES = 1024
#: Rows of a table of such fingerprints or sources that is broadcast, of some 40 bytes each; beyond, it is joined.
BROADCAST_ROWS = 200_000
_LINES = "doc_id long, th long, hashes array<long>, at array<int>, sizes array<int>, grams array<struct<gram:long,pos:int>>"


#: The number of the last line, whatever it is.
_LAST = (1 << 31) - 1


def line_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, numbers, words) of the lines with words; white space within lines doesn't count."""
    import xxhash

    hashes, numbers, sizes = [], [], []
    for i, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        words = line.split()
        if words:
            hashes.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
            numbers.append(i)
            sizes.append(len(words))
    return np.array(hashes, dtype=np.uint64).astype(np.int64), np.array(numbers, dtype=np.int32), np.array(sizes, dtype=np.int32)


def _key(raw: bytes) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(raw)
    return h - (1 << 64) if h >> 63 else h


def fingerprints(hashes: np.ndarray, sizes: np.ndarray, noise: int = NOISE, guarantee: int = GUARANTEE) -> list[tuple[int, int]]:
    """(hash, first line) of each chosen gram, and of each window of GUARANTEE words: the shortest from a line on or up to a line.

    A window's hash is that of its gram and of all its lines; one that is a gram has the gram's.
    """
    import xxhash

    n = len(hashes)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    gram_end = np.searchsorted(total, total[:-1] + noise)
    gram_end = gram_end[gram_end <= n]  # no gram starts where too few words follow
    window_end = np.searchsorted(total, total[:-1] + guarantee)
    window_end = window_end[window_end <= n]
    raw = hashes.tobytes()
    grams = [xxhash.xxh3_64_intdigest(raw[8 * s : 8 * e]) for s, e in enumerate(gram_end.tolist())]
    ends = np.arange(1, n + 1)[total[1:] >= guarantee]
    starts = np.searchsorted(total, total[ends] - guarantee, side="right") - 1
    windows = sorted({*enumerate(window_end.tolist()), *zip(starts.tolist(), ends.tolist())})
    within = np.searchsorted(gram_end, [e for _, e in windows], side="right").tolist()  # grams that start before this end in the window
    found: dict[tuple[int, int], None] = {}
    for (a, e), stop in zip(windows, within):
        s = a if stop == a + 1 else min(range(a, stop), key=grams.__getitem__)
        gram = grams[s]
        found[gram - (1 << 64) if gram >> 63 else gram, s] = None
        if (a, e) != (s, gram_end[s]):
            found[_key(b"window" + gram.to_bytes(8, "little") + raw[8 * a : 8 * e]), a] = None
    return list(found)


def _list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts), kind) if parts else pa.array([], kind))


def _parts(column: pa.ListArray, field: str | None = None) -> list[np.ndarray]:
    """The values of each row of a column of lists, or those of a field of the structs in it."""
    values = column.values.field(field) if field else column.values
    values, offsets = values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


#: Rows of a batch that are worked on at once.
_ROWS = 1000


def _index(noise: int, guarantee: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, _ROWS) for at in range(0, whole.num_rows, _ROWS)):
                rows = [line_hashes(t.as_py()) for t in b.column(2)]
                lists = [_list_array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
                found = [fingerprints(h, s, noise, guarantee) for h, _, s in rows]
                gram = pa.array([g for row in found for g, _ in row], pa.int64())
                pos = pa.array([p for row in found for _, p in row], pa.int32())
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([gram, pos], names=["gram", "pos"]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists, grams], names=["doc_id", "th", "hashes", "at", "sizes", "grams"])

    return run


def extended(own: np.ndarray, other: np.ndarray, anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs of own, (first, end), that equal a run of other through an anchor (line of own, line of other)."""
    found: list[tuple[int, int]] = []
    seen: dict[int, int] = {}  # of each diagonal, the end of the run found last
    for pos, src in sorted(anchors):
        if own[pos] != other[src] or pos < seen.get(pos - src, 0):
            continue
        n = min(len(own) - pos, len(other) - src)
        unequal = np.flatnonzero(own[pos : pos + n] != other[src : src + n])
        end = pos + (int(unequal[0]) if len(unequal) else n)
        m = min(pos, src)
        unequal = np.flatnonzero(own[pos - m : pos] != other[src - m : src])
        first = pos - m + (int(unequal[-1]) + 1 if len(unequal) else 0)
        seen[pos - src] = end
        found.append((first, end))
    return found


def _extend(guarantee: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            lines = zip(_parts(b.column(2), "pos"), _parts(b.column(2), "src_pos"), *(_parts(b.column(c)) for c in (3, 4, 5, 6)), b.column(7).to_pylist())
            for n, (pos, src, own, at, sizes, other, low) in enumerate(lines):
                runs = [(f, e) for f, e in extended(own, other, list(zip(pos.tolist(), (src - low).tolist()))) if sizes[f:e].sum() >= guarantee]
                if runs:
                    rows.append(n)
                    found.append([(int(at[f]), int(at[e]) - 1 if e < len(at) else _LAST) for f, e in runs])  # at has the line after the part, if there is one
            spans = pa.StructArray.from_arrays([pa.array([s[i] for r in found for s in r], pa.int32()) for i in (0, 1)], names=["first", "last"])
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            kept = b.select([0, 1]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.ListArray.from_arrays(pa.array(offsets), spans)], names=["doc_id", "th", "runs"])

    return run


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _small(table: DataFrame) -> DataFrame:
    """Broadcast what is proven small; else let Spark join it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _later_places(places: DataFrame) -> DataFrame:
    """places (gram, doc_id, th, pos) but each gram's first, with that: src_id, src_th, src_pos."""
    # nulls last among the documents
    where = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "pos")
    first = places.groupBy("gram").agg(F.min(where).alias("src"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select("gram", "n", F.col("src.doc_id").alias("src_id"), F.col("src.th").alias("src_th"), F.col("src.pos").alias("src_pos")))
    crowds = first.where(F.col("n") > CROWD).drop("n")  # no more than places / CROWD
    if crowds.isEmpty():
        met = places.join(first.drop("n"), "gram")
    else:
        crowds = _small(crowds)
        met = places.join(crowds, "gram").unionByName(places.join(crowds, "gram", "left_anti").join(first.where(F.col("n") <= CROWD).drop("n"), "gram"))
    return met.where(~(_same("doc_id", "src_id") & _same("th", "src_th") & (F.col("pos") == F.col("src_pos"))))


def repeated_runs(docs: DataFrame, noise: int = NOISE, guarantee: int = GUARANTEE) -> DataFrame:
    """(doc_id, th, runs): of each document (doc_id, th, text) with later runs, the numbers of their first and last lines, with the lines without words after them."""
    lines = stored(map_batches(docs.select("doc_id", "th", "text"), _index(noise, guarantee), _LINES))
    places = lines.select("doc_id", "th", F.explode("grams").alias("g")).select(F.col("g.gram").alias("gram"), "doc_id", "th", F.col("g.pos").alias("pos"))
    in_part = F.floor(F.col("pos") / LINES).cast("int")
    pairs = _later_places(places).groupBy("doc_id", "th", in_part.alias("slab"), "src_id", "src_th").agg(F.collect_set(F.struct((F.col("pos") - in_part * LINES).alias("pos"), "src_pos")).alias("anchors"))
    pairs = stored(pairs)
    many = pairs.groupBy("src_id", "src_th").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts")).where("parts > 1")
    many = _small(many.select(F.col("src_id").alias("many_id"), F.col("src_th").alias("many_th"), "parts"))  # no more than pairs / TOGETHER
    dealt = pairs.join(many, _same("src_id", "many_id") & _same("src_th", "many_th"), "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "th", "slab"), F.col("parts")).cast("int"), F.lit(0))).drop("many_id", "many_th", "parts")
    whole = lines.select(F.col("doc_id").alias("own_id"), F.col("th").alias("own_th"), "hashes", "at", "sizes").dropDuplicates(["own_id", "own_th"])
    slabs = whole.where(F.size("hashes") > 0).withColumn("own_slab", F.explode(F.sequence(F.lit(0), F.floor((F.size("hashes") - 1) / LINES).cast("int"))))
    # a line has a word at least, so a window has `guarantee` lines at most
    cut = lambda c, more: F.slice(c, F.col("own_slab") * LINES + 1, LINES + guarantee + more)
    own = slabs.select("own_id", "own_th", "own_slab", cut("hashes", 0).alias("hashes"), cut("at", 1).alias("at"), cut("sizes", 0).alias("sizes"))
    other = lines.select(F.col("doc_id").alias("other_id"), F.col("th").alias("other_th"), F.col("hashes").alias("other")).dropDuplicates(["other_id", "other_th"])
    other = other.join(many, _same("other_id", "many_id") & _same("other_th", "many_th"), "left")
    other = other.withColumn("other_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("many_id", "many_th", "parts")
    sides = dealt.join(own, _same("doc_id", "own_id") & _same("th", "own_th") & (F.col("slab") == F.col("own_slab")))
    # of the other's lines only those that a match can reach
    shifts = F.transform("anchors", lambda a: a["src_pos"] - a["pos"])
    low = F.greatest(F.array_min(shifts), F.lit(0))
    high = F.array_max(shifts) + F.size("hashes")
    sides = sides.withColumn("low", low).withColumn("high", high)
    sides = sides.join(other, _same("src_id", "other_id") & _same("src_th", "other_th") & (F.col("part") == F.col("other_part")))
    sides = sides.select("doc_id", "th", "anchors", "hashes", "at", "sizes", F.slice("other", F.col("low") + 1, F.col("high") - F.col("low")).alias("other"), "low")
    runs = map_batches(sides, _extend(guarantee), "doc_id long, th long, runs array<struct<first:int,last:int>>")
    return runs.groupBy("doc_id", "th").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"))


def without_repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = NOISE, guarantee: int = GUARANTEE) -> DataFrame:
    """(row, deleted): each row of docs as a struct with its text shortened, and how many lines were deleted from it.

    Of runs of equal lines with `guarantee` words or more, the first in the corpus stays, by key and then by a hash of
    the text (nulls last), and later ones go, all of them; shorter ones stay. Lines are equal if their words are. Lines
    without words go with the line before them. A text of which nothing is left is empty, a null text stays null. Rows
    equal in key and text are one document and stay alike; of one key, texts are equal if their 64-bit hashes are. Keys are
    whole numbers. Columns other than text are left as they are, whatever their names; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), F.col(text).alias("text"))
    runs = repeated_runs(keyed.select("doc_id", "th", F.coalesce("text", F.lit("")).alias("text")), noise, guarantee)
    runs = stored(runs.select(F.col("doc_id").alias("own_id"), F.col("th").alias("own_th"), "runs"))
    # the runs grow with the corpus, so they have no bound to be broadcast by: both sides are shuffled at every size
    joined = keyed.drop("text").join(runs.hint("merge"), _same("doc_id", "own_id") & (F.col("th") == F.col("own_th")), "left")
    lines = F.split(F.col("row")[text], "\n", -1)
    left = F.filter(lines, lambda _, i: ~F.exists("runs", lambda r: (r["first"] <= i) & (i <= r["last"])))
    shorter = F.when(F.col("runs").isNull(), F.col("row")[text]).otherwise(F.array_join(left, "\n"))
    deleted = F.when(F.col("runs").isNull(), 0).otherwise(F.size(lines) - F.size(left))
    return joined.select(F.col("row").withField(f"`{text}`", shorter).alias("row"), deleted.cast("long").alias("deleted"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = NOISE, guarantee: int = GUARANTEE) -> DataFrame:
    """docs with the columns it had, its text without later repeated runs; see without_repeated_runs."""
    return without_repeated_runs(docs, key, text, noise, guarantee).select("row.*")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Of every document: lines deleted, characters left and the digest of what is left."""
    df = without_repeated_runs(documents(spark, sf_dir).select("doc_id", "text"))
    body = F.coalesce(F.col("row.text"), F.lit(""))
    return df.select("row.doc_id", F.col("deleted").alias("deleted_lines"), F.length(body).cast("long").alias("n_chars"), F.sha2(body, 256).alias("text_sha256"))
