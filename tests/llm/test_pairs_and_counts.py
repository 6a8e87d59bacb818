"""op3, op4, op6, op8 and op10 against brute force, on the smallest tables and on awkward rows."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.llm import golay, lz_fingerprint, mixing, sharding, simhash, token_counts
from quillstack.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fingerprint int, shard string, block int"
#: Nulls, empty texts, ties, repeated rows, a long text without spaces, other white space, columns named as results.
AWKWARD = [
    (None, None, None, None, None, None, None, None, None),
    (None, "", "en", "b", 0, "x", 1, "y", 2),
    (None, "one two", "en", None, 1, "x", 1, "y", 2),
    (1, None, "en", "a", 0, "x", 1, "y", 2),
    (2, "Hello World ÄÖ one\ttwo\x0bthree", "en", "a", 1, "x", 1, "y", 2),
    (3, "x" * 40_000, "de", "a", 1, "x", 1, "y", 2),
    (4, " \n\t ", "de", "a", 1, "x", 1, "y", 2),
    (5, "the same text twice and again", "de", "b", 1, "x", 1, "y", 2),
    (5, "the same text twice and again", "de", "b", 1, "x", 1, "y", 2),
    (5, "another text of the same key", "de", "b", 1, "x", 1, "y", 2),
    (-7, "the same text twice and again", "fr", "ä", 1, "x", 1, "y", 2),
    (9, "<s> </s> <unk> ▁ 日本語 \U0001f600 \x00", "fr", "ä", 1, "x", 1, "y", 2),
    (10, "lorem ipsum " * 4000, "fr", "c", 1, "x", 1, "y", 2),
]


@pytest.fixture(scope="module")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


def plain_print(t, k=3, seed=42):
    import xxhash

    w = [x.decode() for x in (t or "").encode().lower().split()]
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(items, linked):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(items):
        for b in items[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in items}


# --- op3


@pytest.mark.parametrize("crowd", [100_000, 1])
@pytest.mark.parametrize("which", ["small", "awkward"])
def test_simhash_matches_brute_force(which, crowd, request, monkeypatch):
    """Also where fingerprints that two rows share are joined apart."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = [plain_print(t) for _, t in rows]
    group = plain_components(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[group[p]] = min(least.get(group[p], i), i)
    want = Counter((i, f"{p:016x}", least.get(group[p])) for (i, _), p in zip(rows, prints))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_golay_keys_of_close_vectors():
    assert len(set(golay.codewords().tolist())) == 4096
    assert min(int(c).bit_count() for c in golay.codewords()[1:]) == 7
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 500)
    w = v ^ (1 << rng.integers(0, 23, 500)) ^ (1 << rng.integers(0, 23, 500))
    (a, x), (b, y) = golay.near(v), golay.near(w)
    assert all(set(p[i]) & set(q[j]) for p, i, q, j in zip(a, x, b, y))


def test_any_fingerprints_at_three_bits_share_a_key():
    rng = random.Random(2)
    pairs = []
    for _ in range(400):
        v = rng.getrandbits(64)
        pairs.append((v, v ^ sum(1 << b for b in rng.sample(range(64), 3))))
    keys = defaultdict(set)
    flat = np.array([[x] for p in pairs for x in p], dtype=np.uint64)
    for rows, found in simhash.EXACT.keys(flat):
        for r, k in zip(rows.tolist(), found.tolist()):
            keys[r].add(k)
    assert all(keys[2 * i] & keys[2 * i + 1] for i in range(len(pairs)))


def test_crowded_keys_are_dealt_in_blocks(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    near = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    df = spark.createDataFrame([(f"{v:016x}",) for v in near], "fingerprint string")
    links = simhash.links_between(df, hot=20).collect()
    found = {x: x for x in near}
    want = plain_components(sorted(near), lambda a, b: (a ^ b).bit_count() <= 3)
    for a, b in links:
        assert (int(a, 16) ^ int(b, 16)).bit_count() <= 3
    pairs = {frozenset((int(a, 16), int(b, 16))) for a, b in links}
    got = plain_components(sorted(near), lambda a, b: frozenset((a, b)) in pairs)
    assert got == want and found


def test_components_of_a_chain_and_a_star(spark):
    chain = [(f"{i:04d}", f"{i + 1:04d}") for i in range(60)]
    star = [("z0000", f"z{i:04d}") for i in range(1, 50)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain + star + [("q", "q")], "a string, b string")).collect()}
    assert found == {f"{i:04d}": "0000" for i in range(1, 61)} | {f"z{i:04d}": "z0000" for i in range(1, 50)}


# --- op4


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_token_counts_are_the_librarys(which, request):
    docs = request.getfixturevalue(which)
    sp, proven = token_counts._library(token_counts.MODEL)
    assert proven
    want = Counter()
    for r in docs.collect():
        n = len(sp.encode(r.text or ""))
        want[(r.doc_id, len((r.text or "").encode()), n, n > 4096)] += 1
    got = token_counts.token_counts(docs, chunk=700, overlap=16).select("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert Counter(map(tuple, got.collect())) == want


def test_overlaps_widen_until_they_align():
    sp, proven = token_counts._library(token_counts.MODEL)
    rng = random.Random(13)
    base64 = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=3000))
    for text in ["a" * 900 + " b" * 400, " " * 700, "日本語" * 300 + " x", "é\n" * 500, "one two  three\n" * 99, base64, "▁a ▁" * 300, "\U0001f600" * 400]:
        for chunk, overlap in ((50, 3), (200, 20)):
            assert token_counts.count_spliced(sp, proven, text, chunk, overlap)[0] == len(sp.encode(text))


def test_texts_without_spaces_are_spliced_in_linear_time():
    """A megabyte each: many chunks and the library's count; without any boundary, one chunk that was doubled."""
    sp, proven = token_counts._library(token_counts.MODEL)
    rng = random.Random(14)
    japanese = "".join(chr(rng.choice((rng.randrange(0x3041, 0x3096), rng.randrange(0x4E00, 0x9FA0)))) for _ in range(1_000_000))
    line = "[" + ",".join(f'{{"id":{i},"v":{rng.random()}}}' for i in range(30_000)) + "]"
    for text, spliced in ((japanese, True), (line, True), ("a" * 300_000, False)):
        start = time.perf_counter()
        want = len(sp.encode(text))
        library = time.perf_counter() - start
        n, chunks = token_counts.count_spliced(sp, proven, text)
        assert n == want and (chunks > 20) == spliced
        assert time.perf_counter() - start - library < 30 * library + 5


# --- op6


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_lz_fingerprints(which, request):
    docs = request.getfixturevalue(which)
    got = lz_fingerprint.lz_fingerprints(docs).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t)) for i, t in rows)
    prints = {t: lz_fingerprint.to_hex(lz_fingerprint.signature(t)) for _, t in rows}
    assert {(r.doc_id, r.fingerprint) for r in got} == {(i, prints[t]) for i, t in rows}
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    if which == "small":
        order = sorted(rows, reverse=True)
        for (i, t), (_, f) in zip(order, order[1:] + order[:1]):
            r = next(x for x in got if x.doc_id == i)
            e = t[: len(t) - len(t) // 2] + f[: len(t) // 2]
            assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            assert r.edited_fingerprint == lz_fingerprint.to_hex(lz_fingerprint.signature(e))
        assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.2


def plain_phrases(text):
    """Phrases by the definition: the shortest run of symbols that was no phrase before; a symbol is a word of up to twelve characters with the space before it, or one other character."""
    symbols, i = [], 0
    while i < len(text):
        j = i + 1 if text[i] == " " and i + 1 < len(text) and (text[i + 1].isalnum() or text[i + 1] == "_") else i
        k = j
        while k < len(text) and k - j < 12 and (text[k].isalnum() or text[k] == "_"):
            k += 1
        symbols.append(text[i : max(k, i + 1)])
        i = max(k, i + 1)
    seen, at = [], 0
    while at < len(symbols):
        end = at + 1
        while end < len(symbols) and "".join(symbols[at:end]) in seen:
            end += 1
        seen.append("".join(symbols[at:end]))
        at = end
    return set(seen)


def test_fingerprints_are_the_least_hashes_of_the_phrases(small):
    import xxhash

    texts = [r.text or "" for r in small.limit(25).collect()] + ["", " ", "a", "a a a a a", "x" * 40 + " é_1\n\t-"]
    for text in texts:
        text = text[:3000]
        phrases = plain_phrases(text)
        assert phrases == lz_fingerprint.phrases(text)
        bins = defaultdict(list)
        for p in phrases:
            h = xxhash.xxh3_64_intdigest(p)
            bins[h >> 57].append(h)
        want = [min(bins[b]) % 255 if bins[b] else 255 for b in range(128)]
        assert lz_fingerprint.signature(text).tolist() == want


def test_signatures_estimate_the_likeness_of_phrase_sets(small):
    texts = [r.text for r in small.limit(30).collect()]
    errors = []
    for a, b in zip(texts, texts[1:]):
        e = lz_fingerprint.edited(a, b)
        x, y = lz_fingerprint.phrases(a), lz_fingerprint.phrases(e)
        errors.append(lz_fingerprint.likeness(lz_fingerprint.signature(a), lz_fingerprint.signature(e)) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.12


# --- op8


def plain_jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_sharding(which, request):
    docs = request.getfixturevalue(which)
    want = Counter()
    for r in docs.collect():
        b = (r.text or "").encode()
        want[(r.doc_id, len(b) + 1, zlib.crc32(b), "key", plain_jump(r.doc_id or 0, 16), plain_jump(r.doc_id or 0, 17))] += 1
    got = sharding.shard_documents(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_jump_of_extreme_keys_and_growth(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 123456789012345]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 17, 100, 5000):
        got = [r[0] for r in df.select(sharding.jump_shard(F.col("k"), n)).collect()]
        assert got == [plain_jump(k, n) for k in keys]


def test_slots_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", 4)
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    got = defaultdict(list)
    for r in sharding.shard_documents(df).collect():
        got[r.shard].append(r.slot)
    assert sum(map(len, got.values())) == 3000 and all(sorted(x) == list(range(len(x))) for x in got.values())


# --- op10


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = [s for s in names if s not in full]
        if not left:
            return {s: most * sizes[s] for s in names}
        share = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * share > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * share for s in names}
        full |= over


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_mixing(which, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.source, len(words(r.text))) for r in docs.collect()]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = plain_targets(dict(sizes))
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, n) for i, _, n in rows)
    assert all(r.taken in {k * r.size for k in range(4)} for r in got)
    taken, biggest = Counter(), defaultdict(int)
    for r in got:
        key = (r.source_size, round(r.target, 6))
        taken[key] += r.taken
        biggest[key] = max(biggest[key], r.size)
    assert {k for k in taken} == {(sizes[s], round(t, 6)) for s, t in want.items()}
    if which == "small":
        assert all(abs(taken[k] - k[1]) <= biggest[k] / 2 + 1e-6 for k in taken)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))


def test_every_pass_has_its_position_and_rows_are_sorted(small, monkeypatch):
    sizes = {r.doc_id: len(words(r.text)) for r in small.collect()}
    got = mixing.mix(small).collect()
    assert all(len(r.positions) * r.size == r.taken and r.positions == sorted(r.positions) for r in got if r.size)
    assert any(len(r.positions) > 1 for r in got)
    taken = [r.position for r in got if r.positions]
    assert taken == sorted(taken) and all(r.position == r.positions[0] for r in got if r.positions)
    assert all(r.position is None for r in got[len(taken) :])
    assert {r.doc_id: r.size for r in got} == sizes
    monkeypatch.setattr(mixing, "SLOPES", (0.5, -0.5, 0.0))
    other = mixing.mix(small).collect()
    assert {(r.doc_id, r.taken) for r in other} == {(r.doc_id, r.taken) for r in got}
    assert [r.doc_id for r in other] != [r.doc_id for r in got]  # the schedule decides the order


def test_positions_follow_the_schedule(spark):
    slope = F.lit(0.5)
    df = spark.range(0, 11).select((F.col("id") / 10).alias("p")).select("p", mixing.due(F.col("p"), slope).alias("t"))
    for p, t in df.collect():
        assert abs(t + 0.5 * (t * t - t) - p) < 1e-12


# --- all


@pytest.mark.parametrize("function", [simhash.near_duplicates, token_counts.token_counts, lz_fingerprint.lz_fingerprints, sharding.shard_documents, mixing.mix])
def test_empty_tables(awkward, function):
    assert function(awkward.limit(0)).collect() == []


def test_one_row(awkward):
    (r,) = lz_fingerprint.lz_fingerprints(awkward.where("doc_id = 2")).collect()
    assert r.near_next == 1.0
