"""Near-duplicates by verified shingle similarity, against brute force over all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_pairs_and_counts import AWKWARD, SCHEMA

from quillstack.llm import jaccard_join, similar


def plain_set(text):
    w = [x.decode("utf-8", "surrogatepass") for x in (text or "").encode("utf-8", "surrogatepass").lower().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_kept(rows, least=0.8):
    """The keys that stay: the least of each component over all pairs. Keys are distinct."""
    sets = {i: plain_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = sorted(sets)
    for n, i in enumerate(keys):
        for j in keys[:n]:
            if jaccard(sets[i], sets[j]) >= least and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in keys}


def replaced(rng, words, share):
    """words with a share of them replaced, in one run or one by one."""
    out, n = list(words), round(share * len(words))
    if rng.random() < 0.5:
        at = rng.randrange(len(out) - n + 1)
        places = range(at, at + n)
    else:
        places = rng.sample(range(len(out)), n)
    for p in places:
        out[p] = f"new{rng.randrange(10**6)}"
    return out


def test_recall_between_six_tenths_and_one(spark):
    """Pairs of every similarity: none under 0.8 is linked, and at least nine in ten of those above are; all but few beyond 0.85."""
    rng = random.Random(21)
    rows, pairs = [], []
    for _ in range(900):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(40, 300))]
        a, b = " ".join(base), " ".join(replaced(rng, base, rng.choice([0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.16])))
        pairs.append((len(rows), len(rows) + 1, jaccard(plain_set(a), plain_set(b))))
        rows += [(len(rows), a), (len(rows) + 1, b)]
    kept = {r.doc_id for r in similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(a in kept for a, _, _ in pairs)
    assert all(b in kept for _, b, j in pairs if j < 0.8)
    limit, above = [b not in kept for _, b, j in pairs if 0.8 <= j < 0.85], [b not in kept for _, b, j in pairs if j >= 0.85]
    assert len(limit) > 30 and len(above) > 200
    assert sum(limit) >= 0.9 * len(limit) and sum(above) >= 0.99 * len(above)


def test_no_pair_at_the_limit_is_missed(spark):
    """Pairs of similarity 0.8 to 0.84, of all sizes, exactly at the limit among them: all of them are linked, and none below."""
    rng = random.Random(23)
    rows, pairs = [], []
    for n in range(400):
        size = rng.choice([9, 13, 22, 49, 100, 300, 900])
        base = [f"p{n}_{i}" for i in range(size + 4)]  # of so many shingles
        cut = size * rng.choice([20, 19, 17, 21]) // 100  # those that lack at an end
        a, b = " ".join(base), " ".join(base[: len(base) - cut])
        pairs.append((len(rows), len(rows) + 1, jaccard(plain_set(a), plain_set(b))))
        rows += [(len(rows), a), (len(rows) + 1, b)]
    assert sum(j == 0.8 for _, _, j in pairs) > 20 and sum(j < 0.8 for _, _, j in pairs) > 20
    kept = {r.doc_id for r in similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == plain_kept_pairs(pairs)


def plain_kept_pairs(pairs):
    return {a for a, _, _ in pairs} | {b for _, b, j in pairs if j < 0.8}


@pytest.mark.parametrize("hot", [1 << 13, 16])
def test_groups_of_copies_against_all_pairs(spark, hot):
    """One row of each component stays, in groups up to two hundred, exact copies among them; also with crowded keys."""
    rng = random.Random(22)
    rows = []
    for size in [1] * 60 + [2] * 20 + [5] * 8 + [40, 200]:
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 200))]
        for c in range(size):
            rows.append((len(rows), " ".join(base if c % 3 == 0 else replaced(rng, base, rng.choice([0.005, 0.01, 0.02])))))
    rows += [(len(rows), ""), (len(rows) + 1, " \n"), (len(rows) + 2, "just one line")]
    rng.shuffle(rows)
    kept = {r.doc_id for r in similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
    want = plain_kept(rows)
    assert want <= kept and len(kept - want) <= 2


def test_sets_of_long_texts_are_those_of_all_words(monkeypatch):
    import xxhash

    text = " ".join(f"W{i % 977}" for i in range(9000))
    want = {xxhash.xxh3_64_intdigest(" ".join(s).encode()) for s in plain_set(text)}
    monkeypatch.setattr(similar, "_SLICE", 64)
    assert similar.shingle_set(text).tolist() == sorted(want)


def test_one_of_each_of_awkward_rows(spark):
    awkward = spark.createDataFrame(AWKWARD, SCHEMA).select("*", *(F.lit("x").alias(c) for c in ("row", "th", "place", "id", "w0", "kept", "node", "root", "none")))
    got = similar.one_of_each(awkward)
    assert got.columns == awkward.columns
    texts = defaultdict(set)
    for r in AWKWARD:
        texts[frozenset(plain_set(r[1]))].add(r[0])
    want = {min((k is None, k or 0) for k in keys) for keys in texts.values()}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(want)
    assert similar.one_of_each(awkward.limit(0)).collect() == []


def test_unlike_texts_are_not_tied(spark, monkeypatch):
    """Texts without a shingle in common are not brought together to be compared, however alike in size."""
    rng = random.Random(24)
    rows = [(n, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 64)))) for n in range(600)]
    ties, components = [], jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda edges: ties.append(edges.count()) or components(edges))
    assert similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == 600
    assert ties == [0]


@pytest.mark.parametrize("often", [1000, 3])
@pytest.mark.parametrize("rows", [1, 2, 7, 1000])
def test_elements_of_several_nodes_are_counted_over_batches(monkeypatch, often, rows):
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    pairs = sorted([(e, n) for e in range(40) for n in range(e % 6)] + [(e, 0) for e in range(0, 40, 3)])
    batches = [pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs[at : at + rows]], pa.int64()) for i in (0, 1)], names=["element", "node"]) for at in range(0, len(pairs), rows)]
    got = {(r["element"], r["node"], r["often"]) for b in jaccard_join._shared(iter(batches)) for r in b.to_pylist()}
    counts = Counter(e for e, _ in set(pairs))
    assert got == {(e, n, min(counts[e], often)) for e, n in pairs if counts[e] > 1}


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_similar_sets_have_enough_of_what_is_sent_in_common(percent):
    rng = np.random.default_rng(percent)
    near = 0
    for _ in range(2000):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 200)), dtype=np.uint64))
        keep, extra = int(rng.integers(max(1, len(a) * percent // 100 - 1), len(a) + 1)), int(rng.integers(0, len(a) // 6 + 2))
        b = np.unique(np.concatenate([rng.permutation(a)[:keep], rng.integers(0, 2**63, extra, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both):
            near += 1
            least = [jaccard_join.least_shared(len(x), percent) for x in (a, b)]
            sent = [x[: len(x) - o + jaccard_join.common(len(x), percent)] for x, o in zip((a, b), least)]
            assert len(np.intersect1d(*sent)) >= max(jaccard_join.common(o, percent) for o in least) >= 1
    assert near > 100
