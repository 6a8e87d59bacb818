"""Token alignment, the Jaccard join and the conversation trie, against plain versions of what they say."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from compare import duck, rows_of
from pyspark.sql import functions as F
from test_pairs_and_counts import AWKWARD, SCHEMA

from quillstack.llm import conversation_trie as trie
from quillstack.llm import jaccard_join as join
from quillstack.llm import queries
from quillstack.llm import token_alignment as align

# --- alignment

ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "a\t \n"), (6, "x▁y"), (7, "  lead  two\n\n  x\t\ty  z"), (8, "<|endoftext|> <s> </s> <unk> <0x41>"), (9, "日本語のテキスト。" * 50), (10, "a" * 5000),
    (11, "foo\x00bar \x1c x"), (12, "é\U0001f642\U0001f642 \xa0　 end \r\n x\u0085y"), (13, "dup it"), (13, "dup it"), (None, "dup it"), (14, "﻿bom ​ zero"), (15, "don't we'll it's 'S x's,y"),
    (16, "tail \t"), (17, "tail "), (18, "tail  "), (19, "a b ᠎ c\x0bd\x0c e"), (20, "x = 1;\n\tif (y):\n\t\treturn (a,b)->[c]{d}; e_f.g@h #9 3.14,15"), (21, "Привет,мир! naïve…,ñandú— ½,² Ⅷ.٣,x"),
]


def plain_alignment(rows):
    """The contract by the libraries, on whole texts."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(align.A_MODEL))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(align.B_MODEL))
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    of_a = lambda i: bytes(byte[c] for c in t.id_to_token(i))
    of_b = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    found, count = [], Counter()
    for key, text in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        if text and not b"".join(map(of_a, a)) == b"".join(map(of_b, b)) == (" " + text).encode():
            a = b = []
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((of_a, a), (of_b, b))]
        at, groups, links = (0, 0), [], []
        for e in sorted(set(ends[0]) & set(ends[1])):
            to = (ends[0].index(e) + 1, ends[1].index(e) + 1)
            groups.append(",".join(map(str, a[at[0] : to[0]])) + "|" + ",".join(map(str, b[at[1] : to[1]])))
            links.append((a[to[0] - 1], b[to[1] - 1]))
            at = to
        count.update(links)
        found.append((key, len(a), len(b), links, ";".join(groups)))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(
        ((k, a, b, len(ls), len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), hashlib.sha256(g.encode()).hexdigest() if g else "") for k, a, b, ls, g in found), key=repr
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def of(df, columns=COLUMNS):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_op11_equals_the_libraries(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert of(queries.QUERIES["op11_token_alignment"](spark, sf)) == plain_alignment(rows)


@pytest.mark.parametrize("chars", [1, 300, align.BLOCK_CHARS])
def test_alignment_of_odd_texts(spark, chars):
    assert of(align.align(spark.createDataFrame(ODD, "doc_id long, text string"), chars=chars)) == plain_alignment(ODD)
    assert of(align.align(spark.createDataFrame(AWKWARD, SCHEMA), chars=chars)) == plain_alignment([r[:2] for r in AWKWARD])
    assert align.align(spark.createDataFrame([], SCHEMA)).collect() == []


def test_alignment_forgets_and_goes_on(spark, monkeypatch):
    al = align.Aligner(align.A_MODEL, align.B_MODEL)
    texts = [t for _, t in ODD]
    want = [al.block(texts)[i] for i in range(2)]
    monkeypatch.setattr(align, "CACHED_BYTES", 0)
    for i in range(0, len(texts), 3):
        counts, digests, *_ = al.block(texts[i : i + 3])
        assert digests == want[1][i : i + 3] and [c.tolist() for c in counts] == [c[i : i + 3].tolist() for c in want[0]]


def test_groups_are_cut_where_no_token_spans():
    assert align.groups([2, 3, 7], [1, 3, 5, 7]) == [(2, 2), (3, 4)]
    rng = random.Random(1)
    for _ in range(500):
        n = rng.randint(1, 30)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n}) for _ in range(2))
        assert align.groups(a, b) == [(a.index(e) + 1, b.index(e) + 1) for e in sorted(set(a) & set(b))]


def test_token_groups_hash_to_the_digest(spark):
    df = spark.createDataFrame([r for r in ODD if r[0] and r[0] != 13], "doc_id long, text string")
    digests = {r.doc_id: r.groups_sha256 for r in align.align(df).collect()}
    assert {r.doc_id: hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "" for r in align.token_groups(df).collect()} == digests


# --- the Jaccard join


def plain_classes(rows, percent=90):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {b" ".join(w)} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    order = sorted((i for i in range(len(rows)) if sets[i]), key=lambda i: len(sets[i]))
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if 100 * len(sets[i]) < percent * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(least.get(top(i), key), key)
    return sorted(((rows[i][0], len(sets[i]), least.get(top(i)), links[i]) for i in range(len(rows))), key=repr)


CLASSES = ["doc_id", "n_shingles", "component_id", "n_links"]


def copies(seed):
    """Groups of texts of all sizes with so many words changed that similarities lie on both sides of the limit."""
    rng = random.Random(seed)
    vocabulary, rows = [f"w{i}" for i in range(3000)], []
    for _ in range(60):
        n = rng.choice([1, 2, 5, 9, 11, 12, 20, 40, 148, 400])
        base = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, n // 50, n // 33])):
                i = rng.randrange(len(w))
                if rng.random() < 0.5:
                    w[i] = rng.choice(vocabulary)
                elif len(w) > 1:
                    del w[i]
            rows.append((len(rows) + 3, " ".join(w)))
    return rows + [(1, None), (2, ""), (None, "a b c d"), (None, None), (0, rows[5][1]), (0, rows[5][1]), (9999, "A B  c\td"), (5000, " \n "), (6000, "ä Ä ß ẞ " + "x" * 30_000)]


@pytest.mark.parametrize("together", [join.TOGETHER, 2000])
def test_classes_equal_brute_force(spark, together):
    rows = copies(5)
    assert of(join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), together=together), CLASSES) == plain_classes(rows)


def test_op12_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert of(queries.QUERIES["op12_jaccard_join"](spark, sf), CLASSES) == plain_classes(rows)


def test_classes_of_awkward_rows(spark, monkeypatch):
    want = plain_classes([r[:2] for r in AWKWARD])
    assert of(join.jaccard_classes(spark.createDataFrame(AWKWARD, SCHEMA)), CLASSES) == want
    monkeypatch.setattr(join, "CROWD", 1)  # sets of several rows are joined apart
    assert of(join.jaccard_classes(spark.createDataFrame(AWKWARD, SCHEMA)), CLASSES) == want
    assert join.jaccard_classes(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("percent", [60, 80, 90, 97])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    near = 0
    for _ in range(1500):
        n = int(rng.integers(1, 300))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        keep, extra = int(rng.integers(max(1, n * percent // 100 - 2), n + 1)), int(rng.integers(0, n // 8 + 2))
        b = np.concatenate([a[:keep], rng.integers(0, 2**63, extra, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
            near += 1
            assert len(np.intersect1d(join.signatures(a, percent), join.signatures(b, percent)))
    assert near > 100


def test_few_unlike_sets_share_a_signature():
    rng = np.random.default_rng(1)
    prints = [join.signatures(np.unique(rng.integers(0, 2**63, 150, dtype=np.uint64))) for _ in range(300)]
    assert sum(n - 1 for n in Counter(np.concatenate(prints).tolist()).values()) < 30


# --- the conversation trie

TURNS = "conv_id long, turn long, role string, text string, rank int, pid string, k1 int, depth string"


def conversations():
    rng = random.Random(7)
    rows = [(None, 0, "user", "lost"), (None, None, None, None), (-5, 0, "user", "neg"), (-20, 1, "user", "base of it"), (-20, 0, None, None), (0, None, "user", "hi there"), (0, 3, "a", "x y"), (0, 3, "a", "x y"), (0, 3, "b", "tie"), (0, 1, "ab", ""), (0, 1, "a", "b")]
    for c in range(1, 160):
        if c % 20 == 0 and c > 60:
            continue  # these have no base
        n = rng.choice([1, 1, 2, 3, 5])
        rows += [(c, t, rng.choice(["user", None]), rng.choice(["hi", "hi there you", "", None, "x  y\tz"])) for t in range(n)]
    rows += [(200, t, "user", f"long {t // 2} of many words") for t in range(400)] + [(203, t, "user", f"long {t // 2} of many words") for t in range(380)] + [(211, 7, "user", "the same")] * 150
    return [(*r, 1, "p", 2, "d") for r in rows]


def in_sql(sf):
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet/*.parquet')")
    found = con.execute(trie.OP13_SQL)
    return rows_of([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("crowd", [trie.CROWD, 2])
def test_trie_of_awkward_conversations(spark, tmp_path, monkeypatch, crowd):
    monkeypatch.setattr(trie, "CROWD", crowd)
    monkeypatch.setattr(trie, "BLOCK", 16 if crowd == 2 else trie.BLOCK)
    monkeypatch.setattr(trie, "PIECE", 3 if crowd == 2 else trie.PIECE)
    spark.createDataFrame(conversations(), TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    df = trie.op13_conversation_trie(spark, str(tmp_path))
    assert rows_of(df.columns, df.collect()) == in_sql(str(tmp_path))


def test_trie_without_conversations(spark):
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "p", 1, "d")], TURNS)).collect() == []


def test_trie_by_hand(spark):
    rows = [(3, 0, "u", "a b"), (3, 1, "u", "c"), (5, 0, "u", "a b"), (5, 1, "u", "d"), (9, 0, "u", "a b"), (12, 0, "u", "a b"), (12, 1, "u", "c")]
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == {(3, 0): (None, 4, 1, 2, 7, sha("")), (3, 1): (3, 4, 2, 2, 7, sha("9")), (3, 2): (3, 2, 0, 1, 1, sha("3,12")), (5, 2): (3, 1, 0, 1, 0, sha("5"))}
    conv = F.col("conv_id")
    turns = trie.numbered(trie.turn_digests(spark.createDataFrame([(c, t, "u", f"{c} {t}") for c in (0, 20, 21, 25) for t in range(5)], "conv_id long, turn long, role string, text string")))
    heads = {r.conv_id: r.n for r in trie.rebuilt(turns).where(conv % 20 != 0).where("rank < 4").groupBy("conv_id").agg(F.count("*").alias("n")).collect()}
    import zlib

    assert heads == {c: zlib.crc32(str(c).encode()) % 4 for c in (21, 25) if zlib.crc32(str(c).encode()) % 4}
