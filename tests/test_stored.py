"""Stored tables: versions, the search index, pages after a key, the finance page from one reading, the intake of files."""

import csv
import io
import json
import random
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_archive import a, frame, ids  # noqa: F401  (a: the archive of rows by hand)

from quillstack.operators import explorer, finance, finance_page, flows, library, search, search_index, writes
from quillstack.operators.explorer import TransactionFilter
from quillstack.plans.archive import stand_ins
from quillstack.sources import bank_csv, json_objects, versions
from quillstack.streaming import ingest


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_scanned(df):
    """Rows that the scans of a query gave, after what files told by their statistics and Bloom filters."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        own = node.metrics().apply("numOutputRows").value() if name.startswith("Scan") else 0
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


# --- versions


def test_a_version_is_seen_whole_or_not_at_all(spark, a, tmp_path):  # noqa: F811
    store = versions.Store(spark, f"file://{tmp_path}/s")
    first = versions.create_archive(store, a, buckets=3)
    held = versions.stored_archive(store, first)
    assert ids(held.documents) == ids(a.documents) and ids(held.transactions) == ids(a.transactions)
    trash = lambda x: replace(x, documents=writes.to_trash(x.documents, spark.createDataFrame([(4,)], "id long"), "now"))
    second = versions.change(store, lambda x: {"documents": x.documents.where("id = 4")}, trash)
    same = [p for p in first.parts["documents"] if first.parts["documents"][p] == second.parts["documents"][p]]
    assert len(first.parts["documents"]) - len(same) == 1 and second.parts["transactions"] == first.parts["transactions"]  # one bucket was written
    assert held.documents.where("id = 4").first().deleted_at is None  # the reader's version
    assert versions.stored_archive(store).documents.where("id = 4").first().deleted_at == "now"
    with pytest.raises(versions.Overtaken):
        versions.change(store, lambda x: {"documents": x.documents.where("id = 5")}, trash, version=first)
    assert store.current().number == second.number

    def fails(x):
        raise OSError("died")

    with pytest.raises(OSError):
        versions.change(store, lambda x: {"documents": x.documents}, fails)
    store.write("documents", a.documents)  # written by somebody who died before the commit
    assert store.current() == second
    assert store.prune() > 0 and ids(versions.stored_archive(store).documents) == ids(a.documents) and store.numbers() == [second.number]


def test_rows_are_not_dealt_out_to_be_written(spark, a, tmp_path, monkeypatch):  # noqa: F811
    """The task that has a row writes it: no shuffle for it, and no bucket that one task sorts."""
    plans, write = [], versions.Store.write
    monkeypatch.setattr(versions.Store, "write", lambda self, table, rows, *rest: plans.append(plan_of(rows)) or write(self, table, rows, *rest))
    store = versions.Store(spark, f"file://{tmp_path}/s")
    spread = replace(a, transactions=a.transactions.repartition(5))
    first = versions.create_archive(store, spread, buckets=2)
    assert plans and not any("hashpartitioning(in_bucket" in p for p in plans)
    held = versions.stored_archive(store, first).transactions
    assert sorted(map(str, held.collect())) == sorted(map(str, a.transactions.select(*held.columns).collect()))
    assert len(held.inputFiles()) > 2


def test_a_lookup_opens_little(spark, tmp_path):
    n = 40_000
    documents = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.lit(None).cast("string").alias("deleted_at"))
    empty = spark.createDataFrame([], "id long, doc_id long, receipt_id long, tx_hash string, file_hash string")
    arch = versions.Archive(documents, empty, empty, empty, empty, empty, empty)
    store = versions.Store(spark, f"{tmp_path}/s")
    versions.create_archive(store, arch, buckets=16)
    digest = documents.where("id = 123").first().content_hash
    by_hash, by_id = versions.lookup(store, "documents", "content_hash", digest), versions.lookup(store, "documents", "id", 123)
    assert ids(by_hash) == ids(by_id) == [123]
    assert rows_scanned(by_hash) <= n / 8 and rows_scanned(by_id) <= n / 8
    assert rows_scanned(versions.lookup(store, "documents", "content_hash", "no such")) <= n / 8


# --- the search index


def _indexed(spark, root, documents):
    store = versions.Store(spark, root)
    search_index.update_index(store, add=documents)
    return store


def _searchable(arch):
    return library.library(arch).select("id", *(c for c in search.FIELDS if c in arch.documents.columns))


@pytest.fixture(scope="module")
def shelf(spark, sf, tmp_path_factory):
    arch = stand_ins(spark, sf)
    return arch, _indexed(spark, str(tmp_path_factory.mktemp("index")), _searchable(arch))


def test_the_index_answers_as_the_scan(spark, a, shelf, tmp_path):  # noqa: F811
    store = _indexed(spark, f"{tmp_path}/i", _searchable(a))
    for q in ("muller", "Müller", "rechn", "muller_strom", "strom_muller", "  %", "summe mwst", "s", "zahlungsziel_summe"):
        assert ids(search_index.found(store, q)) == ids(search.match(a, q)), q
    arch, store = shelf
    for q in ("the ent", "Über", "sender", "sender_1", "e", "7", "zz", "the sender_12"):
        assert ids(search_index.found(store, q)) == ids(search.match(arch, q)), q


def test_the_best_are_those_of_a_full_ranking(spark, shelf):
    arch, store = shelf
    tokens = [r.token for r in search.tokens(arch).select("token").distinct().orderBy("token").collect()]
    rng, index = random.Random(4), search.tokens(arch).persist()
    queries = ["thonre sender", "e", "sender_1 the"] + [" ".join(rng.choice(tokens)[: rng.randint(1, 4)] for _ in range(rng.randint(1, 2))) for _ in range(6)]
    for q in queries:
        got = [(r.id, r.score) for r in search_index.best(store, q, 10).collect()]
        assert got == [(r.id, r.score) for r in search.ranked(arch, q, limit=10, index=index).collect()], q


def test_blocks_that_cannot_reach_the_best_are_not_read(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(["needle"] * (9 if i % 211 == 0 else rng.choice([0, 0, 0, 0, 0, 1, 1, 2])) + ["hay"] * rng.randint(3, 400))) for i in range(6000)]
    store = _indexed(spark, f"{tmp_path}/i", spark.createDataFrame(rows, "id long, extracted_text string"))
    read, every = search_index.share_read(store, "needle", 10)
    assert 0 < read < every / 3
    full = [(r.id, r.score) for r in search_index.scores(store, "needle").orderBy(F.desc("score"), "id").limit(10).collect()]
    assert [(r.id, r.score) for r in search_index.best(store, "needle", 10).collect()] == full


def test_a_prefix_opens_its_letters_and_no_text(shelf):
    _, store = shelf
    files = [f for f in search_index._postings(store, store.current(), "thon").inputFiles()]
    assert files and all("in_shard=th" in f for f in files) and len(files) < len(store.current().parts["postings"])
    assert "extracted_text" not in plan_of(search_index.found(store, "thon ent"))


def test_a_changed_index_is_a_rebuilt_one(spark, shelf, tmp_path):
    arch, _ = shelf
    docs = _searchable(arch)
    store = _indexed(spark, f"{tmp_path}/i", docs)
    edited = docs.where("id % 7 = 1 AND id % 5 <> 0").withColumn("extracted_text", F.lit("brandneu the entwurf"))
    search_index.update_index(store, add=edited, remove=docs.where("id % 5 = 0 OR id % 7 = 1").select("id"))
    left = docs.where("id % 5 <> 0 AND id % 7 <> 1").unionByName(edited)
    fresh = _indexed(spark, f"{tmp_path}/j", left)
    for _ in range(2):
        for q in ("brandneu", "the ent", "entwurf_x", "the_entwurf", "e"):
            assert ids(search_index.found(store, q)) == ids(search_index.found(fresh, q)), q
            key = lambda s: [(r.id, r.score) for r in search_index.best(s, q, 20).collect()]  # noqa: E731, B023
            assert key(store) == key(fresh), q
        search_index.compact(store)
    assert not store.current().parts["gone"]
    nothing = versions.Store(spark, f"{tmp_path}/k")
    search_index.update_index(nothing, add=docs.limit(0))
    assert search_index.best(nothing, "the").collect() == [] == search_index.found(nothing, "the").collect()


def records_shuffled(spark, act):
    """Records that the shuffles of what act does have written."""
    context = spark.sparkContext._jsc.sc()

    def so_far():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = so_far()
    act()
    return sum(n for k, n in so_far().items() if k not in before)


def test_bookings_without_another_side_are_dealt_out(spark):
    rows = spark.range(0, 4000, 1, 4).select("id", F.when(F.col("id") % 100 == 0, "DE1").when(F.col("id") % 2 == 0, "").alias("counterparty_iban"), F.lit("x").alias("category"))
    own = spark.createDataFrame([("DE1",), (None,)], "iban string").select(F.sha2("iban", 256).alias("iban_hash"))
    found = bank_csv.with_transfers(rows, own.hint("merge"))
    assert {r.id for r in found.where("category = 'uebertrag'").collect()} == set(range(0, 4000, 100)) and found.count() == 4000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        counts = bank_csv.with_transfers(rows, own).withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.count("*").alias("n"), F.max("category")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found.columns == rows.columns and max(r.n for r in counts) < 1000


def test_a_document_with_many_receipts_counts_once_in_the_join(spark, a):  # noqa: F811
    many = a.receipts.unionByName(spark.range(4000).select((F.col("id") + 1000).alias("id"), F.lit(1).cast("long").alias("doc_id")), True).repartition(4)
    arch = replace(a, receipts=many)
    categories = [r.category for r in library.library(a).select("category").distinct().collect()]
    got = []
    assert records_shuffled(spark, lambda: got.extend(r.id for r in library.without_receipt(arch, categories).hint("merge").collect())) < 4000 + 1000
    assert sorted(got) == sorted({r.id for r in library.library(a).collect()} - {r.doc_id for r in many.collect()})


def test_an_index_is_built_without_a_shuffled_row_for_each_word(spark, tmp_path):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(50)}" for _ in range(200))) for i in range(300)], "id long, extracted_text string")
    store = versions.Store(spark, f"{tmp_path}/i")
    assert records_shuffled(spark, lambda: search_index.update_index(store, add=docs)) < 300 * 200 / 4
    assert records_shuffled(spark, lambda: search_index.compact(store)) < 300 * 200 / 4


def test_an_index_of_pieces_is_that_of_whole_batches(spark, tmp_path, monkeypatch):
    """Blocks that are cut at some hundred tokens say the same, phrases over their places as well."""
    rng = random.Random(9)
    rows = [(i, f"f{i % 7}", None if i % 9 == 0 else " ".join(f"w{rng.randrange(30)}" for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(200)]
    docs = spark.createDataFrame(rows, "id long, sender string, extracted_text string")
    whole = _indexed(spark, f"{tmp_path}/i", docs)
    monkeypatch.setattr(search_index, "TOGETHER", 150)
    pieces = _indexed(spark, f"{tmp_path}/j", docs)
    got = lambda df: sorted(map(tuple, df.collect()))
    for q in ("w1", "w1 w2", "w3_w4", "f3_w", "f3"):
        assert got(search_index.found(pieces, q)) == got(search_index.found(whole, q)), q
        assert got(search_index.best(pieces, q, 10)) == got(search_index.best(whole, q, 10)), q
    phrase = {i for i, _, text in rows if "w3 w4" in " ".join(x if x != "w4" and not x.startswith("w4") else "w4" for x in (text or "").split())}
    assert {i for i, in got(search_index.found(whole, "w3_w4"))} == phrase


# --- pages


@pytest.mark.parametrize("order_by,direction", [("doc_date", "desc"), ("sender", "asc"), ("sender", "desc"), ("status", "asc")])
def test_pages_join_without_gap_or_repeat(spark, sf, a, order_by, direction):  # noqa: F811
    arch = stand_ins(spark, sf)
    sender = F.when(F.col("id") % 4 > 0, F.col("sender"))  # some are null
    arch = replace(arch, documents=arch.documents.withColumn("sender", sender))
    whole = [r.id for r in library.listing(arch, order_by=order_by, direction=direction, limit=10_000).collect()]
    found, last = [], None
    while page := library.page_after(arch, last, order_by=order_by, direction=direction, limit=37).collect():
        found += [r.id for r in page]
        last = (page[-1].page_key, page[-1].id)
    assert found == whole
    assert "TakeOrderedAndProject" in plan_of(library.page_after(arch, last, order_by=order_by, direction=direction))


def test_pages_of_bookings(spark, sf):
    arch, f = stand_ins(spark, sf), TransactionFilter(direction="expense")
    whole = [r.id for r in explorer.page(arch, f, 500).collect()]
    found, last = [], None
    for _ in range(5):
        page = explorer.page_after(arch, f, last, 100).collect()
        found += [r.id for r in page]
        last = (page[-1].booking_date, page[-1].id)
    assert found == whole


def test_the_finance_page_is_what_the_single_queries_say(spark, a, sf):  # noqa: F811
    single = {
        "summary": finance.summary, "by_category": finance.by_category, "monthly": finance.monthly, "top_counterparties_expense": finance.top_counterparties, "top_counterparties_income": lambda x: finance.top_counterparties(x, "income"),
        "recurring": finance.recurring, "periods": finance.periods, "heatmap": finance.heatmap, "by_weekday": finance.by_weekday, "by_day_of_month": finance.by_day_of_month, "category_monthly": finance.category_monthly,
        "category_totals_spend": finance.category_totals, "category_totals_income": lambda x: finance.category_totals(x, direction="income"), "by_tx_type": finance.by_tx_type, "treemap": finance.treemap,
        "balance_history": finance.balance_history, "accounts": finance.accounts, "kpis": finance.kpis,
    }
    plain = lambda df: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    for arch in (a, replace(a, transactions=a.transactions.limit(0)), stand_ins(spark, sf)):
        page = finance_page.page(arch)
        assert page.keys() == single.keys()
        for name, query in single.items():
            rows = query(arch)
            assert plain(page[name].select(*rows.columns)) == plain(rows), name


def test_the_finance_page_reads_bookings_once(spark, a, tmp_path):  # noqa: F811
    a.transactions.write.parquet(f"{tmp_path}/t")
    seen = finance_page.groups(replace(a, transactions=spark.read.parquet(f"{tmp_path}/t")))
    assert f"{tmp_path}/t" not in plan_of(seen)  # what results are cut from has no bookings any more


# --- replies


def test_first_object_takes_time_by_length():
    began = time.perf_counter()
    for text in ("{" * 100_000, "{" * 50_000 + "}" * 50_000, '{"a":' * 40_000 + "1" + "}" * 40_000, '{"a":' * 900 + "x" + "}" * 900, '{"x' * 30_000, '{"\\"' * 30_000, '{ "' + "{" * 100_000 + '"}'):
        json_objects.first_object(text + ' {"b": 1}')
    assert time.perf_counter() - began < 10
    assert json_objects.first_object("{" * 100_000 + ' {"b": {}}') == '{"b": {}}'


def test_first_object_is_the_first_brace_at_which_one_begins():
    rng = random.Random(3)
    parts = ["{", "}", '"', "\\", "a", ":", "1", ",", "[", "]", '{"a":1}', '{"b":"}"}', " ", "{}", '{"a":{"b":2}}', '\\"', "é", "\n"]

    def slow(text):
        for i, c in enumerate(text):
            if c == "{":
                try:
                    return text[i : json.JSONDecoder().raw_decode(text, i)[1]]
                except ValueError:
                    pass
        return None

    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 26)))
        assert json_objects.first_object(text) == slow(text), text
    assert json_objects.first_object('{"a": NaN} {"a": 1, "a": 2} {"c": 3}') == '{"c": 3}'


def test_a_retry_asks_once_for_each_document(spark, a):  # noqa: F811
    asked = spark.sparkContext.accumulator(0)

    def model(prompt):
        asked.add(1)
        return "" if prompt.startswith("1") else '{"category": "src1", "confidence": 0.9}'

    documents = a.documents.withColumn("filename", F.col("id").cast("string")).withColumn("status", F.lit("review")).withColumn("deleted_at", F.lit(None).cast("string"))
    after = flows.retry_review(replace(a, documents=documents), model, {"src1": []}, text="filename").documents
    assert "ArrowEvalPython" not in plan_of(after) and "MapInPandas" not in plan_of(after)
    got, before = {r.id: r for r in after.collect()}, {r.id: r for r in documents.collect()}
    assert asked.value == len(got) == len(before)
    for i, r in got.items():
        failed = str(i).startswith("1")
        assert (r.status, r.category) == (("failed", before[i].category) if failed else ("filed", "src1"))


# --- bank files in blocks


def plain_rows(path):
    """The rows of a bank file by Python's reader, the whole file at once."""
    raw = open(path, "rb").read()
    text = bank_csv.decode(raw)
    reader = csv.reader(io.StringIO(text), delimiter=bank_csv.separator(text))
    header = next((r for r in reader if any(x.strip() for x in r)), [])
    keys = [bank_csv.key_of(h) for h in header]
    if not set(bank_csv.REQUIRED) <= set(keys):
        return None
    found = [(i, {k: v.strip() for k, v in zip(keys, r) if k}) for i, r in enumerate(reader, 1) if any(x.strip() for x in r)]
    return sorted(((i, *(f.get(k, "") for k in bank_csv.COLUMNS)) for i, f in found), key=repr)


def test_bank_files_are_read_by_the_block(spark, tmp_path):
    rng, want = random.Random(1), {}
    names = ["Auftragskonto", "Buchungstag", "Betrag", "Verwendungszweck", "Gläubiger ID", "Waehrung"]
    cells = ["", "DE1", "05.03.24", "1,5", "a;b", 'q"q', '"x"', "zwei\nzeilen", "drei\nzeilen\n\n mehr", "ä ö", "\t", "komma, hier", "\x85 \x0b"]
    for n in range(14):
        sep, encoding = rng.choice([";", ",", "\t"]), rng.choice(["utf-8", "utf-8-sig", "cp1252", "latin-1"])
        rows = [sep.join(names)]
        for _ in range(rng.choice([0, 1, 60, 90])):
            row = [c for c in rng.choices(cells, k=len(names))]
            row = ['"' + c.replace('"', '""') + '"' if rng.random() < 0.6 or sep in c or "\n" in c else c for c in row]
            rows.append(sep.join(row) if rng.random() < 0.9 else rng.choice(["", sep * 3, " ", f'DE9{sep}01.02.24{sep}5"']))
        text = rng.choice(["", "\n", " \n\n"]) + "\n".join(rows) + rng.choice(["", "\n", '\nDE1;"never closed'])
        raw = text.replace("\x85", "…").encode(encoding) if encoding != "latin-1" else text.encode(encoding) + b"\nDE1;\x81"
        (tmp_path / f"f{n}.csv").write_bytes(raw)
        want[f"f{n}.csv"] = plain_rows(tmp_path / f"f{n}.csv")
    (tmp_path / "g.csv").write_bytes(b"Konto;x\n1;2\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = bank_csv.read_files(spark, [str(tmp_path)]).collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {}
    for r in rows:
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.line_no, *(r[c] for c in bank_csv.COLUMNS)) if r.problem is None else r.problem)
    assert got.pop("g.csv") == ["missing columns: booking_date, amount"]
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: v for k, v in want.items() if v}


# --- the intake of files


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(ingest.USE_ROCKSDB[0], None)
    spark.conf.set(*ingest.USE_ROCKSDB)
    yield spark
    spark.conf.set(ingest.USE_ROCKSDB[0], before) if before else spark.conf.unset(ingest.USE_ROCKSDB[0])


def _look(folder, n, sizes):
    (folder / f"look{n}.tmp").write_text("".join(json.dumps({"path": p, "length": s}) + "\n" for p, s in sizes.items()))
    (folder / f"look{n}.tmp").rename(folder / f"look{n}.json")


def test_a_file_that_grows_is_held_back(rocksdb, tmp_path):
    spark = rocksdb
    (tmp_path / "looks").mkdir()
    out = str(tmp_path / "settled")

    def run():
        seen = spark.readStream.schema(ingest.LOOK).option("pathGlobFilter", "*.json").json(str(tmp_path / "looks"))
        return ingest.run_settling(spark, "", out, str(tmp_path / "state"), wait=1.0, seen=seen, processingTime="0 seconds")

    def passed(query, want, least=0.0):
        until, began = time.time() + 60, time.time()
        while time.time() < until:
            got = sorted((r.path, r.length) for r in spark.read.schema(ingest.LOOK).parquet(out).collect()) if (tmp_path / "settled" / "_spark_metadata").exists() else []
            if got == want and time.time() - began >= least:
                return got
            time.sleep(0.5)
        return got

    query = run()
    _look(tmp_path / "looks", 1, {"a": 1, "b": 5})
    _look(tmp_path / "looks", 2, {"a": 2, "b": 5})
    assert passed(query, [("b", 5)]) == [("b", 5)]
    query.stop()
    query = run()  # started again: what was seen is known
    _look(tmp_path / "looks", 3, {"a": 3, "b": 5})
    time.sleep(3)
    assert passed(query, [("b", 5)]) == [("b", 5)]  # one look at this size is not enough
    _look(tmp_path / "looks", 4, {"a": 3, "b": 5})
    assert passed(query, [("a", 3), ("b", 5)]) == [("a", 3), ("b", 5)]
    _look(tmp_path / "looks", 5, {"a": 3, "b": 5})
    assert passed(query, [("a", 3), ("b", 5)], 3) == [("a", 3), ("b", 5)]  # each once
    query.stop()


def test_looks_at_a_folder(rocksdb, tmp_path):
    spark = rocksdb
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("text")
    (tmp_path / "in" / "x.exe").write_text("no")
    query = ingest.looks(spark, str(tmp_path / "in"), 0.2).writeStream.format("memory").queryName("looked").start()
    until = time.time() + 60
    while time.time() < until and spark.table("looked").count() < 2:
        time.sleep(0.3)
    query.stop()
    assert {(r.path, r.length) for r in spark.table("looked").collect()} == {(f"{tmp_path}/in/a.txt", 4)}


def test_receipts_come_with_their_documents_or_not_at_all(rocksdb, tmp_path, monkeypatch):
    spark = rocksdb
    box, root, state = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "state")
    box.mkdir()
    provider = lambda prompt: '{"category": "Bank", "confidence": 0.9}'
    reader = lambda prompt: '{"shop_name": "Laden", "total_amount": "3,50", "items": [{"name": "Brot", "total_price": "1"}, {"name": "Milch"}]}'

    def put(**texts):
        for name, text in texts.items():
            (box / f"{name}.txt").write_text(text)
        spark.createDataFrame([(str(box / f"{n}.txt"), len(t)) for n, t in texts.items()], ingest.LOOK).write.mode("append").parquet(str(tmp_path / "settled"))

    def run():
        ingest.run_intake(spark, str(tmp_path / "settled"), root, state, {"Bank": []}, provider, reader).awaitTermination()

    def held():
        t = ingest.tables(versions.Store(spark, root))
        docs = {r.path.rsplit("/", 1)[1][0]: (r.category, r.status) for r in t["documents"].collect()}
        return docs, t["receipts"].count(), sorted(r.name for r in t["receipt_items"].collect())

    put(a="Kassenbon Rückgeld girocard", b="ein Brief", c="ein Brief", d=" ")
    real, calls = versions.Store.write, []

    def failing(self, table, *args, **kwargs):
        calls.append(table)
        if table == "receipt_items" and calls.count(table) == 1:
            raise OSError("died between two tables")
        return real(self, table, *args, **kwargs)

    monkeypatch.setattr(versions.Store, "write", failing)
    with pytest.raises(Exception, match="died between two tables"):
        run()
    assert held() == ({}, 0, [])
    run()
    first = ({"a": ("Kassenzettel", "filed"), "b": ("Bank", "filed"), "c": ("Bank", "duplicate"), "d": ("", "failed")}, 1, ["Brot", "Milch"])
    assert held() == first
    put(e="ein Brief", f="Kassenbon Rückgeld girocard")
    run()
    run()
    assert held() == (first[0] | {"e": ("Bank", "duplicate"), "f": ("Kassenzettel", "duplicate")}, 1, ["Brot", "Milch"])
    store = versions.Store(spark, root)
    again = spark.createDataFrame([(str(box / "b.txt"), 9, "h", None)], "path string, length long, content_hash string, original string")
    assert not ingest.take_in(store, again, 0, {"Bank": []}, provider, reader)  # a batch that is delivered again
    assert held()[0].keys() == {"a", "b", "c", "d", "e", "f"}
