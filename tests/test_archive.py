"""Edge rows by hand: visibility, nulls, gaps, ties, folding; scalars, bank files, replies, changes and the inbox."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillstack.functions import rules, scalars
from quillstack.operators import explorer, finance, flows, library, search, writes
from quillstack.operators.explorer import TransactionFilter
from quillstack.plans.archive import SCHEMAS, Archive, open_archive
from quillstack.sources import bank_csv, replies
from quillstack.streaming import inbox


def frame(spark, name, rows, columns):
    """A table of the archive from a few columns; the others are null."""
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    types = dict(x.strip().split(" ", 1) for x in SCHEMAS[name].replace("(18,2)", "(18;2)").replace("(18,4)", "(18;4)").split(","))
    kind = lambda c: types[c].replace(";", ",")
    value = lambda c: F.split(F.col(c), "/").cast("array<string>") if c == "tags" else F.col(c).cast(kind(c))
    return df.select(*((value(c) if c in columns else F.lit(None).cast(kind(c))).alias(c) for c in types))


@pytest.fixture(scope="module")
def a(spark):
    documents = frame(spark, "documents", [
        ("1", "Bank", "2024-01-05", None, "h1", "filed", "2024-01-06T10:00:00", "Müller Stromrechnung", "bank/a.pdf", "10", "0.5"),
        ("2", "Bank", "", "2024-09-01", "h1", "filed", "2024-01-05T10:00:00", "gelöscht", "bank/a.pdf", "10", "0.5"),
        ("3", "_csv_container", None, None, "", "csv_container", "2024-01-07T10:00:00", "", "x", "0", "0"),
        ("4", "Rechnung", None, None, "h1", "review", "2024-01-08T10:00:00", "Summe 12,00 MwSt bar Rückgeld", "bank/a.pdf", "10", None),
        ("5", "rechnung", "2023-12-31", None, None, "filed", "2024-02-08T10:00:00", "Rechnungsnummer 7 Zahlungsziel Summe MwSt", "r/b.pdf", "10", "0.25"),
    ], ["id", "category", "doc_date", "deleted_at", "content_hash", "status", "created_at", "extracted_text", "library_path", "file_size", "cost_usd"])
    documents = documents.withColumn("tags", F.when(F.col("id") == 1, F.array(F.lit("grün"), F.lit("grün"), F.lit("a"))).otherwise(F.array().cast("array<string>")))
    statements = frame(spark, "statements", [("10", "1", "1", "2024-01-01", "100.00"), ("11", "2", "1", "2023-01-01", "999.00"), ("12", "3", "2", "2024-01-01", None)], ["id", "doc_id", "account_id", "period_start", "opening_balance"])
    transactions = frame(spark, "transactions", [
        ("1", "10", "1", "2023-11-30", "-10.00", "REWE", "food", "t1"), ("2", "10", "1", "2024-02-29", "-5.50", "rewe", "food", "t2"), ("3", "10", "1", "2024-02-29", "20.00", "Ärzte", None, "t3"),
        ("4", "10", "1", None, "-1.00", "ärzte", "", "t4"), ("5", "10", "1", "2024-02-31", "-2.00", " REWE ", "food", "t5"), ("6", "11", "1", "2024-03-01", "-1000.00", "gone", "food", "t6"),
        ("7", "12", "2", "2024-01-15", "-7.00", None, "uebertrag", "t7"), ("8", "12", "2", "31.07.2024", "-3.00", "x_y", "food", None), ("9", "12", "2", "", "-4.00", "xzy", "sonstiges", None),
    ], ["id", "statement_id", "account_id", "booking_date", "amount", "counterparty", "category", "tx_hash"])
    receipts = frame(spark, "receipts", [("1", "1", "Laden", "9.99"), ("2", "2", "Laden", "5.00")], ["id", "doc_id", "shop_name", "total_amount"])
    items = frame(spark, "receipt_items", [("1", "1", "Milch", "1.09"), ("2", "2", "Brot", "2.00")], ["id", "receipt_id", "name", "total_price"])
    accounts = frame(spark, "accounts", [("1", "Bank A", "i1"), ("2", "Bank B", "i2")], ["id", "bank_name", "iban_hash"])
    overrides = frame(spark, "overrides", [("t1", "neu", "x")], ["tx_hash", "category", "set_at"])
    return Archive(documents, receipts, items, accounts, statements, transactions, overrides)


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_visibility_and_null_categories(a):
    assert ids(finance.live_transactions(a)) == [1, 2, 3, 4, 5, 7, 8, 9]
    (s,) = finance.summary(a).collect()
    assert (s.income, s.expense, s.tx_count, s.transfer_count, s.transfer_volume) == (0.0, -25.5, 6, 1, -7.0)  # the null category is neither
    assert ids(explorer.page(a, TransactionFilter(exclude_transfers=True))) == [1, 2, 3, 4, 5, 8, 9]


def test_months_fill_gaps_over_the_year(a):
    rows = {r.month: r.n for r in finance.monthly(replace(a, transactions=a.transactions.where("id < 6"))).collect()}
    assert rows == {"2023-11": 1, "2023-12": 0, "2024-01": 0, "2024-02": 2}
    assert finance.monthly(replace(a, transactions=a.transactions.limit(0))).collect() == []


def test_folding_is_ascii_only(a):
    (t,) = [r for r in finance.top_counterparties(a).collect() if r.counterparty.startswith("R") or r.counterparty == "rewe"]
    assert t.times == 2 and t.total == -15.5
    tree = {r.key: r.times for r in finance.treemap(a).collect()}
    assert tree["rewe"] == 3 and "ärzte" in tree
    assert ids(explorer.page(a, TransactionFilter(text="x_y"))) == [8]  # no wildcard


def test_days_that_do_not_exist_are_left_out(a):
    assert sum(r.n for r in finance.by_weekday(a).collect()) == 2 and len(finance.by_day_of_month(a).collect()) == 31


def test_balance_ends_at_anchor_plus_sum(a):
    rows = [r for r in finance.balance_history(a).collect() if r.account_id == 1]
    assert max(rows, key=lambda r: r.date).balance == 100 - 10 - 5.5 + 20 - 2


def test_properties_of_sums(a):
    f = TransactionFilter()
    (t,) = explorer.totals(a, f).collect()
    assert t["count"] == explorer.page(a, f).count() == sum(r.n for r in explorer.categories(a, f).collect())
    assert abs(sum(r.total for r in explorer.categories(a, f).collect()) - t.sum_net) < 1e-9


def test_recurring_with_the_real_settings(spark, a):
    rows = [(str(100 + i), "10", "1", f"2024-0{i + 1}-01", x, "Miete GmbH", "wohnen", f"m{i}") for i, x in enumerate(("-500.00", "-500.00", "-520.00"))]
    t = frame(spark, "transactions", rows, ["id", "statement_id", "account_id", "booking_date", "amount", "counterparty", "category", "tx_hash"])
    (r,) = finance.recurring(replace(a, transactions=t)).collect()
    assert r.months == 3 and r.counterparty == "Miete GmbH" and r.min_amount == -520.0


def test_library(a):
    assert ids(library.listing(a)) == [1, 4, 5]
    assert [r.id for r in library.listing(a).collect()] == [4, 1, 5]  # an undated document sorts by its scan
    assert ids(library.listing(a, library.DocumentFilter(year="unknown"))) == [4]
    assert {r.tag: r["count"] for r in library.tags(a).collect()} == {"grün": 2, "a": 1}
    (g,) = library.duplicate_groups(a).collect()
    assert g.ids == [1, 4]
    (s,) = library.siblings(a, 1).collect()
    assert (s.position, s.total, s.prev_id, s.next_id) == (2, 3, 5, 4)
    tree = {(r.year, r.category, r.level): r.n for r in library.tree(a).collect()}
    assert tree[("—", None, 1)] == 1 and tree[(None, None, 3)] == 3


def test_duplicate_groups_list_all_ids(spark, a):
    """Lists of more than a thousand ids, over many days and within one; nulls come last, as in the SQL."""
    rows = [(i, f"h{i % 2}", f"2024-01-{1 + i * 7 % 28:02d}T10:00:{i % 60:02d}" if i % 2 else f"2024-01-01T{i % 24:02d}:00:00") for i in range(3000)]
    rows += [(3001, "h0", None), (3000, "h0", None), (None, "h0", None), (None, "h1", "2024-01-01T00:00:00"), (3002, "h2", None), (3003, None, None), (3004, "", None), (3005, "", None)]
    documents = spark.createDataFrame(rows, "id long, content_hash string, created_at string")
    documents = documents.select("*", F.lit("Bank").alias("category"), F.lit(None).cast("string").alias("deleted_at"), F.when(F.col("id").isNull(), 7).otherwise(F.col("id")).alias("file_size"))
    found = replace(a, documents=documents)
    last = lambda x: (x is None, x or 0)
    want = {h: [i for i, g, _ in sorted(rows, key=lambda r: (r[2] is None, r[2] or "", *last(r[0]))) if g == h] for h in ("h0", "h1")}
    assert {r.content_hash: (r.n, r.ids) for r in library.duplicate_groups(found).collect()} == {h: (len(w), w) for h, w in want.items()}
    assert sorted((r.content_hash, r.n, r.place, *last(r.id)) for r in library.duplicate_members(found).collect()) == [(h, len(w), k + 1, *last(i)) for h, w in want.items() for k, i in enumerate(w)]
    (waste,) = library.duplicate_waste(found).collect()
    assert waste.wasted_bytes == sum((7 if w[0] is None else w[0]) * (len(w) - 1) for w in want.values())


def test_search(a):
    assert ids(search.match(a, "muller")) == ids(search.match(a, "Müller")) == [1]
    assert ids(search.match(a, "rechn")) == [5]  # not inside Stromrechnung
    assert ids(search.match(a, "muller_strom")) == [1] and ids(search.match(a, "strom_muller")) == []
    assert ids(search.match(a, "  %")) == [1, 4, 5]
    assert [r.id for r in search.ranked(a, "summe").collect()] == [4, 5] or [r.id for r in search.ranked(a, "summe").collect()] == [5, 4]


def test_scalars(spark):
    dates = {"2024-01-05": "2024-01-05", "05.03.26": "2026-03-05", "05.03.71": "1971-03-05", "5.3.2026": "2026-03-05", "2026/03/05": "2026-03-05", "2026-13-01": None, "31.02.2024": "2024-02-31", "x": None, "": None, None: None}
    amounts = {"-39,98": "-39.98", "1.234,56": "1234.56", "12.5": "12.50", "": None, "abc": None, "nan": None, "1.234": "1.23", "+5": "5.00", None: None}
    for table, f in ((dates, scalars.normalise_date), (amounts, lambda c: scalars.parse_amount(c).cast("string"))):
        df = spark.createDataFrame([(k,) for k in table], "c string")
        assert {r.c: r.v for r in df.select("c", f(F.col("c")).alias("v")).collect()} == table
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(scalars.slug(F.lit(" Größe: Über & Äpfel! "))) == "groesse-ueber-aepfel"
    assert one(scalars.file_name(F.lit("2024-01-02"), F.lit("Bank"), F.lit(""), F.lit("Auszug 1"))) == "2024-01-02-bank-auszug-1.pdf"
    assert one(scalars.normalise_iban(F.lit(" de12 3456 "))) == "DE123456" and one(scalars.iban_hash(F.lit(" "))) is None
    assert one(scalars.decode_tags(F.lit("[broken"))) == [] and one(scalars.decode_tags(F.lit('["a","b"]'))) == ["a", "b"]
    assert one(scalars.display_size(F.lit(2048))) == "2.0 KB" and one(scalars.to_number(F.lit("inf"))) is None
    assert one(scalars.narrow_page(F.lit(100), F.lit(200))) and not one(scalars.narrow_page(F.lit(0), F.lit(200)))
    assert [str(one(x)) for x in scalars.date_preset(F.lit("2024-03-15").cast("date"), "last_month")] == ["2024-02-01", "2024-02-29"]
    assert one(rules.tx_type(F.lit("ÜBERWEISUNG"))) == "ueberweisung" and one(rules.tx_type(F.lit(None).cast("string"))) == "sonstiges"
    assert one(rules.is_receipt(F.lit("BON-NR 3 Kassierer 2"))) and not one(rules.is_receipt(F.lit("Rechnungs-Nr: 7 Zahlungsziel Kassierer Payback"))) and not one(rules.is_receipt(F.lit("girocard")))


def _write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_bank_files(spark, tmp_path, a):
    body = "Auftragskonto;Buchungstag;Valutadatum;Buchungstext;Verwendungszweck;Gläubiger ID;Beguenstigter/Zahlungspflichtiger;Kontonummer/IBAN;Betrag;Waehrung\n" + "\n".join([
        "DE11;05.03.24;05.03.24;Überweisung;Miete März;;Hausverwaltung;;-500,00;EUR", "DE11;05.03.24;05.03.24;Überweisung;Miete März;;Hausverwaltung;;-500,00;EUR", ";05.03.24;;x;;;;;1,00;", "DE22;31.13.24;;x;;;;;1,00;", "DE22;01.03.24;;x;;;;;abc;", ";;;;;;;;;", "DE22;01.03.24",
    ]) + "\n"
    paths = [
        _write(tmp_path / "a.csv", body, "utf-8-sig"), _write(tmp_path / "b.csv", body, "cp1252"), _write(tmp_path / "c.csv", body.replace(";", "\t")),
        _write(tmp_path / "d.csv", "Konto;Nichts\n1;2\n"), _write(tmp_path / "e.csv", " \n"),
    ]
    parsed = bank_csv.parse(bank_csv.read_files(spark, paths)).cache()
    by = {}
    for r in parsed.collect():
        by.setdefault(r.path[-5:], []).append((r.status, r.booking_date, str(r.amount), r.purpose, r.category, r.tx_hash))
    assert sorted(by["a.csv"], key=str) == sorted(by["b.csv"], key=str) == sorted(by["c.csv"], key=str)
    assert sorted(s for s, *_ in by["a.csv"]) == ["invalid", "invalid", "invalid", "ok", "ok", "skipped"]
    assert [x[0] for x in by["d.csv"]] == ["error"] and [x[0] for x in by["e.csv"]] == ["error"]
    known = parsed.where("FALSE").select("tx_hash")
    reports = {r.path[-5:]: r for r in bank_csv.report(parsed, known).collect()}
    assert (reports["a.csv"].imported, reports["a.csv"].duplicates, reports["a.csv"].invalid, reports["a.csv"].skipped) == (1, 1, 3, 1)
    fresh = writes.new_transactions(known, parsed.where("status = 'ok'"))
    assert fresh.count() == 1 and writes.new_transactions(fresh, parsed.where("status = 'ok'")).count() == 0  # twice adds nothing


def test_transfers_between_own_accounts(spark):
    accounts = spark.createDataFrame([("DE1",)], "iban string").select(scalars.iban_hash(F.col("iban")).alias("iban_hash"))
    rows = spark.createDataFrame([("de 1", "x"), ("DE2", "x"), (None, "x")], "counterparty_iban string, category string")
    assert {r.counterparty_iban: r.category for r in bank_csv.with_transfers(rows, accounts).collect()} == {"de 1": "uebertrag", "DE2": "x", None: "x"}


def test_replies(spark):
    rows = ['```json\n{"shop_name": "A {x}", "shop_type": "mall", "total_amount": "3,5", "items": [{"name": "Milch", "item_category": "zzz", "unit_price": null}, {"name": " "}]}\n``` bye }', "Sure! {\"shop_name\": \"B\"}", "no json", None]
    got = replies.receipts(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "n int, reply string")).orderBy("n").collect()
    assert [r.parsed for r in got] == [True, True, False, False]
    assert got[0].shop_name == "A {x}" and got[0].shop_type == "sonstiges" and str(got[0].total_amount) == "3.50" and [i.name for i in got[0]["items"]] == ["Milch"]
    tree = {"Bank": ["Auszug"], "Sonstiges": []}
    rows = ['{"category":"Bank","subcategory":"Auszug","tags":["A","a","b"],"confidence":0.9}', '{"category":"Zoo","subcategory":"x","confidence":"0.3"}', "?"]
    got = replies.classifications(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "n int, reply string"), tree).orderBy("n").collect()
    assert [(r.category, r.subcategory, r.tags, r.route) for r in got] == [("Bank", "Auszug", ["a", "b"], "filed"), ("Sonstiges", "", [], "review"), ("Sonstiges", "", [], "failed")]


def test_changes(spark, a):
    gone = writes.purge(a, spark.createDataFrame([(1,), (2,)], "id long"))  # 1 isn't in the trash
    assert ids(gone.documents) == [1, 3, 4, 5] and ids(gone.transactions) == [1, 2, 3, 4, 5, 7, 8, 9] and ids(gone.receipt_items) == [1]
    edited = writes.edit_documents(a, spark.createDataFrame([(1, "Rechnung")], "id long, category string"), ["Bank", "_csv_container"], ["Bank"])
    assert ids(edited.statements) == [11, 12] and ids(edited.receipts) == [2]
    accounts = writes.put_accounts(a.accounts, spark.createDataFrame([(9, "i1", ""), (9, "i9", "New")], "id long, iban_hash string, bank_name string"))
    assert {(r.id, r.bank_name) for r in accounts.collect()} == {(1, "Bank A"), (2, "Bank B"), (9, "New")}
    assert ids(writes.clean_duplicates(a.documents, "now").where("deleted_at = 'now'")) == [4]
    again = writes.put_statement(a, frame(spark, "statements", [("50", "1")], ["id", "doc_id"]), frame(spark, "transactions", [("90", "50", "t1"), ("91", "50", "t6")], ["id", "statement_id", "tx_hash"]))
    assert ids(again.transactions) == [6, 7, 8, 9, 90] and again.transactions.where("id = 90").first().category == "neu"
    assert {r.tx_hash: r.category for r in writes.recategorise(a, spark.createDataFrame([(2,)], "id long"), "z", "now").overrides.collect()} == {"t1": "neu", "t2": "z"}
    assert writes.delete_account(a, 1).transactions.where("account_id IS NULL").count() == 6
    r = writes.put_receipts(a, frame(spark, "receipts", [("7", "1", "5.00")], ["id", "doc_id", "total_amount"]), frame(spark, "receipt_items", [("8", "7", "x")], ["id", "receipt_id", "name"]))
    assert ids(r.receipts) == [2, 7] and ids(r.receipt_items) == [2, 8]


def test_tables_on_disk(spark, a, tmp_path):
    for name in SCHEMAS:
        getattr(a, name).write.parquet(f"{tmp_path}/{name}")
    assert ids(finance.live_transactions(open_archive(spark, str(tmp_path)))) == [1, 2, 3, 4, 5, 7, 8, 9]


def test_inbox_stream(spark, tmp_path):
    box, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    box.mkdir()
    provider = lambda prompt: '{"category": "Bank", "confidence": %s}' % ("0.9" if "sure" in prompt else "0.1")
    (box / "a.txt").write_text("sure text")
    (box / "b.txt").write_text("sure text")
    (box / "c.txt").write_text("other text")
    (box / "d.txt").write_text("  ")
    (box / "x.exe").write_text("no")

    def run():
        inbox.run_inbox(spark, str(box), table, state, {"Bank": []}, provider).awaitTermination()
        return {r.path[-5:]: (r.category, r.status) for r in spark.read.parquet(table).collect()}

    first = run()
    assert first == {"a.txt": ("Bank", "filed"), "b.txt": ("", "duplicate"), "c.txt": ("Bank", "review"), "d.txt": ("", "failed")}
    (box / "e.txt").write_text("sure text")
    assert run() == first | {"e.txt": ("Bank", "duplicate")}
    assert run() == first | {"e.txt": ("Bank", "duplicate")}


def test_windows_of_a_stream_equal_those_of_a_table(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = inbox.windowed_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.table("windows")) == key(inbox.windowed_counts(events))


def test_rules_give_allowed_values(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert {name for name, _ in rules.CATEGORIES} <= set(rules.TX_CATEGORIES) and {name for name, _ in rules.TX_TYPES} <= set(rules.TX_KINDS)
    assert one(rules.tx_type(F.lit("Buchung"), F.lit("Geldautomat 7"), F.lit(""))) == "bargeld"
    assert one(rules.category(F.lit("Apotheke am Markt"), F.lit(None).cast("string"))) == "gesundheit"


def test_replies_try_each_brace(spark):
    texts = ['use {x}: {"category": "Bank"} ok', '{"a": "}{", "b": {"c": 1}} {"d": 2}', "none", None, "{", "{{}", 'say "{" then {"e": [1, {"f": "\\"}"}]}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, reply string").select("i", replies.first_object(F.col("reply")).alias("o")).collect()
    assert {r.i: r.o for r in rows} == {0: '{"category": "Bank"}', 1: '{"a": "}{", "b": {"c": 1}}', 2: None, 3: None, 4: None, 5: "{}", 6: '{"e": [1, {"f": "\\"}"}]}'}
    reply = '{"shop_name": "x", "shop_type": "Cafe", "payment_method": "girocard", "total_amount": "3,5", "items": [{"name": "a", "item_category": "Tabak"}, {"name": "b"}, {"name": "c", "item_category": "zzz"}]}'
    (r,) = replies.receipts(spark.createDataFrame([(reply,)], "reply string")).collect()
    assert (r.shop_type, r.payment_method, [i.item_category for i in r["items"]]) == ("cafe", "girocard", ["tabak", "", "sonstiges"])


def test_orders(a, spark):
    """The order of rows, which comparisons with SQL don't see."""
    days = [r.booking_date for r in explorer.page(a, TransactionFilter()).collect()]
    assert [d for d in days if d] == sorted((d for d in days if d), reverse=True)
    for rows, at in ((explorer.months(a, TransactionFilter()), "month"), (finance.monthly(replace(a, transactions=a.transactions.where("id < 6"))), "month"), (library.by_month(a), "month")):
        found = [r[at] for r in rows.collect()]
        assert found == sorted(found) and len(found) > 1
    sizes = [abs(r.amount) for r in finance.largest(a).collect()]
    assert sizes == sorted(sizes, reverse=True)
    assert [r.tag for r in library.tags(a).collect()] == ["grün", "a"]
    counts = [r.n for r in library.counts_by(a, "category").collect()]
    assert counts == sorted(counts, reverse=True)
    assert [r.year for r in library.years(a).collect()] == ["2024", "2023"]


def test_feed_outlives_malformed_times(a):
    odd = replace(a, documents=a.documents.withColumn("created_at", F.when(F.col("id") == 4, "yesterday").otherwise(F.col("created_at"))))
    assert [r.id for r in library.feed(odd).collect()] == [5, 1, 4]


def test_accounts_without_a_hash_are_left_out(a, spark):
    new = spark.createDataFrame([("", "x"), (None, "y"), ("i1", ""), ("i9", "Neu")], "iban_hash string, bank_name string")
    for _ in range(2):
        got = {r.iban_hash: r.bank_name for r in writes.put_accounts(a.accounts, new).collect()}
        assert got == {"i1": "Bank A", "i2": "Bank B", "i9": "Neu"}


def test_search_folds_marks_of_all_latin_letters(a):
    marked = replace(a, documents=a.documents.withColumn("extracted_text", F.when(F.col("id") == 1, "Škoda aus Łódź, e\u0301te\u0301").otherwise(F.col("extracted_text"))))
    for query in ("skoda", "lodz", "Łódź", "ete", "éte"):
        assert ids(search.match(marked, query)) == [1], query


def test_ranked_by_hand(a, spark):
    import math

    rows = [(1, "alpha beta"), (4, "alpha alpha gamma"), (5, "delta delta delta delta")]
    index = spark.createDataFrame([(i, "extracted_text", p, w) for i, t in rows for p, w in enumerate(t.split())], "id long, field string, pos int, token string")
    got = {r.id: r.score for r in search.ranked(a, "alp", index=index).collect()}
    idf = max(1e-6, math.log((3 - 2 + 0.5) / (2 + 0.5)))
    want = {i: round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 3)), 6) for i, tf, n in ((1, 1, 2), (4, 2, 3))}
    assert got == want
    assert [r.id for r in search.ranked(a, "delta", index=index).collect()] == [5]


def test_replies_are_asked_for_again(spark, tmp_path):
    """The first call for a text fails, and one text always; the marks of calls are files, as executors are other processes."""

    def provider(text):
        import os

        mark = f"{tmp_path}/{text}"
        if text == "never" or not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("busy")
        return text.upper()

    asked = replies.ask(spark.createDataFrame([("a",), ("never",), ("b",)], "prompt string"), provider, tries=3, wait=0.01)
    assert {r.prompt: r.reply for r in asked.collect()} == {"a": "A", "never": "", "b": "B"}


def test_category_trees_and_languages(tmp_path):
    path = tmp_path / "categories.json"
    path.write_text('{"categories": ["Bank", {"name": "Rechnungen", "subcategories": ["Strom", {"name": "Gas"}]}]}')
    assert flows.category_tree(str(path)) == {"Bank": [], "Rechnungen": ["Strom", "Gas"]}
    pick = lambda *x: flows.pick_language(*x, ["de", "en"])
    assert [pick("en", "de"), pick("xx", "fr-FR, en-GB;q=0.8"), pick(None, None)] == ["en", "en", "de"]


def test_upload(spark, tmp_path):
    files = spark.createDataFrame([("a.pdf", b"1"), ("a.pdf", b"2"), ("b.exe", b"3"), ("c.TXT", b"4" * 1000)], "name string, content binary")
    (tmp_path / "a.pdf").write_bytes(b"old")
    for _ in range(2):
        got = flows.upload(files, str(tmp_path)).collect()
        assert [r.name for r in got if r.stored_as is None] == ["b.exe"]
        held = {p.name: p.read_bytes() for p in tmp_path.iterdir() if not p.name.startswith(".")}
        assert sorted(held.values()) == sorted([b"old", b"1", b"2", b"4" * 1000]) and held["a.pdf"] == b"old" and held["c.TXT"] == b"4" * 1000


def test_numbers_of_requests():
    assert [explorer.number(x) for x in ("1,5", "2.5", "", " ", None, "x", "inf", "nan")] == [1.5, 2.5, None, None, None, None, None, None]
    assert [explorer.integer(x) for x in ("7", 7, "", None, "x", "1.5")] == [7, 7, None, None, None, None]
