"""Bank CSV files: decoding, dialect, header names, rows with a status, and the report."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import replace
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.functions import rules
from quillstack.functions.scalars import iban_hash, normalise_date, normalise_iban, parse_amount, tx_hash
from quillstack.operators import writes
from quillstack.plans.archive import Archive, scratch

#: The columns that are read, with the spellings of their headers after folding (fixed values).
COLUMNS = {
    "account": ["auftragskonto", "konto", "iban"],
    "booking_date": ["buchungstag", "buchungsdatum"],
    "value_date": ["valutadatum", "valuta", "wertstellung"],
    "booking_text": ["buchungstext"],
    "purpose": ["verwendungszweck"],
    "creditor_id": ["glaeubigerid", "glaubigerid", "glaeubiger id"],
    "counterparty": ["beguenstigterzahlungspflichtiger", "begunstigterzahlungspflichtiger", "auftraggeberempfaenger", "name zahlungsbeteiligter"],
    "counterparty_iban": ["kontonummeriban", "kontonummer", "iban zahlungsbeteiligter"],
    "amount": ["betrag"],
    "currency": ["waehrung", "wahrung"],
    "info": ["info"],
}
REQUIRED = ("account", "booking_date", "amount")
SEPARATORS = (";", ",", "\t")


def decode(content: bytes) -> str:
    """Text of a file: UTF-8 with or without a mark, else Windows-1252, else Latin-1."""
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            pass
    return content.decode("latin-1")


def separator(text: str) -> str:
    """The most frequent separator of the first line with anything in it; a semicolon where there is none."""
    first = next((x for x in text.splitlines() if x.strip()), "")
    best = max(SEPARATORS, key=first.count)
    return best if first.count(best) else ";"


def key_of(header: str) -> str | None:
    """The column that a header names."""
    plain = header.strip().strip('"').lower()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        plain = plain.replace(a, b)
    plain = "".join(c for c in plain if c.isalnum() or c == " ").strip()
    return next((k for k, names in COLUMNS.items() if plain in names or plain.replace(" ", "") in [n.replace(" ", "") for n in names]), None)


#: Of a line of each separator: whether its quoted fields end in it. A quote counts where a field begins, and doubled inside.
_ENDS = {s: re.compile(rb'(?:"(?:[^"]|"")*+"[^%(s)s]*+|[^"%(s)s][^%(s)s]*+|)(?:%(s)s(?:"(?:[^"]|"")*+"[^%(s)s]*+|[^"%(s)s][^%(s)s]*+|))*+\Z' % {b"s": re.escape(s.encode())}) for s in SEPARATORS}
#: Lines at the start of a file of which the first with a header is sought in one task; a header is there or nowhere.
_HEAD = 1000


def _open_after(line: bytes, was_open: bool, sep: str) -> bool:
    """Whether a quoted field goes on after a line."""
    return was_open if b'"' not in line else not _ENDS[sep].match(b'"' + line if was_open else line)


def _by_block(frames: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """The lines of each block of a file, one block after the other, with what else its rows have."""
    rows = (r for f in frames for r in zip(*(f[c] for c in (*columns, "value"))))
    for key, lines in groupby(rows, key=lambda r: r[:-1]):
        yield key, (bytes(r[-1]) for r in lines)


def _header(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the first lines of each file, which lie together: separator, the header's cells and the record that it is, or none."""
    for (path,), rows in _by_block(frames, "path"):
        lines = list(islice(rows, _HEAD))
        sep = separator("\n".join(x.decode("latin-1") for x in lines))
        texts = [x.decode("utf-8-sig" if i == 0 else "utf-8", "replace") + "\n" for i, x in enumerate(lines)]
        raw = [x.decode("latin-1") + "\n" for x in lines]
        found = next(((i, r) for i, r in enumerate(csv.reader(texts, delimiter=sep)) if any(x.strip() for x in r)), None)
        # a name with an umlaut is read in whichever encoding it has
        other = next((r for r in csv.reader(raw, delimiter=sep) if any(x.strip() for x in r)), [])
        keys = [key_of(x) or (key_of(other[j]) if j < len(other) else None) for j, x in enumerate(found[1])] if found else []
        yield pd.DataFrame([[path, sep, keys, found[0] if found else -1]], columns=["path", "sep", "keys", "header"])


def _states(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each block: for either state that it can begin in, the records that begin in it and the state that it ends in; and the encodings that its lines are."""
    for (path, block, sep), lines in _by_block(frames, "path", "block", "sep"):
        counts, state, utf8, cp1252 = [0, 0], [False, True], True, True
        for line in lines:
            for i in (0, 1):
                counts[i] += not state[i]
                state[i] = _open_after(line, state[i], sep)
            if not line.isascii():
                utf8, cp1252 = utf8 and _is(line, "utf-8"), cp1252 and _is(line, "cp1252")
        yield pd.DataFrame([[path, block, *counts, *state, utf8, cp1252]], columns=["path", "block", "n_closed", "n_open", "closed_to", "open_to", "utf8", "cp1252"])


def _is(line: bytes, encoding: str) -> bool:
    try:
        line.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _begin(blocks: pd.DataFrame) -> pd.DataFrame:
    """Of the blocks of one file: the state that each begins in, the records before it, and the file's encoding."""
    blocks = blocks.sort_values("block")
    encoding = "utf-8" if blocks["utf8"].all() else "cp1252" if blocks["cp1252"].all() else "latin-1"
    rows, before, is_open = [], 0, False
    for r in blocks.itertuples():
        rows.append([r.path, r.block, is_open, before, encoding])
        before += r.n_open if is_open else r.n_closed
        is_open = r.open_to if is_open else r.closed_to
    return pd.DataFrame(rows, columns=["path", "block", "is_open", "before", "encoding"])


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The records of blocks as text columns. Of a record that lies in several blocks, its pieces: `part` is then the block, and `raw` the text."""
    names = ["path", "line_no", *COLUMNS, "part", "raw"]
    for (path, block, sep, keys, header, is_open, before, encoding), lines in _by_block(frames, "path", "block", "sep", "keys", "header", "is_open", "before", "encoding"):
        keys = list(keys.split("|"))
        rows: list[list] = []
        pending: list[str] = []
        piece = lambda number: [path, number - header, *[None] * len(COLUMNS), block, "".join(pending)]  # noqa: E731, B023
        record, leading = before - is_open, is_open  # the record that the next line belongs to
        for n, line in enumerate(lines):
            is_open = _open_after(line, is_open, sep)
            pending.append((line[3:] if block == n == 0 and line.startswith(b"\xef\xbb\xbf") and encoding == "utf-8" else line).decode(encoding) + "\n")
            if is_open:
                continue
            if leading:
                rows.append(piece(record))
            elif record > header:
                rows += _row(path, record - header, keys, "".join(pending), sep)
            leading, pending, record = False, [], record + 1
            if len(rows) >= 10_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if pending:
            rows.append(piece(record))
        if rows:
            yield pd.DataFrame(rows, columns=names)


def _row(path: str, number: int, keys: list[str], text: str, sep: str) -> list[list]:
    """A record as a row, or none if all of it is blank."""
    cells = next(csv.reader(io.StringIO(text), delimiter=sep), [])
    if not any(x.strip() for x in cells):
        return []
    found = {k: v.strip() for k, v in zip(keys, cells) if k}
    return [[path, number, *(found.get(k, "") for k in COLUMNS), None, None]]


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records that were put together from their pieces."""
    for f in frames:
        rows = [r for x in f.itertuples() if x.line_no > 0 for r in _row(x.path, x.line_no, x.keys.split("|"), x.raw, x.sep)]
        yield pd.DataFrame(rows, columns=["path", "line_no", *COLUMNS, "part", "raw"])


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of bank files as text: path, line_no (of the records after the header), COLUMNS and problem.

    Spark's reader gives lines, so a file is read by a task for each of its blocks, whatever its size. A first pass says
    of each block in what state (inside a quoted field or not) it leaves a reader that comes in either state, how many
    records begin in it, and which encodings its bytes are; from that follow, for each block, the state and the record
    that it begins with. A second pass reads the records. One that lies in several blocks is put together from its pieces.

    A file without a header within its first lines, or without a column that is needed, gives one row with the problem.
    A file of no bytes gives no row, as Spark's reader passes over it.
    """
    text = spark.read.option("lineSep", "\n").text(paths)
    where = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    lines = text.select(*where, F.col("value").cast("binary").alias("value"))
    # rows of a block come in the file's order, in one partition
    heads = lines.where("block = 0").select("path", F.substring("value", 1, 100_000).alias("value"))
    files = heads.mapInPandas(_header, "path string, sep string, keys array<string>, header int")
    folder = scratch(spark)
    files.write.parquet(folder)
    files = spark.read.parquet(folder)  # a row a file
    lacking = F.array_except(F.array(*map(F.lit, REQUIRED)), F.col("keys"))
    problem = F.when(F.col("header") < 0, "empty file").when(F.size(lacking) > 0, F.concat(F.lit("missing columns: "), F.array_join(lacking, ", ")))
    files = files.withColumn("problem", problem)
    good = files.where("problem IS NULL").select("path", "sep", F.array_join(F.transform("keys", lambda k: F.coalesce(k, F.lit(""))), "|").alias("keys"), "header")
    # files and blocks are few beside their lines
    states = lines.join(F.broadcast(good.select("path", "sep")), "path").mapInPandas(_states, "path string, block long, n_closed long, n_open long, closed_to boolean, open_to boolean, utf8 boolean, cp1252 boolean")
    begin = states.groupBy("path").applyInPandas(_begin, "path string, block long, is_open boolean, before long, encoding string")
    fields = ", ".join(f"{c} string" for c in COLUMNS)
    schema = f"path string, line_no int, {fields}, part long, raw string"
    rows = lines.join(F.broadcast(begin.join(good, "path")), ["path", "block"]).select("path", "block", "sep", "keys", "header", "is_open", "before", "encoding", "value").mapInPandas(_records, schema)
    folder = scratch(spark)
    rows.write.parquet(folder)
    rows = spark.read.schema(schema).parquet(folder)
    pieces = rows.where("part IS NOT NULL").groupBy("path", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "raw"))), lambda p: p["raw"]), "").alias("raw"))
    joined = pieces.join(F.broadcast(good), "path").select("path", "line_no", "raw", "keys", "sep").mapInPandas(_joined, schema)
    out = ["path", "line_no", *COLUMNS]
    bad = files.where("problem IS NOT NULL").select("path", F.lit(0).alias("line_no"), *(F.lit(None).cast("string").alias(c) for c in COLUMNS), "problem")
    none = F.lit(None).cast("string").alias("problem")
    return rows.where("part IS NULL").select(*out, none).unionByName(joined.select(*out, none)).unionByName(bad)


def parse(rows: DataFrame) -> DataFrame:
    """Rows as bookings, with `status`: ok, invalid (date or amount), skipped (no account) or error (the file's).

    Everything is a Column expression, so rows that come from elsewhere are parsed the same way.
    """
    # what others are made of is worked out once, in a step of its own
    made = rows.select(
        "path", "line_no", "problem", "booking_text", normalise_iban(F.col("account")).alias("iban"), normalise_date(F.col("booking_date")).alias("booking_date"), normalise_date(F.col("value_date")).alias("value_date"),
        parse_amount(F.col("amount")).alias("amount"), F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit("EUR")).alias("currency"), F.substring("counterparty", 1, 200).alias("counterparty"),
        normalise_iban(F.col("counterparty_iban")).alias("counterparty_iban"), F.substring("purpose", 1, 500).alias("purpose"),
    )
    no_value = F.col("booking_date").isNull() | F.col("amount").isNull()
    status: Column = F.when(F.col("problem").isNotNull(), "error").when(F.coalesce("iban", F.lit("")) == "", "skipped").when(no_value, "invalid").otherwise("ok")
    digest = tx_hash(F.col("iban"), F.col("booking_date"), F.col("amount"), F.col("counterparty"), F.col("purpose"))
    return made.withColumn("status", status).select(
        "path", "line_no", "status", "iban", F.when(F.col("iban") != "", F.sha2("iban", 256)).alias("iban_hash"), F.substring("iban", -4, 4).alias("iban_last4"), "booking_date", "value_date", "amount", "currency",
        "counterparty", "counterparty_iban", "purpose", rules.tx_type(F.col("booking_text"), F.col("counterparty"), F.col("purpose")).alias("tx_type"),
        rules.category(F.col("counterparty"), F.col("purpose")).alias("category"), F.when(F.col("status") == "ok", digest).alias("tx_hash"),
    )


def with_transfers(bookings: DataFrame, accounts: DataFrame) -> DataFrame:
    """Bookings whose other side is an account of our own become transfers."""
    own = accounts.select(F.col("iban_hash").alias("_own")).where("_own IS NOT NULL").distinct()
    # bookings without another side match nothing, and are dealt out by what they are, not to one task
    keyed = bookings.withColumn("_other", F.coalesce(iban_hash(F.col("counterparty_iban")), F.concat(F.lit("-"), F.xxhash64(*bookings.columns).cast("string"))))
    joined = keyed.join(own, F.col("_other") == F.col("_own"), "left")
    return joined.withColumn("category", F.when(F.col("_own").isNotNull(), "uebertrag").otherwise(F.col("category"))).drop("_own", "_other")


def report(bookings: DataFrame, known: DataFrame) -> DataFrame:
    """One row a file: rows, imported, duplicates (in the file or known already), invalid, skipped, errors and the period."""
    ok = bookings.where("status = 'ok'").groupBy("path", "tx_hash").agg(F.count("*").alias("n"), F.min("booking_date").alias("first"), F.max("booking_date").alias("last"))
    stored = ok.join(known.select("tx_hash", F.lit(1).alias("old")).distinct(), "tx_hash", "left")
    new = F.when(F.col("old").isNull(), 1).otherwise(0)
    imported = stored.groupBy("path").agg(F.sum(new).alias("imported"), F.sum(F.col("n") - new).alias("duplicates"), F.min("first").alias("first_date"), F.max("last").alias("last_date"))
    when = lambda s: F.count(F.when(F.col("status") == s, 1))
    counts = bookings.groupBy("path").agg((F.count("*") - when("error")).alias("rows"), when("invalid").alias("invalid"), when("skipped").alias("skipped"), when("error").alias("errors"))
    return counts.join(imported, "path", "left").na.fill({"imported": 0, "duplicates": 0})


def import_files(a: Archive, paths: list[str], now: str, bank_name: str = "Sparkasse", known_as: str = "") -> tuple[Archive, DataFrame]:
    """(the archive afterwards, one report row a file): files are read, their accounts put, and bookings that aren't stored appended.

    Account ids that are new follow the greatest by the order of their hashes; bookings' ids come from their hashes. A
    booking belongs to no statement until one is read. Reading the same file again changes nothing.
    """
    spark = a.accounts.sparkSession
    folder = scratch(spark)
    parse(read_files(spark, paths)).write.parquet(folder)  # files are read once
    bookings = spark.read.parquet(folder)
    ok = bookings.where("status = 'ok'")
    seen = ok.groupBy("iban_hash").agg(F.min("iban").alias("iban"), F.min("iban_last4").alias("iban_last4"), F.min("currency").alias("currency"))
    last = a.accounts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"), F.lit(1).alias("k"))
    # the accounts of the files: few
    place = F.row_number().over(W.partitionBy("k").orderBy("iban_hash"))
    fresh = seen.join(a.accounts.select("iban_hash"), "iban_hash", "left_anti").withColumn("k", F.lit(1)).withColumn("_place", place).join(last, "k")
    ids = fresh.select("iban_hash", (F.col("last") + F.col("_place")).cast("long").alias("id"))
    new = seen.join(ids, "iban_hash", "left").withColumns({"bank_name": F.lit(bank_name), "account_holder": F.lit(known_as), "created_at": F.lit(now)})
    accounts = writes.put_accounts(a.accounts, new.select(*[c for c in a.accounts.columns if c in new.columns]))
    owned = with_transfers(ok, accounts).join(accounts.select("iban_hash", F.col("id").alias("account_id")), "iban_hash")
    rows = owned.withColumn("value_date", F.coalesce("value_date", "booking_date")).withColumn("id", F.xxhash64("tx_hash").bitwiseAND(F.lit((1 << 62) - 1)))
    keep = [c for c in a.transactions.columns if c in rows.columns]
    appended = writes.new_transactions(a.transactions, rows.select(*dict.fromkeys([*keep, "path", "line_no"])))
    after = replace(a, accounts=accounts, transactions=a.transactions.unionByName(appended.select(*keep), True))
    return after, report(bookings, a.transactions)
