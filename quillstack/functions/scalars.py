"""Scalar functions of the archive, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRANSFER, OTHER = "uebertrag", "sonstiges"


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z alone; umlauts stay as they are."""
    return F.translate(c, _UPPER, _LOWER)


def ascii_contains(c: Column, part: str) -> Column:
    """Whether part stands in c, ASCII case aside. No character of part is a wildcard."""
    return F.contains(ascii_lower(c), F.lit("".join(x.lower() if x in _UPPER else x for x in part)))


def blank_to(c: Column, label: str) -> Column:
    """label for null and for the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(label))


def real_date(c: Column) -> Column:
    """The date of text in ISO form, null for anything else, such as a 31st of February."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def normalise_date(c: Column) -> Column:
    """ISO text of a date written as ISO, with slashes, or as day.month.year; null if it is none of these.

    Two-digit years up to 69 are 20xx, the others 19xx. Months run to 12 and days to 31, whatever the month.
    """
    t = F.trim(c)
    iso, dotted = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T ].*)?$", r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})$"
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    short = F.when(part(dotted, 3).try_cast("int") < 70, F.concat(F.lit("20"), part(dotted, 3))).otherwise(F.concat(F.lit("19"), part(dotted, 3)))
    year = F.when(t.rlike(iso), part(iso, 1)).when(F.length(part(dotted, 3)) == 2, short).otherwise(part(dotted, 3))
    month = F.when(t.rlike(iso), part(iso, 2)).otherwise(part(dotted, 2))
    day = F.when(t.rlike(iso), part(iso, 3)).otherwise(part(dotted, 1))
    fits = month.try_cast("int").between(1, 12) & day.try_cast("int").between(1, 31) & year.try_cast("int").between(1900, 2199)
    return F.when((t.rlike(iso) | t.rlike(dotted)) & fits, F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def normalise_iban(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))


def iban_hash(c: Column) -> Column:
    """The digest of a normalised IBAN, null where there is none."""
    return F.when(normalise_iban(c) != "", F.sha2(normalise_iban(c), 256))


def parse_amount(c: Column) -> Column:
    """Money from text with a decimal comma and dots for thousands, or with a decimal point; null if it is no number."""
    t = F.regexp_replace(c, r"[\s €]|EUR", "")
    plain = F.when(F.contains(t, F.lit(",")), F.translate(t, ",.", ".")).otherwise(t)
    return F.when(plain.rlike(r"^[+-]?\d+(?:\.\d*)?$|^[+-]?\.\d+$"), plain.try_cast("decimal(38,10)").try_cast("decimal(18,2)"))


def tx_hash(account: Column, booking_date: Column, amount: Column, counterparty: Column, purpose: Column) -> Column:
    """One digest for a booking, however it came in: null parts count as empty, amounts have two decimals."""
    parts = [account, booking_date, amount.cast("decimal(18,2)").cast("string"), counterparty, purpose]
    return F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def statement_tx_hash(account_hash: Column, booking_date: Column, amount: Column, purpose: Column) -> Column:
    """The digest of a booking entered by hand or read from a statement: the account's hash, date, amount and purpose."""
    parts = [F.coalesce(F.nullif(account_hash, F.lit("")), F.lit("no-iban")), F.coalesce(booking_date, F.lit("")), amount.cast("decimal(18,2)").cast("string"), F.coalesce(purpose, F.lit(""))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def slug(c: Column, longest: int = 60) -> Column:
    """Lower-case ASCII words joined by hyphens; umlauts are written out."""
    t = F.lower(c)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.translate(t, "áàâãåéèêëíìîïóòôõúùûñç", "aaaaaeeeeiiiioooouuunc")
    return _stripped(F.substring(_stripped(F.regexp_replace(t, "[^a-z0-9]+", "-")), 1, longest))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, "^-+|-+$", "")


def file_name(date: Column, category: Column, sender: Column, subject: Column, longest: int = 120) -> Column:
    """date-category-sender-subject.pdf in slugs; parts that are missing leave no gap."""
    parts = [F.nullif(_stripped(slug(p)), F.lit("")) for p in (category, sender, subject)]
    stem = F.concat_ws("-", F.nullif(date, F.lit("")), *parts)
    return F.concat(_stripped(F.substring(F.regexp_replace(stem, "-{2,}", "-"), 1, longest)), F.lit(".pdf"))


def target_path(date: Column, category: Column, subcategory: Column) -> Column:
    """year/category/subcategory, without a subcategory where there is none."""
    return F.concat_ws("/", blank_to(F.substring(date, 1, 4), "unknown"), category, F.nullif(subcategory, F.lit("")))


def clamp(c: Column, allowed: list[str], default: str) -> Column:
    """c if it is one of the allowed values, else the default."""
    return F.when(c.isin(allowed), c).otherwise(F.lit(default))


def to_number(c: Column) -> Column:
    """A number from text, null on failure; not-a-number and infinity fail."""
    x = F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def decode_tags(c: Column) -> Column:
    """An array from JSON text; anything else gives an empty one."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def text_too_short(c: Column, least: int = 100) -> Column:
    """Whether a page needs recognition: under 100 characters of text."""
    return F.length(F.trim(F.coalesce(c, F.lit("")))) < least


def narrow_page(width: Column, height: Column) -> Column:
    """Whether a page has the shape of a till receipt."""
    return F.coalesce(height / F.nullif(width, F.lit(0)) >= 2.0, F.lit(False))


def display_size(c: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB; a dash for none."""
    step = lambda k, unit: F.format_string(f"%.1f {unit}", c / float(1024**k))
    sized = F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1024**2, step(1, "KB")).when(c < 1024**3, step(2, "MB")).when(c < 1024**4, step(3, "GB")).otherwise(step(4, "TB"))
    return F.when(F.coalesce(c, F.lit(0)) == 0, "–").otherwise(sized)


#: Dollars to euros, as shown (a fixed value).
EUR_PER_USD = 0.93


def display_eur(usd: Column) -> Column:
    return F.format_string("%.2f €", usd * EUR_PER_USD)


def display_usd(usd: Column) -> Column:
    """Dollars with two places, small amounts with four."""
    return F.when(usd < 0.01, F.format_string("$%.4f", usd)).otherwise(F.format_string("$%.2f", usd))


def display_age(moment: Column, now: Column) -> Column:
    """How long ago a moment was, in the largest whole unit: s (1 at least), m, h or d. Empty for none."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(moment.try_cast("timestamp"))
    whole = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    aged = F.when(seconds < 60, F.concat(F.greatest(seconds, F.lit(1)).cast("string"), F.lit("s"))).when(seconds < 3600, whole(60, "m")).when(seconds < 86400, whole(3600, "h")).otherwise(whole(86400, "d"))
    return F.coalesce(aged, F.lit(""))


#: (provider, model prefix, dollars per million input and output tokens), the first match wins. Public list prices (fixed values).
PRICES = [
    ("anthropic", "claude-haiku-4-5", 1.0, 5.0),
    ("anthropic", "claude-sonnet-4-6", 3.0, 15.0),
    ("anthropic", "claude-opus-4-7", 15.0, 75.0),
    ("anthropic", "claude-3-5-haiku", 0.80, 4.0),
    ("anthropic", "claude-3-5-sonnet", 3.0, 15.0),
    ("openai", "gpt-4o-mini", 0.15, 0.60),
    ("openai", "gpt-4o", 2.50, 10.0),
    ("openai", "gpt-4.1-mini", 0.40, 1.60),
    ("openai", "gpt-4.1", 2.0, 8.0),
    ("openai", "o4-mini", 1.10, 4.40),
    ("gemini", "gemini-1.5-flash", 0.075, 0.30),
    ("gemini", "gemini-1.5-pro", 1.25, 5.0),
    ("gemini", "gemini-2.0-flash", 0.10, 0.40),
    ("gemini", "gemini-2.5-flash", 0.075, 0.30),
    ("gemini", "gemini-2.5-pro", 1.25, 5.0),
]
#: What cached tokens cost, as a multiple of input tokens, by provider: written, read (fixed values).
CACHE = {"anthropic": (1.25, 0.1), "openai": (1.0, 0.5)}


def pricing(spark: SparkSession) -> DataFrame:
    """PRICES as a table: provider, model, input_per_mtok, output_per_mtok, place. A model is priced by the row of least place that its name begins with."""
    return spark.createDataFrame([(*row, i) for i, row in enumerate(PRICES)], "provider string, model string, input_per_mtok double, output_per_mtok double, place int")


def priced(calls: DataFrame, model: str = "model") -> DataFrame:
    """calls with provider, input_per_mtok, output_per_mtok by the first row of PRICES that its model's name begins with; null without one."""
    table = pricing(calls.sparkSession).withColumnRenamed("model", "_prefix")
    first = calls.select(model).distinct().join(F.broadcast(table), F.startswith(F.col(model), F.col("_prefix")))  # the table is a constant
    first = first.groupBy(model).agg(F.min_by(F.struct("provider", "input_per_mtok", "output_per_mtok"), "place").alias("_p"))
    return calls.join(first, model, "left").select(*calls.columns, "_p.provider", "_p.input_per_mtok", "_p.output_per_mtok")


def token_cost(provider: Column, model: Column, tokens_in: Column, tokens_out: Column, written: Column, read: Column, prices: list[tuple] = PRICES) -> Column:
    """Dollars for a call. The first row of the provider whose prefix starts the model's name prices it; without one, as for local models, it is 0."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    out = None
    for name, prefix, price_in, price_out in prices:
        w, r = CACHE.get(name, (0.0, 0.0))
        cost = (zero(tokens_in) * price_in + zero(tokens_out) * price_out + zero(written) * price_in * w + zero(read) * price_in * r) / 1e6
        test = (provider == name) & F.startswith(model, F.lit(prefix))
        out = F.when(test, cost) if out is None else out.when(test, cost)
    return out.otherwise(0.0)


def date_preset(today: Column, name: str) -> tuple[Column, Column]:
    """(first, last) day of a named period about a date: this or last month or year, or the last 30 or 90 days."""
    if name in ("this_month", "last_month"):
        first = F.trunc(F.add_months(today, 0 if name == "this_month" else -1), "month")
        return first, F.last_day(first)
    if name in ("this_year", "last_year"):
        first = F.trunc(F.add_months(today, 0 if name == "this_year" else -12), "year")
        return first, F.date_sub(F.add_months(first, 12), 1)
    if name in ("last_30_days", "last_90_days"):
        return F.date_sub(today, int(name.split("_")[1]) - 1), today
    raise ValueError(f"unknown period {name!r}")


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))
