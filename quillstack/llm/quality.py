"""Quality rules: plain limits, then robust multivariate outliers of each language and source.

Each text gives a vector of transformed statistics, and the variance that counting alone gives each of them in a text of
its length. For each language and source the centre and scatter of the densest half are estimated by minimum covariance
determinant (Rousseeuw and Van Driessen, 1999): concentration steps, each of which keeps the half nearest by Mahalanobis
distance and lowers the determinant, from three deterministic starts (as Hubert, Rousseeuw and Verdonck, 2012). After two
steps the start with the least determinant goes on until it settles. A reweighting step follows. Documents beyond a far
quantile of chi-square are rejected.

The same is done for each language and for the corpus, and estimates of few documents are shrunk towards the next wider
one, so that there is no size at which the rule changes.

Everything is built-in Spark expressions. Quantiles come from counts in bins, and moments from sums, both combined before
the shuffle, so a source with a third of the rows is no heavier than another; texts are measured once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.llm.common import documents, stored, words
from quillstack.llm.spans import let, long

SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\x0b\x0c\r"
_CAPITALS = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]) + "!"
WINDOW = 8
#: The limits of the base: fewer words, or a larger share of them in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 20, 0.30

FEATURES = ("ln_word_length", "root_symbols", "root_dup_lines", "root_repeats", "root_capitals")
NOISE = tuple(f"{f}_noise" for f in FEATURES)
P = len(FEATURES)
#: The share of a group that the estimate rests on, the quantile kept in reweighting and that of rejection.
HALF, REWEIGHT, REJECT = 0.5, 0.975, 1 - 1e-6
#: Starts, steps of each, steps at most, and the change of the determinant's logarithm under which a group stops (cuts move by a bin).
STARTS, FIRST_STEPS, STEPS, SETTLED = 3, 2, 12, 0.03
#: An estimate counts as many documents as it has, the next wider one as so many.
PRIOR = 50
#: Groups whose estimates are broadcast, of some 300 bytes each; beyond, they are joined like any table.
BROADCAST_ROWS = 50_000
#: Bins of one unit of a statistic, and of a doubling of the squared distance.
BINS, BINS_OF_TWO = 256, 32


def chi2_cdf(x: float, k: int) -> float:
    """The regularised lower incomplete gamma function at (k/2, x/2), by its series."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while abs(term) > 1e-16 * total:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 1e-9, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return (low + high) / 2


def _consistency(share: float) -> float:
    """What the scatter of the inner share of normal data is to be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def _covered(places: Column) -> Column:
    """How many words the windows at these sorted places cover."""
    step = lambda s, p: F.struct((s["n"] + p + WINDOW - F.greatest(p, s["end"])).alias("n"), (p + WINDOW).alias("end"))
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda s: s["n"].cast("long"))


def _repeat_words(tokens: Column) -> Column:
    """Words in windows of eight that the text has twice or more."""

    def places(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda p, i: F.coalesce(F.get(pairs, i - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(pairs, i + 1)["h"] == p["h"], F.lit(False)))
        return F.array_sort(F.transform(twice, lambda p: p["at"]))

    def count(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), long(0)).otherwise(let(pairs, lambda p: _covered(places(p))))

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
    return let(hashes, lambda h: F.when(F.size(h) < WINDOW, long(0)).otherwise(let(windows(h), count)))


def with_statistics(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, the group, the FEATURES and their NOISE.

    The root of a rate of things, each of which counts u, among n has the variance u / 4n by counting alone; of the
    logarithm of a mean of n lengths that spread by half their mean it is 1 / 4n. A column of one of these names is replaced. A null text has no words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    length = F.length(body).cast("long")
    without = lambda chars: F.length(F.translate(body, chars, "")).cast("long")
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.translate(x, _WHITE, "")) > 0)
    tokens = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))
    measured = F.struct(
        let(words(body), tokens).alias("w"),
        without(_WHITE).alias("word_chars"),
        (length - without(SYMBOLS)).alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        (length - without(_CAPITALS)).alias("capitals"),
    )
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_lang", "_source", *FEATURES, *NOISE]
    rest = [c for c in docs.columns if c not in own]
    df = docs.withColumn("_m", measured)
    m = F.col("_m")
    n, chars, n_lines = F.greatest(m["w"]["n_words"], long(1)), F.greatest(m["word_chars"], long(1)), F.greatest(m["lines"]["n"], long(1))
    noise = (1 / (4 * n), 1 / (4 * n), 1 / (4 * n_lines), 2 * WINDOW / (4 * n), 1 / (4 * chars))
    return df.select(
        *rest, m["w"]["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["lines"]["dup"].alias("n_dup_lines"), m["w"]["n_repeat_words"].alias("n_repeat_words"),
        ((m["w"]["n_words"] < LEAST_WORDS) | (100 * m["w"]["n_repeat_words"] > round(100 * MOST_REPEATED) * m["w"]["n_words"])).alias("base_failed"),
        F.coalesce(F.col(lang).cast("string"), F.lit("\0")).alias("_lang"), F.coalesce(F.col(source).cast("string"), F.lit("\0")).alias("_source"),
        F.ln(chars / n).alias("ln_word_length"), F.sqrt(m["n_symbols"] / n).alias("root_symbols"),
        F.sqrt(m["lines"]["dup"] / n_lines).alias("root_dup_lines"),
        F.sqrt(m["w"]["n_repeat_words"] / n).alias("root_repeats"), F.sqrt(m["capitals"] / chars).alias("root_capitals"),
        *(v.alias(name) for v, name in zip(noise, NOISE)),
    )


_MEANS = [f"mean_{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_SCATTER = [f"c_{i}_{j}" for i, j in _PAIRS]


def _small(table: DataFrame) -> DataFrame:
    """Broadcast what is proven small; else let Spark join it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _eliminated(state: Column, k: int) -> Column:
    """The state (a_i_j, r_i, d, log_det) after elimination of variable k: d grows by the square of what is left of r_k over its variance."""
    pivot = F.greatest(state[f"a_{k}_{k}"], F.lit(1e-12))
    left = range(k + 1, P)
    parts = [(state[f"a_{i}_{j}"] - state[f"a_{i}_{k}"] * state[f"a_{j}_{k}"] / pivot).alias(f"a_{i}_{j}") for i in left for j in left if j <= i]
    parts += [(state[f"r_{i}"] - state[f"a_{i}_{k}"] * state[f"r_{k}"] / pivot).alias(f"r_{i}") for i in left]
    return F.struct(*parts, (state["d"] + state[f"r_{k}"] * state[f"r_{k}"] / pivot).alias("d"), (state["log_det"] + F.ln(pivot)).alias("log_det"))


def _solved(noise: list[Column], r: list[Column]) -> Column:
    """(d, log_det) of deviations r in the scatter c_i_j with noise added to its diagonal: d is r' (c + noise)^-1 r."""
    start = [((F.col(f"c_{i}_{j}") + noise[i]) if i == j else F.col(f"c_{i}_{j}")).alias(f"a_{i}_{j}") for i, j in _PAIRS]
    state = F.struct(*start, *(x.alias(f"r_{i}") for i, x in enumerate(r)), F.lit(0.0).alias("d"), F.lit(0.0).alias("log_det"))

    def after(state: Column, k: int) -> Column:
        return let(_eliminated(state, k), lambda s: after(s, k + 1)) if k < P - 1 else _eliminated(state, k)

    return let(state, lambda s: after(s, 0))


def _with_distance(df: DataFrame) -> DataFrame:
    """df (FEATURES, NOISE and an estimate) with `d`, the squared Mahalanobis distance in the scatter plus the noise."""
    return df.withColumn("d", _solved([F.col(v) for v in NOISE], [F.col(f) - F.col(f"mean_{i}") for i, f in enumerate(FEATURES)])["d"])


def _with_log_det(estimate: DataFrame) -> DataFrame:
    """estimate with `log_det`, of the scatter plus the mean noise of the group."""
    return estimate.withColumn("log_det", _solved([F.col(f"noise_{i}") for i in range(P)], [F.lit(0.0)] * P)["log_det"])


def _cut(bins: DataFrame, by: list[str], at: str) -> DataFrame:
    """Of counts n of bins `at`: for each group, the bin in which the half is reached, as `cut`, and the share up to it."""
    up_to = F.sum("n").over(W.partitionBy(*by).orderBy(at))  # a group has as many rows as it has bins
    all_ = F.sum("n").over(W.partitionBy(*by))
    reached = bins.select(*by, at, (up_to / all_).alias("share")).where(F.col("share") >= HALF)
    return reached.groupBy(*by).agg(F.min(F.struct(at, "share")).alias("m")).select(*by, F.col(f"m.{at}").alias("cut"), F.col("m.share").alias("share"))


def _wide(df: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """df (…, feature, value) with a column for each feature."""
    return df.groupBy(*by).agg(*(F.max(F.when(F.col("feature") == i, F.col(value))).alias(f"{name}_{i}") for i in range(P)))


def _middles(rows: DataFrame) -> DataFrame:
    """(_key, med_i, mad_i), medians and median deviations to the width of a bin."""
    x = F.array(*(F.floor(F.col(f) * BINS).cast("int") for f in FEATURES))
    bins = stored(rows.select("_key", F.posexplode(x).alias("feature", "bin")).groupBy("_key", "feature", "bin").agg(F.count("*").alias("n")))
    by = ["_key", "feature"]
    middle = stored(_cut(bins, by, "bin").select(*by, F.col("cut").alias("middle")))
    away = bins.join(middle, by).withColumn("away", F.abs(F.col("bin") - F.col("middle")))
    spread = _cut(away.groupBy(*by, "away").agg(F.sum("n").alias("n")), by, "away")
    med = _wide(middle.withColumn("middle", (F.col("middle") + 0.5) / BINS), ["_key"], "med", "middle")
    return med.join(_wide(spread.withColumn("cut", F.col("cut") / BINS), ["_key"], "mad", "cut"), "_key")


def _starts(rows: DataFrame) -> DataFrame:
    """(_key, start, noise_i, mean_i, c_i_j): medians, with scatters by deviations alone, by bounded values and by signs."""
    sizes = rows.groupBy("_key").agg(*(F.avg(v).alias(f"noise_{i}") for i, v in enumerate(NOISE)))
    middles = stored(sizes.join(_middles(rows), "_key"))
    scale = [F.sqrt(F.pow(1.4826 * F.col(f"mad_{i}"), F.lit(2.0)) + F.col(f"noise_{i}")) for i in range(P)]
    z = rows.join(_small(middles), "_key").select("_key", *((F.col(f) - F.col(f"med_{i}")) / scale[i] for i, f in enumerate(FEATURES))).toDF("_key", *(f"z_{i}" for i in range(P)))
    square = sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, P)), F.col("z_0") * F.col("z_0"))
    z = z.withColumn("far", F.greatest(square, F.lit(1e-12)))
    t = [F.tanh(f"z_{i}") for i in range(P)]
    sums = [F.avg(t[i]).alias(f"t_{i}") for i in range(P)] + [F.avg(t[i] * t[j]).alias(f"tt_{i}_{j}") for i, j in _PAIRS]
    sums += [F.avg(F.col(f"z_{i}") * F.col(f"z_{j}") / F.col("far")).alias(f"ss_{i}_{j}") for i, j in _PAIRS]
    got = middles.join(z.groupBy("_key").agg(*sums), "_key")
    spread = [F.greatest(F.col(f"tt_{i}_{i}") - F.col(f"t_{i}") * F.col(f"t_{i}"), F.lit(1e-12)) for i in range(P)]

    def scatter(i: int, j: int) -> list[Column]:
        plain = F.pow(1.4826 * F.col(f"mad_{i}"), F.lit(2.0)) if i == j else F.lit(0.0)
        bounded = (F.col(f"tt_{i}_{j}") - F.col(f"t_{i}") * F.col(f"t_{j}")) / F.sqrt(spread[i] * spread[j])
        return [plain, bounded * scale[i] * scale[j], F.col(f"ss_{i}_{j}") * P * scale[i] * scale[j]]

    every = F.array(*(F.struct(F.lit(s).alias("start"), *(scatter(i, j)[s].alias(f"c_{i}_{j}") for i, j in _PAIRS)) for s in range(STARTS)))
    means = [F.col(f"med_{i}").alias(f"mean_{i}") for i in range(P)]
    return got.select("_key", *(f"noise_{i}" for i in range(P)), *means, F.explode(every).alias("s")).select("_key", *(f"noise_{i}" for i in range(P)), *_MEANS, "s.*")


def _moments(rows: DataFrame, by: list[str], share: Column) -> DataFrame:
    """The estimates of rows, which have an estimate and `share`, the share of the group that they are; sums are taken about the old centre."""
    dev = [F.col(f) - F.col(f"mean_{i}") for i, f in enumerate(FEATURES)]
    sums = [F.count("*").alias("n"), F.first(share).alias("share"), *(F.first(f"noise_{i}").alias(f"noise_{i}") for i in range(P)), *(F.first(f"mean_{i}").alias(f"old_{i}") for i in range(P))]
    sums += [F.avg(dev[i]).alias(f"s_{i}") for i in range(P)] + [F.avg(dev[i] * dev[j]).alias(f"q_{i}_{j}") for i, j in _PAIRS]
    # the factor for each share of a hundredth
    factors = F.array(*(F.lit(_consistency(k / 100)) for k in range(1, 100)), F.lit(1.0))
    factor = F.element_at(factors, F.greatest(F.floor(F.col("share") * 100), F.lit(1)).cast("int"))
    mean = [(F.col(f"old_{i}") + F.col(f"s_{i}")).alias(f"mean_{i}") for i in range(P)]
    scatter = [((F.col(f"q_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}")) * factor).alias(f"c_{i}_{j}") for i, j in _PAIRS]
    return rows.groupBy(*by).agg(*sums).select(*by, "n", *(f"noise_{i}" for i in range(P)), *mean, *scatter)


def _step(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """A concentration step from each estimate (_key, start, …)."""
    by = ["_key", "start"]
    near = _with_distance(rows.join(_small(estimate), "_key"))
    near = near.withColumn("bin", F.floor(F.log2(F.greatest("d", F.lit(2.0**-30))) * BINS_OF_TWO).cast("int"))
    cuts = stored(_cut(near.groupBy(*by, "bin").agg(F.count("*").alias("n")), by, "bin"))
    inner = near.join(_small(cuts), by).where("bin <= cut")
    return stored(_with_log_det(_moments(inner, by, F.col("share"))))


def _determinant(rows: DataFrame) -> DataFrame:
    """(_key, n, mean_i, c_i_j) of each group: the minimum-covariance-determinant estimates, reweighted."""
    estimate = stored(_starts(rows))
    for _ in range(FIRST_STEPS):
        estimate = _step(rows, estimate)
    best = estimate.groupBy("_key").agg(F.min(F.struct("log_det", "start")).alias("b")).select("_key", F.col("b.start").alias("start"))
    moving = stored(estimate.join(best, ["_key", "start"]))
    settled = moving.limit(0)
    for _ in range(FIRST_STEPS, STEPS):
        before = moving.select("_key", F.col("log_det").alias("before"))
        moved = stored(_step(rows, moving).join(before, "_key").withColumn("still", F.abs(F.col("log_det") - F.col("before")) < SETTLED).drop("before"))
        settled = settled.unionByName(moved.where("still").drop("still"))
        moving = moved.where("NOT still").drop("still")
        if moving.isEmpty():
            break
    estimate = stored(settled.unionByName(moving))
    near = _with_distance(rows.join(_small(estimate), "_key")).where(F.col("d") <= chi2_quantile(REWEIGHT, P))
    return stored(_moments(near, ["_key"], F.lit(REWEIGHT)))


_CORPUS = "all"


def _keys(lang: str = "_lang", source: str = "_source") -> list[Column]:
    """The keys of a row's language and source, of its language, and of the corpus."""
    wider = F.concat(F.lit("lang:"), F.col(lang))
    return [F.concat(wider, F.lit("\1source:"), F.col(source)), wider, F.lit(_CORPUS)]


def _shrunk(own: DataFrame, wider: DataFrame) -> DataFrame:
    """own (_key, _wider, n, estimate), drawn to the estimates of wider (_key, estimate)."""
    part = F.col("n") / (F.col("n") + PRIOR)
    other = wider.select(F.col("_key").alias("_wider"), *(F.col(c).alias(f"w_{c}") for c in (*_MEANS, *_SCATTER)))
    joined = own.join(other, "_wider")
    return joined.select("_key", *((F.col(c) * part + F.col(f"w_{c}") * (1 - part)).alias(c) for c in (*_MEANS, *_SCATTER)))


def fit(stats: DataFrame) -> DataFrame:
    """(_lang, _source, mean_i, c_i_j): the estimates of each language and source.

    stats: with_statistics of the documents to learn from, stored. Those that fail the base don't count.
    """
    good = stats.where(~F.col("base_failed")).select("_lang", "_source", *FEATURES, *NOISE)
    rows = good.select(F.explode(F.array(*_keys())).alias("_key"), *FEATURES, *NOISE)
    found = _determinant(rows)
    groups = stored(good.select("_lang", "_source").distinct())
    narrow, lang, all_ = _keys()
    corpus = found.where(F.col("_key") == _CORPUS)
    langs = groups.select(lang.alias("_key")).distinct().withColumn("_wider", F.lit(_CORPUS))
    langs = stored(_shrunk(found.join(langs, "_key"), corpus))
    sources = groups.select(narrow.alias("_key"), lang.alias("_wider"))
    sources = _shrunk(found.join(sources, "_key"), langs)
    return stored(groups.withColumn("_key", narrow).join(sources, "_key").drop("_key"))


def judge(stats: DataFrame, estimates: DataFrame, reject: float = REJECT) -> DataFrame:
    """stats with `distance`, squared, null without an estimate, and `kept`; without the helper columns."""
    own = [c for c in stats.columns if c not in ("distance", "kept")]
    rows = _with_distance(stats.select(*own).join(_small(estimates), ["_lang", "_source"], "left"))
    rest = [c for c in own if c not in ("_lang", "_source", "_m", *FEATURES, *NOISE)]
    inside = F.coalesce(F.col("d") <= chi2_quantile(reject, P), F.lit(True))
    return rows.select(*rest, F.col("d").alias("distance"), (~F.col("base_failed") & inside).alias("kept"))


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """A row for each row of docs: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    Null texts have no words and fail. Null languages and sources are groups like others. A group of few documents has
    nearly the estimate of its language, and that of the corpus where the language has few as well. Rows that
    repeat get one verdict; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"), F.col(lang).alias("_l"), F.col(source).alias("_s"))
    stats = stored(with_statistics(rows, "_text", "_l", "_s").drop("_text", "_l", "_s"))
    return judge(stats, fit(stats)).select("doc_id", *_BASE, "kept", "distance")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that quality keeps, with their columns as they are.

    Texts are measured once and stored with their statistics; the fit reads the statistics alone.
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(text).alias("_text"), F.col(lang).alias("_l"), F.col(source).alias("_s"))
    stats = stored(with_statistics(whole, "_text", "_l", "_s").drop("_text", "_l", "_s"))
    return judge(stats, fit(stats)).where("kept").select("_row.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))
