"""Personal data by weak supervision: labelers vote on candidate spans, and a classifier learns from what they agree on.

Candidates come from regular expressions: the strict ones of the base, whose spans always stay; looser forms of the same
kinds, of bank account and identity numbers; and names and addresses, which lists of given names, cues such as titles,
and street words point to. A strict-format, a gazetteer, a context and a shape labeler each vote for, against or not at
all. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is and how common
each kind, without labels; its posteriors train a logistic span classifier, which decides on the candidates outside the
base. What the base's rules decide is known: its spans are personal data, and a match that fails them never is.

Everything is built-in Spark expressions, so texts don't leave the JVM, and they are searched once: candidates are stored
without the texts. Training is over all of them and reduces to counts of patterns, at most PATTERNS of them; then each
candidate is scored, with the learned numbers as literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import documents, stored
from quillstack.llm.spans import let, matches, no_matches

#: In the order of spans.
KINDS = ("email", "ip", "card", "phone", "iban", "id", "name", "address")
BASE = KINDS[:4]

# The base, as the contract has it. Possessive repeats and the look-behinds change no match: they keep the search linear
# and free of deep recursion in long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Looser forms.
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[\[({]dot[\])}])\x20?[A-Za-z0-9-]{1,63}+){1,8}"
LOOSE_PHONE = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

# Gazetteers and context words (fixed values).
TOP_LEVEL = "com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au ch at be pl se no fi dk pt ie jp cn in br mx ru".split()
IBAN_COUNTRIES = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split()
GIVEN = (
    "Alice Amy Andrew Anna Anne Antonio Arthur Barbara Ben Benjamin Brian Carlos Carmen Caroline Charles Charlotte Chloe Christian Christine Claire Clara "
    "Daniel David Diana Diego Dieter Edward Elena Elizabeth Emily Emma Eric Eva Felix Fernando Florian Frank Franz Friedrich George Georg Grace Hannah Hans "
    "Heinrich Helen Helga Henry Hugo Ines Isabel Jack Jacques James Jan Jane Javier Jean Jennifer Jessica Johann John Jonas Jorge Joseph Juan Julia Julie "
    "Karen Karl Katharina Kevin Klaus Laura Lena Leon Lisa Louis Lucas Lucia Luis Manuel Marco Margaret Maria Marie Mark Markus Martin Mary Matthew Max Michael "
    "Michel Miguel Monika Nathalie Nicolas Nina Olga Oliver Oscar Otto Pablo Patricia Paul Pedro Peter Petra Philip Pierre Rachel Rafael Richard Robert Rosa "
    "Samuel Sandra Sara Sarah Sebastian Simon Sofia Sophie Stefan Steven Susan Thomas Tobias Ursula Victor Werner William Wolfgang Yves"
).split()
NOT_NAMES = "The This That There Then They You Your Our Day Days Street Road Avenue University Company Inc Ltd GmbH Hospital Church River Lake Prize Award Theorem Museum Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December".split()
CITIES = (
    "London Paris Berlin Madrid Vienna Wien Zurich Munich Hamburg Cologne Frankfurt Stuttgart Lyon Marseille Toulouse Bordeaux Barcelona Valencia Sevilla "
    "Boston Chicago Dallas Denver Seattle Austin Portland Springfield Manchester Birmingham Leeds Glasgow Edinburgh Dublin Amsterdam Brussels Rome Milan Lisbon"
).split()
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Herrn Frau Mme Madame Monsieur Sr Sra Don".split()
CALLS = ["name is", "named", "Name:", "name:", "Dear", "Liebe", "Lieber", "heiße", "heißt", "appelle", "llamo", "llama", "Cher", "Chère", "Estimado", "Estimada"]
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
PRIVATE = r"^(?:0|10|127|255|169\.254|192\.168)\."
SPEAKING_FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|kontakt|contacto|courriel|correo|write|schreib)\b",
    "ip": r"(?i)\b(?:ip|address|adresse|host|client|login|from)\b",
    "card": r"(?i)\b(?:card|karte|carte|tarjeta|visa|mastercard|credit|kredit)\b",
    "phone": r"(?i)\b(?:phone|tel|telefon|telefono|mobile|handy|call|fax|cell)\b",
    "iban": r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b",
    "id": r"(?i)\b(?:ssn|social|security|id|passport|ausweis)\b",
    "name": r"\b(?:" + "|".join([*TITLES, *(c for c in CALLS if c[-1] != ":")]) + r")\b|[Nn]ame:|(?i)\b(?:signed|author|patient|sincerely|regards|grüße|cordialement|saludos|born|married)\b",
    "address": r"(?i)\b(?:address|adresse|lives?|living|wohnt|wohnhaft|habite|domicilio|vive|ship|deliver|deliver(?:ed|y)|send|sent|visit|office|resid\w+)\b",
}
SPEAKING_AGAINST = r"(?i)\b(?:version|release|isbn|order|invoice|serial|sku|part|model|figure|section|chapter|ratio|build|built|theorem|novel|song|battle|closed)\b"

# Names and addresses: a word with a capital, and what points to it.
_WORD = r"\p{Lu}[\p{L}'’-]{1,30}+"
NAME_HEAD = rf"(?=\p{{Lu}})(?<![\p{{L}}'’-])(?:(?<=(?<!\p{{L}})(?:{'|'.join(TITLES)})\.?\x20)|(?<=(?<!\p{{L}})(?:{'|'.join(CALLS)})\x20)|(?=(?:{'|'.join(GIVEN)})(?![\p{{L}}'’-])))"
NAME = rf"{NAME_HEAD}(?!(?:{'|'.join(TITLES)})\.?\x20){_WORD}(?:\x20{_WORD}){{0,2}}"
ADDRESS = "|".join([
    r"(?<![0-9\p{L}.,])[0-9]{1,5}[A-Za-z]?\x20(?:\p{Lu}[\p{L}'-]{1,20}+\x20){1,3}?(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Way|Place|Terrace)(?!\p{L})",
    r"(?<!\p{L})\p{Lu}\p{L}{1,20}?(?:straße|strasse|str\.|weg|platz|gasse|allee)\x20[0-9]{1,4}[a-z]?(?![0-9\p{L}])",
    r"(?<![0-9\p{L}.,])[0-9]{1,4}(?:\x20(?:bis|ter))?,?\x20(?:rue|avenue|boulevard|place|quai|chemin)\x20(?:(?:de|du|des|la|le|les)\x20){0,2}(?:[dl]')?\p{Lu}[\p{L}'-]{1,20}+",
    r"(?<!\p{L})(?:Calle|Avenida|Avda\.|Plaza|Paseo)\x20(?:(?:de|del|la|las|los)\x20){0,2}\p{Lu}\p{L}{1,20}+,?\x20(?:n[.º°]?\x20?)?[0-9]{1,4}(?![0-9])",
])

#: How people write these, which their patterns leave open.
GROUPED = {"card": r"^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$", "phone": r"\([0-9]{2,4}\)", "iban": r"^[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){3}"}

LABELERS = ("strict", "gazetteer", "context", "shape")
VOTES = (-1, 0, 1)
_CONTEXT = 40
#: A labeler's record over all kinds counts for each kind as so many candidates.
FEW = 20
#: Kinds, what the base says, votes of the labelers, and bins of length and of digits.
PATTERNS = len(KINDS) * 3 * len(VOTES) ** len(LABELERS) * 4 * 3


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _found(text: Column, may: Column, pattern: str) -> Column:
    return F.when(may, matches(text, pattern, _CONTEXT)).otherwise(no_matches())


def _base_valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return let(_digits(found), _luhn)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _sources(text: Column) -> list[tuple[str, bool, Column]]:
    """(kind, strict, matches) of each pattern; cheap tests spare most texts the search."""
    digit = text.rlike(r"[0-9][\x20().-]?[0-9]")
    return [
        ("email", True, _found(text, F.contains(text, F.lit("@")), EMAIL)),
        ("ip", True, _found(text, text.rlike(r"[0-9]\.[0-9]"), IP)),
        ("card", True, _found(text, text.rlike(r"[0-9](?:[\x20-]?[0-9]){7}"), CARD)),
        ("phone", True, _found(text, F.contains(text, F.lit("+")), PHONE)),
        ("email", False, _found(text, text.rlike(r"at[\])}]"), LOOSE_EMAIL)),
        ("phone", False, _found(text, digit & text.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"), LOOSE_PHONE)),
        ("iban", False, _found(text, text.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), IBAN)),
        ("id", False, _found(text, text.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), ID)),
        ("name", False, _found(text, text.rlike(NAME_HEAD), NAME)),
        ("address", False, _found(text, text.rlike(ADDRESS), ADDRESS)),
    ]


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, strict: bool, valid: Column, found: Column, around: Column) -> list[Column]:
    digits = _digits(found)
    never = F.lit(False)
    if strict:
        first = _vote(valid, ~valid)
    elif kind == "iban":
        first = _vote(_iban_valid(found), ~_iban_valid(found))
    else:
        first = F.lit(0)
    if kind == "email":
        top = F.lower(F.regexp_extract(found, r"([A-Za-z0-9-]+)$", 1))
        second = _vote(top.isin(TOP_LEVEL), ~top.isin(TOP_LEVEL))
    elif kind == "ip":
        second = _vote(~found.rlike(PRIVATE), found.rlike(PRIVATE))
    elif kind == "card":
        second = _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS))
    elif kind == "iban":
        known = F.substring(found, 1, 2).isin(IBAN_COUNTRIES)
        second = _vote(known, ~known)
    elif kind == "id":
        second = _vote(~found.rlike("^(?:000|666|9)"), found.rlike("^(?:000|666|9)"))
    elif kind == "name":  # a given name alone is as often a word
        other = found.rlike(rf"(?:^|\x20)(?:{'|'.join(NOT_NAMES)})(?:\x20|$)")
        second = _vote(found.rlike(rf"^(?:{'|'.join(GIVEN)})\x20") & ~other, other)
    elif kind == "address":
        second = _vote(around.rlike(rf"(?<!\p{{L}})(?:{'|'.join(CITIES)})(?!\p{{L}})|(?<![0-9])[0-9]{{5}}(?![0-9])"), never)
    else:
        second = F.lit(0)
    third = _vote(around.rlike(SPEAKING_FOR[kind]), around.rlike(SPEAKING_AGAINST))
    flat = (F.length(digits) > 6) & digits.rlike(r"^([0-9])\1*$")
    fourth = _vote(never, flat | F.contains(F.lit("01234567890123456789"), digits) & (F.length(digits) > 6))
    if kind == "name":  # a given name and a surname; a word alone may open a sentence
        fourth = _vote(found.rlike(r"\x20") & ~found.rlike(rf"(?:^|\x20)(?:{'|'.join(NOT_NAMES)})(?:\x20|$)"), ~found.rlike(r"\x20"))
    if kind == "address":  # a year is not a house number
        fourth = _vote(found.rlike(r"(?<![0-9])[0-9]{1,3}(?![0-9])"), found.rlike(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"))
    if kind in GROUPED:  # a form that the pattern doesn't ask for anyway, else the vote would say nothing
        fourth = F.when(fourth == 0, _vote(found.rlike(GROUPED[kind]), never)).otherwise(fourth)
    return [first, second, third, fourth]


def _iban_valid(found: Column) -> Column:
    """ISO 13616: the first four characters moved to the end, letters as 10 to 35, and the number is 1 modulo 97."""
    plain = F.regexp_replace(found, r"\x20", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.length(plain).between(15, 34) & (value == 1)


def candidates(text: Column) -> Column:
    """An array of all candidates of a text: kind (its number), start, end, base, failed, votes, bin_length, bin_digits.

    base and failed: a match of the base's form that passes its rules, or doesn't.
    """
    return F.flatten(F.array(*(F.transform(found, _shaped(kind, strict)) for kind, strict, found in _sources(text))))


def _shaped(kind: str, strict: bool):
    def shape(m: Column) -> Column:
        around = F.concat(m["before"], F.lit(" | "), m["after"])
        valid = _base_valid(kind, m["found"]) if strict else F.lit(False)
        share = F.length(_digits(m["found"])) / F.length(m["found"])
        length = m["end"] - m["start"]
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), valid.alias("base"), (~valid if strict else F.lit(False)).alias("failed"),
            F.array(*_votes(kind, strict, valid, m["found"], around)).alias("votes"),
            F.when(length < 12, 0).when(length < 16, 1).when(length < 24, 2).otherwise(3).alias("bin_length"),
            F.when(share < 0.2, 0).when(share < 0.8, 1).otherwise(2).alias("bin_digits"),
        )

    return shape


@dataclass(frozen=True)
class SpanModel:
    """What was learned: the weight of each feature of the final classifier, and each labeler's reliability over all kinds.

    The reliability is the share of spans it votes for and the share of others it votes against.
    """

    weights: dict[str, float] = field(default_factory=dict)
    reliability: dict[str, tuple[float, float]] = field(default_factory=dict)

    def keeps(self, c: Column) -> Column:
        """Whether the classifier takes a candidate.

        Without training it takes none; it never takes a match
        that fails the base's rules, nor one that no labeler votes for.
        """
        if not self.weights:
            return F.lit(False)
        total = F.lit(self.weights["bias"])
        for name, test in _features(c["kind"], c["votes"], c["bin_length"], c["bin_digits"]).items():
            total = total + F.when(test, F.lit(self.weights[name])).otherwise(F.lit(0.0))
        return ~c["failed"] & F.array_contains(c["votes"], 1) & (total > 0)


def _features(kind: Column, votes: Column, length: Column, digits: Column) -> dict[str, Column]:
    found = {f"kind_{k}": kind == i for i, k in enumerate(KINDS[1:], 1)}
    for i, name in enumerate(LABELERS):
        found |= {f"{name}_for": votes[i] == 1, f"{name}_against": votes[i] == -1}
        for k, of in enumerate(KINDS):
            found |= {f"{of}_{name}_for": (kind == k) & (votes[i] == 1), f"{of}_{name}_against": (kind == k) & (votes[i] == -1)}
    found |= {f"length_{b}": length == b for b in (1, 2, 3)} | {f"digits_{b}": digits == b for b in (1, 2)}
    return found


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination with pivoting, for the handful of weights."""
    n = len(b)
    m = [row[:] + [x] for row, x in zip(a, b)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        for r in range(i + 1, n):
            f = m[r][i] / m[i][i]
            for c in range(i, n + 1):
                m[r][c] -= f * m[i][c]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (m[i][n] - sum(m[i][c] * x[c] for c in range(i + 1, n))) / m[i][i]
    return x


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _active(kind: int, votes: list[int], length: int, digits: int) -> list[str]:
    """The names of _features that hold, and the bias."""
    on = ["bias"] + [f"kind_{KINDS[kind]}"] * (kind > 0) + [f"length_{length}"] * (length > 0) + [f"digits_{digits}"] * (digits > 0)
    said = [f"{name}_{'for' if v > 0 else 'against'}" for name, v in zip(LABELERS, votes) if v]
    return on + said + [f"{KINDS[kind]}_{s}" for s in said]


def train(found: DataFrame, em_rounds: int = 20, newton_rounds: int = 12) -> SpanModel:
    """The model of a table of candidates: kind, base, failed, votes, bin_length, bin_digits.

    Spark counts the candidates of each pattern, all of them. At most PATTERNS counts come to the driver, whatever the
    size of the corpus, and the two estimates are sums over those.
    """
    grouped = found.groupBy("kind", "base", "failed", "votes", "bin_length", "bin_digits").agg(F.count("*").alias("n")).collect()
    every = sorted((r.kind, tuple(r.votes), r.bin_length, r.bin_digits, float(r.n), 1.0 if r.base else 0.0 if r.failed else -1.0) for r in grouped)
    counts, known = [c[:5] for c in every], [c[5] for c in every]
    if not counts:
        return SpanModel()
    kinds, labelers = range(len(KINDS)), range(len(LABELERS))
    prior = dict.fromkeys(kinds, 0.0)
    odds = {(k, i, v): float(v) for k in kinds for i in labelers for v in VOTES}
    reliability: dict[str, tuple[float, float]] = {}
    truth: list[float] = []
    for _ in range(em_rounds):
        truth = [_sigmoid(prior[k] + sum(odds[k, i, v] for i, v in enumerate(votes))) for k, votes, *_ in counts]
        truth = [p if fact < 0 else fact for p, fact in zip(truth, known)]
        for k in kinds:
            yes = sum(c[4] * p for c, p in zip(counts, truth) if c[0] == k) + 1
            no = sum(c[4] * (1 - p) for c, p in zip(counts, truth) if c[0] == k) + 1
            prior[k] = max(-3.0, min(3.0, math.log(yes / no)))
        for i, name in enumerate(LABELERS):
            every = [[1.0] * len(VOTES), [1.0] * len(VOTES)]  # of the two classes, the votes of all kinds
            own = {k: [[0.0] * len(VOTES), [0.0] * len(VOTES)] for k in kinds}
            for (k, votes, _, _, n), p in zip(counts, truth):
                at = VOTES.index(votes[i])
                for table in (every, own[k]):
                    table[0][at] += n * p
                    table[1][at] += n * (1 - p)
            share = [[x / sum(row) for x in row] for row in every]
            for k in kinds:  # a labeler can be good at one kind and say nothing about another; where a kind has few candidates it counts as over all
                a, b = ([(x + FEW * s) / (sum(row) + FEW) for x, s in zip(row, shares)] for row, shares in zip(own[k], share))
                for v, x, y in zip(VOTES, a, b):
                    weight = math.log(x / y)
                    # a labeler is never taken to be worse than chance, so that the two classes can't change places
                    odds[k, i, v] = max(0.0, weight) if v > 0 else min(0.0, weight) if v < 0 else max(-0.5, min(0.5, weight))
            reliability[name] = share[0][2], share[1][0]
    names = ["bias", *_features(*map(F.col, ("kind", "votes", "bin_length", "bin_digits")))]
    at = {n: i for i, n in enumerate(names)}
    rows = [([at[n] for n in _active(*c[:4])], c[4], p) for c, p in zip(counts, truth)]
    w = [0.0] * len(names)
    for _ in range(newton_rounds):  # ridge-penalised logistic regression on the posteriors
        gradient = [-x for x in w]
        hessian = [[float(i == j) for j in range(len(w))] for i in range(len(w))]
        for on, n, p in rows:
            q = _sigmoid(sum(w[i] for i in on))
            for i in on:
                gradient[i] += n * (p - q)
                for j in on:
                    hessian[i][j] += n * q * (1 - q)
        w = [a + max(-2.0, min(2.0, s)) for a, s in zip(w, _solve(hessian, gradient))]
    return SpanModel(dict(zip(names, w)), reliability)


def _tokens(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat(names[s["kind"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))))


def find_personal_data(docs: DataFrame, model: SpanModel | None = None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of docs: key, n_email, n_ip, n_card, n_phone, base_sha256, spans; and `personal`, the spans as structs.

    The counts and the digest are of the base; spans adds what the classifier takes outside it, which overlaps no base
    span and is no match that failed the base's rules. Without a model, one is trained on docs. A null text is an empty
    one and has no spans. Rows that repeat are scored alike; an empty table gives no rows. Columns in `keep` are carried
    along unless a result has their name.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    order = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    rows = docs.select(F.col(key).alias("doc_id"), *[c for c in keep if c in docs.columns and c != "doc_id"], candidates(body).alias("_all"))
    if model is None:
        rows = stored(rows)
        model = train(rows.select(F.explode("_all").alias("c")).select("c.kind", "c.base", "c.failed", "c.votes", "c.bin_length", "c.bin_digits"))
    base = order(F.filter("_all", lambda c: c["base"]))
    rows = rows.withColumn("_base", base)
    more = F.filter("_all", lambda c: ~c["base"] & model.keeps(c) & ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rows = rows.withColumn("personal", F.array_sort(F.array_union("_base", order(more))))
    count = lambda i: F.size(F.filter("_base", lambda b: b["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    counts = [count(i) for i in range(len(BASE))]
    return rows.select("doc_id", *counts, F.sha2(_tokens(F.col("_base")), 256).alias("base_sha256"), _tokens(F.col("personal")).alias("spans"), "personal", *[c for c in keep if c in docs.columns and c not in {"doc_id", "base_sha256", "spans", "personal"}])


def op1_personal_data(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir)).drop("personal")
