"""Secret scans: patterns find candidates, and a random forest removes the false positives.

Features of a candidate are its length, the transitions between classes of its characters, how much of it the words of
the corpus cover, the path it lies under and the words beside it. The forest is trained from labelled findings: a table of
the caller's, or `labelled_findings`, which are made by rule. Its size is a parameter and doesn't follow the corpus. The
dictionary is the DICTIONARY words that all texts hold most often. Whole texts are searched, and every candidate is scored.

Everything is built-in Spark expressions and Spark's own random forest, so texts don't leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import documents
from quillstack.llm.spans import let, matches, no_matches

#: Findings to train from, at most and made by rule, trees and their depth.
MOST_FINDINGS, FINDINGS, TREES, DEPTH = 100_000, 8000, 32, 7
#: Words of the corpus that count as known.
DICTIONARY = 2000
_NEAR = 32
#: Blanks that may align a value with its name's sign, on either side of it.
_ALIGNED = 64

# Patterns, in the order of preference at one place (fixed values).
_BLANKS = rf"(?:\s{{0,2}}|[ \t]{{3,{_ALIGNED}}})"
# the first look-behind is the second's end, and spares most places the search for a name
ASSIGNED = rf"""(?<=[:=]{_BLANKS}["']?)(?<=(?i:passwor[dt]|passwd|pwd|secret|token|key|credential)["']?{_BLANKS}[:=]{_BLANKS}["']?)[^\s"',;<>]{{6,}}+"""
# to its end line; a first line without one is found alone
PRIVATE_KEY = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]++(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----)?"
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
# keys of known formats that TOKEN passes over: without a digit, or short
FORMATS = r"(?<![A-Za-z0-9+/_-])(?:A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9+/_-])|gh[pousr]_[A-Za-z0-9]{20,}+|(?:xox[abprs]-|sk_live_|eyJ)[A-Za-z0-9_-]{10,}+)"
PATTERN = f"{ASSIGNED}|{PRIVATE_KEY}|{TOKEN}|{FORMATS}"
KNOWN = r"^(?:AKIA[0-9A-Z]{16}$|ASIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-|sk_live_|eyJ[A-Za-z0-9_-]{10,}|-----BEGIN )"
UUID = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
FOR = r"(?i)(?:passwor|passwd|pwd|secret|token|api.?key|access.?key|private.?key|credential|bearer|auth)"
AGAINST = r"(?i)(?:commit|sha-?1|sha-?256|md5|checksum|digest|hash|uuid|guid|revision|etag|isbn|order|example|sample|placeholder|version|build|serial)"
TEST_PATH = r"(?i)(?:^|[/_.-])(?:tests?|examples?|samples?|docs?|fixtures?|mocks?)(?:[/_.-]|$)"
SECRET_PATH = r"(?i)(?:\.env|config|settings|credentials|secrets?|\.pem|\.ya?ml|\.ini)"
# words that stand in names and placeholders, whatever the corpus holds (fixed values)
WORDS = "user name admin test example sample your here token password secret change value default file path index class function string number version build key none null true false".split()

FEATURES = ["length", "transitions", "distinct", "entropy", "digits", "upper", "hex", "words", "known", "uuid", "test_path", "secret_path", "near_for", "near_against", "assigned"]


def any_of(words: list[str]) -> str:
    """A pattern of any of these words of letters, the longest at one place, as a tree of their beginnings: no word is tried whose start doesn't fit."""
    first: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            first.setdefault(w[0], []).append(w[1:])
    branches = [c + any_of(rest) for c, rest in first.items()]
    return f"(?:{'|'.join(branches)}){'?' if '' in words else ''}" if branches else ""


def dictionary(docs: DataFrame, text: str = "text", most: int = DICTIONARY) -> list[str]:
    """The words of four to twelve letters that stand most often in all texts, `most` of them; ties by the word."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?<!\p{L})\p{L}{4,12}+(?!\p{L})"), F.lit(0))).alias("w"))
    return [r.w for r in words.groupBy("w").agg(F.count("*").alias("n")).where("n > 9").orderBy(F.desc("n"), "w").limit(most).collect()]


def features(found: Column, before: Column, after: Column, path: Column, words: list[str] = ()) -> dict[str, Column]:
    """The numbers that the forest sees of a candidate; path may be null. words: those of the corpus, beside WORDS."""
    n = F.length(found)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    share = lambda pattern: (n - F.length(F.regexp_replace(found, pattern, ""))) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(found, "[^A-Za-z0-9]", "."), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    covered = F.regexp_replace(F.lower(found), any_of([*WORDS, *words]), "")
    chars = F.split(found, "")

    def entropy(c: Column) -> Column:
        total = F.size(c)
        part = lambda x: F.size(F.filter(c, lambda y: y == x)) / total
        return F.aggregate(F.array_distinct(c), F.lit(0.0), lambda a, x: a - part(x) * F.ln(part(x)))

    return {
        "length": F.ln(n), "transitions": (runs - 1) / F.greatest(n - 1, F.lit(1)), "distinct": F.size(F.array_distinct(chars)) / n,
        "entropy": let(F.filter(chars, lambda c: c != ""), entropy), "digits": share("[0-9]"), "upper": share("[A-Z]"),
        "hex": flag(found.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), "words": (n - F.length(covered)) / n, "known": flag(found.rlike(KNOWN)),
        "uuid": flag(found.rlike(UUID)), "test_path": flag(path.rlike(TEST_PATH)), "secret_path": flag(path.rlike(SECRET_PATH)),
        "near_for": flag(before.rlike(FOR)), "near_against": flag(before.rlike(AGAINST) | after.rlike(AGAINST)), "assigned": flag(before.rlike(r"[:=]\s*[\x22\x27]?$")),
    }


# of the labelled findings alone, so that the dictionary isn't known beforehand (fixed values)
_NOUNS = "river lantern copper meadow falcon harbor violet pepper saddle timber canyon marble ribbon walnut anchor breeze cactus dragon ember feather garnet hazel island jungle kettle lemon mango nickel orchid pebble quartz raven salmon tulip umbra velvet willow yonder zephyr barrel".split()
_NAMES = ["password=", "passwd: ", "pwd = ", "secret: ", "client_secret=", "token = \"", "auth_token='", "api_key=", "apiKey: ", "access_key: ", "secret_key = ", "Authorization token: ", "credential: "]
_BESIDE_OTHERS = ["commit ", "sha1 ", "sha256: ", "md5=", "checksum = ", "hash ", "etag: ", "revision ", "build ", "example ", "digest: "]
_PLACEHOLDERS = ["changeme1", "your_token_here", "xxxxxxxxxxxx", "example-password", "default_value", "none123", "<password>", "${API_TOKEN}", "********", "os.environ", "getpass()", "REPLACE_ME_1"]


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(before, found, after, path, label, family): n findings made by rule from their number, half of them secrets."""
    i = F.col("id")
    salt = lambda s: F.concat(i.cast("string"), F.lit(s))
    digest = lambda s: F.sha2(salt(s), 256)
    base64 = lambda s: F.translate(F.base64(F.unhex(F.concat(digest(s), digest(s + "+")))), "+/=", "xYz")
    hexes, mixed = digest("h"), base64("b")
    upper = F.upper(F.translate(mixed, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    pick = lambda values, s: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(salt(s)), F.lit(len(values))) + 1).cast("int"))
    word = lambda s: pick(_NOUNS, s)
    name, prose = pick(_NAMES, "k"), F.concat(word("p"), F.lit(" "), word("q"), F.lit(" "))
    neutral = F.concat(prose, pick(["in ", "see ", "id ", "ref ", "", "of ", "at ", "http://", "file "], "n"))
    against = F.concat(prose, pick(_BESIDE_OTHERS, "a"))
    lengths = lambda s, values: F.substring(F.concat(base64(s), base64(s + "2")), F.lit(1), pick(values, s + "n"))
    secret_path = pick(["app/config.yml", ".env", "src/settings.py", "deploy/secrets.ini", None, "src7", "src0", "web/main.js"], "s")
    other_path = pick(["tests/test_a.py", "docs/readme.md", "src/main.c", None, "src3", "src0", "examples/a.txt", "web/index.html"], "o")
    assigned = F.concat(prose, name)
    secrets = {
        "cloud key id": (prose, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16))),
        "prefixed token": (F.concat(prose, pick(["key ", "use ", "", "with "], "w")), F.concat(pick(["ghp_", "gho_", "xoxb-", "sk_live_"], "g"), F.substring(mixed, 1, 36))),
        "web token": (F.concat(prose, pick(["Bearer ", "token: ", ""], "w")), F.concat(F.lit("eyJ"), lengths("j", [30, 60, 80]))),
        "assigned base64": (assigned, lengths("u", [20, 24, 32, 44, 88])),
        "assigned hex": (assigned, F.substring(hexes, F.lit(1), pick([18, 32, 40, 64], "v"))),
        "password": (assigned, F.concat(word("x"), pick(["!", "#", "$", "_", "@"], "y"), F.substring(mixed, F.lit(1), pick([4, 6, 8], "z")))),
        "private key": (F.concat(prose, F.lit("\n")), F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), mixed, F.lit("\n"), base64("c"), F.lit("\n-----END RSA PRIVATE KEY-----"))),
    }
    others = {
        "revision": (against, F.substring(hexes, 1, 40)),
        "digest": (against, F.substring(hexes, F.lit(1), pick([32, 64], "e"))),
        "uuid": (neutral, F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))),
        "path": (neutral, F.concat_ws("/", word("u"), word("v"), word("w"), F.substring(hexes, 1, 2))),
        "placeholder": (assigned, pick(_PLACEHOLDERS, "d")),
        "identifier": (neutral, F.concat(word("e"), F.lit("_"), word("f"), F.lit("_"), word("g"), (i % 97).cast("string"))),
        "number": (neutral, F.conv(F.substring(hexes, 1, 14), 16, 10)),
        "slug": (neutral, F.concat_ws("-", word("h"), word("i"), (i % 31).cast("string"), word("j"))),
        "assigned name": (assigned, F.concat(word("l"), pick(["_", ".", "/"], "m"), word("o"), pick(["_", "-", "/", ""], "r"), word("t"))),
        "data": (F.concat(prose, F.lit("image/png;base64,")), F.concat(pick(["iVBORw0KGgo", "R0lGODlh", "AAAAAA"], "x"), lengths("i", [40, 88, 120]))),
    }
    half = F.pmod(F.xxhash64(salt("l")), F.lit(2)) == 0

    def choose(families: dict[str, tuple[Column, Column]]) -> Column:
        every = F.array(*(F.struct(F.lit(f).alias("family"), before.alias("before"), found.alias("found")) for f, (before, found) in families.items()))
        return F.element_at(every, (F.pmod(F.xxhash64(salt("c")), F.lit(len(families))) + 1).cast("int"))

    rows = spark.range(n).select(F.when(half, choose(secrets)).otherwise(choose(others)).alias("c"), F.concat(F.lit(" "), word("z")).alias("after"), F.when(half, secret_path).otherwise(other_path).alias("path"), half.cast("double").alias("label"))
    return rows.select("c.before", "c.found", "after", "path", "label", "c.family")


def _vectors(df: DataFrame, words: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    named = features(F.col("found"), F.col("before"), F.col("after"), F.col("path"), words)
    df = df.select("*", *(named[f].cast("double").alias(f"f_{f}") for f in FEATURES))
    return VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features", handleInvalid="keep").transform(df)


def train(labelled: DataFrame, words: list[str] = (), most: int = MOST_FINDINGS):
    """The forest of labelled findings (before, found, after, path, label): `most` of them, those with the least hashes.

    They are one partition, so that reruns agree.
    """
    from pyspark.ml.classification import RandomForestClassifier

    bounded = labelled.orderBy(F.xxhash64("before", "found", "after", "path"), "label").limit(most)
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7).fit(_vectors(bounded.coalesce(1), words))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, start, end, found, before, after, path) of each candidate of each text."""
    body = F.coalesce(F.col(text), F.lit(""))
    may = body.rlike(r"[0-9][A-Za-z+/_-]|[A-Za-z+/_-][0-9]|[:=]|[0-9]{16}|-----BEGIN|A[KS]IA[A-Z]{16}|gh[pousr]_|xox[abprs]-|sk_live_|eyJ")
    far = 2 * _ALIGNED + _NEAR  # alignment counts as two blanks, so that the name is near
    rows = docs.select(F.col(key).alias("doc_id"), F.col(path).cast("string").alias("path"), F.when(may, matches(body, PATTERN, far)).otherwise(no_matches()).alias("all"))

    def around(m: Column) -> Column:
        before = F.right(F.regexp_replace(m["before"], r"[ \t]{3,}", "  "), F.lit(_NEAR))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found"), before.alias("before"), F.left(m["after"], F.lit(_NEAR)).alias("after"))

    return rows.where(F.size("all") > 0).select("doc_id", "path", F.explode(F.transform("all", around)).alias("c")).select("doc_id", "path", "c.*")


def scan(docs: DataFrame, labelled: DataFrame | None = None, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """A row for each candidate: key, start, end (code points, end exclusive), sha256 of what was found, secret.

    secret: the forest's verdict. A private key is one candidate to its end line; without one its first line is. Null and
    empty texts have no candidates; a null path is one that says nothing; rows that repeat are scanned alike; other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    words = dictionary(docs, text)
    model = train(labelled if labelled is not None else labelled_findings(docs.sparkSession), words)
    scored = model.transform(_vectors(candidates(docs, key, text, path), words))
    return scored.select("doc_id", "start", "end", F.sha2("found", 256).alias("sha256"), (F.col("prediction") > 0.5).alias("secret"))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
