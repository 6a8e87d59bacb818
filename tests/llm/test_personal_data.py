"""op1: spans outside the base on planted, held-out texts, and what must never be added."""

import random
import re
from collections import Counter

import pytest

from quillstack.llm import pii

FILLER = "the harbour was quiet and nobody had seen the boats come back that evening while rain fell on the roofs of the old town".split()
FIRST = "Anna Peter Laura Daniel Sophie Markus Elena Robert Clara Miguel".split()
#: No surname, street or host here stands in the operator's lists.
LAST = "Kessler Novak Brandt Okafor Lindqvist Moreau Ferrante Aldana Whitcombe Sorensen".split()
STREETS = "Maple Harbour Foundry Willow Chestnut Mill Quarry Orchard".split()


def iban(rng, right=True):
    bban = "".join(rng.choice("0123456789") for _ in range(18))
    check = 98 - int(bban + "131400") % 97
    plain = f"DE{check if right else (check + 5) % 97 + 1:02d}{bban}"
    return " ".join(plain[i : i + 4] for i in range(0, len(plain), 4))


def planted(rng):
    """(kind, text before, span, text after, whether it is personal data)."""
    d = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    name, last = rng.choice(FIRST), rng.choice(LAST)
    return rng.choice([
        ("phone", rng.choice(["please call me at ", "my phone is ", "tel ", "fax "]), f"({d(3)}) {d(3)}-{d(4)}", "", True),
        ("phone", rng.choice(["order ", "invoice ", "part ", "serial "]), f"{d(3)}-{d(3)}-{d(4)}", " was shipped", False),
        ("email", rng.choice(["write to ", "contact ", "my mail is "]), f"{last.lower()} [at] {rng.choice(STREETS).lower()} [dot] {rng.choice(['org', 'com', 'de'])}", "", True),
        ("email", "the release ", f"{rng.choice(FILLER)}(at){rng.choice(FILLER)}.{rng.choice(['zzq', 'blah', 'xvf'])}", " was built", False),
        ("iban", rng.choice(["pay to account ", "IBAN ", "my bank "]), iban(rng), "", True),
        ("iban", rng.choice(["serial ", "part "]), iban(rng, False), " in stock", False),
        ("id", rng.choice(["social security ", "my ssn is ", "passport id "]), f"{rng.randint(101, 665)}-{d(2)}-{d(4)}", "", True),
        ("id", rng.choice(["part ", "model ", "serial "]), f"9{d(2)}-{d(2)}-{d(4)}", " fits", False),
        ("name", rng.choice(["my name is ", "Dear ", "Dr. ", "Frau ", "signed by "]), f"{name} {last}", "", True),
        ("name", rng.choice(["Dr. ", "Mrs ", "Herr "]), last, " came", True),
        ("name", rng.choice(["the novel ", "the battle of "]), f"{rng.choice(['George', 'Victor', 'Charlotte'])} {rng.choice(['Street', 'River', 'University', 'Prize'])}", " was told", False),
        ("name", "we saw that ", rng.choice(["Mark", "Max", "Grace", "Jack"]), " is a word", False),
        ("address", rng.choice(["she lives at ", "send it to ", "my address is "]), f"{rng.randint(2, 220)} {rng.choice(STREETS)} {rng.choice(['Street', 'Road', 'Lane'])}", ", Leeds", True),
        ("address", rng.choice(["wohnhaft in der ", "Adresse "]), f"{rng.choice(['Garten', 'Linden', 'Ufer'])}{rng.choice(['straße', 'weg', 'gasse'])} {rng.randint(1, 99)}", "", True),
        ("address", rng.choice(["section ", "the battle of "]), f"{rng.choice([1804, 1912, 1944, 2001])} Foundry Road", " was closed", False),
    ])


def make(rng, n):
    rows, truth = [], []
    for i in range(n):
        kind, before, span, after, personal = planted(rng)
        words = [rng.choice(FILLER) for _ in range(rng.randint(30, 60))]
        at = rng.randint(14, len(words) - 14)
        head = " ".join(words[:at]) + " " + before
        rows.append((i, head + span + after + " " + " ".join(words[at:])))
        truth.append((kind, len(head), len(head) + len(span), personal))
    return rows, truth


@pytest.fixture(scope="module")
def scored(spark):
    """Trained on one made corpus, scored on another."""
    schema = "doc_id long, text string"
    rows, _ = make(random.Random(31), 1500)
    found = spark.createDataFrame(rows, schema).select(pii.F.explode(pii.candidates(pii.F.col("text"))).alias("c")).select("c.*")
    model = pii.train(found)
    rows, truth = make(random.Random(32), 1500)
    got = {r.doc_id: {(pii.KINDS[s.kind], s.start, s.end) for s in r.personal} for r in pii.find_personal_data(spark.createDataFrame(rows, schema), model).collect()}
    return rows, truth, got, model


def test_precision_and_recall_of_added_spans_by_kind(scored):
    rows, truth, got, _ = scored
    figures = {}
    for kind in ("phone", "email", "iban", "id", "name", "address"):
        wanted = {(i, kind, a, b) for i, (k, a, b, personal) in enumerate(truth) if k == kind and personal}
        found = {(i, *s) for i, spans in got.items() for s in spans if s[0] == kind}
        figures[kind] = len(wanted & found) / len(wanted), len(wanted & found) / max(1, len(found))
    print(figures)
    assert all(recall >= 0.9 and precision >= 0.9 for recall, precision in figures.values()), figures


def test_failed_matches_of_the_base_are_never_added(spark):
    """Addresses with a part over 255, numbers that fail Luhn and short phones stay out, however the votes fall."""
    rng = random.Random(33)
    rows = []
    for i in range(200):
        bad = rng.choice([f"300.12.{i}.9", f"1.2.3.{256 + i}", "4111 1111 1111 1112", "4222222222222225", "+1 (22) 33", f"+{'1' * 17}"])
        rows.append((i, f"my ip address, credit card and phone: {bad} contact visa login from client"))
    rows += [(1000 + i, f"login from 10.0.0.{i} card 4111 1111 1111 1111 phone +1 (017) 555-7713 a@b.co") for i in range(50)]
    forms = {"ip": r"[0-9]+(\.[0-9]+){3}", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    texts = dict(rows)
    for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        added = [s for s in r.personal if r.doc_id < 1000]
        for s in added:
            kind = pii.KINDS[s.kind]
            assert kind not in forms or not re.fullmatch(forms[kind], texts[r.doc_id][s.start : s.end]), texts[r.doc_id]
        if r.doc_id >= 1000:
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)


def test_a_text_of_megabytes_and_awkward_texts(spark):
    long = ("word Anna Kessler 12 Maple Street " * 100 + "x" * 5000 + " 1.2.3.4 ") * 200
    rows = [(1, long), (2, None), (3, ""), (4, "A" * 100_000), (5, "Anna " * 20_000), (6, "1 Aa " * 50_000), (6, "Anna Kessler"), (6, "Anna Kessler")]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert next(r for r in got if r.doc_id == 1).n_ip == 200
    assert len({r.spans for r in got if r.doc_id == 6 and len(r.personal) < 100}) <= 2
