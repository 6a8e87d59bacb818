"""Rule tables for bookings and receipts, and their application, for German bank and till texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstack.functions.scalars import OTHER

#: Kinds of booking, the first that matches the bank's own words.
TX_TYPES = [
    ("lastschrift", r"lastschrift|sepa.?direct.?debit|einzug"),
    ("dauerauftrag", r"dauerauftrag|standing order"),
    ("gehalt", r"lohn|gehalt|salary|bezüge"),
    ("kartenzahlung", r"karten?zahlung|girocard|debitkarte|kreditkarte|card payment"),
    ("bargeld", r"bargeld|geldautomat|auszahlung|atm"),
    ("gebuehr", r"entgelt|gebühr|abschluss|kontoführung"),
    ("zinsen", r"zins|dividende"),
    ("ueberweisung", r"überweisung|ueberweisung|gutschrift|transfer|echtzeit"),
]

#: What a transaction may be filed under, and the kinds it may have (fixed values).
TX_CATEGORIES = (
    "miete", "nebenkosten", "lebensmittel", "essen-ausser-haus", "mobilitaet", "versicherung", "abonnement", "gesundheit", "freizeit", "bekleidung", "elektronik", "haushalt",
    "bildung", "spende", "gehalt", "rente-zuschuss", "erstattung", "zins-dividende", "uebertrag", "bargeld", "gebuehr", "steuer", "sonstiges",
)
TX_KINDS = ("ueberweisung", "lastschrift", "dauerauftrag", "kartenzahlung", "bargeld", "gehalt", "gebuehr", "zinsen", "uebertrag", "sonstiges")

#: Categories by who was paid and for what, the first that matches.
CATEGORIES = [
    ("lebensmittel", r"supermarkt|lebensmittel|bäcker|metzger|discounter|wochenmarkt"),
    ("haushalt", r"drogerie|parfümerie|baumarkt|möbel"),
    ("gesundheit", r"apotheke|arzt|praxis|klinik"),
    ("mobilitaet", r"tankstelle|bahn|bus|taxi|parkhaus|werkstatt"),
    ("miete", r"miete|hausverwaltung"),
    ("nebenkosten", r"nebenkosten|grundsteuer|strom|gas(?:werk|versorg)|stadtwerk|fernwärme|rundfunk"),
    ("abonnement", r"mobilfunk|internet|telefon|streaming|fitness"),
    ("versicherung", r"versicherung|krankenkasse|haftpflicht"),
    ("essen-ausser-haus", r"restaurant|café|imbiss|pizzeria|lieferdienst"),
    ("freizeit", r"kino|theater|verein"),
    ("rente-zuschuss", r"rente|kindergeld|wohngeld"),
    ("gehalt", r"gehalt|lohn"),
    ("erstattung", r"erstattung|rückzahlung"),
]

#: What a till prints, by what it is for. A phrase is found whole, in any case, with blanks, dots, colons or hyphens between its words; # is a number.
TILL_PHRASES = {
    "slip": ("kassenbon", "kassenzettel", "kassenbeleg", "quittung", "bon nr", "bonnummer", "bon #", "beleg nr", "belegnummer"),
    "till": ("kasse #", "kassen nr", "kassennummer", "filiale #", "markt #"),
    "served": ("es bediente sie", "sie wurden bedient", "bediener", "kassierer", "kassiererin"),
    "total": ("zu zahlen", "summe eur", "gesamt eur", "zwischensumme", "gesamtbetrag eur"),
    "cash": ("rückgeld", "wechselgeld", "gegeben bar", "bar gegeben"),
    "card": ("girocard", "ec karte", "kartenzahlung", "kontaktlos", "karte kontaktlos", "contactless"),
    "terminal": ("terminal id", "terminal nr", "terminalnummer", "trace nr", "vu nr"),
    "approval": ("genehmigungsnummer", "genehmigungs nr", "autorisierungsnummer", "emv aid", "emv daten"),
    "copy": ("kundenbeleg", "händlerbeleg", "beleg für den kunden"),
    "tax": ("mwst # %", "mwst a # %", "mwst b # %", "ust # %", "steuer netto brutto", "netto mwst brutto"),
    "fiscal": ("tse signatur", "tse transaktion", "tse seriennummer", "signaturzähler", "transaktionsnummer"),
    "deposit": ("pfand", "einwegpfand", "mehrwegpfand", "pfandbon", "leergut"),
    "points": ("bonuspunkte", "treuepunkte", "payback", "punktestand"),
    "thanks": ("danke für ihren einkauf", "vielen dank für ihren einkauf", "danke für ihren besuch", "vielen dank für ihren besuch"),
    "returns": ("umtausch nur mit", "umtausch innerhalb", "rückgabe nur mit"),
    "counted": ("anzahl artikel", "# artikel", "posten #", "stück #"),
    "table": ("tisch #", "tisch nr", "trinkgeld"),
    "fuel": ("zapfsäule", "säule #", "preis je liter"),
}
#: What an invoice says and a till doesn't.
INVOICE_PHRASES = {
    "numbered": ("rechnungsnummer", "rechnungs nr", "rechnung nr"),
    "payable": ("zahlbar bis", "zahlbar innerhalb", "fällig am", "zahlungsziel", "zahlungsfrist"),
    "transfer": ("überweisen sie", "bitte überweisen", "unsere bankverbindung"),
    "contract": ("vertragsnummer", "versicherungsnummer", "versicherungsschein", "kundennummer"),
}


def phrase_pattern(phrases: tuple[str, ...]) -> str:
    """A pattern that both engines read: any of the phrases, with no letter or digit beside it. Umlauts may be written out."""
    written = {"ä": "(?:ä|ae)", "ö": "(?:ö|oe)", "ü": "(?:ü|ue)", "ß": "(?:ß|ss)", "#": "[0-9]+(?:[.,][0-9]+)?", "%": "%"}
    spelled = ["[ \\t.:\\-]*".join("".join(written.get(c, c) for c in word) for word in p.split()) for p in phrases]
    return rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(spelled)})(?:$|[^\p{{L}}\p{{N}}])"


SIGNALS = [(name, phrase_pattern(phrases)) for name, phrases in TILL_PHRASES.items()]
BLOCKERS = [(name, phrase_pattern(phrases)) for name, phrases in INVOICE_PHRASES.items()]


def with_shops(shops: tuple[str, ...]) -> list[tuple[str, str]]:
    """SIGNALS, and one more for the names of shops, if any are given."""
    return SIGNALS + ([("shop", phrase_pattern(tuple(s.lower() for s in shops)))] if shops else [])


def first_match(text: Column, rules: list[tuple[str, str]], default: str = OTHER) -> Column:
    """The name of the first rule whose pattern occurs in the text, case aside, umlauts included."""
    out = None
    for name, pattern in rules:
        test = F.coalesce(text, F.lit("")).rlike(f"(?iu){pattern}")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def signal_names(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The names of all rules whose pattern occurs."""
    body = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*(F.when(body.rlike(f"(?iuU){p}"), n) for n, p in rules)))


def tx_type(booking_text: Column, counterparty: Column | None = None, purpose: Column | None = None) -> Column:
    """The kind of a booking by the bank's words, who was paid and for what, whichever are given, read as one text."""
    given = [F.coalesce(c, F.lit("")) for c in (booking_text, counterparty, purpose) if c is not None]
    return first_match(F.concat_ws(" ", *given), TX_TYPES)


def category(counterparty: Column, purpose: Column) -> Column:
    return first_match(F.concat_ws(" ", counterparty, purpose), CATEGORIES)


def is_receipt(text: Column, shops: tuple[str, ...] = ()) -> Column:
    """Two signals or more, and under two of what invoices say. Names of shops are plain words."""
    return (F.size(signal_names(text, with_shops(shops))) >= 2) & (F.size(signal_names(text, BLOCKERS)) < 2)
