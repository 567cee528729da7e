"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby move the score.

Four base kinds (e-mail and IP addresses, card numbers by Luhn, international phone
numbers) are reported wherever their pattern and check hold. Three more kinds have
patterns that also fit harmless numbers, so their score decides: bank accounts (IBAN,
modulus 97), social security numbers and national phone numbers. A span's score is the
kind's own, plus `NEAR` for a word of its context within `WINDOW` code points and minus
as much for a word that speaks against it.

The patterns run in time linear in the text: each is anchored at the characters a
match has to hold or begin with, and never backs out of a run of characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.llm.common import columns_or_raise

#: Order in which kinds are listed; the first four are the base.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "national_phone"]
BASE = KINDS[:4]
#: Score of a confirmed span without any context.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.9, "ssn": 0.4, "national_phone": 0.3}
#: Words that speak for a kind (as prefixes, any case).
CONTEXT = {
    "email": ["mail", "contact", "write"], "ip": ["ip", "host", "server", "address", "login"],
    "card": ["card", "visa", "mastercard", "amex", "credit", "payment"], "phone": ["phone", "tel", "call", "mobile", "fax", "cell"],
    "iban": ["iban", "account", "bank", "konto", "compte", "cuenta"], "ssn": ["ssn", "social", "security"],
    "national_phone": ["phone", "tel", "call", "mobile", "fax", "cell"],
}
#: Words that speak against every kind.
AGAINST = ["version", "order", "invoice", "isbn", "serial", "sample", "example"]
NEAR = 0.3
WINDOW = 40
#: Spans of further kinds are reported from this score on.
THRESHOLD = 0.6

SPAN = "array<struct<kind:string,start:int,end:int,score:double,value:string>>"
#: Number of characters of an account by country.
ACCOUNT_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "TR": 26,
}

DOMAIN = r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: An address from where a run of its characters begins, and from any place.
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@" + DOMAIN)
EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++@" + DOMAIN)
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
#: Digits joined by single blanks or hyphens.
DIGITS = re.compile(r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,27}")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
NATIONAL = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Sum of digits, every second one from the right doubled and cut to one digit, ends in 0."""
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return (sum(map(int, digits[-1::-2])) + sum(doubled[int(d)] for d in digits[-2::-2])) % 10 == 0


def mod_97(account: str) -> bool:
    """The account with its first four characters moved back and letters as numbers from 10 on leaves 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses; one may begin right where the last one ended, in the middle of a run."""
    m = EMAIL.search(text)
    while m:
        yield m.span()
        m = EMAIL_HERE.match(text, m.end()) or EMAIL.search(text, m.end())


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Accounts of their country's length whose checksum holds."""
    for m in ACCOUNT.finditer(text):
        length, end = ACCOUNT_LENGTHS.get(m.group()[:2], 0), m.start()
        taken = []
        while end < m.end() and len(taken) < length:
            if text[end] != " ":
                taken.append(text[end])
            end += 1
        if length and len(taken) == length and not text[end:end + 1].isalnum() and mod_97("".join(taken)):
            yield m.start(), end


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that pattern and checksum confirm, by kind as listed, then by place."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end
    for m in ADDRESS.finditer(text):
        if all(map(_small, m.group().split("."))):
            yield "ip", m.start(), m.end()
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NO_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NO_DIGIT.sub("", m.group())) <= 15:
                yield "phone", m.start(), m.end()
    for start, end in accounts(text):
        yield "iban", start, end
    for kind, pattern in (("ssn", SSN), ("national_phone", NATIONAL)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def _word_patterns() -> dict[str, re.Pattern]:
    return {kind: re.compile(r"\b(?:" + "|".join(words) + ")", re.IGNORECASE)
            for kind, words in [*CONTEXT.items(), ("against", AGAINST)]}


def find(text: str | None, patterns: dict[str, re.Pattern], threshold: float) -> list[tuple[str, int, int, float, str]]:
    """Spans of a text with their score: all of the base, and others that reach the threshold and overlap no base span."""
    if not text:
        return []
    spans, starts, ends = [], [], None
    for kind, start, end in confirmed(text):
        base = kind in BASE
        if base:
            starts.append((start, end))
        else:
            if ends is None:  # The furthest end of all base spans up to each of them, in order of place.
                starts.sort()
                ends = list(accumulate((e for _, e in starts), max))
            before = bisect_left(starts, (end, 0))
            if before and ends[before - 1] > start:
                continue
        around = f"{text[max(0, start - WINDOW):start]} {text[end:end + WINDOW]}"
        moved = bool(patterns[kind].search(around)) - bool(patterns["against"].search(around))
        score = round(min(1.0, max(0.0, SCORES[kind] + NEAR * moved)), 6)
        if base or score >= threshold:
            spans.append((kind, start, end, score, text[start:end]))
    return spans


def personal_spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of `docs` with ``spans``: kind, start, end (code points, exclusive), score and value of each.

    Spans are ordered by kind as in `KINDS`, then by place; spans of one kind never
    overlap, spans of two base kinds may. ``threshold`` applies to kinds beyond the base.

    A null or empty text has no spans. Texts are searched whole, however long, in time
    linear in their length. Equal texts get equal spans. An empty table stays empty. A
    column named ``spans`` is replaced; all other columns stay and none is read but the text.
    """
    columns_or_raise(docs, "text")

    @F.pandas_udf(SPAN)
    def spans(texts: pd.Series) -> pd.Series:
        patterns = _word_patterns()
        names = ("kind", "start", "end", "score", "value")
        return pd.Series([[dict(zip(names, s)) for s in find(t, patterns, threshold)] for t in texts])

    return docs.withColumn("spans", spans(F.col("text")))


def n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column, base_only: bool = False) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(BASE)) if base_only else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping ones the first, then longest, names it.

    A null text stays null.
    """
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("done"), F.array().cast("array<string>").alias("pieces"))

    def step(state: Column, s: Column) -> Column:
        fresh = F.array(F.substring(text, state["done"] + 1, s["start"] - state["done"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        pieces = F.when(s["start"] >= state["done"], F.concat(state["pieces"], fresh)).otherwise(state["pieces"])
        return F.struct(F.greatest(state["done"], -s["back"]).alias("done"), pieces.alias("pieces"))

    return F.aggregate(by_place, start, step, lambda state: F.concat(
        F.array_join(state["pieces"], ""), F.substring(text, state["done"] + 1, F.length(text))))
