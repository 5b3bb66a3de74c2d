"""Personal data by pattern, checksum and context (operator 9).

Regular expressions propose spans; validators confirm them (Luhn for card numbers, ISO 7064
mod 97 for bank accounts, ranges for the rest); words close by raise a span's score. E-mail and
IP addresses, card and phone numbers that pass their checks always count (the base). Further
kinds count when their score, context included, reaches ``MIN_SCORE``: bank accounts (iban),
card numbers of 13 to 15 digits (shortcard) and social security numbers (ssn).

Null texts are empty. Offsets are code points, ends exclusive. Patterns run in time linear in
the text (anchored or possessive), however long a run of digits or letters is.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the contract: the base patterns and their order.
BASE_KINDS = ("email", "ip", "card", "phone")
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Length of an account number by country; others may have any.
IBAN_LENGTH = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "AE BG BH CR DE GB GE IE ME RS VA", 23: "GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
WORD = re.compile(r"[a-z]+")

SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "shortcard": 0.4, "ssn": 0.4}
CONTEXT = {
    "email": "mail email contact write", "ip": "ip address host server", "card": "card visa mastercard credit payment",
    "phone": "phone call tel telephone mobile fax", "iban": "iban account bank konto compte cuenta",
    "shortcard": "card amex visa diners credit payment", "ssn": "ssn social security",
}
_NEAR = {kind: frozenset(words.split()) for kind, words in CONTEXT.items()}
#: Context is looked for in so many characters before and after a span.
REACH, BOOST, MIN_SCORE = 40, 0.3, 0.7

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    # the part before @ is the longest run of its characters, not reaching into the match before
    since, at = 0, text.find("@")
    while at >= 0:
        start = since + len(text[since:at].rstrip(LOCAL_PART))
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield "email", start, found.end()
        since = found.end() if found else at + 1
        at = text.find("@", since)


def _accounts(text: str) -> Iterator[tuple[str, int, int]]:
    # the pattern may take in upper-case words that follow: of the group ends that pass the check
    # the one at the country's length counts, else the last
    m = IBAN.search(text)
    while m:
        start, end = m.span()
        ends = []
        while end > start:
            account = text[start:end].replace(" ", "")
            if 15 <= len(account) <= 34 and mod97(account):
                ends.append((len(account) != IBAN_LENGTH.get(account[:2]), -end))
            end = text.rfind(" ", start, end)
        end = -min(ends)[1] if ends else start + 1
        if ends:
            yield "iban", start, end
        m = IBAN.search(text, end)


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card" if len(digits) >= 16 else "shortcard", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield "phone", *m.span()
    yield from _accounts(text)
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "ssn", *m.span()


def find(text: str | None) -> list[Span]:
    """(kind, start, end, score) of every span, by kind in the order of SCORES, then start."""
    text = text or ""
    out = []
    for kind, start, end in (*_emails(text), *_numbers(text)):
        around = f"{text[max(0, start - REACH):start]} {text[end:end + REACH]}".lower()
        score = min(1.0, SCORES[kind] + BOOST * (not _NEAR[kind].isdisjoint(WORD.findall(around))))
        if kind in BASE_KINDS or score >= MIN_SCORE:
            out.append((kind, start, end, score))
    order = list(SCORES)
    return sorted(out, key=lambda s: (order.index(s[0]), s[1]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, _ in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, found (array of kind, start, end, score)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(t)]
                     for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "found"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, found array<struct<kind:string,start:int,end:int,score:double>>")


def redact(text: str | None) -> str | None:
    """``text`` with every span replaced by its kind in brackets (overlapping spans: the first)."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end, _ in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(_joined([s for s in spans if s[0] in BASE_KINDS]).encode()).hexdigest()
