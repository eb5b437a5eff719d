"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

The four base kinds (email, ip, card, phone) are kept whatever their score. The
added kinds need ``min_score``: an account number (iban) passes by its mod-97
checksum, a social security number or a secret needs a word that names it.
Patterns are written so that a text is scanned in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, id_text, map_rows

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret", "ssn")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_DIGITS = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}={0,2}")
_WORD = re.compile(r"[a-z]+")

# Words that name a kind, and words that speak against it.
FOR = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "address", "host", "server"},
    "card": {"card", "visa", "mastercard", "credit", "debit"},
    "phone": {"phone", "tel", "call", "mobile", "fax"},
    "iban": {"iban", "account", "bank", "konto"},
    "secret": {"token", "secret", "password", "passwd", "apikey", "key", "credential"},
    "ssn": {"ssn", "social", "security"},
}
AGAINST = {
    "ip": {"version", "release", "build", "section"},
    "card": {"isbn", "order", "tracking", "serial"},
    "iban": {"example", "part", "serial"},
    "secret": {"commit", "digest", "checksum", "sha"},
    "ssn": {"order", "part", "serial"},
}
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "secret": 0.4, "ssn": 0.4}


@dataclass(frozen=True)
class Settings:
    reach: int = 40  # characters before a span in which words count
    step: float = 0.3  # what a word adds or takes
    min_score: float = 0.5  # of the added kinds


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod_97(account: str) -> bool:
    """Whether an account number without blanks has the right check digits."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def _numbers(pattern: re.Pattern, least: int, most: int, confirm=None) -> callable:
    def find(text: str) -> Iterator[tuple[int, int]]:
        for m in pattern.finditer(text):
            if m.end() - m.start() < least:
                continue
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (confirm is None or confirm(digits)):
                yield m.span()

    return find


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        # leading zeros do not count; more than three other digits are beyond 255
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        found = m[0]
        while len(found.replace(" ", "")) >= 15:
            if mod_97(found.replace(" ", "")):
                yield m.start(), m.start() + len(found)
                break
            # the last group may be an ordinary word
            found = found.rpartition(" ")[0]


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in _SECRET.finditer(text):
        if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
            yield m.span()


_FIND = {
    "email": _emails,
    "ip": _ips,
    "card": _numbers(_DIGITS, 13, 19, luhn),
    "phone": _numbers(_PHONE, 9, 15),
    "iban": _ibans,
    "secret": _secrets,
    "ssn": lambda text: (m.span() for m in _SSN.finditer(text)),
}


def score(kind: str, text: str, start: int, settings: Settings) -> float:
    """The kind's own score, moved once by words for it and once by words against it in the characters before."""
    words = set(_WORD.findall(text[max(0, start - settings.reach):start].lower()))
    moved = SCORE[kind] + settings.step * (bool(words & FOR[kind]) - bool(words & AGAINST.get(kind, set())))
    return round(min(1.0, max(0.0, moved)), 3)


def spans_of(text: str, settings: Settings = Settings()) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind in the order of KINDS, then start; places are code points."""
    found = []
    for kind in KINDS:
        for start, end in _FIND[kind](text):
            s = score(kind, text, start, settings)
            if kind in BASE or s >= settings.min_score:
                found.append((kind, start, end, s))
    return found


def redacted(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind in angle brackets; spans that overlap are one, named by the first."""
    out, last = [], 0
    for start, end, kind in sorted((s[1], s[2], s[0]) for s in spans):
        if start >= last:
            out += [text[last:start], f"<{kind.upper()}>"]
        last = max(last, end)
    return "".join([*out, text[last:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, redacted) per row.

    ``spans`` holds structs (kind, start, end, score) in the order of ``spans_of``.
    A null text is an empty one: no spans, an empty text. Repeated rows and null
    ids stay rows of their own; other columns go. Empty tables give empty tables.
    """

    def make():
        def step(rows):
            found = [spans_of(t, settings) for t in rows["text"]]
            return {
                "doc_id": rows["doc_id"],
                "spans": [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in x] for x in found],
                "redacted": [redacted(t, s) for t, s in zip(rows["text"], found, strict=True)],
            }

        return step

    arrow = pa.schema([("doc_id", pa.int64()), ("spans", _SPANS), ("redacted", pa.string())])
    schema = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>, redacted string"
    return map_rows(id_text(docs, id_col, text_col), make, schema, arrow)


def redact(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The columns of documents, personal data in ``text`` replaced and ``n_chars`` counted anew; a null text stays null."""

    def make():
        def step(rows):
            rows["text"] = [t if t is None else redacted(t, spans_of(t, settings)) for t in rows["text"]]
            rows["n_chars"] = [n if t is None else len(t) for t, n in zip(rows["text"], rows["n_chars"], strict=True)]
            return rows

        return step

    kinds = {"bigint": pa.int64(), "string": pa.string()}
    arrow = pa.schema([(c, kinds[k]) for c, k in DOCUMENT_COLUMNS.items()])
    narrow = docs.select(*[F.col(c).cast(k).alias(c) for c, k in DOCUMENT_COLUMNS.items()])
    return map_rows(narrow, make, ", ".join(f"{c} {k}" for c, k in DOCUMENT_COLUMNS.items()), arrow)


def listed(spans, kinds: tuple[str, ...]):
    """kind:start:end of the spans of these kinds, comma-joined in their order."""
    kept = F.filter(spans, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
