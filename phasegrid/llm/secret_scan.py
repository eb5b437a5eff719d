"""Secrets: shapes of known credentials, and windows of candidate strings whose letters are too evenly spread for words.

The three base kinds (assign, access, hex) follow fixed patterns. The added kinds
come from Shannon entropy: inside every candidate string a window slides over
each run of a character class. The counts of its characters are kept, so a
step costs one character in and one out whatever the window's width. Windows at
or above the class's threshold are merged into spans. An allow-list takes spans
away again that look like identifiers, paths, placeholders or announced digests;
it never touches a base span.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_rows

BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
#: one of these is in every assignment, in lower case
_NAMES = ("passw", "secret", "token", "api")
# a run that is long enough begins where any of its matches would, so the length may stand in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")


@dataclass(frozen=True)
class CharClass:
    """Strings of ``letters`` (a regex set); a window is secret-like from ``bits`` of entropy on, if it has a digit and a letter."""

    name: str
    letters: str
    window: int
    bits: float


# Fixed values. Random strings of a class have about 3.4, 3.8 and 4.2 bits in such windows, words of prose 3.0 to 3.6.
CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", 20, 3.0),
    CharClass("entropy_lower", "0-9a-z", 20, 3.55),
    CharClass("entropy_mixed", "0-9A-Za-z+/_=-", 24, 3.9),
)
# Harmless reasons for a high entropy, inside a candidate and right before a span.
ALLOW = (
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"(?i:example|sample|dummy|changeme|placeholder|x{6}|abcdefgh|01234567|12345678)",
    r"(?:[A-Za-z]{3,}[/_.=-]+){2,}[A-Za-z]{3,}",
)
ALLOW_BEFORE = (
    r"(?i:commit|checksum|digest|integrity|fingerprint|etag|uuid|md5|sha-?[0-9]{1,3})[\"']?\s*[:=(-]?\s*[\"']?$",
    r"https?://[^\s\"'<>]*$",
)
KINDS = (*BASE, *(c.name for c in CLASSES))


@dataclass(frozen=True)
class Settings:
    classes: tuple[CharClass, ...] = CLASSES
    candidate: str = r"(?<![0-9A-Za-z+/_=.-])[0-9A-Za-z+/_=.-]{20,}"  # strings that may hold one
    allow: tuple[str, ...] = ALLOW
    allow_before: tuple[str, ...] = ALLOW_BEFORE
    reach: int = 64  # characters before a span in which ``allow_before`` is sought


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) by kind; matches that are too short are consumed and dropped."""
    lowered = text.lower()
    if any(n in lowered for n in _NAMES):
        for m in _ASSIGN.finditer(text):
            if len(m[1]) >= 12:
                yield "assign", *m.span()
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        for m in pattern.finditer(text):
            yield kind, *m.span()


#: entropies are compared as whole numbers, so that a window's value does not depend on the way it was reached
_UNIT = 1 << 40


class SlidingEntropy:
    """Entropy of the last ``width`` characters fed, from their counts.

    With counts c the entropy is log2 w - (sum of c log2 c) / w; feeding a character changes two terms of the sum.
    """

    def __init__(self, width: int, bits: float):
        self.width = width
        self._term = [0, *(round(c * math.log2(c) * _UNIT) for c in range(1, width + 1))]
        self._most = math.floor(width * (math.log2(width) - bits) * _UNIT)

    def windows(self, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
        """Merged spans of the windows in ``text[start:end]`` that are evenly spread and hold a digit and a letter."""
        width, term, most = self.width, self._term, self._most
        counts: dict[str, int] = {}
        total = digits = letters = 0
        first = last = -1
        for at in range(start, end):
            if at - start >= width:
                c = text[at - width]
                n = counts[c]
                counts[c] = n - 1
                total -= term[n] - term[n - 1]
                digits -= c.isdigit()
                letters -= c.isalpha()
            c = text[at]
            n = counts.get(c, 0)
            counts[c] = n + 1
            total += term[n + 1] - term[n]
            digits += c.isdigit()
            letters += c.isalpha()
            if at - start + 1 >= width and total <= most and digits and letters:
                begin = at + 1 - width
                if first >= 0 and begin > last:
                    yield first, last
                    first = begin
                elif first < 0:
                    first = begin
                last = at + 1
        if first >= 0:
            yield first, last


class Scanner:
    """Patterns and tables of one task."""

    def __init__(self, settings: Settings = Settings()):
        self.settings = settings
        self._candidate = re.compile(settings.candidate)
        self._classes = [
            (c.name, re.compile(rf"[{c.letters}]{{{c.window},}}"), SlidingEntropy(c.window, c.bits)) for c in settings.classes]
        self._allow = [re.compile(p) for p in settings.allow]
        self._before = [re.compile(p) for p in settings.allow_before]

    def entropy_spans(self, text: str) -> list[tuple[str, int, int]]:
        """(class, start, end); what a narrower class, listed earlier, covers is not reported again."""
        found: list[tuple[str, int, int]] = []
        for m in self._candidate.finditer(text):
            here: list[tuple[str, int, int]] = []
            for name, runs, entropy in self._classes:
                for run in runs.finditer(text, *m.span()):
                    for s, e in entropy.windows(text, *run.span()):
                        if not any(t <= s and e <= f for _, t, f in here):
                            here.append((name, s, e))
            if here:
                allowed = [x.span() for p in self._allow for x in p.finditer(text, *m.span())]
                found += [h for h in here if not any(t < h[2] and h[1] < f for t, f in allowed) and not self._announced(text, h[1])]
        return found

    def _announced(self, text: str, start: int) -> bool:
        before = text[max(0, start - self.settings.reach):start]
        return any(p.search(before) for p in self._before)

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All spans by start, then kind in the order of the base kinds and the classes, then end."""
        order = {k: i for i, k in enumerate((*BASE, *(c.name for c in self.settings.classes)))}
        found = [*base_spans(text), *self.entropy_spans(text)]
        return sorted(found, key=lambda s: (s[1], order[s[0]], s[2]))


def masked(text: str, spans: list[tuple[str, int, int]], mark: str = "<SECRET>") -> str:
    """The text with every span, or union of spans that overlap, replaced by ``mark``."""
    out, last = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= last:
            out += [text[last:start], mark]
        last = max(last, end)
    return "".join([*out, text[last:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, masked) per row.

    ``spans`` holds structs (kind, start, end) in code points, end exclusive, by
    start and then kind; ``masked`` is the text without them. A null text is an
    empty one: no spans, an empty text. Repeated rows and null ids stay rows of
    their own; other columns go, whatever their names. Empty tables give empty
    tables. A text of any length is scanned whole, in linear time.
    """

    def make():
        scanner = Scanner(settings)

        def step(rows):
            found = [scanner.spans(t) for t in rows["text"]]
            return {
                "doc_id": rows["doc_id"],
                "spans": [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in found],
                "masked": [masked(t, s) for t, s in zip(rows["text"], found, strict=True)],
            }

        return step

    arrow = pa.schema([("doc_id", pa.int64()), ("spans", _SPANS), ("masked", pa.string())])
    schema = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>, masked string"
    return map_rows(id_text(docs, id_col, text_col), make, schema, arrow)


def listed(spans, kinds: tuple[str, ...]):
    """kind:start:end of the spans of these kinds, comma-joined in their order."""
    kept = F.filter(spans, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
