"""A byte-level BPE vocabulary as arrays, and the split of texts into pre-tokens.

The file is read on the driver and travels to the tasks as its own text (some
1.5 MB, whatever the corpus holds), so executors need no copy of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import SparkSession

# Fixed value: the published pattern of byte-level pre-tokens.
PIECE = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
# Code points that newer tables count as letters or digits and the published split as neither.
NEITHER = (
    "558, 58B-58C, 88F, C5C, CDC, 208F, 209D-209F, A7CE-A7CF, A7D2, A7D4, A7DD, A7E2, A7F1, AB6C-AB6D, 107BB-107BF, "
    "10940-10959, 10EC5-10EC7, 10ED9-10EEE, 11B0A, 11DB0-11DDB, 11DE0-11DE9, 11DF1, 1246F, 12475-1247F, "
    "12550-12686, 16EA0-16EB8, 16EBB-16ED3, 16FF2-16FF6, 187F8-187FF, 18CD6-18CDA, 18D09-18D20, 18D80-18DF2, "
    "18E00-19191, 191A0-191D2, 1B123-1B128, 1B168, 1D6A6, 1DF1F-1DF24, 1DF2B-1DF81, 1DF90-1DF96, 1DFCD-1DFFF, "
    "1E6C0-1E6DE, 1E6E0-1E6E2, 1E6E4-1E6E5, 1E6E7-1E6ED, 1E6F0-1E6F4, 1E6FE-1E6FF, 2B73A-2B73F, 2B81E, 2CEA2-2CEAD, "
    "323B0-33479, 3D000-3FC3F "
)
_NEITHER = "".join("-".join(rf"\U{int(x, 16):08X}" for x in run.split("-")) for run in NEITHER.replace(",", " ").split())
#: the same split where such code points occur
RARE_PIECE = (PIECE.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|[{_NEITHER}])")
              .replace(r"\p{L}+", rf"(?:(?![{_NEITHER}])\p{{L}})+", 1).replace(r"\p{N}+", rf"(?:(?![{_NEITHER}])\p{{N}})+", 1))
#: a text longer than this is split piece by piece and not as one list
LONG_TEXT = 1 << 20
#: a pre-token longer than this many bytes is never remembered
LONG_PIECE = 64
NONE = np.iinfo(np.int32).max


def printable_bytes() -> dict[str, int]:
    """The byte each character of a vocabulary file stands for: printable bytes stand for themselves,
    the others in order for the characters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteVocab:
    """Token bytes by id, ranks and products of mergeable pairs, ids of single bytes, special strings."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                 and not split.get("add_prefix_space") and not spec.get("normalizer") and not model.get("dropout")
                 and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
                 and not model.get("end_of_word_suffix"))
        if not plain:
            raise ValueError("not a plain byte-level BPE file")
        byte_of, ids = printable_bytes(), model["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens: list[bytes] = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for token, i in ids.items():
            self.tokens[i] = bytes(byte_of[c] for c in token)
        for token, i in added.items():
            self.tokens[i] = token.encode()
        self.special = added
        self.byte_ids = np.array([ids.get(c, -1) for c, _ in sorted(byte_of.items(), key=lambda x: x[1])], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.product = np.array([ids[a + b] for a, b in pairs], np.int32)  # by rank
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        self._order = np.argsort(keys, kind="stable").astype(np.int32)
        self._keys = keys[self._order]
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self._piece, self._rare_piece, self._rare = map(regex.compile, (PIECE, RARE_PIECE, f"[{_NEITHER}]"))
        self._cut = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where they do not merge."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._order[at], NONE).astype(np.int32)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Lists of pre-tokens that make up the text; a special string is a list of its own with a leading None."""
        at = 0
        for m in self._cut.finditer(text) if self._cut else ():
            yield from self._split(text[at:m.start()])
            yield [None, m[0]]
            at = m.end()
        yield from self._split(text[at:] if at else text)

    def _split(self, text: str) -> Iterator[list[str]]:
        piece = self._piece if text.isascii() or not self._rare.search(text) else self._rare_piece
        if len(text) <= LONG_TEXT:
            yield piece.findall(text)
            return
        some: list[str] = []
        for m in piece.finditer(text):
            some.append(m[0])
            if len(some) >= LONG_TEXT // 8:
                yield some
                some = []
        yield some

    def symbols(self, piece: str) -> np.ndarray:
        return self.byte_ids[np.frombuffer(piece.encode(), np.uint8)]


def vocabulary(spark: SparkSession, path: str):
    """A broadcast of the file's text; ``ByteVocab(b.value)`` in a task. A wrong kind of file raises here."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    ByteVocab(text)
    return spark.sparkContext.broadcast(text)


class Remembered:
    """Results by pre-token, made for many new ones at a time; emptied when ``most`` are held."""

    def __init__(self, vocab: ByteVocab, make, most: int = 400_000):
        self.vocab, self.make, self.most, self.known = vocab, make, most, {}

    def of(self, texts: list[str], special) -> Iterator[tuple[int, list]]:
        """(number of the text, results of its next pre-tokens), in order; ``special(id)`` is a special string's result."""
        lists = [(k, p) for k, text in enumerate(texts) for p in self.vocab.pieces(text)]
        wanted = set().union(*(p for _, p in lists if p and p[0] is not None))
        if len(self.known) > self.most:
            self.known = {}
        new = [x for x in wanted if x not in self.known]
        made = dict(zip(new, self.make(new), strict=True))
        self.known |= {k: v for k, v in made.items() if len(k) <= LONG_PIECE}
        long = {k: v for k, v in made.items() if len(k) > LONG_PIECE}
        for k, p in lists:
            if p and p[0] is None:
                yield k, [special(self.vocab.special[p[1]])]
            elif long and not long.keys().isdisjoint(p):
                yield k, [long[x] if x in long else self.known[x] for x in p]
            else:
                yield k, list(map(self.known.__getitem__, p))
