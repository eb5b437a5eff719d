"""The base spans against the patterns as they are stated, entropies against a plain sum, and the allow-list."""

import math
import random
import re
import string

import pytest

from phasegrid.llm import queries, secret_scan
from phasegrid.llm.secret_scan import BASE, CLASSES, Scanner, SlidingEntropy, find_secrets, masked

from .cases import AWKWARD, awkward, empty

STATED = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
               r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def brute(text):
    found = [(k, *m.span()) for k, (p, good) in STATED.items() for m in re.finditer(p, text) if good(m)]
    return sorted(found, key=lambda s: (s[1], BASE.index(s[0])))


def test_base_spans_on_random_texts():
    rnd = random.Random(11)
    parts = ["password", "PassWD", "token", "secret", "api_key", "APIKEY", "apikey", "=", ":", " ", "'", '"', "AKIA", "ABCDEFG7",
             "0123456789abcdef", "abc", "x-y_z.=", "é", "ſecret", "toKen", "\n", "AKIAAKIA", "f00d" * 5, "中"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert sorted(secret_scan.base_spans(text), key=lambda s: (s[1], BASE.index(s[0]))) == brute(text), text


def test_a_short_value_uses_up_the_name_inside_it():
    assert brute("token=api_key: abcdefghijklmnop") == []
    assert list(secret_scan.base_spans("token=api_key: abcdefghijklmnop")) == []


def entropy(window):
    return -sum(window.count(c) / len(window) * math.log2(window.count(c) / len(window)) for c in set(window))


@pytest.mark.parametrize("kind", CLASSES)
def test_windows_are_those_of_a_plain_entropy(kind):
    rnd = random.Random(3)
    for _ in range(300):
        text = "".join(rnd.choice(rnd.choice(["ab12", "0123456789abcdef", string.ascii_letters + string.digits])) for _ in range(rnd.randint(0, 90)))
        hot = [i for i in range(len(text) - kind.window + 1)
               if entropy(text[i:i + kind.window]) >= kind.bits - 1e-9 and re.search("[0-9]", text[i:i + kind.window])
               and re.search("[A-Za-z]", text[i:i + kind.window])]
        merged = []
        for i in hot:
            if merged and i <= merged[-1][1]:
                merged[-1][1] = i + kind.window
            else:
                merged.append([i, i + kind.window])
        assert list(map(list, SlidingEntropy(kind.window, kind.bits).windows(text, 0, len(text)))) == merged


def kinds(text):
    return [s[0] for s in Scanner().spans(text)]


def test_entropy_adds_what_no_pattern_has():
    assert kinds("TOKEN IS 9233A8ECF7C5B09FE5949719B6B82BC439E9329B now") == ["entropy_hex"]
    assert kinds("use h8Zq3LmP0xVw9RtY2sKd7BnC5 here") == ["entropy_mixed"]
    assert kinds("use q8z3x7k2v9w4m1r6t5y0p8 here") == ["entropy_lower"]
    assert kinds('token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"') == ["assign", "hex", "entropy_hex"]


def test_words_and_numbers_stay():
    for text in ("losasmentementemente keitstlichschenverpf antidisestablishmentarianism", "1" * 60, "12345678901234567890123456",
                 "reeux.09@mail2.example.com", "a" * 4000, "=" * 300, "getElementsByClassNameAndTheirParents"):
        assert Scanner().entropy_spans(text) == []


def test_the_allow_list_suppresses_added_spans_only():
    digest = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    assert kinds(f"sha1: {digest}") == kinds(f"commit {digest}") == kinds(f"see https://x.org/a?id={digest}") == []
    assert kinds(f"owner {digest}") == ["entropy_hex"]
    assert kinds("F81D4FAE-7DEC-11D0-A765-00A0C91E6BF6") == []
    assert kinds(f"commit {digest.lower()}") == ["hex"]
    nothing = secret_scan.Settings(allow=(), allow_before=())
    assert [s[0] for s in Scanner(nothing).spans(f"commit {digest}")] == ["entropy_hex"]


def test_random_secrets_are_found():
    rnd = random.Random(5)
    for letters, least in (("0123456789ABCDEF", 0.98), (string.ascii_lowercase + string.digits, 0.97), (string.ascii_letters + string.digits + "+/", 0.97)):
        made = ["".join(rnd.choice(letters) for _ in range(40)) for _ in range(400)]
        assert sum(bool(Scanner().entropy_spans(f"a {m} b")) for m in made) >= least * len(made)


def test_masks_and_long_texts():
    assert masked("ab cd ef", [("hex", 3, 5), ("assign", 0, 4)]) == "<SECRET> ef"
    for text in ("a1" * 300_000, "AKIA" * 100_000, "token" * 100_000, "token=" + " " * 400_000, "0123456789abcdef" * 30_000):
        Scanner().spans(text)


def test_awkward_and_empty_tables(spark):
    got = sorted((r.doc_id is None, r.doc_id or 0, tuple(map(tuple, r.spans)), r.masked) for r in find_secrets(awkward(spark)).collect())
    texts = [(d is None, d or 0, tuple(Scanner().spans(t or "")), masked(t or "", Scanner().spans(t or ""))) for d, t, *_ in AWKWARD]
    assert got == sorted(texts)
    assert find_secrets(empty(spark)).columns == ["doc_id", "spans", "masked"] and find_secrets(empty(spark)).count() == 0


def test_query_on_the_table(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.QUERIES["op11_secret_scan"](spark, small).collect()
    assert len(got) == len(texts)
    import hashlib
    for r in got:
        base = brute(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in base) for k in BASE]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in BASE] == [s for s in listed.split(",") if s]
    # nothing but credentials: entropy spans lie where a name or a hex run stands
    for r in got:
        for kind, a, b in (s.split(":") for s in r.spans.split(",") if s.startswith("entropy")):
            assert re.search("(?i)token", texts[r.doc_id][max(0, int(a) - 12):int(a)])
