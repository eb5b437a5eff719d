"""Token ids, counts and decoded texts against the installed library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, pre_tokenizers

from phasegrid.llm import bpe, bpe_vocab, token_counts

from .cases import AWKWARD, awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as f:
    VOCAB = bpe_vocab.ByteVocab(f.read())
ODD = "".join(map(chr, [*range(33), 0x85, 0xA0, 0x1680, 0x180E, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF, 0xE9, 0x301,
                        0x4E2D, 0x1F600, 0xBD, 0x2160, 0x661])) + "ab 's'T12..<|endoftext|>"


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def own_ids(texts):
    memory = bpe_vocab.Remembered(VOCAB, lambda new: bpe.merge_pieces(VOCAB, new))
    out = [[] for _ in texts]
    for k, found in memory.of(texts, lambda i: np.uint32(i).astype("<u4").tobytes()):
        out[k] += np.frombuffer(b"".join(found), "<u4").tolist()
    return out


def own_counts(texts):
    memory = bpe_vocab.Remembered(VOCAB, lambda new: token_counts.count_pieces(VOCAB, new), most=50)
    out = [0] * len(texts)
    for k, found in memory.of(texts, lambda _: 1):
        out[k] += sum(found)
    return out


TEXTS = ["", "a" * 5000, "ab" * 3000, "x<|endoftext|>y <|endoftext|><|endoftext|>", " " * 3000, "é" * 700, "don't we'll I'VE",
         "".join(random.Random(1).choice("abcdefgh") for _ in range(3000)), "aaaa aaaaa aaaaaaa"]


@pytest.mark.parametrize("text", TEXTS)
def test_hard_texts(text):
    assert own_ids([text]) == [ids_of(text)] and own_counts([text]) == [len(ids_of(text))]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(ODD) | st.characters(exclude_categories=["Cs", "Cn", "Co"]), max_size=80))
def test_any_text(text):
    assert own_ids([text]) == [ids_of(text)] and own_counts([text]) == [len(ids_of(text))]


def test_every_kind_of_code_point_is_split_as_the_library_does():
    """Each place where a listed run begins or ends, and every 61st code point beside them, in four surroundings."""
    ends = [int(x, 16) for run in bpe_vocab.NEITHER.replace(",", " ").split() for x in run.split("-")]
    points = {c + d for c in ends for d in (-1, 0, 1)} | set(range(0, 0x110000, 61))
    split = pre_tokenizers.ByteLevel(add_prefix_space=False)
    for c in sorted(points - set(range(0xD800, 0xE000))):
        text = f"a{chr(c)}1{chr(c)}.{chr(c)} {chr(c)}{chr(c)}'s{chr(c)}"
        want = [text[a:b] for _, (a, b) in split.pre_tokenize_str(text)]
        assert [x for some in VOCAB.pieces(text) for x in some] == want, hex(c)


def test_long_texts_are_split_piece_by_piece(monkeypatch):
    monkeypatch.setattr(bpe_vocab, "LONG_TEXT", 16)
    text = "some words, 123 of them;  and   blanks " * 5
    assert own_ids([text]) == [ids_of(text)]


def test_a_vocabulary_that_ranks_a_pair_before_its_parts():
    token_counts.check(VOCAB)
    bad = '{"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "c": 2, "ab": 3, "abc": 4}, "merges": [["ab", "c"], ["a", "b"]]}, "pre_tokenizer": {"type": "ByteLevel"}}'
    with pytest.raises(ValueError):
        token_counts.check(bpe_vocab.ByteVocab(bad))
    with pytest.raises(ValueError):
        bpe_vocab.ByteVocab('{"model": {"type": "WordPiece", "vocab": {}}}')


def test_table_round_trip(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == ids_of(texts[r.doc_id]) and r.text == texts[r.doc_id]
    for r in token_counts.token_counts(docs, PATH).collect():
        n = len(ids_of(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 1024)


def test_awkward_rows(spark):
    want = sorted(((d, t or "") for d, t, *_ in AWKWARD), key=repr)
    got = bpe.decode(bpe.encode(awkward(spark), PATH), PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == want
    assert {hashlib.sha256(bytes(r.ids)).hexdigest() for r in got} == {hashlib.sha256(np.array(ids_of(t), "<u4").tobytes()).hexdigest() for _, t in want}
    counts = token_counts.token_counts(awkward(spark), PATH).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in counts), key=repr) == sorted(((d, len(ids_of(t))) for d, t in want), key=repr)
    for frame in (bpe.encode(empty(spark), PATH), token_counts.token_counts(empty(spark), PATH)):
        assert frame.count() == 0
