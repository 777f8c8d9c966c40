"""BPE coding and token counts against the public libraries."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, token_counts

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  a", "a  ", "\n\n", "a\x1cb", "ΑΣ ΣΑΣ", "İstanbul", "<|endoftext|>x<|startoftext|> y", "<|endof", "é é", "▁a ▁▁ b", "it's we'll I'D 12345 ½²", "漢字" * 50,
    "a" * 3000, "ab" * 2000, "​  x　y", "<0x0A></s><unk>", "😀😀 👨‍👩‍👧", "word" * 200 + " " + "!?" * 200, "\t a", "hello\n world", "ﷺ ﬁ",
]
SCHEMA = "doc_id long, text string, n_tokens string, other int"


@pytest.fixture(scope="module")
def word_bpe():
    return bpe.loaded(open(WORDS, "rb").read()), Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def pieces():
    return token_counts.loaded(open(PIECES, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_bpe_equals_library(word_bpe):
    ours, library = word_bpe
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abAB 'é\n\t  ñ漢😀0½.,!▁_<|>") for _ in range(rng.randrange(60))) for _ in range(500)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids
        assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_tree_equals_naive_merges(word_bpe):
    ours, _ = word_bpe

    def naive(ids):
        while True:
            ranks = [ours.pairs.get(a * ours.base + b, 1 << 60) for a, b in zip(ids, ids[1:])]
            if not ranks or min(ranks) == 1 << 60:
                return ids
            i = ranks.index(min(ranks))
            ids = ids[:i] + [ours.made[ranks[i]]] + ids[i + 2 :]

    rng = random.Random(5)
    for _ in range(300):
        ids = [ours.inner[b] for b in "".join(rng.choice("theandion") for _ in range(rng.randrange(1, 40))).encode()]
        assert ours.merge(list(ids)) == naive(list(ids))


def test_forest_equals_single_trees(word_bpe):
    ours, _ = word_bpe
    rng = random.Random(6)
    words = list({"".join(rng.choice("thenaioéß") for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 17, 33, 40, 63, 70, 200]))) for _ in range(400)})
    ids, first, last = ours.encode_words(words)
    for word, a, b in zip(words, first, last):
        data = word.encode()
        assert ids[a:b].tolist() == ours.merge([*[ours.inner[x] for x in data[:-1]], ours.last[data[-1]]])


def test_long_texts(spark, word_bpe):
    text = "x" * 1_000_000 + " " + "many words here, " * 60_000
    out = bpe.encode_decode(spark.createDataFrame([(1, text)], "doc_id long, text string"), WORDS).first()
    ids = word_bpe[1].encode(text, add_special_tokens=False).ids
    assert list(out["ids"]) == ids and out["decoded"] == word_bpe[1].decode(ids, skip_special_tokens=False)


def test_bpe_of_late_characters(word_bpe):
    ours, library = word_bpe
    for text in ("a:\U000323b0b", "\u1c89\ua7cb\U00010d50 \U00016ea0x1", "x\U00018e00,\U00012550 9"):
        assert ours.encode(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80).filter(lambda t: "\x00" not in t))
def test_any_text(text):
    ours, library = bpe.loaded(open(WORDS, "rb").read()), Tokenizer.from_file(WORDS)
    assert ours.encode(text) == library.encode(text, add_special_tokens=False).ids
    counted = token_counts.loaded(open(PIECES, "rb").read())
    assert counted.counts([text]) == [len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text))]


def test_counts_equal_library(pieces):
    ours, library = pieces
    assert ours.counts(ODD) == [len(x) for x in library.encode(ODD, num_threads=1)]


def test_long_words(pieces):
    ours, library = pieces
    rng = random.Random(8)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (("ab", 3000), ("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", 20_000), ("theando漢é", 5000), ("aaab", 700))]
    texts += ["a" * 4001, "ha" * 2000, "x" + " " * 3000 + "y"]
    assert ours.counts(texts) == [len(library.encode(t)) for t in texts]


def test_memo_turnover(word_bpe, monkeypatch):
    ours, library = word_bpe
    monkeypatch.setattr(bpe, "MEMO", 5)
    text = " ".join(f"word{i % 13}x, other{i % 7}" for i in range(200))
    assert ours.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_rows(spark):
    rows = [(1, "Hello world", "x", 5), (2, None, None, None), (2, "", "y", 1), (None, "Hello world", "x", 5), (1, "Hello world", "x", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = bpe.encode_decode(docs, WORDS, outputs="digests").collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in out) == [(0, 2), (1, 2), (1, 2), (2, 0), (2, 0)]
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["ids_sha256"] for r in out if r["n_tokens"] == 0} == {empty} == {r["decoded_sha256"] for r in out if r["n_tokens"] == 0}
    assert "other" in out[0].asDict()
    full = bpe.encode_decode(docs, WORDS).filter("doc_id = 2").collect()
    assert [list(r["ids"]) for r in full] == [[], []] and [r["decoded"] for r in full] == ["", ""]
    assert bpe.encode_decode(docs.limit(0), WORDS).count() == 0


def test_count_rows(spark):
    docs = spark.createDataFrame([(1, "Hello world", "x", 5), (2, None, None, None), (3, "", "y", 1), (4, "a " * 5000, "z", 2)], SCHEMA)
    out = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, PIECES).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert out[1] == (11, len(library.encode("Hello world")), False) and out[2] == out[3] == (0, 0, False)
    assert out[4] == (10000, len(library.encode("a " * 5000)), True)
    assert token_counts.token_counts(docs.limit(0), PIECES).count() == 0
