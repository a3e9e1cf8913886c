import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexspan.llm import queries
from lexspan.llm.token_counts import TokenCounter, merges_of, token_counts
from tests.llm.conftest import ROWS

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.fixture(params=FILES)
def both(request):
    path = public_tokenizers.path(request.param)
    return Tokenizer.from_file(path), TokenCounter(path, room=50)


def library(tokenizer, text):
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


TEXTS = [
    "", " ", "\n\t \x0b\x0c\r", "a", "It's we'll I'd 'S 'LL", "ΑΣ ΣΑΣ Σ", "ſ K Å İstanbul ǅ", "é ́ ạ́", "日本語 テキスト 한국어 ไทย",
    "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|>", "<|endoftext|><|endoftext|>", "\x00\x01 \x1c\x1d \x85     　 ﻿", "1234567 ½ Ⅷ ٣", "😀😀👨‍👩‍👧 !!!???###", "snake_case camelCase http://x.y/z?a=b&c",
]


def test_texts_as_the_library(both):
    tokenizer, counter = both
    for text in [*TEXTS, *(t or "" for _, t in ROWS)]:
        assert counter.count(text.encode()) == library(tokenizer, text), text


def test_random_texts_as_the_library(both):
    tokenizer, counter = both
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice("aabbethinr  \n.,'s1É́ß日 😀Σ<|endoftext|>") for _ in range(rng.randrange(60)))
        text += rng.choice(["", "<|endoftext|>", " THE the", "ͅ"])
        assert counter.count(text.encode()) == library(tokenizer, text), repr(text)


def test_one_long_word(both):
    tokenizer, counter = both
    rng = random.Random(4)
    word = "".join(rng.choice("abcdeéin") for _ in range(200_000))
    assert counter.count(word.encode()) == library(tokenizer, word)


def test_merges_take_the_lowest_rank_then_the_leftmost():
    pairs = {(1, 1): (0, 2), (2, 1): (1, 3), (2, 2): (2, 4)}
    assert merges_of([1, 1, 1], pairs) == 2
    assert merges_of([1, 1, 1, 1], pairs) == 3
    assert merges_of([], pairs) == merges_of([1], pairs) == 0


def test_other_files_are_refused(tmp_path):
    path = tmp_path / "other.json"
    path.write_text('{"model": {"type": "WordPiece", "vocab": {}}}')
    with pytest.raises(ValueError):
        TokenCounter(str(path))


def test_rows(docs, none):
    path = public_tokenizers.path(FILES[0])
    tokenizer = Tokenizer.from_file(path)
    got = token_counts(docs, path, limit=100).collect()
    want = [(i, len((t or "").encode()), n := library(tokenizer, t or ""), n > 100) for i, t in ROWS]
    assert [tuple(r) for r in got] == want
    assert token_counts(none, path).collect() == []
    clash = docs.selectExpr("doc_id as id", "text as n_tokens", "top as n_bytes")
    assert [tuple(r) for r in token_counts(clash, path, "id", "n_tokens", 100).collect()] == want


def test_registered_query(spark, real):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.QUERIES["op11_token_counts"](spark, "/root/testdata/sf0.01").collect()}
    want = {}
    for r in real.select("doc_id", "text").collect():
        n = library(tokenizer, r["text"] or "")
        want[r["doc_id"]] = (len((r["text"] or "").encode()), n, n > 2048)
    assert got == want
