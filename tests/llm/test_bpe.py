import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm.bpe import PrefixCode, TextEncoder, Vocabulary
from granary.llm.tokencount import LongestMatchCounter, TextCounter

VOCABULARY = Vocabulary.load(P.path("byte_bpe_50k.tiktoken"))
ENCODER = TextEncoder(VOCABULARY, P.PATTERN)
OTHER = tiktoken.Encoding("other", pat_str=P.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
TEXT = st.text(alphabet=st.sampled_from(list("ab  \n\té'st re1²2,.\x1c\x85 日本\U0001f600lltthing")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_as_another_library_and_back(text):
    assert ENCODER.encode(text) == OTHER.encode_ordinary(text)
    assert VOCABULARY.decode(ENCODER.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "the  end ", " 's", "word's\n\n x", "don't stop, believing."])
def test_edges(text):
    assert ENCODER.encode(text) == OTHER.encode_ordinary(text)


def test_many_texts_at_once_as_another_library():
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeinorstlq\u00e9\u65e5-'9") for _ in range(r.choice((1, 3, 7, 9, 20, 70, 600))))
    texts = [r.choice((" ", "  ", "\n", " \n ", ", ")).join(word() for _ in range(r.randint(0, 80))) for _ in range(150)]
    codes = ENCODER.encode_texts(texts)
    assert [np.frombuffer(c, "<u4").tolist() for c in codes] == OTHER.encode_ordinary_batch(texts)
    assert VOCABULARY.decode_all(codes) == [t.encode() for t in texts]


def test_ids_that_no_token_has():
    with pytest.raises(ValueError):
        VOCABULARY.decode([60_000])


def test_appends_and_edits_equal_a_fresh_encoding():
    r = random.Random(5)
    for _ in range(300):
        data = bytes(r.choice(b"abaathe  ing\xff\xe3") for _ in range(r.randint(0, 60)))
        grown = PrefixCode(VOCABULARY)
        for byte in data:
            grown.append(bytes([byte]))
        assert grown.last == PrefixCode(VOCABULARY, data).last
        a, b = sorted((r.randint(0, len(data)), r.randint(0, len(data))))
        grown.replace(a, b, b"the")
        assert grown.last == PrefixCode(VOCABULARY, data[:a] + b"the" + data[b:]).last


def test_an_edit_looks_at_few_positions():
    small = Vocabulary({**{bytes([b]): b for b in range(256)}, b"th": 256, b"the": 257, b"in": 258})
    code = PrefixCode(small, b"the in " * 500)
    assert code.replace(700, 702, b"xx") < 50
    assert code.ids() == PrefixCode(small, code.data).ids()


def _greedy(word: bytes) -> int:
    n = 0
    while word:
        k = next(k for k in range(min(len(word), VOCABULARY.longest), 0, -1) if word[:k] in VOCABULARY.ranks)
        word, n = word[k:], n + 1
    return n


COUNTER = TextCounter(VOCABULARY.ranks, P.PATTERN)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_token_counts_equal_greedy_matching(text):
    pieces = [p.encode() for p in ENCODER.encode_texts.pattern.findall(text)]
    assert COUNTER.count([text])[0] == (sum(map(_greedy, pieces)), len(pieces))


def test_counter_needs_all_bytes():
    with pytest.raises(ValueError):
        LongestMatchCounter([b"a", b"ab"])
