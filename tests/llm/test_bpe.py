"""The token automaton against the public library, and its round trip."""

import os
import random
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")

from tidelog.llm.bpe import LONG_WORD, automaton, byte_alphabet  # noqa: E402

TRICKY = [
    "", " ", "  ", "\n", "a\n\n b", "it's we'll 'tis ''s '  's a's\n's 're 'reX'lls 'l 'S", "don't 'd", "x \t y  　z ", "a" * 700, "ab" * 400,
    " " * 900 + "x", "ß" * 300, "<|endoftext|>", "\x1c a\x85b​c", "1'2'3's4", "漢字かな交じり文。" * 40, "💥👩‍👩‍👧", "'s", "'", "s'",
    "́a", "₁²③Ⅷ٣", "foo_bar-baz", "=" * 600, "0123456789" * 60, "\r\n\r\n", "퟿￿",
]


@lru_cache(1)
def library_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def library():
    return library_tokenizer()


def encode(texts):
    raw = [t.encode() for t in texts]
    ids, offsets = automaton(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def expected(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_tricky_texts(library):
    assert encode(TRICKY) == expected(library, TRICKY)
    assert encode(TRICKY[::-1]) == expected(library, TRICKY[::-1])


def test_random_texts(library):
    rng = random.Random(7)
    texts = ["".join(rng.choice("aabe's tl re\n\t1é漢💥‍'dmv  _-") for _ in range(rng.randrange(80))) for _ in range(4000)]
    assert encode(texts) == expected(library, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(texts):
    assert encode(texts) == expected(library_tokenizer(), texts)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_round_trip(text):
    (ids,) = encode([text])
    assert automaton(PATH).decode(ids) == text.encode()


def test_walk_is_encode_words():
    a, rng = automaton(PATH), random.Random(1)
    words = [bytes(rng.choice(b"aeinorst ") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    words += [b"a" * LONG_WORD, b"a" * (LONG_WORD + 1), b"the" * LONG_WORD]
    ids, counts = a.encode_words(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]))
    got = [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [a.walk(w) for w in words]


def test_every_token_is_its_own_path():
    a = automaton(PATH)
    step = list(range(0, len(a.labels), 37))
    whole = [i for i in step if a.labels[i] and a.walk(a.labels[i]) == [i]]
    # A label is one word to the automaton whatever the pattern says of it.
    assert len(whole) == sum(1 for i in step if a.labels[i])


def test_merges_replayed_by_hand():
    """The plain procedure, merge by merge in rank order, on short words."""
    a, rng = automaton(PATH), random.Random(5)
    alphabet = {v: k for k, v in byte_alphabet().items()}
    single = {label: i for i, label in enumerate(a.labels) if len(label) == 1}
    assert len(alphabet) == 256
    for _ in range(300):
        word = bytes(rng.choice(b"abcdehilnorst'1 \xc3\xa9") for _ in range(rng.randrange(1, 14)))
        ids = [single[bytes([b])] for b in word]
        while True:
            ranks = [(a.closed[x << 16 | y], i) for i, (x, y) in enumerate(zip(ids, ids[1:])) if x << 16 | y in a.closed]
            if not ranks:
                break
            rank = min(ranks)[0]
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and a.closed.get(ids[i] << 16 | ids[i + 1]) == rank:
                    out.append(int(np.flatnonzero(a.birth == rank)[0]))
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        assert a.walk(word) == ids
