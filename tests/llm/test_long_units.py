"""Long unbroken text: the same pieces as the batched Viterbi, in time that grows with the length."""

import time

import numpy as np
import pytest

from maskwright.llm import sentencepiece as sp


@pytest.fixture(scope="module")
def pieces():
    return sp.load()


def units():
    rng = np.random.default_rng(4)
    base64 = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 700))
    return [base64, "a" * 600, "the" * 200 + "漢字😀", "aab" * 150 + "ß", "internationalization" * 30]


def test_same_pieces_as_the_batched_way(pieces):
    for unit in units():
        one, _ = sp.viterbi([unit], pieces)
        assert sp.viterbi_long(unit, pieces).tolist() == one.tolist()


def test_a_megabyte_without_a_space(pieces):
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 1 << 20))
    for t in (text, "abc" * (1 << 18)):
        began = time.time()
        ids, counts = sp.Encoder(pieces)([t])
        assert sp.decode_ids(ids, counts, pieces) == [t.encode()]
        assert time.time() - began < 60
