"""Repeats by the Burrows-Wheeler transform against all pairs of strings."""

import random
from collections import Counter

import numpy as np
import pytest

from logsift.llm import bwt


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in texts]


@pytest.mark.parametrize("length", [1, 2, 7, 8, 20, 60])
def test_repeats_are_those_of_all_strings(length):
    rng = random.Random(length)
    for _ in range(30):
        alphabet = rng.choice([b"a", b"ab", b"\x00\x01\xff", bytes(range(256))])
        parts = [bytes(rng.choices(alphabet, k=rng.randint(0, 90))) for _ in range(4)]
        texts = [b"".join(rng.choices(parts, k=rng.randint(0, 3))) for _ in range(rng.randint(0, 8))]
        got = [g.tolist() for g in bwt.repeated_starts(texts, length)]
        assert got == brute(texts, length)


def test_periods_and_one_letter():
    texts = [b"ab" * 400, b"a" * 500, b"", b"b" + b"ab" * 210]
    assert [g.tolist() for g in bwt.repeated_starts(texts, 100)] == brute(texts, 100)


def test_common_prefixes_below_the_length_part_neighbours():
    rng = random.Random(2)
    symbols = np.array([*rng.choices([1, 2, 3], k=399), 0], np.uint16)
    order, length = bwt.suffix_order(symbols, 9), 9
    words = [tuple([*symbols[i : i + length].tolist(), *[0] * length][:length]) for i in order.tolist()]
    assert words == sorted(words)
    cut = bwt.parted(symbols, order, length)
    wrong = [k for k in range(1, 400) if cut[k] != (words[k] != words[k - 1]) and 0 not in words[k] and 0 not in words[k - 1]]
    assert not wrong
