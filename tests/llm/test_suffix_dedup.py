import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logsift.llm import suffix_dedup


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[s : s + length] for _, b in texts for s in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s] += 1
                gone[s + length] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2, 500])
def test_equals_brute_force(make, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "CLASS_ROWS", hot)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, other = text(70), text(45)
    rows = [(i, text(rng.randint(0, 60)) + passage[rng.randint(0, 9) : rng.randint(50, 70)] + text(30)) for i in range(40)]
    rows += [(50, other + text(20) + other), (51, "a" * 200), (52, "ab" * 100), (53, text(400)), (54, None), (55, ""), (56, passage), (56, passage), (None, other)]
    rows += [(57, "x" + passage[:39]), (58, passage[:40] + "y"), (60, rows[3][1]), (61, rows[3][1])]
    got = suffix_dedup.remove_repeats(make(rows), length=40, anchor=12).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 40)


def test_empty_table(make):
    assert suffix_dedup.remove_repeats(make([])).count() == 0


def test_windows_of_long_texts_are_in_one_block_each(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (1000, 10, 300, 40, 700)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.r_[0, np.cumsum([len(t) for t in texts])]
    found = Counter()
    for a, skip, part, offsets in suffix_dedup._blocks(data, at, 40):
        text, first, last, _, _ = suffix_dedup.runs(part, offsets, 40, 12)
        for t, x, y in zip(text, first, last, strict=True):
            found.update((int(t) + a, s + skip) for s in range(x, y + 1))
    assert found == Counter((k, s) for k, t in enumerate(texts) for s in range(len(t) - 39))
    assert pa.__version__
