import random
import re

import numpy as np
import pyarrow as pa
import pytest

from logsift.llm import minhash

W = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, n, percent):
    sets = []
    for doc_id, text in rows:
        w = W.findall((text or "").translate(LOW))
        sets.append((doc_id, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for j, (b, t) in enumerate(sets[:i]):
            same = a is not None and a == b
            if same or (a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    out = []
    for i, (doc_id, s) in enumerate(sets):
        members = [sets[j][0] for j in range(len(rows)) if find(j) == find(i)]
        low = min(members) if doc_id is not None and s else doc_id
        out.append((doc_id, len(s), low, doc_id == low))
    return sorted(out, key=str)


def near_copies(rng, base, n, edits):
    for _ in range(n):
        w = base.split(" ")
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"w{rng.randint(0, 999)}"
        yield " ".join(w)


@pytest.mark.parametrize(("n", "percent", "edits"), [(3, 85, 4), (3, 85, 9), (5, 80, 5)])
def test_equals_brute_force(make, n, percent, edits):
    rng = random.Random(edits)
    text = lambda k: " ".join(f"v{rng.randint(0, 400)}" for _ in range(k))
    base = [text(200) for _ in range(3)]
    texts = [t for b in base for t in near_copies(rng, b, 25, edits)] + base + [text(150) for _ in range(10)]
    texts += ["One two", "one TWO", "one", "", None, "É two three four", "é two three four", base[0], base[0].upper(), "a b c\x0bd", "word " * 4000]
    rows = list(enumerate(texts)) + [(None, base[0]), (None, "one"), (5, texts[5]), (200, "alone in the world of words")]
    got = minhash.near_duplicates(make(rows), minhash.Near(n, percent)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, n, percent)


def test_empty_table(make):
    assert minhash.near_duplicates(make([])).count() == 0


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1500, dtype=np.uint64) * np.uint64(2)
    a, b = pool[:1000], pool[500:]
    grams = np.concatenate([np.unique(a), np.unique(b)])
    s = minhash.signatures(grams, np.array([0, 1000, 2000]), 2000)
    assert (s[0] == s[1]).mean() == pytest.approx(1 / 3, abs=0.04)


def test_sets_of_sliced_batches_with_nulls():
    column = pa.array(["skip", "a b c d", None, "A b C d", "a b"]).slice(1)
    (_, grams, at), *rest = list(minhash.shingle_sets(column, 3, "0123456789abcdef"))
    assert not rest and np.diff(at).tolist() == [2, 0, 2, 1]
    assert (grams[at[0] : at[1]] == grams[at[2] : at[3]]).all()


@pytest.mark.parametrize("carried", [170, 1000])
def test_groups_without_their_original(make, monkeypatch, carried):
    """Edited copies whose original is missing: many pairs near the limit, some above it, verified in the bucket or fetched."""
    monkeypatch.setattr(minhash, "CARRIED", carried)
    rng = random.Random(7)
    texts = []
    for _ in range(2):
        base = " ".join(f"v{rng.randint(0, 400)}" for _ in range(180))
        texts += [t for edits in (2, 4, 6) for t in near_copies(rng, base, 20, edits)]
    rows = list(enumerate(texts))
    got = minhash.near_duplicates(make(rows), minhash.Near(3, 85)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 3, 85)
    assert 2 < len({r["component_id"] for r in got}) < len(rows) - 10
