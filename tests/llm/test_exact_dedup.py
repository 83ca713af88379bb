import hashlib
import random

import pytest

from logsift.llm.exact_dedup import exact_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    norm = [(d, (t or "").translate(LOW)) for d, t in rows]
    out = []
    for d, t in norm:
        ids = [x for x, u in norm if u == t]
        known = [x for x in ids if x is not None]
        keep = max(known) if known else None
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("id_bits", [64, 2])
def test_equals_brute_force_even_with_colliding_identifiers(make, id_bits):
    rng = random.Random(id_bits)
    long = " ".join("".join(rng.choice("abcdefg") for _ in range(6)) + rng.choice(["", ".", "!"]) for _ in range(3000))
    other = long[:9000] + "X" + long[9001:]
    texts = [long, other, long.upper(), long + " ", "a", "A", "É", "é", "", None, "b", "z" * 10000, "z" * 10000, "c", "d", "e", "f", "x\ny", "X\nY"]
    rows = list(enumerate(texts)) + [(None, "a"), (None, "no id"), (None, "no id"), (4, "a"), (90, "b")]
    got = exact_dedup(make(rows), id_bits=id_bits).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_table(make):
    assert exact_dedup(make([])).count() == 0
