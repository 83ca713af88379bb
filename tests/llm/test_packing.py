import random
import zlib
from collections import Counter

import numpy as np
import pytest

from logsift.llm.packing import configurations, pack
from logsift.llm.queries import tokenizer_file

ODD = "don't <|endoftext|> x\x1cy café ÀÉß İstanbul ΑΣ 漢字 a b c 10km 𝒳 hi!! <|startoftext|>z _a_ 'll"


def check(rows, got, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    want = Counter()
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            cut = ids[a : a + capacity]
            want[doc_id, k, a, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_pieces_ids_and_places(make):
    rows = [(1, None), (2, ""), (3, ODD), (4, "word " * 5000), (5, "same text"), (5, "same text"), (None, "no id"), (6, "a" * 3000), (7, " \n\t ")]
    got = pack(make(rows), tokenizer_file(), capacity=512).collect()
    n = check(rows, got, 512)
    assert n == -(-sum(r["length"] for r in got) // 512)


def test_empty_table(make):
    assert pack(make([]), tokenizer_file()).count() == 0


@pytest.mark.parametrize("rounds", [0, 40])
def test_configurations_cover_each_length_once_and_fill_well(rounds):
    rng = random.Random(1)
    counts = Counter(min(4096, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(20_000))
    lengths = np.array(sorted(counts))
    got, total = Counter(), 0
    for n, contents in configurations(lengths, np.array([counts[x] for x in lengths.tolist()]), 4096, rounds):
        assert n > 0 and sum(a * b for a, b in contents) <= 4096
        total += n
        for length, copies in contents:
            got[length] += n * copies
    assert got == counts
    least = -(-sum(k * v for k, v in counts.items()) // 4096)
    assert total <= 1.002 * least + 1


def test_lengths_that_do_not_combine():
    got = configurations(np.array([3000, 4096]), np.array([5, 2]), 4096, 10)
    assert sum(n for n, _ in got) == 7
    assert configurations(np.array([], np.int64), np.array([], np.int64), 4096, 10) == []


def test_blocks_without_new_words():
    from pathlib import Path

    from logsift.llm.packing import _Encoder

    encode = _Encoder(Path(tokenizer_file()).read_text())
    data, at = np.frombuffer(b"the cat the", np.uint8), np.array([0, 11])
    first, again = encode(data, at), encode(data, at)
    assert first[0].tolist() == again[0].tolist() and first[1].tolist() == again[1].tolist() == [3]


def test_weights_cover_every_length_at_a_price_near_the_least():
    """The linear program is solved, not only begun: best fit gets what rounding leaves, not nearly all."""
    from logsift.llm.packing import fractions

    lengths, counts = np.unique(np.clip(np.random.default_rng(1).lognormal(6, 1, 100_000).astype(int), 1, 4096), return_counts=True)
    covered, chosen = np.zeros(len(lengths)), fractions(lengths, counts, 4096, 100)
    for config, x in chosen.items():
        assert sum(int(lengths[k]) * a for k, a in config) <= 4096
        for k, a in config:
            covered[k] += a * x
    assert np.allclose(covered, counts)
    assert sum(chosen.values()) <= 1.005 * (lengths * counts).sum() / 4096


def test_known_words_stay_in_place_as_others_are_learned():
    """Arrays of all words are not made anew for each block: their holes took as much memory as they did."""
    from pathlib import Path

    from logsift.llm.packing import _Encoder

    encode, own = _Encoder(Path(tokenizer_file()).read_text()), []
    for k in range(64):
        words = " ".join(f"word{k}x{i}" for i in range(50))
        ids, _ = encode(np.frombuffer(words.encode(), np.uint8), np.array([0, len(words)]))
        assert ids.tolist() == encode.tokenizer.encode(words, add_special_tokens=False).ids
        own.append((id(encode.starts.held), id(encode.ids.held), id(encode.text.held), id(encode.at.held)))
    assert all(len({o[c] for o in own}) < 16 for c in range(4)) and encode.starts.n == 64 * 50 + 1


def test_a_worker_remembers_a_bounded_number_of_words():
    from pathlib import Path

    import pyarrow as pa

    from logsift.llm.common import text_bytes
    from logsift.llm.packing import _Encoder

    encode, first = _Encoder(Path(tokenizer_file()).read_text()), None
    for k in [*range(7), 0]:
        ids, n = encode(*text_bytes(pa.array([" ".join(f"w{k * 50_000 + i}" for i in range(50_000))])))
        assert encode.starts.n <= 300_001
        first = (ids, n) if first is None else first
    assert np.array_equal(ids, first[0]) and np.array_equal(n, first[1])
