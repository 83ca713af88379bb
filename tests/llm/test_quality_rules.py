import random
import re
from collections import Counter

from logsift.llm import quality_rules as q

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = W.findall(text)
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = [any(grams[tuple(w[j : j + 8])] > 1 for j in range(max(0, k - 7), min(k, len(w) - 8) + 1)) for k in range(len(w))]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    n = sum(hit)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, n, len(w) < 20 or 100 * n > 30 * len(w)


def corpus(rng):
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "time", "house"]) + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(120)]
    bad = [" ".join(rng.choice(["$$$", "win!!", "###", "CLICK", "&&&"]) + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(120)]
    return good, bad


def test_counts_equal_brute_force_and_verdict_follows_labels(make, spark):
    rng = random.Random(1)
    good, bad = corpus(rng)
    odd = [None, "", "\n\n", "a\na\n a\nb\r\nb\r", "é😀 ü\n" * 30, "one two three four five six seven eight " * 9, "x " * 5000, "### " * 25, "q" * 9000]
    rows = list(enumerate(good + bad + odd)) + [(None, good[0]), (0, good[0])]
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(120 + i, 0) for i in range(100)] + [(5, None), (None, 1), (0, 1)], "doc_id long, quality int")
    got = q.judge(make(rows), q.learn(make(rows), labels)).collect()
    assert len(got) == len(rows)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *(r[c] for c in fields)) for r in got) == Counter((i, *brute(t)) for i, t in rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in range(100, 120)) and not any(kept[i] for i in range(220, 240))
    assert all(0 <= r["quality_prob"] <= 1 for r in got) and not any(r["kept"] for r in got if r["base_failed"])


def test_without_labels_only_the_rules_decide(make, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = make([(1, "w " * 10), (2, " ".join(f"w{k}" for k in range(40)))])
    assert {r["doc_id"]: r["kept"] for r in q.judge(docs, q.learn(docs, none)).collect()} == {1: False, 2: True}
    assert q.judge(make([]), q.learn(make([]), none)).count() == 0
