"""What op2_line_dedup shuffles: cut hashes and short lists, which lose no pair."""

import os
import random
import time

import corpus_pipeline

from logsift.llm import line_dedup


def grams(line):
    return {line[i : i + 9] for i in range(max(1, len(line) - 8))}


def near(a, b):
    return 100 * len(grams(a) & grams(b)) >= 80 * len(grams(a) | grams(b))


def edited(rng, groups, length):
    """Lines in groups, of similarities from about 0.6 to 0.9."""
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    lines = []
    for _ in range(groups):
        base = text(length)
        lines.append(base)
        for _ in range(3):
            at = [rng.randrange(length) for _ in range(rng.randint(1, 3))]
            lines.append("".join(text(2) if i in at else c for i, c in enumerate(base)))
    return lines


def test_hashes_that_meet_only_add_comparisons(make, monkeypatch):
    lines = edited(random.Random(21), 12, 110)
    monkeypatch.setattr(line_dedup, "SIGNED_BITS", 9)
    monkeypatch.setattr(line_dedup, "NAME_BITS", 5)
    label = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            if near(a, b):
                x, y = sorted((label[i], label[j]))
                label = [x if c == y else c for c in label]
    got = line_dedup.dedup_lines(make(list(enumerate(lines)))).collect()
    assert sorted(r["doc_id"] for r in got if r["text"]) == [i for i, c in enumerate(label) if c == i]
    assert len(set(label)) < len(lines) - 8


def test_short_lists_of_rarer_shingles_keep_every_near_pair(spark):
    lines = edited(random.Random(22), 10, 260)
    sets = spark.createDataFrame([(k, len(grams(x)), x) for k, x in enumerate(lines)], "l1 long, n int, norm string")
    names = line_dedup.materialize(spark.createDataFrame([(k, k) for k in range(len(lines))], "l1 long, c long"))
    rows = line_dedup._asked(line_dedup.materialize(line_dedup._rarest(names, sets))).collect()
    assert max(len(r["rarer"]) for r in rows) == line_dedup.RARER < max(r["pos"] for r in rows)
    held = {k: {r["key"]: set(r["rarer"]) for r in rows if r["l1"] == k} for k in range(len(lines))}
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if near(lines[i], lines[j])]
    assert len(pairs) > 10
    for i, j in pairs:
        assert any(not held[i][key] & held[j][key] for key in held[i].keys() & held[j].keys())


def test_a_stage_of_the_pipeline_leaves_next_to_no_shuffle_files(make, spark):
    top = spark.sparkContext.getConf().get("spark.local.dir")
    files = lambda: {f"{d}/{f}" for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    size = lambda names: sum(os.path.getsize(f) for f in names if os.path.exists(f))
    rng = random.Random(23)
    docs = make([(i, "".join(rng.choice("abcdefghijklmnop") for _ in range(100))) for i in range(3000)])
    before = files()
    line_dedup.materialize(corpus_pipeline.drop_lines(spark, docs, ""))
    until = time.time() + 20
    while size(files() - before) > 50_000 and time.time() < until:  # executors remove them a little later
        time.sleep(0.2)
    assert size(files() - before) <= 50_000  # 749,104 stayed before
