"""Line dedup as op2_line_dedup and the pipeline run it: shingles at every character, against their own brute force."""

import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from logsift.llm import line_dedup, queries

GERMAN = "Donaudampfschifffahrtsgesellschaft Rechtsschutzversicherungsgesellschaften Kraftfahrzeughaftpflichtversicherung Haltestellenverzeichnis"


def grams(line):
    return {line[i : i + 9] for i in range(max(1, len(line) - 8))}


def kept(lines):
    """Lines that stay of documents of one line each, by comparing all with all."""
    norm = [x.strip(" \t\r\f\x0b").lower() for x in lines]
    sets, label = [grams(x) for x in norm], list(range(len(lines)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((label[i], label[j]))
                label = [x if c == y else c for c in label]
    return [i for i, c in enumerate(label) if c == i]


def unspaced(rng, n):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(n))


def test_shingles_are_all_places(spark):
    rng = random.Random(2)
    lines = ["x", "12345678", "123456789", "a b\rc 漢字😀d e f g h i"] + [unspaced(rng, n) for n in (63, 64, 65, 71, 72, 73, 74, 128, 137, 500)]
    rows = spark.createDataFrame([(x,) for x in lines], "v string").select("v", line_dedup.dense(F.col("v")).alias("s")).collect()
    want = [[x[i : i + 9] for i in range(max(1, len(x) - 8))] for x in lines]
    hashed = spark.createDataFrame([(w,) for w in want], "w array<string>").select(F.transform("w", lambda s: F.xxhash64(F.encode(s, "UTF-32"))).alias("s")).collect()
    assert {r["v"]: r["s"] for r in rows} == {x: r["s"] for x, r in zip(lines, hashed, strict=True)}


def test_inserted_characters_and_lines_without_blanks(spark, tmp_path):
    rng = random.Random(9)
    lines = []
    for n in (90, 120, 200, 200, 700):
        base = unspaced(rng, n)
        lines += [base, base[:1] + "Q" + base[1:], base[: n // 2] + "q" + base[n // 2 :], unspaced(rng, n)]
    lines += [GERMAN, GERMAN[:40] + "s" + GERMAN[40:], "漢字仮名" + unspaced(rng, 200), "short", "shorts"]
    docs = spark.createDataFrame([(i, x, "en", "a", len(x)) for i, x in enumerate(lines)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = kept(lines)
    assert len(want) < len(lines) - 10
    got = queries.op2_line_dedup(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got if r["text"]) == want
    piped = corpus_pipeline.drop_lines(spark, docs, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in piped if r["text"]) == want


def test_rare_shingles_are_numbers_in_the_order_of_their_frequency(spark):
    rng = random.Random(5)
    base = [unspaced(rng, 120) for _ in range(4)]
    lines = [*base, *(x[:60] + unspaced(rng, 6) + x[60:] for x in base), *(base[k][:100] + base[0][:20] for k in range(4))]
    sets = spark.createDataFrame([(k, len(grams(x)), x) for k, x in enumerate(lines)], "l1 long, n int, norm string")
    names = spark.createDataFrame([(k, k) for k in range(len(lines))], "l1 long, c long")
    got = {r["l1"]: r["rare"] for r in line_dedup._rarest(line_dedup.materialize(names), sets).collect()}
    often = Counter(g for x in lines for g in grams(x))
    for k, rare in got.items():
        frequencies = sorted(often[g] for g in grams(lines[k]) if often[g] > 1)
        assert rare == sorted(rare)
        assert [x >> line_dedup.NAME_BITS for x in rare] == frequencies[: len(rare)]
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            if 100 * len(grams(a) & grams(b)) >= 80 * len(grams(a) | grams(b)):
                assert set(got[i]) & set(got[j])
