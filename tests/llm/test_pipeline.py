import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = {"en": "the and of with house time by or that from".split(), "fr": "le que été même où château dans une est pour".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    text = lambda lang, n: "\n".join(" ".join(rng.choice(WORDS[lang]) + str(rng.randint(0, 999)) for _ in range(15)) for _ in range(n))
    rows = [(i, text(lang, 4), lang, f"s{i % 3}") for i, lang in enumerate(["en", "fr"] * 30)]
    near = rows[0][1].split(" ")
    near[5] = "changed"
    rows += [(100, rows[2][1], "en", "s0"), (101, " ".join(near), "en", "s1"), (102, "123 456", "en", "s2"), (103, None, "en", "s0"), (104, "", None, None), (105, "the " * 6000, "en", "s1")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_keep_the_columns_and_do_their_work(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "minhash_near_dedup", "mix_sources", "pack"]
    found = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = corpus_pipeline.materialize(stage(spark, found, folder))
        assert found.schema.simpleString() == docs.schema.simpleString(), name
        ids = {r["doc_id"] for r in found.select("doc_id").collect()}
        if name == "language_id":
            assert ids == set(range(60)) | {100, 101, 105}
        if name == "line_dedup":
            assert {r["doc_id"]: r["text"] for r in found.collect()}[100] == ""


def test_near_duplicates_leave_one_of_each_group(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {100, 101}


def test_run_packs_what_is_left(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and max(r["length"] for r in rows) <= 4096
    for s in {r["sequence_id"] for r in rows}:
        mine = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert [o for o, _ in mine] == [0, *np.cumsum([n for _, n in mine])[:-1]] and sum(n for _, n in mine) <= 4096


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_pass_through_and_n_chars_may_be_missing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("n_chars")
    names = ["score", "Ambiguous", "n_dropped", "_parts", "copy", "mix_copies", "_key", "kept", "a.b"]
    more = docs.select("*", *[F.concat(F.lit(f"{n}:"), "doc_id").alias(n) for n in names])
    more = corpus_pipeline.materialize(more.unionByName(more.where("doc_id < 5")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = corpus_pipeline.materialize(stage(spark, more, folder))
        assert got.columns == more.columns, name
        assert got.count() > 0 and all(r[n] == f"{n}:{r['doc_id']}" for r in got.collect() for n in names), name
