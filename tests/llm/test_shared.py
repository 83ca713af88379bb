import random

import numpy as np
import pyarrow as pa
import pytest

from logsift.llm import common
from logsift.llm.components import connected_components


@pytest.mark.parametrize("shape", ["star", "chain", "random", "none"])
def test_components_equal_union_find(spark, shape):
    rng = random.Random(2)
    edges = {"star": [(0, k) for k in range(1, 200)], "chain": [(k, k + 1) for k in range(60)], "random": [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)], "none": []}[shape]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    df = spark.createDataFrame(edges + [(None, 1)] if edges else [], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {x: find(x) for x in parent}


def test_words_and_hashes_do_not_depend_on_place():
    texts = ["  the cat\tsat ", "", None, "cat\x0bthe", "x"]
    data, offsets = common.text_bytes(pa.array(["skipped", *texts]).slice(1))
    starts, ends, owner = common.word_spans(data, offsets)
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert words == ["the", "cat", "sat", "cat", "the", "x"] and owner.tolist() == [0, 0, 0, 3, 3, 4]
    h = common.span_hash(common.prefix_hash(data), starts, ends)
    assert h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 4
    assert common.pieces(np.array([0, 5, 5, 30, 31]), 10) == [(0, 2), (2, 3), (3, 4)]


def test_lower_case_of_ascii_only(spark):
    df = spark.createDataFrame([("ABC É İ",), ("ABC",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(common.ascii_lower(df.t)).collect()] == ["abc É İ", "abc", None, ""]
