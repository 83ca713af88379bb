"""Template mining against a plain tree, and as a stream."""

import datetime as dt
import random
import tempfile
from collections import defaultdict

import pytest

from logsift.sources import logs
from logsift.sources.templates import WILDCARD, Tree
from logsift.streaming import stateful, windows


def plain(lines, tree):
    """(line, cluster, template) by a tree in one task: distinct texts in the order of their first lines."""
    first = {}
    for i, text in sorted(lines):
        first.setdefault(text, i)
    texts = sorted((i, t) for t, i in first.items())
    paths = {t: (len(t.split(" ")),) for _, t in texts}
    for k in range(tree.depth - 3):
        named = lambda t: t.split(" ")[k] if k < len(t.split(" ")) else ""  # noqa: B023, E731
        own = defaultdict(list)
        for _, t in texts:
            name = named(t)
            if not any(c.isdigit() for c in name) and name != WILDCARD and name not in own[paths[t]]:
                own[paths[t]].append(name)
        paths = {t: (*p, named(t) if named(t) in own[p][: tree.children - 1] else WILDCARD) for t, p in paths.items()}
    leaves, joined = defaultdict(list), {}
    for i, t in texts:
        tokens, leaf = t.split(" "), leaves[paths[t]]
        same = [sum(a == b and b != WILDCARD for a, b in zip(tokens, c[1], strict=True)) for c in leaf]
        best = same.index(max(same)) if same else -1
        if best < 0 or same[best] < tree.similarity * len(tokens):
            leaf.append([i, tokens])
            best = len(leaf) - 1
        leaf[best][1] = [a if a == b else WILDCARD for a, b in zip(leaf[best][1], tokens, strict=True)]
        joined[t] = leaf[best]
    return sorted((i, joined[t][0], " ".join(joined[t][1])) for i, t in lines)


def mined(spark, lines, tree, parts):
    df = spark.createDataFrame(lines, "line_id long, content string").repartition(parts)
    return sorted(map(tuple, logs.mine_templates(df, tree).select("line_id", "cluster", "template").collect()))


def words(rng, n):
    return " ".join(rng.choice(["up", "down", "disk", "net", "cpu", "at"]) if rng.random() < 0.8 else rng.choice("ABCDEFGH") for _ in range(n))


@pytest.mark.parametrize("tree", [Tree(), Tree(similarity=0.7, depth=5, children=4), Tree(depth=3), Tree(depth=6, children=2)])
def test_small_leaves_are_those_of_a_plain_tree(spark, tree):
    rng = random.Random(tree.depth)
    lines = [(i, words(rng, rng.randint(1, 5))) for i in range(400)] + [(400, ""), (401, "up"), (402, "up  down")]
    assert mined(spark, lines, tree, 5) == plain(lines, tree)
    assert mined(spark, [], tree, 1) == [] and mined(spark, [(1, None), (None, "x")], tree, 1) == []


def test_a_large_leaf_is_dealt_to_many_tasks_and_merged(spark):
    rng = random.Random(4)
    kinds = [["kernel", *(f"{w}{chr(97 + k)}" for w in ("read", "of", "unit", "ended", "with"))] for k in range(6)]
    name = lambda: "".join(rng.choices("abcdefghij", k=8))
    lines = []
    for i in range(12_000):
        tokens = list(rng.choice(kinds))
        tokens[rng.choice([3, 5])] = name()
        lines.append((i, " ".join(tokens)))
    found = mined(spark, lines, Tree(split=500), 7)
    assert found == mined(spark, lines[::-1], Tree(split=500), 3) == plain(lines, Tree())
    assert len({t for _, _, t in found}) == 6


STREAM = "line_id long, ts timestamp, content string"


class Online:
    def __init__(self, spark, idle):
        self.spark, self.idle, self.folder = spark, idle, tempfile.mkdtemp(prefix="spark-")

    def add(self, lines):
        at = dt.datetime(2024, 1, 1)
        self.spark.createDataFrame([(i, at + dt.timedelta(minutes=m), t) for i, m, t in lines], STREAM).coalesce(1).write.mode("append").parquet(self.folder)

    def run(self):
        source = self.spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(self.folder)
        out = stateful.online_templates(windows.with_time(source, "10 minutes"), idle=self.idle)
        q = out.writeStream.format("parquet").option("path", f"{self.folder}-out").option("checkpointLocation", f"{self.folder}-state").trigger(availableNow=True)
        q.start().awaitTermination()
        return sorted(map(tuple, self.spark.read.parquet(f"{self.folder}-out").select("line_id", "cluster", "template").collect()))


def test_a_stream_finds_the_templates_of_the_batch_across_a_restart(spark):
    rng, online = random.Random(5), Online(spark, "30 days")
    lines = [(i, i // 10, words(rng, rng.randint(3, 4))) for i in range(240)]
    online.add(lines[:80])
    early = online.run()
    online.add(lines[80:160])
    online.add(lines[160:])  # from the checkpoint, in two batches
    found, want = online.run(), mined(spark, [(i, t) for i, _, t in lines], Tree(), 3)
    assert [r for r in found if r[0] < 80] == early
    assert [(i, c) for i, c, _ in found] == [(i, c) for i, c, _ in want]
    last = {c: t for _, c, t in found}
    assert last == {c: t for _, c, t in want}


def test_a_leaf_is_forgotten_when_it_has_been_idle(spark):
    online = Online(spark, "1 hours")
    online.add([(1, 0, "disk A failed here"), (2, 1, "disk B failed here")])
    online.add([(3, 300, "net up")])
    online.add([(4, 310, "net up again now")])  # the watermark has passed the first leaf's hour
    online.add([(5, 320, "disk C failed here")])
    assert online.run() == [(1, 1, "disk <*> failed here"), (2, 1, "disk <*> failed here"), (3, 3, "net up"), (4, 4, "net up again now"), (5, 5, "disk C failed here")]
