"""Operators whose state outlives a batch of a stream: windows of so many lines, and templates that grow with the lines.

State is kept for each key, is written with the query's checkpoint and so survives restarts, and is forgotten a time after the
key's last line, by event time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logsift.sources.logs import masked
from logsift.sources.templates import Leaf, branch, tokens_of

#: What Spark needs for operators with timers and several states.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Pandas = Iterator[pd.DataFrame]


#: Groups that keys are dealt to by hash: reading and writing state costs by the group, not by the key.
KEY_GROUPS = 1024


class _FixedCount(StatefulProcessor):
    """Lines of a group of keys wait until the watermark has passed them, so that none can come before them any more; then they are
    counted key by key in the order of time and id."""

    def __init__(self, size: int, idle_ms: int) -> None:
        self.size, self.idle_ms = size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "key string, at long, id long, y int")
        self.open = handle.getListState("open", "key string, window_no long, n long, y int, last long")
        self.due = handle.getValueState("due", "at long")  # of the group's only timer

    def _wake(self, at: int) -> None:
        due = self.due.get()[0] if self.due.exists() else None
        if due is None or at < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key: Any, rows: Pandas, timerValues: Any) -> Pandas:
        for b in rows:
            keys = b["key"].astype(object).where(b["key"].notna(), None).tolist()
            self.waiting.appendList(list(zip(keys, b["at"].tolist(), b["id"].tolist(), b["y"].tolist(), strict=True)))
            self._wake(int(b["at"].min()))
        yield from ()

    def _count(self, ready: list[tuple], state: tuple, passed: int) -> tuple[list[tuple], tuple]:
        """Windows that the lines (at, y) of a key, in order, and idleness until now close; the state after them."""
        (no, n, y, last), out = state, []
        for at, v in [*ready, (passed, None)]:  # the last is no line: it closes what has been idle until now
            if last is not None and at >= last + self.idle_ms:
                out += [(no, n, y)] if n else []
                no, n, y, last = 0, 0, 0, None
            if v is not None:
                n, y, last = n + 1, max(y, v) if n else v, at
            if n == self.size:
                out.append((no, n, y))
                no, n, y = no + 1, 0, 0
        return out, (no, n, y, last)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Pandas:
        passed = timerValues.getCurrentWatermarkInMs()
        ready: dict[Any, list[tuple]] = {}
        later = []
        for r in sorted(map(tuple, self.waiting.get()) if self.waiting.exists() else (), key=lambda r: r[1:]):
            if r[1] <= passed:
                ready.setdefault(r[0], []).append((r[1], r[3]))
            else:
                later.append(r)
        held = {r[0]: tuple(r)[1:] for r in self.open.get()} if self.open.exists() else {}
        out = []
        for k in [*held, *(k for k in ready if k not in held)]:
            found, state = self._count(ready.get(k, []), held.get(k, (0, 0, 0, None)), passed)
            out += [(k, *w) for w in found]
            held[k] = state
        held = {k: v for k, v in held.items() if v[3] is not None}
        for state, rows in ((self.waiting, later), (self.open, [(k, *v) for k, v in held.items()])):
            state.put(rows) if rows else state.clear()
        self.due.clear()
        ahead = [later[0][1]] if later else []
        ahead += [v[3] + self.idle_ms for v in held.values()]
        if ahead:
            self._wake(min(ahead))
        if out:
            keys, *rest = zip(*out, strict=True)
            yield pd.DataFrame({"key": pd.Series(keys, dtype=object), **dict(zip(("window_no", "n", "y"), rest, strict=True))})


def fixed_count(lines: DataFrame, size: int, key: str, idle: str = "30 days") -> DataFrame:
    """(key, window_no, n, y) of windows of ``size`` successive lines of a key, as sequences.fixed_count() makes them of lines
    that are not too late.

    lines: a stream (key, ts with a watermark, id, y). A full window is written once the watermark has passed its last
    line. After a gap of ``idle`` a key begins again with window 0: then a window that is not full is written and the key
    forgotten, as soon as the watermark has passed the gap. Lines without a time are left out, those without a key are a
    key of their own; without an id a line comes first among those of its time.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = lines.schema[key].dataType.simpleString()
    y, line = F.coalesce(F.col("y").cast("int"), F.lit(0)), F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))
    group = F.pmod(F.xxhash64(key), F.lit(KEY_GROUPS))
    held = lines.where("ts IS NOT NULL").select(group.alias("group"), F.col(key).cast("string").alias("key"), "ts", F.unix_millis("ts").alias("at"), line.alias("id"), y.alias("y")).groupBy("group")
    processor = _FixedCount(size, int(pd.Timedelta(idle).total_seconds() * 1000))
    found = held.transformWithStateInPandas(processor, "key string, window_no long, n long, y int", "Append", "EventTime")
    return found.select(F.col("key").cast(kind).alias(key), "window_no", "n", "y")


class _Templates(StatefulProcessor):
    """The templates of a leaf, and the texts that have joined them."""

    def __init__(self, similarity: float, idle_ms: int) -> None:
        self.similarity, self.idle_ms = similarity, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.templates = handle.getMapState("templates", "place int", "cluster long, template string")
        self.joined = handle.getMapState("joined", "masked string", "place int")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key: Any, rows: Pandas, timerValues: Any) -> Pandas:
        lines = pd.concat(list(rows)).sort_values(["line_id", "masked"])
        held = sorted((k[0], v[0], v[1]) for k, v in self.templates.iterator()) if self.templates.exists() else []
        leaf, cluster = Leaf(self.similarity, int(key[0])), [c for _, c, _ in held]
        before = [t for _, _, t in held]
        for t in before:
            leaf.begin(t.split(" "))
        places: dict[str, int] = {}
        first = lines.drop_duplicates("masked")  # a text is clustered once, at its first line
        for text, line in zip(first["masked"], first["line_id"], strict=True):
            known = self.joined.getValue((text,)) if self.joined.containsKey((text,)) else None
            if known is None:
                places[text] = leaf.add(text.split(" "))
                self.joined.updateValue((text,), (places[text],))
                if places[text] == len(cluster):
                    cluster.append(int(line))
            else:
                places[text] = known[0]
        now = [leaf.template(k) for k in range(leaf.n)]
        for k in range(leaf.n):
            if k >= len(before) or now[k] != before[k]:
                self.templates.updateValue((k,), (cluster[k], now[k]))
        due = int(lines["at"].max()) + self.idle_ms
        old = self.due.get()[0] if self.due.exists() else 0
        if due > old:
            if old:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
            self.due.update((due,))
        place = [places[t] for t in lines["masked"]]
        yield pd.DataFrame({"line_id": lines["line_id"], "cluster": [cluster[k] for k in place], "template": [now[k] for k in place]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Pandas:
        for state in (self.templates, self.joined, self.due):
            state.clear()
        yield from ()


def online_templates(lines: DataFrame, similarity: float = 0.5, idle: str = "30 days") -> DataFrame:
    """(line_id, cluster, template): each line with the template that it joined, as it is after the batch of the line; templates
    only grow more general, so that a cluster's last line has its last template.

    lines: a stream (line_id, ts with a watermark, content). For lines in the order of their ids, and as long as no node of the
    tree runs out of branches, the clusters are those of logs.mine_templates(); online there is no limit of branches, since it
    would make one task see all lines of a length. A leaf (length and first token) is forgotten when the watermark is ``idle`` past
    its last line.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    text = masked(F.col("content"))
    held = lines.where(text.isNotNull() & F.col("line_id").isNotNull() & F.col("ts").isNotNull()).select("line_id", "ts", F.unix_millis("ts").alias("at"), text.alias("masked"))
    tokens = tokens_of(F.col("masked"))
    held = held.withColumn("size", F.size(tokens)).withColumn("head", branch(tokens[0]))
    processor = _Templates(similarity, int(pd.Timedelta(idle).total_seconds() * 1000))
    return held.groupBy("size", "head").transformWithStateInPandas(processor, "line_id long, cluster long, template string", "Append", "EventTime")
