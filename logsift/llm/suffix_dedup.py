"""Removal of byte strings of a minimum length that repeat anywhere in a corpus.

One suffix array over all documents would have to stand in one task. So windows of ``length`` bytes are first dealt to
classes that no two equal ones can be parted by: by the window's anchor, the ``anchor``-byte string inside it with the least
hash. Anchors that occur once, and runs of successive windows with one anchor that are copies as a whole, are settled
then. What is left, different runs that share an anchor, is searched in the tasks that classes are dealt to: suffixes sorted,
their Burrows-Wheeler transform extended backward up to ``length`` (bwt.py). Only a class of more than CLASS_ROWS different
runs, which would be too much for one task, is parted further by hashes of its windows and searched by these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.bwt import repeated_starts
from logsift.llm.common import broadcast_if_small, materialize, mix64, pieces, prefix_hash, span_hash, text_bytes, arrow_map

#: Bytes of text at a time, and of the runs that are searched together; different runs of a class beyond which it is parted
#: by hashes of windows.
BLOCK, CLASS_ROWS = 1 << 20, 500
#: Rows of the tables of spans (a few numbers for each text) that are broadcast.
SPAN_ROWS = 200_000
_PLACE = np.uint64((1 << 24) - 1)


def _blocks(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, bytes of it that are before, bytes, offsets): windows of a long text begin in one block each."""
    for a, b in pieces(offsets, BLOCK):
        if b - a > 1 or offsets[b] - offsets[a] <= BLOCK + length:
            yield a, 0, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            continue
        for skip in range(0, int(offsets[b] - offsets[a]) - length + 1, BLOCK):
            part = data[offsets[a] + skip : min(offsets[b], offsets[a] + skip + BLOCK + length - 1)]
            yield a, skip, part, np.array([0, len(part)])


def runs(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (text, first window, last window, anchor's hash, name of the run's bytes)."""
    wide = length - anchor + 1
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    sums, at = prefix_hash(data), np.arange(len(data) - anchor + 1)
    hashes = span_hash(sums, at, at + anchor)
    ranks = (hashes & ~_PLACE) | (_PLACE - at.astype(np.uint64))  # of equal hashes the last one
    count = len(ranks) - wide + 1
    grid = np.concatenate([ranks, np.full(-len(ranks) % wide, np.uint64(2**64 - 1))]).reshape(-1, wide)
    ahead = np.minimum.accumulate(grid, 1).ravel()[wide - 1 : wide - 1 + count]
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()[:count]
    chosen = (_PLACE - (np.minimum(ahead, behind) & _PLACE)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:count]
    window = np.flatnonzero(np.arange(count) + length <= offsets[text + 1])
    text, chosen = text[window], chosen[window]
    new = np.ones(len(window), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(window) - 1)[: len(first)]
    a, b = window[first], window[last]
    name = mix64(span_hash(sums, a, b + length) + (chosen[first] - a).astype(np.uint64))
    return text[first], a - offsets[text[first]], b - offsets[text[first]], hashes[chosen[first]], name


def _found(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, skip, part, at in _blocks(data, offsets, length):
                text, first, last, fp, name = runs(part, at, length, anchor)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text + a)), pa.array(first + skip), pa.array(last + skip), pa.array(fp.view(np.int64)), pa.array(name.view(np.int64))],
                    names=["uid", "first", "last", "fp", "name"],
                )

    return arrow_map(texts, run, "uid binary, first long, last long, fp long, name long")


def _bytes(held: DataFrame, length: int) -> DataFrame:
    """(fp, uid, first, run) of runs: held has (uid, text, runs of (first, last, fp, salts))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out: list[list] = [[], [], [], []]
            for k, runs_ in enumerate(batch.column(2).to_pylist()):
                raw = data[offsets[k] : offsets[k + 1]].tobytes()
                for r in runs_:
                    for x, y in zip(out, (r["fp"], k, r["first"], raw[r["first"] : r["last"] + length]), strict=True):
                        x.append(y)
            uid = batch.column(0).take(pa.array(out[1], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), uid, pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["fp", "uid", "first", "run"])

    return arrow_map(held, run, "fp long, uid binary, first long, run binary")


def _searched(dealt: DataFrame, length: int) -> DataFrame:
    """Spans (uid, first, end) of strings that stand twice in the runs of a class; dealt is sorted by fp in each partition. Several
    small classes are searched together: strings of two classes are never equal, since their anchors differ."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        found = repeated_starts(table["run"].to_pylist(), length)
        row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        at = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64) + table["first"].to_numpy()[row]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:] - 1, len(row) - 1)[: len(a)]
        uid = table["uid"].combine_chunks().take(pa.array(row[a]))
        return pa.RecordBatch.from_arrays([uid if isinstance(uid, pa.Array) else uid.combine_chunks(), pa.array(at[a]), pa.array(at[b] + length)], names=["uid", "first", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, sizes = batch.column(0).to_numpy(), pc.binary_length(batch.column(3)).to_numpy()
            edges = [0, *(np.flatnonzero(fp[1:] != fp[:-1]) + 1).tolist(), len(fp)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):  # classes
                if size >= BLOCK and fp[a] != last:
                    yield settle(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size, last = size + int(sizes[a:b].sum()), fp[a]
        if held:
            yield settle(held)

    return arrow_map(dealt, run, "uid binary, first long, end long")


def _windows(held: DataFrame, length: int) -> DataFrame:
    """Window hashes of the runs of large classes, dealt by salt: held has (uid, text, runs of (first, last, fp, salts))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out: list[list] = [[], [], [], [], []]
            for k, runs_ in enumerate(batch.column(2).to_pylist()):
                raw = data[offsets[k] : offsets[k + 1]]
                for r in runs_:
                    part = raw[r["first"] : r["last"] + length]
                    at = np.arange(r["last"] - r["first"] + 1)
                    hashes = span_hash(prefix_hash(part), at, at + length)
                    salt = (hashes % np.uint64(r["salts"])).astype(np.int64)
                    for s in np.unique(salt):
                        mine = salt == s
                        for x, y in zip(out, (k, r["fp"], int(s), at[mine] + r["first"], hashes[mine].view(np.int64)), strict=True):
                            x.append(y)
            n = np.zeros(len(out[0]) + 1, np.int32)
            np.cumsum([len(x) for x in out[3]], out=n[1:])
            lists = [pa.ListArray.from_arrays(pa.array(n), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in out[3:]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), batch.column(0).take(pa.array(out[0], pa.int64())), *lists],
                names=["fp", "salt", "uid", "at", "hashes"],
            )

    return arrow_map(held, run, "fp long, salt long, uid binary, at array<long>, hashes array<long>")


def _repeated(dealt: DataFrame, length: int) -> DataFrame:
    """Spans (uid, first, end) of windows found twice in a class; dealt is sorted by fp and salt in each partition."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        lists = table.column("hashes").combine_chunks()
        hashes = lists.flatten().to_numpy().view(np.uint64)
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        at = table.column("at").combine_chunks().flatten().to_numpy()
        fp = table.column("fp").to_numpy().view(np.uint64)
        _, which, count = np.unique(mix64(hashes ^ mix64(fp[row])), return_inverse=True, return_counts=True)
        twice = count[which] > 1
        row, at = row[twice], at[twice]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:] - 1, len(row) - 1)[: len(a)]
        uid = table.column("uid").combine_chunks().take(pa.array(row[a]))
        return pa.RecordBatch.from_arrays([uid, pa.array(at[a]), pa.array(at[b] + length)], names=["uid", "first", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            fp, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.flatnonzero((fp[1:] != fp[:-1]) | (salt[1:] != salt[:-1])) + 1
            before = held[-1] if held else None
            if before is not None and batch.num_rows and (before.column(0)[-1].as_py(), before.column(1)[-1].as_py()) != (int(fp[0]), int(salt[0])):
                yield settle(pa.Table.from_batches(held))
                held = []
            if len(new):
                yield settle(pa.Table.from_batches([*held, batch.slice(0, int(new[-1]))]))
                held = [batch.slice(int(new[-1]))]
            elif batch.num_rows:
                held.append(batch)
        if held:
            yield settle(pa.Table.from_batches(held))

    return arrow_map(dealt, run, "uid binary, first long, end long")


def _cut(held: DataFrame) -> DataFrame:
    """held has (id, text, spans of (first, end)); spans that overlap or touch become one."""

    def merged(spans: list[dict]) -> list[tuple[int, int]]:
        at = np.array([(c["first"], c["end"]) for c in spans], np.int64).reshape(-1, 2)
        at = at[np.argsort(at[:, 0], kind="stable")]
        ends = np.maximum.accumulate(at[:, 1])
        new = np.append(True, at[1:, 0] > ends[:-1])[: len(at)]
        return list(zip(at[new, 0].tolist(), ends[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)].tolist() if len(at) else [], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            removed, spans, digest, kept_texts = [], [], [], []
            for k, cuts in enumerate(batch.column(2).to_pylist()):
                raw, at, kept = data[offsets[k] : offsets[k + 1]].tobytes(), 0, []
                cuts = merged(cuts or [])
                for first, end in cuts:
                    kept.append(raw[at:first])
                    at = end
                kept.append(raw[at:])
                left = b"".join(kept)
                removed.append(len(raw) - len(left))
                spans.append(len(cuts))
                digest.append(hashlib.sha256(left).hexdigest())
                kept_texts.append(left)
            n = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_texts, pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return arrow_map(held, run, f"id {held.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeated_spans(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """(uid, spans): for each text with repeats, runs of bytes that repeated strings cover, in any order; they may overlap.

    texts: (uid, text), where rows of one uid have one text.
    """
    found = materialize(_found(texts, length, anchor))
    shared = found.groupBy("fp").agg(F.count("*").alias("n"), F.min("name").alias("x"), F.max("name").alias("y")).where("n > 1")
    shared = materialize(shared.select("fp", F.expr("x = y").alias("same")))
    hits = materialize(found.join(broadcast_if_small(shared), "fp"))
    mixed = hits.where("NOT same")
    counts = materialize(mixed.groupBy("fp", "name").agg(F.count("*").alias("n"), F.min(F.struct("uid", "first", "last")).alias("one")))
    classes = materialize(counts.groupBy("fp").agg((F.count("*") / CLASS_ROWS + 1).cast("long").alias("salts")))
    single = counts.join(broadcast_if_small(classes), "fp").select("one.*", "fp", "salts")
    copied = materialize(counts.where("n > 1").select("fp", "name"))
    several = mixed.join(broadcast_if_small(copied), ["fp", "name"], "left_semi")

    asked = materialize(single.groupBy("uid").agg(F.collect_list(F.struct("first", "last", "fp", "salts")).alias("runs")))
    held = texts.join(broadcast_if_small(asked, SPAN_ROWS), "uid").select("uid", "text", "runs")
    which = lambda large: F.filter("runs", lambda r: (r["salts"] > 1) == large)
    some = lambda large: held.withColumn("runs", which(large)).where(F.size("runs") > 0)
    dealt = _bytes(some(False), length).repartition("fp").sortWithinPartitions("fp", "uid", "first")
    large = _windows(some(True), length).repartition("fp", "salt").sortWithinPartitions("fp", "salt")
    whole = hits.where("same").unionByName(several.select(hits.columns)).select("uid", "first", (F.col("last") + length).alias("end"))
    spans = _searched(dealt, length).unionByName(_repeated(large, length)).unionByName(whole).distinct()

    return spans.groupBy("uid").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 400, anchor: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each byte that lies in a string of length bytes which also starts anywhere else.

    Strings never span texts, are judged on the input, and may overlap, in one text too. Returns (id_col, n_bytes,
    n_removed, n_spans, kept_sha256, kept), a row for each row of docs; kept has the bytes that are left, which may cut
    a character. A null text counts as empty; shorter texts than length stay whole; of repeated rows with such texts all
    bytes go. Ids may be null or repeat. Other columns are ignored; an empty table gives an empty one.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("uid", F.unhex(F.md5("text")))
    spans = materialize(repeated_spans(texts.select("uid", "text"), length, anchor))
    held = texts.join(broadcast_if_small(spans, SPAN_ROWS), "uid", "left").select("id", "text", "spans")
    return _cut(held).withColumnRenamed("id", id_col)
