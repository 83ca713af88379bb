"""Networks, word vectors and one-class models fitted on all rows of a table, for many groups and configurations in the same jobs.

Rows are dealt to shards of a bounded size by a hash of their ids. In a round each shard is trained on, from the same
parameters, in the task that holds it, in the order of its ids; then the parameters are averaged, weighted by rows. Sums
are taken in the order of shards, or are exact decimals, so that a fit depends neither on partitions nor on the order of tasks. A
table that fits into one shard is trained on in one task as a whole, by the same steps. The driver holds a model for each group and configuration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.operators.models import Network, OneClass, fit_one_class
from logsift.operators.ranks import quantiles
from logsift.session import shared_dir

#: Rows, and sequences, of a shard, about.
SHARD_ROWS, SHARD_SEQUENCES = 20_000, 5_000
#: Bytes of vectors in a row of a packed shard, about.
PACKED = 4 << 20
#: Parameters, and words, whose numbers are added up together.
BLOCK, BLOCK_WORDS = 2_048, 64


@dataclass(frozen=True)
class Setup:
    """A network: hidden layers, weight penalty, seed, most epochs, rows of a step, epochs without progress until it stops."""

    hidden: tuple[int, ...] = (32, 16, 32)
    alpha: float = 1e-4
    seed: int = 42
    epochs: int = 100
    batch: int = 200
    patience: int = 10


# --- shards --------------------------------------------------------------------------------------------------


@dataclass
class Shards:
    rows: DataFrame  # (g, shard, held, id, value), a shard to a partition; packed: (g, shard, held, value), of many rows each, as bytes
    groups: list  # the group of each g
    most: int  # shards of the largest group


def deal(rows: DataFrame, value: str, by: str | None, key: str, size: int, pack: bool = False) -> Shards:
    """rows in shards of about ``size`` rows of a group. A tenth, by a hash of the key, is held for the stopping rule. pack: vectors that
    are read in each round are kept as bytes of many rows; read one by one they took longer than an epoch."""
    shared_dir(rows.sparkSession)
    group = F.col(by) if by else F.lit(0)
    counts = {r["g"]: r["n"] for r in rows.groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect()}  # a row for each group
    groups = sorted(counts)
    if not groups:
        return Shards(rows.limit(0).select(F.lit(0).alias("g"), F.lit(0).alias("shard"), F.lit(False).alias("held"), F.col(key).alias("id"), F.col(value).alias("value")), [], 0)
    many = {g: -(-counts[g] // size) for g in groups}
    number = lambda of: F.create_map(*[F.lit(v) for g in groups for v in (g, of(g))])[group]
    held = rows.select(
        number(groups.index).alias("g"), F.pmod(F.xxhash64(F.lit("shard"), key), number(many.get)).cast("int").alias("shard"),
        (F.pmod(F.xxhash64(F.lit("held"), key), F.lit(10)) == 0).alias("held"), F.col(key).alias("id"), F.col(value).alias("value"),
    )
    first = np.cumsum([0, *[many[g] for g in groups]]).tolist()  # shards of the groups before
    place = F.element_at(F.array(*map(F.lit, first)), F.col("g") + 1) + F.col("shard")
    dealt = held.repartitionById(first[-1], place.cast("int")).sortWithinPartitions("g", "shard", "id", "value")
    if pack:
        dealt = dealt.mapInArrow(packed, "g int, shard int, held binary, value binary")
    return Shards(dealt.checkpoint(), groups, max(many.values()))


def in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """(g, shard, its rows) one after the other."""
    waiting: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not len(b):
            continue
        keys = np.stack([b.column("g").to_numpy(), b.column("shard").to_numpy()])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), len(b)]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            key = (int(keys[0, a]), int(keys[1, a]))
            if now is not None and key != now:
                yield *now, pa.Table.from_batches(waiting)
                waiting = []
            now = key
            waiting.append(b.slice(a, z - a))
    if now is not None:
        yield *now, pa.Table.from_batches(waiting)


def matrix(t: pa.Table) -> np.ndarray:
    flat = t["value"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(len(t), -1)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard, in their order, as bytes."""
    for b in batches:
        for g, shard, t in in_shards(iter([b])):
            m, held = matrix(t), t["held"].to_numpy().astype(bool)
            n = max(1, PACKED // max(1, 8 * m.shape[1]))
            for a in range(0, len(m), n):
                columns = [pa.array([g], pa.int32()), pa.array([shard], pa.int32()), *(pa.array([x[a : a + n].tobytes()], pa.binary()) for x in (held, m))]
                yield pa.RecordBatch.from_arrays(columns, names=["g", "shard", "held", "value"])


def unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a packed shard, and which are held."""
    held = np.frombuffer(b"".join(t["held"].to_pylist()), bool)
    return np.frombuffer(b"".join(t["value"].to_pylist())).reshape(len(held), -1), held


def exact_sum(c: Column | str) -> Column:
    """A sum that does not depend on the order of rows; numbers keep 15 digits after the point."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(38,15)")).cast("double")


# --- networks ------------------------------------------------------------------------------------------------


@dataclass
class State:
    """A network in training: parameters, both moments of their gradients, steps, and what the stopping rule knows."""

    sizes: list[int]
    flat: np.ndarray  # (3, parameters)
    steps: float = 0
    best: float = np.inf
    kept: np.ndarray | None = None
    waited: int = 0
    losses: list[float] = field(default_factory=list)

    def layers(self, row: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes[:-1], self.sizes[1:], strict=True):
            out.append((row[at : at + a * b].reshape(a, b), row[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def output(self, x: np.ndarray) -> np.ndarray:
        return Network(np.zeros(0), self.layers(self.flat[0])).output(x)

    def judged(self, loss: float, patience: int) -> bool:
        """Takes the loss of the present parameters down; whether to stop."""
        self.losses.append(loss)
        if loss < self.best - 1e-4 * min(self.best, 1):
            self.best, self.kept, self.waited = loss, self.flat[0].copy(), 0
        else:
            self.waited += 1
        return self.waited >= patience

    def network(self, mean: np.ndarray) -> Network:
        kept = self.flat[0] if self.kept is None else self.kept
        return Network(mean, [(w.copy(), b.copy()) for w, b in self.layers(kept)], self.losses)


def begin(d: int, s: Setup) -> State:
    rng, sizes, parts = np.random.default_rng(s.seed), [d, *s.hidden, d], []
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        r = np.sqrt(6 / (a + b))
        parts += [rng.uniform(-r, r, a * b), rng.uniform(-r, r, b)]
    flat = np.concatenate(parts)
    return State(sizes, np.stack([flat, np.zeros_like(flat), np.zeros_like(flat)]))


def epoch(state: State, x: np.ndarray, s: Setup, number: int, shard: int) -> None:
    """Steps of Adam over all rows in a seeded order."""
    order = np.random.default_rng([s.seed, number, shard]).permutation(len(x))
    layers, grad = state.layers(state.flat[0]), np.zeros(state.flat.shape[1])
    slots = state.layers(grad)
    for at in range(0, len(x), s.batch):
        rows = x[order[at : at + s.batch]]
        acts = [rows]
        for i, (w, b) in enumerate(layers):
            z = acts[-1] @ w + b
            acts.append(np.maximum(z, 0) if i < len(layers) - 1 else z)
        back = (acts[-1] - rows) / len(rows)
        for i in reversed(range(len(layers))):
            slots[i][0][:] = acts[i].T @ back + s.alpha * layers[i][0] / len(rows)
            slots[i][1][:] = back.sum(0)
            back = (back @ layers[i][0].T) * (acts[i] > 0)
        state.steps += 1
        state.flat[1] = 0.9 * state.flat[1] + 0.1 * grad
        state.flat[2] = 0.999 * state.flat[2] + 0.001 * grad * grad
        state.flat[0] -= 1e-3 * (state.flat[1] / (1 - 0.9**state.steps)) / (np.sqrt(state.flat[2] / (1 - 0.999**state.steps)) + 1e-8)


def loss(state: State, x: np.ndarray) -> float:
    """Summed squared error."""
    return float(((state.output(x) - x) ** 2).sum())


def fit_whole(x: np.ndarray, held: np.ndarray, s: Setup) -> State:
    """A network fitted on the rows of one shard. Without held rows, or others, all rows take their part."""
    held = held & (not held.all())
    train, check = x[~held], x[held] if held.any() else x
    state = begin(x.shape[1], s)
    for k in range(s.epochs):
        epoch(state, train, s, k, 0)
        if state.judged(loss(state, check) / check.size, s.patience):
            break
    return state


def fit_networks(rows: DataFrame, setups: list[Setup], by: str | None = None, x: str = "x", key: str = "seq_id", shard: int = SHARD_ROWS) -> dict:
    """For each group (0, without ``by``) a network for each setup, from x to x, fitted on all its rows.

    After a round of one epoch in each shard, parameters and moments are averaged; the mean squared error on the held
    tenth tells when to stop, and the best parameters are kept. Rows of equal ids are taken in the order of their vectors; a table
    without rows gives no group.
    """
    dealt = deal(rows.where(F.col(x).isNotNull()), x, by, key, shard, pack=True)
    if not dealt.groups:
        return {}
    spark = rows.sparkSession
    means = _means(dealt.rows)
    jobs = [(g, c) for g in means for c in range(len(setups))]
    if dealt.most == 1:
        got = _whole(dealt.rows, means, setups)
        return {dealt.groups[g]: [got[g, c].network(means[g]) for c in range(len(setups))] for g in means}
    states = {(g, c): begin(len(means[g]), setups[c]) for g, c in jobs}
    open_ = set(jobs)
    for number in range(max(s.epochs for s in setups) + 1):
        held = spark.sparkContext.broadcast(({j: (states[j].sizes, states[j].flat, states[j].steps) for j in open_}, means))
        found = _round(dealt.rows, held, setups, number)
        held.unpersist()
        for job, (flat, steps, error, cells) in found.items():
            done = states[job].judged(error / cells, setups[job[1]].patience) if number and cells else False
            if done or number == setups[job[1]].epochs:
                open_.discard(job)
            else:
                states[job].flat, states[job].steps = flat, steps
        if not open_:
            break
    return {dealt.groups[g]: [states[g, c].network(means[g]) for c in range(len(setups))] for g in means}


def _means(rows: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each group, from sums of shards in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, shard, t in in_shards(batches):
            m, _ = unpacked(t)
            v = np.array([len(m), *m.sum(0, dtype=np.longdouble)], float)
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([shard], pa.int32()), pa.array([v], pa.list_(pa.float64()))], names=["g", "shard", "v"])

    def add(t: pa.Table) -> pa.Table:  # a row for each shard
        v = list_rows(t.sort_by("shard")["v"]).sum(0, dtype=np.longdouble)
        return pa.table({"g": t["g"].slice(0, 1), "v": pa.array([(v[1:] / v[0]).astype(float)], pa.list_(pa.float64()))})

    found = rows.mapInArrow(run, "g int, shard int, v array<double>").groupBy("g").applyInArrow(add, "g int, v array<double>").collect()  # a row for each group
    return {r["g"]: np.array(r["v"]) for r in sorted(found)}


def _whole(rows: DataFrame, means: dict, setups: list[Setup]) -> dict:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, _, t in in_shards(batches):
            m, held = unpacked(t)
            m = m - means[g]
            for c, s in enumerate(setups):
                state = fit_whole(m, held, s)
                flat = state.flat[0] if state.kept is None else state.kept
                yield pa.RecordBatch.from_pylist([{"g": g, "c": c, "sizes": state.sizes, "flat": flat.tolist(), "losses": state.losses}], schema=schema)

    schema = pa.schema([("g", pa.int32()), ("c", pa.int32()), ("sizes", pa.list_(pa.int64())), ("flat", pa.list_(pa.float64())), ("losses", pa.list_(pa.float64()))])
    made = rows.mapInArrow(run, "g int, c int, sizes array<long>, flat array<double>, losses array<double>").collect()  # models
    return {(r["g"], r["c"]): State(r["sizes"], np.array([r["flat"]]), losses=r["losses"]) for r in made}


def _round(rows: DataFrame, held, setups: list[Setup], number: int) -> dict:  # noqa: ANN001
    """For each open job: averaged (3, parameters) and steps after an epoch in each shard; squared error of what they started from on
    held rows, and how many numbers that is over."""
    schema = pa.schema([("g", pa.int32()), ("c", pa.int32()), ("block", pa.int32()), ("shard", pa.int32()), ("v", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, means = held.value
        for g, shard, t in in_shards(batches):
            m, check = unpacked(t)
            m = m - means[g]
            for c, s in enumerate(setups):
                if (g, c) not in starts:
                    continue
                sizes, flat, steps = starts[g, c]
                state = State(sizes, flat.copy(), steps)
                error = loss(state, m[check])
                epoch(state, m[~check], s, number, shard)
                n = int((~check).sum())
                v = np.concatenate([[n, state.steps * n, error, m[check].size], (state.flat * n).ravel()])
                v = np.where(np.abs(v) < 8, np.round(v, 15), v)  # 15 digits after the point, as in exact_sum()
                parts = [v[a : a + BLOCK] for a in range(0, len(v), BLOCK)]
                same = lambda x, k=len(parts): pa.array([x] * k, pa.int32())
                yield pa.RecordBatch.from_arrays([same(g), same(c), pa.array(range(len(parts)), pa.int32()), same(shard), pa.array(parts, pa.list_(pa.float64()))], schema=schema)

    def add(t: pa.Table) -> pa.Table:  # a row for each shard
        t = t.sort_by("shard").combine_chunks()
        return t.slice(0, 1).select(["g", "c", "block"]).append_column("v", pa.array([list_rows(t["v"]).sum(0)], pa.list_(pa.float64())))

    made = rows.mapInArrow(run, "g int, c int, block int, shard int, v array<double>").groupBy("g", "c", "block")
    parts = made.applyInArrow(add, "g int, c int, block int, v array<double>").toArrow().sort_by([("g", "ascending"), ("c", "ascending"), ("block", "ascending")])
    found: dict[tuple[int, int], list[np.ndarray]] = {}
    for r in range(len(parts)):  # parameters of each model
        found.setdefault((parts["g"][r].as_py(), parts["c"][r].as_py()), []).append(parts["v"][r].values.to_numpy())
    out = {}
    for job, blocks in found.items():
        v = np.concatenate(blocks)
        out[job] = (v[4:].reshape(3, -1) / v[0], v[1] / v[0], v[2], int(v[3]))
    return out


def list_rows(column: pa.ChunkedArray) -> np.ndarray:
    """The lists of a column, all of one length, as rows of a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def score_networks(rows: DataFrame, networks: dict, by: str | None = None, x: str = "x") -> DataFrame:
    """rows with err, the mean over the networks of a row's group of its reconstruction error, all in one pass. Rows of a group
    that has none, and rows without a vector, have no score."""
    held = rows.sparkSession.sparkContext.broadcast(networks)
    names = [*rows.columns, "err"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            err, groups = np.full(len(b), np.nan), np.array(b.column(by).to_pylist(), object) if by else np.zeros(len(b), int)
            there = b.column(x).is_valid().to_numpy(zero_copy_only=False)
            for g, nets in held.value.items():
                mine = there & (groups == g)
                if mine.any():
                    v = b.column(x).filter(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(mine.sum()), -1)
                    err[mine] = np.mean([net.errors(v) for net in nets], axis=0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(err, pa.float64(), from_pandas=True)], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, err double")


# --- word vectors --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Words:
    """Skip-gram with negative sampling: dimensions, words on each side at most, words drawn against each pair, epochs, first
    and last step size, share of a word's occurrences beyond which it is thinned out, pairs of a step."""

    dims: int = 32
    window: int = 5
    negative: int = 5
    epochs: int = 5
    rate: tuple[float, float] = (0.025, 1e-4)
    sample: float = 1e-3
    batch: int = 64
    seed: int = 42


def _pairs(ids: np.ndarray, seqs: np.ndarray, s: Words, keep: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(word, word near it) in a random order: frequent words are thinned out first, windows are of random width."""
    on = rng.random(len(ids)) < keep[ids]
    ids, seqs = ids[on], seqs[on]
    width = rng.integers(1, s.window + 1, len(ids))
    a, b = [], []
    for k in range(1, s.window + 1):
        same = seqs[k:] == seqs[:-k]
        left, right = np.flatnonzero(same & (width[:-k] >= k)), np.flatnonzero(same & (width[k:] >= k)) + k
        a += [ids[left], ids[right]]
        b += [ids[left + k], ids[right - k]]
    a, b = np.concatenate(a), np.concatenate(b)
    order = rng.permutation(len(a))
    return a[order], b[order]


def word_epoch(vectors: np.ndarray, ids: np.ndarray, seqs: np.ndarray, counts: np.ndarray, s: Words, number: int, shard: int) -> np.ndarray:
    """(2, words, dims), word and context vectors, after an epoch over the sequences of a shard."""
    rng, share = np.random.default_rng([s.seed, number, shard]), counts / counts.sum()
    keep = np.minimum(1, np.sqrt(s.sample / share) + s.sample / share)
    a, b = _pairs(ids, seqs, s, keep, rng)
    drawn = np.cumsum(counts**0.75)
    word, context = vectors.copy()
    first, last = s.rate
    for at in range(0, len(a), s.batch):
        rate = first + (last - first) * (number + at / len(a)) / s.epochs
        w, c = a[at : at + s.batch], b[at : at + s.batch]
        others = np.searchsorted(drawn, rng.random((len(w), s.negative)) * drawn[-1])
        targets = np.concatenate([c[:, None], others], 1)
        right = np.zeros(targets.shape)
        right[:, 0] = 1
        v, u = word[w], context[targets]
        step = rate * (right - 1 / (1 + np.exp(-np.clip(np.einsum("ij,ikj->ik", v, u), -30, 30))))
        step[:, 1:][others == c[:, None]] = 0  # a word drawn against itself
        np.add.at(word, w, np.einsum("ik,ikj->ij", step, u))
        np.add.at(context, targets, step[:, :, None] * v[:, None, :])
    return np.stack([word, context])


def first_vectors(n: int, s: Words) -> np.ndarray:
    rng = np.random.default_rng(s.seed)
    return np.stack([(rng.random((n, s.dims)) - 0.5) / s.dims, np.zeros((n, s.dims))])


def fit_words(sequences: DataFrame, words: Words | None = None, by: str | None = None, events: str = "events", key: str = "seq_id", shard: int = SHARD_SEQUENCES) -> DataFrame:
    """(group, term, dim, v) of all words of each group's sequences; group 0 without ``by``.

    sequences: (by, key, events), events an array of words in order. Each epoch trains all shards from the same
    vectors, which are then averaged, each word's weighted by its occurrences in the shard. The driver holds the vocabulary and
    its vectors, a vector for each group and word: words are templates of events. The result is the same in every run.
    """
    s, spark = words or Words(), sequences.sparkSession
    dealt = deal(sequences.where(F.col(events).isNotNull()), events, by, key, shard)
    kind = sequences.schema[by].dataType.simpleString() if by else "int"
    schema = f"group {kind}, term string, dim int, v double"
    counted = dealt.rows.select("g", F.explode("value").alias("term")).where("term IS NOT NULL").groupBy("g", "term").agg(F.count("*").alias("n")).orderBy("g", "term").collect()
    names: dict[int, list[str]] = {}
    counts: dict[int, list[int]] = {}
    for r in counted:
        names.setdefault(r["g"], []).append(r["term"])
        counts.setdefault(r["g"], []).append(r["n"])
    if not names:
        return spark.createDataFrame([], schema)
    total = {g: np.array(n, float) for g, n in counts.items()}
    vectors = {g: first_vectors(len(n), s) for g, n in names.items()}
    rounds = [range(s.epochs)] if dealt.most == 1 else [range(k, k + 1) for k in range(s.epochs)]
    for numbers in rounds:
        held = spark.sparkContext.broadcast((vectors, names, total))
        vectors = _word_round(dealt.rows, held, s, numbers, vectors)
        held.unpersist()
    out = [(dealt.groups[g], t, k, float(x)) for g, v in vectors.items() for t, row in zip(names[g], v[0], strict=True) for k, x in enumerate(row)]
    return spark.createDataFrame(out, schema)


def _word_round(rows: DataFrame, held, s: Words, numbers: range, before: dict) -> dict:  # noqa: ANN001
    fields = "g int, block int, shard int, w long, n long, v array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, names, total = held.value
        for g, shard, t in in_shards(batches):
            if g not in names:
                continue
            place = pa.array(names[g])
            column = t["value"].combine_chunks()
            ids = column.flatten().cast(pa.string())
            seqs = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
            found = pc.index_in(ids, place).fill_null(-1).to_numpy()
            found, seqs = found[found >= 0], seqs[found >= 0]
            v = start[g]
            for number in numbers:
                v = word_epoch(v, found, seqs, total[g], s, number, shard)
            n = np.bincount(found, minlength=len(names[g]))
            w = np.flatnonzero(n)
            flat = [v[:, k].ravel() * n[k] for k in w]
            columns = [pa.array([x] * len(w), pa.int32()) for x in (g, shard)]
            yield pa.RecordBatch.from_arrays([columns[0], pa.array(w // BLOCK_WORDS, pa.int32()), columns[1], pa.array(w, pa.int64()), pa.array(n[w], pa.int64()), pa.array(flat, pa.list_(pa.float64()))], names=["g", "block", "shard", "w", "n", "v"])

    def mean(t: pa.Table) -> pa.Table:  # a row for each shard and word
        t = t.sort_by([("w", "ascending"), ("shard", "ascending")]).combine_chunks()
        w, first = np.unique(t["w"].to_numpy(), return_index=True)
        v = np.add.reduceat(list_rows(t["v"]), first, axis=0) / np.add.reduceat(t["n"].to_numpy(), first)[:, None]
        return pa.table([pa.array(np.full(len(w), t["g"][0].as_py()), pa.int32()), pa.array(w), pa.array(list(v), pa.list_(pa.float64()))], names=["g", "w", "v"])

    made = rows.mapInArrow(run, fields).groupBy("g", "block").applyInArrow(mean, "g int, w long, v array<double>").toArrow()
    out = {g: v.copy() for g, v in before.items()}
    for g in out:  # vectors of each group's vocabulary
        part = made.filter(pc.equal(made["g"], g))
        if len(part):
            out[g][:, part["w"].to_numpy()] = list_rows(part["v"]).reshape(len(part), 2, s.dims).transpose(1, 0, 2)
    return out


# --- one class -----------------------------------------------------------------------------------------------


def fit_one_class_rows(rows: DataFrame, nu: float = 0.05, features: int = 256, seed: int = 42, x: str = "x", key: str = "seq_id", shard: int = SHARD_ROWS) -> OneClass:
    """fit_one_class of all rows: the same random features everywhere, a direction fitted in each shard, their mean weighted by
    rows, and the offset at the exact nu-quantile of all rows' scores."""
    rows = rows.where(F.col(x).isNotNull())
    flat = F.aggregate(F.col(x), F.lit(0.0), lambda a, v: a + v), F.aggregate(F.col(x), F.lit(0.0), lambda a, v: a + v * v)
    n, s, q = rows.agg(F.sum(F.size(x)), exact_sum(flat[0]), exact_sum(flat[1])).first()
    variance = max(q / n - (s / n) ** 2, 1e-12)
    dealt = deal(rows, x, None, key, shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, t in in_shards(batches):
            m = fit_one_class(matrix(t), nu, features, seed, variance=variance)
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"k": np.arange(features), "v": m.a * len(t), "n": len(t)}))

    got = dealt.rows.mapInArrow(run, "k long, v double, n long").groupBy("k").agg((exact_sum("v") / F.sum("n")).alias("a")).toPandas().sort_values("k")
    d = len(rows.select(x).first()[0])
    found = OneClass.drawn(d, variance, features, seed)
    found.a = got.a.to_numpy()
    scores = _margins(rows.select(x), found, x)
    found.rho = float(quantiles(scores, "err", [nu])[0])
    return found


def _margins(rows: DataFrame, model: OneClass, x: str) -> DataFrame:
    score: Callable[[np.ndarray], np.ndarray] = lambda m: model.features(m) @ model.a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                m = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), -1)
                yield pa.RecordBatch.from_arrays([pa.array(score(m))], names=["err"])

    return rows.mapInArrow(run, "err double")
