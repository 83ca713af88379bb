"""Reconstruction and isolation detectors: fit to a small parameter record, score rows where they are.

Scores are native array expressions or Arrow batches; the driver sees d by d sums, or a sample of rows bounded by a
parameter for the models that need rows together. Configurations of a grid are fitted in parallel, one task for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.operators.features import dot, minus, norm, vector_mean
from logsift.session import materialize


def array(values: object) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


# --- principal components ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Subspace:
    mean: np.ndarray
    basis: np.ndarray  # (k, d), orthonormal rows
    energy: np.ndarray  # squared singular values, falling

    def residual(self, x: Column) -> Column:
        """Length of what the subspace does not hold of the centred row, in Arrow batches; the vector itself, for small
        residuals. A null row has none."""
        mean, basis = self.mean, self.basis

        @F.arrow_udf("double")
        def length(v: pa.Array) -> pa.Array:
            rows = v.drop_null()
            m = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1) - mean
            out = np.full(len(v), np.nan)
            out[v.is_valid().to_numpy(zero_copy_only=False)] = np.linalg.norm(m - m @ basis.T @ basis, axis=1)
            return pa.array(out, pa.float64(), from_pandas=True)

        return length(x)


def gram(rows: DataFrame, x: str = "x") -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, sums and sums of products; each task adds up its own, so a d by d matrix for each task is shuffled."""
    d = len(rows.select(x).first()[0])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            m = np.array(b[x].tolist(), float).reshape(-1, d)
            n, s, g = n + len(m), s + m.sum(0), g + m.T @ m
        k = np.arange(d)
        yield pd.DataFrame({"i": np.repeat(k, d), "n": n, "s": np.repeat(s, d), "j": np.tile(k, d), "g": g.ravel()})

    made = rows.select(x).mapInPandas(add, "i int, n long, s double, j int, g double")
    got = made.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("g").alias("g")).toPandas().sort_values(["i", "j"])
    return int(got.n.iloc[0]), got.s.to_numpy().reshape(d, d)[:, 0], got.g.to_numpy().reshape(d, d)


def fit_pca(rows: DataFrame, k: int, center: bool = True, x: str = "x") -> Subspace:
    return subspace(*gram(rows, x), k, center)


def gram_by(rows: DataFrame, by: str, x: str = "x") -> dict:
    """gram() of each group in one pass; groups, a d by d matrix each, come to the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            keys = np.array(b.column(0).to_pylist(), object)
            for key in set(keys.tolist()):
                part = b.column(1).filter(pa.array(keys == key))
                m = part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), -1)
                n, s, g = held.get(key, (0, 0.0, 0.0))
                held[key] = (n + len(m), s + m.sum(0), g + m.T @ m)
        for key, (n, s, g) in held.items():
            yield pa.RecordBatch.from_pylist([{"key": key, "v": [float(n), *s.tolist(), *g.ravel().tolist()]}], pa.schema([("key", kind), ("v", pa.list_(pa.float64()))]))

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema[by].dataType)
    made = rows.where(F.col(x).isNotNull()).select(by, x).mapInArrow(add, f"key {rows.schema[by].dataType.simpleString()}, v array<double>")
    sums = made.select("key", F.posexplode("v").alias("k", "v")).groupBy("key", "k").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for key, part in sums.groupby("key"):
        v = part.sort_values("k").v.to_numpy()
        d = int((np.sqrt(4 * len(v) - 3) - 1) / 2)
        out[key] = (int(v[0]), v[1 : d + 1], v[d + 1 :].reshape(d, d))
    return out


def subspace(n: int, s: np.ndarray, g: np.ndarray, k: int, center: bool = True) -> Subspace:
    mean = s / n if center else np.zeros(len(s))
    values, vectors = np.linalg.eigh(g - n * np.outer(mean, mean))
    order = np.argsort(values)[::-1]
    return Subspace(mean, vectors[:, order[:k]].T, np.maximum(values[order], 0))


def fit_pca_by(rows: DataFrame, by: str, k: int, x: str = "x") -> dict:
    """A subspace for each group, all from one pass."""
    return {key: subspace(*sums, k) for key, sums in gram_by(rows, by, x).items()}


def residuals_by(rows: DataFrame, spaces: dict, by: str, ks: list[int] | None = None, x: str = "x") -> DataFrame:
    """rows with err, the residual against the subspace of the row's group; with ks, err is an array of the residuals against its
    first k directions for each k, from one product with all directions (which spaces must then hold). All in one pass."""
    held = rows.sparkSession.sparkContext.broadcast(spaces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            err = np.full((len(b), len(ks) if ks else 1), np.nan)
            there, groups = b.column(x).is_valid().to_numpy(zero_copy_only=False), np.array(b.column(by).to_pylist(), object)
            for key, space in held.value.items():
                mine = there & (groups == key)
                if mine.any():
                    z = b.column(x).filter(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(mine.sum()), -1) - space.mean
                    if ks:
                        rest = np.cumsum(((z @ space.basis.T) ** 2)[:, ::-1], 1)[:, ::-1]  # of direction k and all after it
                        err[mine] = np.sqrt(np.concatenate([rest, np.zeros((len(z), 1))], 1)[:, ks])
                    else:
                        err[mine, 0] = np.linalg.norm(z - z @ space.basis.T @ space.basis, axis=1)
            column = pa.array(list(err), pa.list_(pa.float64())) if ks else pa.array(err[:, 0], pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, "err"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, err {'array<double>' if ks else 'double'}")


def smallest_rank(energy: np.ndarray, share: float = 0.95, most: int = 9) -> int:
    """Least number of components that hold the share of the energy, from 1 to the rank and at most ``most``."""
    held = energy[energy > 0]
    if not len(held):
        return 1
    return int(min(np.searchsorted(np.cumsum(held) / held.sum(), share) + 1, len(held), most))


def sample(rows: DataFrame, most: int, seed: int = 42, x: str = "x") -> np.ndarray:
    """At most that many rows, of the smallest seeded id hash, in the order of their ids."""
    got = rows.orderBy(F.xxhash64(F.lit(seed), "seq_id")).limit(most).select("seq_id", x).collect()
    return np.array([r[x] for r in sorted(got, key=lambda r: r["seq_id"])], float)


# --- robust principal components -----------------------------------------------------------------------------


@dataclass
class Decomposition:
    low: np.ndarray
    sparse: np.ndarray
    iterations: int
    error: float
    rank: int


def soft(x: np.ndarray, tau: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - tau, 0)


def singular_threshold(x: np.ndarray, tau: float) -> tuple[np.ndarray, int]:
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    s = np.maximum(s - tau, 0)
    return (u * s) @ vt, int((s > 1e-6).sum())


def robust_pca(m: np.ndarray, scale: float = 1.0, tol: float = 1e-7, most: int = 500) -> Decomposition:
    """m as a low-rank plus a sparse part, by an inexact augmented Lagrangian; scale multiplies 1 / sqrt(max(m.shape))."""
    lam = scale / np.sqrt(max(m.shape))
    top, size = np.linalg.norm(m, 2), np.linalg.norm(m)
    if size == 0:
        return Decomposition(m.copy(), m.copy(), 0, 0.0, 0)
    y, mu = m / max(top, np.abs(m).max() / lam), 1.25 / top
    bound, sparse = mu * 1e7, np.zeros_like(m)
    for k in range(1, most + 1):
        low, rank = singular_threshold(m - sparse + y / mu, 1 / mu)
        sparse = soft(m - low + y / mu, lam / mu)
        rest = m - low - sparse
        error = float(np.linalg.norm(rest) / size)
        if error < tol:
            break
        y, mu = y + mu * rest, min(mu * 1.5, bound)
    return Decomposition(low, sparse, k, error, rank)


def fit_rpca(x: np.ndarray, k: int = 9, scale: float = 1.0, center: bool = False) -> Subspace:
    mean = x.mean(0) if center else np.zeros(x.shape[1])
    _, s, vt = np.linalg.svd(robust_pca(x - mean, scale).low, full_matrices=False)
    return Subspace(mean, vt[:k], s**2)


#: Steps of a decomposition of partitioned rows that are replayed from the last written state.
REPLAY = 25


def _matrix(b: pd.DataFrame, col: str, d: int) -> np.ndarray:
    return np.array(b[col].tolist(), float).reshape(-1, d)


def _sums(rows: DataFrame, of: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """Sum of a vector over all batches; a task adds up its own."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                v = of(b)
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    made = rows.mapInPandas(add, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
    return made.toPandas().sort_values("k").v.to_numpy()


def _alm_step(m: np.ndarray, s: np.ndarray, y: np.ndarray, shrink: np.ndarray, mu: float, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, sparse, multiplier, rest) of rows after a step; each row needs the d by d matrix only."""
    low = (m - s + y / mu) @ shrink
    s = soft(m - low + y / mu, lam / mu)
    rest = m - low - s
    return low, s, y + mu * rest, rest


@dataclass
class RowDecomposition:
    """What robust_pca_rows found; parts() has its rows."""

    state: DataFrame
    steps: list[tuple[np.ndarray, float]]
    mean: np.ndarray
    lam: float
    iterations: int
    error: float
    rank: int

    def gram_of_low(self) -> np.ndarray:
        d, steps, lam = len(self.mean), self.steps, self.lam

        def of(b: pd.DataFrame) -> np.ndarray:
            low = _replay(b, steps, d, lam)[1]
            return (low.T @ low).ravel()

        return _sums(self.state, of).reshape(d, d)

    def sparse_cells(self, least: float = 1e-6) -> int:
        d, steps, lam = len(self.mean), self.steps, self.lam
        return int(_sums(self.state, lambda b: np.array([float((np.abs(_replay(b, steps, d, lam)[2]) > least).sum())]))[0])

    def low_space(self, k: int | None = None) -> Subspace:
        """The first k directions of the low-rank part, by default as many as its rank, at least one."""
        values, vectors = np.linalg.eigh(self.gram_of_low())
        order = np.argsort(values)[::-1]
        return Subspace(self.mean, vectors[:, order[: max(self.rank, 1) if k is None else k]].T, np.maximum(values[order], 0))

    def low_residuals(self, k: int | None = None) -> DataFrame:
        """The rows' other columns with err, the length of what low_space does not hold of the row."""
        d, basis = len(self.mean), self.low_space(k).basis

        def err(b: pd.DataFrame) -> np.ndarray:
            m = _matrix(b, "_m", d)
            return np.linalg.norm(m - m @ basis.T @ basis, axis=1)

        return score_rows(self.state, err).drop("_m", "_s", "_z")

    def low_rows(self) -> DataFrame:
        """(seq_id, x): the low-rank part."""
        d, steps, lam = len(self.mean), self.steps, self.lam

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"seq_id": b.seq_id, "x": list(_replay(b, steps, d, lam)[1])})

        return self.state.mapInPandas(run, "seq_id long, x array<double>")

    def sparse_norms(self) -> DataFrame:
        """The rows' other columns with err, the length of the sparse part."""
        d, steps, lam = len(self.mean), self.steps, self.lam
        return score_rows(self.state, lambda b: np.linalg.norm(_replay(b, steps, d, lam)[2], axis=1)).drop("_m", "_s", "_z")


def _replay(b: pd.DataFrame, steps: list[tuple[np.ndarray, float]], d: int, lam: float) -> tuple[np.ndarray, ...]:
    """(m, low, sparse, multiplier, rest) of a batch of state rows after the steps."""
    m, s, y = (_matrix(b, c, d) for c in ("_m", "_s", "_z"))
    low = rest = np.zeros_like(m)
    for shrink, mu in steps:
        low, s, y, rest = _alm_step(m, s, y, shrink, mu, lam)
    return m, low, s, y, rest


def robust_pca_rows(rows: DataFrame, scale: float = 1.0, center: bool = False, tol: float = 1e-7, most: int = 500, x: str = "x") -> RowDecomposition:
    """robust_pca of all rows where they are. A step needs the d by d Gram matrix of what it shrinks, whose eigenvectors the
    driver takes; rows are shrunk in their tasks. State is written every REPLAY steps, and replayed from there."""
    n, sums, g = gram(rows, x)
    d = len(sums)
    mean = sums / n if center else np.zeros(d)
    g = g - n * np.outer(mean, mean)
    lam, size, top = scale / np.sqrt(max(n, d)), float(np.sqrt(max(np.trace(g), 0))), float(np.sqrt(max(np.linalg.eigvalsh(g)[-1], 0)))
    others = [c for c in rows.columns if c != x]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != x)
    schema = f"{fields + ', ' if fields else ''}_m array<double>, _s array<double>, _z array<double>"

    def written(df: DataFrame, of: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield b[others].assign(**{c: list(v) for c, v in zip(("_m", "_s", "_z"), of(b), strict=True)})

        return materialize(df.mapInPandas(run, schema))

    largest = rows.select(F.max(F.array_max(F.zip_with(x, array(mean), lambda v, c: F.abs(v - c))))).first()[0]

    def begin(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = _matrix(b, x, d) - mean
        return m, np.zeros_like(m), m / max(top, largest / lam) if size else m

    state, steps = written(rows, begin), []
    if size == 0:
        return RowDecomposition(state, [], mean, lam, 0, 0.0, 0)
    mu = 1.25 / top
    bound = mu * 1e7

    def gram_after(steps: list, mu: float) -> tuple[np.ndarray, float]:
        """Gram matrix of m - s + y / mu after the steps, and what is left of m after them."""
        def of(b: pd.DataFrame) -> np.ndarray:
            m, _, s, y, rest = _replay(b, steps, d, lam)
            a = m - s + y / mu
            return np.append((a.T @ a).ravel(), (rest**2).sum())

        got = _sums(state, of)
        return got[:-1].reshape(d, d), float(np.sqrt(got[-1]) / size)

    g, _ = gram_after(steps, mu)
    for k in range(1, most + 1):
        values, vectors = np.linalg.eigh(g)
        s = np.sqrt(np.maximum(values, 0))
        held = np.maximum(s - 1 / mu, 0)
        rank = int((held > 1e-6).sum())
        steps = [*steps, ((vectors * np.divide(held, s, out=np.zeros(d), where=s > 0)) @ vectors.T, mu)]
        mu = min(mu * 1.5, bound)
        g, error = gram_after(steps, mu)
        if error < tol or k == most:
            break
        if len(steps) == REPLAY:
            state = written(state, lambda b, steps=steps: (lambda r: (r[0], r[2], r[3]))(_replay(b, steps, d, lam)))
            steps = []
    return RowDecomposition(state, steps, mean, lam, k, error, rank)


def fit_rpca_rows(rows: DataFrame, k: int = 9, scale: float = 1.0, center: bool = False) -> Subspace:
    """fit_rpca of all rows where they are."""
    return robust_pca_rows(rows, scale, center).low_space(k)


# --- autoencoder ---------------------------------------------------------------------------------------------


@dataclass
class Network:
    mean: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]
    losses: list[float] = field(default_factory=list)

    def output(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(self.layers):
            x = x @ w + b
            x = np.maximum(x, 0) if i < len(self.layers) - 1 else x
        return x

    def errors(self, x: np.ndarray) -> np.ndarray:
        c = x - self.mean
        return np.sqrt(((c - self.output(c)) ** 2).sum(1))

    def forward(self, x: Column) -> Column:
        """The same output as a native array expression."""
        for i, (w, b) in enumerate(self.layers):
            last = i == len(self.layers) - 1
            outs = [dot(x, array(w[:, j])) + F.lit(float(b[j])) for j in range(len(b))]
            x = F.array(*[o if last else F.greatest(o, F.lit(0.0)) for o in outs])
        return x


def fit_autoencoder(x: np.ndarray, hidden: tuple[int, ...] = (32, 16, 32), alpha: float = 1e-4, seed: int = 42, epochs: int = 100, batch: int = 200, patience: int = 10) -> Network:
    """Rectified network from x to x by Adam; a tenth of the rows tells when to stop, and the best weights are kept."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0)
    x = (x - mean)[rng.permutation(len(x))]
    held, x = x[: len(x) // 10], x[len(x) // 10 :]
    sizes = [x.shape[1], *hidden, x.shape[1]]
    layers = []
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        r = np.sqrt(6 / (a + b))
        layers.append([rng.uniform(-r, r, (a, b)), rng.uniform(-r, r, b)])
    net = Network(mean, layers)
    first, second = ([[np.zeros_like(p) for p in layer] for layer in layers] for _ in range(2))
    best, kept, waited, t = np.inf, None, 0, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = x[order[at : at + batch]]
            acts = [rows]
            for i, (w, b) in enumerate(layers):
                z = acts[-1] @ w + b
                acts.append(np.maximum(z, 0) if i < len(layers) - 1 else z)
            back, t = (acts[-1] - rows) / len(rows), t + 1
            for i in reversed(range(len(layers))):
                grads = (acts[i].T @ back + alpha * layers[i][0] / len(rows), back.sum(0))
                back = (back @ layers[i][0].T) * (acts[i] > 0)
                for j, g in enumerate(grads):
                    first[i][j] = 0.9 * first[i][j] + 0.1 * g
                    second[i][j] = 0.999 * second[i][j] + 0.001 * g * g
                    layers[i][j] -= 1e-3 * (first[i][j] / (1 - 0.9**t)) / (np.sqrt(second[i][j] / (1 - 0.999**t)) + 1e-8)
        check = held if len(held) else x
        net.losses.append(float(((net.output(check) - check) ** 2).mean()))
        if net.losses[-1] < best - 1e-4 * min(best, 1):
            best, kept, waited = net.losses[-1], [tuple(p.copy() for p in layer) for layer in layers], 0
        else:
            waited += 1
            if waited >= patience:
                break
    net.layers = kept or [tuple(layer) for layer in layers]
    return net


# --- isolation forest, kernel density of one class -----------------------------------------------------------


def _path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


@dataclass
class Forest:
    trees: list[dict]
    size: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean depth / expected depth) - 0.5: over 0 is rather anomalous."""
        depth = np.zeros(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), int)
            while (live := tree["feature"][at] >= 0).any():
                f = tree["feature"][at]
                right = x[np.arange(len(x)), np.maximum(f, 0)] >= tree["cut"][at]
                at = np.where(live, np.where(right, tree["right"][at], tree["left"][at]), at)
            depth += tree["depth"][at]
        return 2.0 ** (-depth / len(self.trees) / max(_path(self.size), 1e-9)) - 0.5


def fit_forest(x: np.ndarray, trees: int = 100, size: int = 256, seed: int = 42) -> Forest:
    rng, size = np.random.default_rng(seed), min(size, len(x))
    limit, out = int(np.ceil(np.log2(max(size, 2)))), []
    for _ in range(trees):
        nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "depth")}

        def grow(rows: np.ndarray, depth: int, nodes: dict = nodes) -> int:
            me = len(nodes["feature"])
            low, high = rows.min(0), rows.max(0)
            split = np.flatnonzero(high > low) if depth < limit and len(rows) > 1 else []
            for k, v in (("feature", -1), ("cut", 0.0), ("left", me), ("right", me), ("depth", depth + _path(len(rows)))):
                nodes[k].append(v)
            if len(split):
                f = int(rng.choice(split))
                cut = rng.uniform(low[f], high[f])
                right = rows[:, f] >= cut
                if right.any() and not right.all():
                    nodes["feature"][me], nodes["cut"][me] = f, cut
                    nodes["left"][me] = grow(rows[~right], depth + 1)
                    nodes["right"][me] = grow(rows[right], depth + 1)
            return me

        grow(x[rng.choice(len(x), size, replace=False)], 0)
        out.append({k: np.array(v) for k, v in nodes.items()})
    return Forest(out, size)


@dataclass
class OneClass:
    """One-class support vector machine on random Fourier features of a Gaussian kernel."""

    w: np.ndarray
    phase: np.ndarray
    a: np.ndarray
    rho: float

    @classmethod
    def drawn(cls, d: int, variance: float, features: int, seed: int) -> OneClass:
        """Random features, before a fit."""
        rng = np.random.default_rng(seed)
        gamma = 1 / (d * max(variance, 1e-12))
        return cls(rng.normal(0, np.sqrt(2 * gamma), (d, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features), 0.0)

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / len(self.phase)) * np.cos(x @ self.w + self.phase)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.rho - self.features(x) @ self.a


def fit_one_class(x: np.ndarray, nu: float = 0.05, features: int = 256, seed: int = 42, steps: int = 400, variance: float | None = None) -> OneClass:
    """variance: of the numbers that the width of the kernel is for; of x, if it is not given."""
    m = OneClass.drawn(x.shape[1], x.var() if variance is None else variance, features, seed)
    z = m.features(x)
    m.a = z.mean(0)
    for t in range(1, steps + 1):
        m.rho = float(np.quantile(z @ m.a, nu))
        out = z[z @ m.a < m.rho]
        m.a = m.a - (m.a - out.sum(0) / (nu * len(z))) / (t + 1)
    m.rho = float(np.quantile(z @ m.a, nu))
    return m


# --- scoring and grids ---------------------------------------------------------------------------------------


def score_batches(rows: DataFrame, score: Callable[[np.ndarray], np.ndarray], x: str = "x") -> DataFrame:
    """rows with err = score of the batch's matrix, in Arrow batches on the executors."""
    return score_rows(rows, lambda b: score(np.array(b[x].tolist(), float)))


def score_rows(rows: DataFrame, score: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """rows with err = score of the batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(err=score(b))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, err double")


def run_grid(spark, configs: list[dict], work: Callable[[dict], dict], schema: str) -> DataFrame:
    """One task for each configuration; work gets a configuration and returns a row."""
    rows = spark.createDataFrame([(i, repr(c)) for i, c in enumerate(configs)], "id int, config string").repartition(max(1, len(configs)), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast

        for b in batches:
            for c in b.config:
                yield pd.DataFrame([work(ast.literal_eval(c))])

    return rows.mapInPandas(run, schema)


def zscore_ensemble(scores: DataFrame, stats: DataFrame, mode: str = "mean") -> DataFrame:
    """scores: (seq_id, model, err); stats: (model, mu, sigma) of fit rows. Mean (or greatest) of the standardized scores."""
    z = (F.col("err") - F.col("mu")) / (F.col("sigma") + 1e-10)
    out = F.max(z) if mode == "max" else F.avg(z)
    return scores.join(F.broadcast(stats), "model").groupBy("seq_id").agg(out.alias("err"))  # stats: a row for each model


def mean_vector(rows: DataFrame, x: str = "x") -> np.ndarray:
    return np.array(vector_mean(rows, x))
