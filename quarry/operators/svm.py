"""One-vs-one support vector machines, all class pairs (and grid points, and folds) trained together.

A pass is one Spark job: every task computes the margins of its rows under all weight vectors by matrix
products and adds up losses and gradients; sums are merged by chunks of models.  The driver holds the
weights and moves each model by its own L-BFGS direction, so the number of passes does not follow the
number of models.  Loss: 0.5 |w|^2 + C * sum of squared hinges; the bias is not penalised.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMORY = 10  # L-BFGS pairs kept
_CHUNK = 32  # models whose sums travel as one row


@dataclass(frozen=True)
class Space:
    """Inputs as they are, or random Fourier features of an RBF kernel exp(-|x-y|^2 / (2 sigma^2))."""

    dim: int
    sigma: float | None = None
    features: int = 0
    seed: int = 7

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Features with a last column of ones for the bias."""
        if self.sigma is not None:
            rng = np.random.default_rng(self.seed)
            w = rng.normal(0.0, 1.0 / self.sigma, size=(self.dim, self.features))
            x = math.sqrt(2.0 / self.features) * np.cos(x @ w + rng.uniform(0.0, 2 * np.pi, size=self.features))
        return np.column_stack([x, np.ones(len(x))])

    @property
    def width(self) -> int:
        return (self.dim if self.sigma is None else self.features) + 1


@dataclass(frozen=True)
class Task:
    """One two-class problem: rows of classes ``plus`` and ``minus`` (by place) outside one fold."""

    space: int
    plus: int
    minus: int
    cost: float
    without: int = -1


def _matrix(col: pa.ListArray, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dim)


class _Mover:
    """L-BFGS with backtracking for one weight vector; fed one loss and gradient a pass."""

    def __init__(self, size: int):
        self.w, self.f, self.g = np.zeros(size), None, None
        self.trial, self.step, self.way, self.past, self.done = self.w, 1.0, None, [], False

    def take(self, f: float, g: np.ndarray, tol: float) -> None:
        if self.f is not None:
            if f > self.f + 1e-4 * self.step * (self.g @ self.way) and self.step > 1e-12:
                self.step /= 2
                self.trial = self.w + self.step * self.way
                return
            s, y = self.trial - self.w, g - self.g
            if s @ y > 1e-12 * (y @ y):
                self.past = [*self.past, (s, y)][-MEMORY:]
            self.done = self.f - f <= tol * abs(f)
        self.w, self.f, self.g = self.trial, f, g
        self.done |= float(np.abs(g).max()) <= 1e-9
        q, alphas = g.copy(), []
        for s, y in reversed(self.past):
            alphas.append((s @ q) / (s @ y))
            q -= alphas[-1] * y
        if self.past:
            s, y = self.past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.sqrt(g @ g)))
        for (s, y), a in zip(self.past, reversed(alphas)):
            q += s * (a - (y @ q) / (s @ y))
        self.way, self.step = -q, 1.0
        if self.g @ self.way >= 0:
            self.way, self.past = -g, []
        self.trial = self.w + self.way


def train(rows: DataFrame, spaces: Sequence[Space], tasks: Sequence[Task], tol: float = 1e-6,
          max_passes: int = 500) -> tuple[list[np.ndarray], int]:
    """Weights of every task and the passes it took.

    ``rows``: ``y`` (place of the class), ``fold``, ``x`` (array); read once a pass, so persist or
    materialise it.  A task ends when a step lowers its loss by under ``tol`` of it.
    """
    movers = [_Mover(spaces[t.space].width) for t in tasks]
    passes = 0
    while passes < max_passes and (live := [i for i, m in enumerate(movers) if not m.done]):
        passes += 1
        for i, (loss, slope) in _sums(rows, spaces, tasks, {i: movers[i].trial for i in live}).items():
            w, c = movers[i].trial, tasks[i].cost
            pull = np.append(w[:-1], 0.0)
            movers[i].take(0.5 * float(pull @ pull) + c * loss, pull - 2 * c * slope, tol)
    return [m.w for m in movers], passes


def _sums(rows: DataFrame, spaces: Sequence[Space], tasks: Sequence[Task], trials: dict[int, np.ndarray]) -> dict:
    groups = []  # (space, model numbers, weights, targets per class, fold left out)
    by_space = lambda i: tasks[i].space
    for s, ids in itertools.groupby(sorted(trials, key=by_space), by_space):
        ids = list(ids)
        for at in range(0, len(ids), _CHUNK):
            part = ids[at:at + _CHUNK]
            groups.append((s, part, np.column_stack([trials[i] for i in part]), [(tasks[i].plus, tasks[i].minus) for i in part],
                           np.array([tasks[i].without for i in part])))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((w.shape[0] + 1, w.shape[1])) for _, _, w, _, _ in groups]
        for b in batches:
            y, fold = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            raw = _matrix(b.column(2), spaces[0].dim)
            made: dict[int, np.ndarray] = {}
            for cell, (s, _, w, pairs, without) in zip(total, groups):
                z = made.get(s)
                if z is None:
                    z = made[s] = spaces[s].apply(raw)
                side = np.column_stack([(y == p).astype(float) - (y == m) for p, m in pairs]) * (fold[:, None] != without)
                hinge = np.where(side != 0, np.maximum(0.0, 1.0 - side * (z @ w)), 0.0)
                cell[0] += (hinge ** 2).sum(axis=0)
                cell[1:] += z.T @ (side * hinge)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([c.tobytes() for c in total], pa.binary())], ["g", "v"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for g, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[g] = held.get(g, 0.0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([c.tobytes() for c in held.values()], pa.binary())], ["g", "v"])

    schema, out = "g int, v binary", {}
    # summed chunk by chunk as they stream in: a merging task holds one sum a chunk
    for r in rows.select("y", "fold", "x").mapInArrow(work, schema).repartition("g").mapInArrow(merge, schema).collect():
        _, part, w, _, _ = groups[r["g"]]
        cell = np.frombuffer(bytes(r["v"])).reshape(-1, w.shape[1])
        out.update({i: (float(cell[0, j]), cell[1:, j].copy()) for j, i in enumerate(part)})
    return out


def _votes(z: np.ndarray, weights: np.ndarray, pairs: Sequence[tuple[int, int]], classes: int) -> np.ndarray:
    """Class with the most pairwise wins; ties go to the first class."""
    margin = z @ weights
    wins = np.zeros((len(z), classes), np.int64)
    for j, (p, m) in enumerate(pairs):
        wins[:, p] += margin[:, j] > 0
        wins[:, m] += margin[:, j] <= 0
    return wins.argmax(axis=1)


def _prepared(df: DataFrame, label: str, array_col: str, fold) -> tuple[DataFrame, list, int]:
    """Rows with a class and a whole vector (``y`` place of the class, ``fold``, ``x``), the classes, the length."""
    used = df.where(F.col(label).isNotNull() & F.col(array_col).isNotNull())
    classes = sorted(r[0] for r in used.select(label).distinct().collect())
    dim = used.select(F.size(array_col)).first()[0] if classes else 0
    names = F.array(*[F.lit(c) for c in classes]) if classes else F.array()
    rows = used.select((F.array_position(names, F.col(label)) - 1).cast("int").alias("y"), fold.cast("int").alias("fold"),
                       F.col(array_col).cast("array<double>").alias("x"))
    return rows, classes, dim


@dataclass
class PairModel:
    space: Space
    classes: list
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    passes: int

    def predict(self, df: DataFrame, array_col: str, out: str = "prediction") -> DataFrame:
        """Adds the class with the most votes; NULL where the vector is NULL."""
        space, classes, pairs, weights = self.space, self.classes, self.pairs, self.weights

        @F.pandas_udf("double")
        def vote(col: pd.Series) -> pd.Series:
            some = col.notna()
            result = pd.Series([None] * len(col), dtype="float64")
            if some.any():
                z = space.apply(np.stack(col[some].to_numpy()).astype(np.float64))
                result[some.to_numpy()] = np.array(classes, float)[_votes(z, weights, pairs, len(classes))]
            return result

        return df.withColumn(out, vote(F.col(array_col)))


def svm_pairs(df: DataFrame, label: str, array_col: str, cost: float = 1.0, sigma: float | None = None, features: int = 256,
              seed: int = 7) -> PairModel:
    """One-vs-one machine over numeric classes: linear, or with ``sigma`` on random Fourier features."""
    rows, classes, dim = _prepared(df, label, array_col, F.lit(0))
    space = Space(dim, sigma, features if sigma is not None else 0, seed)
    pairs = list(itertools.combinations(range(len(classes)), 2))
    rows = rows.persist()
    weights, passes = train(rows, [space], [Task(0, p, m, cost) for p, m in pairs])
    rows.unpersist()
    return PairModel(space, classes, pairs, np.column_stack(weights) if weights else np.zeros((space.width, 0)), passes)


def grid_cv(df: DataFrame, label: str, array_col: str, id_col: str, sigmas: Sequence[float], costs: Sequence[float],
            dim: int = 128, folds: int = 3, seed: int = 42) -> DataFrame:
    """k-fold grid over kernel width and cost: (sigma, cost, accuracy, kappa), means over the folds.

    All widths x costs x folds x class pairs are trained in the same passes, and scored in one more.  Folds
    come from a hash of the id.  Every task works out the random features of its rows itself.
    """
    fold = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(folds))
    rows, classes, size = _prepared(df, label, array_col, fold)
    rows = rows.persist()
    spaces = [Space(size, s, dim, seed) for s in sigmas]
    pairs = list(itertools.combinations(range(len(classes)), 2))
    points = list(itertools.product(range(len(sigmas)), costs, range(folds)))
    weights, _ = train(rows, spaces, [Task(s, p, m, c, k) for s, c, k in points for p, m in pairs])
    sets = {at: np.column_stack(weights[i * len(pairs):(i + 1) * len(pairs)]) for i, at in enumerate(points)} if pairs else {}
    n = len(classes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(points), n, n), np.int64)
        for b in batches:
            y, part = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            raw = _matrix(b.column(2), size)
            made = {s: spaces[s].apply(raw) for s in range(len(spaces))}
            for i, (s, c, k) in enumerate(points):
                mine = part == k
                if mine.any() and sets:
                    np.add.at(table[i], (y[mine], _votes(made[s][mine], sets[s, c, k], pairs, n)), 1)
        i, y, p = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int32)) for v in (i, y, p)), pa.array(table[i, y, p])], ["i", "y", "p", "n"])

    seen = rows.mapInArrow(score, "i int, y int, p int, n bigint").groupBy("i", "y", "p").agg(F.sum("n").alias("n")).toPandas()
    rows.unpersist()
    out = []
    for i, (s, c, _) in enumerate(points):
        table = np.zeros((n, n))
        got = seen[seen["i"] == i]
        table[got["y"], got["p"]] = got["n"]
        total = table.sum()
        if total:
            hit, chance = np.trace(table) / total, float(table.sum(axis=0) @ table.sum(axis=1)) / total ** 2
            out.append((float(sigmas[s]), float(c), float(hit), float((hit - chance) / (1 - chance)) if chance < 1 else None))
    return df.sparkSession.createDataFrame(out, "sigma double, cost double, accuracy double, kappa double") \
        .groupBy("sigma", "cost").agg(F.avg("accuracy").alias("accuracy"), F.avg("kappa").alias("kappa"))
