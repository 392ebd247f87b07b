"""Binomial regressions by reweighted least squares, many models in one pass.

A pass is one Spark job: each task turns its Arrow batches into the weighted cross products, the score
vector and the deviance of every model still moving, and Spark adds these up.  All candidates of a
selection step share the passes, so their number does not follow the number of candidates, and each
starts from the coefficients of the model it changes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PASSES = 100


@dataclass
class Fit:
    """A fitted model on the scale of its inputs: the intercept is the last coefficient."""

    terms: list[str]
    beta: np.ndarray
    se: np.ndarray
    deviance: float
    passes: int
    converged: bool
    scaled: np.ndarray  # intercept first, on standardised inputs

    @property
    def aic(self) -> float:
        return self.deviance + 2 * len(self.beta)

    @property
    def z(self) -> np.ndarray:
        return np.divide(self.beta, self.se, out=np.full(len(self.se), np.nan), where=self.se > 0)

    @property
    def p_values(self) -> np.ndarray:
        return np.array([math.erfc(abs(v) / math.sqrt(2)) for v in self.z])


class Batch:
    """The complete rows of a table, read once a pass for all models asked for."""

    def __init__(self, df: DataFrame, y: str, x: Sequence[str]):
        self.x, self.passes = list(x), 0
        cols = [F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([y, *x])]
        self.rows = df.select(*cols).dropna().persist()
        stats = self.rows.agg(F.count(F.lit(1)), *[f(f"_{i + 1}") for i in range(len(x)) for f in (F.avg, F.stddev_pop)]).first()
        self.n = stats[0]
        self.mean = np.array([v or 0.0 for v in stats[1::2]])
        self.sd = np.array([v or 1.0 for v in stats[2::2]])

    def close(self) -> None:
        self.rows.unpersist()

    def _sums(self, models: dict[int, tuple[list[int], np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
        """Information, score and deviance of each model at its coefficients: one job."""
        self.passes += 1
        mean, sd, p = self.mean, self.sd, len(self.x)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {m: np.zeros((len(b) + 1, len(b) + 1)) for m, (_, b) in models.items()}
            for batch in batches:
                y = batch.column(0).to_numpy(zero_copy_only=False)
                full = np.ones((len(y), p + 1))
                for i in range(p):
                    full[:, i + 1] = (batch.column(i + 1).to_numpy(zero_copy_only=False) - mean[i]) / sd[i]
                for m, (at, beta) in models.items():
                    x = full[:, at]
                    eta = x @ beta
                    mu = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                    cell = total[m]
                    cell[:-1, :-1] += x.T @ (x * (mu * (1 - mu))[:, None])
                    cell[:-1, -1] += x.T @ (y - mu)
                    cell[-1, -1] += 2 * (np.logaddexp(0, eta) - y * eta).sum()
            ids = np.concatenate([np.full(c.size, m) for m, c in total.items()])
            at = np.concatenate([np.arange(c.size) for c in total.values()])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(at, pa.int32()),
                                              pa.array(np.concatenate([c.ravel() for c in total.values()]))], ["m", "i", "v"])

        cells = {m: np.zeros((len(b) + 1) ** 2) for m, (_, b) in models.items()}
        for r in self.rows.mapInArrow(work, "m int, i int, v double").groupBy("m", "i").agg(F.sum("v").alias("v")).collect():
            cells[r["m"]][r["i"]] = r["v"]
        out = {}
        for m, flat in cells.items():
            square = flat.reshape(int(math.isqrt(len(flat))), -1)
            out[m] = (square[:-1, :-1], square[:-1, -1], float(square[-1, -1]))
        return out

    def fit(self, models: Sequence[Sequence[str]], starts: Sequence[dict[str, float] | None] | None = None,
            tol: float = 1e-10) -> list[Fit]:
        """All models by Newton steps (halved where the deviance rises) until their deviances settle.

        ``starts`` holds coefficients on the standardised scale (:meth:`start_of`) to begin from.
        """
        at = [[0, *(self.x.index(t) + 1 for t in terms)] for terms in models]
        beta = [np.array([(s or {}).get(t, 0.0) for t in ("", *terms)]) for terms, s in zip(models, starts or [None] * len(models))]
        before: list = [None] * len(models)  # (deviance, coefficients) of the last accepted step
        state: list = [None] * len(models)
        passes = [0] * len(models)
        moving = set(range(len(models)))
        for _ in range(MAX_PASSES):
            if not moving:
                break
            for m, (info, score, deviance) in self._sums({m: (at[m], beta[m]) for m in sorted(moving)}).items():
                passes[m] += 1
                if before[m] is not None and deviance > before[m][0] * (1 + tol) + tol:
                    beta[m] = (beta[m] + before[m][1]) / 2
                    continue
                settled = before[m] is not None and abs(before[m][0] - deviance) <= tol * (abs(deviance) + 0.1)
                state[m], before[m] = (info, deviance, beta[m], settled), (deviance, beta[m])
                if settled:
                    moving.discard(m)
                else:
                    beta[m] = beta[m] + np.linalg.lstsq(info, score, rcond=1e-12)[0]
        return [self._finish(list(terms), *state[m], passes[m], at[m]) for m, terms in enumerate(models)]

    def _finish(self, terms: list[str], info: np.ndarray, deviance: float, beta: np.ndarray, settled: bool,
                passes: int, at: list[int]) -> Fit:
        k = np.array(at[1:], int) - 1
        back = np.zeros((len(beta), len(beta)))  # standardised, intercept first -> inputs' scale, intercept last
        back[np.arange(len(k)), np.arange(len(k)) + 1] = 1 / self.sd[k]
        back[-1, 0], back[-1, 1:] = 1.0, -self.mean[k] / self.sd[k]
        cov = back @ np.linalg.pinv(info, rcond=1e-12, hermitian=True) @ back.T
        return Fit(terms, back @ beta, np.sqrt(np.maximum(np.diag(cov), 0)), deviance, passes, settled, beta)

    @staticmethod
    def start_of(fit: Fit) -> dict[str, float]:
        return dict(zip(("", *fit.terms), fit.scaled))


def both_ways(batch: Batch, x: Sequence[str], report: Callable[[int, str, str | None, Fit], None]) -> None:
    """Stepwise by AIC from the full model: every step fits all drops and adds together."""
    best = batch.fit([list(x)])[0]
    report(0, "start", None, best)
    step = 0
    while True:
        step += 1
        moves = [("-", t, [c for c in best.terms if c != t]) for t in best.terms]
        moves += [("+", t, [*best.terms, t]) for t in x if t not in best.terms]
        if not moves:
            return
        fits = batch.fit([terms for _, _, terms in moves], [batch.start_of(best)] * len(moves))
        i = min(range(len(moves)), key=lambda j: fits[j].aic)
        if fits[i].aic >= best.aic - 1e-9:
            return
        best = fits[i]
        report(step, moves[i][0], moves[i][1], best)
