"""Toxicity: two class-conditional Kneser-Ney models over one shared backoff.

In each class a word is counted the Kneser-Ney way, by the number of different words it follows, so
a passage copied into many documents counts once while an insult used everywhere counts often.
Absolute discounts (one each for counts 1, 2 and 3 or more, from the counts of counts) take mass from
the seen words; the mass goes to a backoff distribution of the same counts over both classes together.
A word that is rare, or that neither class has seen, thus says almost nothing about the class.

Two length-normalised differences of the toxic and ordinary log-likelihoods describe a text: the mean
over all its words, and the mean over its ``PEAK`` most telling words (a long text with a few insults
is toxic all the same).  A logistic curve, fitted on labelled documents that were kept out of the
counts, turns them into a probability at the true class shares.

Fitting uses a bounded sample: at most ``max_toxic`` and ``max_ordinary`` labelled documents (smallest
hash of the id), so the list of sampled ids may be broadcast; the table holds at most ``max_words``
words.  Scoring covers every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WordHashes, id_fold, kth_largest, materialize, text_bytes

PEAK = 3


@dataclass(frozen=True)
class Model:
    """Sorted word hashes with their log-likelihood ratio; scoring is an array look-up."""
    words: np.ndarray                          # sorted word hashes
    ratio: np.ndarray                          # log P_toxic / P_ordinary of each
    unknown: float                             # the same for any other word
    curve: tuple[float, float, float] | float  # logistic weights, or a constant score

    def statistics(self, h: np.ndarray) -> tuple[float, float]:
        """Mean log-likelihood ratio of a text's word hashes, and of its most telling words."""
        if len(h) == 0 or len(self.words) == 0:
            return 0.0, 0.0
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        r = np.where(self.words[at] == h, self.ratio[at], self.unknown)
        top = np.partition(r, len(r) - PEAK)[-PEAK:] if len(r) > PEAK else r
        return float(r.mean()), float(top.mean())

    def score(self, h: np.ndarray) -> float:
        if isinstance(self.curve, float):
            return self.curve
        mean, peak = self.statistics(h)
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * mean + c * peak, -40, 40))))


class _FewHashes(WordHashes):
    """Remembers fewer words, as several tasks share an executor's memory."""

    LIMIT = 200_000


def _labelled(labels: DataFrame, id_col: str, label_col: str, fold: int, folds: int) -> DataFrame:
    """One 0/1 label per learnable id (any 1 wins); NULL ids and labels teach nothing."""
    return (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
                         & (id_fold(F.col(id_col), folds) != fold))
            .groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("_y")))


def _count_contexts(train: DataFrame) -> DataFrame:
    """(b, c0, c1, c): per word hash, the different left neighbours in class 0, in class 1, in both together."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _FewHashes()
        left, right, classes, held = [], [], [], 0

        def flush():
            a, b, y = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, classes))
            by = np.lexsort((b, a))
            a, b, bit = a[by], b[by], (1 << y)[by]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
            bits = np.bitwise_or.reduceat(bit, first) if len(a) else bit
            for x in (left, right, classes):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array((bits & 1).astype(np.int32)),
                                               pa.array((bits >> 1).astype(np.int32))], ["a", "b", "s0", "s1"])

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = hashes.array(text.lower().split()).view(np.int64)
                left.append(np.concatenate([np.zeros(min(1, len(h)), np.int64), h[:-1]]))
                right.append(h)
                classes.append(np.full(len(h), y, np.int64))
                held += len(h)
                if held > 400_000:
                    yield flush()
                    held = 0
        yield flush()

    pairs = train.select("_y", "_text").mapInArrow(work, "a bigint, b bigint, s0 int, s1 int")
    pairs = pairs.groupBy("a", "b").agg(F.max("s0").alias("s0"), F.max("s1").alias("s1"))
    return pairs.groupBy("b").agg(F.sum("s0").alias("c0"), F.sum("s1").alias("c1"), F.count(F.lit(1)).alias("c"))


def _discounts(tally: dict[int, int]) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more, from how many words have counts 1 to 4."""
    n = [tally.get(i, 0) for i in range(5)]
    if not (n[1] and n[2]):
        return np.array([0.0, 0.75, 0.75, 0.75])
    y = n[1] / (n[1] + 2 * n[2])
    raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / max(n[3], 1)]
    return np.array([0.0, *[min(max(d, 0.1), i + 0.95) for i, d in enumerate(raw)]])


def _statistics(df: DataFrame, model: Model) -> list:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _FewHashes()
        for b in batches:
            res = [model.statistics(hashes.array(t.lower().split())) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in res], pa.float64()),
                                              pa.array([r[1] for r in res], pa.float64())], ["y", "mean", "peak"])
    return df.select("_y", "_text").mapInArrow(work, "y int, mean double, peak double").collect()


def _fit_curve(rows: list, share: float) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; rows are weighted to the true class shares."""
    y = np.array([r["y"] for r in rows], float)
    x = np.array([[1.0, r["mean"], r["peak"]] for r in rows])
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1.0
    x = x / scale
    w = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    beta, ridge = np.zeros(3), np.array([1e-6, 0.05, 0.05])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        g = x.T @ (w * (y - p)) - ridge * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(3)
        step = np.linalg.solve(h, g)
        beta = beta + step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in beta / scale)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", fold: int = 1, folds: int = 3, max_toxic: int = 5000,
        max_ordinary: int = 15_000, max_words: int | None = 200_000) -> Model:
    """Fit the two models and the curve on labelled rows outside fold ``fold``.

    The table holds the ``max_words`` most frequent words of the sample (None: all, also those met
    once); other words are scored as unknown.  The sample has at most ``max_toxic`` + ``max_ordinary`` texts.  NULL texts count
    as empty, NULL labels and ids as none; without documents or labels of both classes the model gives
    every text the share of label 1.
    """
    rows = materialize(_labelled(labels, id_col, label_col, fold, folds), "tox-labels")
    shares = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    share = shares.get(1, 0) / total if total else 0.0
    none = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, share)
    if not (shares.get(0) and shares.get(1)):
        return none
    by_hash = [F.xxhash64(F.lit(17), "_id"), F.col("_id")]
    sample = (rows.where("_y = 0").orderBy(*by_hash).limit(max_ordinary)
              .union(rows.where("_y = 1").orderBy(*by_hash).limit(max_toxic)))
    # at most max_toxic + max_ordinary ids: bounded, so the list is broadcast
    train = materialize(docs.select(F.col(id_col).alias("_id"), text_bytes(F.col(text_col)).alias("_text"))
                        .join(F.broadcast(sample), "_id").select("_id", "_y", "_text"), "tox-sample")
    apart = F.pmod(F.xxhash64(F.lit(29), "_id"), F.lit(4)) == 0  # for the curve only
    words = materialize(_count_contexts(train.where(~apart)), "tox-words")
    tot = words.agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    if not (tot["n0"] and tot["n1"]):
        return none
    tallies = words.select(F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.least(f"c{y}", F.lit(5)).alias("k"))
                                               for y in (0, 1)])).alias("x")).groupBy("x.y", "x.k").agg(F.count(F.lit(1)).alias("n"))
    tally: list[dict] = [{}, {}]
    for r in tallies.collect():
        tally[r["y"]][r["k"]] = r["n"]
    words = words.withColumn("both", F.col("c0") + F.col("c1"))
    cut = kth_largest(words, "both", max_words + 1) if max_words and tot["v"] > max_words else 0
    kept = words.where(F.col("both") > F.lit(cut)).select("b", "c", "c0", "c1").toPandas()
    h = kept["b"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(h)
    shared = (kept["c"].to_numpy(float)[by] + 1) / (tot["n"] + tot["v"] + 1)
    unseen = 1.0 / (tot["n"] + tot["v"] + 1)
    log_p, log_unseen = [], []
    for y in (0, 1):
        counts = kept[f"c{y}"].to_numpy(np.int64)[by]
        rest = np.maximum(counts - _discounts(tally[y])[np.minimum(counts, 3)], 0.0)
        mass = tot[f"n{y}"] - rest.sum()
        log_p.append(np.log((rest + mass * shared) / tot[f"n{y}"]))
        log_unseen.append(np.log(mass * unseen / tot[f"n{y}"]))
    model = Model(h[by], log_p[1] - log_p[0], float(log_unseen[1] - log_unseen[0]), share)
    rest = _statistics(train.where(apart), model)
    if len({r["y"] for r in rest}) < 2:  # too few labels to keep any apart
        rest = _statistics(train, model)
    return Model(model.words, model.ratio, model.unknown, _fit_curve(rest, share))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                   score_col: str = "score") -> DataFrame:
    """``docs`` ids with a score from 0 to 1, one row per input row.

    Empty and NULL texts get the curve's value at a zero difference; without labels of both
    classes every score is the share of label 1.  Only the text is read for a score.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _FewHashes()
        for b in batches:
            s = [model.score(hashes.array(t.lower().split())) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["id", "score"])

    src = docs.select(F.col(id_col).alias("id"), text_bytes(F.col(text_col)).alias("text"))
    out = src.mapInArrow(work, f"id {src.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), F.col("score").alias(score_col))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Rows of ``docs`` scored under ``threshold``, all columns, schema unchanged.

    NULL texts count as empty; an empty table gives an empty result.  Only the text goes to Python and
    only the score comes back; the other columns stay where they are.
    """
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = _FewHashes()
        for part in texts:
            yield pd.Series([model.score(hashes.array(t.lower().split())) for t in part], dtype="float64")

    return docs.where(score(text_bytes(F.col(text_col))) < F.lit(threshold))
