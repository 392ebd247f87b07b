"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and word pairs are hashed into ``buckets``.  The raw model counts them over all documents,
the target model over documents labelled good.  A document's log importance weight is the sum of
log(target share / raw share) over its n-grams; adding Gumbel noise and taking the ``k`` largest
keys samples ``k`` documents without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WordHashes, kth_largest, materialize, mix64, text_bytes


def _ngrams(h: np.ndarray, buckets: int) -> np.ndarray:
    uni = mix64(h)
    if len(h) > 1:
        uni = np.concatenate([uni, mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])])
    return (uni % np.uint64(buckets)).astype(np.int64)


def fit_log_ratio(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", buckets: int = 65_536, max_target: int = 20_000,
                  smoothing: float = 1.0) -> np.ndarray:
    """log(target / raw) for each bucket; raw counts cover all documents.

    The target is at most ``max_target`` labelled-good ids (smallest hash), so the id list is
    broadcast.  Without good labels the ratio is zero everywhere.
    """
    good = (labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull())
            .select(F.col(id_col).alias("_id")).distinct()
            .orderBy(F.xxhash64(F.lit(41), "_id"), "_id").limit(max_target).withColumn("_good", F.lit(True)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, raw, target = WordHashes(), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for g, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = _ngrams(hashes.array(text.lower().split()), buckets)
                np.add.at(raw, at, 1)
                if g:
                    np.add.at(target, at, 1)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])],
                                         ["bucket", "raw", "target"])

    src = (docs.select(F.col(id_col).alias("_id"), text_bytes(F.col(text_col)).alias("_text"))
           .join(F.broadcast(good), "_id", "left").select("_good", "_text"))
    rows = (src.mapInArrow(work, "bucket bigint, raw bigint, target bigint").groupBy("bucket")
            .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())
    raw, target = np.full(buckets, smoothing), np.full(buckets, smoothing)
    raw[rows["bucket"]] += rows["raw"]
    target[rows["bucket"]] += rows["target"]
    if not rows["target"].sum():
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weights(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
                seed: int = 1) -> DataFrame:
    """id, ``log_weight``, ``n_grams`` and the Gumbel ``key``, one row per input row.

    Empty and NULL texts have weight 0.  The noise is a hash of id and text: reruns agree, and
    repeated rows share one key.
    """
    buckets = len(ratio)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            w, n = [], []
            for text in b.column(2).to_pylist():
                at = _ngrams(hashes.array(text.lower().split()), buckets)
                w.append(float(ratio[at].sum()))
                n.append(len(at))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(w, pa.float64()),
                                              pa.array(n, pa.int64())], ["id", "u", "log_weight", "n_grams"])

    unit = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    src = docs.select(F.col(id_col).alias("id"), unit.alias("u"), text_bytes(F.col(text_col)).alias("text"))
    out = src.mapInArrow(work, f"id {src.schema['id'].dataType.simpleString()}, u double, log_weight double, n_grams bigint")
    return out.select(F.col("id").alias(id_col), "log_weight", "n_grams",
                      (F.col("log_weight") - F.log(-F.log("u"))).alias("key"))


def resample(weights: DataFrame, share: float) -> DataFrame:
    """Adds ``selected``: the ``round(share * rows)`` largest keys (rows tied at the cut are all taken)."""
    w = materialize(weights, "dsir")
    k = round(share * w.count())
    cut = kth_largest(w, "key", k)
    return w.withColumn("selected", F.lit(False) if cut is None else F.col("key") >= F.lit(cut))
