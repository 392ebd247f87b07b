"""Mixing sources to target weights: token blocks, multinomial shard draws, index permutations.

Each source's documents form one stream of tokens, packed into blocks of ``block`` tokens.  For
every output shard the counts per source are drawn multinomially from what each source still has
to give, so shards vary but the totals meet the targets.  The i-th slot of a source is mapped
through a pseudorandom permutation of the source's block indexes (a new one for each pass over the
source), and slots are joined to blocks by index.  A block is taken at most twice.  Inside a shard a
further permutation gives each drawn slot its place, so the sources' blocks are mingled.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import WORD, materialize, mix64

WEIGHTS = (3, 1, 2)


def source_targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share=Fraction(3, 2),
                   limit: int = 2) -> dict[str | None, Fraction]:
    """Target per source: ``share`` of all tokens dealt by weight, none above ``limit`` times its size."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    w = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: Fraction(limit * n) for s, n in order}
    left = Fraction(share) * sum(n for _, n in order)
    target: dict[str | None, Fraction] = {}
    while len(target) < len(order):
        active = [s for s, _ in order if s not in target]
        total = sum(w[s] for s in active)
        full = [s for s in active if left * w[s] / total > cap[s]]
        for s in full or active:
            target[s] = cap[s] if full else left * w[s] / total
        if full:
            left -= sum(cap[s] for s in full)
    return target


def draw_shards(totals: np.ndarray, shard_slots: int, max_shards: int, seed: int) -> np.ndarray:
    """(shards, sources) slot counts; column sums equal ``totals``."""
    left = totals.astype(np.int64).copy()
    slots = int(left.sum())
    shards = max(1, min(max_shards, math.ceil(slots / shard_slots)))
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(left)), np.int64)
    for i in range(shards):
        need = math.ceil(slots / (shards - i))
        slots -= need
        while need:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[i] += got
            left -= got
            need -= int(got.sum())
    return out


def permute(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 for each ``key``: a four-round Feistel network, walked
    until the value falls below ``n`` (under four steps on average)."""
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2).astype(float) + 1)).astype(np.uint64) + np.uint64(1)) // np.uint64(2), 1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = k.astype(np.uint64), np.ones(len(k), bool)
    n = n.astype(np.uint64)
    while todo.any():
        h, m, y, s = half[todo], mask[todo], x[todo], key[todo].astype(np.uint64)
        left, right = y >> h, y & m
        for r in range(4):
            left, right = right, left ^ (mix64(right * np.uint64(0x9E3779B97F4A7C15) + s + np.uint64(r)) & m)
        x[todo] = (left << h) | right
        todo = x >= n
    return x.astype(np.int64)


def _deal(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share, block: int, shard_slots: int,
          max_shards: int, seed: int, with_text: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with what is known of their source, the pieces of their blocks, and the slots of the mix with a block each."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_src"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("_th"),
        *([text.alias("_text")] if with_text else []))
        .withColumn("_rid", F.monotonically_increasing_id()), "mix-rows")
    per = rows.groupBy("_src").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    target = source_targets([(r["_src"], r["size"]) for r in per], weights, share)
    order = sorted(((r["_src"], r["size"]) for r in per), key=lambda x: (x[0] is None, x[0] or ""))
    blocks = [-(-n // block) for _, n in order]
    totals = np.array([min(2 * b, round(b * target[s] / n)) if n else 0 for (s, n), b in zip(order, blocks)], np.int64)
    drawn = draw_shards(totals, shard_slots, max_shards, seed) if len(order) and totals.sum() else np.zeros((0, len(order)), np.int64)

    # a plan row is one source's part of one shard: slots of the source from ``_from``, slots of the shard from ``_at``
    plan = pd.DataFrame({"shard": np.repeat(np.arange(len(drawn)), len(order)),
                         "_s": np.tile(np.arange(len(order)), len(drawn)), "_n": np.tile(np.array(blocks, np.int64), len(drawn)),
                         "_from": (np.cumsum(drawn, axis=0) - drawn).reshape(-1), "_at": (np.cumsum(drawn, axis=1) - drawn).reshape(-1),
                         "_slots": np.repeat(drawn.sum(axis=1), len(order)), "_count": drawn.reshape(-1)})
    plan = plan[plan["_count"] > 0]
    info = spark.createDataFrame(
        [(i, s, n, float(target[s])) for i, (s, n) in enumerate(order)],
        "_s int, _src string, source_size long, target double")
    # one row per source: bounded by the number of sources, the driver holds it already
    known = rows.join(F.broadcast(info), rows["_src"].eqNullSafe(info["_src"])).drop(info["_src"])

    # offset of every document in its source's stream: sums within hashed chunks, then over chunks,
    # so a source with a third of all rows is not one task's window
    chunks = max(1, sum(r["n"] for r in per) // 20_000)
    w = Window.partitionBy("_s", "_chunk").orderBy("_id", "size", "_th", "_rid").rowsBetween(Window.unboundedPreceding, -1)
    sized = (known.where("size > 0").select("_rid", "_id", "_s", "size", "_th",
                                            F.pmod(F.xxhash64("_id"), F.lit(chunks)).alias("_chunk")))
    placed = sized.withColumn("_in", F.coalesce(F.sum("size").over(w), F.lit(0)))
    by_chunk = sized.groupBy("_s", "_chunk").agg(F.sum("size").alias("_sum"))
    wc = Window.partitionBy("_s").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    by_chunk = by_chunk.select("_s", "_chunk", F.coalesce(F.sum("_sum").over(wc), F.lit(0)).alias("_base"))
    placed = placed.join(by_chunk, ["_s", "_chunk"]).withColumn("_off", F.col("_base") + F.col("_in"))
    end, low = F.col("_off") + F.col("size"), F.greatest(F.col("_off"), F.col("_b") * block)
    piece = (placed.withColumn("_b", F.explode(F.sequence((F.col("_off") / block).cast("long"), ((end - 1) / block).cast("long"))))
             .select("_rid", "_id", "_s", "_b", (low - F.col("_b") * block).cast("int").alias("at"), (low - F.col("_off")).alias("first_word"),
                     (F.least(end, (F.col("_b") + 1) * block) - low).alias("n_words")))

    @F.pandas_udf("long")
    def turned(k: pd.Series, n: pd.Series, salt: pd.Series) -> pd.Series:
        kk, nn = k.to_numpy(np.int64), n.to_numpy(np.int64)
        key = mix64((salt.to_numpy(np.int64) * 1_000_003 + kk // nn + seed).astype(np.uint64))
        return pd.Series(permute(kk % nn, nn, key))

    # salts of shards are negative, those of sources are not; long plan rows are unrolled in two steps;
    # the hint is needed as Spark sizes the slots by their few plan rows and would send them all through the driver
    j = F.explode(F.sequence(F.col("_lo"), F.least(F.col("_lo") + 4095, F.col("_count") - 1)))
    slots = (spark.createDataFrame(plan, "shard int, _s int, _n long, _from long, _at long, _slots long, _count long")
             .repartition(max(1, min(len(plan), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
             .withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1, F.lit(4096).cast("long"))))
             .withColumn("_j", j)
             .select("shard", "_s", turned(F.col("_at") + F.col("_j"), "_slots", -F.col("shard").cast("long") - 1).alias("place"),
                     turned(F.col("_from") + F.col("_j"), "_n", F.col("_s").cast("long")).alias("_b"))
             .hint("merge"))
    return known, piece, slots


def mix_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights=WEIGHTS, share=Fraction(3, 2), block: int = 128, shard_slots: int = 65_536,
               max_shards: int = 4096, seed: int = 11) -> DataFrame:
    """The mixed corpus: ``shard``, ``place`` (from 0 in each shard), ``source``, ``n_words`` and ``text`` of every slot.

    A slot's text is its block: up to ``block`` words of the source's stream, joined by one space.
    """
    known, piece, slots = _deal(docs, id_col, text_col, source_col, weights, share, block, shard_slots, max_shards, seed, True)
    words = F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))
    spans = piece.groupBy("_rid").agg(F.collect_list(F.struct("_s", "_b", "at", "first_word", "n_words")).alias("_p"))
    # a long text has many pieces, of which Spark's sizes know nothing either
    cut = (known.join(spans.hint("merge"), "_rid").withColumn("_w", words)
           .select("_src", F.explode(F.transform("_p", lambda p: F.struct(
               p["_s"].alias("_s"), p["_b"].alias("_b"), p["at"].alias("at"), p["n_words"].alias("n"),
               F.array_join(F.slice("_w", (p["first_word"] + 1).cast("int"), p["n_words"].cast("int")), " ").alias("t")))).alias("p"))
           .select("_src", "p.*"))
    whole = cut.groupBy("_s", "_b").agg(F.first("_src").alias(source_col), F.sum("n").alias("n_words"),
                                        F.array_join(F.sort_array(F.collect_list(F.struct("at", "t")))["t"], " ").alias("text"))
    return slots.join(whole, ["_s", "_b"]).select("shard", "place", source_col, "n_words", "text")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, share=Fraction(3, 2), block: int = 128, shard_slots: int = 65_536,
                max_shards: int = 4096, seed: int = 11) -> DataFrame:
    """One row per input row: id, ``size``, ``source_size``, ``target`` and ``taken`` tokens, ``n_spans`` (stretches of
    the row in the mix, repeats counted), ``first_shard`` and ``first_place`` (where the first of them stands; else NULL).

    NULL and empty texts have size 0 and take nothing; NULL is a source of its own, last in order;
    repeated rows are separate stretches of the stream; an empty table gives an empty result.
    The driver holds one row per source, and at most ``max_shards`` counts for each.
    """
    known, piece, slots = _deal(docs, id_col, text_col, source_col, weights, share, block, shard_slots, max_shards, seed)
    # the mix itself: every slot's shard and place with the stretches of documents that fill its block
    spans = slots.join(piece, ["_s", "_b"])
    taken = spans.groupBy("_rid").agg(F.sum("n_words").alias("taken"), F.count(F.lit(1)).alias("n_spans"),
                                      F.min(F.struct("shard", "place")).alias("_first"))
    return (known.join(taken, "_rid", "left")
            .select(F.col("_id").alias(id_col), "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
                    F.col("_first.shard").alias("first_shard"), F.col("_first.place").alias("first_place"), F.col("_src").alias(source_col)))
