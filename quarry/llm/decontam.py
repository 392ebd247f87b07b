"""Benchmark decontamination: spaced seeds find places, aligned words verify them.

Fixed masks pick some words of every window; the hashes of the picked words of benchmark items and
documents are joined, so a hit survives substitutions at the ignored places.
Around each hit the item is laid along the document (same shift), and the pair counts when some
stretch of ``overlap`` aligned words (the whole item if shorter) agrees in at least ``share`` of its
places.  With the default ``overlap`` and ``share`` the masks leave no accepted pair without a hit
(one word in five changed at most: 3 of 16, 2 of 10, 1 of 5 to 9).  Built from DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, ascii_lower, free_names, materialize

# places that each mask compares, by the item's number of words (8: eight and more; fixed values)
MASKS = {5: ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)),
         6: ((0, 1, 2, 4), (0, 2, 3, 4)),
         7: ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 3, 4, 5)),
         8: ((0, 1, 2, 3, 5), (0, 1, 2, 5, 6), (0, 3, 5, 6, 7))}


def _word_hashes(text):
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, keep: list[str], kind: int) -> DataFrame:
    """Explode ``_h`` into (``_seed``, ``_pos``) by the masks of ``kind``; the mask is part of the hash."""
    masks = MASKS[kind]
    shortest = min(m[-1] for m in masks) + 1

    def picked(i):
        return F.array(*[F.when(i + m[-1] < F.size("_h"), F.xxhash64(F.lit(kind), F.lit(no), *[F.get(F.col("_h"), i + k) for k in m]))
                         for no, m in enumerate(masks)])

    windows = F.transform(F.sequence(F.lit(0), F.size("_h") - shortest), picked)
    rows = df.where(F.size("_h") >= shortest).select(*keep, F.posexplode(windows).alias("_pos", "_each"))
    return rows.select(*keep, "_pos", F.explode("_each").alias("_seed")).where(F.col("_seed").isNotNull())


def contaminated_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", overlap: int = 16, share: float = 0.8,
                       broadcast_seeds: int = 2_000_000) -> DataFrame:
    """(``_id``, ``_th``, ``_item``, ``agree``): verified documents with the best share of agreeing words.

    The benchmark's seeds are broadcast only while they number at most ``broadcast_seeds``;
    beyond that the join is left to the optimizer (a shuffle on the seed).  Documents are read with the
    masks of those item lengths that the benchmark holds.
    """
    items = materialize(benchmark.where(F.col(item_col).isNotNull())
                        .select(F.col(item_col).alias("_item"), _word_hashes(F.col(item_text)).alias("_t")).distinct(), "bench")
    kind = F.least(F.size("_t"), F.lit(max(MASKS)))
    kinds = sorted(r[0] for r in items.select(kind).distinct().collect() if r[0] in MASKS) or [max(MASKS)]
    per_item = [_seeds(items.where(kind == k).withColumn("_h", F.col("_t")), ["_item"], k) for k in kinds]
    tests = materialize(reduce(DataFrame.unionAll, per_item).select("_item", F.col("_pos").alias("_q"), "_seed"), "bench-seeds")
    small = tests.count() <= broadcast_seeds
    hashed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"),
                         _word_hashes(F.col(text_col)).alias("_h"))
    seeds = reduce(DataFrame.unionAll, [_seeds(hashed, ["_id", "_th"], k) for k in kinds])
    hits = (seeds.join(F.broadcast(tests) if small else tests, "_seed")
            .select("_id", "_th", "_item", (F.col("_pos") - F.col("_q")).alias("_shift")).distinct())
    hits = materialize(hits, "bench-hits")

    # hits are grouped per document so that each document's words are laid out once
    per_doc = (hits.join(items, "_item").groupBy("_id", "_th")
               .agg(F.collect_list(F.struct("_item", "_shift", "_t")).alias("_hits")))
    per_doc = per_doc.select(F.col("_id").alias("_hid"), F.col("_th").alias("_hth"), "_hits")
    words = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    found = (words.join(per_doc, words["_id"].eqNullSafe(per_doc["_hid"]) & (words["_th"] == per_doc["_hth"]))
             .select("_id", "_th", _word_hashes(F.col("_text")).alias("_h"), "_hits")
             .select("_id", "_th", "_h", F.explode("_hits").alias("x"))
             .select("_id", "_th", "_h", "x._item", "x._shift", "x._t"))
    first = F.greatest(F.lit(0), -F.col("_shift"))
    last = F.least(F.size("_t"), F.size("_h") - F.col("_shift")) - 1
    same = F.transform(F.sequence(first, last), lambda i: F.when(
        F.get(F.col("_t"), i) == F.get(F.col("_h"), i + F.col("_shift")), 1).otherwise(0))
    width = F.least(F.lit(overlap), F.size("_t"))
    best = F.array_max(F.transform(
        F.sequence(F.lit(0), F.size("_same") - F.col("_w")),
        lambda s: F.aggregate(F.slice("_same", s + 1, F.col("_w")), F.lit(0), lambda a, x: a + x)))
    checked = (found.select("_id", "_th", "_item", same.alias("_same"), width.alias("_w"))
               .where(F.size("_same") >= F.col("_w"))
               .withColumn("agree", best / F.col("_w")).where(F.col("agree") >= share))
    return checked.groupBy("_id", "_th", "_item").agg(F.max("agree").alias("agree"))


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **options) -> DataFrame:
    """One row per input row: id, ``contaminated``, ``n_items``, ``item_ids`` (sorted) and ``best``.

    Items under five words (the shingle length of this library) match nothing, as do NULL texts, NULL
    items and an empty benchmark; an item of under ``overlap`` words has to be in the text as a whole.  Rows of equal id and text get equal results.
    """
    found = materialize(contaminated_items(docs, benchmark, id_col, text_col, **options)
                        .groupBy("_id", "_th").agg(F.sort_array(F.collect_list("_item")).alias("item_ids"),
                                                   F.max("agree").alias("best")), "bench-found")
    left = docs.select(F.col(id_col).alias(id_col), F.xxhash64(text_col).alias("_lth"))
    out = left.join(found, left[id_col].eqNullSafe(found["_id"]) & (left["_lth"] == found["_th"]), "left")
    return out.select(left[id_col], F.col("best").isNotNull().alias("contaminated"),
                      F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce(F.array_join(F.transform("item_ids", lambda x: x.cast("string")), ","), F.lit("")).alias("item_ids"),
                      F.coalesce("best", F.lit(0.0)).alias("best"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **options) -> DataFrame:
    """Rows of ``docs`` without a verified benchmark overlap, all columns (NULL texts and all rows of an empty benchmark stay)."""
    id_, th_ = free_names(docs, "__id", "__th")
    found = materialize(contaminated_items(docs, benchmark, id_col, text_col, **options)
                        .select(F.col("_id").alias(id_), F.col("_th").alias(th_)).distinct(), "bench-found")
    return docs.join(found, docs[id_col].eqNullSafe(found[id_]) & (F.xxhash64(docs[text_col]) == found[th_]), "left_anti")
