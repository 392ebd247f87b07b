"""Window operators and ordering / top-k (§2.8).

Scale notes
-----------
* ``row_number``/``rank``/``dense_rank`` followed by ``<= n`` lets Spark put a
  *partial* ``WindowGroupLimit`` before the shuffle, so a hot group is cut
  to ``n`` rows per map task before it moves.  :func:`top_n_per_group`
  keeps that shape.
* A window with no ``partitionBy`` runs in one task.  The only such
  windows here run on already aggregated, bounded tables (a few bins).
  Buckets and splits compare rows with cut points looked up by
  :func:`selection.select_ranks`; running totals are :func:`prefix_sums`.  Row numbers for every row
  of a table use :func:`global_row_number`, a distributed sort plus
  per-partition offsets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.selection import select_ranks, selectable

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


_RANKERS = {"keep": F.dense_rank, "cut": F.row_number, "rank": F.rank}


def top_n_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int,
                    ties: str = "keep", rank_col: str = "rnk") -> DataFrame:
    """Rows ranked ``<= n`` inside each group.

    ``ties="keep"`` ranks values (dense_rank: more than ``n`` rows when tied),
    ``"cut"`` ranks rows (row_number: exactly ``n``; give a total order),
    ``"rank"`` is SQL ``rank``.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, _RANKERS[ties]().over(w)).where(F.col(rank_col) <= n)


def top_n_of_top_groups(df: DataFrame, group: str, item: str, groups_n: int, n: int,
                        count_col: str = "n") -> DataFrame:
    """Top ``n`` items inside each of the ``groups_n`` busiest groups, groups found from data.

    Counts are aggregated first (partial aggregation combines a hot key
    map-side); the group list is a top-k result, so it is broadcast.
    """
    counts = df.groupBy(group, item).agg(F.count(F.lit(1)).alias(count_col))
    top_groups = (counts.groupBy(group).agg(F.sum(count_col).alias("_g"))
                  .orderBy(F.desc("_g"), F.asc(group)).limit(groups_n).select(group))
    kept = counts.join(F.broadcast(top_groups), group, "left_semi")
    return top_n_per_group(kept, [group], [F.desc(count_col), F.asc(item)], n, ties="cut")


def nth_highest(df: DataFrame, col: str, n: int, ties: str = "value",
                by: Sequence[str] = (), tie_break: Sequence[str] = ()) -> DataFrame:
    """Row(s) holding the n-th highest value: by distinct value or by row."""
    ranker = F.dense_rank if ties == "value" else F.row_number
    w = Window.partitionBy(*by).orderBy(F.desc(col), *[F.asc(t) for t in tie_break])
    # "<= n" first lets Spark infer a map-side window-group limit
    return df.withColumn("_r", ranker().over(w)).where(F.col("_r") <= n).where(F.col("_r") == n).drop("_r")


def with_grand_total(df: DataFrame, agg: Column, name: str) -> DataFrame:
    """Grand total next to every row as a scalar subquery (computed once, not per row)."""
    total = df.agg(agg.alias(name))
    return df.withColumn(name, total.scalar())


def sorted_with_ids(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Distributed sort tagged with ``_mid`` (partition index << 33 | position), checkpointed."""
    from quarry.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    tagged = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    return tagged.checkpoint(eager=True)


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "rn") -> DataFrame:
    """1-based row number over the whole table without a one-task window.

    The table is range-partitioned and sorted (a distributed sort);
    ``monotonically_increasing_id`` then carries the partition index in its
    upper bits and the position inside the partition in its lower bits.
    Row counts per partition (one row per partition) give the offsets.

    The id-tagged table is read twice (counts, then the join), and AQE may
    coalesce the sorted partitions differently in two plans, so it is
    materialised once with a reliable ``checkpoint()`` into the shared
    ``spark.checkpoint.dir``: both reads see the same ids, and the lineage
    is cut, so a lost executor does not force the sort to be redone.
    """
    ordered = sorted_with_ids(df, order)
    part = F.shiftright(F.col("_mid"), 33)
    pos = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    ordered = ordered.withColumn("_part", part).withColumn("_pos", pos)
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(Window.orderBy("_part").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_off")
    # one row per partition: bounded by the partition count
    out = ordered.join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_off") + F.col("_pos") + 1).drop("_mid", "_part", "_pos", "_off")


def prefix_sums(df: DataFrame, order: Sequence[Column], cols: Sequence[str], prefix: str = "cum_") -> DataFrame:
    """Running totals of ``cols`` in ``order`` over the whole table, distributed.

    Range partitioning + sort; per-partition totals (one row per
    partition) become offsets; the running sum inside each partition is a
    window over that partition only.  ``order`` must be total.
    """
    ordered = sorted_with_ids(df, order)
    ordered = ordered.withColumn("_part", F.shiftright("_mid", 33))
    part_tot = ordered.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    wo = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part_tot.select("_part", *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}")
                                         for c in cols])
    wi = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ordered.join(F.broadcast(offsets), "_part")
    for c in cols:
        out = out.withColumn(prefix + c, F.col(f"_o_{c}") + F.sum(c).over(wi))
    return out.drop("_mid", "_part", *[f"_o_{c}" for c in cols])


def ntile_from_rank(rn: Column, total: Column, k: int) -> Column:
    """SQL ``ntile(k)`` bucket of 1-based row ``rn`` among ``total`` rows (larger buckets first)."""
    q = F.floor(total / k)
    rem = total - q * k
    big = rem * (q + 1)
    return F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1) \
        .otherwise(rem + F.floor((rn - big - 1) / F.greatest(q, F.lit(1))) + 1).cast("int")


def deciles(df: DataFrame, score: str, id_col: str, n: int = 10, name: str = "bucket") -> DataFrame:
    """``ntile(n)`` by descending score (NULL last), ties by ascending id (NULL first).

    The last (score, id) of each bucket is looked up first (:func:`rank_cuts`,
    jobs on narrow aggregates, run while the plan is built); the bucket is then
    a comparison with at most ``n - 1`` literals, so the rows themselves are
    neither sorted nor written.  Rows equal in score and id share a bucket.
    """
    x, i = F.col(score), F.col(id_col)
    bucket = F.lit(1)
    for last_score, whole, last_id in rank_cuts(df, score, id_col, n):
        if last_score is None:
            tied, below = x.isNull(), F.lit(False)
        else:
            tied, below = x == F.lit(last_score), x.isNull() | (x < F.lit(last_score))
        if whole:
            after = below
        else:
            after = below | (tied & (i.isNotNull() if last_id is None else i > F.lit(last_id)))
        bucket = bucket + F.when(after, 1).otherwise(0)
    return df.withColumn(name, bucket.cast("int"))


def rank_cuts(df: DataFrame, score: str, id_col: str, n: int) -> list[tuple]:
    """Last row of each of the first ``n - 1`` ntile buckets: (score, all of that score?, id).

    The scores at the bucket ends come from one multi-rank selection, and so do the ids where an end
    falls among equal scores (only rows of those scores are read for it).  Scores or ids
    that are not plain numbers are counted per value and ranked by distributed prefix sums instead.  The
    driver sees one row per bucket end.
    """
    total, valued = df.agg(F.count(F.lit(1)), F.count(score)).first()
    q, rem = divmod(total, n)
    ends = sorted({b * q + min(b, rem) for b in range(1, n)} - {0, total})
    if not ends:
        return []
    at, split = {}, []  # split: scores cut in the middle, with the ranks wanted inside
    for value, above, same in _score_spans(df, score, ends, valued, total):
        inside = [r for r in ends if above < r <= above + same]
        at.update({r: (value, True, None) for r in inside if r == above + same})
        if middle := {r: r - above for r in inside if r < above + same}:
            split.append((value, middle))
    if split:
        wanted = reduce(lambda p, q: p | q, [F.col(score).eqNullSafe(F.lit(v)) for v, _ in split])
        at.update(_tied_ids(df.where(wanted), score, id_col, split))
    return [at[r] for r in ends]


def _score_spans(df: DataFrame, score: str, ends: Sequence[int], valued: int, total: int) -> list[tuple]:
    """(value, rows above it, rows of it) of every score that holds one of the 1-based descending ranks."""
    if selectable(df, score):
        asked = F.array(*[F.lit(r).cast("bigint") for r in ends])
        got = select_ranks(df, score, lambda m: F.filter(F.transform(asked, lambda r: m - r), lambda r: r >= 0), len(ends))
        spans = {(r["value"], r["total"] - r["below"] - r["same"], r["same"]) for r in got.collect()}
        return sorted(spans, key=lambda s: s[1]) + ([(None, valued, total - valued)] if total > valued else [])
    per = prefix_sums(df.groupBy(score).agg(F.count(F.lit(1)).alias("_n")), [F.desc_nulls_last(score)], ["_n"], "_cum")
    return [(r[score], r["_cum_n"] - r["_n"], r["_n"]) for r in _covering(per, ends)]


def _covering(ranked: DataFrame, ranks: Sequence[int]) -> list:
    hit = reduce(lambda p, q: p | q, [(F.col("_cum_n") >= r) & (F.col("_cum_n") - F.col("_n") < r) for r in ranks])
    return sorted(ranked.where(hit).collect(), key=lambda row: row["_cum_n"])


def _tied_ids(tied: DataFrame, score: str, id_col: str, split: Sequence[tuple]) -> dict[int, tuple]:
    """For each wanted rank the (score, False, id) it falls on, ids ascending with NULL first."""
    # keyed by text, as NaN does not equal itself here
    sizes = {str(r[0]): (r[1], r[2]) for r in tied.groupBy(score).agg(
        F.count(F.lit(1)), F.count_if(F.col(id_col).isNull())).collect()}
    if not selectable(tied, id_col):
        by_id = tied.groupBy(score, id_col).agg(F.count(F.lit(1)).alias("_n"))
        by_id = prefix_sums(by_id, [F.desc_nulls_last(score), F.asc(id_col)], ["_n"], "_cum")
        ranks, before = {}, 0
        for value, middle in split:
            ranks |= {before + k: r for r, k in middle.items()}
            before += sizes[str(value)][0]
        return {r: (row[score], False, row[id_col]) for row in _covering(by_id, sorted(ranks)) for g, r in ranks.items()
                if row["_cum_n"] - row["_n"] < g <= row["_cum_n"]}
    out = {r: (value, False, None) for value, middle in split for r, k in middle.items() if k <= sizes[str(value)][1]}
    places = {str(value): {k - sizes[str(value)][1] - 1: r for r, k in middle.items() if r not in out} for value, middle in split}
    asked = F.array().cast("array<bigint>")
    for value, _ in split:
        if ranks := places[str(value)]:
            asked = F.when(F.col("_by0").eqNullSafe(F.lit(value)), F.array(*[F.lit(k).cast("bigint") for k in sorted(ranks)])).otherwise(asked)
    for row in select_ranks(tied, id_col, lambda _: asked, max(map(len, places.values())), [score]).collect():
        out[places[str(row["_by0"])][row["rank"]]] = (row["_by0"], False, row["value"])
    return out


def cumulative(df: DataFrame, order: Sequence[ColumnOrName], col: str, name: str | None = None,
               by: Sequence[str] = (), share: bool = False) -> DataFrame:
    """Running sum in ``order`` (optionally as a share of the group total).

    Meant for aggregated tables (bins, deciles); with ``by`` it is distributed.
    """
    name = name or f"cum_{col}"
    w = Window.partitionBy(*by).orderBy(*[_c(o) for o in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn(name, F.sum(col).over(w))
    if share:
        out = out.withColumn(f"{name}_share", F.col(name) / F.sum(col).over(Window.partitionBy(*by)))
    return out


def moving_avg(df: DataFrame, key: Sequence[str], t: str, x: str, w: int,
               name: str = "ma") -> DataFrame:
    """Centred moving average over ``2w+1`` points, NULL where the window is not full."""
    win = Window.partitionBy(*key).orderBy(t).rowsBetween(-w, w)
    return df.withColumn(name, F.when(F.count(x).over(win) == 2 * w + 1, F.avg(x).over(win)))


def extend_ends(df: DataFrame, key: Sequence[str], t: str, s: str, w: int,
                name: str = "smooth") -> DataFrame:
    """Fill the NULL ends of a centred smoother by straight lines.

    Right end: ``s[n-w] + k*(s[n-w] - s[n-w-1])``; left end:
    ``s[w+1] - k*(s[w+2] - s[w+1])`` where ``k`` counts steps from the last
    or first smoothed point.  Series positions come from ``t`` (1-based).
    """
    g = Window.partitionBy(*key)
    n = F.max(t).over(g)
    at = lambda pos: F.max(F.when(F.col(t) == pos, F.col(s))).over(g)
    right_base, right_prev = at(n - w), at(n - w - 1)
    left_base, left_next = at(F.lit(w + 1)), at(F.lit(w + 2))
    right = right_base + (F.col(t) - (n - w)) * (right_base - right_prev)
    left = left_base - ((w + 1) - F.col(t)) * (left_next - left_base)
    return df.withColumn(name, F.when(F.col(s).isNotNull(), F.col(s))
                         .when(F.col(t) > n - w, right).when(F.col(t) <= w, left))


def month_sequence(df: DataFrame, key: Sequence[str], year: str, month: str,
                   name: str = "month_seq") -> DataFrame:
    """Month ordinal from 1 within each series."""
    m = F.col(year) * 12 + F.col(month)
    return df.withColumn(name, (m - F.min(m).over(Window.partitionBy(*key)) + 1).cast("int"))


# --------------------------------------------------------------------------- ordering / top-k

def top_k(df: DataFrame, order: Sequence[Column], k: int, skip: Column | None = None) -> DataFrame:
    """First ``k`` rows in ``order``; ``skip`` removes unwanted keys *before* ranking.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps its
    own top k, only ``k`` rows per task move.
    """
    base = df.where(~skip) if skip is not None else df
    return base.orderBy(*order).limit(k)


def first_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, ordinal: str, k: int) -> DataFrame:
    """Last ``k`` rows by an explicit load ordinal."""
    return df.orderBy(F.desc(ordinal)).limit(k)


def in_both_top_k(df: DataFrame, order_a: Sequence[Column], order_b: Sequence[Column],
                  k: int) -> DataFrame:
    """Rows ranked in the top ``k`` under both orders (e.g. highest profit, lowest cv)."""
    a = df.orderBy(*order_a).limit(k)
    b = df.orderBy(*order_b).limit(k)
    return a.intersect(b)
