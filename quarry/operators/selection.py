"""Exact values at many ranks at once, by refining histograms shared by all ranks of a group.

Each round counts the values of every open interval in bins (one aggregate: combined in the tasks, a few
numbers a bin are shuffled) and keeps only the bins that hold a wanted rank, with their true smallest and
largest value.  A bin of one distinct value is an answer, any other is an open interval of the next round.
Values find their interval by arithmetic and a join on (interval, bin), so a row costs the same for three
ranks as for a hundred.  Values are never sorted, collected or written; a hot value is one bin count.

The table of open intervals has at most groups x ranks rows.  Up to ``LOCAL_ROWS`` of them are held by the
driver and broadcast; beyond that they are checkpointed and joined like any table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType
from pyspark.sql.window import Window

from quarry.session import ensure_checkpoint_dir

LOCAL_ROWS = 20_000
_TOP = 4096  # bins of a single interval
_ALL = 65_536  # bins of all intervals of a round together, about
_INF = float("inf")
_WHOLE = (ByteType, ShortType, IntegerType, LongType)


def selectable(df: DataFrame, col: str) -> bool:
    """Whether the column holds plain numbers, so that its values can be binned without loss."""
    return isinstance(df.schema[col].dataType, (*_WHOLE, FloatType, DoubleType))


def bounded(df: DataFrame) -> DataFrame:
    """The table, for joins to many rows: computed once and broadcast if it has at most ``LOCAL_ROWS`` rows."""
    table = df.limit(LOCAL_ROWS + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(table)) if table.num_rows <= LOCAL_ROWS else df


def _settle(df: DataFrame, bound: int) -> tuple[DataFrame, int | None]:
    """A table of intervals with an ``id``, and how many are open: held by the driver if ``bound`` rows may be.

    A checkpointed table has no such number yet (None).
    """
    spark = df.sparkSession
    if bound <= LOCAL_ROWS:
        table = df.toArrow()
        lo, hi = (table.column(c).to_pylist() for c in ("lo", "hi"))
        return (spark.createDataFrame(table.append_column("id", pa.array(range(len(lo)), pa.int64()))),
                sum(not (a == b or a != a) for a, b in zip(lo, hi)))
    ensure_checkpoint_dir(spark)
    return df.withColumn("id", F.monotonically_increasing_id()).checkpoint(), None


def _attach(rows: DataFrame, table: DataFrame, local: bool, on: Sequence[tuple[str, str]], nulls: bool = False) -> DataFrame:
    """Join of a table of intervals to many rows, on keys that may be NULL or on whole numbers."""
    pairs = [(F.col(f"l.{a}"), F.col(f"r.{b}")) for a, b in on]
    cond = [p.eqNullSafe(q) if nulls else p == q for p, q in pairs]
    right = F.broadcast(table) if local else table
    return rows.alias("l").join(right.alias("r"), reduce(lambda p, q: p & q, cond, F.lit(True)))


class _Doubles:
    """Equal bins between ``lo`` and ``hi``; ``wide`` ones are equal on a scale logarithmic away from zero."""

    columns = ["half", "span", "lo", "width"]

    def frame(self, lo: Column, hi: Column, wide: Column, bins: int) -> list[Column]:
        """What a row needs of its interval; worked out once for each interval."""
        half = F.when(wide | (hi - lo < F.lit(_INF)), F.lit(1.0)).otherwise(F.lit(0.5))  # hi - lo may be over the range
        span = F.when(wide, F.greatest(F.abs(lo), F.abs(hi), F.lit(1e-290)) * F.lit(2.0 ** -50))
        low, high = (self._scaled(v, half, span) for v in (lo, hi))
        return [half.alias("half"), span.alias("span"), low.alias("lo"), F.when(high > low, high - low).otherwise(F.lit(1.0)).alias("width")]

    def _scaled(self, v: Column, half: Column, span: Column) -> Column:
        return F.when(span.isNull(), v * half).otherwise(F.signum(v) * F.log1p(F.abs(v) / span))

    def place(self, x: Column, half: Column, span: Column, lo: Column, width: Column, bins: int) -> Column:
        at = F.floor((self._scaled(x, half, span) - lo) / width * bins)
        return (F.when(F.isnan(x), F.lit(bins + 1)).when(x == F.lit(_INF), F.lit(bins)).when(x == F.lit(-_INF), F.lit(-1))
                .otherwise(F.least(at, F.lit(bins - 1)))).cast("long")


class _Longs:
    """Bins of equal whole width, without overflow over the whole range of bigint."""

    columns = ["lo", "width"]

    def frame(self, lo: Column, hi: Column, wide: Column, bins: int) -> list[Column]:
        width = self._div(hi, F.lit(bins)) - self._div(lo, F.lit(bins)) + 1
        return [self._div(lo, width).alias("lo"), width.alias("width")]

    def _div(self, a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    def place(self, x: Column, lo: Column, width: Column, bins: int) -> Column:
        return self._div(x, width) - lo


def select_ranks(df: DataFrame, x: str, ranks: Callable[[Column], Column], most: int, by: Sequence[str] = (),
                 ) -> DataFrame:
    """Values at wanted ranks of each group: ``_by<i>``, ``rank``, ``value``, ``below``, ``same``, ``total``.

    ``ranks`` gives from a group's number of non-NULL values (and its keys ``_by<i>``) the array of wanted
    0-based ranks: at most ``most``, each once; ranks outside are ignored.  ``below`` values are smaller than ``value`` and ``same``
    equal it.  Integer columns are selected as bigint, other numbers as double (NaN is the largest).
    Groups may be NULL; a group without a value has no row.  Jobs run while the plan is built.
    """
    whole = isinstance(df.schema[x].dataType, _WHOLE)
    value, axis = F.col(x).cast("bigint" if whole else "double"), _Longs() if whole else _Doubles()
    keys = [f"_by{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], value.alias("_x")).where(F.col("_x").isNotNull())
    usual = F.lit(True) if whole else ~F.isnan("_x") & (F.abs("_x") < F.lit(_INF))
    groups = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(usual, F.col("_x"))).alias("lo"), F.max(F.when(usual, F.col("_x"))).alias("hi"))
    groups = groups.where(F.col("n") > 0).select(
        *keys, "n", "lo", "hi", F.lit(0).cast("bigint").alias("base"), ranks(F.col("n")).cast("array<bigint>").alias("ranks"),
        F.lit(False).alias("wide"))
    n_groups = 1 if not keys else groups.limit(LOCAL_ROWS + 1).count()
    bound = n_groups * most
    local = bound <= LOCAL_ROWS
    groups, _ = _settle(groups, bound)

    opened, inside = groups.withColumn("root", F.col("id")), rows
    on, count, answers = [(k, k) for k in keys], n_groups, []
    while count:
        bins = max(64, min(_TOP, _ALL // count))
        near = opened.select(*[c for _, c in on], "id", *axis.frame(F.col("lo"), F.col("hi"), F.col("wide"), bins))
        if on:
            here = _attach(inside, near, local, on, nulls=not answers).select("r.id", *[f"r.{c}" for c in axis.columns], "l._x")
        else:  # one group: its interval is written into the plan
            only = near.first()
            if only is None:
                break
            here = rows.select(*[F.lit(only[c]).cast(t).alias(c) for c, t in near.dtypes], "_x")
        inside = here.select("id", axis.place(F.col("_x"), *map(F.col, axis.columns), bins).alias("bin"), "_x")
        hist = inside.groupBy("id", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        told = opened.select(F.col("id").alias("_id"), "root", "base", "ranks", F.col("n").alias("_of"), F.col("wide").alias("_was"))
        start = F.col("base") + F.sum("n").over(Window.partitionBy("id").orderBy("bin").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        found = (_attach(hist, told, local, [("id", "_id")]).withColumn("_start", start)
                 .withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("n"))))
                 .where(F.size("ranks") > 0)
                 # a bin that keeps half of its interval's values is split on the other scale next
                 .select(F.col("id").alias("parent"), "bin", "root", "n", "lo", "hi", F.col("_start").alias("base"), "ranks",
                         ((F.col("n") * 2 >= F.col("_of")) & ~F.col("_was")).alias("wide")))
        found, count = _settle(found, bound)
        one = F.col("lo").eqNullSafe(F.col("hi"))
        answers.append(found.where(one))
        opened = found.where(~one)
        count = opened.count() if count is None else count
        on = [("id", "parent"), ("bin", "bin")]
    if not answers:
        answers = [opened.withColumn("parent", F.col("id"))]
    values = reduce(DataFrame.unionByName, answers).select(
        F.col("root"), F.explode("ranks").alias("rank"), F.col("lo").alias("value"), F.col("base").alias("below"), F.col("n").alias("same"))
    names = groups.select(F.col("id").alias("_id"), *keys, F.col("n").alias("total"))
    return _attach(values, names, local, [("root", "_id")]).select(*keys, "rank", "value", "below", "same", "total")


def quantiles(df: DataFrame, x: str, positions: dict[float, Callable[[Column], Column]], by: Sequence[str] = ()) -> DataFrame:
    """Values at fractional 0-based positions, between neighbours linearly: (``_by<i>``, ``pct``, ``value``).

    ``positions`` gives for each label a position from the group's number of values.  Groups without a
    value have no row.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    spots = lambda n: [h(n).cast("double") for h in positions.values()]
    wanted = lambda n: F.array_distinct(F.array(*[f(h) for h in spots(n) for f in (F.floor, F.ceil)]))
    got = select_ranks(df, x, wanted, 2 * len(positions), by)
    per = got.groupBy(*keys).agg(F.max("total").alias("n"), F.map_from_entries(F.collect_list(
        F.struct("rank", F.col("value").cast("double")))).alias("at")).where(F.col("n").isNotNull())
    labels = F.array(*[F.struct(F.lit(float(p)).alias("pct"), h.alias("h")) for p, h in zip(positions, spots(F.col("n")))])
    long = per.select(*keys, "at", F.explode(labels).alias("s"))
    h = F.col("s.h")
    a, b = F.element_at("at", F.floor(h)), F.element_at("at", F.ceil(h))
    return long.select(*keys, F.col("s.pct").alias("pct"), F.when(a == b, a).otherwise(a + (h - F.floor(h)) * (b - a)).alias("value"))
