"""Whole business questions built from the operators.

Each takes role-shaped DataFrames (tickets, requests, rounds, ...) and
returns a DataFrame.  Years, series and countries are key columns, not
copies of the code; groups picked "from the data" are computed, never
typed in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry import functions as S
from quarry.operators import aggregate as A
from quarry.operators import windows as W
from quarry.operators.columns import drop_all_null
from quarry.operators.reshape import melt_flags
from quarry.session import ensure_checkpoint_dir


def ticket_seasonality(tickets: DataFrame, n: int = 3, ts: str = "issued", code: str = "code",
                       by: Sequence[str] = ("fy",)) -> DataFrame:
    """Tickets per season and the top ``n`` codes of each season (ties kept)."""
    t = tickets.withColumn("season", S.season(F.month(ts)))
    counts = t.groupBy(*by, "season", code).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by, "season").agg(F.sum("n").alias("season_total"))
    top = W.top_n_per_group(counts, [*by, "season"], [F.desc("n")], n, ties="keep")
    return top.join(totals, [*by, "season"])


def ticket_hour_profile(tickets: DataFrame, n: int = 3, clock: str = "clock", code: str = "code",
                        by: Sequence[str] = ("fy",)) -> DataFrame:
    """Top ``n`` codes per 4-hour bin, the hour parsed from ``hhmm`` + A/P text."""
    t = tickets.withColumn("hour_bin", S.hour_bin(S.parse_clock(clock)["hour"], 4))
    # unparsable clocks form their own NULL bin (as a CASE without ELSE does).  No
    # filter on hour_bin: Catalyst would push it to the scan with the whole parsing
    # expression inlined many times over.
    counts = t.groupBy(*by, "hour_bin", code).agg(F.count(F.lit(1)).alias("n"))
    return W.top_n_per_group(counts, [*by, "hour_bin"], [F.desc("n")], n, ties="keep")


def common_hours_of_top_codes(tickets: DataFrame, n: int = 3, clock: str = "clock", code: str = "code",
                              by: Sequence[str] = ("fy",)) -> DataFrame:
    """For the ``n`` commonest codes (found from data), their busiest hour bin."""
    t = tickets.withColumn("hour_bin", S.hour_bin(S.parse_clock(clock)["hour"], 4))
    per_code = t.groupBy(*by, code).agg(F.count(F.lit(1)).alias("code_n"))
    top_codes = W.top_n_per_group(per_code, list(by), [F.desc("code_n"), F.asc(code)], n, ties="cut") \
        .select(*by, code)
    counts = t.join(top_codes, [*by, code], "left_semi") \
        .groupBy(*by, code, "hour_bin").agg(F.count(F.lit(1)).alias("n"))
    return W.top_n_per_group(counts, [*by, code], [F.desc("n"), F.asc("hour_bin")], 1, ties="cut") \
        .drop("rnk")


def fines_by_year(tickets: DataFrame, rates: DataFrame, n: int = 3, code: str = "code",
                  rate_key: Sequence[str] = ("fy", "band"), year: str = "fy") -> DataFrame:
    """Top ``n`` codes per year, their fine from a rate card, and the amount collected."""
    t = tickets.withColumn("band", (F.col(code) / 10).cast("int"))
    counts = t.groupBy(year, code, "band").agg(F.count(F.lit(1)).alias("tickets"))
    top = W.top_n_per_group(counts, [year], [F.desc("tickets"), F.asc(code)], n, ties="cut")
    out = top.join(rates, list(rate_key), "left")
    return out.select(year, code, "tickets", "fine", (F.col("tickets") * F.col("fine")).cast("long").alias("collected"))


def supply_demand_gap(requests: DataFrame, slot: str = "slot", point: str = "pickup_point",
                      completed: str = "purchase", status: str = "status") -> DataFrame:
    """Demand, supply and gap per (slot, pickup point), flagging each point's worst slot."""
    g = requests.groupBy(slot, point).agg(
        F.count(F.lit(1)).alias("demand"),
        F.count(F.when(F.col(status) == completed, 1)).alias("supply"))
    g = g.withColumn("gap", F.col("demand") - F.col("supply"))
    # window over the small (slot x point) table
    worst = F.max("gap").over(Window.partitionBy(point))
    return g.withColumn("is_worst", F.col("gap") == worst)


def status_by_slot(requests: DataFrame, statuses: Sequence[str], slot: str = "slot",
                   point: str = "pickup_point", status: str = "status") -> DataFrame:
    return requests.where(F.col(status).isin(*statuses)).groupBy(slot, point, status) \
        .agg(F.count(F.lit(1)).alias("n"))


def sector_investment(rounds: DataFrame, mapping_wide: DataFrame, lo: float, hi: float,
                      countries_n: int = 3, sectors_n: int = 3, amount: str = "amount",
                      company: str = "company", country: str = "country",
                      category: str = "category") -> DataFrame:
    """Investments inside an amount band, top countries, their top sectors and top company.

    ``mapping_wide`` is a category -> 0/1 sector-column table (a fixed code
    list); it is melted to (category, sector).
    """
    sectors = [c for c in mapping_wide.columns if c != category]
    mapping = melt_flags(mapping_wide, [category], sectors, "sector", "_flag").drop("_flag")
    r = rounds.where(S.in_range(amount, lo, hi)).join(mapping, category)
    # one pass over the fact rows: everything below is derived from this small
    # (country, sector, company) aggregate.  The branches push different filters,
    # so Spark would not reuse one exchange; the aggregate is checkpointed instead.
    ensure_checkpoint_dir(rounds.sparkSession)
    fine = r.groupBy(country, "sector", company).agg(F.count(F.lit(1)).alias("_n"),
                                                     F.sum(amount).alias("company_amount")) \
        .checkpoint(eager=True)
    top_countries = (fine.groupBy(country).agg(F.sum("company_amount").alias("_t"))
                     .orderBy(F.desc("_t"), F.asc(country)).limit(countries_n).select(country))
    fine = fine.join(F.broadcast(top_countries), country, "left_semi")
    per_sector = fine.groupBy(country, "sector").agg(F.sum("_n").alias("n_rounds"),
                                                     F.sum("company_amount").alias("total_amount"))
    ranked = W.top_n_per_group(per_sector, [country], [F.desc("n_rounds"), F.asc("sector")],
                               sectors_n, ties="cut", rank_col="sector_rank")
    best = A.argmax(fine, "company_amount", [company], by=[country, "sector"], tie=[company])
    return ranked.join(best, [country, "sector"], "left")


def best_group(df: DataFrame, by: str, x: str, lo: float, hi: float) -> DataFrame:
    """Group means inside ``[lo, hi]``, then the largest one."""
    means = df.groupBy(by).agg(F.avg(x).alias("mean"))
    return A.argmax(means.where(S.in_range("mean", lo, hi)), "mean", [by], tie=[by])


def attendance(in_wide: DataFrame, out_wide: DataFrame, id_col: str,
               long_day: float = 8.0, short_day: float = 7.0) -> DataFrame:
    """Per employee: mean hours worked, overtime days, short days and leave days.

    Both wide tables (one timestamp column per day) lose their all-NULL days
    first (holidays), are unpivoted and joined on (id, day); a day with no
    clock-in is leave.  Counting is by id, never by row position.
    """
    in_wide = drop_all_null(in_wide)
    out_wide = out_wide.select(*in_wide.columns)
    days = [c for c in in_wide.columns if c != id_col]
    ins = in_wide.unpivot([id_col], days, "day", "t_in")
    outs = out_wide.unpivot([id_col], days, "day", "t_out")
    j = ins.join(outs, [id_col, "day"])
    hours = S.elapsed("t_in", "t_out", "hours")
    return j.groupBy(id_col).agg(
        F.avg(hours).alias("mean_hours"),
        F.count(F.when(hours > long_day, 1)).alias("overtime_days"),
        F.count(F.when(hours < short_day, 1)).alias("short_days"),
        F.count(F.when(F.col("t_in").isNull(), 1)).alias("leave_days"))


def least_profitable_by_region(fact: DataFrame, sub_category: str, region: str, profit: str,
                               shipment: str) -> DataFrame:
    """Find the least profitable sub-category from the data, then its shipments and profit by region."""
    worst = (fact.groupBy(sub_category).agg(F.sum(profit).alias("_p"))
             .orderBy(F.asc("_p"), F.asc(sub_category)).limit(1).select(sub_category).scalar())
    return fact.where(F.col(sub_category) == worst).groupBy(region).agg(
        F.count(shipment).alias("n_shipments"), F.sum(profit).alias("profit"))


def default_profile(loans: DataFrame, attrs: Sequence[str], bad: F.Column) -> DataFrame:
    """Default rate by every level of every attribute, one job: (attribute, level, n, n_bad, bad_rate)."""
    long = loans.select(bad.cast("int").alias("_bad"), *[F.col(a).cast("string").alias(a) for a in attrs]) \
        .unpivot(["_bad"], list(attrs), "attribute", "level")
    return long.groupBy("attribute", "level").agg(F.count(F.lit(1)).alias("n"),
                                                  F.sum("_bad").alias("n_bad")) \
        .withColumn("bad_rate", F.col("n_bad") / F.col("n"))


def monthly_series(monthly: DataFrame, by: Sequence[str], value: str, k: int = 2) -> DataFrame:
    """Total and cv of each monthly series, ranked both ways; ``picked`` = in both top ``k``."""
    s = monthly.groupBy(*by).agg(F.sum(value).alias("total"), S.cv(value).alias("cv"))
    # rank windows run over the small per-series table
    s = s.withColumn("total_rank", F.row_number().over(Window.orderBy(F.desc("total"), *by))) \
         .withColumn("cv_rank", F.row_number().over(Window.orderBy(F.asc("cv"), *by)))
    return s.withColumn("picked", (F.col("total_rank") <= k) & (F.col("cv_rank") <= k))
