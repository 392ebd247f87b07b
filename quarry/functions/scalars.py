"""Column -> Column helpers: predicates, parsing, binning.

Everything here is a built-in Spark expression, so it stays inside
whole-stage codegen and never leaves the JVM.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------- predicates

def eq_ci(c: ColumnOrName, value: str) -> Column:
    """String equality that ignores case, like a case-blind SQL collation."""
    return F.lower(_c(c)) == F.lit(value.lower())


def in_range(c: ColumnOrName, lo, hi) -> Column:
    """Inclusive range, both ends kept."""
    return _c(c).between(lo, hi)


def fiscal_year_bounds(year: int, start_month: int = 7) -> tuple[_dt.date, _dt.date]:
    """First and last day of a fiscal year that ends in ``year``."""
    if start_month == 1:
        return _dt.date(year, 1, 1), _dt.date(year, 12, 31)
    lo = _dt.date(year - 1, start_month, 1)
    hi = _dt.date(year, start_month, 1) - _dt.timedelta(days=1)
    return lo, hi


def in_fiscal_year(c: ColumnOrName, year: int, start_month: int = 7) -> Column:
    """Date inside the fiscal year; compares the raw column so Parquet can skip row groups."""
    lo, hi = fiscal_year_bounds(year, start_month)
    return (_c(c) >= F.lit(lo)) & (_c(c) < F.lit(hi + _dt.timedelta(days=1)))


def any_of(*conds: Column) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def all_of(*conds: Column) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def ne(c: ColumnOrName, value, keep_null: bool = False) -> Column:
    """``c != value``; NULL rows fall out unless ``keep_null``."""
    cond = _c(c) != F.lit(value)
    return (cond | _c(c).isNull()) if keep_null else cond


def not_sentinel(c: ColumnOrName, sentinel=0) -> Column:
    """Exclude a placeholder code (0 = unknown) before ranking."""
    return _c(c) != F.lit(sentinel)


# --------------------------------------------------------------------------- strings

def first_token(c: ColumnOrName, sep: str) -> Column:
    """First piece of a delimited string; ``sep`` is taken literally."""
    import re
    return F.element_at(F.split(_c(c), re.escape(sep)), 1)


def to_type(c: ColumnOrName, dtype: str, strict: bool = False) -> Column:
    """Cast; bad text becomes NULL unless ``strict`` (ANSI cast raises)."""
    return _c(c).cast(dtype) if strict else _c(c).try_cast(dtype)


def parse_percent(c: ColumnOrName, digits: int = 1) -> Column:
    """``"10.65%"`` -> 10.7 (half-even, as R rounds)."""
    num = F.regexp_replace(_c(c), "%", "").try_cast("double")
    return F.bround(num, digits)


def parse_tenure(c: ColumnOrName) -> Column:
    """``"10+ years"`` -> 10, ``"< 1 year"`` -> 0, ``"n/a"`` -> NULL."""
    s = F.regexp_replace(_c(c), "< ?1", "0")
    s = F.regexp_replace(s, "[^0-9]", "")
    return F.nullif(F.trim(s), F.lit("")).try_cast("int")


def parse_ts(c: ColumnOrName, *formats: str) -> Column:
    """First of several timestamp formats that parses; NULL when none does."""
    return F.coalesce(*[F.try_to_timestamp(_c(c), F.lit(f)) for f in formats])


def century_pivot(ts: ColumnOrName, pivot: int = 69) -> Column:
    """Two-digit years: Spark's ``yy`` reads 00-99 as 2000-2099; move years from
    ``2000 + pivot`` upward back a century (so 69-99 become 1969-1999)."""
    return F.when(F.year(_c(ts)) >= 2000 + pivot, F.add_months(_c(ts), -1200)).otherwise(_c(ts))


def parse_clock(c: ColumnOrName) -> Column:
    """``"0752A"`` -> struct(hour=7, minute=52).  ``00xxA`` is just after midnight.

    12-hour clock: hours 01-12, ``12xxA`` is just after midnight, ``12xxP``
    noon, and an AM hour written ``00`` also means midnight.  Integer
    arithmetic on the digits (no timestamp parsing); anything else is NULL.
    """
    s = F.upper(F.trim(_c(c)))
    hh = F.substring(s, 1, 2).try_cast("int")
    mm = F.substring(s, 3, 2).try_cast("int")
    ap = F.substring(s, 5, 1)
    valid = (s.rlike("^[0-9]{4}[AP]M?$") & (mm < 60)
             & (hh.between(1, 12) | ((hh == 0) & (ap == "A"))))
    hour = F.when(valid, hh % 12 + F.when(ap == "P", 12).otherwise(0))
    return F.struct(hour.alias("hour"), F.when(valid, mm).alias("minute"))


def clock_text(ts: ColumnOrName) -> Column:
    """Inverse of :func:`parse_clock`: ``hhmm`` plus ``A``/``P``, midnight hour ``00``."""
    h = F.hour(_c(ts))
    h12 = F.when(h > 12, h - 12).otherwise(h)
    return F.concat(F.lpad(h12.cast("string"), 2, "0"),
                    F.lpad(F.minute(_c(ts)).cast("string"), 2, "0"),
                    F.when(h < 12, F.lit("A")).otherwise(F.lit("P")))


# --------------------------------------------------------------------------- dates and durations

def elapsed(start: ColumnOrName, end: ColumnOrName, unit: str = "minutes") -> Column:
    """Elapsed time as a double in seconds, minutes or hours (exact, microsecond based)."""
    micros = F.timestamp_diff("MICROSECOND", _c(start), _c(end)).cast("double")
    div = {"seconds": 1e6, "minutes": 6e7, "hours": 3.6e9, "days": 8.64e10}[unit]
    return micros / F.lit(div)


def speed(dist: ColumnOrName, start: ColumnOrName, end: ColumnOrName) -> Column:
    """Distance per elapsed hour; NULL when no time elapsed."""
    return F.try_divide(_c(dist), elapsed(start, end, "hours"))


# --------------------------------------------------------------------------- numbers

def round_to(c: ColumnOrName, digits: int = 0, mode: str = "half_up") -> Column:
    """``half_up`` as SQL ``round``; ``half_even`` as R ``round``."""
    if mode == "half_even":
        return F.bround(_c(c), digits)
    if mode == "half_up":
        return F.round(_c(c), digits)
    raise ValueError(mode)


def ratio(a: ColumnOrName, b: ColumnOrName, digits: int | None = None) -> Column:
    r = F.try_divide(_c(a).cast("double"), _c(b))
    return r if digits is None else F.bround(r, digits)


def flag(cond: Column) -> Column:
    """1/0 indicator; NULL in, NULL out."""
    return F.when(cond, F.lit(1)).when(~cond, F.lit(0))


def cv(c: ColumnOrName) -> Column:
    """Coefficient of variation in percent, sample standard deviation (aggregate)."""
    return F.try_divide(F.lit(100.0) * F.stddev_samp(_c(c)), F.avg(_c(c)))


def avg_where(x: ColumnOrName, cond: Column) -> Column:
    """Average of ``x`` over rows meeting ``cond`` (aggregate)."""
    return F.avg(F.when(cond, _c(x)))


def label_at(p: ColumnOrName, t: float, pos=1, neg=0) -> Column:
    """Class label at a probability cut-off (``p >= t`` is positive)."""
    return F.when(_c(p) >= F.lit(t), F.lit(pos)).otherwise(F.lit(neg))


# --------------------------------------------------------------------------- bins

def hour_bin(hour: ColumnOrName, size: int = 4) -> Column:
    """Label ``a_b`` of the ``size``-hour block holding ``hour`` (0_3, 4_7, ...)."""
    lo = (F.floor(_c(hour) / size) * size).cast("int")
    return F.concat(lo.cast("string"), F.lit("_"), (lo + size - 1).cast("string"))


def cut(c: ColumnOrName, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins, lowest edge included: [b0,b1], (b1,b2], ...  Outside -> NULL."""
    if len(labels) != len(breaks) - 1:
        raise ValueError("need one label per interval")
    x = _c(c)
    expr = F.when((x >= breaks[0]) & (x <= breaks[1]), F.lit(labels[0]))
    for i in range(1, len(labels)):
        expr = expr.when((x > breaks[i]) & (x <= breaks[i + 1]), F.lit(labels[i]))
    return expr


# Meteorological seasons by month; the first matching branch wins,
# so December is Winter.
SEASONS = (("Winter", (1, 2, 12)), ("Spring", (3, 4, 5)), ("Summer", (6, 7, 8)),
           ("Fall", (9, 10, 11, 12)))

# 4-hour time slots of a day (right-closed cut, lowest edge kept).
SLOT_BREAKS = (0, 4, 8, 12, 16, 20, 23)
SLOT_LABELS = ("LateNight", "EarlyMorning", "Morning", "Afternoon", "Evening", "LateEvening")

# Tip bands [0,5), [5,10), [10,15), [15,20), everything else.
TIP_EDGES = (0, 5, 10, 15, 20)
TIP_LABELS = ("0_Bucket_5", "5_Bucket_10", "10_Bucket_15", "15_Bucket_20")
TIP_OTHER = "20above_Bucket"


def season(month: ColumnOrName) -> Column:
    m = _c(month)
    expr = None
    for name, months in SEASONS:
        expr = (F.when(m.isin(*months), F.lit(name)) if expr is None
                else expr.when(m.isin(*months), F.lit(name)))
    return expr


def bands(c: ColumnOrName, edges: Sequence[float], labels: Sequence[str],
          otherwise: str | None = None) -> Column:
    """Value bands ``[e0,e1), [e1,e2) ...`` with a catch-all label (NULL, negatives...)."""
    x = _c(c)
    expr = None
    for i, lab in enumerate(labels):
        cond = (x >= edges[i]) & (x < edges[i + 1])
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(otherwise))


def round_bin(c: ColumnOrName, step: float, mode: str = "half_even") -> Column:
    """Bin by rounding to a multiple of ``step`` (R's half-even by default)."""
    q = _c(c) / F.lit(step)
    r = F.bround(q, 0) if mode == "half_even" else F.round(q, 0)
    return r * F.lit(step)


# --------------------------------------------------------------------------- date parts

_PARTS = {
    "year": lambda ts: F.year(ts), "month": lambda ts: F.month(ts),
    "day": lambda ts: F.dayofmonth(ts), "hour": lambda ts: F.hour(ts),
    "minute": lambda ts: F.minute(ts), "weekday": lambda ts: F.date_format(ts, "EEEE"),
    "month_text": lambda ts: F.date_format(ts, "MM"), "day_text": lambda ts: F.date_format(ts, "dd"),
    "date": lambda ts: F.to_date(ts),
}


def date_parts(ts: ColumnOrName, parts=("year", "month", "day", "hour", "weekday")) -> list[Column]:
    """Named calendar parts of a timestamp, as a list of aliased Columns."""
    return [_PARTS[p](_c(ts)).alias(p) for p in parts]
