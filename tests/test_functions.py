"""Column functions on hand-made rows: clocks, dates, bins, rounding."""

from pyspark.sql import functions as F

from quarry import functions as S


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_parse_clock(spark):
    rows = [("0752A",), ("0012A",), ("1230P",), ("1215A",), ("12",), (None,), ("0115P",), ("1375A",)]
    out = spark.createDataFrame(rows, "c string").select(S.parse_clock("c").alias("p")).collect()
    got = [(r.p.hour, r.p.minute) for r in out]
    assert got == [(7, 52), (0, 12), (12, 30), (0, 15), (None, None), (None, None), (13, 15), (None, None)]


def test_clock_text_roundtrip(spark):
    df = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ'2024-01-01 00:00:00', "
                   "TIMESTAMP_NTZ'2024-01-01 23:59:00', INTERVAL 7 MINUTES)) AS ts")
    out = df.select(F.hour("ts").alias("h"), F.minute("ts").alias("m"),
                    S.parse_clock(S.clock_text("ts")).alias("p")).collect()
    assert all(r.h == r.p.hour and r.m == r.p.minute for r in out)


def test_parse_ts_first_format_wins(spark):
    got = _one(spark, [("11/7/2016 11:51",), ("13-07-2016 08:33:16",), ("junk",)], "s string",
               F.date_format(S.parse_ts("s", "d/M/yyyy HH:mm", "dd-MM-yyyy HH:mm:ss"), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2016-07-11 11:51:00", "2016-07-13 08:33:16", None]


def test_percent_and_tenure(spark):
    got = _one(spark, [("10.65%",), ("10.75%",), ("x",)], "s string", S.parse_percent("s", 1))
    assert got == [10.6, 10.8, None]  # half-even: 10.65 -> 10.6
    got = _one(spark, [("10+ years",), ("< 1 year",), ("1 year",), ("3 years",), ("n/a",), (None,)],
               "s string", S.parse_tenure("s"))
    assert got == [10, 0, 1, 3, None, None]


def test_season_first_branch_wins(spark):
    got = _one(spark, [(m,) for m in range(1, 13)], "m int", S.season("m"))
    assert got[11] == "Winter" and got[0] == "Winter" and got[2] == "Spring" and got[8] == "Fall"


def test_cut_is_right_closed(spark):
    got = _one(spark, [(h,) for h in (0, 4, 5, 8, 20, 21, 23, 24)], "h int",
               S.cut("h", S.SLOT_BREAKS, S.SLOT_LABELS))
    assert got == ["LateNight", "LateNight", "EarlyMorning", "EarlyMorning", "Evening",
                   "LateEvening", "LateEvening", None]


def test_bands_catch_all(spark):
    got = _one(spark, [(-1.0,), (None,), (0.0,), (5.0,), (19.99,), (20.0,)], "x double",
               S.bands("x", S.TIP_EDGES, S.TIP_LABELS, S.TIP_OTHER))
    assert got == ["20above_Bucket", "20above_Bucket", "0_Bucket_5", "5_Bucket_10", "15_Bucket_20",
                   "20above_Bucket"]


def test_rounding_modes(spark):
    df = spark.createDataFrame([(2.5,), (25000.0,), (35000.0,)], "x double")
    r = df.select(S.round_to("x", 0, "half_even").alias("e"), S.round_to("x", 0, "half_up").alias("u"),
                  S.round_bin("x", 10000).alias("b")).collect()
    assert (r[0].e, r[0].u) == (2.0, 3.0)
    assert r[1].b == 20000.0 and r[2].b == 40000.0


def test_hour_bin_and_flag(spark):
    got = _one(spark, [(0,), (3,), (4,), (23,)], "h int", S.hour_bin("h", 4))
    assert got == ["0_3", "0_3", "4_7", "20_23"]
    got = _one(spark, [(1.0,), (0.0,), (None,)], "x double", S.flag(F.col("x") > 0))
    assert got == [1, 0, None]


def test_fiscal_year_bounds():
    lo, hi = S.fiscal_year_bounds(2017, 7)
    assert str(lo) == "2016-07-01" and str(hi) == "2017-06-30"


def test_elapsed_exact(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00.9' AS a, TIMESTAMP_NTZ'2024-01-01 00:00:01.1' AS b")
    assert abs(df.select(S.elapsed("a", "b", "seconds")).first()[0] - 0.2) < 1e-9


def test_century_pivot(spark):
    df = spark.createDataFrame([("Dec-11",), ("Jan-85",)], "s string")
    got = [r[0] for r in df.select(F.date_format(S.century_pivot(S.parse_ts("s", "MMM-yy")), "yyyy-MM")).collect()]
    assert got == ["2011-12", "1985-01"]


def test_zero_in_word_fix(spark):
    from quarry.operators.quality import ZERO_IN_WORD, recode
    df = spark.createDataFrame([("A0lytics",), ("2.0",), ("0nline",)], "s string")
    got = [r.s for r in recode(df, "s", patterns=[ZERO_IN_WORD]).collect()]
    assert got == ["Analytics", "2.0", "nanline"]


def test_conform_skip_rule(spark):
    from quarry.operators.quality import conform
    df = spark.createDataFrame([(1, 2), (3, 0)], "a int, b int")
    rules = {"pos": F.col("b") > 0, "small": F.col("a") < 5}
    assert conform(df, rules).count() == 1 and conform(df, rules, skip=["pos"]).count() == 2
