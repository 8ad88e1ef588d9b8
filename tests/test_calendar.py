import datetime as dt
import math

import pandas as pd
import pytest
from pandas.tseries.holiday import USFederalHolidayCalendar
from pyspark.sql import functions as F

from gridcast.functions import calendar as cal
from gridcast.schemas import CALENDAR_COLUMNS

NY = "America/New_York"


def hours(spark, first, last):
    return spark.sql(
        f"select explode(sequence(timestamp_ntz'{first}', timestamp_ntz'{last}', interval 1 hour)) as datetime"
    )


def at(spark, *texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    return rows.select("t", F.col("t").cast("timestamp_ntz").alias("datetime"))


def test_localize_drop_matches_pandas(spark):
    kept = cal.localize_drop(hours(spark, "2022-03-12 00:00:00", "2022-11-08 23:00:00"), "datetime")
    got = sorted(r[0] for r in kept.collect())
    naive = pd.date_range("2022-03-12", "2022-11-08 23:00", freq="h")
    want = naive.tz_localize(NY, ambiguous="NaT", nonexistent="NaT").dropna().tz_localize(None)
    assert got == list(want.to_pydatetime())
    assert len(naive) - len(got) == 2


def test_clock_change_days_have_23_hours(spark):
    for day, missing in (("2022-03-13", 2), ("2022-11-06", 1)):
        kept = cal.localize_drop(hours(spark, f"{day} 00:00:00", f"{day} 23:00:00"), "datetime")
        found = {r[0].hour for r in kept.collect()}
        assert set(range(24)) - found == {missing}


def test_is_dst_matches_pandas(spark):
    rows = cal.localize_drop(hours(spark, "2021-01-01 00:00:00", "2022-12-31 23:00:00"), "datetime")
    got = rows.select("datetime", cal.is_dst(F.col("datetime")).alias("dst")).toPandas()
    want = pd.DatetimeIndex(got["datetime"]).tz_localize(NY).strftime("%z") == "-0400"
    assert (got["dst"].to_numpy() == want).all()


def test_results_do_not_depend_on_the_session_zone(spark):
    def frame():
        rows = cal.with_calendar(hours(spark, "2022-03-12 22:00:00", "2022-03-13 05:00:00"))
        shown = rows.select(*[F.col(c).cast("string") for c in CALENDAR_COLUMNS])
        return sorted(map(tuple, shown.collect()))

    in_utc = frame()
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert frame() == in_utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_holidays_match_the_federal_calendar(spark):
    days = spark.sql("select explode(sequence(date'1995-01-01', date'2030-12-31', interval 1 day)) as d")
    got = {r[0] for r in days.filter(cal.holiday(F.col("d"))).collect()}
    want = {t.date() for t in USFederalHolidayCalendar().holidays("1995-01-01", "2030-12-31")}
    assert got == want


@pytest.mark.parametrize(
    "day, expected",
    [("2021-12-24", True), ("2021-12-25", False), ("2022-12-26", True), ("2022-12-25", False), ("2021-12-31", True),
     ("2021-06-18", True), ("2020-06-19", False), ("2022-06-20", True), ("2022-11-24", True), ("2022-11-25", False)],
)
def test_observed_holidays(spark, day, expected):
    row = spark.range(1).select(cal.holiday(F.lit(day).cast("date")).alias("h")).first()
    assert row["h"] is expected


def test_juneteenth_start_is_a_parameter(spark):
    day = F.lit("2021-06-18").cast("date")
    assert spark.range(1).select(cal.holiday(day, "2021-10-01").alias("h")).first()["h"] is False


def test_regimes_partition_time(spark):
    rows = at(spark, "2020-03-17 23:00:00", "2020-03-18 00:00:00", "2020-06-30 00:00:00", "2020-06-30 01:00:00")
    flags = rows.select("t", *[v.cast("int").alias(k) for k, v in cal.regime(F.col("datetime")).items()])
    got = {r["t"]: (r["precovid"], r["is_sah"], r["postcovid"]) for r in flags.collect()}
    assert list(got.values()) == [(1, 0, 0), (0, 1, 0), (0, 1, 0), (0, 0, 1)]


def test_cyclic_default_joins_both_ends_and_period_does_not(spark):
    rows = spark.createDataFrame([(0,), (23,)], "h int")
    closed = [tuple(r) for r in rows.select(*cal.cyclic(F.col("h"), 0, 23)).collect()]
    assert closed[0] == pytest.approx(closed[1], abs=1e-12)
    cos, sin = rows.select(*cal.cyclic(F.col("h"), 0, 23, period=24)).collect()[1]
    assert cos == pytest.approx(math.cos(2 * math.pi * 23 / 24)) and sin == pytest.approx(math.sin(2 * math.pi * 23 / 24))


def test_day_numbers_seasons_and_names(spark):
    days = spark.sql("select explode(sequence(date'2022-10-03', date'2022-10-09', interval 1 day)) as d")
    got = days.select(cal.dow_number(F.col("d")), cal.day_name(F.col("d")), cal.weekend(F.col("d"))).collect()
    assert [r[0] for r in got] == [1, 2, 3, 4, 5, 6, 7]
    assert [r[1] for r in got][0::6] == ["Monday", "Sunday"]
    assert [r[2] for r in got] == [False] * 5 + [True] * 2
    months = spark.range(1, 13).select(cal.season_number(F.col("id").cast("int"))).collect()
    assert [r[0] for r in months] == [4, 4, 4, 3, 2, 1, 1, 1, 1, 2, 3, 4]


def test_calendar_frame_has_all_columns(spark):
    row = cal.with_calendar(at(spark, "2022-10-08 05:00:00")).select(CALENDAR_COLUMNS).first()
    assert row["date"] == dt.date(2022, 10, 8) and row["hour"] == 5 and row["dow"] == "Saturday"
    assert (row["is_dst"], row["weekend"], row["postcovid"], row["holiday"]) == (True, True, True, False)
    assert (row["recent"], row["dow_num"], row["season_num"]) == (1, 6, 2)


def test_parse_and_build_timestamps(spark):
    row = spark.createDataFrame([("11/1/2022 12:00:00 AM", "2022-11-01", 5)], "t string, d string, h int").select(
        cal.parse_wall_time(F.col("t"), "M/d/yyyy h:mm:ss a"), cal.wall_hour(F.col("d").cast("date"), F.col("h")),
        cal.format_date(cal.next_day(F.col("d").cast("date"))),
    ).first()
    assert row[0] == dt.datetime(2022, 11, 1) and row[1] == dt.datetime(2022, 11, 1, 5) and row[2] == "2022-11-02"
