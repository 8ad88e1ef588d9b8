"""Scalar functions: calendar, weather and display."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.bindings import common as c
from gridcast.bindings.common import codes, query, sql
from gridcast.bindings.selection_queries import _HOLIDAY
from gridcast.functions import calendar as cal
from gridcast.functions import display, weather
from gridcast.functions.weather import INHG_PER_HPA, RAIN_CODES, SNOW_CODES
from gridcast.operators import peaks

_DATE = "CAST(o_orderdate AS DATE)"
_NY = "'America/New_York'"
# Hours that survive the round trip through UTC and are not shown twice.
_REAL_HOURS = f"""
    SELECT datetime FROM (SELECT datetime, timezone({_NY}, datetime) AS instant FROM order_hours)
    WHERE timezone({_NY}, instant) = datetime AND timezone({_NY}, instant + INTERVAL 1 HOUR) <> datetime
      AND timezone({_NY}, instant - INTERVAL 1 HOUR) <> datetime"""


@query("date_parts", """
    SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
           CAST(hour(ts) AS INTEGER) AS hour, dayname(ts) AS dow FROM events""")
def date_parts(spark, d):
    ts, date = F.col("ts"), F.col("ts").cast("date")
    return c.table(spark, d, "events").select(
        "event_id", date.cast("string").alias("date"), F.year(date).alias("year"), F.month(date).alias("month"),
        F.hour(ts).alias("hour"), cal.day_name(date).alias("dow"))


@query("localize_drop", sql("SELECT CAST(datetime AS VARCHAR) AS datetime FROM real_hours", "order_hours", extra={"real_hours": _REAL_HOURS}))
def localize_drop(spark, d):
    return c.as_text(cal.localize_drop(c.order_hours(spark, d), "datetime"), "datetime")


@query("is_dst", sql(f"""
    SELECT CAST(datetime AS VARCHAR) AS datetime,
           date_diff('hour', timezone('UTC', timezone({_NY}, datetime)), datetime) = -4 AS is_dst
    FROM real_hours""", "order_hours", extra={"real_hours": _REAL_HOURS}))
def is_dst(spark, d):
    hours = cal.localize_drop(c.order_hours(spark, d), "datetime")
    return c.as_text(hours.withColumn("is_dst", cal.is_dst(F.col("datetime"))), "datetime")


@query("regime_flags", """
    SELECT o_orderkey, o_orderdate BETWEEN TIMESTAMP '1997-03-18' AND TIMESTAMP '1998-06-30' AS is_sah,
           o_orderdate < TIMESTAMP '1997-03-18' AS precovid, o_orderdate > TIMESTAMP '1998-06-30' AS postcovid FROM orders""")
def regime_flags(spark, d):
    flags = cal.regime(F.col("o_orderdate"), "1997-03-18 00:00:00", "1998-06-30 00:00:00")
    return c.table(spark, d, "orders").select("o_orderkey", *[v.alias(k) for k, v in flags.items()])


@query("weekend_flag", f"SELECT o_orderkey, isodow({_DATE}) >= 6 AS weekend FROM orders")
def weekend_flag(spark, d):
    return c.order_dates(spark, d).select("o_orderkey", cal.weekend(F.col("date")).alias("weekend"))


@query("cyclic_encode", """
    SELECT event_id, round(cos(2 * pi() / 23 * hour(ts)), 6) + 0.0 AS hour_cos, round(sin(2 * pi() / 23 * hour(ts)), 6) + 0.0 AS hour_sin,
           round(cos(2 * pi() / 11 * month(ts)), 6) + 0.0 AS month_cos, round(sin(2 * pi() / 11 * month(ts)), 6) + 0.0 AS month_sin,
           round(cos(2 * pi() / 24 * hour(ts)), 6) + 0.0 AS true_cos FROM events""")
def cyclic_encode(spark, d):
    hour, month = F.hour("ts"), F.month("ts")
    hour_cos, hour_sin = cal.cyclic(hour, 0, 23)
    month_cos, month_sin = cal.cyclic(month, 1, 12)
    true_cos, _ = cal.cyclic(hour, 0, 23, period=24)
    columns = {"hour_cos": hour_cos, "hour_sin": hour_sin, "month_cos": month_cos, "month_sin": month_sin, "true_cos": true_cos}
    return c.table(spark, d, "events").select("event_id", *[(F.round(v, 6) + 0.0).alias(k) for k, v in columns.items()])


@query("dow_number", f"SELECT o_orderkey, CAST(isodow({_DATE}) AS INTEGER) AS dow_num FROM orders")
def dow_number(spark, d):
    return c.order_dates(spark, d).select("o_orderkey", cal.dow_number(F.col("date")).alias("dow_num"))


@query("season_number", f"""
    SELECT o_orderkey, CASE WHEN month({_DATE}) IN (6, 7, 8, 9) THEN 1 WHEN month({_DATE}) IN (5, 10) THEN 2
           WHEN month({_DATE}) IN (4, 11) THEN 3 ELSE 4 END AS season_num FROM orders""")
def season_number(spark, d):
    return c.order_dates(spark, d).select("o_orderkey", cal.season_number(F.month("date")).alias("season_num"))


@query("holiday_flag", f"SELECT o_orderkey, {_HOLIDAY.format(d=_DATE)} AS holiday FROM orders")
def holiday_flag(spark, d):
    return c.order_dates(spark, d).select("o_orderkey", cal.holiday(F.col("date")).alias("holiday"))


@query("weather_codes", sql(f"""
    SELECT zone, time, weathercode, weathercode IN {codes(RAIN_CODES)} AS rain,
           weathercode IN {codes(SNOW_CODES)} AS snow FROM weather_hourly""", "weather_hourly"))
def weather_codes(spark, d):
    code = F.col("weathercode")
    return c.weather_hourly(spark, d).select(
        "zone", "time", "weathercode", weather.rain_flag(code).alias("rain"), weather.snow_flag(code).alias("snow"))


@query("pressure_convert", sql(f"SELECT zone, time, round(surface_pressure * {INHG_PER_HPA}, 6) AS pressure FROM weather_hourly", "weather_hourly"))
def pressure_convert(spark, d):
    return c.weather_hourly(spark, d).select("zone", "time", F.round(weather.to_inhg(F.col("surface_pressure")), 6).alias("pressure"))


@query("offset_from_abbrev", sql(f"""
    SELECT CAST(datetime AS VARCHAR) AS wall, abbreviation,
           CAST(timezone({_NY}, timezone('UTC', datetime + to_hours(CASE WHEN contains(abbreviation, 'S') THEN 5 ELSE 4 END))) AS VARCHAR) AS local
    FROM (SELECT datetime, CASE WHEN hour(datetime) < 12 THEN 'EST' ELSE 'EDT' END AS abbreviation FROM order_hours)""", "order_hours"))
def offset_from_abbrev(spark, d):
    hours = c.order_hours(spark, d).withColumn("abbreviation", F.when(F.hour("datetime") < 12, "EST").otherwise("EDT"))
    wall = F.col("datetime").cast("string")
    local = weather.document_time_to_local(wall, F.col("abbreviation"))
    return hours.select(wall.alias("wall"), "abbreviation", local.cast("string").alias("local"))


@query("null_flag_cast", sql("""
    SELECT s.zone, CAST(s.datetime AS VARCHAR) AS datetime, coalesce(rain, true) AS rain, coalesce(snow, true) AS snow
    FROM spine s LEFT JOIN weather w ON s.zone = w.zone AND s.datetime = w.datetime""", "spine", "weather"))
def null_flag_cast(spark, d):
    rows = weather.fill_missing_flags(c.calendar_weather(spark, d), "rain", "snow", missing_as_true=True)
    return c.as_text(rows, "datetime").select("zone", "datetime", "rain", "snow")


@query("timestamp_from_parts", sql("SELECT zone, CAST(date AS VARCHAR) AS date, hour, CAST(ds AS VARCHAR) AS ds FROM load_hourly", "load_hourly"))
def timestamp_from_parts(spark, d):
    rows = c.readings(spark, d).select("zone", "date", "hour").distinct()
    return c.as_text(rows.withColumn("ds", cal.wall_hour(F.col("date"), F.col("hour"))), "date", "ds")


@query("parse_timestamp", """
    SELECT event_id, CAST(strptime(strftime(ts, '%m/%d/%Y %H:%M:%S'), '%m/%d/%Y %H:%M:%S') AS VARCHAR) AS ds FROM events""")
def parse_timestamp(spark, d):
    day = F.col("ts").cast("date")
    clock = F.substring(F.col("ts").cast("string"), 12, 8)
    text = F.concat(F.date_format(day, "MM/dd/yyyy"), F.lit(" "), clock)
    return c.as_text(c.table(spark, d, "events").select("event_id", cal.parse_wall_time(text, "MM/dd/yyyy HH:mm:ss").alias("ds")), "ds")


@query("format_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date_text FROM orders")
def format_date(spark, d):
    return c.order_dates(spark, d).select("o_orderkey", cal.format_date(F.col("date")).alias("date_text"))


@query("tomorrow", f"SELECT o_orderkey, CAST({_DATE} + 1 AS VARCHAR) AS target_day FROM orders")
def tomorrow(spark, d):
    return c.as_text(c.order_dates(spark, d).select("o_orderkey", cal.next_day(F.col("date")).alias("target_day")), "target_day")


@query("pct_of_record", sql("""
    SELECT z.zone, CAST(z.date AS VARCHAR) AS date, round(z.mw_max / d.hist_peak_mw, 6) AS pct, round_even(z.mw_max / d.hist_peak_mw * 100, 2) AS percent
    FROM zone_peaks z JOIN zone_dim d ON z.zone = d.zone""", "zone_peaks", "zone_dim"))
def pct_of_record(spark, d):
    hourly, dim = c.forecast_parts(spark, d)
    rows = peaks.zone_peaks(hourly, c.BY_DAY).join(dim, "zone")
    peak, record = F.col("mw_max"), F.col("hist_peak_mw")
    return c.as_text(rows, "date").select(
        "zone", "date", F.round(display.ratio(peak, record), 6).alias("pct"), display.pct_of_record(peak, record).alias("percent"))


@query("round_half_even", sql("SELECT zone, CAST(ds AS VARCHAR) AS ds, round_even(temp, 0) AS whole, round_even(temp * 2, 0) AS halves FROM load_hourly", "load_hourly"))
def round_half_even(spark, d):
    return c.as_text(c.load_hourly(spark, d), "ds").select(
        "zone", "ds", display.round_half_even(F.col("temp")).alias("whole"), display.round_half_even(F.col("temp") * 2).alias("halves"))


@query("location_pair", sql("SELECT zone, lat AS first, long AS second FROM zone_dim", "zone_dim"))
def location_pair(spark, d):
    pairs = c.forecast_parts(spark, d)[1].select("zone", display.location().alias("place"))
    return pairs.select("zone", F.col("place.lat").alias("first"), F.col("place.long").alias("second"))
