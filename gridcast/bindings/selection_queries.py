"""Projections, filters, selections, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.bindings import common as c
from gridcast.bindings.common import query, sql
from gridcast.operators import joins, nearest, peaks, profile
from gridcast.operators import selection as sel

_IN = c.sql_list(c.SELECTED)
_HOURLY_OUT = "zone, CAST(ds AS VARCHAR) AS ds, mw, temp"
_MEASURES = ("temp", "precip", "rh", "pressure", "windspeed")


def _hourly_out(df):
    return c.as_text(df, "ds").select("zone", "ds", "mw", "temp")


_HOLIDAY = """(
    (isodow({d}) < 6 AND month({d}) * 100 + day({d}) IN (101, 704, 1111, 1225))
    OR (isodow({d}) = 5 AND month({d} + 1) * 100 + day({d} + 1) IN (101, 704, 1111, 1225))
    OR (isodow({d}) = 1 AND month({d} - 1) * 100 + day({d} - 1) IN (101, 704, 1111, 1225))
    OR ({d} >= DATE '2021-06-18' AND ((isodow({d}) < 6 AND month({d}) = 6 AND day({d}) = 19)
        OR (isodow({d}) = 5 AND month({d}) = 6 AND day({d}) = 18) OR (isodow({d}) = 1 AND month({d}) = 6 AND day({d}) = 20)))
    OR (isodow({d}) = 1 AND (month({d}) IN (1, 2) AND day({d}) BETWEEN 15 AND 21 OR month({d}) = 5 AND day({d}) >= 25
        OR month({d}) = 9 AND day({d}) <= 7 OR month({d}) = 10 AND day({d}) BETWEEN 8 AND 14))
    OR (isodow({d}) = 4 AND month({d}) = 11 AND day({d}) BETWEEN 22 AND 28))"""


@query("feature_projection", sql(f"""
    SELECT s.zone, CAST(s.datetime AS VARCHAR) AS datetime, CAST(CAST(s.datetime AS DATE) AS VARCHAR) AS date,
        CAST(hour(s.datetime) AS INTEGER) AS hour, CAST(year(s.datetime) AS INTEGER) AS year,
        isodow(s.datetime) >= 6 AS weekend, {_HOLIDAY.format(d='CAST(s.datetime AS DATE)')} AS holiday,
        is_dst, s.datetime BETWEEN TIMESTAMP '2020-03-18' AND TIMESTAMP '2020-06-30' AS is_sah,
        s.datetime < TIMESTAMP '2020-03-18' AS precovid, s.datetime > TIMESTAMP '2020-06-30' AS postcovid,
        coalesce(temp, -999) AS temp, coalesce(precip, -999) AS precip, coalesce(rh, -999) AS rh,
        round(coalesce(pressure, -999), 6) AS pressure, coalesce(windspeed, -999) AS windspeed,
        coalesce(rain, true) AS rain, coalesce(snow, true) AS snow, 1 AS recent,
        round(cos(2 * pi() / 23 * hour(s.datetime)), 6) + 0.0 AS hour_cos, round(sin(2 * pi() / 23 * hour(s.datetime)), 6) + 0.0 AS hour_sin,
        round(cos(2 * pi() / 11 * month(s.datetime)), 6) + 0.0 AS month_cos, round(sin(2 * pi() / 11 * month(s.datetime)), 6) + 0.0 AS month_sin,
        CAST(isodow(s.datetime) AS INTEGER) AS dow_num,
        CASE WHEN month(s.datetime) IN (6, 7, 8, 9) THEN 1 WHEN month(s.datetime) IN (5, 10) THEN 2
             WHEN month(s.datetime) IN (4, 11) THEN 3 ELSE 4 END AS season_num
    FROM real_spine s LEFT JOIN weather w ON s.zone = w.zone AND s.datetime = w.datetime""", "real_spine", "weather"))
def feature_projection(spark, d):
    frame = c.features(spark, d, season=True, missing_flags_as_true=True)
    shown = c.filled(c.as_text(frame, "datetime", "date"), -999.0, *_MEASURES)
    # Adding zero turns a negative zero into a positive one.
    circular = {x: F.col(x) + 0.0 for x in ("hour_cos", "hour_sin", "month_cos", "month_sin")}
    return c.rounded(shown, 6, "pressure", *circular).withColumns(circular)


@query("weather_rename", sql("""
    SELECT zone, CAST(datetime AS VARCHAR) AS datetime, temp, rh, precip, round(pressure, 6) AS pressure, windspeed, rain, snow
    FROM weather""", "weather"))
def weather_rename(spark, d):
    return c.rounded(c.as_text(c.weather(spark, d), "datetime"), 6, "pressure")


@query("constant_columns", sql(f"SELECT {_HOURLY_OUT}, 1 AS recent, 'forecast' AS source FROM load_hourly", "load_hourly"))
def constant_columns(spark, d):
    return _hourly_out(c.load_hourly(spark, d)).withColumns({"recent": F.lit(1), "source": F.lit("forecast")})


@query("zone_subset", sql(f"SELECT {_HOURLY_OUT} FROM load_hourly WHERE zone IN {_IN}", "load_hourly"))
def zone_subset(spark, d):
    return _hourly_out(sel.zone_subset(c.load_hourly(spark, d), c.SELECTED))


@query("time_slice", sql("""
    SELECT f.zone, CAST(ds AS VARCHAR) AS ds, mw, temp, lat, long, full_zone_name, hist_peak_mw
    FROM load_hourly f JOIN zone_dim d ON f.zone = d.zone
    WHERE f.date = DATE '2024-01-16' AND f.hour = 18""", "zone_dim"))
def time_slice(spark, d):
    hourly, dim = c.forecast_parts(spark, d)
    rows = sel.time_slice(hourly, dim, "2024-01-16", 18)
    return c.as_text(rows, "ds").select("zone", "ds", "mw", "temp", "lat", "long", "full_zone_name", "hist_peak_mw")


@query("single_zone", sql(f"SELECT {_HOURLY_OUT} FROM load_hourly WHERE zone = 'click'", "load_hourly"))
def single_zone(spark, d):
    return _hourly_out(sel.single_zone(c.load_hourly(spark, d), "click"))


@query("drop_incomplete", sql("""
    SELECT s.zone, CAST(s.datetime AS VARCHAR) AS datetime, temp, round(pressure, 6) AS pressure, rain
    FROM spine s LEFT JOIN weather w ON s.zone = w.zone AND s.datetime = w.datetime
    WHERE temp IS NOT NULL AND pressure IS NOT NULL AND rain IS NOT NULL""", "spine", "weather"))
def drop_incomplete(spark, d):
    rows = sel.drop_incomplete(c.calendar_weather(spark, d).select("zone", "datetime", "temp", "pressure", "rain"))
    return c.rounded(c.as_text(rows, "datetime"), 6, "pressure")


@query("peak_hour_slice", sql("""
    SELECT f.zone, CAST(f.ds AS VARCHAR) AS ds, f.mw, f.temp
    FROM load_hourly f JOIN system_peak p ON f.date = p.date AND f.hour = p.peak_hour""", "system_peak"))
def peak_hour_slice(spark, d):
    hourly = c.stored_hourly(spark, d)
    peak = peaks.system_peak(peaks.hourly_total(hourly, c.BY_DAY), c.BY_DAY)
    return _hourly_out(peaks.peak_hour_slice(hourly, peak, c.BY_DAY))


@query("flag_split", sql("""
    SELECT CASE WHEN test = 0 THEN 'train' ELSE 'test' END AS part, zone, count(*) AS n, round(sum(mw), 2) AS mw
    FROM train GROUP BY ALL""", "train"))
def flag_split(spark, d):
    def summed(rows, part):
        return rows.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mw"), 2).alias("mw")).withColumn("part", F.lit(part))

    train, test = sel.flag_split(c.train(spark, d))
    return summed(train, "train").unionByName(summed(test, "test"))


@query("selected_flag", sql(f"""
    SELECT {_HOURLY_OUT}, CASE WHEN zone IN {_IN} THEN 'True' ELSE 'False' END AS selected FROM load_hourly""", "load_hourly"))
def selected_flag(spark, d):
    rows = sel.selected_flag(c.load_hourly(spark, d), c.SELECTED)
    return c.as_text(rows, "ds").select("zone", "ds", "mw", "temp", "selected")


@query("selection_or_all", sql(f"""
    SELECT 'some' AS chosen, hour, round(sum(mw), 4) AS mw FROM load_hourly WHERE zone IN {_IN} GROUP BY hour
    UNION ALL SELECT 'none', hour, round(sum(mw), 4) FROM load_hourly GROUP BY hour""", "load_hourly"))
def selection_or_all(spark, d):
    hourly, dim = c.forecast_parts(spark, d)
    stored = c.stored_zone_dim(spark, dim)

    def total(name, zones):
        rows = sel.selection_or_all(hourly, c.selection_table(stored, zones))
        return peaks.hourly_total(rows).select(F.lit(name).alias("chosen"), "hour", F.round("mw", 4).alias("mw"))

    return total("some", c.SELECTED).unionByName(total("none", ["no such zone"]))


@query("member_filter", sql(f"""
    SELECT zone, date::VARCHAR AS date, mw_max, h_max FROM zone_peaks WHERE zone IN {_IN}""", "zone_peaks"))
def member_filter(spark, d):
    hourly, dim = c.forecast_parts(spark, d)
    stored = c.stored_zone_dim(spark, dim)
    rows = peaks.zone_peaks(hourly, c.BY_DAY).join(stored, "zone")
    members = stored.filter(F.col("zone").isin(list(c.SELECTED)))
    kept = sel.member_filter(rows, members, ["full_zone_name", "lat", "long", "zone"])
    return c.as_text(kept, "date").select("zone", "date", "mw_max", "h_max")


@query("hour_set", sql(f"SELECT {_HOURLY_OUT}, hour IN (0, 3, 6, 9, 12, 15, 18, 21) AS in_set FROM load_hourly", "load_hourly"))
def hour_set(spark, d):
    rows = c.load_hourly(spark, d).withColumn("in_set", sel.in_hour_set(F.col("hour")))
    return c.as_text(rows, "ds").select("zone", "ds", "mw", "temp", "in_set")


@query("non_empty_check", sql("SELECT count(*) > 0 AS finished FROM events"))
def non_empty_check(spark, d):
    return sel.non_empty(c.table(spark, d, "events"))


@query("selection_state", sql(f"""
    SELECT 'none' AS chosen, 0::BIGINT AS n_selected, count(*) AS n_zones, 'empty' AS state FROM zone_dim
    UNION ALL SELECT 'some', (SELECT count(*) FROM zone_dim WHERE zone IN {_IN}), count(*), 'partial' FROM zone_dim
    UNION ALL SELECT 'all', count(*), count(*), 'all' FROM zone_dim""", "zone_dim"))
def selection_state(spark, d):
    dim = c.stored_zone_dim(spark, c.forecast_parts(spark, d)[1])
    chosen = {"none": dim.filter("zone is null"), "some": c.selection_table(dim), "all": dim.select("zone")}
    rows = [sel.selection_state(zones, dim).withColumn("chosen", F.lit(name)) for name, zones in chosen.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("toggle_selection", sql(f"""
    SELECT zone FROM (SELECT event_type AS zone FROM events UNION ALL SELECT DISTINCT event_type FROM events WHERE event_type IN {_IN})
    GROUP BY zone HAVING count(*) % 2 = 1"""))
def toggle_selection(spark, d):
    clicks = c.table(spark, d, "events").select(F.col("event_type").alias("zone"))
    return sel.toggle_selection(c.selection_table(clicks).distinct(), clicks)


@query("click_to_toggle", """
    WITH points AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS lat, CAST(embedding[2] AS DOUBLE) AS long, label FROM embeddings),
    sites AS (SELECT label, CAST(label AS VARCHAR) AS zone, round(avg(lat), 6) AS lat, round(avg(long), 6) AS long FROM points GROUP BY label),
    clicked AS (SELECT vec_id, arg_min(s.zone, (abs(p.lat - s.lat) + abs(p.long - s.long), s.label)) AS zone FROM points p, sites s GROUP BY vec_id)
    SELECT zone FROM (SELECT zone FROM clicked UNION ALL SELECT DISTINCT zone FROM sites WHERE zone IN ('1', '2', '3'))
    GROUP BY zone HAVING count(*) % 2 = 1""")
def click_to_toggle(spark, d):
    """Points that are clicked, the zone nearest to each, and what is selected after all of them."""
    points = c.table(spark, d, "embeddings").select(
        "vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("lat"), F.get("embedding", F.lit(1)).cast("double").alias("long"))
    sites = points.groupBy("label").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("long"), 6).alias("long")).select(
        F.col("label").alias("site_order"), F.col("label").cast("string").alias("zone"), "lat", "long")
    clicks = nearest.nearest_zone(points.select("vec_id", "lat", "long"), sites, "vec_id")
    return sel.toggle_selection(sites.filter(F.col("zone").isin("1", "2", "3")), clicks)


@query("sorted_zones", "SELECT DISTINCT event_type AS zone FROM events ORDER BY zone")
def sorted_zones(spark, d):
    return c.readings(spark, d).select("zone").distinct().orderBy("zone")


@query("top5_zones", """
    SELECT CAST(l_suppkey AS VARCHAR) AS zone, max(l_extendedprice) AS mw_max FROM lineitem
    GROUP BY l_suppkey ORDER BY mw_max DESC, CAST(l_suppkey AS VARCHAR) LIMIT 5""")
def top5_zones(spark, d):
    rows = c.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("zone"), F.col("l_extendedprice").alias("mw"))
    return peaks.top_zones(rows.groupBy("zone").agg(F.max("mw").alias("mw_max")))


@query("first_rows", """
    SELECT event_id, CAST(ts AS VARCHAR) AS ts, event_type AS zone, value AS mw FROM events ORDER BY event_id LIMIT 5""")
def first_rows(spark, d):
    rows = c.table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("zone"), F.col("value").alias("mw"))
    return c.as_text(sel.first_rows(rows, 5, "event_id"), "ts")


@query("distinct_zones", """
    SELECT event_type AS zone, min(event_id) AS first_seen FROM events GROUP BY event_type""")
def distinct_zones(spark, d):
    return profile.distinct_zones(c.readings(spark, d), "event_id")
