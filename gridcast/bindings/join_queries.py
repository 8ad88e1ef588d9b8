"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast import schemas
from gridcast.bindings import common as c
from gridcast.bindings.common import query, sql
from gridcast.operators import joins, nearest, peaks
from gridcast.plans.day_ahead import hourly_table, peak_table, system_table
from gridcast.session import scratch_path
from gridcast.sources import delimited


@query("calendar_weather_left", sql("""
    SELECT s.zone, CAST(s.datetime AS VARCHAR) AS datetime, coalesce(temp, -999) AS temp, coalesce(rh, -999) AS rh,
           coalesce(CAST(rain AS INTEGER), -1) AS rain, coalesce(CAST(snow AS INTEGER), -1) AS snow
    FROM spine s LEFT JOIN weather w ON s.zone = w.zone AND s.datetime = w.datetime""", "spine", "weather"))
def calendar_weather_left(spark, d):
    rows = c.as_text(c.calendar_weather(spark, d), "datetime")
    flags = {f: F.coalesce(F.col(f).cast("int"), F.lit(-1)) for f in ("rain", "snow")}
    return c.filled(rows.withColumns(flags), -999.0, "temp", "rh").select("zone", "datetime", "temp", "rh", "rain", "snow")


@query("peak_vs_history", sql("""
    SELECT zone, CAST(date AS VARCHAR) AS date, peak_hour, peak_hour_mw, hist_peak_mw,
           round(pct_hist_peak_mw, 6) AS pct_hist_peak_mw FROM peak_table""", "peak_table"))
def peak_vs_history(spark, d):
    return c.rounded(c.as_text(peak_table(*c.forecast_parts(spark, d), c.BY_DAY), "date"), 6, "pct_hist_peak_mw")


@query("zone_enrich_inner", sql("""
    SELECT f.zone, CAST(ds AS VARCHAR) AS ds, mw, temp, lat, long, full_zone_name, hist_peak_mw
    FROM load_hourly f JOIN zone_dim d ON f.zone = d.zone""", "zone_dim"))
def zone_enrich_inner(spark, d):
    hourly, dim = c.forecast_parts(spark, d)
    # The dimension as a file: its size is known before the join is planned, so the fact side stays where it is.
    rows = joins.zone_enrich(hourly, c.stored_zone_dim(spark, dim))
    return c.as_text(rows, "ds").drop("date", "hour")


@query("zone_peak_join", sql("""
    SELECT f.zone, CAST(f.ds AS VARCHAR) AS ds, f.mw, p.mw_max, p.h_max
    FROM load_hourly f JOIN zone_peaks p ON f.zone = p.zone AND f.date = p.date""", "zone_peaks"))
def zone_peak_join(spark, d):
    hourly = c.stored_hourly(spark, d)
    rows = hourly.join(peaks.zone_peaks(hourly, c.BY_DAY), ["zone", "date"])
    return c.as_text(rows, "ds").select("zone", "ds", "mw", "mw_max", "h_max")


@query("load_at_system_peak", sql("""
    SELECT f.zone, CAST(f.date AS VARCHAR) AS date, f.mw AS mw_sys
    FROM load_hourly f JOIN system_peak p ON f.date = p.date AND f.hour = p.peak_hour""", "system_peak"))
def load_at_system_peak(spark, d):
    return c.as_text(peaks.load_at_system_peak(c.stored_hourly(spark, d), c.BY_DAY), "date")


@query("known_zones_semi", sql("""
    SELECT event_id, event_type AS zone, value FROM events
    WHERE event_type IN (SELECT zone FROM zone_dim WHERE zone <> 'error')""", "zone_dim"))
def known_zones_semi(spark, d):
    known = c.stored_zone_dim(spark, c.forecast_parts(spark, d)[1]).filter("zone <> 'error'")
    return joins.known_zones(c.readings(spark, d).select("zone", "event_id", "value"), known)


@query("nearest_zone", """
    WITH points AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS lat, CAST(embedding[2] AS DOUBLE) AS long, label FROM embeddings),
    sites AS (SELECT label, CAST(label AS VARCHAR) AS zone, round(avg(lat), 6) AS lat, round(avg(long), 6) AS long FROM points GROUP BY label)
    SELECT vec_id, arg_min(s.zone, (abs(p.lat - s.lat) + abs(p.long - s.long), s.label)) AS zone,
           round(min(abs(p.lat - s.lat) + abs(p.long - s.long)), 6) AS distance
    FROM points p, sites s GROUP BY vec_id""")
def nearest_zone(spark, d):
    points = c.table(spark, d, "embeddings").select(
        "vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("lat"), F.get("embedding", F.lit(1)).cast("double").alias("long"))
    sites = points.groupBy("label").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("long"), 6).alias("long")).select(
        F.col("label").alias("site_order"), F.col("label").cast("string").alias("zone"), "lat", "long")
    return c.rounded(nearest.nearest_zone(points.select("vec_id", "lat", "long"), sites, "vec_id"), 6, "distance")


@query("nearest_site", """
    WITH points AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS lat, CAST(embedding[2] AS DOUBLE) AS long FROM embeddings)
    SELECT p.vec_id, arg_min(s.vec_id, (abs(p.lat - s.lat) + abs(p.long - s.long), s.vec_id)) AS site, round(min(abs(p.lat - s.lat) + abs(p.long - s.long)), 6) AS distance
    FROM points p JOIN points s ON p.vec_id % 10 = 0 AND s.vec_id % 10 <> 0 GROUP BY p.vec_id""")
def nearest_site(spark, d):
    """The same with very many sites: nine tenths of the vectors."""
    places = c.table(spark, d, "embeddings").select(
        "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("lat"), F.get("embedding", F.lit(1)).cast("double").alias("long"))
    sites = places.filter("vec_id % 10 <> 0").selectExpr("vec_id AS site_order", "CAST(vec_id AS STRING) AS zone", "lat", "long")
    found = nearest.nearest_zone(places.filter("vec_id % 10 = 0"), sites, "vec_id")
    return c.rounded(found.select("vec_id", F.col("zone").cast("long").alias("site"), "distance"), 6, "distance")


@query("relationship_star", sql("""
    SELECT d.zone, d.full_zone_name, CAST(f.date AS VARCHAR) AS date, f.hour, f.mw AS hourly_mw, s.mw AS system_mw, q.peak_hour,
           coalesce(p.peak_hour_mw, -1) AS zone_peak_mw, round(coalesce(p.pct_hist_peak_mw, -1), 6) AS zone_pct
    FROM zone_dim d LEFT JOIN load_hourly f ON d.zone = f.zone LEFT JOIN system_hourly s ON f.date = s.date AND f.hour = s.hour
    LEFT JOIN system_peak q ON f.date = q.date LEFT JOIN peak_table p ON d.zone = p.zone AND f.date = p.date""", "peak_table"))
def relationship_star(spark, d):
    hourly, dim = c.forecast_parts(spark, d)
    rows = joins.relationship_star(
        dim, hourly_table(hourly, c.BY_DAY), system_table(hourly, c.BY_DAY), peak_table(hourly, dim, c.BY_DAY), c.BY_DAY)
    shown = c.filled(c.as_text(rows, "date"), -1.0, "zone_peak_mw", "zone_pct")
    return c.rounded(c.rounded(shown, 6, "zone_pct"), 4, "system_mw").select(
        "zone", "full_zone_name", "date", "hour", "hourly_mw", "system_mw", "peak_hour", "zone_peak_mw", "zone_pct")


@query("zone_lookup_first", sql("""
    SELECT d.zone, arg_min(e.value, e.event_id) AS first_value, arg_min(e.user_id, e.event_id) AS first_user
    FROM zone_dim d LEFT JOIN events e ON d.zone = e.event_type GROUP BY d.zone""", "zone_dim"))
def zone_lookup_first(spark, d):
    zones = c.forecast_parts(spark, d)[1].select("zone")
    lookup = c.table(spark, d, "events").select(
        F.col("event_type").alias("zone"), "event_id", F.col("value").alias("first_value"), F.col("user_id").alias("first_user"))
    return joins.zone_lookup(zones, lookup, F.col("event_id"), "first_value", "first_user")


@query("zone_lookup_file_order", sql("""
    SELECT d.zone, arg_min(e.value, e.event_id) AS first_value, arg_min(e.user_id, e.event_id) AS first_user
    FROM zone_dim d LEFT JOIN events e ON d.zone = e.event_type GROUP BY d.zone""", "zone_dim"))
def zone_lookup_file_order(spark, d):
    """The first row of a zone as it stands in text files that hold no number to order by."""
    path = scratch_path(spark, "lookup")
    ordered = c.table(spark, d, "events").sort("event_id")
    delimited.write_delimited(ordered.selectExpr("event_type AS zone", "value AS first_value", "user_id AS first_user"), path)
    lookup = joins.in_file_order(delimited.read_delimited(spark, path, schemas.LOOKUP))
    zones = c.forecast_parts(spark, d)[1].select("zone")
    return joins.zone_lookup(zones, lookup, F.col("position"), "first_value", "first_user")


@query("zone_hour_cross", sql("SELECT zone, CAST(datetime AS VARCHAR) AS datetime FROM spine", "spine"))
def zone_hour_cross(spark, d):
    return c.as_text(c.hours_of(c.zone_days(spark, d)), "datetime")


@query("attach_scalar", sql("""
    SELECT hour, mw AS system_mw, (SELECT arg_max(hour, (mw, -hour)) FROM totals) AS peak_hour FROM totals""", "load_hourly",
    extra={"totals": "SELECT hour, round(sum(mw), 4) AS mw FROM load_hourly GROUP BY hour"}))
def attach_scalar(spark, d):
    return c.rounded(system_table(c.stored_hourly(spark, d)), 4, "system_mw")
