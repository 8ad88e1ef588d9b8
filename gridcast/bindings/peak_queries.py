"""Totals, peaks, windows and sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.bindings import common as c
from gridcast.bindings.common import query, sql
from gridcast.functions import display
from gridcast.functions.calendar import truncate_hour
from gridcast.operators import peaks, sheets, windows
from gridcast.operators.selection import zone_subset
from gridcast.plans.day_ahead import day_ahead_tables, hourly_table, peak_table, system_table
from gridcast.plans.dashboard import zone_dashboard

_IN = c.sql_list(c.SELECTED)


@query("system_hourly", sql("SELECT CAST(date AS VARCHAR) AS date, hour, mw FROM system_hourly", "system_hourly"))
def system_hourly(spark, d):
    return c.rounded(c.as_text(peaks.hourly_total(c.load_hourly(spark, d), c.BY_DAY), "date"), 4, "mw")


@query("subset_hourly", sql(f"""
    SELECT CAST(date AS VARCHAR) AS date, hour, round(sum(mw), 4) AS mw FROM load_hourly WHERE zone IN {_IN} GROUP BY date, hour""", "load_hourly"))
def subset_hourly(spark, d):
    hourly, dim = c.forecast_parts(spark, d)
    chosen = zone_subset(hourly, c.selection_table(c.stored_zone_dim(spark, dim)))
    return c.rounded(c.as_text(peaks.hourly_total(chosen, c.BY_DAY), "date"), 4, "mw")


@query("history_hourly", """
    SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS ds, event_type AS zone, round(sum(value), 4) AS mw FROM events GROUP BY ALL""")
def history_hourly(spark, d):
    raw = c.table(spark, d, "events").select(
        truncate_hour(F.col("ts")).alias("ds"), F.col("event_type").alias("zone"), F.col("value").alias("mw"))
    return c.rounded(c.as_text(peaks.history_hourly(raw), "ds"), 4, "mw")


@query("zone_peak", sql("SELECT zone, CAST(date AS VARCHAR) AS date, mw_max FROM zone_peaks", "zone_peaks"))
def zone_peak(spark, d):
    return c.as_text(peaks.zone_peaks(c.load_hourly(spark, d), c.BY_DAY), "date").drop("h_max")


@query("zone_peak_hour", sql("SELECT zone, CAST(date AS VARCHAR) AS date, h_max FROM zone_peaks", "zone_peaks"))
def zone_peak_hour(spark, d):
    return c.as_text(peaks.zone_peaks(c.load_hourly(spark, d), c.BY_DAY), "date").drop("mw_max")


@query("avg_temp_hourly", sql(f"""
    SELECT 'all' AS chosen, hour, round_even(avg(temp), 2) AS temp FROM load_hourly GROUP BY hour
    UNION ALL SELECT 'selected', hour, round_even(avg(temp), 2) FROM load_hourly WHERE zone IN {_IN} GROUP BY hour""", "load_hourly"))
def avg_temp_hourly(spark, d):
    hourly = c.stored_hourly(spark, d)
    everything = peaks.avg_temp_hourly(hourly).withColumn("chosen", F.lit("all"))
    return everything.unionByName(
        peaks.avg_temp_hourly(zone_subset(hourly, c.SELECTED)).withColumn("chosen", F.lit("selected")))


@query("system_peak", sql("SELECT CAST(date AS VARCHAR) AS date, peak_mw, peak_hour FROM system_peak", "system_peak"))
def system_peak(spark, d):
    rows = peaks.system_peak(peaks.hourly_total(c.load_hourly(spark, d), c.BY_DAY), c.BY_DAY)
    return c.rounded(c.as_text(rows, "date"), 4, "peak_mw")


@query("subset_peak", sql(f"""
    SELECT CAST(date AS VARCHAR) AS date, max(mw) AS peak_mw, arg_max(hour, (mw, -hour)) AS peak_hour
    FROM (SELECT date, hour, round(sum(mw), 4) AS mw FROM load_hourly WHERE zone IN {_IN} GROUP BY date, hour) GROUP BY date""", "load_hourly"))
def subset_peak(spark, d):
    hourly, dim = c.forecast_parts(spark, d)
    stored = c.stored_zone_dim(spark, dim)
    rows = peaks.subset_peak(hourly, c.selection_table(stored), stored, c.BY_DAY)
    return c.rounded(c.as_text(rows, "date"), 4, "peak_mw")


@query("lag_one", sql("""
    SELECT zone, CAST(ds AS VARCHAR) AS ds, mw, temp, coalesce(lag(mw) OVER w, -1) AS previous_mw, coalesce(lag(temp) OVER w, -1) AS previous_temp
    FROM load_hourly WINDOW w AS (PARTITION BY zone ORDER BY ds)""", "load_hourly"))
def lag_one(spark, d):
    rows = windows.lag_one(c.stored_hourly(spark, d).select("zone", "ds", "mw", "temp"))
    return c.filled(c.as_text(rows, "ds"), -1.0, "previous_mw", "previous_temp")


@query("lag_features", sql("""
    SELECT * FROM (SELECT zone, CAST(ds AS VARCHAR) AS ds, mw, temp, lag(mw, 48) OVER w AS previous_mw, lag(temp, 24) OVER w AS previous_temp
    FROM load_hourly WINDOW w AS (PARTITION BY zone ORDER BY load_hourly.ds)) WHERE previous_mw IS NOT NULL AND previous_temp IS NOT NULL""", "load_hourly"))
def lag_features(spark, d):
    return c.as_text(windows.lag_features(c.stored_hourly(spark, d).select("zone", "ds", "mw", "temp")), "ds")


@query("hour_delta", sql(f"""
    SELECT chosen, CAST(date AS VARCHAR) AS date, hour, mw, round(coalesce(CASE WHEN lag(hour) OVER w = hour - 1
           THEN mw - lag(mw) OVER w END, -99999), 4) AS delta_mw
    FROM (SELECT 'all' AS chosen, * FROM system_hourly UNION ALL
          SELECT 'selected', date, hour, round(sum(mw), 4) FROM load_hourly WHERE zone IN {_IN} GROUP BY date, hour)
    WINDOW w AS (PARTITION BY chosen, date ORDER BY hour)""", "system_hourly"))
def hour_delta(spark, d):
    hourly = c.stored_hourly(spark, d)

    def deltas(name, rows):
        return windows.hour_delta(peaks.hourly_total(rows, c.BY_DAY), c.BY_DAY).withColumn("chosen", F.lit(name))

    both = deltas("all", hourly).unionByName(deltas("selected", zone_subset(hourly, c.SELECTED)))
    return c.rounded(c.as_text(c.filled(both, -99999.0, "delta_mw"), "date"), 4, "mw", "delta_mw")


@query("table_calc_difference", sql("""
    SELECT zone, hour, total, round(coalesce(total - lag(total) OVER (PARTITION BY zone ORDER BY hour), -99999), 4) AS difference
    FROM (SELECT zone, hour, round(sum(mw), 4) AS total FROM load_hourly GROUP BY zone, hour)""", "load_hourly"))
def table_calc_difference(spark, d):
    rows = windows.table_calc_difference(hourly_table(c.load_hourly(spark, d)))
    return c.rounded(c.filled(rows, -99999.0, "difference"), 4, "total", "difference")


@query("minmax_scale", sql("""
    SELECT zone, mw_max, CAST(trunc((mw_max - (SELECT min(mw_max) FROM m)) / (SELECT nullif(max(mw_max) - min(mw_max), 0) FROM m) * 40 + 10) AS INTEGER) AS radius
    FROM m""", "load_hourly", extra={"m": "SELECT zone, max(mw) AS mw_max FROM load_hourly GROUP BY zone"}))
def minmax_scale(spark, d):
    rows = peaks.minmax_scale(peaks.zone_peaks(c.stored_hourly(spark, d)), "mw_max", "radius")
    return rows.select("zone", "mw_max", F.col("radius").cast("int").alias("radius"))


@query("attr_aggregate", """
    SELECT o_custkey, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) ELSE '*' END AS status
    FROM orders GROUP BY o_custkey""")
def attr_aggregate(spark, d):
    return c.table(spark, d, "orders").groupBy("o_custkey").agg(F.coalesce(sheets.attr("o_orderstatus"), F.lit("*")).alias("status"))


@query("map_sheet", sql("""
    SELECT d.zone, d.full_zone_name, d.lat, d.long, CAST(p.date AS VARCHAR) AS date, min(peak_hour_mw) AS attr_peak_hour_mw,
           round(sum(peak_hour_mw), 4) AS sum_peak_hour_mw, round(avg(pct_hist_peak_mw), 6) AS avg_pct_hist_peak_mw
    FROM zone_dim d LEFT JOIN peak_table p ON d.zone = p.zone GROUP BY ALL""", "peak_table"))
def map_sheet(spark, d):
    hourly, dim = c.forecast_parts(spark, d)
    rows = c.as_text(sheets.map_sheet(dim, peak_table(hourly, dim, c.BY_DAY), c.BY_DAY), "date")
    return c.rounded(c.rounded(rows, 4, "sum_peak_hour_mw"), 6, "avg_pct_hist_peak_mw")


@query("system_info_sheet", sql("""
    SELECT d.zone, d.full_zone_name, f.hour, round(f.mw, 4) AS sum_hourly_mw, round(p.avg_peak_hour, 6) AS avg_peak_hour
    FROM zone_dim d LEFT JOIN (SELECT zone, hour, sum(mw) AS mw FROM load_hourly GROUP BY zone, hour) f ON d.zone = f.zone
    LEFT JOIN (SELECT zone, avg(peak_hour) AS avg_peak_hour FROM peak_table GROUP BY zone) p ON d.zone = p.zone""", "peak_table"))
def system_info_sheet(spark, d):
    hourly, dim = c.forecast_parts(spark, d)
    rows = sheets.system_info_sheet(dim, hourly_table(hourly), peak_table(hourly, dim, c.BY_DAY))
    return c.rounded(c.rounded(rows, 4, "sum_hourly_mw"), 6, "avg_peak_hour")


@query("title_sheet", sql("""
    SELECT CAST(s.date AS VARCHAR) AS date, max(s.mw) AS max_system_mw, avg(p.peak_hour) AS avg_peak_hour
    FROM system_hourly s JOIN system_peak p ON s.date = p.date GROUP BY s.date""", "system_peak"))
def title_sheet(spark, d):
    return c.rounded(c.as_text(sheets.title_sheet(system_table(c.load_hourly(spark, d), c.BY_DAY)), "date"), 4, "max_system_mw")


@query("zone_detail_sheet", sql("""
    SELECT hour, round(sum(mw), 4) AS sum_hourly_mw, round(avg(temp), 8) AS avg_temp, 'click' AS attr_zone, 'Zone, click' AS attr_full_zone_name
    FROM load_hourly WHERE zone = 'click' GROUP BY hour""", "load_hourly"))
def zone_detail_sheet(spark, d):
    hourly, dim = c.forecast_parts(spark, d)
    stored = c.stored_zone_dim(spark, dim)
    members = stored.filter(F.col("zone") == "click")
    rows = sheets.zone_detail_sheet(stored, hourly_table(hourly), members, ["full_zone_name", "lat", "long", "zone"])
    return c.rounded(c.rounded(rows, 4, "sum_hourly_mw"), 8, "avg_temp")


@query("day_ahead_tables", sql("""
    SELECT zone, CAST(date AS VARCHAR) AS date, peak_hour, peak_hour_mw, hist_peak_mw, round(pct_hist_peak_mw, 6) AS pct_hist_peak_mw
    FROM peak_table""", "peak_table"))
def day_ahead(spark, d):
    tables = day_ahead_tables(*c.forecast_parts(spark, d), c.BY_DAY)
    return c.rounded(c.as_text(tables.peak, "date"), 6, "pct_hist_peak_mw")


_DASHBOARD = f"""
    SELECT f.zone, CAST(f.date AS VARCHAR) AS date, round(f.mw, 2) AS mw, f.temp, d.lat, d.long, d.full_zone_name, d.hist_peak_mw,
           z.mw_max, z.h_max, s.mw AS mw_sys, q.peak_hour AS system_hour, round(z.mw_max / d.hist_peak_mw, 6) AS pct,
           coalesce(CAST(trunc((z.mw_max - min(z.mw_max) OVER w) / nullif(max(z.mw_max) OVER w - min(z.mw_max) OVER w, 0) * 40 + 10) AS INTEGER), -1) AS radius,
           row_number() OVER (PARTITION BY f.date ORDER BY z.mw_max DESC, f.zone) <= 3 AS in_top, f.zone IN {_IN} AS selected,
           f.mw AS exact_mw
    FROM load_hourly f JOIN zone_dim d ON f.zone = d.zone JOIN zone_peaks z ON f.zone = z.zone AND f.date = z.date
    JOIN system_peak q ON f.date = q.date JOIN load_hourly s ON s.zone = f.zone AND s.date = f.date AND s.hour = q.peak_hour
    WHERE f.hour = 18 WINDOW w AS (PARTITION BY f.date)"""
_VIEWS = ("zone_peaks", "system_peak", "zone_dim")
_WHOLE = "format('{{:,}}', CAST(round_even({0}, 0) AS BIGINT))"


def _dashboard(spark, d):
    return zone_dashboard(*c.forecast_parts(spark, d), hour=18, selection=c.SELECTED, top=3)


@query("zone_dashboard", sql("SELECT * EXCLUDE (exact_mw) FROM board", *_VIEWS, extra={"board": _DASHBOARD}))
def dashboard(spark, d):
    rows = _dashboard(spark, d).drop("label").withColumn("radius", F.coalesce("radius", F.lit(-1)))
    return c.rounded(c.as_text(rows, "date"), 6, "pct")


@query("zone_label_text", sql(f"""
    SELECT zone, date, full_zone_name || '(' || zone || ')' || chr(10) || 'Peak Load (' || h_max || 'H): ' || {_WHOLE.format('mw_max')}
        || chr(10) || 'Load when system peak (' || system_hour || 'H): ' || {_WHOLE.format('mw_sys')}
        || chr(10) || '% of historical peak: ' || CAST(round_even(mw_max / hist_peak_mw * 100, 2) AS VARCHAR) || '%'
        || chr(10) || 'Realtime Load (18H): ' || {_WHOLE.format('exact_mw')}
        || chr(10) || 'Temperature (18H): ' || CAST(temp AS VARCHAR) AS label,
        zone || ' ' || {_WHOLE.format('mw_max')} AS marker, {_WHOLE.format('mw_sys')} || ' mw' AS load_card, system_hour || 'H' AS hour_card
    FROM board""", *_VIEWS, extra={"board": _DASHBOARD}))
def zone_label_text(spark, d):
    return c.as_text(_dashboard(spark, d), "date").select(
        "zone", "date", "label", display.marker_text(F.col("zone"), F.col("mw_max")).alias("marker"),
        display.megawatt_text(F.col("mw_sys")).alias("load_card"), display.hour_text(F.col("system_hour")).alias("hour_card"))
