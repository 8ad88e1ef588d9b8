"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast import schemas
from gridcast.bindings import common as c
from gridcast.bindings.common import query, sql
from gridcast.functions import calendar as cal
from gridcast.operators import peaks
from gridcast.plans.day_ahead import day_ahead_tables
from gridcast.plans.memo import ResultStore
from gridcast.session import scratch_path
from gridcast.sources import delimited, quarantine
from gridcast.sources.weather_documents import explode_documents, weather_rows


@query("zone_dim_scan", sql("SELECT * FROM zone_dim", "zone_dim"))
def zone_dim_scan(spark, d):
    return c.stored_zone_dim(spark, c.forecast_parts(spark, d)[1])


@query("zone_peak_projection", sql("SELECT zone, hist_peak_mw FROM zone_dim", "zone_dim"))
def zone_peak_projection(spark, d):
    path = scratch_path(spark, "zone_dim")
    delimited.write_delimited(c.forecast_parts(spark, d)[1], path)
    return delimited.read_zone_peaks(spark, path)


@query("load_history", sql("""
    SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS ds, event_type AS zone, round(sum(value), 4) AS mw
    FROM events WHERE event_type <> 'error' GROUP BY ALL"""))
def load_history(spark, d):
    path = scratch_path(spark, "metered")
    raw = c.readings(spark, d)
    metered = raw.select(
        cal.wall_hour(F.col("date"), F.col("hour")).cast("string").alias("datetime_beginning_ept"), "zone", F.col("value").alias("mw")
    )
    delimited.write_delimited(metered, path)
    known = c.stored_zone_dim(spark, c.forecast_parts(spark, d)[1]).filter("zone <> 'error'")
    return c.rounded(c.as_text(delimited.load_history(spark, path, known), "ds"), 4, "mw")


@query("fallback_source", sql("""
    SELECT CAST(date AS VARCHAR) AS date, hour, zone, mw, temp,
           CAST((SELECT min(date) FROM load_hourly) AS VARCHAR) AS forecast_date
    FROM load_hourly""", "load_hourly"))
def fallback_source(spark, d):
    path = scratch_path(spark, "saved")
    saved = c.load_hourly(spark, d).select(F.col("hour").alias("index"), "date", "hour", "zone", "mw", "temp")
    delimited.write_delimited(saved, path)
    read = delimited.read_or_fallback(spark, scratch_path(spark, "absent"), path)
    return c.as_text(read.withColumn("forecast_date", delimited.forecast_date(read).scalar()), "date", "forecast_date")


@query("training_scan", sql("""
    SELECT l_orderkey, l_linenumber, zone, CAST(date AS VARCHAR) AS date, month, quantity, discount, tax, mw, test
    FROM train""", "train"))
def training_scan(spark, d):
    path = scratch_path(spark, "training")
    rows = c.train(spark, d)
    delimited.write_delimited(rows, path)
    return c.as_text(delimited.read_training(spark, path, rows.schema), "date")


@query("weather_json_explode", sql("""
    SELECT zone, 'EST' AS timezone_abbreviation, time, temperature_2m, relativehumidity_2m, precipitation, weathercode,
           surface_pressure, windspeed_10m FROM weather_hourly""", "weather_hourly"))
def weather_json_explode(spark, d):
    return explode_documents(c.landed_documents(spark, d)).drop("date")


@query("hour_spine", sql("SELECT CAST(datetime AS VARCHAR) AS datetime FROM order_hours", "order_hours"))
def hour_spine(spark, d):
    return c.as_text(c.order_hours(spark, d), "datetime")


_STACKED = """
    SELECT 'peak_hour_forecast' AS table_name, zone, CAST(date AS VARCHAR) AS date, -1 AS hour, -1.0::DOUBLE AS hourly_mw,
           -1.0::DOUBLE AS temp, -1.0::DOUBLE AS system_mw, peak_hour, peak_hour_mw, hist_peak_mw,
           round(pct_hist_peak_mw, 6) AS pct_hist_peak_mw
    FROM peak_table
    UNION ALL
    SELECT 'hourly_forecast', zone, CAST(date AS VARCHAR), hour, mw, temp, -1, -1, -1, -1, -1 FROM load_hourly
    UNION ALL
    SELECT 'system_hourly_forecast', '', CAST(s.date AS VARCHAR), s.hour, -1, -1, s.mw, p.peak_hour, -1, -1, -1
    FROM system_hourly s JOIN system_peak p ON s.date = p.date"""


def _stacked(tables):
    both = delimited.stack(*[
        df.withColumn("table_name", F.lit(name)) for name, df in tables.items()
    ])
    shown = c.as_text(both, "date").withColumns({
        "zone": F.coalesce("zone", F.lit("")),
        "hour": F.coalesce("hour", F.lit(-1)),
        "peak_hour": F.coalesce("peak_hour", F.lit(-1)),
    })
    numbers = ["hourly_mw", "temp", "system_mw", "peak_hour_mw", "hist_peak_mw", "pct_hist_peak_mw"]
    shown = c.filled(shown, -1.0, *numbers)
    return c.rounded(c.rounded(shown, 4, "system_mw"), 6, "pct_hist_peak_mw")


@query("day_ahead_write", sql(_STACKED, "peak_table"))
def day_ahead_write(spark, d):
    root = scratch_path(spark, "day_ahead")
    hourly, dim = c.forecast_parts(spark, d)
    delimited.write_tables(day_ahead_tables(hourly, dim, c.BY_DAY).as_dict(), root)
    return _stacked(delimited.read_tables(spark, root, c.declared_by_day()))


@query("forecast_export", sql("SELECT CAST(ds AS VARCHAR) AS ds, zone, temp, mw FROM load_hourly", "load_hourly"))
def forecast_export(spark, d):
    path = delimited.export_forecast(c.as_text(c.load_hourly(spark, d), "ds"), scratch_path(spark, "export"), "2024-01-31")
    return delimited.read_delimited(spark, path, "ds string, zone string, temp double, mw double")


@query("typed_text_tables", sql(
    _STACKED.replace("round(pct_hist_peak_mw, 6) AS pct_hist_peak_mw", "round(pct_hist_peak_mw, 6) AS pct_hist_peak_mw, -1.0::DOUBLE AS lat, '' AS full_zone_name")
    .replace("-1, -1, -1, -1, -1 FROM load_hourly", "-1, -1, -1, -1, -1, -1, '' FROM load_hourly")
    .replace("p.peak_hour, -1, -1, -1\n", "p.peak_hour, -1, -1, -1, -1, ''\n")
    + """ UNION ALL SELECT 'zone_mapping', zone, '', -1, -1, -1, -1, -1, -1, -1, -1, lat, full_zone_name FROM zone_dim""",
    "peak_table"))
def typed_text_tables(spark, d):
    root = scratch_path(spark, "typed")
    hourly, dim = c.forecast_parts(spark, d)
    mapping = dim.select("zone", "lat", "long", "full_zone_name")
    tables = {**day_ahead_tables(hourly, dim, c.BY_DAY).as_dict(), "zone_mapping": mapping}
    delimited.write_tables(tables, root)
    declared = {**c.declared_by_day(), "zone_mapping": schemas.ZONE_MAPPING}
    shown = _stacked(delimited.read_tables(spark, root, declared)).drop("long")
    return c.filled(shown, -1.0, "lat").withColumns({
        "full_zone_name": F.coalesce("full_zone_name", F.lit("")), "date": F.coalesce("date", F.lit("")),
    })


@query("extract_snapshot", sql("""
    SELECT 'peak_hour_forecast' AS table_name, count(*) AS n FROM peak_table
    UNION ALL SELECT 'hourly_forecast', count(*) FROM load_hourly
    UNION ALL SELECT 'system_hourly_forecast', count(*) FROM system_hourly
    UNION ALL SELECT 'total', (SELECT count(*) FROM peak_table) + (SELECT count(*) FROM load_hourly)
              + (SELECT count(*) FROM system_hourly)""", "peak_table"))
def extract_snapshot(spark, d):
    root = scratch_path(spark, "extract")
    hourly, dim = c.forecast_parts(spark, d)
    tables = day_ahead_tables(hourly, dim, c.BY_DAY).as_dict()
    delimited.write_extract(tables, root)
    return delimited.extract_counts(spark, root, c.declared_by_day())


@query("union_zones", sql("""
    SELECT zone, CAST(ds AS VARCHAR) AS ds, mw, temp FROM load_hourly
    UNION ALL
    SELECT o_orderpriority, CAST(date_trunc('hour', o_orderdate) AS VARCHAR), round(sum(o_totalprice), 4), -1
    FROM orders GROUP BY o_orderpriority, date_trunc('hour', o_orderdate)""", "load_hourly"))
def union_zones(spark, d):
    first = c.as_text(c.load_hourly(spark, d).select("zone", "ds", "mw", "temp"), "ds")
    orders = c.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("zone"), cal.truncate_hour(F.col("o_orderdate")).alias("ds"), "o_totalprice")
    second = orders.groupBy("zone", "ds").agg(F.round(F.sum("o_totalprice"), 4).alias("mw"))
    return c.filled(delimited.stack(first, c.as_text(second, "ds")), -1.0, "temp")


# Of the days divisible by five, hour 3 lacks its last columns, hour 5 has a word for a number, and hour 7 has a column too many.
_PLANTED = "CASE WHEN day(ds) % 5 <> 0 THEN 'good' WHEN hour IN (3, 7) THEN 'columns' WHEN hour = 5 THEN 'hourly_mw' ELSE 'good' END"


@query("text_quarantine", sql(f"""
    SELECT {_PLANTED} AS reason, count(*) AS n, round(sum(CASE WHEN {_PLANTED} = 'good' THEN mw ELSE 0 END), 2) AS mw
    FROM load_hourly GROUP BY ALL""", "load_hourly"))
def text_quarantine(spark, d):
    """Hourly text with rows that do not fit: the good ones are read, the others stand aside with their reason."""
    path = scratch_path(spark, "planted")
    text = [F.col(name).cast("string") for name in ("zone", "hour", "mw", "temp")]
    odd = F.day("ds") % 5 == 0
    line = (F.when(odd & (F.col("hour") == 3), F.concat_ws(",", *text[:2])).when(odd & (F.col("hour") == 5), F.concat_ws(",", text[0], text[1], F.lit("n/a"), text[3]))
            .when(odd & (F.col("hour") == 7), F.concat_ws(",", *text, F.lit("9"))).otherwise(F.concat_ws(",", *text)))
    c.load_hourly(spark, d).select(line.alias("line")).write.text(path)
    rows, rejected = quarantine.read_sorted(spark, path, schemas.HOURLY_FORECAST, header=False)
    good = rows.agg(F.lit("good").alias("reason"), F.count(F.lit(1)).alias("n"), F.round(F.sum("hourly_mw"), 2).alias("mw"))
    bad = rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("mw"))
    return good.unionByName(bad)


# Of the documents, those of days 1, 11, .. are cut off, those of days 2, 12, .. are absent.
_FAULT = "CASE WHEN day(date) % 10 = 1 THEN 'malformed' WHEN day(date) % 10 = 2 THEN 'empty' ELSE 'good' END"


@query("document_quarantine", sql(f"""
    SELECT reason, count(DISTINCT (zone, date)) AS documents, sum(CASE WHEN reason = 'good' THEN 1 ELSE 0 END)::BIGINT AS hours
    FROM (SELECT *, {_FAULT} AS reason FROM weather_hourly) GROUP BY reason""", "weather_hourly"))
def document_quarantine(spark, d):
    """Landed weather documents of which some are cut off or absent: no document is lost without a word."""
    number = F.day("date") % 10
    path = scratch_path(spark, "faulty")
    faulty = F.when(number == 1, F.substring("document", 1, 50)).when(number != 2, F.col("document"))
    c.landed_documents(spark, d).withColumn("document", faulty).write.json(path)
    good, rejected = quarantine.read_documents(spark, path, schemas.LANDED_DOCUMENT)
    hours = weather_rows(explode_documents(good)).agg(F.count(F.lit(1)).alias("hours"))
    counts = good.agg(F.lit("good").alias("reason"), F.count(F.lit(1)).alias("documents")).withColumn("hours", hours.scalar())
    return counts.unionByName(rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("documents"), F.lit(0).cast("long").alias("hours")))


@query("memoised_system", sql("SELECT CAST(date AS VARCHAR) AS date, hour, mw, true AS computed_first, true AS read_then FROM system_hourly", "system_hourly"))
def memoised_system(spark, d):
    """System totals asked for twice: computed by the first call, read from the store by the second."""
    store = ResultStore(spark, scratch_path(spark, "store"))

    def totals():
        return c.rounded(peaks.hourly_total(c.load_hourly(spark, d), c.BY_DAY), 4, "mw")

    _, there = store.fetch(totals(), "system")
    rows, found = store.fetch(totals(), "system")
    return c.as_text(rows, "date").select("date", "hour", "mw", F.lit(not there).alias("computed_first"), F.lit(found).alias("read_then"))
