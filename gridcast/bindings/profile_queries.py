"""Data profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.bindings import common as c
from gridcast.bindings.common import query, sql
from gridcast.operators import profile
from gridcast.session import materialize

_PROFILED = ["temp", "rh", "precip", "pressure", "windspeed", "rain", "snow"]
_NUMBERS = ["quantity", "mw", "discount", "tax", "month"]


@query("zone_counts", "SELECT event_type AS zone, count(*) AS n FROM events GROUP BY event_type")
def zone_counts(spark, d):
    return profile.zone_counts(c.readings(spark, d))


@query("null_profile", sql(" UNION ALL ".join(
    f"""SELECT '{x}' AS "column", count(*) - count({x}) AS nulls, round(coalesce((count(*) - count({x})) / nullif(count({x}), 0), -1), 6) AS null_ratio FROM j"""
    for x in _PROFILED), "spine", "weather",
    extra={"j": "SELECT w.* FROM spine s LEFT JOIN weather w ON s.zone = w.zone AND s.datetime = w.datetime"}))
def null_profile(spark, d):
    rows = profile.null_profile(c.calendar_weather(spark, d), _PROFILED)
    return c.rounded(c.filled(rows, -1.0, "null_ratio"), 6, "null_ratio")


@query("widest_range", sql("""
    SELECT arg_max(name, (spread, -place)) AS "column", round(max(spread), 4) AS spread FROM (""" + " UNION ALL ".join(
    f"SELECT '{x}' AS name, {i} AS place, CAST(max({x}) - min({x}) AS DOUBLE) AS spread FROM train" for i, x in enumerate(_NUMBERS)) + ")", "train"))
def widest_range(spark, d):
    return c.rounded(profile.widest_range(c.train(spark, d), _NUMBERS), 4, "spread")


@query("correlation_matrix", sql(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) + 0.0 AS corr FROM train" for a in _NUMBERS for b in _NUMBERS), "train"))
def correlation_matrix(spark, d):
    # Adding zero turns a negative zero into a positive one.
    return profile.correlation_matrix(c.train(spark, d), _NUMBERS).withColumn("corr", F.col("corr") + 0.0)


@query("global_max", sql("SELECT max(temp) AS temp FROM load_hourly", "load_hourly"))
def global_max(spark, d):
    return profile.global_max(c.load_hourly(spark, d), "temp")


@query("next_forecast_date", "SELECT CAST(max(CAST(ts AS DATE)) + 1 AS VARCHAR) AS forecast_date FROM events")
def next_forecast_date(spark, d):
    return c.as_text(profile.next_forecast_date(c.table(spark, d, "events"), "ts"), "forecast_date")


@query("column_profile", sql(" UNION ALL ".join(
    f"""SELECT '{x}' AS "column", '{kind}' AS type, '{agg}' AS aggregation, count(*) > count({x}) AS contains_null, count(DISTINCT {x}) AS distinct_values FROM load_hourly"""
    for x, kind, agg in [("zone", "string", "Count"), ("date", "date", "Count"), ("hour", "integer", "Sum"), ("mw", "real", "Sum"), ("temp", "real", "Sum"), ("ds", "datetime", "Count")]),
    "load_hourly"))
def column_profile(spark, d):
    return profile.column_profile(c.stored_hourly(spark, d), exact=True)


@query("summary_stats", sql(" UNION ALL ".join(
    f"""SELECT '{x}' AS "column", count({x}) AS count, round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std, CAST(min({x}) AS DOUBLE) AS min,
        round(quantile_cont({x}, 0.25), 4) AS q25, round(quantile_cont({x}, 0.5), 4) AS q50, round(quantile_cont({x}, 0.75), 4) AS q75,
        CAST(max({x}) AS DOUBLE) AS max FROM train""" for x in ["quantity", "mw", "discount", "month"]), "train"))
def summary_stats(spark, d):
    return c.rounded(profile.summary_stats(c.train(spark, d), ["quantity", "mw", "discount", "month"]), 4, "mean", "std", "q25", "q50", "q75")


_SKETCHED = ["zone", "hour", "k", "rounded"]


@query("range_profile", sql(" UNION ALL ".join(f"""
    SELECT '{x}' AS "column", count(*) AS rows, count(*) - count({x}) AS nulls, count(DISTINCT {x}) AS distinct_values FROM sketched"""
    for x in _SKETCHED), extra={"sketched": """
    SELECT event_type AS zone, hour(ts) AS hour, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
           CASE WHEN hour(ts) <> 3 THEN round(value / 10) END AS rounded
    FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"""}))
def range_profile(spark, d):
    """Nulls and distinct values of a range of days, from sketches stored per day."""
    rows = c.readings(spark, d).withColumn("rounded", F.when(F.col("hour") != 3, F.round(F.col("value") / 10)))
    stored = materialize(profile.day_sketches(rows, _SKETCHED), "sketches")
    return profile.range_profile(stored, "2024-01-05", "2024-01-20")
