"""Views of the driver tables in the library's data model, in Spark and as SQL.

Loads, sums and means are rounded once, here, on both sides, so that ties between hours do not hang on
the order in which an engine adds numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast import schemas
from gridcast.functions.calendar import ntz, wall_hour
from gridcast.functions.weather import INHG_PER_HPA, RAIN_CODES, SNOW_CODES
from gridcast.operators import joins
from gridcast.plans import day_ahead
from gridcast.session import materialize, scratch_path
from gridcast.sources.delimited import read_zone_dimension, write_delimited
from gridcast.sources.weather_documents import explode_documents, to_documents, weather_rows

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BY_DAY = ("date",)
SELECTED = ("click", "view")
TRAIN_FEATURES = ["quantity", "discount", "tax", "month"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where it can be said in SQL, its oracle."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# ---------------------------------------------------------------- Spark views


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single meter readings: zone, date, hour, value, k."""
    # A pattern reads the one field of these flat documents several times faster than a JSON parser.
    k = F.nullif(F.regexp_extract("props", r'"k"\s*:\s*(-?\d+)', 1), F.lit("")).cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("zone"), F.col("ts").cast("date").alias("date"), F.hour("ts").alias("hour"),
        "value", k.alias("k"), "event_id",
    )


def load_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly load and temperature: zone, date, hour, mw, temp, ds."""
    return (
        readings(spark, sf_dir).groupBy("zone", "date", "hour")
        .agg(F.round(F.sum("value"), 4).alias("mw"), F.round(F.avg("k"), 4).alias("temp"))
        .withColumn("ds", wall_hour(F.col("date"), F.col("hour")))
    )


def stored_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly frame as a written table, for queries that use it more than once: the raw readings are
    scanned a single time, and joins are planned on the table's real size."""
    return materialize(load_hourly(spark, sf_dir), "hourly")


def zone_dim(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("zone").agg(
        F.round(F.avg("temp"), 8).alias("lat"), (-F.round(F.avg("mw"), 8)).alias("long"), F.max("mw").alias("hist_peak_mw"),
    ).select("zone", "lat", "long", F.concat(F.lit("Zone, "), "zone").alias("full_zone_name"), "hist_peak_mw")


def stored_zone_dim(spark: SparkSession, dim: DataFrame) -> DataFrame:
    """The dimension as the file it is in daily use, so that its size is known to the optimizer."""
    path = scratch_path(spark, "zone_dim")
    write_delimited(dim, path)
    return read_zone_dimension(spark, path)


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather under the document field names."""
    time = F.concat(F.col("date").cast("string"), F.lit("T"), F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00"))
    return (
        readings(spark, sf_dir).groupBy("zone", "date", "hour").agg(
            F.round(F.avg("k"), 4).alias("temperature_2m"),
            F.min("k").cast("double").alias("relativehumidity_2m"),
            F.round(F.min("value"), 4).alias("precipitation"),
            F.max("k").alias("weathercode"),
            F.round(F.max("value") + 900, 4).alias("surface_pressure"),
            F.count(F.lit(1)).cast("double").alias("windspeed_10m"),
        ).withColumn("time", time)
    )


def landed_documents(spark: SparkSession, sf_dir: str, least_readings: int = 1) -> DataFrame:
    """Weather documents written as JSON lines and read back. Hours of fewer readings have no pressure in them."""
    path = scratch_path(spark, "weather")
    hourly = weather_hourly(spark, sf_dir)
    if least_readings > 1:
        hourly = hourly.withColumn("surface_pressure", F.when(F.col("windspeed_10m") >= least_readings, F.col("surface_pressure")))
    to_documents(hourly, F.lit("EST")).write.json(path)
    return spark.read.schema("zone string, date date, document string").json(path)


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather_rows(explode_documents(landed_documents(spark, sf_dir)))


def hours_of(days: DataFrame) -> DataFrame:
    """Every hour of every (zone, date)."""
    spine = joins.zone_hours(days.select("zone", "date"), F.col("date").cast("timestamp_ntz"))
    return spine.select("zone", "datetime")


def zone_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).select("zone", "date").distinct()


def features(spark: SparkSession, sf_dir: str, least_readings: int = 1, **options) -> DataFrame:
    documents = landed_documents(spark, sf_dir, least_readings)
    found = weather_rows(explode_documents(documents))
    return day_ahead.feature_frame(documents, F.col("date").cast("timestamp_ntz"), found, **options)


def calendar_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = landed_documents(spark, sf_dir)
    return joins.calendar_weather(hours_of(documents), weather_rows(explode_documents(documents)))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows: zone is one of six order states, the last year is held out."""
    date = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("zone"), date.alias("date"),
        F.month(date).alias("month"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("mw"),
        # Compared as the raw column, so that a filter on the flag reaches the scan.
        (F.col("l_shipdate") >= ntz("2001-01-01")).cast("int").alias("test"),
    )


def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: o_orderkey, date."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))


def order_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every wall-clock hour of every day that has an order, over several years of clock changes."""
    days = order_dates(spark, sf_dir).select("date").distinct()
    return joins.zone_hours(days, F.col("date").cast("timestamp_ntz")).select("datetime")


def forecast_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hourly = stored_hourly(spark, sf_dir)
    return hourly, zone_dim(hourly)


def selection_table(dim: DataFrame, zones=SELECTED) -> DataFrame:
    return dim.filter(F.col("zone").isin(list(zones))).select("zone")


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Dates and timestamps as ISO text, which both engines print alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def filled(df: DataFrame, value: float, *columns: str) -> DataFrame:
    """A stated number in place of null, so that a comparison of values also compares nulls."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})


def declared_by_day() -> dict:
    """Schemas of the published tables with the day as a column."""
    day = schemas.PEAK_HOUR["date"]
    return {
        "peak_hour_forecast": schemas.PEAK_HOUR,
        "hourly_forecast": type(schemas.HOURLY_FORECAST)([schemas.HOURLY_FORECAST["zone"], day, *schemas.HOURLY_FORECAST.fields[1:]]),
        "system_hourly_forecast": type(schemas.SYSTEM_HOURLY)([day, *schemas.SYSTEM_HOURLY.fields]),
    }


# ------------------------------------------------------------------ SQL views

def codes(numbers) -> str:
    return "(" + ", ".join(map(str, numbers)) + ")"


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"

VIEWS = {
    "load_hourly": f"""
        SELECT event_type AS zone, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour,
               date_trunc('hour', ts) AS ds, round(sum(value), 4) AS mw, round(avg({_K}), 4) AS temp
        FROM events GROUP BY ALL""",
    "zone_dim": """
        SELECT zone, round(avg(temp), 8) AS lat, -round(avg(mw), 8) AS long, 'Zone, ' || zone AS full_zone_name,
               max(mw) AS hist_peak_mw
        FROM load_hourly GROUP BY zone""",
    "weather_hourly": f"""
        SELECT event_type AS zone, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour,
               date_trunc('hour', ts) AS datetime,
               strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M') AS time, round(avg({_K}), 4) AS temperature_2m,
               CAST(min({_K}) AS DOUBLE) AS relativehumidity_2m, round(min(value), 4) AS precipitation,
               max({_K}) AS weathercode, round(max(value) + 900, 4) AS surface_pressure,
               CAST(count(*) AS DOUBLE) AS windspeed_10m
        FROM events GROUP BY ALL""",
    "weather": f"""
        SELECT zone, timezone('America/New_York', timezone('UTC', datetime + INTERVAL 5 HOUR)) AS datetime, temperature_2m AS temp, relativehumidity_2m AS rh, precipitation AS precip,
               surface_pressure * {INHG_PER_HPA} AS pressure, windspeed_10m AS windspeed,
               weathercode IN {codes(RAIN_CODES)} AS rain, weathercode IN {codes(SNOW_CODES)} AS snow
        FROM weather_hourly""",
    "spine": """
        SELECT zone, CAST(date AS TIMESTAMP) + to_hours(CAST(h.hour AS BIGINT)) AS datetime
        FROM (SELECT DISTINCT event_type AS zone, CAST(ts AS DATE) AS date FROM events) d,
             (SELECT unnest(range(24)) AS hour) h""",
    "real_spine": """
        SELECT zone, datetime, date_diff('hour', timezone('UTC', instant), datetime) = -4 AS is_dst
        FROM (SELECT *, timezone('America/New_York', datetime) AS instant FROM spine)
        WHERE timezone('America/New_York', instant) = datetime
          AND timezone('America/New_York', instant + INTERVAL 1 HOUR) <> datetime
          AND timezone('America/New_York', instant - INTERVAL 1 HOUR) <> datetime""",
    "train": """
        SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS zone, CAST(l_shipdate AS DATE) AS date,
               CAST(month(l_shipdate) AS INTEGER) AS month, l_quantity AS quantity, l_discount AS discount, l_tax AS tax,
               l_extendedprice AS mw, CASE WHEN year(l_shipdate) >= 2001 THEN 1 ELSE 0 END AS test
        FROM lineitem""",
    "order_hours": """
        SELECT CAST(date AS TIMESTAMP) + to_hours(CAST(h.hour AS BIGINT)) AS datetime
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) d, (SELECT unnest(range(24)) AS hour) h""",
    "system_hourly": "SELECT date, hour, round(sum(mw), 4) AS mw FROM load_hourly GROUP BY date, hour",
    "system_peak": """
        SELECT date, max(mw) AS peak_mw, arg_max(hour, (mw, -hour)) AS peak_hour FROM system_hourly GROUP BY date""",
    "zone_peaks": """
        SELECT zone, date, max(mw) AS mw_max, arg_max(hour, (mw, -hour)) AS h_max FROM load_hourly GROUP BY zone, date""",
    "peak_table": """
        SELECT f.zone, f.date, f.hour AS peak_hour, f.mw AS peak_hour_mw, d.hist_peak_mw,
               f.mw / nullif(d.hist_peak_mw, 0) AS pct_hist_peak_mw
        FROM load_hourly f JOIN system_peak p ON f.date = p.date AND f.hour = p.peak_hour
        LEFT JOIN zone_dim d ON f.zone = d.zone""",
}

_NEEDS = {
    "zone_dim": ["load_hourly"],
    "weather": ["weather_hourly"],
    "real_spine": ["spine"],
    "system_hourly": ["load_hourly"],
    "system_peak": ["system_hourly"],
    "zone_peaks": ["load_hourly"],
    "peak_table": ["system_peak", "zone_dim"],
}


def sql(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the named views, everything they need, and further ones in ``extra``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    parts = [f"{v} AS ({VIEWS[v]})" for v in ordered] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def eliminate(source: str, keys: list[str], rows: int, columns: int, prefix: str = "step") -> dict[str, str]:
    """Views that run Gauss-Jordan elimination on columns m_i_j of ``source``; the last one holds the result."""
    steps, previous = {}, source
    for k in range(rows):
        cells = []
        for i in range(rows):
            for j in range(columns):
                value = f"m_{k}_{j} / m_{k}_{k}" if i == k else f"m_{i}_{j} - m_{i}_{k} * m_{k}_{j} / m_{k}_{k}"
                cells.append(f"{value} AS m_{i}_{j}")
        steps[f"{prefix}{k}"] = f"SELECT {', '.join([*keys, *cells])} FROM {previous}"
        previous = f"{prefix}{k}"
    return steps
