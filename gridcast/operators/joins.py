"""Joins between zones, hours and forecasts.

No join carries a broadcast hint. Spark broadcasts a side only after its size is known to be below
``spark.sql.autoBroadcastJoinThreshold`` (from file statistics, or at run time through adaptive
execution) and shuffles with skew splitting otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.display import ratio


def calendar_weather(calendar: DataFrame, weather: DataFrame, on: Sequence[str] = ("zone", "datetime")) -> DataFrame:
    """Every calendar hour with its weather; hours without weather keep nulls."""
    return calendar.join(weather, list(on), "left")


def peak_vs_history(peaks: DataFrame, dim: DataFrame, peak: str = "peak_hour_mw") -> DataFrame:
    """Peak rows with the record peak of their zone and the share of it."""
    joined = peaks.join(dim.select("zone", "hist_peak_mw"), "zone", "left")
    return joined.withColumn("pct_hist_peak_mw", ratio(F.col(peak), F.col("hist_peak_mw")))


def zone_enrich(df: DataFrame, dim: DataFrame) -> DataFrame:
    return df.join(dim, "zone")


def known_zones(df: DataFrame, dim: DataFrame) -> DataFrame:
    return df.join(dim.select("zone"), "zone", "left_semi")


def in_file_order(df: DataFrame, out: str = "position") -> DataFrame:
    """Add the position of each row in its source files, for 'first row wins' rules."""
    position = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")
    )
    return df.withColumn(out, position)


def first_per_zone(df: DataFrame, order: Column, *columns: str) -> DataFrame:
    """One row per zone: the values of the first row in ``order``, which must be unique. A partial
    aggregate, not a window, so a zone with many rows is reduced before the shuffle."""
    return df.groupBy("zone").agg(*[F.min_by(c, order).alias(c) for c in columns])


def zone_lookup(df: DataFrame, lookup: DataFrame, order: Column, *columns: str) -> DataFrame:
    return df.join(first_per_zone(lookup, order, *columns), "zone", "left")


def zone_hours(zones: DataFrame, start: Column, hours: int = 24) -> DataFrame:
    """Give every row of ``zones`` its own consecutive hours; generated per row, so nothing is paired."""
    last = start + F.make_dt_interval(F.lit(0), F.lit(hours - 1))
    return zones.withColumn("datetime", F.explode(F.sequence(start, last, F.expr("INTERVAL '1' HOUR"))))


def relationship_star(dim: DataFrame, hourly: DataFrame, system: DataFrame, peaks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Zones with their hours, the system row of each hour and the zone's peak row.

    Peaks are first reduced to one row per zone (and ``by``), because they live at a coarser grain
    than hours and must not be repeated inside a sum. Hours meet the zones by an inner join, in which a zone
    with very many hours can be split; zones without hours are added after it.
    """
    per_zone = peaks.groupBy("zone", *by).agg(
        F.sum("peak_hour_mw").alias("zone_peak_mw"), F.avg("pct_hist_peak_mw").alias("zone_pct")
    )
    hours = with_all_zones(dim, hourly).join(system, ["hour", *by], "left")
    return hours.join(per_zone, ["zone", *by], "left")


def with_all_zones(dim: DataFrame, facts: DataFrame) -> DataFrame:
    """Zones with their facts, and once, with nulls, the zones that have none."""
    absent = dim.join(facts.select("zone").distinct(), "zone", "left_anti")
    return dim.join(facts, "zone").unionByName(absent, allowMissingColumns=True)
