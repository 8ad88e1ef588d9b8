"""The aggregate queries behind the four report sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.operators.joins import with_all_zones
from gridcast.operators.selection import member_filter


def attr(column: str) -> Column:
    """The value when a group holds a single distinct one, else null."""
    return F.when(F.min(column) == F.max(column), F.min(column))


def map_sheet(dim: DataFrame, peaks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per place: the peak as attribute and as sum, and the mean share of the record."""
    return (
        with_all_zones(dim, peaks.drop("hist_peak_mw"))
        .groupBy("zone", "full_zone_name", "lat", "long", *by)
        .agg(
            attr("peak_hour_mw").alias("attr_peak_hour_mw"),
            F.sum("peak_hour_mw").alias("sum_peak_hour_mw"),
            F.avg("pct_hist_peak_mw").alias("avg_pct_hist_peak_mw"),
        )
    )


def system_info_sheet(dim: DataFrame, hourly: DataFrame, peaks: DataFrame) -> DataFrame:
    """Per zone and hour: summed load and mean peak hour. Each table is reduced at its own grain first."""
    loads = hourly.groupBy("zone", "hour").agg(F.sum("hourly_mw").alias("sum_hourly_mw"))
    hours = peaks.groupBy("zone").agg(F.avg("peak_hour").alias("avg_peak_hour"))
    names = dim.select("zone", "full_zone_name")
    return names.join(loads, "zone", "left").join(hours, "zone", "left")


def title_sheet(system: DataFrame) -> DataFrame:
    """Per day: the system peak and the mean peak hour. ``system`` carries a date."""
    return system.groupBy("date").agg(
        F.max("system_mw").alias("max_system_mw"), F.avg("peak_hour").alias("avg_peak_hour")
    )


def zone_detail_sheet(dim: DataFrame, hourly: DataFrame, members: DataFrame, fields: Sequence[str]) -> DataFrame:
    """For the chosen members, per hour: summed load, mean temperature, zone and name as attributes."""
    chosen = member_filter(dim, members, fields).select("zone", "full_zone_name")
    return (
        hourly.join(chosen, "zone")
        .groupBy("hour")
        .agg(
            F.sum("hourly_mw").alias("sum_hourly_mw"),
            F.avg("temp").alias("avg_temp"),
            attr("zone").alias("attr_zone"),
            attr("full_zone_name").alias("attr_full_zone_name"),
        )
    )
