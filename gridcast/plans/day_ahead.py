"""The day-ahead job: features, scores and the three published tables for every zone in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast import schemas
from gridcast.functions.calendar import EASTERN, localize_drop, with_calendar
from gridcast.functions.weather import fill_missing_flags
from gridcast.operators import joins, peaks
from gridcast.sources.delimited import write_tables
from gridcast.sources.weather_documents import explode_documents, weather_rows


@dataclass
class DayAheadTables:
    peak: DataFrame
    hourly: DataFrame
    system: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {
            "peak_hour_forecast": self.peak,
            "hourly_forecast": self.hourly,
            "system_hourly_forecast": self.system,
        }


def feature_frame(
    zones: DataFrame, start: Column, weather: DataFrame, tz: str = EASTERN,
    season: bool = False, missing_flags_as_true: bool = False,
) -> DataFrame:
    """Calendar hours of every zone from ``start`` with weather: 20 model columns, or 21 with season."""
    spine = localize_drop(joins.zone_hours(zones.select("zone", start.alias("__start")), F.col("__start")), "datetime", tz)
    calendar = with_calendar(spine.drop("__start"), "datetime", tz)
    joined = joins.calendar_weather(calendar, weather)
    joined = fill_missing_flags(joined, "rain", "snow", missing_as_true=missing_flags_as_true)
    features = schemas.PAGE_FEATURES if season else schemas.BATCH_FEATURES
    return joined.select("zone", "datetime", "date", "hour", *features)


def peak_table(forecast: DataFrame, dim: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each zone's load at the system peak hour, against its record."""
    peak = peaks.system_peak(peaks.hourly_total(forecast, by), by)
    at_peak = peaks.peak_hour_slice(forecast, peak, by).select(
        "zone", "date", F.col("hour").alias("peak_hour"), F.col("mw").alias("peak_hour_mw")
    )
    return joins.peak_vs_history(at_peak, dim)


def system_table(forecast: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    totals = peaks.hourly_total(forecast, by, out="system_mw")
    return peaks.with_system_peak_hour(totals, by, "system_mw")


def hourly_table(forecast: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return forecast.select("zone", *by, "hour", F.col("mw").alias("hourly_mw"), "temp")


def day_ahead_tables(forecast: DataFrame, dim: DataFrame, by: Sequence[str] = ()) -> DayAheadTables:
    """The three tables of a scored forecast (zone, date, hour, mw, temp)."""
    return DayAheadTables(
        peak=peak_table(forecast, dim, by), hourly=hourly_table(forecast, by), system=system_table(forecast, by)
    )


def run(
    zones: DataFrame, dim: DataFrame, documents: DataFrame, start: Column,
    score: Callable[[DataFrame], DataFrame], out: str, tz: str = EASTERN, by: Sequence[str] = (),
) -> None:
    """Documents to written tables. The scored frame feeds three writes and is kept between them. For
    more than one day give ``zones`` a row per day, ``start`` as an expression on it, and ``by``."""
    weather = weather_rows(explode_documents(documents), tz)
    forecast = score(feature_frame(zones, start, weather, tz)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        write_tables(day_ahead_tables(forecast, dim, by).as_dict(), out)
    finally:
        forecast.unpersist()
