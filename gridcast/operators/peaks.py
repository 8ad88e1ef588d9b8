"""Totals and peaks of an hourly forecast.

``by`` holds extra grouping columns. Empty, a frame is one forecast day, as in a daily run; with
``("date",)`` the same operators work on every day of a longer frame at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.operators.selection import zone_subset


def hourly_total(df: DataFrame, by: Sequence[str] = (), value: str = "mw", out: str = "mw") -> DataFrame:
    return df.groupBy(*by, "hour").agg(F.sum(value).alias(out))


def history_hourly(df: DataFrame) -> DataFrame:
    return df.groupBy("ds", "zone").agg(F.sum("mw").alias("mw"))


def avg_temp_hourly(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "hour").agg(F.bround(F.avg("temp"), 2).alias("temp"))


def peak_hour_of(value: str = "mw", hour: str = "hour") -> Column:
    """Hour of the largest value; the earliest hour wins a tie."""
    return F.max_by(hour, F.struct(F.col(value), -F.col(hour)))


def zone_peaks(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest load per zone and the hour it happens, in one aggregate."""
    return df.groupBy("zone", *by).agg(F.max("mw").alias("mw_max"), peak_hour_of().alias("h_max"))


def system_peak(system: DataFrame, by: Sequence[str] = (), value: str = "mw") -> DataFrame:
    peak = [F.max(value).alias("peak_mw"), peak_hour_of(value).alias("peak_hour")]
    return system.groupBy(*by).agg(*peak) if by else system.agg(*peak)


def with_system_peak_hour(system: DataFrame, by: Sequence[str] = (), value: str = "mw") -> DataFrame:
    """Put the peak hour on every row of an hourly system frame (at most a day of rows per group)."""
    if by:
        return system.withColumn("peak_hour", peak_hour_of(value).over(Window.partitionBy(*by)))
    return system.withColumn("peak_hour", system.agg(peak_hour_of(value).alias("h")).scalar())


def peak_hour_slice(df: DataFrame, peaks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of the system peak hour."""
    if by:
        return df.join(peaks.select(*by, F.col("peak_hour").alias("hour")), [*by, "hour"], "left_semi")
    return df.filter(F.col("hour") == peaks.select("peak_hour").scalar())


def load_at_system_peak(df: DataFrame, by: Sequence[str] = (), hour_as: str | None = None) -> DataFrame:
    """Each zone's load at the system peak hour, with that hour when a name for it is given."""
    peaks = system_peak(hourly_total(df, by), by)
    hour = [F.col("hour").alias(hour_as)] if hour_as else []
    return peak_hour_slice(df, peaks, by).select("zone", *by, *hour, F.col("mw").alias("mw_sys"))


def subset_peak(df: DataFrame, selection: DataFrame, dim: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Peak of the selected zones; no row unless the selection is a proper, non-empty part of all zones."""
    n_selected = selection.agg(F.count_distinct("zone").alias("n")).scalar()
    n_zones = dim.agg(F.count_distinct("zone").alias("n")).scalar()
    peak = system_peak(hourly_total(zone_subset(df, selection), by), by)
    return peak.filter((n_selected > 0) & (n_selected < n_zones))


def top_zones(df: DataFrame, n: int = 5, value: str = "mw_max") -> DataFrame:
    """The ``n`` zones with the largest value, by name on ties."""
    return df.orderBy(F.desc(value), "zone").limit(n)


def top_flag(df: DataFrame, by: Sequence[str], n: int = 5, value: str = "mw_max", out: str = "in_top") -> DataFrame:
    """Mark the ``n`` zones with the largest value in each group. A limit on the rank lets Spark keep
    only ``n`` rows per group and task before the shuffle; the few marked zones are joined back."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), "zone"))
    largest = df.select("zone", *by, value).withColumn("__rank", rank).filter(F.col("__rank") <= n)
    marked = largest.select("zone", *by, F.lit(True).alias(out))
    return df.join(marked, ["zone", *by], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def minmax_scale(df: DataFrame, value: str, out: str, low: float = 10.0, high: float = 50.0, by: Sequence[str] = ()) -> DataFrame:
    """Scale a column linearly to ``low..high``; null where all values are equal."""
    def scaled(smallest: Column, largest: Column) -> Column:
        spread = F.nullif(largest - smallest, F.lit(0.0))
        return (F.col(value) - smallest) / spread * (high - low) + low

    ends = F.struct(F.min(value).alias("smallest"), F.max(value).alias("largest")).alias("__ends")
    if by:
        joined = df.join(df.groupBy(*by).agg(ends), list(by), "left")
        return joined.withColumn(out, scaled(F.col("__ends.smallest"), F.col("__ends.largest"))).drop("__ends")
    span = df.agg(ends).scalar()
    return df.withColumn(out, scaled(span["smallest"], span["largest"]))
