"""The table behind the interactive page, for every forecast day at one hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.functions.display import pct_of_record, ratio, zone_label
from gridcast.operators import peaks
from gridcast.session import materialize


def zone_dashboard(forecast: DataFrame, dim: DataFrame, hour: int, selection: Sequence[str] = (), top: int = 5) -> DataFrame:
    """Per day and zone: load at ``hour``, own peak and its hour, load at the system peak, share of the
    record, marker size, label, and whether it is among the day's largest. ``forecast`` is read several
    times, so pass a stored or persisted frame.

    """
    by = ["date"]
    now = forecast.filter(F.col("hour") == hour).select("zone", "date", "mw", "temp").join(dim, "zone")
    at_system_peak = peaks.load_at_system_peak(forecast, by, hour_as="system_hour")
    # Scaling and ranking look at all rows of a day; they read the joined rows instead of redoing them.
    rows = materialize(
        now.join(peaks.zone_peaks(forecast, by), ["zone", *by]).join(at_system_peak, ["zone", *by]), "dashboard"
    )
    sized = peaks.top_flag(peaks.minmax_scale(rows, "mw_max", "radius", by=by), by, top)
    shown = sized.withColumns({
        "pct": ratio(F.col("mw_max"), F.col("hist_peak_mw")),
        "radius": F.col("radius").cast("int"),
        "selected": F.col("zone").isin(list(selection)) if selection else F.lit(False),
        "label": zone_label(
            F.col("full_zone_name"), F.col("zone"), F.col("h_max"), F.col("mw_max"), F.col("system_hour"),
            F.col("mw_sys"), pct_of_record(F.col("mw_max"), F.col("hist_peak_mw")), F.lit(hour), F.col("mw"), F.col("temp"),
        ),
    })
    return shown.withColumn("mw", F.bround("mw", 2))
