"""Ratios, rounding and text for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """Null when the whole is zero or missing."""
    return part / F.nullif(whole, F.lit(0.0))


def round_half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def pct_of_record(peak: Column, record: Column) -> Column:
    return round_half_even(ratio(peak, record) * 100, 2)


def whole_number(value: Column) -> Column:
    """Nearest whole number with thousands separators."""
    return F.format_number(round_half_even(value), 0)


def hour_text(hour: Column) -> Column:
    return F.concat(hour.cast("string"), F.lit("H"))


def megawatt_text(value: Column) -> Column:
    return F.concat(whole_number(value), F.lit(" mw"))


def zone_title(name: Column, zone: Column) -> Column:
    return F.concat(name, F.lit("("), zone, F.lit(")"))


def zone_label(
    name: Column, zone: Column, peak_hour: Column, peak: Column, system_hour: Column,
    at_system_peak: Column, pct: Column, hour: Column, load: Column, temp: Column,
) -> Column:
    """The lines shown for one zone, separated by line breaks. The captions are fixed values."""

    def line(caption: str, at: Column, value: Column) -> Column:
        return F.concat(F.lit(f"{caption} ("), hour_text(at), F.lit("): "), value)

    return F.concat_ws(
        "\n",
        zone_title(name, zone),
        line("Peak Load", peak_hour, whole_number(peak)),
        line("Load when system peak", system_hour, whole_number(at_system_peak)),
        F.concat(F.lit("% of historical peak: "), pct.cast("string"), F.lit("%")),
        line("Realtime Load", hour, whole_number(load)),
        line("Temperature", hour, temp.cast("string")),
    )


def marker_text(zone: Column, peak: Column) -> Column:
    """The short label drawn next to the largest zones."""
    return F.concat_ws(" ", zone, whole_number(peak))


def location(lat: str = "lat", long: str = "long") -> Column:
    return F.struct(F.col(lat), F.col(long))
