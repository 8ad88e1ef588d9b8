"""Weather expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.calendar import EASTERN, utc_to_local

# Weather codes that count as rain and as snow, and hectopascal to inches of mercury.
RAIN_CODES = [51, 53, 55, 61, 63, 65, 80, 81, 82, 95, 96, 99]
SNOW_CODES = [56, 57, 66, 67, 71, 73, 75, 77, 85, 86]
INHG_PER_HPA = 0.029529983071445


def rain_flag(code: Column) -> Column:
    return code.isin(RAIN_CODES)


def snow_flag(code: Column) -> Column:
    return code.isin(SNOW_CODES)


def to_inhg(hpa: Column) -> Column:
    return hpa * F.lit(INHG_PER_HPA)


def document_time_to_local(text: Column, abbreviation: Column, tz: str = EASTERN) -> Column:
    """Wall-clock text plus one offset per document (standard time if the abbreviation holds an S,
    else daylight time), shown in ``tz``."""
    wall = text.cast("timestamp_ntz")
    behind = F.when(abbreviation.contains("S"), F.lit(5)).otherwise(F.lit(4))
    return utc_to_local(wall + F.make_dt_interval(F.lit(0), behind), tz)


def fill_missing_flags(df: DataFrame, *flags: str, missing_as_true: bool = False) -> DataFrame:
    """Missing flags stay null, or become true when the caller asks for that."""
    if not missing_as_true:
        return df
    return df.withColumns({f: F.coalesce(F.col(f), F.lit(True)) for f in flags})
