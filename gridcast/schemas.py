"""Declared schemas of every table the library reads or writes. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()

ZONE_DIM = _struct(zone=_S, lat=_D, long=_D, full_zone_name=_S, hist_peak_mw=_D)
ZONE_MAPPING = _struct(zone=_S, lat=_D, long=_D, full_zone_name=_S)
HOURLY_FORECAST = _struct(zone=_S, hour=_I, hourly_mw=_D, temp=_D)
SYSTEM_HOURLY = _struct(hour=_I, system_mw=_D, peak_hour=_I)
PEAK_HOUR = _struct(
    zone=_S, date=T.DateType(), peak_hour=_I, peak_hour_mw=_D, hist_peak_mw=_D, pct_hist_peak_mw=_D
)
METERED_HISTORY = _struct(datetime_beginning_ept=_S, zone=_S, mw=_D)
SAVED_FORECAST = _struct(index=_I, date=T.DateType(), hour=_I, zone=_S, mw=_D, temp=_D)

LOOKUP = _struct(zone=_S, first_value=_D, first_user=T.LongType())
LANDED_DOCUMENT = _struct(zone=_S, date=T.DateType(), document=_S)

WEATHER_DOCUMENT = T.StructType(
    [
        T.StructField("timezone_abbreviation", _S),
        T.StructField(
            "hourly",
            T.StructType(
                [
                    T.StructField("time", T.ArrayType(_S)),
                    T.StructField("temperature_2m", T.ArrayType(_D)),
                    T.StructField("relativehumidity_2m", T.ArrayType(_D)),
                    T.StructField("precipitation", T.ArrayType(_D)),
                    T.StructField("weathercode", T.ArrayType(_I)),
                    T.StructField("surface_pressure", T.ArrayType(_D)),
                    T.StructField("windspeed_10m", T.ArrayType(_D)),
                ]
            ),
        ),
    ]
)

# Column lists of the three feature layouts (fixed names, they are part of a stored model).
CALENDAR_COLUMNS = [
    "datetime", "date", "hour", "year", "dow", "is_dst", "is_sah", "precovid", "postcovid",
    "weekend", "recent", "hour_cos", "hour_sin", "month_cos", "month_sin", "dow_num", "holiday",
    "season_num",
]
BATCH_FEATURES = [
    "year", "weekend", "holiday", "is_dst", "is_sah", "precovid", "postcovid", "temp", "precip",
    "rh", "pressure", "windspeed", "rain", "snow", "recent", "hour_cos", "hour_sin", "month_cos",
    "month_sin", "dow_num",
]
PAGE_FEATURES = BATCH_FEATURES + ["season_num"]
TRAINING_FEATURES = ["month", "temp", "precip", "rh", "pressure", "windspeed", "rain", "snow"]
