"""Weather documents: one JSON text per zone and day, holding parallel arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast import schemas
from gridcast.functions.calendar import EASTERN
from gridcast.functions.weather import document_time_to_local, rain_flag, snow_flag, to_inhg

# Names in the documents and in the library.
RENAMED = {
    "temperature_2m": "temp", "relativehumidity_2m": "rh", "precipitation": "precip",
    "windspeed_10m": "windspeed",
}
HOURLY_FIELDS = [f.name for f in schemas.WEATHER_DOCUMENT["hourly"].dataType.fields]


def explode_documents(docs: DataFrame, json: str = "document") -> DataFrame:
    """One row per document hour, with the document's own field names."""
    parsed = docs.withColumn("__doc", F.from_json(json, schemas.WEATHER_DOCUMENT)).drop(json)
    arrays = [F.col(f"__doc.hourly.{f}").alias(f) for f in HOURLY_FIELDS]
    keep = [c for c in docs.columns if c != json]
    return parsed.select(
        *keep, F.col("__doc.timezone_abbreviation").alias("timezone_abbreviation"),
        F.inline(F.arrays_zip(*arrays)),
    )


def weather_rows(hours: DataFrame, tz: str = EASTERN) -> DataFrame:
    """Complete document hours as library weather: local time, flags, pressure in inches of mercury."""
    complete = hours.na.drop("any", subset=HOURLY_FIELDS)
    return (
        complete.withColumns({
            "datetime": document_time_to_local(F.col("time"), F.col("timezone_abbreviation"), tz),
            "rain": rain_flag(F.col("weathercode")),
            "snow": snow_flag(F.col("weathercode")),
            "pressure": to_inhg(F.col("surface_pressure")),
        })
        .withColumnsRenamed(RENAMED)
        .select("zone", "temp", "rh", "precip", "pressure", "windspeed", "datetime", "rain", "snow")
    )


def to_documents(hourly: DataFrame, abbreviation: Column) -> DataFrame:
    """The inverse: hourly rows to one document per zone and day. A document holds a day of hours, so
    the collected arrays are bounded whatever the zone's share of the table."""
    # A struct sorts by its first field, which is the time.
    hours = F.sort_array(F.collect_list(F.struct(*HOURLY_FIELDS)))
    grouped = hourly.groupBy("zone", "date").agg(hours.alias("h"))
    arrays = F.struct(*[F.col(f"h.{f}").alias(f) for f in HOURLY_FIELDS])
    document = F.to_json(F.struct(abbreviation.alias("timezone_abbreviation"), arrays.alias("hourly")), {"ignoreNullFields": "false"})
    return grouped.select("zone", "date", document.alias("document"))
