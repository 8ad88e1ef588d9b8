import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gridcast.functions import weather
from gridcast.sources.weather_documents import explode_documents, to_documents, weather_rows


def document(abbreviation="EST", **changes):
    hourly = {
        "time": ["2022-11-16T00:00", "2022-11-16T01:00"], "temperature_2m": [50.8, 51.3],
        "relativehumidity_2m": [80, 81], "precipitation": [0.0, 0.1], "weathercode": [61, 71],
        "surface_pressure": [1000.0, 1010.0], "windspeed_10m": [3.0, 4.0],
    }
    hourly.update(changes)
    return json.dumps({"timezone_abbreviation": abbreviation, "hourly": hourly, "latitude": 1})


def rows(frame, *docs):
    parsed = explode_documents(frame([("AE", d) for d in docs], "zone string, document string"))
    return weather_rows(parsed).orderBy("datetime").collect()


def test_document_to_hourly_rows(frame):
    first, second = rows(frame, document())
    assert first["datetime"] == dt.datetime(2022, 11, 16, 0) and second["datetime"] == dt.datetime(2022, 11, 16, 1)
    assert (first["temp"], first["rh"], first["rain"], first["snow"]) == (50.8, 80.0, True, False)
    assert (second["rain"], second["snow"]) == (False, True)
    assert first["pressure"] == pytest.approx(29.529983071445)


def test_one_offset_per_document(frame):
    # A daylight-time label on a standard-time day shifts every hour by one.
    assert [r["datetime"].hour for r in rows(frame, document("EDT"))] == [23, 0]
    summer = document("EDT", time=["2022-07-01T00:00", "2022-07-01T01:00"])
    assert [r["datetime"] for r in rows(frame, summer)] == [dt.datetime(2022, 7, 1, 0), dt.datetime(2022, 7, 1, 1)]


@pytest.mark.parametrize("field", ["temperature_2m", "weathercode", "surface_pressure"])
def test_a_null_anywhere_drops_the_hour(frame, field):
    kept = rows(frame, document(**{field: [None, 61]}))
    assert [r["datetime"].hour for r in kept] == [1]


def test_missing_flags(frame):
    df = frame([(None, True), (False, None)], "rain boolean, snow boolean")
    assert [tuple(r) for r in weather.fill_missing_flags(df, "rain", "snow").collect()] == [(None, True), (False, None)]
    filled = weather.fill_missing_flags(df, "rain", "snow", missing_as_true=True)
    assert [tuple(r) for r in filled.collect()] == [(True, True), (False, True)]


def test_documents_round_trip(frame):
    parsed = explode_documents(frame([("AE", document())], "zone string, document string"))
    hourly = parsed.withColumn("date", F.lit("2022-11-16").cast("date"))
    back = explode_documents(to_documents(hourly, F.lit("EST"))).drop("date")
    assert sorted(map(str, back.collect())) == sorted(map(str, parsed.collect()))
