import pytest
from pyspark.sql import functions as F

from gridcast import schemas
from gridcast.sources import quarantine as q
from gridcast.sources.delimited import read_delimited
from gridcast.sources.weather_documents import explode_documents, weather_rows

LINES = [
    "zone,hour,hourly_mw,temp",
    "AE,0,10.5,50",
    "AE,1,n/a,51",
    "AE,2",
    "AE,3,11,52,9",
    '"B, C",4,12,',
    "AE,x,y,53",
    "",
    "AE,5,13.25,54",
    'AE,6,"14"',
]


def test_bad_rows_go_aside_and_good_ones_go_on(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.csv").write_text("﻿" + "\n".join(LINES) + "\n")
    (tmp_path / "in" / "two.csv").write_text("zone,hour,hourly_mw,temp\nXX,7,1,2\nXX,1.5,1,2\n")
    rows, rejected = q.read_sorted(spark, str(tmp_path / "in"), schemas.HOURLY_FORECAST)
    assert rows.schema == schemas.HOURLY_FORECAST
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(
        [("AE", 0, 10.5, 50.0), ("B, C", 4, 12.0, None), ("AE", 5, 13.25, 54.0), ("XX", 7, 1.0, 2.0)], key=str)
    got = {(r.file.rsplit("/", 1)[1], r.line, r.reason) for r in rejected.collect()}
    assert got == {("one.csv", "AE,1,n/a,51", "hourly_mw"), ("one.csv", "AE,2", "columns"), ("one.csv", "AE,3,11,52,9", "columns"),
                   ("one.csv", "AE,x,y,53", "hour,hourly_mw"), ("one.csv", 'AE,6,"14"', "columns"), ("two.csv", "XX,1.5,1,2", "hour")}
    # Every line but headers and blank ones is on one side.
    assert rows.count() + rejected.count() == len(LINES) - 2 + 2
    with pytest.raises(Exception):
        read_delimited(spark, str(tmp_path / "in"), schemas.HOURLY_FORECAST).collect()


def test_other_separator_without_header_and_nothing_bad(spark, tmp_path):
    (tmp_path / "in.txt").write_text("AE;0;1.5;2\n")
    rows, rejected = q.read_sorted(spark, str(tmp_path / "in.txt"), schemas.HOURLY_FORECAST, sep=";", header=False)
    assert [tuple(r) for r in rows.collect()] == [("AE", 0, 1.5, 2.0)] and rejected.count() == 0
    (tmp_path / "empty.txt").write_text("")
    rows, rejected = q.read_sorted(spark, str(tmp_path / "empty.txt"), schemas.HOURLY_FORECAST, header=False)
    assert rows.count() == rejected.count() == 0


def document(**changes):
    import json

    hourly = {"time": ["2022-01-01T00:00"], "temperature_2m": [1.0], "relativehumidity_2m": [2.0], "precipitation": [0.0], "weathercode": [3],
              "surface_pressure": [1000.0], "windspeed_10m": [4.0]} | {k: v for k, v in changes.items() if k != "timezone_abbreviation"}
    top = {"timezone_abbreviation": changes.get("timezone_abbreviation", "EST"), "hourly": {k: v for k, v in hourly.items() if v is not None}}
    return json.dumps(top)


def test_documents(frame):
    docs = [("good", document()), ("null", None), ("blank", "  "), ("cut", document()[:60]), ("text", "no data"), ("array", "[1]"),
            ("abbreviation", document(timezone_abbreviation=None)), ("hourly", '{"timezone_abbreviation": "EST"}'), ("missing", document(weathercode=None)),
            ("unequal", document(weathercode=[1, 2])), ("type", document(temperature_2m=["warm"])), ("gap", document(temperature_2m=[None]))]
    good, rejected = q.sort_documents(frame(docs, "zone string, document string"))
    assert {r.zone for r in good.collect()} == {"good", "gap"}
    reasons = {r.zone: r.reason for r in rejected.collect()}
    assert reasons == {"null": "empty", "blank": "empty", "cut": "malformed", "text": "malformed", "array": reasons["array"], "abbreviation": "timezone_abbreviation",
                       "hourly": "hourly", "missing": "weathercode", "unequal": "unequal", "type": "malformed"}
    assert reasons["array"] in ("malformed", "timezone_abbreviation")
    # A gap inside a good document takes its hour away, as before.
    assert {r.zone for r in weather_rows(explode_documents(good)).collect()} == {"good"}


def test_landed_lines(spark, tmp_path):
    import json

    lines = [json.dumps({"zone": "A", "date": "2022-01-01", "document": document()}), '{"zone": "B", "date": "2022-01-0', json.dumps({"zone": "C", "date": "2022-01-01", "document": "{"})]
    (tmp_path / "in.json").write_text("\n".join(lines) + "\n")
    good, rejected = q.read_documents(spark, str(tmp_path / "in.json"), schemas.LANDED_DOCUMENT)
    assert [r.zone for r in good.collect()] == ["A"] and good.columns == ["zone", "date", "document"]
    got = {(r.zone, r.document, r.reason, r.file.rsplit("/", 1)[1]) for r in rejected.collect()}
    assert got == {(None, lines[1], "line", "in.json"), ("C", "{", "malformed", "in.json")}
