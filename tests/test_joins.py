import pytest
from pyspark.sql import functions as F

from gridcast.operators import joins


def test_peak_vs_history_keeps_unknown_zones_and_zero_records(frame):
    peaks = frame([("AE", 1299.4641), ("ZERO", 5.0), ("XX", 7.0)], "zone string, peak_hour_mw double")
    dim = frame([("AE", 2737.312), ("ZERO", 0.0)], "zone string, hist_peak_mw double")
    got = {r["zone"]: r["pct_hist_peak_mw"] for r in joins.peak_vs_history(peaks, dim).collect()}
    assert got["AE"] == pytest.approx(0.47472268828987163, rel=1e-6)
    assert got["ZERO"] is None and got["XX"] is None


def test_inner_and_semi_joins(frame):
    rows = frame([("AE", 1), ("XX", 2)], "zone string, x int")
    dim = frame([("AE", 39.45), ("AE", 40.0)], "zone string, lat double")
    assert joins.zone_enrich(rows, dim).count() == 2
    assert joins.known_zones(rows, dim).collect() == [("AE", 1)]


def test_first_row_wins_on_duplicates(frame):
    lookup = frame([(2, "AE", 2.0, None), (1, "AE", 1.0, "first"), (3, "AP", 3.0, "x")], "at int, zone string, lat double, note string")
    zones = frame([("AE",), ("AP",), ("XX",)], "zone string")
    got = {r["zone"]: (r["lat"], r["note"]) for r in joins.zone_lookup(zones, lookup, F.col("at"), "lat", "note").collect()}
    assert got == {"AE": (1.0, "first"), "AP": (3.0, "x"), "XX": (None, None)}


def test_file_order(spark, tmp_path):
    path = tmp_path / "dup.csv"
    path.write_text("zone,lat\nAE,1\nAE,2\nAP,3\n")
    rows = spark.read.schema("zone string, lat double").option("header", True).csv(str(path))
    got = {r["zone"]: r["lat"] for r in joins.first_per_zone(joins.in_file_order(rows), F.col("position"), "lat").collect()}
    assert got == {"AE": 1.0, "AP": 3.0}


def test_every_zone_gets_every_hour(frame):
    zones = frame([("AE", "2022-11-16"), ("AP", "2022-11-17")], "zone string, day string")
    rows = joins.zone_hours(zones, F.col("day").cast("timestamp_ntz")).collect()
    assert len(rows) == 48
    assert sorted({r["datetime"].hour for r in rows}) == list(range(24))
    assert {(r["zone"], str(r["datetime"].date())) for r in rows} == {("AE", "2022-11-16"), ("AP", "2022-11-17")}


def test_star_does_not_repeat_peaks(frame):
    dim = frame([("AE", "Atlantic")], "zone string, full_zone_name string")
    hourly = frame([("AE", h, 1.0) for h in range(3)], "zone string, hour int, hourly_mw double")
    system = frame([(h, 1.0, 2) for h in range(3)], "hour int, system_mw double, peak_hour int")
    peaks = frame([("AE", 10.0, 0.5), ("AE", 20.0, 0.7)], "zone string, peak_hour_mw double, pct_hist_peak_mw double")
    rows = joins.relationship_star(dim, hourly, system, peaks).collect()
    assert len(rows) == 3 and {r["zone_peak_mw"] for r in rows} == {30.0}
    assert {round(r["zone_pct"], 6) for r in rows} == {0.6}


def test_calendar_keeps_hours_without_weather(frame):
    calendar = frame([("AE", 1), ("AE", 2)], "zone string, datetime int")
    weather = frame([("AE", 1, 50.0), ("AE", 9, 60.0)], "zone string, datetime int, temp double")
    got = {r["datetime"]: r["temp"] for r in joins.calendar_weather(calendar, weather).collect()}
    assert got == {1: 50.0, 2: None}


def test_star_keeps_zones_without_hours(frame):
    dim = frame([("A",), ("B",)], "zone string")
    facts = frame([("A", 1), ("X", 2)], "zone string, v int")
    assert sorted(map(str, map(tuple, joins.with_all_zones(dim, facts).collect()))) == ["('A', 1)", "('B', None)"]
