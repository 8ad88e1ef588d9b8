import pytest
from pyspark.sql import functions as F

from gridcast.functions import display
from gridcast.operators import peaks, sheets
from gridcast.plans.day_ahead import day_ahead_tables
from gridcast.plans.dashboard import zone_dashboard


@pytest.fixture
def forecast(frame):
    # Hour 2 is absent, as on the day clocks go forward; the system peaks equally at 3 and 5.
    loads = {"AE": {0: 1.0, 1: 2.0, 3: 9.0, 4: 4.0, 5: 5.0}, "DOM": {0: 3.0, 1: 20.0, 3: 22.0, 4: 6.0, 5: 26.0}}
    rows = [(z, "2022-03-13", h, mw, 50.0 + h) for z, by_hour in loads.items() for h, mw in by_hour.items()]
    return frame(rows, "zone string, date string, hour int, mw double, temp double").withColumn("date", F.col("date").cast("date"))


@pytest.fixture
def dim(frame):
    return frame([("AE", 39.0, -74.0, "Atlantic", 18.0), ("DOM", 37.0, -77.0, "Dominion", 52.0)],
                 "zone string, lat double, long double, full_zone_name string, hist_peak_mw double")


def test_tied_system_peak_takes_the_earliest_hour_as_a_value(forecast):
    row = peaks.system_peak(peaks.hourly_total(forecast)).first()
    assert (row["peak_mw"], row["peak_hour"]) == (31.0, 3)


def test_day_ahead_tables_of_one_day_equal_those_by_day(forecast, dim):
    one = day_ahead_tables(forecast, dim)
    many = day_ahead_tables(forecast, dim, ("date",))
    peak = {r["zone"]: (r["peak_hour"], r["peak_hour_mw"], r["pct_hist_peak_mw"]) for r in one.peak.collect()}
    assert peak == {"AE": (3, 9.0, 0.5), "DOM": (3, 22.0, 22.0 / 52.0)}
    assert peak == {r["zone"]: (r["peak_hour"], r["peak_hour_mw"], r["pct_hist_peak_mw"]) for r in many.peak.collect()}
    assert sorted(map(tuple, one.system.collect())) == [(0, 4.0, 3), (1, 22.0, 3), (3, 31.0, 3), (4, 10.0, 3), (5, 31.0, 3)]
    assert sorted(r["system_mw"] for r in many.system.collect()) == [4.0, 10.0, 22.0, 31.0, 31.0]
    assert one.hourly.columns == ["zone", "hour", "hourly_mw", "temp"]
    assert one.peak.columns == ["zone", "date", "peak_hour", "peak_hour_mw", "hist_peak_mw", "pct_hist_peak_mw"]


def test_own_peak_differs_from_load_at_system_peak(forecast):
    own = {r["zone"]: (r["mw_max"], r["h_max"]) for r in peaks.zone_peaks(forecast).collect()}
    assert own == {"AE": (9.0, 3), "DOM": (26.0, 5)}
    at_peak = {r["zone"]: r["mw_sys"] for r in peaks.load_at_system_peak(forecast).collect()}
    assert at_peak == {"AE": 9.0, "DOM": 22.0}


@pytest.mark.parametrize("chosen, rows", [([], 0), (["AE"], 1), (["AE", "DOM"], 0)])
def test_subset_peak_needs_a_proper_part(frame, forecast, dim, chosen, rows):
    selection = frame([(z,) for z in chosen], "zone string")
    got = peaks.subset_peak(forecast, selection, dim).collect()
    assert len(got) == rows
    if rows:
        assert (got[0]["peak_mw"], got[0]["peak_hour"]) == (9.0, 3)


def test_scaling_and_top(frame):
    df = frame([("a", 10.0), ("b", 20.0), ("c", 20.0), ("d", 30.0)], "zone string, mw_max double")
    scaled = {r["zone"]: r["r"] for r in peaks.minmax_scale(df, "mw_max", "r").collect()}
    assert scaled == {"a": 10.0, "b": 30.0, "c": 30.0, "d": 50.0}
    assert [r["zone"] for r in peaks.top_zones(df, 2).collect()] == ["d", "b"]
    flagged = peaks.top_flag(df.withColumn("date", F.lit(1)), ["date"], 2)
    assert {r["zone"] for r in flagged.filter("in_top").collect()} == {"d", "b"} and flagged.count() == 4
    equal = frame([("a", 5.0), ("b", 5.0)], "zone string, mw_max double")
    assert {r["r"] for r in peaks.minmax_scale(equal, "mw_max", "r").collect()} == {None}


def test_dashboard(forecast, dim):
    rows = {r["zone"]: r for r in zone_dashboard(forecast, dim, hour=4, selection=["AE"], top=1).collect()}
    ae, dom = rows["AE"], rows["DOM"]
    assert (ae["mw"], ae["mw_max"], ae["h_max"], ae["mw_sys"], ae["system_hour"], ae["pct"]) == (4.0, 9.0, 3, 9.0, 3, 0.5)
    assert (ae["selected"], dom["selected"], ae["in_top"], dom["in_top"]) == (True, False, False, True)
    assert (ae["radius"], dom["radius"]) == (10, 50)
    assert ae["label"].split("\n") == [
        "Atlantic(AE)", "Peak Load (3H): 9", "Load when system peak (3H): 9", "% of historical peak: 50.0%",
        "Realtime Load (4H): 4", "Temperature (4H): 54.0",
    ]


def test_display_rounding(frame):
    rows = frame([(0.5, 1.0), (1.5, 0.0), (2.5, 4.0), (101479.8, 8.0)], "x double, y double").select(
        display.round_half_even(F.col("x")), display.megawatt_text(F.col("x")), display.pct_of_record(F.lit(1.0), F.col("y"))).collect()
    assert [r[0] for r in rows] == [0.0, 2.0, 2.0, 101480.0]
    assert rows[3][1] == "101,480 mw"
    assert [r[2] for r in rows] == [100.0, None, 25.0, 12.5]


def test_sheets(frame, forecast, dim):
    tables = day_ahead_tables(forecast, dim)
    map_rows = {r["zone"]: r for r in sheets.map_sheet(dim, tables.peak).collect()}
    assert map_rows["AE"]["attr_peak_hour_mw"] == map_rows["AE"]["sum_peak_hour_mw"] == 9.0
    info = sheets.system_info_sheet(dim, tables.hourly, tables.peak).collect()
    assert len(info) == 10 and {r["avg_peak_hour"] for r in info} == {3.0}
    title = sheets.title_sheet(day_ahead_tables(forecast, dim, ("date",)).system).first()
    assert (title["max_system_mw"], title["avg_peak_hour"]) == (31.0, 3.0)
    fields = ["full_zone_name", "lat", "long", "zone"]
    both = sheets.zone_detail_sheet(dim, tables.hourly, dim, fields).collect()
    assert {r["attr_zone"] for r in both} == {None} and {r["hour"]: r["sum_hourly_mw"] for r in both}[3] == 31.0
    one = sheets.zone_detail_sheet(dim, tables.hourly, dim.filter("zone = 'AE'"), fields).collect()
    assert {r["attr_zone"] for r in one} == {"AE"}


def test_average_temperature(forecast):
    got = {r["hour"]: r["temp"] for r in peaks.avg_temp_hourly(forecast).collect()}
    assert got == {0: 50.0, 1: 51.0, 3: 53.0, 4: 54.0, 5: 55.0}
