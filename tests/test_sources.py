import datetime as dt

import pytest

from gridcast import schemas
from gridcast.session import materialize, scratch_path
from gridcast.sources import delimited


@pytest.fixture
def dim_file(tmp_path):
    path = tmp_path / "dim.csv"
    path.write_bytes("﻿zone,lat,long,full_zone_name,hist_peak_mw\nAE,39.45,-74.57,Atlantic,2737\nDEOK,39,-84.5,\"Duke, Ohio\",5000.5\n".encode())
    return str(path)


def test_zone_dimension_with_mark_quotes_and_whole_numbers(spark, dim_file):
    rows = {r["zone"]: r for r in delimited.read_zone_dimension(spark, dim_file).collect()}
    assert rows["AE"]["hist_peak_mw"] == 2737.0 and rows["DEOK"]["lat"] == 39.0
    assert rows["DEOK"]["full_zone_name"] == "Duke, Ohio"
    assert delimited.read_zone_peaks(spark, dim_file).columns == ["zone", "hist_peak_mw"]


def test_a_row_that_does_not_fit_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("zone,hour,hourly_mw,temp\nAE,one,1.0,2.0\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        delimited.read_delimited(spark, str(path), schemas.HOURLY_FORECAST).collect()


def test_history_is_summed_for_known_zones(spark, dim_file, tmp_path):
    path = tmp_path / "metered.csv"
    path.write_text("datetime_beginning_ept,zone,mw\n2022-11-01 00:00:00,AE,1.5\n2022-11-01 00:00:00,AE,2\n2022-11-01 01:00:00,XX,9\n")
    got = delimited.load_history(spark, str(path), delimited.read_zone_dimension(spark, dim_file)).collect()
    assert [tuple(r) for r in got] == [(dt.datetime(2022, 11, 1), "AE", 3.5)]


def test_fallback_only_when_the_path_is_absent(spark, frame, tmp_path):
    saved = tmp_path / "saved.csv"
    saved.write_text(",date,hour,zone,mw,temp\n0,2022-11-16,0,AE,1.0,50.0\n")
    read = delimited.read_or_fallback(spark, str(tmp_path / "absent"), str(saved))
    assert read.columns == ["date", "hour", "zone", "mw", "temp"]
    assert delimited.forecast_date(read).first()[0] == dt.date(2022, 11, 16)

    primary = str(tmp_path / "primary")
    frame([(0, dt.date(2022, 11, 16), 0, "AE", 7.0, 50.0)], "index int, date date, hour int, zone string, mw double, temp double").write.parquet(primary)
    assert delimited.read_or_fallback(spark, primary, str(saved)).first()["mw"] == 7.0

    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="not a Parquet file"):
        delimited.read_or_fallback(spark, str(tmp_path / "broken"), str(saved)).collect()


def test_tables_are_overwritten_and_counted(spark, frame, tmp_path):
    hourly = frame([("A, B", 0, 1.0, 2.0), ('q"x', 1, 3.0, None)], schemas.HOURLY_FORECAST)
    declared = {"hourly": schemas.HOURLY_FORECAST}
    for _ in range(2):
        delimited.write_tables({"hourly": hourly}, str(tmp_path / "text"))
        delimited.write_extract({"hourly": hourly}, str(tmp_path / "extract"))
    back = delimited.read_tables(spark, str(tmp_path / "text"), declared)["hourly"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, hourly.collect()))
    counts = {r["table_name"]: r["n"] for r in delimited.extract_counts(spark, str(tmp_path / "extract"), declared).collect()}
    assert counts == {"hourly": 2, "total": 2}


def test_export_is_named_by_date(spark, frame, tmp_path):
    df = frame([("2022-11-16 00:00:00", "AE", 50.0, 1.0, 9)], "ds string, zone string, temp double, mw double, extra int")
    path = delimited.export_forecast(df, str(tmp_path), "2022-11-16")
    assert path.endswith("/forecast_2022-11-16")
    header = spark.read.text(path).first()[0]
    assert header == "ds,zone,temp,mw"


def test_stack_matches_by_name(frame):
    both = delimited.stack(frame([("AE", 1.0)], "zone string, mw double"), frame([(2.0, "AP", 50.0)], "mw double, zone string, temp double"))
    assert sorted(map(tuple, both.collect())) == [("AE", 1.0, None), ("AP", 2.0, 50.0)]


class FakeSession:
    """A session as far as the scratch folder is concerned."""

    def __init__(self, **settings):
        self.conf = {k.replace("__", "."): v for k, v in settings.items()}


def test_scratch_follows_the_session_setting(spark, frame):
    assert scratch_path(FakeSession(spark__checkpoint__dir="hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(FakeSession(spark__master="spark://host:7077"), "x")
    assert materialize(frame([(1,)], "a int"), "t").collect()[0][0] == 1
