import json

from pyspark.sql import functions as F

from gridcast import schemas
from gridcast.plans import day_ahead
from gridcast.sources import delimited


def test_documents_to_three_written_tables(spark, frame, tmp_path):
    hours = [f"2022-11-16T{h:02d}:00" for h in range(24)]

    def document(base):
        return json.dumps({"timezone_abbreviation": "EST", "hourly": {
            "time": hours, "temperature_2m": [base + h for h in range(24)], "relativehumidity_2m": [50.0] * 24,
            "precipitation": [0.0] * 24, "weathercode": [None if h == 7 else 61 for h in range(24)],
            "surface_pressure": [1000.0] * 24, "windspeed_10m": [5.0] * 24}})

    zones = frame([("AE",), ("AP",), ("DRY",)], "zone string")
    docs = frame([("AE", document(40.0)), ("AP", document(30.0))], "zone string, document string")
    dim = frame([("AE", 100.0), ("AP", 0.0)], "zone string, hist_peak_mw double")

    seen = {}

    def score(features):
        seen["columns"] = features.columns
        return features.withColumn("mw", F.coalesce("temp", F.lit(1.0)) + F.when(F.col("zone") == "AE", 1.0).otherwise(0.0))

    day_ahead.run(zones, dim, docs, F.lit("2022-11-16").cast("timestamp_ntz"), score, str(tmp_path))

    assert seen["columns"] == ["zone", "datetime", "date", "hour", *schemas.BATCH_FEATURES]
    declared = {"peak_hour_forecast": schemas.PEAK_HOUR, "hourly_forecast": schemas.HOURLY_FORECAST, "system_hourly_forecast": schemas.SYSTEM_HOURLY}
    tables = delimited.read_tables(spark, str(tmp_path), declared)
    assert {n: t.count() for n, t in tables.items()} == {"peak_hour_forecast": 3, "hourly_forecast": 72, "system_hourly_forecast": 24}
    peak = {r["zone"]: r for r in tables["peak_hour_forecast"].collect()}
    assert {r["peak_hour"] for r in peak.values()} == {23}
    assert (peak["AE"]["peak_hour_mw"], peak["AE"]["pct_hist_peak_mw"]) == (64.0, 0.64)
    assert peak["AP"]["pct_hist_peak_mw"] is None and peak["DRY"]["hist_peak_mw"] is None
    # The hour with an incomplete document row stays in the calendar without weather.
    missing = tables["hourly_forecast"].filter("zone = 'AE' and hour = 7").first()
    assert missing["temp"] is None and missing["hourly_mw"] == 2.0


def test_feature_layouts(frame):
    zones = frame([("AE",)], "zone string")
    weather = frame([], "zone string, temp double, rh double, precip double, pressure double, windspeed double, datetime timestamp_ntz, rain boolean, snow boolean")
    start = F.lit("2022-03-13").cast("timestamp_ntz")
    batch = day_ahead.feature_frame(zones, start, weather)
    page = day_ahead.feature_frame(zones, start, weather, season=True, missing_flags_as_true=True)
    assert len(batch.columns) == 24 and page.columns[-1] == "season_num"
    assert batch.count() == 23
    assert {r["rain"] for r in batch.collect()} == {None} and {r["rain"] for r in page.collect()} == {True}


def test_several_days_in_one_run(spark, frame, tmp_path):
    days = frame([("AE", "2022-11-16"), ("AE", "2022-11-17"), ("AP", "2022-11-16")], "zone string, day string")
    docs = frame([("XX", "{}")], "zone string, document string")
    dim = frame([("AE", 100.0)], "zone string, hist_peak_mw double")

    def score(features):
        late_on_the_second_day = F.when((F.dayofmonth("date") == 17) & (F.col("hour") == 20), 5.0).otherwise(0.0)
        early_on_the_first = F.when((F.dayofmonth("date") == 16) & (F.col("hour") == 6), 7.0).otherwise(0.0)
        return features.withColumn("mw", late_on_the_second_day + early_on_the_first)

    day_ahead.run(days.withColumnRenamed("day", "start"), dim, docs, F.col("start").cast("timestamp_ntz"), score, str(tmp_path), by=["date"])
    peak = delimited.read_delimited(spark, f"{tmp_path}/peak_hour_forecast", schemas.PEAK_HOUR).collect()
    assert sorted((r["zone"], str(r["date"]), r["peak_hour"], r["peak_hour_mw"]) for r in peak) == [
        ("AE", "2022-11-16", 6, 7.0), ("AE", "2022-11-17", 20, 5.0), ("AP", "2022-11-16", 6, 7.0)]
    assert spark.read.option("header", True).csv(f"{tmp_path}/hourly_forecast").count() == 72
