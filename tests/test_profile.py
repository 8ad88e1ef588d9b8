import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridcast.operators import profile


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({
        "zone": rng.choice(["AE", "AP", "DOM"], n), "temp": rng.normal(50, 20, n).round(1), "precip": rng.exponential(0.1, n),
        "rain": rng.random(n) < 0.2, "wind": rng.integers(0, 30, n).astype(float),
    })
    pdf.loc[::7, "wind"] = np.nan
    return pdf


@pytest.fixture
def df(spark, data):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in data.itertuples(index=False)]
    rows = [(z, float(t), float(p), bool(r), None if w is None else float(w)) for z, t, p, r, w in rows]
    return spark.createDataFrame(rows, "zone string, temp double, precip double, rain boolean, wind double")


def test_null_profile_divides_by_present_values(df, data):
    got = {r["column"]: (r["nulls"], r["null_ratio"]) for r in profile.null_profile(df).collect()}
    want = data.isna().sum() / data.count()
    assert got["wind"] == (int(data["wind"].isna().sum()), pytest.approx(want["wind"]))
    assert got["temp"] == (0, 0.0)


def test_null_ratio_of_an_empty_column(frame):
    assert profile.null_profile(frame([(None,)], "x double")).first()["null_ratio"] is None


def test_correlations_match_pandas(df, data):
    columns = ["temp", "precip", "rain", "wind"]
    want = data[columns].astype(float).corr().round(4)
    for r in profile.correlation_matrix(df, columns).collect():
        assert r["corr"] == pytest.approx(want.loc[r["a"], r["b"]], abs=1e-4)


def test_widest_range_and_ties(df, frame):
    assert profile.widest_range(df, ["precip", "temp", "rain"]).first()["column"] == "temp"
    tied = frame([(0, 0), (5, 5)], "b int, a int")
    assert profile.widest_range(tied, ["b", "a"]).first()["column"] == "b"


def test_counts_and_first_seen(df, data, frame):
    assert {r["zone"]: r["n"] for r in profile.zone_counts(df).collect()} == data.groupby("zone").size().to_dict()
    rows = frame([("b", 1), ("a", 2), ("b", 3)], "zone string, at int")
    assert [r["zone"] for r in profile.distinct_zones(rows, "at").orderBy("first_seen").collect()] == ["b", "a"]


def test_column_profile_exact_and_approximate(df, data):
    exact = {r["column"]: r for r in profile.column_profile(df, exact=True).collect()}
    rough = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert set(exact) == set(rough) == set(data.columns)
    for c in data.columns:
        assert exact[c]["distinct_values"] == data[c].nunique()
        assert rough[c]["distinct_values"] == pytest.approx(data[c].nunique(), rel=0.15)
        assert exact[c]["contains_null"] == bool(data[c].isna().any())
    assert (exact["zone"]["type"], exact["temp"]["type"], exact["rain"]["type"]) == ("string", "real", "boolean")
    assert (exact["zone"]["aggregation"], exact["temp"]["aggregation"]) == ("Count", "Sum")


def test_summary_matches_describe(df, data):
    want = data[["temp", "precip", "wind"]].describe()
    for r in profile.summary_stats(df, ["temp", "precip", "wind"]).collect():
        got = [r[c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")]
        assert got == pytest.approx(list(want[r["column"]]), rel=1e-12)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, 1e-9, -1e9])), min_size=1, max_size=60))
def test_exact_quantiles_of_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values + [1.0] * 30], "x double")
    got = profile.exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.9, 1.0], bins=4)
    for p, q in {p: q for (_, p), q in got.items()}.items():
        assert q == pytest.approx(np.quantile(values + [1.0] * 30, p), rel=1e-12, abs=1e-12)


def test_quantiles_of_a_column_without_values(frame):
    df = frame([(None, 1.0)], "x double, y double")
    assert profile.summary_stats(df, ["x", "y"]).filter("column = 'x'").first()["q50"] is None


def test_next_forecast_date(frame):
    df = frame([(dt.datetime(2022, 11, 7, 23),), (dt.datetime(2022, 11, 1),)], "ds timestamp_ntz")
    assert profile.next_forecast_date(df).first()[0] == dt.date(2022, 11, 8)
    assert profile.global_max(df, "ds").first()[0] == dt.datetime(2022, 11, 7, 23)


def test_not_a_number_is_missing(frame):
    df = frame([(1.0, 1), (float("nan"), 2), (3.0, None)], "x double, y int")
    assert {r["column"]: r["nulls"] for r in profile.null_profile(df).collect()} == {"x": 1, "y": 1}
    assert profile.widest_range(df, ["x", "y"]).first()["spread"] == 2.0
    assert profile.global_max(df, "x").first()["x"] == 3.0


def test_quantiles_of_infinite_and_very_large_values(frame):
    inf = float("inf")
    df = frame([(v,) for v in (-inf, 1.0, 2.0, 3.0, inf)], "x double")
    assert profile.exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0]) == {("x", 0.0): -inf, ("x", 0.25): 1.0, ("x", 0.5): 2.0, ("x", 0.75): 3.0, ("x", 1.0): inf}
    wide = frame([(v,) for v in (-1.7e308, 0.0, 1.7e308)], "x double")
    assert profile.exact_quantiles(wide, ["x"], [0.5]) == {("x", 0.5): 0.0}


def test_exact_distinct_counts_values(frame):
    df = frame([(0.0, bytearray(b"\xff")), (-0.0, bytearray(b"\xfe")), (1.0, bytearray(b"\xff"))], "x double, b binary")
    assert {r["column"]: r["distinct_values"] for r in profile.column_profile(df, exact=True).collect()} == {"x": 2, "b": 2}


def test_quantiles_take_two_reads(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=20_000), np.full(9_000, 0.25), rng.exponential(100, 5_000)])
    spark.createDataFrame([(float(v), int(i % 7)) for i, v in enumerate(values)], "x double, y int").write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    shares = [0.0, 0.01, 0.25, 0.5, 0.5001, 0.99, 1.0]
    counted = []
    narrowed = profile._narrowed
    monkeypatch.setattr(profile, "_narrowed", lambda frame, *rest: counted.append(frame) or narrowed(frame, *rest))
    want = {("x", p): np.quantile(values, p) for p in shares} | {("y", p): np.quantile(np.arange(len(values)) % 7, p) for p in shares}
    for collected in (50_000, 3):
        monkeypatch.setattr(profile, "COLLECTED", collected)
        got = profile.exact_quantiles(df, ["x", "y"], shares)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-12) for k in want)
    # Nothing was narrowed on the input; the second time, on the counts of the brackets.
    assert len(counted) == 1 and all("counts-" in f for f in counted[0].inputFiles())


def test_a_wrong_bracket_costs_a_pass_but_no_digit(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1000)], "x double")
    moments = profile._moments(df, ["x"], [0.5])
    from pyspark.sql import Row

    wrong = {"x": Row(**(moments["x"].asDict() | {"near": [10.0, 20.0]}))}
    assert profile.exact_quantiles(df, ["x"], [0.5], moments=wrong) == {("x", 0.5): 499.5}


def test_sketches_unite_over_days(spark, tmp_path):
    rows = [(dt.date(2024, 1, 1 + i % 10), i % 50, float(i) if i % 3 else None, f"t{i}", -0.0 if i % 2 else 0.0) for i in range(3000)]
    rows += [(dt.date(2024, 1, 20), None, float("nan"), None, None)]
    df = spark.createDataFrame(rows, "date date, few int, many double, text string, zero double")
    path = f"{tmp_path}/sketches"
    profile.day_sketches(df, ["few", "many", "text", "zero"]).write.partitionBy("date").parquet(path)
    stored = spark.read.parquet(path)
    got = {r["column"]: r for r in profile.range_profile(stored).collect()}
    assert {c: (r["rows"], r["nulls"]) for c, r in got.items()} == {"few": (3001, 1), "many": (3001, 1001), "text": (3001, 1), "zero": (3001, 1)}
    assert (got["few"]["distinct_values"], got["zero"]["distinct_values"]) == (50, 1)
    assert got["many"]["distinct_values"] == pytest.approx(2000, rel=0.03) and got["text"]["distinct_values"] == pytest.approx(3000, rel=0.03)
    part = profile.range_profile(stored, "2024-01-02", "2024-01-03")
    assert {r["column"]: r["rows"] for r in part.collect()} == dict.fromkeys(got, 600)
    assert "PartitionFilters: [isnotnull(date" in part._jdf.queryExecution().executedPlan().toString()
    assert profile.range_profile(stored, "2025-01-01").count() == 0
