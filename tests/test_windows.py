import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.operators import windows


def history(rng, zone, n, gaps=True):
    start = dt.datetime(2022, 1, 1)
    steps = rng.integers(1, 6 if gaps else 2, n).cumsum()
    return [(zone, start + dt.timedelta(hours=int(s)), float(rng.integers(1, 100)), float(rng.integers(0, 90))) for s in steps]


@pytest.mark.parametrize("block_rows", [1, 7, 50, 8192])
def test_lags_match_pandas_with_gaps_and_one_large_zone(frame, block_rows):
    rng = np.random.default_rng(3)
    rows = history(rng, "BIG", 600) + history(rng, "AE", 60) + history(rng, "AP", 3)
    df = frame(rows, "zone string, ds timestamp_ntz, mw double, temp double")
    lags = {"m48": ("mw", 48), "t24": ("temp", 24), "m1": ("mw", 1)}
    got = windows.lag_rows(df, "ds", lags, block_rows=block_rows).toPandas().sort_values(["zone", "ds"]).reset_index(drop=True)

    want = pd.DataFrame(rows, columns=["zone", "ds", "mw", "temp"]).sort_values(["zone", "ds"]).reset_index(drop=True)
    by = want.groupby("zone")
    want["m48"], want["t24"], want["m1"] = by["mw"].shift(48), by["temp"].shift(24), by["mw"].shift(1)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def test_lag_by_another_order_column(frame):
    df = frame([("a", i, float(i)) for i in range(10)], "zone string, n int, mw double")
    got = windows.lag_rows(df, "n", {"p": ("mw", 2)}, bucket=F.floor(F.col("n") / 3), block_rows=4).orderBy("n").collect()
    assert [r["p"] for r in got] == [None, None] + [float(i) for i in range(8)]


def test_lag_features_drop_before_and_after(frame):
    start = dt.datetime(2022, 1, 1)
    rows = [("AE", start + dt.timedelta(hours=h), None if h == 5 else float(h), 50.0) for h in range(60)]
    got = windows.lag_features(frame(rows, "zone string, ds timestamp_ntz, mw double, temp double")).orderBy("ds").collect()
    # 59 complete rows, the first 48 of them have no earlier load.
    assert len(got) == 11
    # The dropped hour makes 48 rows back one hour more for the first of them.
    assert (got[0]["mw"], got[0]["previous_mw"]) == (49.0, 0.0)


def test_hour_delta_is_null_at_the_start_and_after_a_gap(frame):
    totals = frame([("d", 0, 5.0), ("d", 1, 7.0), ("d", 3, 4.0), ("e", 0, 1.0), ("e", 1, 0.5)], "date string, hour int, mw double")
    got = {(r["date"], r["hour"]): r["delta_mw"] for r in windows.hour_delta(totals, ["date"]).collect()}
    assert got == {("d", 0): None, ("d", 1): 2.0, ("d", 3): None, ("e", 0): None, ("e", 1): -0.5}


def test_table_calc_difference_uses_the_mark_before(frame):
    rows = frame([("a", 0, 1.0), ("a", 0, 2.0), ("a", 3, 10.0), ("b", 1, 4.0)], "zone string, hour int, hourly_mw double")
    got = {(r["zone"], r["hour"]): r["difference"] for r in windows.table_calc_difference(rows).collect()}
    assert got == {("a", 0): None, ("a", 3): 7.0, ("b", 1): None}


def test_lag_keeps_rows_without_key_or_time(frame):
    rows = [("A", dt.datetime(2022, 1, 1, h), float(h), 0.0) for h in range(3)] + [(None, dt.datetime(2022, 1, 1, h), float(h), 0.0) for h in range(2)] + [("A", None, 9.0, 0.0)]
    got = windows.lag_one(frame(rows, "zone string, ds timestamp_ntz, mw double, temp double")).collect()
    assert len(got) == 6
    assert {(r["zone"], r["ds"] and r["ds"].hour): r["previous_mw"] for r in got} == {
        ("A", None): None, ("A", 0): 9.0, ("A", 1): 0.0, ("A", 2): 1.0, (None, 0): None, (None, 1): 0.0}
