import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.models import linear
from gridcast.sources import moment_store

FEATURES = ["a", "b", "flag"]
SCHEMA = "zone string, date date, a double, b double, flag boolean, mw double"


def rows_of(n=600, offset=0.0, seed=1):
    import datetime

    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        zone = "NSW"[i % 3]
        a, b, flag = rng.normal() + offset, rng.normal(3, 2), bool(rng.random() < 0.4)
        y = {"N": 2.0, "S": -1.0, "W": 0.5}[zone] * (a - offset) + 0.25 * b + 3 * flag + 7 + offset + rng.normal(0, 0.01)
        out.append((zone, datetime.date(2024, 1, 1 + i * 10 // n), a, b, flag, y))
    return out


def coefficients(models):
    return {r.zone: (r.n, [*r.coefficients, r.intercept]) for r in models.collect()}


@pytest.mark.parametrize("offset", [0.0, 1e7])
def test_merged_moments_fit_as_all_rows_do(frame, offset):
    df = frame(rows_of(offset=offset), SCHEMA)
    want = coefficients(linear.fit(df, FEATURES))
    got = coefficients(linear.fit_moments(linear.merge_moments(linear.moments(df, FEATURES, "mw", by=["date"]), 3), FEATURES))
    assert got.keys() == want.keys()
    for zone, (n, values) in want.items():
        assert got[zone][0] == n and np.allclose(got[zone][1][:3], values[:3], rtol=1e-6, atol=1e-6)
        assert got[zone][1][3] == pytest.approx(values[3], rel=1e-6)
    assert got["N"][1][0] == pytest.approx(2.0, abs=0.01)


def test_days_come_one_after_another(spark, frame, tmp_path):
    path, rows = f"{tmp_path}/days", rows_of()
    df = frame(rows, SCHEMA)
    moment_store.write_days(df.filter("date < '2024-01-06'"), path, FEATURES)
    early = coefficients(moment_store.fit_days(spark, path, FEATURES))
    assert sum(n for n, _ in early.values()) == df.filter("date < '2024-01-06'").count()
    # A wrong day, then the same day again as it should be, and the rest.
    moment_store.write_days(df.filter("date = '2024-01-06'").withColumn("mw", F.lit(0.0)), path, FEATURES)
    moment_store.write_days(df.filter("date >= '2024-01-06'"), path, FEATURES)
    want, got = coefficients(linear.fit(df, FEATURES)), coefficients(moment_store.fit_days(spark, path, FEATURES))
    for zone in want:
        assert got[zone][0] == want[zone][0] and np.allclose(got[zone][1], want[zone][1], atol=1e-9)
    some = moment_store.read_days(spark, path, FEATURES, "2024-01-02", "2024-01-03")
    assert {str(r.date) for r in some.select("date").distinct().collect()} == {"2024-01-02", "2024-01-03"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-01-0" in plan or "date#" in plan


def test_gaps_and_other_features(spark, frame, tmp_path):
    path = f"{tmp_path}/days"
    rows = rows_of(60) + [("N", None, None, 1.0, True, 2.0), ("Z", rows_of(1)[0][1], 1.0, 1.0, True, None)]
    moment_store.write_days(frame(rows, SCHEMA), path, FEATURES)
    assert set(coefficients(moment_store.fit_days(spark, path, FEATURES))) == {"N", "S", "W"}
    with pytest.raises(Exception, match="other features"):
        moment_store.fit_days(spark, path, ["b", "a", "flag"]).collect()
