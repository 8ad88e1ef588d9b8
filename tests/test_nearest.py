import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.operators import nearest
from gridcast.operators.nearest import nearest_zone
from gridcast.session import materialize

SITES, POINTS = "site_order int, zone string, lat double, long double", "id int, lat double, long double"


def brute(point, sites):
    _, lat, long = point
    distance, order, zone = min((abs(lat - a) + abs(long - b), i, z) for i, z, a, b in sites)
    return zone, distance


@pytest.mark.parametrize("n, spread", [(20, 12), (300, 12), (500, 1000)])
def test_equals_brute_force_with_ties(frame, n, spread):
    rng = np.random.default_rng(n)
    sites = [(i, f"z{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, spread, (n, 2)))]
    points = [(i, float(a) / 2, float(b) / 2) for i, (a, b) in enumerate(rng.integers(-10, 2 * spread + 10, (200, 2)))]
    got = {r["id"]: (r["zone"], r["distance"]) for r in nearest_zone(frame(points, POINTS), frame(sites, SITES), "id").collect()}
    assert got == {p[0]: brute(p, sites) for p in points}


def test_points_and_sites_in_tight_clusters(frame):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [1e6, 1e6], [1e6, 1e6 + 1], [-1e300, 1e300]])
    sites = [(i, f"z{i}", *map(float, centres[i % 4] + rng.normal(0, 1e-3, 2))) for i in range(400)]
    points = [(i, *map(float, centres[i % 4] + rng.normal(0, 10.0 ** (i % 5 - 3), 2))) for i in range(80)]
    got = {r["id"]: (r["zone"], r["distance"]) for r in nearest_zone(frame(points, POINTS), frame(sites, SITES), "id").collect()}
    assert got == {p[0]: brute(p, sites) for p in points}


def test_many_sites_at_one_place_and_many_points_at_one(frame):
    sites = [(i, f"z{i}", 5.0, 5.0) for i in range(500, 0, -1)] + [(1000 + i, f"y{i}", float(i), 0.0) for i in range(100)]
    points = [(i, 5.0, 4.0) for i in range(300)] + [(300, 5.0, 1.0)]
    got = {r["id"]: r["zone"] for r in nearest_zone(frame(points, POINTS), frame(sites, SITES), "id").collect()}
    assert len(got) == 301 and set(got.values()) == {"z1", "y5"} and got[300] == "y5"


def test_without_coordinates(frame):
    nan, inf = float("nan"), float("inf")
    sites = frame([(0, "A", None, 1.0), (1, "B", 0.0, 0.0), (2, "C", nan, 0.0), (3, "D", inf, 0.0)], SITES)
    points = frame([(1, 0.0, 1.0), (2, None, 1.0), (3, nan, 0.0), (4, inf, 0.0), (1, 0.0, 1.0)], POINTS)
    got = sorted((r["id"], r["zone"], r["distance"]) for r in nearest_zone(points, sites, "id").collect())
    assert got == [(1, "B", 1.0), (1, "B", 1.0), (2, None, None), (3, None, None), (4, None, None)]
    none = nearest_zone(points, sites.filter("false"), "id")
    assert {r["zone"] for r in none.collect()} == {None}
    assert nearest_zone(points.filter("false"), sites, "id").count() == 0


def test_a_million_sites(spark):
    """Half of them in one small cluster; points inside it, near it and far away."""
    n = 1_000_000
    sites = spark.range(n).select(
        F.col("id").alias("site_order"), F.col("id").cast("string").alias("zone"),
        *[(F.when(F.col("id") % 2 == 0, 0.5 + (F.rand(seed) - 0.5) * 1e-4).otherwise(F.rand(seed))).alias(name) for name, seed in (("lat", 1), ("long", 2))])
    sites = spark.createDataFrame(sites.toPandas())
    rng = np.random.default_rng(3)
    places = np.concatenate([rng.uniform(-0.5, 1.5, (100, 2)), 0.5 + rng.uniform(-1e-4, 1e-4, (100, 2)), 0.5 + rng.uniform(-1e-2, 1e-2, (100, 2))])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], POINTS)
    pairs = materialize(nearest.compared(points.select("lat", "long"), sites), "pairs")
    assert pairs.count() < 300 * 400
    held = sites.toPandas()
    lat, long = held["lat"].to_numpy(), held["long"].to_numpy()
    best = pairs.groupBy("lat", "long").agg(F.min(F.struct("distance", "site_order")).alias("best"))
    got = {r["id"]: (r["best"]["site_order"], r["best"]["distance"]) for r in points.join(best, ["lat", "long"]).collect()}
    for i, (a, b) in enumerate(places):
        distance = np.abs(a - lat) + np.abs(b - long)
        assert got[i] == (int(distance.argmin()), distance.min())
