import datetime as dt

from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.models import evaluate, linear, response, trees
from gridcast.models.dispatch import ModelRegistry
from gridcast.sources import model_store

FEATURES = ["temp", "rh", "rain"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    rows = []
    for zone, (b0, b) in {"AE": (10.0, [2.0, -1.0, 30.0]), "DOM": (-5.0, [0.5, 4.0, 0.0])}.items():
        x = np.column_stack([rng.normal(50, 15, 300), rng.uniform(0, 100, 300), rng.random(300) < 0.3])
        y = b0 + x @ b
        rows += [(zone, float(r[0]), float(r[1]), bool(r[2]), float(v), int(i % 5 == 0)) for i, (r, v) in enumerate(zip(x, y))]
    rows.append(("AE", None, 1.0, True, 1e9, 0))
    return spark.createDataFrame(rows, "zone string, temp double, rh double, rain boolean, mw double, test int")


def coefficients(models):
    return {r["zone"]: (r["intercept"], list(r["coefficients"]), r["n"], list(r["features"])) for r in models.collect()}


def test_fit_recovers_planted_coefficients(planted):
    got = coefficients(linear.fit(planted.filter("test = 0"), FEATURES))
    assert got["AE"][0] == pytest.approx(10.0, abs=1e-8) and got["AE"][1] == pytest.approx([2.0, -1.0, 30.0], abs=1e-9)
    assert got["DOM"][1] == pytest.approx([0.5, 4.0, 0.0], abs=1e-9)
    assert got["AE"][2:] == (240, FEATURES)


def test_constant_and_repeated_features_do_not_fail(planted):
    df = planted.withColumns({"one": F.lit(1.0), "again": F.col("temp") * 2})
    got = coefficients(linear.fit(df, ["temp", "rh", "rain", "one", "again"]))["AE"]
    assert got[1][3] == 0.0
    assert got[1][0] + 2 * got[1][4] == pytest.approx(2.0, abs=1e-8)
    assert np.isfinite(got[0])


def test_large_offsets_keep_their_digits(frame):
    rng = np.random.default_rng(0)
    x = 1e7 + rng.normal(0, 1, 200)
    rows = [("AE", float(v), float(3.0 * (v - 1e7))) for v in x]
    got = coefficients(linear.fit(frame(rows, "zone string, x double, mw double"), ["x"]))["AE"]
    assert got[1][0] == pytest.approx(3.0, rel=1e-6)


def test_store_predict_and_mape(spark, planted, tmp_path):
    model_store.save_linear(linear.fit(planted.filter("test = 0"), FEATURES), str(tmp_path / "m"))
    models = model_store.load_linear(spark, str(tmp_path / "m"))
    test = planted.filter("test = 1")
    scored = linear.predict(test, models, FEATURES)
    assert scored.columns == [*sorted(test.columns, key=scored.columns.index), "prediction"]
    for r in scored.collect():
        assert r["prediction"] == pytest.approx(r["mw"], abs=1e-6)
    assert {r["zone"] for r in evaluate.mape_by_zone(scored).filter("mape < 1e-6").collect()} == {"AE", "DOM"}
    unknown = linear.predict(test.withColumn("zone", F.lit("XX")), models, FEATURES)
    assert {r["prediction"] for r in unknown.collect()} == {None}


def test_predict_point_uses_the_first_model(frame, planted):
    point = frame([(55.0, 83.0, False)], "temp double, rh double, rain boolean")
    point = point.withColumn("rain", F.col("rain").cast("int"))
    models = linear.fit(planted.filter("test = 0"), FEATURES)
    row = linear.predict_point(point, models, FEATURES).first()
    assert row["zone"] == "AE" and row["prediction"] == pytest.approx(10 + 110 - 83, abs=1e-6)


def test_vif_matches_the_regression_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(10, 3, (200, 3))
    x[:, 2] = x[:, 0] + rng.normal(0, 0.5, 200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = {r["feature"]: r["vif"] for r in linear.vif(df, ["a", "b", "c"]).collect()}
    for i, name in enumerate("abc"):
        others = np.delete(x, i, axis=1)
        fitted = others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        share = 1 - ((x[:, i] - fitted) ** 2).sum() / (x[:, i] ** 2).sum()
        assert got[name] == pytest.approx(1 / (1 - share), rel=1e-8)


def test_mape_skips_and_counts_zero_loads(frame):
    df = frame([("AE", 0.0, 1.0), ("AE", 10.0, 9.0), ("AE", 8.0, None), ("AP", 0.0, 1.0)], "zone string, mw double, prediction double")
    got = {r["zone"]: (r["mape"], r["mape_pct"], r["skipped"], r["unscored"]) for r in evaluate.mape_by_zone(df).collect()}
    assert got["AE"] == (pytest.approx(0.1), pytest.approx(10.0), 1, 1) and got["AP"] == (None, None, 1, 0)
    assert evaluate.mean_absolute_error(df, "mw", "prediction").first()["mae"] == 1.0


def test_random_split_is_stable_and_near_its_share(spark):
    df = spark.range(20000)
    one = evaluate.random_split(df.repartition(7), ["id"])
    two = evaluate.random_split(df.repartition(3), ["id"])
    assert one.agg(F.avg("test")).first()[0] == pytest.approx(0.2, abs=0.01)
    assert one.exceptAll(two).count() == 0
    assert evaluate.random_split(df, ["id"], seed=1).exceptAll(one).count() > 0
    assert evaluate.random_split(df, ["id"], test_share=0.0).agg(F.sum("test")).first()[0] == 0
    assert evaluate.random_split(df, ["id"], test_share=1.0).agg(F.sum("test")).first()[0] == 20000


def test_scaling_uses_population_deviation_of_train(frame):
    train = frame([(1.0, 7.0), (3.0, 7.0)], "x double, c double")
    got = evaluate.standard_scale(train, frame([(5.0, 8.0)], "x double, c double"), ["x", "c"]).first()
    assert (got["x"], got["c"]) == (3.0, 1.0)


NODES = "zone string, tree int, node int, feature string, threshold double, left int, right int, missing_left boolean, value double, weight double"


@pytest.fixture
def hand_made(frame):
    rows = [
        ("AE", 0, 0, "x", 10.0, 1, 2, False, 0.0, 1.0), ("AE", 0, 1, None, None, None, None, True, 1.0, 1.0),
        ("AE", 0, 2, "y", 5.0, 3, 4, True, 0.0, 1.0), ("AE", 0, 3, None, None, None, None, True, 20.0, 1.0),
        ("AE", 0, 4, None, None, None, None, True, 300.0, 1.0),
        ("AE", 1, 0, None, None, None, None, True, 4000.0, 0.5),
        ("AP", 0, 0, None, None, None, None, True, 7.0, 1.0),
    ]
    return frame(rows, NODES)


@pytest.mark.parametrize("score", [trees.score_trees, partial(trees.score_trees_grouped, rows_per_group=2)])
def test_trees_with_nulls_thresholds_and_unknown_zones(frame, hand_made, score):
    rows = [(1, "AE", 10.0, 9.0), (2, "AE", 11.0, 5.0), (3, "AE", 11.0, 6.0), (4, "AE", None, 6.0), (5, "AE", 11.0, None),
            (6, "AP", None, None), (7, "XX", 1.0, 1.0), (8, None, 1.0, 1.0)]
    df = frame(rows, "id int, zone string, x double, y double")
    scored = score(df, hand_made, ["x", "y"])
    assert scored.columns == ["id", "zone", "x", "y", "prediction"]
    got = {r["id"]: r["prediction"] for r in scored.collect()}
    assert got == {1: 2001.0, 2: 2020.0, 3: 2300.0, 4: 2300.0, 5: 2020.0, 6: 7.0, 7: None, 8: None}
    strict = {r["id"]: r["prediction"] for r in score(df, hand_made, ["x", "y"], inclusive=False).collect()}
    assert strict[1] == 2300.0 and strict[2] == 2300.0


def test_stored_boosted_models_score_like_the_models(spark, planted, tmp_path):
    df = planted.na.drop().withColumn("rain", F.col("rain").cast("double"))
    models = trees.fit_boosted(df, ["AE", "DOM"], FEATURES, "mw", rounds=3, depth=3)
    model_store.save_tree_models(models, str(tmp_path / "b"))
    nodes = model_store.load_trees(spark, str(tmp_path / "b"), FEATURES)
    got = trees.score_trees(df, nodes, FEATURES)
    for zone, model in models.items():
        want = model.transform(trees.assemble(df.filter(F.col("zone") == zone), FEATURES)).select("mw", F.col("prediction").alias("want"))
        both = got.filter(F.col("zone") == zone).join(want, "mw")
        assert both.count() > 0
        assert both.filter("abs(prediction - want) > 1e-6").count() == 0


def test_forest_learns_the_planted_zone(planted):
    rows = planted.filter("zone = 'DOM'").drop("test").withColumn("rain", F.col("rain").cast("int"))
    scored = trees.fit_forest(rows, FEATURES, "mw", ["temp", "rh"], trees=20)
    spread = rows.agg(F.stddev("mw")).first()[0]
    assert evaluate.mean_absolute_error(scored, "mw", "prediction").first()["mae"] < spread / 2


def test_unknown_model_name_is_an_error(planted):
    registry = ModelRegistry()
    registry.register("same", lambda df: df)
    assert registry.score("same", planted) is planted
    with pytest.raises(ValueError, match="Not implemented"):
        registry.score("other", planted)


def respond(order, n=200, dt_hours=1.0):
    """Exact samples of a response to an input held between samples."""
    rng = np.random.default_rng(4)
    u = rng.normal(0, 1, n).round(3)
    if order == 1:
        k, tau = 2.5, 6.0
        a = np.exp(-dt_hours / tau)
        y = np.zeros(n)
        for t in range(1, n):
            y[t] = a * y[t - 1] + k * (1 - a) * u[t - 1]
        return u, y, {"k": k, "tau": tau}
    k, wn, zeta = 1.5, 0.4, 0.3
    A = np.array([[0, 1], [-wn**2, -2 * zeta * wn]])
    B = np.array([0, k * wn**2])
    values, vectors = np.linalg.eig(A)
    step = (vectors @ np.diag(np.exp(values * dt_hours)) @ np.linalg.inv(vectors)).real
    push = np.linalg.solve(A, (step - np.eye(2)) @ B)
    state, y = np.zeros(2), np.zeros(n)
    for t in range(1, n):
        state = step @ state + push * u[t - 1]
        y[t] = state[0]
    return u, y, {"k": k, "wn": wn, "zeta": zeta}


@pytest.mark.parametrize("order, fit", [(1, response.first_order), (2, response.second_order)])
def test_responses_recover_planted_constants(frame, order, fit):
    u, y, want = respond(order)
    start = dt.datetime(2022, 1, 1)
    rows = [("AE", start + dt.timedelta(hours=i), float(a), float(b)) for i, (a, b) in enumerate(zip(u, y))]
    rows += [("FLAT", start + dt.timedelta(hours=i), 0.0, 0.0) for i in range(10)]
    df = frame(rows, "zone string, ds timestamp_ntz, u double, y double")
    got = {r["zone"]: r.asDict() for r in fit(df, "u", "y", block_rows=30).collect()}
    for name, value in want.items():
        assert got["AE"][name] == pytest.approx(value, rel=1e-6)
        assert got["FLAT"][name] is None


def test_growing_response_has_no_constants(frame):
    start = dt.datetime(2022, 1, 1)
    rows = [("AE", start + dt.timedelta(hours=i), float(i % 3), float(1.2**i)) for i in range(30)]
    df = frame(rows, "zone string, ds timestamp_ntz, u double, y double")
    row = response.first_order(df, "u", "y").first()
    assert row["a"] == pytest.approx(1.2) and row["tau"] is None and row["k"] is None


def test_zone_names_with_pattern_characters(spark, frame, tmp_path):
    zone = "A[1]*"
    df = frame([(z, float(i), float(i % 3)) for z in (zone, "7") for i in range(30)], "zone string, x double, mw double")
    models = trees.fit_boosted(df, [zone, "7"], ["x"], "mw", rounds=2, depth=2)
    model_store.save_tree_models(models, str(tmp_path / "m"))
    nodes = model_store.load_trees(spark, str(tmp_path / "m"), ["x"])
    assert {r["zone"] for r in nodes.select("zone").distinct().collect()} == {zone, "7"}


def test_the_forest_query_grows_full_trees(spark, tmp_path, monkeypatch):
    from gridcast.bindings import common, model_queries

    rng = np.random.default_rng(4)
    # An own level for each of 2,048 cells: trees of at most 1,024 leaves blur them, full ones do not.
    level = rng.permutation(2048).astype(float)
    rows = [(i, n, "RF", float(i % 16), float(i // 16 % 16), float(i // 256), 1, float(level[i]), 0) for i in range(2048) for n in range(6)]
    table = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, zone string, quantity double, discount double, tax double, month int, mw double, test int")
    fit, seen = trees.fit_forest, {}

    def fewer_trees(*args, **options):
        seen["scored"] = fit(*args, trees=5, **options)
        return seen["scored"]

    monkeypatch.setattr(common, "train", lambda spark, d: table)
    monkeypatch.setattr(trees, "fit_forest", fewer_trees)
    result = model_queries.random_forest(spark, str(tmp_path)).first()
    own = seen["scored"].agg(F.avg(F.abs(F.col("mw") - F.col("prediction")))).first()[0]
    assert result["near_mean"] and own < 0.2 * result["mean_error"]


def test_the_forest_is_grown_some_trees_at_a_time(frame, monkeypatch):
    rng = np.random.default_rng(9)
    rows = frame([(i, float(a), float(b), float(3 * a + b)) for i, (a, b) in enumerate(rng.integers(0, 16, (1200, 2)))], "id long, x double, y double, mw double")
    learner, seen = trees.RandomForestRegressor, []

    def noted(**options):
        seen.append(options)
        return learner(**options)

    monkeypatch.setattr(trees, "RandomForestRegressor", noted)
    whole = trees.fit_forest(rows, ["x", "y"], "mw", ["id"], trees=10)
    assert [o["numTrees"] for o in seen] == [10] and seen.pop()["maxMemoryInMB"] <= 256
    # At most 256 different rows, so 512 nodes a tree, and a little more or less as they are estimated.
    monkeypatch.setattr(trees, "FOREST_NODES", 2100)
    parts = trees.fit_forest(rows, ["x", "y"], "mw", ["id"], trees=10)
    sizes = [o["numTrees"] for o in seen]
    assert sum(sizes) == 10 and max(sizes) <= 5 and len({o["seed"] for o in seen}) == len(seen)
    assert parts.columns == whole.columns
    want, got = ({r.id: r.prediction for r in f.collect()} for f in (whole, parts))
    assert want.keys() == got.keys() and len(got) > 100
    assert max(abs(want[i] - got[i]) for i in want) < 6
    assert evaluate.mean_absolute_error(parts, "mw", "prediction").first()["mae"] < 1.5
