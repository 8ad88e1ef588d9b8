import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.models import forest, trees


def rows_of(spark, n, seed=3, noise=20.0):
    """Rows with a level that hangs on both features; x has more values than bins."""
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 60, n), rng.integers(0, 7, n)
    mw = 10.0 * (x // 5) * (y % 3) + rng.normal(0, noise, n)
    table = pd.DataFrame({"id": np.arange(n), "x": x.astype(float), "y": y.astype(float), "mw": mw})
    return spark.createDataFrame(table)


def predictions(scored):
    return {r["id"]: r["prediction"] for r in scored.select("id", "prediction").collect()}


def jobs_of(spark, run):
    spark.sparkContext.setJobGroup(name := f"jobs-{id(run)}", name)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_grow_neither_with_trees_nor_with_rounds(spark, monkeypatch):
    # The learner has a job or more for each level, and again for every two trees with so few nodes.
    monkeypatch.setattr(trees, "FOREST_NODES", 2100)
    rows = rows_of(spark, 6000)
    few = jobs_of(spark, lambda: trees.fit_forest(rows, ["x", "y"], "mw", ["id"], trees=2).collect())
    many = jobs_of(spark, lambda: trees.fit_forest(rows, ["x", "y"], "mw", ["id"], trees=20).collect())
    assert many <= few + 2


def test_the_forest_predicts_like_the_learner(spark, monkeypatch):
    rows = rows_of(spark, 6000)
    own = trees.fit_forest(rows, ["x", "y"], "mw", ["id"], trees=40)
    monkeypatch.setattr(trees, "LEARNER_ROWS", 10**9)
    other = trees.fit_forest(rows, ["x", "y"], "mw", ["id"], trees=40)
    assert own.schema.simpleString() == other.schema.simpleString()
    got, want = predictions(own), predictions(other)
    assert got.keys() == want.keys() and len(got) > 1000
    gap = np.array([got[i] - want[i] for i in want])
    # A cell has about 14 rows of deviation 20, so its mean has a deviation of 5; two forests are far closer than that.
    assert np.sqrt((gap**2).mean()) < 1.5
    errors = [frame.agg(F.avg(F.abs(F.col("mw") - F.col("prediction")))).first()[0] for frame in (own, other)]
    assert errors[0] == pytest.approx(errors[1], rel=0.02)


def test_equal_seeds_give_equal_forests_wherever_the_rows_lie(spark):
    rows = rows_of(spark, 4000)
    one = predictions(trees.fit_forest(rows, ["x", "y"], "mw", ["id"], trees=3))
    two = predictions(trees.fit_forest(rows.repartition(5, "y"), ["x", "y"], "mw", ["id"], trees=3, partitions=3))
    assert one.keys() == two.keys()
    assert max(abs(one[i] - two[i]) for i in one) < 1e-8


def test_incomplete_rows_are_left_out_and_a_missing_target_is_an_error(spark):
    rows = rows_of(spark, 4000)
    gaps = rows.withColumn("x", F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 == 1, float("nan")).otherwise(F.col("x")))
    scored = trees.fit_forest(gaps.filter("id % 10 <> 1"), ["x", "y"], "mw", ["id"], trees=2)
    assert scored.count() > 500 and scored.filter("id % 10 = 0 or prediction is null").count() == 0
    # A test row needs no target, a training row does.
    split = trees.random_split(rows, ["id"])
    blind = split.withColumn("mw", F.when(F.col("test") == 0, F.col("mw"))).drop("test")
    assert trees.fit_forest(blind, ["x", "y"], "mw", ["id"], trees=2).filter("prediction is not null").count() > 500
    with pytest.raises(Exception, match="Labels MUST NOT be Null or NaN"):
        trees.fit_forest(rows.withColumn("mw", F.when(F.col("id") > 9, F.col("mw"))), ["x", "y"], "mw", ["id"], trees=2).collect()


def test_keys_and_rows_may_repeat(spark):
    rows = rows_of(spark, 2000).withColumn("id", F.col("id") % 500)
    twice = rows.unionAll(rows)
    scored = trees.fit_forest(twice, ["x", "y"], "mw", ["id"], trees=2)
    assert scored.count() == trees.random_split(twice, ["id"]).filter("test = 1").count() > 500


def test_more_cells_than_a_task_holds_go_to_the_learner(spark, monkeypatch):
    learner, seen = trees.RandomForestRegressor, []

    def noted(**options):
        seen.append(options["numTrees"])
        return learner(**options)

    monkeypatch.setattr(trees, "RandomForestRegressor", noted)
    rows = rows_of(spark, 4000)
    trees.fit_forest(rows, ["x", "y"], "mw", ["id"], trees=2)
    assert not seen
    monkeypatch.setattr(forest, "MAX_CELLS", 100)
    assert trees.fit_forest(rows, ["x", "y"], "mw", ["id"], trees=2, depth=3).count() > 500
    assert sum(seen) == 2


def plain_tree(bins, weight, total, rows, depth, value):
    """The same tree, one node at a time."""
    w, s = weight[rows].sum(), total[rows].sum()
    value[rows] = s / w
    best = (1e-12, None)
    for f in range(bins.shape[1] if depth else 0):
        for cut in range(forest.BINS):
            left = rows[bins[rows, f] <= cut]
            a, b = weight[left].sum(), total[left].sum()
            if 0 < a < w and (gain := b * b / a + (s - b) ** 2 / (w - a) - s * s / w) > best[0] * (1 + 1e-9):
                best = (gain, (f, cut))
    if best[1]:
        f, cut = best[1]
        plain_tree(bins, weight, total, rows[bins[rows, f] <= cut], depth - 1, value)
        plain_tree(bins, weight, total, rows[bins[rows, f] > cut], depth - 1, value)


@pytest.mark.parametrize("depth", [0, 1, 4, 30])
def test_a_tree_is_the_one_grown_node_by_node(depth):
    rng = np.random.default_rng(8)
    for _ in range(10):
        codes = np.unique(rng.integers(0, 32 * 5 * 3, 150))
        bins = forest.bins_of(codes, [32, 5, 3])
        assert (codes == (bins[:, 0].astype(int) * 5 + bins[:, 1]) * 3 + bins[:, 2]).all()
        weight = rng.poisson(1.0, len(codes)).astype(float)
        total = weight * rng.normal(0, 100, len(codes))
        want = np.zeros(len(codes))
        plain_tree(bins, weight, total, np.arange(len(codes)), depth, want)
        assert forest.grow_tree(bins, weight, total, depth) == pytest.approx(want)


def test_draws_are_poisson_and_one_for_each_row():
    code, target = np.arange(20_000), np.sin(np.arange(20_000.0))
    for mean in (1, 7, 5000):
        drawn = forest.draws(code, target, np.full(len(code), mean), 10, 42)
        assert drawn.mean() == pytest.approx(mean, rel=0.01) and drawn.var() == pytest.approx(mean, rel=0.03)
        # Trees, and rows, draw on their own.
        assert abs(np.corrcoef(drawn.T)[~np.eye(10, dtype=bool)]).max() < 0.04
        assert abs(np.corrcoef(drawn[:-1, 0], drawn[1:, 0])[0, 1]) < 0.04
    one, other = (forest.draws(code, target, np.ones(len(code), int), 10, seed) for seed in (42, 43))
    assert (one == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    assert abs(np.corrcoef(one.ravel(), other.ravel())[0, 1]) < 0.02


def test_sums_of_a_cell_that_comes_in_parts(monkeypatch):
    monkeypatch.setattr(forest, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(forest, "CELLS_AT_ONCE", 5)
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"__cell": np.sort(rng.integers(10, 30, 100)), "__target": rng.normal(50, 9, 100), "__n": rng.integers(1, 4, 100)})
    codes = np.arange(10, 30)
    drawn = forest.draws(rows["__cell"].to_numpy(), rows["__target"].to_numpy(), rows["__n"].to_numpy(), 3, 1)
    found = pd.concat(forest.bootstrap_sums(iter([rows[:40], rows[40:]]), codes, 50.0, 3, 1))
    for tree, parts in found.groupby("tree"):
        at, weight, total = (np.frombuffer(b"".join(parts[c]), kind) for c, kind in (("cells", np.int32), ("weights", np.int64), ("sums", float)))
        place = rows["__cell"].to_numpy() - 10
        assert (np.bincount(at, weight, 20) == np.bincount(place, drawn[:, tree], 20)).all()
        assert np.bincount(at, total, 20) == pytest.approx(np.bincount(place, drawn[:, tree] * (rows["__target"].to_numpy() - 50.0), 20))


def test_cuts_part_few_values_all_and_many_evenly(spark):
    rng = np.random.default_rng(2)
    few, many = rng.permutation(np.r_[np.zeros(19_999), 5.0]), rng.normal(0, 1, 20_000)
    # Mostly zero, like rain: what is not zero is still told apart.
    rain = np.where(rng.random(20_000) < 0.9, 0.0, rng.integers(1, 200, 20_000))
    rows = spark.createDataFrame(pd.DataFrame({"few": few, "many": many, "rain": rain, "same": 1.0}))
    cuts = dict(zip(names := ["few", "many", "rain", "same"], forest.thresholds(rows, names)))
    assert cuts["few"].tolist() == [2.5] and len(cuts["same"]) == 0
    assert len(cuts["many"]) == 31
    counts = np.bincount(np.searchsorted(cuts["many"], many))
    assert counts.min() > 550 and counts.max() < 700
    assert len(cuts["rain"]) > 20 and cuts["rain"][0] == 0.5
    code = rows.select("few", forest.cell(["few", "same"], [cuts["few"], cuts["same"]]).alias("c")).distinct().collect()
    assert {(r.few, r.c) for r in code} == {(0.0, 0), (5.0, 1)}
