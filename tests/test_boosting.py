import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridcast.models import boosting, trees
from gridcast.models.boosting import fit

SCHEMA = "zone string, a double, b double, flag boolean, mw double"
FEATURES = ["a", "b", "flag"]


def quantile(values, p):
    """The smallest value with at least that share of the values at or below it."""
    return values[max(0, math.ceil(p * len(values)) - 1)]


def plain_fit(rows, features, rounds, depth, rate, bins, l2, min_rows):
    """The same trees of one zone by loops over rows: {tree: {node: split}} and base."""
    data = [([None if x is None or x != x else float(x) for x in r[1:-1]], r[-1]) for r in rows if r[-1] is not None and r[-1] == r[-1]]
    cuts = []
    for j in range(len(features)):
        held = sorted(x[j] for x, _ in data if x[j] is not None)
        cuts.append(sorted({quantile(held, i / bins) for i in range(1, bins)}) if held else [])
    base = sum(y for _, y in data) / len(data)
    residual = [y - base for _, y in data]
    grown = {}
    for tree in range(1, rounds + 1):
        splits, at, value = {}, [0] * len(data), [0.0] * len(data)
        for _ in range(depth):
            found = {}
            for node in {n for n in at if n is not None}:
                own = [i for i, n in enumerate(at) if n == node]
                g, n = sum(residual[i] for i in own), len(own)
                options = []
                for j in range(len(features)):
                    gaps = [i for i in own if data[i][0][j] is None]
                    for cut in [*cuts[j], math.inf]:
                        low = [i for i in own if data[i][0][j] is not None and data[i][0][j] <= cut]
                        if not low:
                            continue
                        for missing_left in (True, False) if gaps else (True,):
                            side = low + gaps if missing_left else low
                            gl, nl = sum(residual[i] for i in side), len(side)
                            if nl >= min_rows and n - nl >= min_rows:
                                gain = gl ** 2 / (nl + l2) + (g - gl) ** 2 / (n - nl + l2) - g ** 2 / (n + l2)
                                options.append((-round(gain, 4), j, cut, not missing_left, gl / (nl + l2), (g - gl) / (n - nl + l2)))
                if options and min(options)[0] < 0:
                    found[node] = min(options)
            for i, node in enumerate(at):
                if node in found:
                    _, j, cut, right, low, high = found[node]
                    x = data[i][0][j]
                    left = (not right) if x is None else x <= cut
                    at[i], value[i] = 2 * node + (1 if left else 2), low if left else high
                elif node is not None:
                    at[i] = None
            splits |= found
        grown[tree] = splits
        residual = [r - rate * v for r, v in zip(residual, value)]
    return base, grown


def plain_score(row, base, grown, rate):
    total = base
    for splits in grown.values():
        node, value = 0, 0.0
        while node in splits:
            _, j, cut, right, low, high = splits[node]
            x = row[1 + j]
            left = (not right) if x is None or x != x else float(x) <= cut
            node, value = 2 * node + (1 if left else 2), low if left else high
        total += rate * value
    return total


def some(n, zones=("N", "S"), seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, flag = rng.gauss(0, 1), float(rng.randrange(5)), rng.random() < 0.3
        y = (3.0 if a > 0.4 else -1.0) + b * (1 if flag else -0.5) + rng.gauss(0, 0.1)
        if rng.random() < 0.2:
            a, y = None, y + 6  # a gap tells something
        rows.append((zones[i % len(zones)], a, b if rng.random() < 0.9 else float("nan"), flag if rng.random() < 0.9 else None, y))
    return rows


def test_equals_plain_version(spark, frame):
    rows = some(400) + [("S", 1.0, 1.0, True, None), (None, 1.0, 1.0, True, 5.0), ("S", 1.0, 1.0, True, float("nan"))]
    nodes = fit(frame(rows, SCHEMA), FEATURES, rounds=3, depth=3, rate=0.3, bins=16, min_rows=4)
    by_zone = defaultdict(list)
    for r in nodes.collect():
        by_zone[r.zone].append(r)
    assert set(by_zone) == {"N", "S"}
    for zone, held in by_zone.items():
        base, grown = plain_fit([r for r in rows if r[0] == zone], FEATURES, 3, 3, 0.3, 16, 1.0, 4)
        want = {(t, n): (FEATURES[s[1]], s[2], not s[3], -s[0]) for t, splits in grown.items() for n, s in splits.items()}
        got = {(r.tree, r.node): (r.feature, r.threshold, r.missing_left, r.gain) for r in held if r.feature}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k][:3] == want[k][:3] and got[k][3] == pytest.approx(want[k][3], abs=2e-4)
        assert [r.value for r in held if r.tree == 0] == [pytest.approx(base)]
        assert any(not r.missing_left for r in held) and any(r.feature == "a" for r in held)
    scored = trees.score_trees(frame([r for r in rows if r[0]], SCHEMA), nodes, FEATURES).collect()
    models = {z: plain_fit([r for r in rows if r[0] == z], FEATURES, 3, 3, 0.3, 16, 1.0, 4) for z in by_zone}
    for r in scored:
        assert r.prediction == pytest.approx(plain_score(tuple(r), *models[r.zone], 0.3))


def test_gaps_are_learnt_from(spark, frame):
    df = frame(some(3000, zones=("N",), seed=2), SCHEMA)
    scored = trees.score_trees(df, fit(df, FEATURES, rounds=5, depth=3, rate=0.7), FEATURES)
    error, spread = scored.agg(F.avg(F.abs(F.col("mw") - F.col("prediction"))), F.stddev("mw")).first()
    # A constant would be off by most of the spread.
    assert error < 0.3 * spread
    gaps = scored.filter("a IS NULL").agg(F.avg(F.col("mw") - F.col("prediction"))).first()[0]
    assert abs(gaps) < 0.1 * spread


def test_jobs_and_plans_do_not_follow_the_zones(spark, frame):
    def size(zones):
        df = frame(some(300, zones=tuple(f"z{i}" for i in range(zones))), SCHEMA)
        splits = boosting.best_splits(boosting.walked(df.select("zone", F.array(F.lit(1).cast("short")).alias("bins"), F.col("mw").alias("residual")), None, 0), 1.0, 1)
        return splits._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert size(2) == size(40)
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext

    def jobs(zones, group):
        context.setJobGroup(group, group)
        fit(frame(some(200, zones=tuple(f"z{i}" for i in range(zones))), SCHEMA), FEATURES, rounds=1, depth=2, bins=8)
        context.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(30, "many") <= jobs(2, "few") + 4


def test_odd_inputs(spark, frame):
    empty = fit(frame([], SCHEMA), FEATURES, rounds=1, depth=1)
    assert empty.count() == 0
    flat = [("N", 1.0, None, True, 2.0)] * 20
    assert [(r.tree, r.value) for r in fit(frame(flat, SCHEMA), FEATURES, rounds=2, depth=2).collect()] == [(0, 2.0)]
    # Only gaps differ: the cut is at the one value there is, and the gaps go to the other side.
    gaps = [("N", 1.0, None, None, 2.0)] * 20 + [("N", None, None, None, 8.0)] * 20
    nodes = fit(frame(gaps, SCHEMA), FEATURES, rounds=1, depth=1, rate=1.0, l2=0.0)
    split = nodes.filter("feature IS NOT NULL").collect()
    assert [(r.feature, r.threshold, r.missing_left, r.n) for r in split] == [("a", 1.0, False, 40)]
    scored = trees.score_trees(frame(gaps, SCHEMA), nodes, FEATURES)
    assert scored.filter("abs(prediction - mw) > 1e-9").count() == 0


def test_bins_by_binary_search(spark, frame):
    rows = [("N", float(i), float(i % 7), None, 1.0) for i in range(200)]
    df = frame(rows, SCHEMA)
    for bins in (2, 3, 8, 33, 64):
        cuts = boosting.feature_cuts(df, FEATURES, "mw", bins)
        held = cuts.first()["cuts"]
        got = boosting.with_bins(df, cuts, FEATURES, bins, F.col("a").alias("x"), F.col("b").alias("y")).collect()
        for r in got:
            assert list(r.bins) == [sum(c < r.x for c in held[0]), sum(c < r.y for c in held[1]), None]
