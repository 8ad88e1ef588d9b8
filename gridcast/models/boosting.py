"""Boosted trees of every zone at once, from histograms, on rows with gaps.

Features are cut into bins once, at quantiles of their zone. Then trees grow level by level, all zones and all nodes of a
level in one aggregate: sums of residuals by (zone, node, feature, bin), reduced before the shuffle, so that what is moved
depends on zones and bins and not on rows, however many rows a zone has. A window over the bins of a feature turns them into the
gain of every cut, with the missing values on either side; the best cut of a node, with the side that its missing values
take, is the node's split. After a tree the residuals are written anew; the number of jobs follows rounds and depth, never the zones.

The result is a table with one row per node, which :func:`gridcast.models.trees.score_trees` reads. A missing value is a null or
a not-a-number; a split may part all values from the missing ones, its threshold is then infinite. Rows without zone or target take
no part in the fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.session import materialize

BINS = 64
#: Of the quantiles at which features are cut: one part in so many of a zone's rows.
ACCURACY = 10_000
GAIN_DIGITS = 4


def _value(name: str) -> Column:
    number = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(number), number)


def feature_cuts(df: DataFrame, features: Sequence[str], target: str, bins: int = BINS) -> DataFrame:
    """Per zone: base (mean target) and cuts, an array per feature of ascending values at which it may be split."""
    places = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    cuts = [F.coalesce(F.array_distinct(F.percentile_approx(_value(f), places, ACCURACY)), F.array().cast("array<double>")) for f in features]
    rows = df.filter(F.col("zone").isNotNull() & _value(target).isNotNull())
    return rows.groupBy("zone").agg(F.avg(_value(target)).alias("base"), F.array(*cuts).alias("cuts"))


def with_bins(df: DataFrame, cuts: DataFrame, features: Sequence[str], bins: int, *keep: Column) -> DataFrame:
    """zone, bins (per feature the number of cuts below the value, null if it is missing), base, and ``keep``."""
    names = range(len(features))
    rows = df.select("zone", *keep, *[_value(f).alias(f"__x{i}") for i, f in enumerate(features)]).join(cuts, "zone")
    kept = [c for c in rows.columns if c != "cuts"]
    rows = rows.selectExpr(*kept, *[f"get(cuts, {i}) AS __c{i}" for i in names], *[f"0 AS __b{i}" for i in names])
    kept += [f"__c{i}" for i in names]
    # A binary search in all features together, one bit of the answer per projection.
    step = 1 << max(0, (bins - 1).bit_length() - 1)
    while step:
        rows = rows.selectExpr(*kept, *[f"__b{i} + CASE WHEN get(__c{i}, __b{i} + {step - 1}) < __x{i} THEN {step} ELSE 0 END AS __b{i}" for i in names])
        step //= 2
    found = ", ".join(f"CAST(CASE WHEN __x{i} IS NOT NULL THEN __b{i} END AS SMALLINT)" for i in names)
    return rows.selectExpr(*[c for c in kept if not c.startswith("__")], f"array({found}) AS bins")


def walked(rows: DataFrame, splits: DataFrame | None, levels: int) -> DataFrame:
    """``rows`` with node, where they are after so many levels (null where the tree has ended), and value, that of the last
    node they were in. Nodes are numbered as in a heap."""
    if splits is None or not levels:
        return rows.selectExpr("*", "0 AS node", "0D AS value")
    # One row per zone: its splits in an array, so that a row finds its node's by place.
    trees = splits.groupBy("zone").agg(F.expr("map_from_entries(collect_list(struct(node, struct(feature, cut, missing_left, left_value, right_value)))) AS held"))
    trees = trees.selectExpr("zone", f"transform(sequence(0, {2 ** levels - 2}), i -> try_element_at(held, i)) AS tree")
    kept = rows.columns
    at = rows.join(trees, "zone", "left").selectExpr(*kept, "tree", "0 AS node", "0D AS value")
    for _ in range(levels):
        at = at.selectExpr(*kept, "tree", "node", "value", "get(tree, node) AS split")
        at = at.selectExpr(*kept, "tree", "node", "value", "split", "coalesce(get(bins, split.feature) <= split.cut, split.missing_left) AS left")
        at = at.selectExpr(*kept, "tree", "CASE WHEN split IS NOT NULL THEN 2 * node + CASE WHEN left THEN 1 ELSE 2 END END AS node",
                           "CASE WHEN split IS NULL THEN value WHEN left THEN split.left_value ELSE split.right_value END AS value")
    return at.drop("tree")


def best_splits(at: DataFrame, l2: float, min_rows: int) -> DataFrame:
    """The best split of every (zone, node) of rows (zone, node, bins, residual) that gains anything: feature, cut (the last
    bin to go left), missing_left, the values of both sides, gain, n."""
    cells = at.filter("node IS NOT NULL").selectExpr("zone", "node", "residual", "posexplode(bins) AS (feature, bin)")
    sums = cells.groupBy("zone", "node", "feature", "bin").agg(F.expr("sum(residual) AS g"), F.expr("count(*) AS n"))
    # The sums of a node, at most one per feature and bin, are brought together once: window and choice then need no further shuffle.
    sums = sums.repartition("zone", "node")
    whole = "PARTITION BY zone, node, feature"
    run = sums.selectExpr("zone", "node", "feature", "bin", *[c for x in "gn" for c in (
        f"coalesce(sum(CASE WHEN bin IS NOT NULL THEN {x} END) OVER ({whole} ORDER BY bin ROWS UNBOUNDED PRECEDING), 0) AS {x}_left",
        f"coalesce(sum(CASE WHEN bin IS NULL THEN {x} END) OVER ({whole}), 0) AS {x}_missing", f"sum({x}) OVER ({whole}) AS {x}_all")])
    cuts = run.filter("bin IS NOT NULL").selectExpr(
        "zone", "node", "feature", "bin", "g_all", "n_all", "n_missing",
        "inline(array(struct(true AS missing_left, g_left + g_missing AS gl, n_left + n_missing AS nl), struct(false AS missing_left, g_left AS gl, n_left AS nl)))")
    cuts = cuts.filter(f"(missing_left OR n_missing > 0) AND nl >= {min_rows} AND n_all - nl >= {min_rows}")
    # Rounded, so that equal gains stay equal in whatever order they were summed: the first feature and cut win, missing to the left.
    rated = cuts.selectExpr("zone", "node", f"""struct(
        round(gl * gl / (nl + {l2}D) + (g_all - gl) * (g_all - gl) / (n_all - nl + {l2}D) - g_all * g_all / (n_all + {l2}D), {GAIN_DIGITS}) AS gain,
        -feature AS feature, -bin AS cut, missing_left, gl / (nl + {l2}D) AS left_value, (g_all - gl) / (n_all - nl + {l2}D) AS right_value, n_all AS n) AS rated""")
    best = rated.groupBy("zone", "node").agg(F.max("rated").alias("best")).filter("best.gain > 0")
    return best.selectExpr("zone", "node", "-best.feature AS feature", "CAST(-best.cut AS INT) AS cut", "best.missing_left", "best.left_value", "best.right_value", "best.gain", "best.n")


def fit(df: DataFrame, features: Sequence[str], target: str = "mw", rounds: int = 20, depth: int = 5, rate: float = 0.1,
        bins: int = BINS, l2: float = 1.0, min_rows: int = 5) -> DataFrame:
    """Trees of all zones, one row per node: zone, tree, node, feature, threshold, left, right, missing_left, value, weight, gain, n.

    Tree 0 is a single leaf, the zone's mean. A tree that gains nothing is left out."""
    features = list(features)
    cuts = materialize(feature_cuts(df, features, target, bins), "cuts")
    rows = with_bins(df, cuts.select("zone", "cuts", "base"), features, bins, _value(target).alias("y")).filter("y IS NOT NULL")
    rows = materialize(rows.selectExpr("zone", "bins", "y - base AS residual"), "binned")
    grown: DataFrame | None = None
    for tree in range(1, rounds + 1):
        splits: DataFrame | None = None
        for level in range(depth):
            found = materialize(best_splits(walked(rows, splits, level), l2, min_rows), "splits")
            splits = found if splits is None else splits.unionByName(found)
        numbered = splits.withColumn("tree", F.lit(tree))
        grown = numbered if grown is None else grown.unionByName(numbered)
        if tree < rounds:
            left = walked(rows, splits, depth).selectExpr("zone", "bins", f"residual - {rate}D * value AS residual")
            rows = materialize(left, "binned")
    return _nodes(materialize(grown, "grown"), cuts, features, rate)


def _nodes(splits: DataFrame, cuts: DataFrame, features: list[str], rate: float) -> DataFrame:
    names = F.array(*[F.lit(f) for f in features])
    none = F.lit(None)
    inner = splits.join(cuts.select("zone", "cuts"), "zone").select(
        "zone", "tree", "node", F.get(names, F.col("feature")).alias("feature"), F.coalesce(F.get(F.get("cuts", F.col("feature")), F.col("cut")), F.lit(float("inf"))).alias("threshold"),
        (2 * F.col("node") + 1).alias("left"), (2 * F.col("node") + 2).alias("right"), "missing_left", F.lit(0.0).alias("value"),
        F.lit(rate).alias("weight"), "gain", "n")

    def leaf(node: Column, value: Column, weight: float, tree: Column) -> list[Column]:
        return ["zone", tree.alias("tree"), node.alias("node"), none.cast("string").alias("feature"), none.cast("double").alias("threshold"),
                none.cast("int").alias("left"), none.cast("int").alias("right"), F.lit(True).alias("missing_left"), value.alias("value"),
                F.lit(weight).alias("weight"), none.cast("double").alias("gain"), none.cast("long").alias("n")]

    ends = splits.select("zone", "tree", F.inline(F.array(
        F.struct((2 * F.col("node") + 1).alias("node"), F.col("left_value").alias("value")),
        F.struct((2 * F.col("node") + 2).alias("node"), F.col("right_value").alias("value")))))
    ends = ends.join(splits.select("zone", "tree", "node"), ["zone", "tree", "node"], "left_anti")
    leaves = ends.select(*leaf(F.col("node"), F.col("value"), rate, F.col("tree")))
    return inner.unionByName(leaves).unionByName(cuts.select(*leaf(F.lit(0), F.col("base"), 1.0, F.lit(0))))
