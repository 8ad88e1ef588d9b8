"""Boosted and bagged trees per zone.

Training uses the distributed learners of ``pyspark.ml``. Scoring takes trees as rows (one per node:
zone, tree, node, feature, threshold, left, right, missing_left, value, weight); a leaf has no feature.
``score_trees`` sends the node table to the tasks and leaves the scored rows where they are, as long as it has no more than
``MAX_NODES`` rows; beyond that ``score_trees_grouped`` brings rows and trees together in bounded groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.models.evaluate import random_split, standard_scale
from gridcast.models.forest import score_with_forest
from gridcast.session import discard, materialize, scratch_path


WRITERS = 8
MAX_NODES = 500_000
#: Nodes of a forest that are grown together (a few hundred bytes each in the driver), and what a task holds of their statistics.
FOREST_NODES = 1_000_000
STATISTICS_MB = 256
#: Rows up to which a forest is left to the learner of ``pyspark.ml``.
LEARNER_ROWS = 2_000


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Complete rows with a feature vector."""
    numbers = df.withColumns({c: F.col(c).cast("double") for c in features})
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(numbers)


def fit_forest(
    df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], trees: int = 100, seed: int = 42,
    depth: int = 30, partitions: int | None = None,
) -> DataFrame:
    """Split, scale and fit a random forest; returns the scored test rows. Every split looks at all features; ``depth`` is
    the most the learner allows. ``partitions`` spreads a small input, which is read many times, over more tasks.

    The learner shuffles the statistics of every node, level by level, which takes minutes for full trees of some ten thousand rows. So
    more than ``LEARNER_ROWS`` rows are added up per cell of bins, and trees grow whole in tasks (:mod:`gridcast.models.forest`): the same
    bins, bootstraps, splits and leaves. What has too many cells for that goes to the learner too. It holds all trees of a fit at once, in the
    driver and in every task that scores, so trees are fitted some at a time (:func:`trees_at_once`), and test rows carry the sum so far."""
    split = random_split(df, keys, seed=seed)
    train = split.filter("test = 0")
    scaled = materialize(standard_scale(train, split, features), "forest")
    fitted = assemble(scaled.filter("test = 0"), features)
    # Complete rows only; the vector is made anew after each reading.
    scored, path = assemble(scaled.filter("test = 1"), features).drop("features"), None
    if fitted.count() > LEARNER_ROWS:
        found = score_with_forest(fitted.drop("features"), scored, features, target, trees, seed, depth, partitions or 1)
        if found is not None:
            return found
    fitted = fitted.repartition(partitions) if partitions else fitted
    at_once, total = trees_at_once(fitted, features, trees), F.lit(0.0)
    for first in range(0, trees, at_once):
        model = RandomForestRegressor(
            featuresCol="features", labelCol=target, numTrees=(n := min(at_once, trees - first)), seed=seed + first, maxDepth=depth,
            minInstancesPerNode=1, featureSubsetStrategy="all", maxMemoryInMB=STATISTICS_MB, cacheNodeIds=True,  # rows need not walk down again
        ).fit(fitted)
        found = model.transform(assemble(scored, features)).drop("features")
        if at_once >= trees:
            return found
        total, older = F.col("prediction") * n + total, path
        path = scratch_path(df.sparkSession, "forest-sum")
        found.withColumn("__total", total).drop("prediction").write.parquet(path)
        scored, total = df.sparkSession.read.parquet(path), F.col("__total")
        if older:
            discard(df.sparkSession, older)
    return scored.withColumn("prediction", F.col("__total") / trees).drop("__total")


def trees_at_once(rows: DataFrame, features: Sequence[str], trees: int) -> int:
    """How many full trees have at most ``FOREST_NODES`` nodes together; one at least. A tree has no more leaves than
    there are rows, and no more than there are different ones (which are estimated)."""
    n, different = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(*features), 0.02)).first()
    return max(1, min(trees, FOREST_NODES // max(1, 2 * min(n, different))))


def fit_boosted(
    df: DataFrame, zones: Sequence[str], features: Sequence[str], target: str,
    rounds: int = 20, depth: int = 5, seed: int = 42, parallelism: int = 8,
) -> dict[str, GBTRegressionModel]:
    """One boosted model per zone. Rows are written once, split into folders by zone, so that each fit
    reads its own zone only."""
    spark = df.sparkSession
    stored = materialize_by_zone(df.select("zone", *features, target))
    learner = GBTRegressor(featuresCol="features", labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed)

    def fit(zone: str) -> GBTRegressionModel:
        return learner.fit(assemble(stored.filter(F.col("zone") == zone), features))

    # The fits are independent jobs; several run at once, as in the tuning tools of pyspark.ml.
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return dict(zip(zones, pool.map(fit, zones)))


def materialize_by_zone(df: DataFrame) -> DataFrame:
    """Rows in one folder per zone, in a few files each: a large zone is written by several tasks."""
    path = scratch_path(df.sparkSession, "by-zone")
    df = df.repartition("zone", F.pmod(F.xxhash64(*df.columns), F.lit(WRITERS)))
    df.write.mode("overwrite").partitionBy("zone").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tree_arrays(nodes: pd.DataFrame, features: Sequence[str]) -> list[tuple]:
    """The trees of one zone as plain arrays."""
    place = {name: i for i, name in enumerate(features)}
    trees = []
    for _, t in nodes.groupby("tree"):
        t = t.sort_values("node")
        row_of = np.full(int(t["node"].max()) + 1, -1)
        row_of[t["node"].to_numpy()] = np.arange(len(t))
        left, right = (row_of[t[side].fillna(t["node"]).astype(int).to_numpy()] for side in ("left", "right"))
        feature = np.array([place[f] if isinstance(f, str) else -1 for f in t["feature"]])
        missing_left = np.array([m is not False for m in t["missing_left"].astype(object)])
        value = t["value"].to_numpy(float) * t["weight"].to_numpy(float)
        trees.append((feature, t["threshold"].to_numpy(float), left, right, missing_left, value))
    return trees


def _score_arrays(trees: list[tuple], x: np.ndarray, inclusive: bool) -> np.ndarray:
    """Walk all rows down each tree together, one level per step. The root is the lowest node number."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, threshold, left, right, missing_left, value in trees:
        at = np.zeros(len(x), dtype=int)
        while (inner := feature[at] >= 0).any():
            v = x[rows, np.where(inner, feature[at], 0)]
            go_left = (v <= threshold[at]) if inclusive else (v < threshold[at])
            go_left = np.where(np.isnan(v), missing_left[at], go_left)
            at = np.where(inner, np.where(go_left, left[at], right[at]), at)
        total += value[at]
    return total


def score_trees(
    df: DataFrame, nodes: DataFrame, features: Sequence[str], out: str = "prediction",
    inclusive: bool = True,
) -> DataFrame:
    """Sum of weighted leaves of the zone's trees. A missing feature follows the node's default branch; ``inclusive`` says
    whether a value equal to the threshold goes left. Zones without trees get null. Up to ``MAX_NODES`` nodes go to every task;
    of a larger table so many are read, and rows and trees then meet in groups."""
    small = nodes.limit(MAX_NODES + 1).toPandas()
    if len(small) > MAX_NODES:
        return score_trees_grouped(df, nodes, features, out, inclusive)
    scored = _score_with_copies(_with_numbers(df, features), small, list(features), out, inclusive)
    return scored.drop(*[f"__{c}" for c in features])


def score_trees_grouped(
    df: DataFrame, nodes: DataFrame, features: Sequence[str], out: str = "prediction",
    inclusive: bool = True, rows_per_group: int = 500_000,
) -> DataFrame:
    """The same for any number of nodes: rows and trees meet in groups of about ``rows_per_group`` rows."""
    scored = _score_in_groups(_with_numbers(df, features), nodes, list(features), out, inclusive, rows_per_group)
    return scored.drop(*[f"__{c}" for c in features])


def _with_numbers(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f"__{c}": F.col(c).cast("double") for c in features})


def _score_with_copies(df: DataFrame, small: pd.DataFrame, features: list[str], out: str, inclusive: bool) -> DataFrame:
    forests = df.sparkSession.sparkContext.broadcast(
        {zone: _tree_arrays(part, features) for zone, part in small.groupby("zone")}
    )

    @F.pandas_udf("double")
    def score(zone: pd.Series, values: pd.DataFrame) -> pd.Series:
        x = values.to_numpy(float)
        result = np.full(len(x), np.nan)
        for name, places in zone.groupby(zone).indices.items():
            if name in forests.value:
                result[places] = _score_arrays(forests.value[name], x[places], inclusive)
        return pd.Series(result)

    scored = score("zone", F.struct(*[f"__{c}" for c in features]))
    return df.withColumn(out, F.nanvl(scored, F.lit(None).cast("double")))


def _score_in_groups(df: DataFrame, nodes: DataFrame, features: list[str], out: str, inclusive: bool, rows_per_group: int) -> DataFrame:
    """Rows and trees meet by (zone, part). A zone has as many parts as its row count needs, so no group
    grows with the zone's share of the table. The input partition is hashed too, which spreads equal rows.
    """
    sizes = materialize(
        df.groupBy("zone").agg(F.ceil(F.count(F.lit(1)) / rows_per_group).alias("__parts")), "parts"
    )
    placed = df.withColumn("__hash", F.xxhash64(F.spark_partition_id(), *df.columns))
    parts = F.coalesce("__parts", F.lit(1).cast("long"))
    rows = placed.join(sizes, "zone", "left").withColumn("__part", F.pmod("__hash", parts)).drop("__hash", "__parts")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))
    copies = nodes.join(sizes, "zone").withColumn("__part", part).drop("__parts")
    # New names for the same columns, in case the trees were derived from the scored rows themselves.
    copies = copies.toDF(*[f"{c}_" for c in copies.columns])
    schema = df.withColumn(out, F.lit(None).cast("double")).schema

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x = left[[f"__{c}" for c in features]].to_numpy(float)
        if len(left) and len(right):
            left[out] = _score_arrays(_tree_arrays(right.rename(columns=lambda c: c.removesuffix("_")), features), x, inclusive)
        else:
            left[out] = np.nan
        return left[schema.names]

    scored = rows.groupBy("zone", "__part").cogroup(copies.groupBy("zone_", "__part_")).applyInPandas(score, schema)
    return scored.withColumn(out, F.nanvl(out, F.lit(None).cast("double")))
