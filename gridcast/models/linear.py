"""Least squares per zone from sufficient statistics.

Rows are reduced to a p x p table of central moments per zone by built-in aggregates with a map-side
combine; only these small rows reach the solver. Moments can be kept per day and merged, so that a fit takes a new day
without reading the old ones (:mod:`gridcast.sources.moment_store`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COEFFICIENTS = T.StructType([
    T.StructField("zone", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("coefficients", T.ArrayType(T.DoubleType())),
    T.StructField("intercept", T.DoubleType()),
])


def _sum_of(columns: list[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def moments(df: DataFrame, features: Sequence[str], target: str, key: str = "zone", by: Sequence[str] = ()) -> DataFrame:
    """Means and population covariances of features and target per zone (and ``by``), over complete rows."""
    complete = df.na.drop("any", subset=[*features, target]).select(
        key, *by, *[F.col(c).cast("double").alias(c) for c in (*features, target)]
    )
    pairs = list(combinations_with_replacement(features, 2))
    return complete.groupBy(key, *by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in (*features, target)]).alias("means"),
        F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("xx"),
        F.array(*[F.covar_pop(c, target) for c in features]).alias("xy"),
    )


def merge_moments(parts: DataFrame, n_features: int, key: str = "zone") -> DataFrame:
    """The moments of all rows of a zone from those of its parts, whatever parts they are.

    The means come first; each part then adds its own covariances and the product of its means' distances from
    the whole, which are differences of like numbers: an offset of any size costs no digits."""
    p = n_features
    whole = parts.groupBy(key).agg(F.expr("sum(n) AS all_n"), F.array(*[F.expr(f"sum(n * means[{i}]) / sum(n)") for i in range(p + 1)]).alias("centre"))
    away = [f"(means[{i}] - centre[{i}])" for i in range(p + 1)]
    pairs = list(combinations_with_replacement(range(p), 2))

    def pooled(name: str, k: int, i: int, j: int):
        return F.expr(f"sum(n * ({name}[{k}] + {away[i]} * {away[j]})) / first(all_n)")

    return parts.join(whole, key).groupBy(key).agg(
        F.expr("first(all_n) AS n"), F.expr("first(centre) AS means"),
        F.array(*[pooled("xx", k, i, j) for k, (i, j) in enumerate(pairs)]).alias("xx"),
        F.array(*[pooled("xy", i, i, p) for i in range(p)]).alias("xy"),
    )


def fit(df: DataFrame, features: Sequence[str], target: str = "mw") -> DataFrame:
    """One model per zone. A feature that does not vary, or is a combination of others, gets the
    minimum-norm solution instead of failing."""
    return fit_moments(moments(df, features, target), features)


def fit_moments(sums: DataFrame, features: Sequence[str]) -> DataFrame:
    """The same from the moments of :func:`moments` or :func:`merge_moments`."""
    features = list(features)
    p = len(features)
    upper = np.triu_indices(p)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                xx = np.zeros((p, p))
                xx[upper] = r.xx
                xx = xx + np.triu(xx, 1).T
                means = np.asarray(r.means)
                # Scaling to unit variance keeps the rank decision independent of the units.
                scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
                beta = np.linalg.lstsq(xx / np.outer(scale, scale), np.asarray(r.xy) / scale, rcond=1e-12)[0] / scale
                rows.append((r.zone, r.n, features, beta.tolist(), float(means[p] - means[:p] @ beta)))
            yield pd.DataFrame(rows, columns=COEFFICIENTS.names)

    return sums.mapInPandas(solve, COEFFICIENTS)


def predict(df: DataFrame, models: DataFrame, features: Sequence[str], out: str = "prediction") -> DataFrame:
    """Score every row with the model of its zone; rows without a model or feature get null."""
    joined = df.join(models.select("zone", "coefficients", "intercept"), "zone", "left")
    return joined.withColumn(out, _linear(features)).drop("coefficients", "intercept")


def _linear(features: Sequence[str]) -> Column:
    terms = [F.col(c).cast("double") * F.get("coefficients", F.lit(i)) for i, c in enumerate(features)]
    return F.col("intercept") + _sum_of(terms)


def predict_point(point: DataFrame, models: DataFrame, features: Sequence[str], out: str = "prediction") -> DataFrame:
    """Score given points with the first stored model (by zone name)."""
    model = F.struct("zone", "coefficients", "intercept")
    first = models.agg(F.min_by(model, "zone").alias("m")).scalar()
    scored = point.withColumns({"coefficients": first["coefficients"], "intercept": first["intercept"]})
    return scored.select("*", first["zone"].alias("zone"), _linear(features).alias(out)).drop("coefficients", "intercept")


def vif(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Variance inflation factors without a constant term, from one pass of products."""
    features = list(features)
    p = len(features)
    upper = np.triu_indices(p)
    numbers = {c: F.col(c).cast("double") for c in features}
    complete = df.na.drop("any", subset=features)
    products = complete.agg(F.array(*[
        F.sum(numbers[a] * numbers[b]) for a, b in combinations_with_replacement(features, 2)
    ]).alias("xx"))

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for values in pdf["xx"]:
                xx = np.zeros((p, p))
                xx[upper] = values
                xx = xx + np.triu(xx, 1).T
                scale = np.sqrt(np.diag(xx))
                # The factor is the diagonal product, which scaling to a unit diagonal leaves unchanged.
                factors = np.diag(np.linalg.inv(xx / np.outer(scale, scale)))
                yield pd.DataFrame({"feature": features, "vif": factors})

    return products.mapInPandas(invert, "feature string, vif double")
