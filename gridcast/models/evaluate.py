"""Splits, scaling and error measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def random_split(df: DataFrame, keys: Sequence[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add a 0/1 ``test`` column from a digest of the row key: the same row always lands in the same part,
    however the data is partitioned or re-read, and in any engine that knows the digest."""
    # Digests are even over all 32-bit numbers, so a share is a limit, written as text like the digest.
    limit = f"{int(test_share * 2**32):08x}" if test_share < 1 else "g"
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return df.withColumn("test", (F.substring(digest, 1, 8) < F.lit(limit)).cast("int"))


def standard_scale(train: DataFrame, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Centre and scale ``rows`` by mean and population deviation of ``train``. A feature that does not
    vary is only centred."""
    stats = train.agg(F.struct(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in features
    ]).alias("stats")).scalar()
    scaled = {}
    for c in features:
        std = stats[c]["std"]
        scaled[c] = (F.col(c) - stats[c]["mean"]) / F.when(std > 0, std).otherwise(F.lit(1.0))
    return rows.withColumns(scaled)


def mean_absolute_error(df: DataFrame, actual: str, predicted: str, digits: int = 2) -> DataFrame:
    return df.agg(F.bround(F.avg(F.abs(F.col(predicted) - F.col(actual))), digits).alias("mae"))


def mape_by_zone(df: DataFrame, actual: str = "mw", predicted: str = "prediction") -> DataFrame:
    """Mean absolute percentage error per zone as fraction and as percent. Rows whose actual value is
    zero have no percentage, nor have rows without a prediction; both are left out and counted."""
    share = F.abs((F.col(actual) - F.col(predicted)) / F.nullif(F.col(actual), F.lit(0.0)))
    scored = df.groupBy("zone").agg(F.avg(share).alias("mape"), F.count_if(F.col(actual) == 0).alias("skipped"),
                                     F.count_if(F.col(actual).isNotNull() & F.col(predicted).isNull()).alias("unscored"))
    return scored.withColumn("mape_pct", F.col("mape") * 100)
