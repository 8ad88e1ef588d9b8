"""Moments kept per zone and day: a fit takes new days without reading the rows of old ones.

The table is partitioned by day. Writing a day again replaces it, so a late correction or a repeated job does no harm. The
features are part of the stored table, by name and in order; a fit asks for the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.models import linear

STORED = T.StructType([
    T.StructField("zone", T.StringType()), T.StructField("n", T.LongType()), T.StructField("means", T.ArrayType(T.DoubleType())),
    T.StructField("xx", T.ArrayType(T.DoubleType())), T.StructField("xy", T.ArrayType(T.DoubleType())),
    T.StructField("features", T.ArrayType(T.StringType())), T.StructField("date", T.DateType()),
])


def write_days(df: DataFrame, path: str, features: Sequence[str], target: str = "mw", day: str = "date") -> None:
    """Adds the days of ``df``, whole, to the store; a day that is there already is replaced."""
    daily = linear.moments(df, features, target, by=[day]).withColumnRenamed(day, "date")
    named = daily.withColumn("features", F.array(*[F.lit(f) for f in features])).select(*STORED.names)
    # One file per day, however many tasks made its rows.
    named.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def read_days(spark: SparkSession, path: str, features: Sequence[str], since: str | None = None, until: str | None = None) -> DataFrame:
    """Stored moments of the days from ``since`` to ``until``; other days are not read. Days stored with other features are an error."""
    rows = spark.read.schema(STORED).parquet(path)
    if since is not None:
        rows = rows.filter(F.col("date") >= F.lit(since).cast("date"))
    if until is not None:
        rows = rows.filter(F.col("date") <= F.lit(until).cast("date"))
    wanted = F.array(*[F.lit(f) for f in features])
    wrong = F.raise_error(F.concat(F.lit("stored with other features: "), F.array_join("features", ",")))
    return rows.withColumn("n", F.when(F.col("features") == wanted, F.col("n")).otherwise(wrong.cast("long"))).drop("features")


def fit_days(spark: SparkSession, path: str, features: Sequence[str], since: str | None = None, until: str | None = None) -> DataFrame:
    """One model per zone from the stored days."""
    return linear.fit_moments(linear.merge_moments(read_days(spark, path, features, since, until), len(features)), features)
