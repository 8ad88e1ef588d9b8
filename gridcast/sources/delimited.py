"""Delimited text sources and sinks with declared schemas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast import schemas
from gridcast.functions.calendar import parse_wall_time
from gridcast.operators.joins import known_zones
from gridcast.operators.peaks import history_hourly


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Header, quoting and byte-order mark are handled; a row that does not fit the schema is an error."""
    return (
        spark.read.schema(schema)
        .option("header", True).option("sep", sep).option("mode", "FAILFAST").option("escape", '"')
        .csv(path)
    )


def write_delimited(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_zone_dimension(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, schemas.ZONE_DIM)


def read_zone_peaks(spark: SparkSession, path: str) -> DataFrame:
    """Zone and record peak only; the other columns are not parsed."""
    return read_zone_dimension(spark, path).select("zone", "hist_peak_mw")


def load_history(spark: SparkSession, path: str, dim: DataFrame, fmt: str | None = None) -> DataFrame:
    """Metered load of known zones summed by hour; ``fmt`` says how times are written, ISO if not given. Unknown zones
    are dropped before the shuffle."""
    raw = read_delimited(spark, path, schemas.METERED_HISTORY)
    metered = known_zones(raw, dim).select(
        parse_wall_time(F.col("datetime_beginning_ept"), fmt).alias("ds"), "zone", "mw"
    )
    return history_hourly(metered)


def read_training(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_delimited(spark, path, schema)


def read_or_fallback(spark: SparkSession, primary: str, fallback: str) -> DataFrame:
    """The forecast at ``primary`` (parquet), or the saved text forecast when that path is absent.

    Only a missing path falls back; a broken file still fails.
    """
    try:
        return spark.read.schema(schemas.SAVED_FORECAST).parquet(primary).drop("index")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return read_delimited(spark, fallback, schemas.SAVED_FORECAST).drop("index")


def forecast_date(saved: DataFrame) -> DataFrame:
    """The day a saved one-day forecast is for (all its rows carry the same date)."""
    return saved.agg(F.min("date").alias("date"))


def export_forecast(df: DataFrame, root: str, date_text: str) -> str:
    """Write the four published columns below a name that carries the date; returns the path."""
    path = f"{root}/forecast_{date_text}"
    write_delimited(df.select("ds", "zone", "temp", "mw"), path)
    return path


def write_tables(tables: Mapping[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        write_delimited(df, f"{root}/{name}")


def read_tables(spark: SparkSession, root: str, declared: Mapping[str, T.StructType]) -> dict[str, DataFrame]:
    return {name: read_delimited(spark, f"{root}/{name}", schema) for name, schema in declared.items()}


def write_extract(tables: Mapping[str, DataFrame], root: str) -> None:
    """Full-refresh columnar snapshot of every table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def extract_counts(spark: SparkSession, root: str, declared: Mapping[str, T.StructType]) -> DataFrame:
    """Rows per extracted table and in total; counts come from file footers."""
    counts = None
    for name, schema in declared.items():
        one = spark.read.schema(schema).parquet(f"{root}/{name}").agg(F.count(F.lit(1)).alias("n"))
        one = one.select(F.lit(name).alias("table_name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts.rollup("table_name").agg(F.sum("n").alias("n")).withColumn(
        "table_name", F.coalesce("table_name", F.lit("total"))
    )


def stack(*frames: DataFrame) -> DataFrame:
    """Frames on top of each other, columns matched by name, absent ones null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result
