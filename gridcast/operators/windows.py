"""Ordered operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8192


def lag_rows(
    df: DataFrame,
    order_by: str,
    lags: Mapping[str, tuple[str, int]],
    keys: Sequence[str] = ("zone",),
    bucket: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Values of earlier rows of the same key: ``lags`` maps a new column to (column, rows back).

    A window over a whole key would put a zone holding a third of the table into one task. Instead
    rows get their position inside the key from counts per (key, bucket), are cut into blocks of
    ``block_rows`` positions, and the last rows of a block are also sent to the following block, so
    that every window sees one bounded block. Rows with a null key or position are kept, nulls first in
    order. ``order_by`` must be unique inside a key, and ``bucket``
    must grow with it; the default bucket is the day.
    """
    keys = list(keys)
    reach = max(k for _, k in lags.values())
    size = max(block_rows, reach)
    bucketed = df.withColumn("__bucket", bucket if bucket is not None else F.col(order_by).cast("date"))

    counts = bucketed.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"__at_{k}") for k in (*keys, "__bucket")], F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    # A null key or bucket is a group like any other.
    alike = [F.col(k).eqNullSafe(F.col(f"__at_{k}")) for k in (*keys, "__bucket")]

    in_bucket = Window.partitionBy(*keys, "__bucket").orderBy(order_by)
    placed = bucketed.join(offsets, alike).drop(*offsets.columns[:-1]).withColumn(
        "__pos", F.col("__offset") + F.row_number().over(in_bucket) - 1
    )
    block = F.floor(F.col("__pos") / size)
    copies = F.when(
        F.col("__pos") % size >= size - reach, F.array(block, block + 1)
    ).otherwise(F.array(block))
    spread = placed.withColumn("__block", F.explode(copies))

    in_block = Window.partitionBy(*keys, "__block").orderBy("__pos")
    lagged = spread.withColumns({out: F.lag(c, k).over(in_block) for out, (c, k) in lags.items()})
    return lagged.filter(F.col("__block") == block).drop("__bucket", "__offset", "__pos", "__block")


def lag_one(df: DataFrame, order_by: str = "ds", **options) -> DataFrame:
    """Load and temperature of the row before."""
    return lag_rows(df, order_by, {"previous_mw": ("mw", 1), "previous_temp": ("temp", 1)}, **options)


def lag_features(df: DataFrame, order_by: str = "ds", mw_rows: int = 48, temp_rows: int = 24, **options) -> DataFrame:
    """Complete rows with load ``mw_rows`` and temperature ``temp_rows`` rows back, complete again."""
    lags = {"previous_mw": ("mw", mw_rows), "previous_temp": ("temp", temp_rows)}
    return lag_rows(df.na.drop("any"), order_by, lags, **options).na.drop("any")


def hour_delta(totals: DataFrame, by: Sequence[str] = (), value: str = "mw") -> DataFrame:
    """Change from the hour before on an hourly total (at most a day of rows per group); null at hour 0
    and where the hour before is missing."""
    w = Window.partitionBy(*by).orderBy("hour")
    follows = F.lag("hour").over(w) == F.col("hour") - 1
    return totals.withColumn("delta_mw", F.when(follows, F.col(value) - F.lag(value).over(w)))


def table_calc_difference(df: DataFrame, by: Sequence[str] = ("zone",), value: str = "hourly_mw") -> DataFrame:
    """Difference of a summed mark from the mark before it, along hours; null on the first mark."""
    marks = df.groupBy(*by, "hour").agg(F.sum(value).alias("total"))
    w = Window.partitionBy(*by).orderBy("hour")
    return marks.withColumn("difference", F.col("total") - F.lag("total").over(w))
