"""Row selections driven by literals or by a selection table with one ``zone`` column."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The named set of hours shown as labels.
HOUR_SET = [0, 3, 6, 9, 12, 15, 18, 21]


def zone_subset(df: DataFrame, zones: Iterable[str] | DataFrame) -> DataFrame:
    """Rows of the selected zones. Literals become a pushed-down filter, a table a semi join."""
    if isinstance(zones, DataFrame):
        return df.join(zones.select("zone"), "zone", "left_semi")
    return df.filter(F.col("zone").isin(list(zones)))


def single_zone(df: DataFrame, zone: str) -> DataFrame:
    return df.filter(F.col("zone") == zone)


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def flag_split(df: DataFrame, flag: str = "test") -> tuple[DataFrame, DataFrame]:
    """(train, test) by a stored 0/1 flag."""
    return df.filter(F.col(flag) == 0), df.filter(F.col(flag) == 1)


def selected_flag(df: DataFrame, zones: Iterable[str]) -> DataFrame:
    """Mark rows of the selection with the text 'True', all others with 'False'."""
    chosen = F.col("zone").isin(list(zones))
    return df.withColumn("selected", F.when(chosen, "True").otherwise("False"))


def selection_or_all(df: DataFrame, selection: DataFrame) -> DataFrame:
    """The selected rows, or every row when nothing is selected."""
    return df if selection.isEmpty() else zone_subset(df, selection)


def selection_state(selection: DataFrame, dim: DataFrame) -> DataFrame:
    """One row: 'empty', 'partial' or 'all', with both counts."""
    counts = selection.agg(F.count_distinct("zone").alias("n_selected")).withColumn(
        "n_zones", dim.agg(F.count_distinct("zone").alias("n")).scalar()
    )
    return counts.withColumn(
        "state",
        F.when(F.col("n_selected") == 0, "empty")
        .when(F.col("n_selected") < F.col("n_zones"), "partial")
        .otherwise("all"),
    )


def toggle_selection(selection: DataFrame, clicks: DataFrame) -> DataFrame:
    """Each click adds a zone or removes it again: a zone stays if it was named an odd number of times."""
    named = selection.select("zone").distinct().unionByName(clicks.select("zone"))
    return named.groupBy("zone").count().filter(F.col("count") % 2 == 1).select("zone")


def member_filter(df: DataFrame, members: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows whose combination of ``fields`` is among the chosen members."""
    return df.join(members.select(*fields), list(fields), "left_semi")


def in_hour_set(hour: Column, hours: Sequence[int] = HOUR_SET) -> Column:
    return hour.isin(list(hours))


def non_empty(df: DataFrame) -> DataFrame:
    """One row telling whether any row exists; reads at most one row."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("finished"))


def time_slice(df: DataFrame, dim: DataFrame, date: str, hour: int, ts: str = "ds") -> DataFrame:
    """Rows of one wall-clock hour with the zone attributes attached."""
    day = F.lit(date).cast("date")
    start = day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hour))
    # A range on the raw column reaches the scan; date() and hour() of it would not.
    in_hour = (F.col(ts) >= start) & (F.col(ts) < start + F.expr("INTERVAL '1' HOUR"))
    return df.filter(in_hour).join(dim, "zone")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in a stated order (a distributed frame has no order of its own)."""
    return df.orderBy(*order).limit(n)
