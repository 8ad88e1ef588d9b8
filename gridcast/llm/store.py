"""Shared helpers: whole words, stored frames, and ranks over a distributed sort."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_IDS = 1_000_000
BLANKS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space; none for a null text."""
    found = F.array_remove(F.split(text, BLANKS), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor reaches.

    Only a local session without that setting, as in tests, gets a folder of its own.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="llm-")
        context.setCheckpointDir(base)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, for what is wide: columns are packed, and a reader takes those it needs."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Take away a table of :func:`fresh_path` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the files of shuffles that nothing refers to any more, which it does when the driver's garbage is collected."""
    spark._jvm.System.gc()


def few(ids: DataFrame, limit: int = BROADCAST_IDS) -> bool:
    """Whether the frame, a column of numbers that is stored, is small enough to be sent to every task."""
    return ids.limit(limit + 1).count() <= limit


def narrowed(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` whose ``name`` is among ``ids``, or all if the ids are too many to be sent to every task.

    Used ahead of a join with the same ids: rows that cannot match then stay out of its shuffle.
    """
    return docs.join(F.broadcast(ids), name, "left_semi") if few(ids) else docs


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal names under which null meets null; the keys appear once."""
    other = right.select(*(F.col(c).alias(f"__right_{c}" if c in keys else c) for c in right.columns))
    condition = F.lit(True)
    for name in keys:
        condition = condition & F.col(name).eqNullSafe(F.col(f"__right_{name}"))
    joined = left.join(other, condition, how)
    return joined.drop(*(f"__right_{c}" for c in keys))


def ranked(df: DataFrame, order: Sequence[Column], within: Sequence[str] = ()) -> DataFrame:
    """Adds ``rank``: the 0-based place of each row in ``order`` inside its group ``within``.

    ``order`` must begin with the columns of ``within``. The rows are range-sorted, so a large group is
    spread over many tasks; only one count per partition and group is scanned to find where each starts.
    """
    rows = stored(df.sort(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    counts = rows.groupBy("part", *within).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", *within, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    joined = join_same(rows, starts, ["part", *within])
    return joined.select(*df.columns, (F.col("place") + F.col("shift")).alias("rank"))
