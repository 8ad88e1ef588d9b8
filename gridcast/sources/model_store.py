"""Stored models.

Linear models are one coefficient table keyed by zone. Read back from storage its size is known, so
scoring joins it without moving the scored rows as long as it is small, and shuffles it when not.
"""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import quote

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridcast.models.linear import COEFFICIENTS


def save_linear(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(path)


def load_linear(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COEFFICIENTS).parquet(path)


def zone_folder(root: str, zone: str) -> str:
    """The folder of a zone, its name escaped as partition folders are, so that no character of it acts as a pattern."""
    return f"{root}/zone={quote(zone, safe='')}"


def save_tree_models(models: Mapping[str, GBTRegressionModel], root: str) -> None:
    for zone, model in models.items():
        model.write().overwrite().save(zone_folder(root, zone))


def load_trees(spark: SparkSession, root: str, features: list[str]) -> DataFrame:
    """Trees of all saved boosted models as rows, one per node, for :mod:`gridcast.models.trees`: two reads in all."""

    def read(part: str) -> DataFrame:
        reader = spark.read.option("basePath", root)
        found = reader.parquet(f"{root}/zone=*/{part}").schema
        # A zone is text even where all names look like numbers.
        declared = StructType([StructField("zone", StringType()) if f.name == "zone" else f for f in found.fields])
        return reader.schema(declared).parquet(f"{root}/zone=*/{part}")

    names = F.array(*[F.lit(f) for f in features])
    nodes = read("data").select("zone", "treeID", "nodeData.*")
    stored = read("treesMetadata")
    weights = stored.select("zone", *[F.col(c).alias(n) for c, n in zip([c for c in stored.columns if c != "zone"], ("treeID", "metadata", "weight"))])
    leaf = F.col("leftChild") < 0
    return nodes.join(weights, ["zone", "treeID"]).select(
        "zone",
        F.col("treeID").cast("int").alias("tree"),
        F.col("id").cast("int").alias("node"),
        F.when(~leaf, F.get(names, F.col("split.featureIndex"))).alias("feature"),
        F.when(~leaf, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(~leaf, F.col("leftChild")).cast("int").alias("left"),
        F.when(~leaf, F.col("rightChild")).cast("int").alias("right"),
        F.lit(True).alias("missing_left"),
        F.col("prediction").alias("value"),
        "weight",
    )
