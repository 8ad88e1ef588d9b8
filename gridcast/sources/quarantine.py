"""Sources in which some rows do not fit: the good ones go on, the bad ones go to a table with reason and file.

Text is read once and written once, so that both parts come from the same reading; nothing is lost between them. The strict readers
in :mod:`gridcast.sources.delimited` still end at the first bad row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast import schemas
from gridcast.session import materialize
from gridcast.sources.weather_documents import HOURLY_FIELDS

CORRUPT = "_corrupt_record"


def _text_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(CORRUPT, T.StringType())])


def row_fault(line: Column, schema: T.StructType, options: dict[str, str]) -> Column:
    """Why a line does not fit: ``columns`` for a wrong number of them, else the names of the columns whose text is not of their type,
    else ``format``."""
    tokens = F.from_csv(line, F.lit(_text_schema(schema).simpleString()), {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    parts = []
    for field in schema.fields:
        token = F.nullif(tokens[field.name], F.lit(""))
        if not isinstance(field.dataType, T.StringType):
            parts.append(F.when(token.isNotNull() & token.try_cast(field.dataType).isNull(), F.lit(field.name)))
    names = F.concat_ws(",", *parts) if parts else F.lit("")
    return F.when(tokens[CORRUPT].isNotNull(), "columns").when(names != "", names).otherwise("format")


def read_sorted(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Delimited text as rows of ``schema``, and what did not fit: file, line, reason."""
    options = {"sep": sep, "escape": '"'}
    declared = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    read = (spark.read.schema(declared).options(**options).option("header", header).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    held = materialize(read.select("*", F.col("_metadata.file_path").alias("__file")), "sorted-text")
    bad = held.filter(F.col(CORRUPT).isNotNull())
    rejected = bad.select(F.col("__file").alias("file"), F.col(CORRUPT).alias("line"), row_fault(F.col(CORRUPT), schema, options).alias("reason"))
    return held.filter(F.col(CORRUPT).isNull()).select(*schema.names), rejected


def document_fault(document: Column) -> Column:
    """Why a weather document cannot be turned into hours: ``empty``, ``malformed`` (not JSON, or a value of another type), the name of the first
    field that is missing, or ``unequal`` if the arrays differ in length. Null if it can."""
    declared = T.StructType([*schemas.WEATHER_DOCUMENT.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(document, declared, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    hourly = parsed["hourly"]
    sizes = F.array(*[F.size(hourly[f]) for f in HOURLY_FIELDS])
    fault = F.when(document.isNull() | (F.trim(document) == ""), "empty").when(parsed.isNull() | parsed[CORRUPT].isNotNull(), "malformed")
    fault = fault.when(parsed["timezone_abbreviation"].isNull(), "timezone_abbreviation").when(hourly.isNull(), "hourly")
    for name in HOURLY_FIELDS:
        fault = fault.when(hourly[name].isNull(), name)
    return fault.when(F.array_min(sizes) != F.array_max(sizes), "unequal")


def sort_documents(docs: DataFrame, json: str = "document") -> tuple[DataFrame, DataFrame]:
    """Documents that can be turned into hours, and the others with their reason. Faults are found once."""
    held = materialize(docs.withColumn("reason", document_fault(F.col(json))), "sorted-documents")
    return held.filter("reason IS NULL").drop("reason"), held.filter("reason IS NOT NULL")


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Landed documents, one JSON line each with its zone and day beside it. A line that is not JSON is rejected as a whole: its
    columns are null, its text stands under the document's name, and its reason is ``line``."""
    declared = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    read = spark.read.schema(declared).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    held = materialize(read.select("*", F.col("_metadata.file_path").alias("file")), "landed")
    whole, bad = held.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), held.filter(F.col(CORRUPT).isNotNull())
    good, faulty = sort_documents(whole)
    lines = bad.withColumn("document", F.col(CORRUPT)).drop(CORRUPT).withColumn("reason", F.lit("line"))
    return good.drop("file"), faulty.unionByName(lines)
