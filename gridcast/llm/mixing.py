"""Mixing sources to target weights by systematic sampling.

Every source has a target size in words. Inside a source each document is expected to be taken
``target / source size`` times. The documents are put in an order, their expected copies are summed from
the front, one random offset is added, and a document is emitted once for every whole number its stretch
crosses. The order is by size, so that documents of like size share out the fractions and the words taken
come as near to the target as whole documents allow. Sums are kept in whole units of 2^-24 copies: no rounding.

Null and empty texts have size 0; a null source is a source of its own, last in order. Repeated rows are
separate documents. An empty table gives an empty result. Other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.store import join_same, ranked, stored, words

UNIT = 1 << 24
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source: source_size and target, from rows (source, size).

    Weights go to the sources in code point order, repeating. A target stops at ``max_repeats`` times the
    source's size; what is over goes to the other sources by weight. All targets are ``weight * level`` up to
    their stop, so only the level is sought: it rises until no further source is stopped.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = ranked(totals, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = stored(placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_repeats).alias("stop")))
    whole, weight_sum = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    level, stopped = (whole / weight_sum if weight_sum else 0.0), 0
    while True:
        over = F.col("stop") < F.col("weight") * F.lit(level)
        n, given, open_weight = weighted.agg(
            F.count_if(over), F.sum(F.when(over, F.col("stop")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))),
        ).first()
        if n == stopped or not open_weight:
            break
        level, stopped = (whole - given) / open_weight, n
    target = F.least(F.col("stop").cast("double"), F.col("weight") * F.lit(float(level)))
    return weighted.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """The source's one random offset, in units, from a digest of seed and name."""
    name = F.coalesce(F.concat(F.lit("="), source), F.lit("-"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), name)), 1, 6), 16, 10).cast("long")


def mix_plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """For rows (doc_id, source, size): adds source_size, target, copies and taken (copies times size)."""
    placed = ranked(rows, [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id")], ["source"])
    placed = stored(placed)
    targets = source_targets(placed.select("source", "size"), weights, max_repeats)
    joined = join_same(placed, targets, ["source"], "left")
    each = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    step = joined.select("*", each.alias("each"), offset(F.col("source"), seed).alias("offset"))
    end = F.shiftright((F.col("rank") + 1) * F.col("each") + F.col("offset"), 24)
    start = F.shiftright(F.col("rank") * F.col("each") + F.col("offset"), 24)
    copies = (end - start).cast("long")
    return step.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents: every row as often as its copies say, with all its columns."""
    row = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("string").alias("doc_id"),
        F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"),
    )
    plan = mix_plan(row.select("doc_id", "source", "size"), **options).filter("copies > 0")

    # The shuffle of the join also serves the numbering of rows that are alike in id, source and size.
    key = ["id_key", "source_key", "size"]

    def keyed(df: DataFrame, order: Column, *keep: str) -> DataFrame:
        known = df.select("size", *keep, *(
            F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")).alias(k) for c, k in (("doc_id", "id_key"), ("source", "source_key"))))
        return known.withColumn("twin", F.row_number().over(Window.partitionBy(*key).orderBy(order)))

    left = keyed(row, F.xxhash64(F.col(f"row.`{text_col}`")), "row")
    right = keyed(plan, F.col("copies").desc(), "copies")
    joined = left.join(right, [*key, "twin"])
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
