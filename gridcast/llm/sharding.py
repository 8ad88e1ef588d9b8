"""Sharding by a hypergeometric communication matrix: a uniform shuffle whose shard sizes are exact.

In a uniform shuffle of all rows, how many rows of each input partition go to each shard is a table with given row and column
sums, distributed as a multivariate hypergeometric law. That table, the communication matrix, is drawn first, from the partitions'
row counts alone: the partitions are halved again and again, and at each halving the places of every shard are split between
the halves by exact draws (inversion of the law, term by term). Then each partition is permuted by itself and its first rows go to
the first shard, the next to the second and so on, as the matrix says; rows are exchanged; and the rows of a shard are
permuted again, which gives their slots. A shard of any size is dealt over cells of about ``CELL_ROWS`` rows for that, by
the leading part of a random key, so that no task holds a shard.

Everything is DataFrame functions. What is not spread over tasks is one list of the partitions' row counts (not of rows); the
halvings below the sixth are. Input partitions and places in them are fixed by writing the permuted rows to the shared folder, so a
lost executor changes nothing, and the same files read in the same way give the same shards.

Shard sizes differ by one row at most, the first shards being the larger; a table of fewer rows than shards leaves some
empty, an empty table gives no rows. Null and empty texts, very long ones, null ids and repeated rows are rows like any
other: equal texts are spread as chance has it, and a group of copies of any size loads no shard more than another. Other
columns are carried along untouched, whatever their names, unless they have the name of a result: those are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.store import stored, written

SHARDS = 16
SEED = 12
CELL_ROWS = 1 << 14
#: The draws leave out what lies so many standard deviations (and 40) from the likeliest value: less than a double can tell.
REACH = 12
#: From this halving on, the parts of the table are drawn in many tasks.
SPREAD_LEVEL = 6
_PLACE = (1 << 33) - 1


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed a single time, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) that follows from the parts: 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0 ** -53)


def hypergeometric(total: Column, good: Column, taken: Column, unit: Column) -> Column:
    """How many of ``taken`` rows out of ``total``, of which ``good`` are good, are good: the value at ``unit`` of the law's
    distribution function."""

    def bounds(n: Column) -> Column:
        lowest = F.greatest(F.lit(0).cast("long"), n["k"] + n["good"] - n["total"])
        highest = F.least(n["k"], n["good"])
        total, good, k = (n[c].cast("double") for c in ("total", "good", "k"))
        mode = F.floor((k + 1) * (good + 1) / (total + 2))
        share = good / F.greatest(total, F.lit(1.0))
        spread = F.sqrt(F.greatest(F.lit(0.0), k * share * (1 - share) * (total - k) / F.greatest(total - 1, F.lit(1.0))))
        reach = F.ceil(spread * REACH) + 40
        return F.struct(F.greatest(lowest, mode - reach).alias("low"), F.least(highest, mode + reach).alias("high"),
                        n["total"].alias("total"), n["good"].alias("good"), n["k"].alias("k"), n["unit"].alias("unit"))

    def next_weight(n: Column, state: Column, x: Column) -> Column:
        # Weights relative to the first value's; each follows from the one before.
        at = x.cast("double")
        return state["weight"] * (n["good"] - at) * (n["k"] - at) / ((at + 1) * (n["total"] - n["good"] - n["k"] + at + 1))

    def summed(n: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"))
        return F.aggregate(F.sequence(n["low"], n["high"]), start, lambda state, x: F.struct(
            next_weight(n, state, x).alias("weight"), (state["sum"] + state["weight"]).alias("sum")))["sum"]

    def sought(n: Column, goal: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("below"))
        below = F.aggregate(F.sequence(n["low"], n["high"]), start, lambda state, x: F.struct(
            next_weight(n, state, x).alias("weight"), (state["sum"] + state["weight"]).alias("sum"),
            (state["below"] + F.when(state["sum"] + state["weight"] <= goal, 1).otherwise(0)).alias("below")))["below"]
        return F.least(n["low"] + below, n["high"])

    numbers = F.struct(total.cast("long").alias("total"), good.cast("long").alias("good"), taken.cast("long").alias("k"), unit.alias("unit"))
    return _once(_once(numbers, bounds), lambda n: _once(summed(n) * n["unit"], lambda goal: sought(n, goal)))


def _split(places: Column, total: Column, taken: Column, shards: int, node: Column, seed: int) -> Column:
    """How many of ``taken`` rows go to each shard, when ``total`` rows fill the shards' ``places``: one draw per shard, each
    from what the draws before have left."""
    start = F.struct(total.alias("total"), taken.alias("taken"), F.array().cast("array<bigint>").alias("drawn"))

    def step(state: Column, shard: Column) -> Column:
        held = F.get(places, shard)
        drawn = hypergeometric(state["total"], held, state["taken"], _unit(F.lit(seed), node, shard))
        return _once(drawn, lambda k: F.struct(
            (state["total"] - held).alias("total"), (state["taken"] - k).alias("taken"), F.concat(state["drawn"], F.array(k)).alias("drawn")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, step)["drawn"]


def capacities(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart, the larger ones first."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def communication_matrix(sizes: DataFrame, places: Sequence[int], seed: int = SEED) -> DataFrame:
    """(part, counts): how many rows of each partition go to each shard, from rows (part, n) with one row per partition
    and the shards' sizes, whose sum is that of ``n``."""
    places = list(places)
    count = sizes.count()
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct(F.col("part").cast("long").alias("part"), F.col("n").cast("long").alias("n")))).alias("parts"))
    nodes = listed.select(F.lit(1).cast("long").alias("node"), "parts", F.lit(places).cast("array<bigint>").alias("places"))

    def rows_in(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x["n"])

    half = F.ceil(F.size("parts") / 2).cast("int")
    for level in range(max(0, count - 1).bit_length()):
        if level == SPREAD_LEVEL:
            nodes = nodes.repartition("node")
        cut = nodes.select("node", "places", F.slice("parts", F.lit(1), half).alias("left"),
                           F.slice("parts", half + 1, F.size("parts")).alias("right"))
        drawn = _split(F.col("places"), rows_in(F.col("left")) + rows_in(F.col("right")), rows_in(F.col("left")), len(places), F.col("node"), seed)
        split = cut.select("node", "places", "left", "right", drawn.alias("drawn"))
        rest = F.zip_with("places", "drawn", lambda a, b: a - b)
        both = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("parts"), F.col("drawn").alias("places")),
                       F.struct((F.col("node") * 2 + 1).alias("node"), F.col("right").alias("parts"), rest.alias("places")))
        nodes = split.select(F.inline(both)).filter(F.size("parts") > 0)
    return nodes.filter(F.size("parts") == 1).select(F.col("parts")[0]["part"].alias("part"), F.col("places").alias("counts"))


def permuted(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` with part, the input partition, and place (from 0) in a random order of it, written to the shared folder."""
    tagged = rows.withColumn("__scanned", F.monotonically_increasing_id())
    mixed = tagged.sortWithinPartitions(F.xxhash64(F.lit(seed), "__scanned"), "__scanned").drop("__scanned")
    placed = mixed.select("*", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)).alias("place"))
    return written(placed, "permuted")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``docs`` with shard (from 0) and slot, the row's place in its shard (from 0)."""
    results = ["shard", "slot"]
    held = permuted(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), seed)
    sizes = stored(held.groupBy("part").agg(F.count("*").alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    matrix = stored(communication_matrix(sizes, capacities(total, shards), seed))
    # Where each shard's stretch of a permuted partition ends.
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice("counts", F.lit(1), k), F.lit(0).cast("long"), lambda s, x: s + x))
    key = F.xxhash64(F.lit(seed + 1), "part", "place")
    cells = max(1, -(-total // (shards * cell_rows)))
    cell = F.shiftright(F.shiftrightunsigned(key, 33) * F.lit(cells).cast("long"), 31)
    dealt = held.join(matrix.select("part", ends.alias("ends")), "part").select(
        "row", "part", "place", F.size(F.filter("ends", lambda end: end <= F.col("place"))).alias("shard"), key.alias("key"), cell.alias("cell"))
    counts = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "cell").orderBy("key", "part", "place")
    mixed = dealt.withColumn("at", F.row_number().over(inside).cast("long") - 1).join(firsts, ["shard", "cell"])
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in results]
    return mixed.select(*kept, "shard", (F.col("first") + F.col("at")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Writes ``docs``, shuffled, as Parquet with one folder per shard; the rows of a file are in the order of their slots."""
    shard(docs, shards, seed).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
