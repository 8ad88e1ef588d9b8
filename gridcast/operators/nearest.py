"""The nearest site of each point, by a tree of cells over the sites.

The sites' area is cut into 4 by 4 cells, and a cell of more than ``LEAF_SITES`` sites again, down to ``MAX_LEVEL``; the index holds of
each cell how many sites it has and the box around them. Points go down the tree level by level in equi-joins: a point
keeps those cells that may hold its nearest site, which are the cells no farther away than a site surely is, and is
compared with the sites of the last cells only. What a point is compared with does not grow with the sites, however they are
clustered, but for the depth of the tree. Points at one place are searched once.

Distance is |d lat| + |d long|; the lower ``site_order`` wins a tie. Bounds are computed as distances are, and rounding
keeps order, so no site is missed. Sites without a finite coordinate take no part; a point without one has no zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.session import materialize

LEAF_SITES = 32
MAX_LEVEL = 12
# The first cell. Zero, but not as a constant: a join on a constant would be a join of all with all to the planner.
ROOT = ["pmod(hash(lat), 1) AS level", "CAST(pmod(hash(lat), 1) AS BIGINT) AS cx", "CAST(pmod(hash(lat), 1) AS BIGINT) AS cy"]


def _finite(*names: str) -> Column:
    result = F.lit(True)
    for name in names:
        result = result & F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(F.col(name)) < float("inf"))
    return result


def _cell(number: Column, low: float, high: float) -> Column:
    """The place of a coordinate on the finest grid."""
    most = 4 ** MAX_LEVEL - 1
    # Halves first, so that the widest range of doubles does not overflow.
    share = (number / 2 - low / 2) / ((high / 2 - low / 2) or 1.0)
    return F.least(F.lit(most), F.floor(share * (most + 1))).cast("long")


def _levels(sites: DataFrame, names: list[str]) -> DataFrame:
    """Each site in its cell of every level."""
    level = F.explode(F.sequence(F.lit(0), F.lit(MAX_LEVEL))).alias("level")
    up = f"2 * ({MAX_LEVEL} - level)"
    return sites.select("*", level).select("level", F.expr(f"shiftright(x, {up}) AS cx"), F.expr(f"shiftright(y, {up}) AS cy"), *names)


def site_index(sites: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Cells (level, cx, cy, box, leaf), the sites with the leaf they are in, and the deepest level."""
    first_here = F.min(F.struct(F.col("site_order").cast("long").alias("site_order"), "zone"))
    numbers = sites.select("site_order", "zone", F.col("lat").cast("double").alias("lat"), F.col("long").cast("double").alias("long"))
    compact = numbers.filter(_finite("lat", "long")).groupBy("lat", "long").agg(first_here.alias("site")).select("lat", "long", "site.*")
    compact = materialize(compact, "sites")
    ends = compact.agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("long").alias("c"), F.max("long").alias("d"), F.count("*").alias("n")).first()
    if not ends["n"]:
        return compact, compact.selectExpr(*ROOT, "*"), 0
    placed = compact.withColumns({"x": _cell(F.col("lat"), ends["a"], ends["b"]), "y": _cell(F.col("long"), ends["c"], ends["d"])})
    if ends["n"] <= LEAF_SITES:
        return compact, placed.selectExpr(*ROOT, "lat", "long", "site_order", "zone"), 0
    cells = _levels(placed, ["lat", "long"]).groupBy("level", "cx", "cy").agg(
        F.count("*").alias("n"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("long").alias("long_min"), F.max("long").alias("long_max"))
    cells = materialize(cells, "cells")
    # A cell is in the tree if the one above it had to be cut.
    cut = cells.filter(F.col("n") > LEAF_SITES).selectExpr("level + 1 AS level", "cx AS px", "cy AS py")
    held = cells.filter("level > 0").withColumns({"px": F.expr("shiftright(cx, 2)"), "py": F.expr("shiftright(cy, 2)")}).join(cut, ["level", "px", "py"], "left_semi")
    leaf = (F.col("n") <= LEAF_SITES) | (F.col("level") == MAX_LEVEL)
    index = materialize(held.withColumn("leaf", leaf).drop("n"), "index")
    leaves = index.filter("leaf").select("level", "cx", "cy")
    inside = materialize(_levels(placed, ["lat", "long", "site_order", "zone"]).join(leaves, ["level", "cx", "cy"], "left_semi"), "placed-sites")
    return index, inside, index.agg(F.max("level")).first()[0]


_LOWER = "greatest(lat_min - lat, lat - lat_max, 0D) + greatest(long_min - long, long - long_max, 0D)"
# Some site lies on each side of a box: at worst at the far end of the nearest side.
_UPPER = """least(least(abs(lat - lat_min), abs(lat - lat_max)) + greatest(abs(long - long_min), abs(long - long_max)),
                  least(abs(long - long_min), abs(long - long_max)) + greatest(abs(lat - lat_min), abs(lat - lat_max)))"""


def compared(places: DataFrame, sites: DataFrame) -> DataFrame:
    """The pairs of a place (lat, long; no two alike) and a site that are compared: lat, long, distance, site_order, zone."""
    index, inside, depth = site_index(sites)
    at = places.selectExpr("lat", "long", *ROOT, "false AS leaf", "0D AS lower", "CAST('Infinity' AS DOUBLE) AS upper")
    for level in range(1, depth + 1):
        below = index.filter(F.col("level") == level).selectExpr(
            "px", "py", "cx AS x", "cy AS y", "leaf AS is_leaf", "lat_min", "lat_max", "long_min", "long_max")
        # Places that have arrived match nothing, each under a number of its own.
        keyed = at.selectExpr("*", "CASE WHEN leaf THEN -1 - pmod(xxhash64(lat, long), 1073741824) ELSE cx END AS kx", "cy AS ky")
        joined = keyed.join(below, (F.col("kx") == F.col("px")) & (F.col("ky") == F.col("py")), "left").filter("leaf OR px IS NOT NULL")
        moved = joined.selectExpr(
            "lat", "long", f"CASE WHEN leaf THEN level ELSE {level} END AS level", "CASE WHEN leaf THEN cx ELSE x END AS cx", "CASE WHEN leaf THEN cy ELSE y END AS cy",
            "leaf OR is_leaf AS leaf", f"CASE WHEN leaf THEN lower ELSE {_LOWER} END AS lower", f"CASE WHEN leaf THEN upper ELSE {_UPPER} END AS upper")
        near = moved.selectExpr("*", "min(upper) OVER (PARTITION BY lat, long) AS surely")
        at = near.filter("lower <= surely").drop("surely")
    own = inside.selectExpr("level", "cx", "cy", "lat AS site_lat", "long AS site_long", "site_order", "zone")
    met = at.select("lat", "long", "level", "cx", "cy").join(own, ["level", "cx", "cy"])
    return met.selectExpr("lat", "long", "abs(lat - site_lat) + abs(long - site_long) AS distance", "site_order", "zone")


def nearest_zone(points: DataFrame, sites: DataFrame, point_id: str) -> DataFrame:
    """``point_id``, zone and distance of the nearest of ``sites`` (site_order, zone, lat, long) for each of ``points`` (lat, long)."""
    numbers = points.select(F.col(point_id), F.col("lat").cast("double").alias("lat"), F.col("long").cast("double").alias("long"))
    pairs = compared(numbers.filter(_finite("lat", "long")).select("lat", "long").distinct(), sites)
    best = pairs.groupBy("lat", "long").agg(F.min(F.struct("distance", "site_order", "zone")).alias("best"))
    return numbers.join(best, ["lat", "long"], "left").select(point_id, F.col("best.zone").alias("zone"), F.col("best.distance").alias("distance"))
