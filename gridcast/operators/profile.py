"""Data profiles. Each is one pass with a partial aggregate unless stated otherwise."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.session import materialize

QUARTILES = (0.25, 0.5, 0.75)
#: Of the sketches: ranks are right to one part in so many, and brackets are three of these parts wide to either side.
ACCURACY = 10_000
BRACKET = 3 / ACCURACY
COLLECTED = 50_000
#: Of a sketch of distinct values: its size is two to this power.
SKETCH_BITS = 14

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _long_form(row: DataFrame, structs: list[Column]) -> DataFrame:
    """One wide row of results to one row per entry."""
    return row.select(F.inline(F.array(*structs)))


def _number(df: DataFrame, name: str) -> Column:
    """A numeric or boolean column as double."""
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.col(name).cast("int").cast("double")
    return F.col(name).cast("double")


def zone_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls, and in floating columns not-a-numbers, per column, and nulls divided by the number of present values."""
    columns = list(columns or df.columns)
    present = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(_there(df, c)).alias(c) for c in columns])
    return _long_form(
        present,
        [F.struct(F.lit(c).alias("column"), (F.col("__rows") - F.col(c)).alias("nulls"),
                  ((F.col("__rows") - F.col(c)) / F.nullif(F.col(c), F.lit(0))).alias("null_ratio")) for c in columns],
    )


def widest_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column with the largest spread; the first listed wins a tie."""
    spreads = df.agg(*[(F.max(_present(df, c)) - F.min(_present(df, c))).alias(c) for c in columns])
    entries = _long_form(
        spreads,
        [F.struct(F.lit(c).alias("column"), F.lit(-i).alias("rank"), F.col(c).alias("spread")) for i, c in enumerate(columns)],
    )
    return entries.agg(
        F.max_by("column", F.struct("spread", "rank")).alias("column"), F.max("spread").alias("spread")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Pearson correlation of every pair in long form; both halves of the matrix, from one aggregate."""
    pairs = list(combinations_with_replacement(columns, 2))
    row = df.agg(*[F.corr(_number(df, a), _number(df, b)).alias(f"{a}|{b}") for a, b in pairs])
    both = [(a, b, a, b) for a, b in pairs] + [(b, a, a, b) for a, b in pairs if a != b]
    return _long_form(
        row,
        [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                  F.bround(F.col(f"`{x}|{y}`"), digits).alias("corr")) for a, b, x, y in both],
    )


def global_max(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(_there(df, column)).alias(column))


def distinct_zones(df: DataFrame, position: str) -> DataFrame:
    """Zones with the position at which they first appear."""
    return df.groupBy("zone").agg(F.min(position).alias("first_seen"))


def next_forecast_date(df: DataFrame, ts: str = "ds") -> DataFrame:
    return df.agg(F.date_add(F.max(ts).cast("date"), 1).alias("forecast_date"))


def column_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """Per column: kind, default aggregate, distinct values, and whether nulls occur.

    Distinct counts are sketches by default. ``exact`` reduces to distinct (column, value) rows with a
    map-side combine before it counts, so that no task holds the values of one column.
    """
    kinds = {f.name: _kind(f.dataType) for f in df.schema.fields}
    names = df.columns
    row = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(c).alias(f"n:{c}") for c in names],
        *([] if exact else [F.approx_count_distinct(c).alias(f"d:{c}") for c in names]),
    )
    entries = _long_form(
        row,
        [F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"),
                  F.lit("Sum" if kinds[c] in ("integer", "real") else "Count").alias("aggregation"),
                  (F.col("__rows") > F.col(f"`n:{c}`")).alias("contains_null"),
                  *([] if exact else [F.col(f"`d:{c}`").alias("distinct_values")])) for c in names],
    )
    if not exact:
        return entries
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), _as_text(df, c).alias("value")) for c in names
    ]))).filter(F.col("value").isNotNull())
    distinct = values.groupBy("column", "value").agg(F.lit(1).alias("one"))
    counts = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    return entries.join(counts, "column", "left").withColumn(
        "distinct_values", F.coalesce("distinct_values", F.lit(0))
    )


def _as_text(df: DataFrame, name: str) -> Column:
    """A text that is equal where the values are: one zero, and bytes as they are."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (F.col(name) + F.lit(0.0)).cast("string")
    return F.hex(name) if isinstance(kind, T.BinaryType) else F.col(name).cast("string")


def _kind(kind: T.DataType) -> str:
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "real"
    if isinstance(kind, NUMERIC):
        return "integer"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string"


def day_sketches(df: DataFrame, columns: Sequence[str], day: str = "date") -> DataFrame:
    """Per day and column: rows, present (values), and a sketch of the distinct values; small rows to be stored by day."""
    parts = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(columns):
        value = _there(df, c)
        # A hash of the value in its own type: no text is made of it. Zero has one sign.
        plain = value + 0 if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else value
        parts += [F.count(value).alias(f"__n{i}"), F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(plain)), F.lit(SKETCH_BITS)).alias(f"__s{i}")]
    daily = df.groupBy(day).agg(*parts)
    entries = [F.struct(F.lit(c).alias("column"), F.col("__rows").alias("rows"), F.col(f"__n{i}").alias("present"), F.col(f"__s{i}").alias("sketch"))
               for i, c in enumerate(columns)]
    return daily.select(day, F.inline(F.array(*entries)))


def range_profile(sketches: DataFrame, since: str | None = None, until: str | None = None, day: str = "date") -> DataFrame:
    """Per column over the days from ``since`` to ``until``: rows, nulls, distinct_values (estimated, within about one per cent, and right for
    some hundreds). It reads stored sketches only, never the rows they were made of."""
    rows = sketches
    if since is not None:
        rows = rows.filter(F.col(day) >= F.lit(since).cast("date"))
    if until is not None:
        rows = rows.filter(F.col(day) <= F.lit(until).cast("date"))
    return rows.groupBy("column").agg(
        F.sum("rows").alias("rows"), (F.sum("rows") - F.sum("present")).alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))


def summary_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, standard deviation, extremes and exact quartiles of numeric columns, from two reads."""
    moments = _moments(df, columns, QUARTILES)
    quartiles = exact_quantiles(df, columns, QUARTILES, moments=moments)
    rows = [
        (c, m["count"], m["mean"], m["std"], m["min"], *[quartiles.get((c, p)) for p in (0.25, 0.5, 0.75)], m["max"])
        for c, m in moments.items()
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    )


def _there(df: DataFrame, name: str) -> Column:
    """The value in its own type, or null where it is missing or not a number."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(name), F.col(name))
    return F.col(name)


def _present(df: DataFrame, column: str) -> Column:
    """The number, or null where it is missing or not a number."""
    v = _number(df, column)
    return F.when(~F.isnan(v), v)


def _moments(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = ()) -> dict[str, Row]:
    """One result row per column, from one pass; near each probability also two values of a sketch, between which its quantile
    is expected."""
    near = [F.lit(min(1.0, max(0.0, p + side * BRACKET))) for p in probabilities for side in (-1, 1)]
    row = df.agg(*[
        F.struct(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
                 *[F.percentile_approx(v, F.array(*near), ACCURACY).alias("near") for _ in near[:1]]).alias(c)
        for c in columns for v in [_present(df, c)]
    ]).first()
    return {c: row[c] for c in columns}


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], bins: int = 8192,
    moments: dict[str, Row] | None = None,
) -> dict[tuple[str, float], float]:
    """Exact quantiles with linear interpolation, without sorting or gathering rows, from two reads of ``df``.

    Sketches of the first pass give a narrow bracket for every wanted rank. The second pass counts what lies outside the brackets,
    and inside them every value: about one row in a thousand. These counts, which are written, hold the answer. A rank that is
    not in its bracket after all, and columns with infinite values, are found by narrowing an interval pass by pass; the driver sees
    at most ``COLLECTED`` values, or ``bins`` counts per rank.
    """
    moments = moments or _moments(df, columns, probabilities)
    ends = {c: m for c, m in moments.items() if m["count"]}
    wanted = {}
    for c, m in ends.items():
        for p in probabilities:
            place = (m["count"] - 1) * p
            wanted[c, p] = (int(place), min(int(place) + 1, m["count"] - 1), place - int(place))
    ranks = {(c, k) for (c, _), (a, b, _) in wanted.items() for k in (a, b)}
    # Infinite values have their ranks at the two ends and are counted apart; the search is among the others.
    infinite = {c for c, m in ends.items() if math.isinf(m["min"]) or math.isinf(m["max"])}
    found = _in_brackets(df, {c: m for c, m in ends.items() if c not in infinite and "near" in m}, ranks, bins)
    open_ranks, finite = {}, _finite(df, sorted(infinite)) if infinite else {}
    for c, k in ranks - found.keys():
        below, n, low, high = finite.get(c) or (0, ends[c]["count"], ends[c]["min"], ends[c]["max"])
        if k < below:
            found[c, k] = -math.inf
        elif k >= below + n:
            found[c, k] = math.inf
        else:
            open_ranks[c, k] = (low, high, below)
    if open_ranks:
        found |= _narrowed(_values(df, sorted({c for c, _ in open_ranks})), open_ranks, bins)

    def between(low: float, high: float, share: float) -> float:
        if low == high or share == 0:
            return low
        return low * (1 - share) + high * share if math.isinf(low) or math.isinf(high - low) else low + (high - low) * share

    return {key: between(found[key[0], a], found[key[0], b], share) for key, (a, b, share) in wanted.items()}


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, v, n: every value once."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), _present(df, c).alias("v"), F.lit(1).cast("long").alias("n")) for c in columns])))


def _in_brackets(df: DataFrame, ends: dict[str, Row], ranks: set[tuple[str, int]], bins: int) -> dict[tuple[str, int], float]:
    """The values at those ranks that lie in the brackets of their column, from one read."""
    if not ends:
        return {}
    brackets: dict[str, list[list[float]]] = {}
    for c, m in ends.items():
        merged: list[list[float]] = []
        for low, high in sorted(zip(m["near"][::2], m["near"][1::2])):
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(high, merged[-1][1])
            else:
                merged.append([low, high])
        brackets[c] = merged
    # Zones of a column in order: odd ones are brackets, in which the value itself is counted.
    entries = []
    for c, merged in brackets.items():
        v = _present(df, c)
        zone, inside = F.lit(2 * len(merged)), F.lit(False)
        for j, (low, high) in reversed(list(enumerate(merged))):
            zone = F.when(v < low, 2 * j).when(v <= high, 2 * j + 1).otherwise(zone)
            inside = inside | v.between(low, high)
        entries.append(F.struct(F.lit(c).alias("column"), F.when(v.isNotNull(), zone).alias("zone"), F.when(inside, v).alias("v")))
    rows = df.select(F.inline(F.array(*entries))).filter("zone IS NOT NULL")
    counted = materialize(rows.groupBy("column", "zone", "v").agg(F.count(F.lit(1)).alias("n")), "counts")
    sizes: dict[str, dict[int, int]] = {c: {} for c in brackets}
    for r in counted.groupBy("column", "zone").agg(F.sum("n").alias("n")).collect():
        sizes[r["column"]][r["zone"]] = r["n"]
    places: dict[tuple[str, int], tuple[int, int]] = {}
    for c, k in ranks & {(c, k) for c, k in ranks if c in brackets}:
        below = 0
        for zone in range(2 * len(brackets[c]) + 1):
            n = sizes[c].get(zone, 0)
            if k < below + n:
                if zone % 2:
                    places[c, k] = (zone, below)
                break
            below += n
    values = counted.filter("v IS NOT NULL")
    held = values.limit(COLLECTED + 1).collect()
    if len(held) > COLLECTED:
        return _narrowed(values, {(c, k): (*brackets[c][zone // 2], below) for (c, k), (zone, below) in places.items()}, bins)
    found = {}
    for (c, k), (zone, below) in places.items():
        for v, n in sorted((r["v"], r["n"]) for r in held if (r["column"], r["zone"]) == (c, zone)):
            below += n
            if k < below:
                found[c, k] = v
                break
    return found


def _narrowed(values: DataFrame, open_ranks: dict[tuple[str, int], tuple[float, float, int]], bins: int) -> dict[tuple[str, int], float]:
    """The value at each (column, rank) among rows (column, v, n), known to lie in (low end, high end, values below the low end).

    Each pass counts values in ``bins`` equal parts of an interval and goes on with the part that holds the wanted rank, until that part is a single
    value. A pass shuffles only bin counts."""
    found = {}
    open_ranks = dict(open_ranks)
    while open_ranks:
        for key, (lo, hi, _) in list(open_ranks.items()):
            if lo == hi:
                found[key] = lo
                del open_ranks[key]
        if open_ranks:
            counted = _count_parts(values, {(c, lo, hi) for (c, _), (lo, hi, _) in open_ranks.items()}, bins)
            for (c, k), (lo, hi, below) in open_ranks.items():
                for part in counted[c, lo, hi]:
                    if k < below + part["n"]:
                        if (part["first"], part["last"]) == (lo, hi) and len(counted[c, lo, hi]) == 1:
                            raise ArithmeticError(f"no progress on {c} between {lo} and {hi}")
                        open_ranks[c, k] = (part["first"], part["last"], below)
                        break
                    below += part["n"]
    return found


def _finite(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, int, float, float]]:
    """Per column: how many values are minus infinity and how many finite, and the ends of these."""
    entries = []
    for c in columns:
        v = _present(df, c)
        inner = F.when(F.abs(v) < math.inf, v)
        entries.append(F.struct(F.count_if(v == -math.inf).alias("below"), F.count(inner).alias("n"), F.min(inner).alias("low"), F.max(inner).alias("high")).alias(c))
    row = df.agg(*entries).first()
    return {c: tuple(row[c]) for c in columns}


def _count_parts(values: DataFrame, intervals: set[tuple[str, float, float]], bins: int) -> dict[tuple, list[Row]]:
    """For each interval its non-empty parts in order, with count, smallest and largest value."""
    table = values.sparkSession.createDataFrame(sorted(intervals), "column string, lo double, hi double")
    lo, hi = F.col("lo"), F.col("hi")
    # Halved first: the distance of two large values may be more than a double holds.
    part = F.least(F.floor((F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2) * bins), F.lit(bins - 1))
    rows = (
        values.join(table, "column").filter(F.col("v").between(lo, hi))
        .groupBy("column", "lo", "hi", part.alias("part"))
        .agg(F.sum("n").alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
        .collect()
    )
    found: dict[tuple, list[Row]] = {interval: [] for interval in intervals}
    for row in sorted(rows, key=lambda r: r["part"]):
        found[row["column"], row["lo"], row["hi"]].append(row)
    return found
