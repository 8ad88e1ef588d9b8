"""A bagged forest grown from sums per cell.

A learner that bins its features knows a row by its bins only: rows of the same bins, a cell, go down every tree together. So a tree needs
the weight and the weighted target of each cell under its bootstrap, and no rows. One pass over the rows draws the bootstraps of all trees
and adds them up per cell; each tree is then grown whole in one task, where the cells of the scored rows end in their leaves too.
What is shuffled follows cells and trees, and the number of jobs neither trees nor depth.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.session import materialize


#: Bins of a feature, and values that tell them, as the learner of ``pyspark.ml`` has them.
BINS = 32
RANKS = 10_000
#: Cells that a task holds (a few hundred bytes each while a tree grows). More are not handled here.
MAX_CELLS = 1_000_000
#: Rows for one task, rows whose draws are in memory at once, and cells that are put out together.
ROWS_A_TASK = 50_000
ROWS_AT_ONCE = 4_096
CELLS_AT_ONCE = 4_096
#: Gains that differ by this share are equal.
ROUNDING = 1e-9
GOLDEN = 0x9E3779B97F4A7C15


def score_with_forest(
    train: DataFrame, rows: DataFrame, features: Sequence[str], target: str, trees: int, seed: int, depth: int, partitions: int = 1,
) -> DataFrame | None:
    """``rows`` with the mean prediction of ``trees`` trees fitted to ``train``; both have complete numeric features. None if
    they have more than ``MAX_CELLS`` cells."""
    spark, cuts = train.sparkSession, thresholds(train, features)
    if np.prod([len(c) + 1.0 for c in cuts]) >= 2.0**62:
        return None
    placed, value = rows.withColumn("__cell", cell(features, cuts)), F.col(target).cast("double")
    checked = F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit("Labels MUST NOT be Null or NaN"))).otherwise(value)
    # Rows of one cell and one target are drawn together, so no cell is too large for a task.
    counted = train.select(cell(features, cuts).alias("__cell"), checked.alias("__target"))
    counted = materialize(counted.groupBy("__cell", "__target").agg(F.count(F.lit(1)).alias("__n")), "forest-rows")
    known = counted.select("__cell", F.lit(False).alias("__asked")).union(placed.select("__cell", F.lit(True)))
    known = known.groupBy("__cell").agg(F.max("__asked").alias("__asked")).limit(MAX_CELLS + 1).toPandas().sort_values("__cell")
    if len(known) > MAX_CELLS:
        return None
    codes, asked = known["__cell"].to_numpy(), known["__asked"].to_numpy(bool)
    different, centre = counted.agg(F.count(F.lit(1)), F.sum(F.col("__target") * F.col("__n")) / F.sum("__n")).first()
    shared = spark.sparkContext.broadcast((codes, asked, bins_of(codes, [len(c) + 1 for c in cuts])))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from bootstrap_sums(batches, shared.value[0], centre, trees, seed)

    def grow(parts: pd.DataFrame) -> pd.DataFrame:
        codes, asked, bins = shared.value
        at, weights, sums = (np.frombuffer(b"".join(parts[c]), kind) for c, kind in (("cells", np.int32), ("weights", np.int64), ("sums", float)))
        weight, total = np.bincount(at, weights, len(codes)), np.bincount(at, sums, len(codes))
        return pd.DataFrame({"__cell": codes[asked], "prediction": grow_tree(bins, weight, total, depth)[asked] + centre})

    dealt = counted.repartitionByRange(max(partitions, -(-different // ROWS_A_TASK)), "__cell", "__target")
    sums = dealt.sortWithinPartitions("__cell", "__target").mapInPandas(draw, "tree int, cells binary, weights binary, sums binary")
    leaves = sums.repartition(trees, "tree").groupBy("tree").applyInPandas(grow, "__cell long, prediction double")
    found = materialize(leaves.groupBy("__cell").agg(F.avg("prediction").alias("prediction")), "forest-cells")
    return placed.join(found, "__cell").drop("__cell")


def thresholds(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Up to ``BINS`` - 1 values per feature that part its values: all of them if they are few, else into about equal numbers of rows."""
    found, many = {}, []
    for c in features:
        values = [r[0] for r in rows.select(F.col(c).cast("double")).distinct().limit(BINS + 1).collect()]
        found[c] = midpoints(np.unique(values))
        if len(values) > BINS:
            many.append(c)
    if many:
        ranks = F.expr(f"array({', '.join(f'{i / (RANKS - 1)}D' for i in range(RANKS))})")  # as a list it takes seconds
        row = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), ranks, RANKS).alias(c) for c in many]).first()
        found |= {c: even_cuts(np.array(row[c])) for c in many}
    return [found[c] for c in features]


def midpoints(values: np.ndarray) -> np.ndarray:
    return (values[:-1] + values[1:]) / 2


def even_cuts(ranked: np.ndarray) -> np.ndarray:
    """Cuts as the learner makes them: where the count so far is nearest to the next share. A frequent value takes one share only,
    so the values beside it are still told apart."""
    values, counts = np.unique(ranked, return_counts=True)
    if len(values) <= BINS:
        return midpoints(values)
    stride = len(ranked) / BINS
    middle, before, goal, cuts = midpoints(values), counts[0], stride, []
    for i, count in enumerate(counts[1:]):
        if abs(before - goal) < abs(before + count - goal) and len(cuts) < BINS - 1:
            cuts.append(middle[i])
            goal += stride
        before += count
    return np.array(cuts)


def cell(features: Sequence[str], cuts: list[np.ndarray]) -> Column:
    """The bins of a row as one number; a value equal to a threshold lies below it."""

    @F.pandas_udf("long")
    def code(values: pd.DataFrame) -> pd.Series:
        number = np.zeros(len(values), np.int64)
        for c, cut in zip(values.columns, cuts):
            number = number * (len(cut) + 1) + np.searchsorted(cut, values[c].to_numpy(float))
        return pd.Series(number)

    return code(F.struct(*[F.col(c).cast("double").alias(c) for c in features]))


def bins_of(codes: np.ndarray, sizes: list[int]) -> np.ndarray:
    """A row of bins for each cell."""
    bins = np.empty((len(codes), len(sizes)), np.uint8)
    for i in range(len(sizes) - 1, -1, -1):
        codes, bins[:, i] = np.divmod(codes, sizes[i])
    return bins


def bootstrap_sums(batches: Iterator[pd.DataFrame], codes: np.ndarray, centre: float, trees: int, seed: int) -> Iterator[pd.DataFrame]:
    """Weights and weighted targets per tree and cell, some cells at a time. Rows come in the order of cells; a cell may come in several parts."""
    kept: list[tuple[np.ndarray, ...]] = []

    def packed() -> pd.DataFrame:
        cells, weights, sums = (np.concatenate(x) for x in zip(*kept))
        parts = []
        for tree in range(trees):
            hit = weights[:, tree] > 0
            parts.append((tree, cells[hit].tobytes(), weights[hit, tree].tobytes(), sums[hit, tree].tobytes()))
        return pd.DataFrame(parts, columns=["tree", "cells", "weights", "sums"])

    for batch in batches:
        for first in range(0, len(batch), ROWS_AT_ONCE):
            code, target, n = (batch[c].to_numpy()[first:first + ROWS_AT_ONCE] for c in ("__cell", "__target", "__n"))
            drawn = draws(code, target, n, trees, seed)
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            sums = np.add.reduceat(drawn * (target - centre)[:, None], starts, axis=0)
            kept.append((np.searchsorted(codes, code[starts]).astype(np.int32), np.add.reduceat(drawn, starts, axis=0), sums))
            if sum(len(x[0]) for x in kept) >= CELLS_AT_ONCE:
                yield packed()
                kept.clear()
    if kept:
        yield packed()


def draws(code: np.ndarray, target: np.ndarray, n: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """How often each tree draws the ``n`` rows of one cell and target: a Poisson number of mean ``n``, the sum of one for each row.
    It hangs on the seed, the tree and the row's values, not on where the row lies."""
    key = mixed(mixed(code.astype(np.uint64) + mixed(np.array([seed % 2**64], np.uint64))) ^ np.ascontiguousarray(target).view(np.uint64))
    each = mixed(key[:, None] + np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(GOLDEN))
    even = (each >> np.uint64(11)) * 2.0**-53
    drawn = np.empty(even.shape, np.int64)
    for mean in np.unique(n):
        least, below = poisson(int(mean))
        drawn[n == mean] = least + np.searchsorted(below, even[n == mean], side="right")
    return drawn


def mixed(x: np.ndarray) -> np.ndarray:
    """The last steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson(mean: int) -> tuple[int, np.ndarray]:
    """The least number that counts, and the share of numbers up to each from there on; 12 deviations either way."""
    reach = 12 * mean**0.5 + 30
    least = max(0, int(mean - reach))
    k = np.arange(least + 1, int(mean + reach) + 1)
    logs = np.r_[0.0, np.cumsum(np.log(mean) - np.log(k))]
    below = np.cumsum(np.exp(logs - logs.max()))
    below /= below[-1]
    return least, below


def grow_tree(bins: np.ndarray, weight: np.ndarray, total: np.ndarray, depth: int) -> np.ndarray:
    """The leaf's mean for every cell of a tree that is split on the largest fall in variance until no split gains, ``depth`` levels at most.
    Cells without weight follow the splits. Of equal splits the first feature's lowest counts."""
    value = np.zeros(len(weight))
    here, node = np.arange(len(weight)), np.zeros(len(weight), np.int64)
    for level in range(depth + 1):
        w, s = weight[here], total[here]
        node_w = np.bincount(node, w)
        mean = np.bincount(node, s) / node_w
        value[here] = mean[node]
        if level == depth:
            break
        # Less than the first is what rounding leaves of no gain.
        best, feature, cut = ROUNDING**2 * node_w * mean**2, np.full(len(node_w), -1), np.zeros(len(node_w), np.uint8)
        for f in range(bins.shape[1]):
            gain, at = best_cuts(node, bins[here, f], w, s - w * mean[node], node_w)
            better = gain > best * (1 + ROUNDING)
            best[better], feature[better], cut[better] = gain[better], f, at[better]
        split = feature >= 0
        stay = split[node]
        here, node = here[stay], node[stay]
        if not len(here):
            break
        right = bins[here, feature[node]] > cut[node]
        node = 2 * (np.cumsum(split) - 1)[node] + right
    return value


def best_cuts(node: np.ndarray, code: np.ndarray, w: np.ndarray, s: np.ndarray, node_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node the largest gain of parting its cells after a bin, and that bin; ``s`` adds up to nothing in a node. Without a cut
    that leaves weight on both sides the gain is zero."""
    key = node * BINS + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    # Sums per node and bin, then up to each bin from the node's first.
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    on, bin_ = key[first] // BINS, key[first] % BINS
    bin_w, bin_s = np.add.reduceat(w[order], first), np.add.reduceat(s[order], first)
    starts = np.flatnonzero(np.r_[True, on[1:] != on[:-1]])
    left_w, left_s = np.cumsum(bin_w), np.cumsum(bin_s)
    left_w -= (left_w[starts] - bin_w[starts])[on]
    left_s -= (left_s[starts] - bin_s[starts])[on]
    right_w = node_w[on] - left_w
    both = (left_w > 0) & (right_w > 0)
    gain = np.zeros(len(on))
    gain[both] = left_s[both] ** 2 * (1 / left_w[both] + 1 / right_w[both])
    gain[np.isnan(gain)] = 0.0
    most = np.maximum.reduceat(gain, starts)
    hit = np.flatnonzero(gain >= most[on] * (1 - ROUNDING))
    hit = hit[np.r_[True, on[hit][1:] != on[hit][:-1]]]
    return most, bin_[hit]
