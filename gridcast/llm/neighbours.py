"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Vectors get one more component that makes all norms equal, so that the largest inner product is the nearest point. A tree
splits at the median of a projection on the difference of two points, level by level; it is fitted on a bounded sample, and
the forest (``trees * 2**depth`` directions) goes to the tasks. Every row is indexed under its leaf in each tree. A query
walks all trees through one priority queue, ordered by the smallest margin on the way, and takes leaves until they hold
``share`` of the rows; queries and rows meet by leaf, and the inner products on the original vectors, in double precision,
give the ranks. A leaf of many rows, or one sought by many queries, is dealt to several tasks.

Null and zero vectors, and those with null or non-finite components, another length than most, or no id, take no part.
Of equal vectors only the ``k + 1`` smallest ids can be among the nearest, and only these are indexed. A repeated id
counts once, with the smallest of its vectors. Fewer candidates than ``k`` give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.store import stored

TREES = 24
DEPTH = 7
SHARE = 0.8
SAMPLE = 20_000
MIN_LEAF = 64
LEAF_ROWS = 4096
LEAF_QUERIES = 20_000
SEED = 7


class Forest:
    """Per tree and inner node a direction and a threshold, as a heap; per leaf its share of the sample."""

    def __init__(self, directions: np.ndarray, thresholds: np.ndarray, weights: np.ndarray):
        self.directions, self.thresholds, self.weights = directions, thresholds, weights
        self.depth = int(np.log2(weights.shape[1]))

    @classmethod
    def fit(cls, points: np.ndarray, trees: int, depth: int, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        inner, dim = 2 ** depth - 1, points.shape[1]
        directions = rng.standard_normal((trees, inner, dim)).astype(np.float32)
        thresholds, weights = np.zeros((trees, inner), np.float32), np.zeros((trees, inner + 1))
        for tree in range(trees):
            held = [np.arange(len(points))]
            for node in range(inner):
                own = held[node]
                if len(own) > 1:
                    first, second = rng.choice(own, 2, replace=False)
                    if (points[first] != points[second]).any():
                        directions[tree, node] = points[first] - points[second]
                    side = points[own] @ directions[tree, node]
                    thresholds[tree, node] = np.median(side)
                    right = side > thresholds[tree, node]
                else:
                    right = np.zeros(len(own), dtype=bool)
                held += [own[~right], own[right]]
            weights[tree] = [len(h) for h in held[inner:]]
        return cls(directions, thresholds, weights / max(1, len(points)))

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """The leaf of every point in every tree."""
        out = np.zeros((len(points), len(self.directions)), dtype=np.int32)
        for tree, (directions, thresholds) in enumerate(zip(self.directions, self.thresholds)):
            node = np.zeros(len(points), dtype=np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", points, directions[node]) > thresholds[node]
                node = 2 * node + 1 + right
            out[:, tree] = node - len(thresholds)
        return out

    def search(self, point: np.ndarray, share: float) -> list[tuple[int, int]]:
        """Leaves in the order of the shared queue, until they hold ``share`` of the rows. At least one per tree."""
        margins = self.directions @ point - self.thresholds
        inner = self.thresholds.shape[1]
        queue = [(-np.inf, tree, 0) for tree in range(len(margins))]
        found, held, seen = [], 0.0, set()
        while queue and (held < share or len(seen) < len(margins)):
            priority, tree, node = heapq.heappop(queue)
            if node >= inner:
                if held < share or tree not in seen:
                    found.append((tree, node - inner))
                    held += self.weights[tree, node - inner]
                    seen.add(tree)
                continue
            margin = float(margins[tree, node])
            heapq.heappush(queue, (max(priority, -margin), tree, 2 * node + 2))
            heapq.heappush(queue, (max(priority, margin), tree, 2 * node + 1))
        return found


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part, one per id: vec_id, embedding as doubles."""
    values = F.col("embedding").cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists(values, lambda x: x != 0.0), F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding"))
    common = rows.groupBy(F.size("embedding").alias("n")).agg(F.countDistinct("vec_id").alias("count")).orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("embedding") == (common["n"] if common else 0))
    return stored(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))


def dealt(ids: np.ndarray, n: int) -> np.ndarray:
    """A share from 0 to n - 1 for each id, even for ids in steps."""
    return ((ids * 0x9E3779B1) >> 15) % n


def matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values]) if len(values) else np.zeros((0, 1))


def levelled(points: np.ndarray, largest: float) -> np.ndarray:
    """Points with the component that makes their norms equal."""
    rest = np.sqrt(np.maximum(0.0, largest ** 2 - (points ** 2).sum(axis=1)))
    return np.concatenate([points, rest[:, None]], axis=1).astype(np.float32)


def best(rows: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of largest inner product, computed one way only, so that equal vectors have equal scores."""
    scores = (rows * query).sum(axis=1)
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, depth: int = DEPTH, share: float = SHARE,
            sample: int = SAMPLE) -> DataFrame:
    """For each row with ``is_query``: query_id, rank (from 1), vec_id, score of its k nearest other rows found."""
    rows = usable(vectors)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("square"),
                     F.count_if(is_query).alias("queries")).first()
    schema = "query_id long, ids array<long>, scores array<double>"
    if not facts["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    depth = max(0, min(depth, int(np.log2(facts["n"] / MIN_LEAF)))) if facts["n"] > MIN_LEAF else 0
    largest = float(np.sqrt(facts["square"]))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    part = rows.filter(place <= (1 << 30) * min(1.0, sample / facts["n"])).orderBy(place, "vec_id").limit(sample)
    picked = matrix([r["embedding"] for r in part.select("embedding").collect()])  # at most `sample` rows
    forest = Forest.fit(levelled(picked, largest) if len(picked) else np.zeros((0, 2), np.float32), trees, depth)
    sent = vectors.sparkSession.sparkContext.broadcast((forest.directions, forest.thresholds, forest.weights))
    chunks = -(-facts["n"] // (2 ** depth * LEAF_ROWS))
    decks = max(1, -(-int(facts["queries"] * share) // (trees * LEAF_QUERIES)))

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Forest(*sent.value)
        for table in parts:
            if not len(table):
                continue
            leaves = held.leaves(levelled(matrix(table["embedding"]), largest))
            for tree in range(leaves.shape[1]):
                yield pd.DataFrame({"tree": tree, "leaf": leaves[:, tree], "chunk": dealt(table["vec_id"].to_numpy(), chunks),
                                    "vec_id": table["vec_id"], "embedding": table["embedding"]})

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Forest(*sent.value)
        for table in parts:
            for start in range(0, len(table), 256):
                piece = table.iloc[start:start + 256]
                points = np.concatenate([matrix(piece["embedding"]), np.zeros((len(piece), 1))], axis=1).astype(np.float32)
                visits = [held.search(p, share) for p in points]
                at = np.repeat(np.arange(len(piece)), [len(v) for v in visits])
                flat = np.array([x for v in visits for x in v], dtype=np.int32)
                ids = piece["vec_id"].to_numpy()[at]
                yield pd.DataFrame({"tree": flat[:, 0], "leaf": flat[:, 1], "deck": dealt(ids, decks), "vec_id": ids,
                                    "embedding": piece["embedding"].to_numpy()[at]})

    equal = Window.partitionBy("embedding").orderBy("vec_id")
    fewest = rows.withColumn("place", F.row_number().over(equal)).filter(F.col("place") <= k + 1).drop("place")
    indexed = fewest.mapInPandas(index, "tree int, leaf int, chunk long, vec_id long, embedding array<double>")
    indexed = indexed.withColumn("deck", F.explode(F.array(*(F.lit(d).cast("long") for d in range(decks)))))
    sought = rows.filter(is_query).mapInPandas(walk, "tree int, leaf int, deck long, vec_id long, embedding array<double>")
    sought = sought.withColumn("chunk", F.explode(F.array(*(F.lit(c).cast("long") for c in range(chunks)))))

    def meet(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(own) and len(asked):
            points, ids = matrix(own["embedding"]), own["vec_id"].to_numpy()
            for start in range(0, len(asked), 512):
                piece = asked.iloc[start:start + 512]
                queries = matrix(piece["embedding"])
                rough = queries @ points.T
                # A few more than k, all above the k-th by more than rounding can move it.
                for query, line, own_id in zip(queries, rough, piece["vec_id"].to_numpy()):
                    line = np.where(ids == own_id, -np.inf, line)
                    if len(line) > k:
                        kth = np.partition(line, -k)[-k]
                        near = np.flatnonzero((line >= kth - 1e-9 * max(1.0, largest ** 2)) & (line > -np.inf))
                    else:
                        near = np.flatnonzero(line > -np.inf)
                    if len(near):
                        out.append((own_id, *best(points[near], ids[near], query, k)))
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    keys = ["tree", "leaf", "chunk", "deck"]
    found = indexed.groupBy(*keys).cogroup(sought.groupBy(*keys)).applyInPandas(meet, schema)

    def merge(lines: pd.DataFrame) -> pd.DataFrame:
        ids, first = np.unique(np.concatenate(list(lines["ids"])), return_index=True)
        scores = np.concatenate(list(lines["scores"]))[first]
        order = np.lexsort((ids, -scores))[:k]
        return pd.DataFrame({"query_id": lines["query_id"].iloc[0], "rank": np.arange(1, len(order) + 1, dtype=np.int32),
                             "vec_id": ids[order], "score": scores[order]})

    # A query's lines are bounded by the leaves it visits.
    return found.groupBy("query_id").applyInPandas(merge, "query_id long, rank int, vec_id long, score double")
