"""Hard negatives by rotated one-bit codes, whose estimates carry a sure bound, and whole-number scores of what is left.

Components are whole numbers, ``floor(256 * x)``. A vector v of D components is turned into a space of M bits (``EXPAND`` per
component) by a fixed matrix R with orthonormal columns, and its code is the signs of Rv. With c the signs over sqrt(M), the code's
own vector is p = R'c; stored beside the code are the length of v, the length of p and the alignment, the cosine of p and v. For
an anchor q, Rq is rounded to ``PLANES`` bits a component; counts of the common ones of code and bit planes give c.Rq up to
the rounding. What v has besides p's direction is at right angles to it, so by Cauchy-Schwarz

    v.q = |v| (alignment * p.q / |p|  +-  sqrt(1 - alignment^2) * sqrt(|q|^2 - (p.q / |p|)^2)),

an interval that surely holds the score. Only rows whose interval may hold one of the rows sought are scored, in whole numbers.
The result is that of comparing every anchor with every row.

Rows meet anchors in blocks: a chunk of rows is one group, anchors are copied to every chunk and, if many, dealt over decks. First
the positives of every anchor are found, then its negatives; what a block finds is bounded by the numbers asked for.

Null labels, null vectors, vectors with a null or non-finite component and rows without id take no part; nor do those whose
whole-number vector has a squared length above 2^55, as scores would not fit in a long. Zero and empty vectors score 0. Rows of
another length than the anchor's have no inner product with it and are not compared. A repeated id counts once, with the smallest of
its (label, vector). Ties go to the smaller id. An anchor without positives, or a positive without negatives, has no rows;
an empty table gives none. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.store import stored

POSITIVES = 5
NEGATIVES = 10
#: 100 times a negative's score lies between these multiples of the positive's.
LOWEST, HIGHEST = 30, 90
SCALE = 256
EXPAND = 8
PLANES = 6
MAX_SQUARE = 2.0 ** 55
#: Rows of a chunk at most (about), rows it has at least if there are as many, anchors of a deck (about).
CHUNK_ROWS = 16_384
LEAST_ROWS = 512
DECK_ANCHORS = 20_000
#: So many rows are scored before the others' intervals are judged by what these have shown.
FIRST = 64
SEED = 13

_ENCODED = "dim int, vec_id long, label long, content binary, code binary, length double, code_length double, alignment double"


@cache
def rotation(dim: int, expand: int = EXPAND, seed: int = SEED) -> np.ndarray:
    """M x dim, with orthonormal columns; M is a multiple of 64."""
    bits = 64 * max(1, -(-dim * expand // 64))
    return np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((bits, dim)))[0]


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """Rows that take part, one per id: vec_id, label, values (whole numbers)."""
    given = F.col("embedding").cast("array<double>")
    finite = F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), given.alias("given"), finite.alias("finite"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("finite"))
    square = F.aggregate("given", F.lit(0.0), lambda s, x: s + F.floor(x * SCALE).cast("double") * F.floor(x * SCALE).cast("double"))
    rows = rows.filter(square <= MAX_SQUARE).select("vec_id", "label", F.transform("given", lambda x: F.floor(x * SCALE)).alias("values"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "values")).alias("held")).select("vec_id", "held.label", "held.values")


def _whole(contents: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(contents), dtype="<i8").reshape(len(contents), dim)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of whole-number rows: codes (bytes), lengths, lengths of the codes' own vectors, alignments."""
    turn = rotation(values.shape[1])
    points = values.astype(np.float64)
    bits = points @ turn.T > 0
    own = np.where(bits, 1.0, -1.0) @ turn / np.sqrt(len(turn))
    length, code_length = np.sqrt((points ** 2).sum(axis=1)), np.sqrt((own ** 2).sum(axis=1))
    both = length * code_length
    alignment = np.where(both > 0, (points * own).sum(axis=1) / np.where(both > 0, both, 1.0), 0.0)
    return np.packbits(bits, axis=1, bitorder="little"), length, code_length, alignment


def encoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for table in parts:
        for dim, rows in table.groupby(table["values"].map(len)):
            for start in range(0, len(rows), 2048):
                piece = rows.iloc[start:start + 2048]
                values = np.stack(piece["values"].to_numpy()).astype("<i8").reshape(len(piece), dim)
                codes, length, code_length, alignment = encode(values)
                yield pd.DataFrame({
                    "dim": np.int32(dim), "vec_id": piece["vec_id"].to_numpy(), "label": piece["label"].to_numpy(),
                    "content": [v.tobytes() for v in values], "code": [c.tobytes() for c in codes],
                    "length": length, "code_length": code_length, "alignment": alignment})


class Block:
    """Rows of one length of vector, sorted by label, with their codes."""

    def __init__(self, rows: pd.DataFrame, dim: int):
        rows = rows.sort_values(["label", "vec_id"])
        self.dim, self.ids, self.labels = dim, rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        self.values = _whole(rows["content"], dim)
        # One row per word of the codes: a word of all rows is worked at once.
        words = np.frombuffer(b"".join(rows["code"]), dtype="<u8").reshape(len(rows), -1)
        self.words = np.ascontiguousarray(words.T)
        self.ones = np.bitwise_count(self.words).sum(axis=0, dtype=np.int64)
        self.length, code_length, alignment = (rows[c].to_numpy(float) for c in ("length", "code_length", "alignment"))
        self.sure = code_length > 1e-6
        self.code_length = np.where(self.sure, code_length, 1.0)
        self.factor = np.where(self.sure, self.length * alignment / self.code_length, 0.0)
        self.beside = np.where(self.sure, self.length * np.sqrt(np.maximum(0.0, 1.0 - alignment ** 2)), self.length)

    def slice_of(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))

    def intervals(self, query: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Bounds that surely hold the scores of the rows in ``part``."""
        turn = rotation(self.dim)
        q = query.astype(np.float64)
        size = float(np.sqrt(q @ q))
        turned = turn @ q
        low = turned.min()
        step = (turned.max() - low) / ((1 << PLANES) - 1) or 1.0
        steps = np.rint((turned - low) / step).astype(np.uint8)
        off = float(np.sqrt(((turned - (low + step * steps)) ** 2).sum()))
        words = self.words[:, part]
        common = np.zeros(words.shape[1], dtype=np.int64)
        for j in range(PLANES):
            plane = np.packbits((steps >> j) & 1, bitorder="little").view("<u8")
            count = np.zeros(words.shape[1], dtype=np.uint32)
            for word, mask in zip(words, plane):
                count += np.bitwise_count(word & mask)
            common += count.astype(np.int64) << j
        # Signs are two times the bits less one.
        dot = (2.0 * low * self.ones[part] + 2.0 * step * common - (low * len(turn) + step * float(steps.sum()))) / np.sqrt(len(turn))
        along = np.where(self.sure[part], np.maximum(0.0, np.abs(dot) - off) / self.code_length[part], 0.0)
        middle = self.factor[part] * dot
        # The last terms are far above what rounding can move.
        half = (np.abs(self.factor[part]) * off + self.beside[part] * np.sqrt(np.maximum(0.0, size ** 2 - along ** 2))
                + 1e-9 * size * self.length[part] + 1e-6)
        return middle - half, middle + half

    def positives(self, own_id: int, label: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the first k other rows of the label."""
        part = self.slice_of(label)
        ids = self.ids[part]
        if not len(ids):
            return ids, ids
        lower, upper = self.intervals(query, part)
        lower, upper = (np.where(ids == own_id, -np.inf, x) for x in (lower, upper))
        left = np.flatnonzero(upper > -np.inf)
        if len(left) > k:
            left = left[upper[left] >= np.partition(lower[left], -k)[-k]]
        scores = self.values[part][left] @ query
        order = np.lexsort((ids[left], -scores))[:k]
        return ids[left][order], scores[order]

    def negatives(self, label: int, query: np.ndarray, positive_scores: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per positive, ids and scores of the first k rows of other labels between its bounds."""
        lower, upper = self.intervals(query, slice(None))
        other = np.ones(len(self.ids), dtype=bool)
        other[self.slice_of(label)] = False
        scores, known = np.zeros(len(self.ids), dtype=np.int64), np.zeros(len(self.ids), dtype=bool)

        def scored(places: np.ndarray) -> np.ndarray:
            new = places[~known[places]]
            scores[new] = self.values[new] @ query
            known[new] = True
            return scores[places]

        for positive in positive_scores.tolist():
            least, most = -(-LOWEST * positive // 100), HIGHEST * positive // 100
            left = np.flatnonzero(other & (upper >= least) & (lower <= most)) if least <= most else np.zeros(0, dtype=np.int64)
            if len(left) > max(FIRST, k):
                # Those whose estimate is nearest the upper bound first: a k-th score found among them rules out most others.
                far = np.abs(lower[left] + upper[left] - 2 * most)
                first = left[np.argpartition(far, FIRST)[:FIRST]]
                shown = scored(first)
                shown = shown[(shown >= least) & (shown <= most)]
                if len(shown) >= k:
                    left = left[upper[left] >= np.partition(shown, -k)[-k]]
            found = scored(left)
            inside = (found >= least) & (found <= most)
            left, found = left[inside], found[inside]
            order = np.lexsort((self.ids[left], -found))[:k]
            yield self.ids[left][order], found[order]


def mine(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         chunk_rows: int = CHUNK_ROWS, deck_anchors: int = DECK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score of (vec_id, embedding) rows.

    ``label`` is an expression over ``vectors``, ``is_anchor`` one over vec_id.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, label).mapInPandas(encoded, _ENCODED))
    facts = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors")).first()
    cores = spark.sparkContext.defaultParallelism
    chunks = max(1, -(-facts["n"] // chunk_rows), min(2 * cores, facts["n"] // LEAST_ROWS))
    decks = max(1, -(-facts["anchors"] // deck_anchors))

    def every(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)

    place = F.xxhash64("vec_id")
    blocks = rows.select("*", F.pmod(place, F.lit(chunks)).alias("chunk"), every(decks, "deck"))
    # Names of their own, as both sides come from the same rows.
    anchors = rows.filter(is_anchor).select(
        F.col("vec_id").alias("anchor_id"), F.col("dim").alias("of_dim"), F.col("label").alias("of_label"), F.col("content").alias("query"),
        F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(decks)).alias("of_deck"))

    def meet(asked: DataFrame, function, schema: str) -> DataFrame:
        asked = asked.select("*", every(chunks, "of_chunk"))
        return blocks.groupBy("dim", "chunk", "deck").cogroup(asked.groupBy("of_dim", "of_chunk", "of_deck")).applyInPandas(function, schema)

    def near(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asked):
            dim = int(own["dim"].iloc[0])
            block, queries = Block(own, dim), _whole(asked["query"], dim)
            for anchor, name, query in zip(asked["anchor_id"].tolist(), asked["of_label"].tolist(), queries):
                ids, scores = block.positives(anchor, name, query, positives)
                out.append(pd.DataFrame({"anchor_id": anchor, "positive_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "positive_id": [], "score": []}, dtype="int64")

    found = meet(anchors, near, "anchor_id long, positive_id long, score long")
    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    best = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= positives)
    pairs = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("held"))
    pairs = stored(pairs.select("anchor_id", F.col("held.positive_id").alias("positive_ids"), F.col("held.score").alias("positive_scores")))

    def far(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asked):
            dim = int(own["dim"].iloc[0])
            block, queries = Block(own, dim), _whole(asked["query"], dim)
            for anchor, name, query, ids, scores in zip(asked["anchor_id"].tolist(), asked["of_label"].tolist(), queries, asked["positive_ids"], asked["positive_scores"]):
                scores = np.asarray(scores, dtype=np.int64)
                for positive, score, (others, values) in zip(ids, scores, block.negatives(name, query, scores, negatives)):
                    if len(others):
                        out.append(pd.DataFrame({"anchor_id": anchor, "positive_id": positive, "positive_score": score,
                                                 "negative_id": others, "negative_score": values}))
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in names}, dtype="int64")

    asked = anchors.join(pairs, "anchor_id")
    held = meet(asked, far, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    by_value = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = held.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
