"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of character n-grams (orders 3 to 5 inside words, with word borders, hashed to ``BUCKETS``). In
how many toxic and in how many other texts each occurs gives its log-count ratio; a logistic regression is fitted on
the features scaled by these ratios. Its weights times the ratios are one number per bucket, which is all that scoring needs.

The classifier is fitted on at most ``MAX_ROWS`` labelled texts, chosen by a hash of their id; every text of the table
is scored, whole. Null and empty texts have no feature and get the score of the intercept. With no labelled text, or
with one class only, every score is that class's share (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
ORDERS = (3, 4, 5)
MAX_ROWS = 6_000
ROUNDS = 40
PENALTY = 1.0
CHUNK = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None, marks: np.ndarray) -> np.ndarray:
    """Sorted buckets of the n-grams in a whole text. ``marks``: BUCKETS flags, all false before and after."""
    text = text or ""
    for start in range(0, len(text), CHUNK):
        # Pieces of bounded size that overlap by the longest order; a border stands before and after the text.
        piece = " " * (start == 0) + text[max(0, start - max(ORDERS) + 1):start + CHUNK] + " " * (start + CHUNK >= len(text))
        points = np.frombuffer(piece.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        blank = (points == 32) | ((points >= 9) & (points <= 13))
        points = np.where(blank, 32, points).astype(np.uint64)
        inner = np.cumsum(blank)
        code = np.zeros(len(points), dtype=np.uint64)
        for order in range(1, max(ORDERS) + 1):
            size = len(points) - order + 1
            if size <= 0:
                break
            code = (code[:size] * MIX) ^ (points[order - 1:] + np.uint64(order))
            if order in ORDERS:
                # White space only at the ends: an n-gram lies inside one word.
                whole = inner[order - 2:size + order - 2] == inner[:size]
                marks[((code[whole] * MIX) >> np.uint64(46)).astype(np.int64)] = True
    found = np.flatnonzero(marks)
    marks[found] = False
    return found


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Per bucket: log of its smoothed share among positive texts over that among the others."""
    with_it = [np.ones(BUCKETS), np.ones(BUCKETS)]
    for row, label in zip(rows, labels):
        with_it[int(label)][row] += 1
    n = [2 + (labels == v).sum() for v in (0, 1)]
    return np.log((with_it[1] / n[1]) / (with_it[0] / n[0]))


def logistic(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights per bucket and intercept of a ridge logistic regression on scaled presence, by accelerated gradient steps."""
    sizes = np.array([len(r) for r in rows])
    at = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    columns = np.concatenate(rows).astype(np.int32)
    # Each text's features have length 1, so that long texts do not outweigh short ones.
    values = ratios[columns].astype(np.float32)
    values /= np.sqrt(np.maximum(np.bincount(at, weights=values ** 2, minlength=len(rows)), 1e-12)).astype(np.float32)[at]

    def margins(weights: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=values * weights[columns].astype(np.float32), minlength=len(rows))

    def gathered(slopes: np.ndarray) -> np.ndarray:
        return np.bincount(columns, weights=values * slopes[at].astype(np.float32), minlength=BUCKETS)

    share = labels.mean()
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    direction, largest = np.ones(len(rows)) / np.sqrt(len(rows)), 1.0
    for _ in range(6):  # the largest curvature bounds the step
        direction = margins(gathered(direction)) + direction.sum()
        largest = np.linalg.norm(direction)
        direction /= largest
    step = 1 / (0.3 * largest * balance.max() + PENALTY)
    weights, bias = np.zeros(BUCKETS), 0.0
    lead, lead_bias = weights, bias
    for turn in range(1, ROUNDS + 1):
        slopes = balance * (1 / (1 + np.exp(-(margins(lead) + lead_bias))) - labels)
        following, following_bias = lead - step * (gathered(slopes) + PENALTY * lead), lead_bias - step * slopes.sum()
        push = (turn - 1) / (turn + 2)
        lead, lead_bias = following + push * (following - weights), following_bias + push * (following_bias - bias)
        weights, bias = following, following_bias
    return weights, float(bias)


class Model:
    """One ratio and one weight per bucket, and the intercept."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, bias: float):
        self.ratios, self.pull, self.bias = ratios, ratios * weights, bias

    def score(self, text: str | None, marks: np.ndarray) -> float:
        held = features(text, marks)
        length = float(np.sqrt((self.ratios[held] ** 2).sum()))
        margin = self.bias + (float(self.pull[held].sum()) / length if length > 0 else 0.0)
        return float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))


def trained(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    share = labels.mean() if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels) or not any(map(len, rows)):
        clipped = np.clip(share, 1e-6, 1 - 1e-6)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), float(np.log(clipped / (1 - clipped))))
    ratios = log_count_ratios(rows, labels)
    return Model(ratios, *logistic(rows, labels, ratios))


def fit(labelled: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from texts (doc_id, text) and their labels (doc_id, toxic); null labels are not learnt from."""
    chosen = labels.filter("toxic is not null and doc_id is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = labelled.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows pairs of numbers

    def extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = np.zeros(BUCKETS, dtype=bool)
        for part in parts:
            held = [features(t, marks).astype(np.int32) for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "toxic": part["toxic"], "held": held})

    def train(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [p for p in parts if len(p)]
        rows, found = [], np.zeros(0)
        if every:
            table = pd.concat(every).sort_values("doc_id", kind="stable")
            rows, found = [np.asarray(h) for h in table["held"]], table["toxic"].to_numpy(dtype=float)
        model = trained(rows, found)
        yield pd.DataFrame({"ratios": [model.ratios.tobytes()], "pull": [model.pull.tobytes()], "bias": [model.bias]})

    # One task trains: its rows are bounded by max_rows.
    held = texts.mapInPandas(extract, "doc_id long, toxic int, held array<int>").repartition(1)
    rows = held.mapInPandas(train, "ratios binary, pull binary, bias double").collect()
    if not rows:
        return trained([], np.zeros(0))
    model = Model(np.zeros(BUCKETS), np.zeros(BUCKETS), rows[0]["bias"])
    model.ratios, model.pull = (np.frombuffer(bytes(rows[0][c])) for c in ("ratios", "pull"))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted; an own column of one of these names is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast((model.ratios, model.pull, model.bias))

    @F.pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(np.zeros(1), np.zeros(1), 0.0)
        own.ratios, own.pull, own.bias = sent.value
        marks = np.zeros(BUCKETS, dtype=bool)
        for part in parts:
            yield pd.Series([own.score(t, marks) for t in part], dtype=float)

    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), scores(F.col(text_col)).alias("score"))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    return found.select(*kept, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
