"""Language identification by the nearest of several centroids per language.

A text becomes a vector of character n-gram counts (orders 1 to 3, hashed to ``BUCKETS``), damped, weighted by inverse
document frequency and scaled to length 1. The vectors of each language's labelled texts are clustered into a few
centroids by spherical k-means. A text gets the language of the centroid with the largest cosine; if even that is
below the floor of the language for texts of its length, or the text has no letter, it is rejected.

A floor is ``SLACK`` times a low quantile of the cosines of labelled texts, each cut to the shortest length of the class and
scored by centroids of the other half of its language's texts. A class of less than ``LEAST`` such texts has the floor of the
next shorter one; the shortest texts have ``REJECT``.

The model is fitted on at most about ``SAMPLE`` different labelled texts a language, chosen by a hash of their text; every text of
the table is scored, whole. A null language is not learnt from. Null texts and texts without a letter get ``und`` and
score 0. Without any labelled text everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.llm.store import few, stored

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SAMPLE = 1500
CENTROIDS = 4
ROUNDS = 12
REJECT = 0.1
#: Lengths (letters, and one blank between words) from which on a floor of its own holds.
LENGTHS = (16, 64, 256, 1024)
QUANTILE = 0.005
SLACK = 0.85
LEAST = 20
CHUNK = 1 << 20
#: Texts whose vectors are made or added up at a time.
PIECE = 64
UNKNOWN = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)


LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For every code point: is it a letter?"""
    if not LETTERS:
        LETTERS.append(np.char.isalpha(np.arange(0x110000, dtype="<u4").view("<U1")))
    return LETTERS[0]


def counts(text: str | None) -> np.ndarray:
    """Hashed n-gram counts of a whole text: letters in lower case, each run of anything else as one blank.

    The text is taken in pieces of bounded size; each goes on from the last characters of the one before.
    """
    total = np.zeros(BUCKETS, dtype=np.float64)
    text = text or ""
    tail = np.full(1, 32, dtype=np.uint64)
    for start in range(0, len(text), CHUNK):
        raw = np.frombuffer(text[start:start + CHUNK].lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        points = np.where(letter_table()[raw], raw, 32).astype(np.uint64)
        points = np.concatenate([tail, points, np.full(int(start + CHUNK >= len(text)), 32, dtype=np.uint64)])
        fresh = np.ones(len(points), dtype=bool)
        fresh[1:] = (points[1:] != 32) | (points[:-1] != 32)
        fresh[:len(tail)] = True
        points, known = points[fresh], len(tail)
        code = np.zeros(len(points), dtype=np.uint64)
        for order in range(1, max(ORDERS) + 1):
            size = len(points) - order + 1
            if size <= 0:
                break
            code = (code[:size] * MIX) ^ (points[order - 1:] + np.uint64(order))
            if order in ORDERS:
                hashed = (code[max(0, known - order + 1):] * MIX) >> np.uint64(65 - BUCKETS.bit_length())
                total += np.bincount(hashed.astype(np.int64), minlength=BUCKETS)
        tail = points[1 - max(ORDERS):]
    return total


def vectors(texts, idf: np.ndarray) -> np.ndarray:
    """Unit vectors, made in pieces into their place so that little is held besides them."""
    rows = np.empty((len(texts), BUCKETS), dtype=np.float32)
    for start in range(0, len(texts), PIECE):
        rows[start:start + PIECE] = unit(np.sqrt(np.stack([counts(t) for t in texts[start:start + PIECE]])) * idf)
    return rows


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(norms > 0, norms, 1)).astype(np.float32)


def summed(rows: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The sum of the rows at these places, in their order, without a copy of them all."""
    total = rows[taken[:PIECE]].sum(axis=0)
    for start in range(PIECE, len(taken), PIECE):
        total = np.concatenate([total[None], rows[taken[start:start + PIECE]]]).sum(axis=0)
    return total


def clustered(rows: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means; the first centres are picked far apart, without chance."""
    centres = [rows.mean(axis=0)]
    nearest = rows @ unit(np.stack(centres))[0]
    while len(centres) < min(k + 1, len(rows) + 1):
        far = int(nearest.argmin())
        centres.append(rows[far])
        nearest = np.maximum(nearest, rows @ rows[far])
    centres = unit(np.stack(centres[1:] or centres))
    for _ in range(rounds):
        owner = (rows @ centres.T).argmax(axis=1)
        sums = np.stack([summed(rows, np.flatnonzero(owner == c)) if (owner == c).any() else centres[c] for c in range(len(centres))])
        centres = unit(sums)
    return centres


def floors(texts: list[str], rows: np.ndarray, idf: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Per length class, the shortest first, the cosine below which a text is in none of the learnt languages."""
    halves = [clustered(rows[i::2], k, rounds) for i in (1, 0)] if len(texts) > 1 else []
    found = [REJECT]
    for length in LENGTHS:
        cosines = []
        for i, other in enumerate(halves):
            cut = [t[:length] for t in texts[i::2] if len(t) >= length]
            cosines += [(vectors(cut[start:start + PIECE], idf) @ other.T).max(axis=1) for start in range(0, len(cut), PIECE)]
        held = np.concatenate(cosines) if cosines else np.zeros(0)
        found.append(SLACK * float(np.quantile(held, QUANTILE)) if len(held) >= LEAST else found[-1])
    return np.array(found)


class Model:
    """Inverse document frequencies, and centroids with their language and floors: of a size that does not grow with the data."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, names: list[str], floors: np.ndarray):
        self.idf, self.centroids, self.names, self.floors = idf, centroids, names, floors

    def predict(self, texts: pd.Series) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and the score below which the text is rejected."""
        letters = [isinstance(t, str) and any(map(str.isalpha, t)) for t in texts]
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), REJECT)
        names, scores, least = [], np.zeros(len(texts)), np.zeros(len(texts))
        for start in range(0, len(texts), PIECE):
            part = [t if isinstance(t, str) else "" for t in texts.iloc[start:start + PIECE]]
            rows = np.stack([counts(t) for t in part])
            cosines = unit(np.sqrt(rows) * self.idf) @ self.centroids.T
            best = cosines.argmax(axis=1)
            scores[start:start + PIECE] = cosines[np.arange(len(part)), best]
            # Every place counts once in each order.
            least[start:start + PIECE] = self.floors[best, np.searchsorted(LENGTHS, rows.sum(axis=1) / len(ORDERS), side="right")]
            names += [self.names[b] for b in best]
        known = np.array(letters, dtype=bool)
        return [n if k else UNKNOWN for n, k in zip(names, known)], np.where(known, np.clip(scores, 0.0, 1.0), 0.0), least


def fit(labelled: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """A model from rows (text, lang); rows without text or language are left out."""
    usable = labelled.filter("text is not null and lang is not null").select("text", "lang")
    # Copies count once: hashes are counted, and each task hands on one copy of a chosen text.
    sizes = stored(usable.select("lang", F.xxhash64("text").alias("one")).distinct().groupBy("lang").agg(F.count("*").alias("n")))
    sizes = F.broadcast(sizes) if few(sizes) else sizes
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    chosen = stored(usable.join(sizes, "lang").filter(place * F.col("n") <= sample * F.lit(1 << 30).cast("double")).select("lang", "text").distinct())

    def frequencies(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for part in parts:
            for text in part["text"]:
                seen += counts(text) > 0
                n += 1
        yield pd.DataFrame({"seen": [seen], "n": [n]})

    summed = chosen.mapInPandas(frequencies, "seen array<bigint>, n bigint").collect()  # a row of BUCKETS numbers a partition
    n = sum(r["n"] for r in summed)
    seen = np.sum([r["seen"] for r in summed], axis=0) if summed else np.zeros(BUCKETS)
    idf = np.log((1 + n) / (1 + np.asarray(seen, dtype=np.float64))) + 1

    def centroids(part: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(part["text"])
        rows = vectors(texts, idf)
        least = floors(texts, rows, idf, k, ROUNDS)
        return pd.DataFrame({"lang": part["lang"].iloc[0], "centroid": [r.astype(float) for r in clustered(rows, k, ROUNDS)]}).assign(
            floors=lambda found: [least] * len(found))

    found = chosen.groupBy("lang").applyInPandas(centroids, "lang string, centroid array<double>, floors array<double>").collect()  # k rows a language
    found.sort(key=lambda r: (r["lang"], r["centroid"]))
    stacked = np.array([r["centroid"] for r in found], dtype=np.float32).reshape(-1, BUCKETS)
    least = np.array([r["floors"] for r in found], dtype=np.float64).reshape(-1, len(LENGTHS) + 1)
    return Model(idf, stacked, [r["lang"] for r in found], least)


def _found(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """The whole row, and lang_pred, score and least (the floor) as ``found``."""
    sent = docs.sparkSession.sparkContext.broadcast((model.idf, model.centroids, model.names, model.floors))

    @F.pandas_udf("lang_pred string, score double, least double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores, least = Model(*sent.value).predict(texts)
        return pd.DataFrame({"lang_pred": names, "score": scores, "least": least})

    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), predict(F.col(text_col)).alias("found"))


def _rejected(reject: float | None) -> Column:
    return (F.col("found.lang_pred") == UNKNOWN) | (F.col("found.score") < (F.col("found.least") if reject is None else F.lit(reject)))


def identify(docs: DataFrame, model: Model, reject: float | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; an own column of one of these names is replaced.
    ``reject`` puts one number in place of the floors."""
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return _found(docs, model, text_col).select(
        *kept, F.col("found.lang_pred").alias("lang_pred"), F.col("found.score").alias("score"), _rejected(reject).alias("rejected"))


def keep_known(docs: DataFrame, model: Model, reject: float | None = None, text_col: str = "text") -> DataFrame:
    """``docs``, all columns as they are, without the rows that are rejected."""
    return _found(docs, model, text_col).filter(~_rejected(reject)).select("row.*")
