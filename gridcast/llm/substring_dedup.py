"""Substring dedup by anchored window hashing against blocks of earlier documents.

Every text is cut into words. Each window of ``size`` words belongs to the anchor inside it: the ``ANCHOR``-word run with the
smallest hash. Equal windows have equal anchors, so a text falls into blocks, one per anchor, and two texts can share a
window only in blocks of one anchor. These blocks, indexed by anchor, are the reference; a document is compared with those
of all documents with a smaller id:

- a block that also stands whole in an earlier document is found by the block's hash;
- the first document that has a block, if other blocks of the same anchor exist, is checked window by window, which also
  settles the windows that lie across block boundaries.

This is no Lempel-Ziv parse. Found pieces that overlap or touch make one run, whichever earlier documents they come from; the runs are
given as ``factors``, have at least ``size`` words, and their words are removed. Windows are judged on the input. A hot anchor is reduced to its distinct blocks before the shuffle, and windows
are grouped by their own hash, so no task gathers all texts that share a passage. Hashes are two of 64 bits.

White space is what separates words; null and empty texts have none. A null id is never smaller than another: such rows
keep all words and are no reference. Rows that repeat an id are no reference for each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.store import few, narrowed, stored

SIZE = 50
ANCHOR = 10
MIX = 0x9E3779B97F4A7C15
BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n + 1, dtype=U)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


class Texts:
    """Words of many texts at once: byte ranges in one array, and 64-bit hashes of words and of runs of words."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined, dtype=np.uint8)
        blank = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        edges = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=np.int8(1)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        limits = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, limits)
        self.words = self._run_hashes(self.data.astype(U) + U(1), 0x2545F4914F6CDD1D)(self.starts, self.ends)
        self.words = scrambled(self.words)
        self.runs = [self._run_hashes(scrambled(self.words ^ U(i)), base) for i, base in enumerate(BASES)]

    @staticmethod
    def _run_hashes(values: np.ndarray, base: int):
        """A function from ranges [a, b) of ``values`` to hashes that depend on nothing but what is in them."""
        inverse = _powers(pow(base, -1, 1 << 64), len(values))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(values * _powers(base, len(values))[:-1], dtype=U)])
        return lambda a, b: (sums[b] - sums[a]) * inverse[a]


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(MIX)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def blocks_of(texts: Texts, size: int) -> dict[str, np.ndarray]:
    """The blocks of all texts: text number, place of the first window, number of windows, anchor and block hashes."""
    anchors = texts.first[1:] - texts.first[:-1]
    span = size - ANCHOR + 1
    owner = np.repeat(np.arange(len(anchors)), np.maximum(0, anchors - size + 1))
    begin = np.concatenate([np.arange(a, b - size + 1) for a, b in zip(texts.first[:-1], texts.first[1:]) if b - a >= size] or [np.zeros(0, np.int64)])
    if not len(begin):
        return {k: np.zeros(0, np.int64) for k in ("text", "start", "n", "anchor", "hash")}
    n_runs = len(texts.words) - ANCHOR + 1
    low = scrambled(texts.runs[0](np.arange(n_runs), np.arange(ANCHOR, n_runs + ANCHOR)))
    # The leftmost smallest of the runs in each window, by doubling.
    place, width = np.arange(n_runs), 1
    while width * 2 <= span:
        left, right = place[:-width], place[width:]
        place, width = np.where(low[right] < low[left], right, left), width * 2
    left, right = place[begin], place[begin + span - width]
    at = np.where(low[right] < low[left], right, left)
    cut = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    n = np.diff(cut, append=len(at))
    start, anchor = begin[cut], at[cut]
    content = scrambled(texts.runs[1](start, start + n + size - 1) ^ scrambled(n.astype(U) * U(MIX) + (anchor - start).astype(U)))
    return {"text": owner[cut], "start": start - texts.first[owner[cut]], "n": n, "anchor": signed(low[anchor]), "hash": signed(content)}


def encoded(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def pieces(table: pd.DataFrame, characters: int = 1 << 18) -> Iterator[pd.DataFrame]:
    """A table in parts of bounded text, at least a row each."""
    sizes = np.array([len(t) if isinstance(t, str) else 0 for t in table["text"]])
    part = np.cumsum(sizes) // characters
    for _, rows in table.groupby(part, sort=False):
        yield rows


def _emit_blocks(size: int):
    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in parts:
            for rows in pieces(table):
                found = blocks_of(Texts(encoded(rows["text"])), size)
                yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[found["text"]], "key": rows["key"].to_numpy()[found["text"]],
                                    "start": found["start"].astype(np.int32), "n": found["n"].astype(np.int16),
                                    "anchor": found["anchor"], "hash": found["hash"]})

    return emit


def _emit_windows(size: int):
    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in parts:
            for rows in pieces(table):
                texts = Texts(encoded(rows["text"]))
                held = rows["starts"].map(np.asarray).to_numpy()
                begin = np.concatenate([np.repeat(s, c) + np.concatenate([np.arange(k) for k in c]) for s, c in zip(held, rows["ns"].map(np.asarray))])
                owner = np.repeat(np.arange(len(rows)), [int(np.sum(c)) for c in rows["ns"]])
                at = texts.first[owner] + begin
                yield pd.DataFrame({
                    "doc_id": rows["doc_id"].to_numpy()[owner], "key": rows["key"].to_numpy()[owner], "start": begin.astype(np.int32),
                    "one": signed(texts.runs[0](at, at + size)), "two": signed(texts.runs[1](at, at + size))})

    return emit


def _emit_kept(size: int):
    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in parts:
            for rows in pieces(table):
                n_words, removed, kept, factors = [], [], [], []
                for text, starts, ns in zip(encoded(rows["text"]), rows["starts"], rows["ns"]):
                    words = text.split()
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    found = []
                    if starts is not None:
                        # A run goes on as long as the next window is found before it ends.
                        for start, n in sorted(zip(starts, ns)):
                            end = int(start) + int(n) + size - 1
                            if found and start <= found[-1][1]:
                                found[-1][1] = max(found[-1][1], end)
                            else:
                                found.append([int(start), end])
                        for start, end in found:
                            gone[start] += 1
                            gone[end] -= 1
                    out = np.cumsum(gone[:-1]) > 0
                    left = b" ".join(w for w, g in zip(words, out) if g == 0) if len(found) else b" ".join(words)
                    n_words.append(len(words))
                    removed.append(int(out.sum()))
                    kept.append(left.decode("utf-8", "surrogatepass"))
                    factors.append(found)
                yield rows.drop(columns=["text", "starts", "ns"]).assign(n_words=n_words, n_removed=removed, kept=kept, factors=factors)

    return emit


def duplicate_runs(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Windows of (doc_id, key, text) rows that also start in a document with a smaller id, as runs: doc_id, key, start, n."""
    known = docs.filter("doc_id is not null and text is not null")
    blocks = known.mapInPandas(_emit_blocks(size), "doc_id long, key long, start int, n short, anchor long, hash long")
    # Distinct blocks, each with the first document that has it; only anchors that two documents share go on.
    classes = blocks.groupBy("anchor", "hash").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"))
    classes = stored(classes)
    shared = classes.groupBy("anchor").agg(F.count("*").alias("n_blocks"), F.min("lowest").alias("a"), F.max("highest").alias("b"))
    shared = shared.filter("a < b").select("anchor", "n_blocks")
    wanted = classes.join(shared, "anchor").select("anchor", "hash", "lowest", "n_blocks")
    mine = stored(blocks.join(wanted, ["anchor", "hash"]).filter("lowest < doc_id or n_blocks > 1"))
    whole = mine.filter("lowest < doc_id").select("doc_id", "key", "start", "n")
    # Of a block that several documents have, the first one's windows stand for all.
    open_blocks = mine.filter("lowest = doc_id").groupBy("doc_id", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))
    open_blocks = stored(open_blocks)
    open_docs = narrowed(known, open_blocks.select("doc_id").distinct(), "doc_id")
    windows = stored(open_docs.join(open_blocks, ["doc_id", "key"]).mapInPandas(_emit_windows(size), "doc_id long, key long, start int, one long, two long"))
    first = windows.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    single = windows.join(first, ["one", "two"]).filter("first < doc_id").select("doc_id", "key", "start", F.lit(1).cast("short").alias("n"))
    return whole.unionByName(single)


def remove_duplicates(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows of (doc_id, text): doc_id, n_words, n_removed, kept (words joined by a blank), factors (from, to)."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    runs = stored(duplicate_runs(keyed, size).groupBy("doc_id", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns")))
    ids = runs.select("doc_id").distinct()
    parts = [keyed]
    if few(ids):
        # Documents that lose nothing need not be shuffled.
        parts = [keyed.join(F.broadcast(ids), "doc_id", "left_semi"), keyed.join(F.broadcast(ids), "doc_id", "left_anti")]
    joined = parts[0].join(runs, ["doc_id", "key"], "left").select("doc_id", "text", "starts", "ns")
    for rest in parts[1:]:
        joined = joined.unionByName(rest.select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("array<smallint>").alias("ns")))
    # As text: beside a null, pandas holds whole numbers as floats, which changes large ids.
    done = joined.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        _emit_kept(size), "doc_id string, n_words long, n_removed long, kept string, factors array<array<long>>")
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))

