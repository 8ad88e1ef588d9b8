"""Near-duplicate documents by DartMinHash signatures and banding.

A document is the weighted set of its ``SHINGLE``-word runs, weights being how often each occurs; words are runs of digits,
letters and non-ASCII characters with A-Z in lower case, and a shorter text is one run. Over each unit of an element's weight
the same hashed darts fall in every document, at ranks with exponential gaps, each on one of ``COORDINATES`` coordinates. A
document throws only darts below a rank at which it expects all its coordinates to be hit, whatever its size, and keeps the
earliest per coordinate. Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.

Texts of equal words are one node. Nodes that agree in a band are first compared with one of them only, the one that meets most
others, which joins groups of copies of any size in as many comparisons as they have members. Then those that share a band but
are still in different components are compared with each other in tiles, within tasks, but for texts whose runs that any other
text shares show that they cannot be alike to one: no pair that could be alike and meets in a band is left out. All comparisons are
exact; at a similarity of 0.8 a pair meets in some band with probability 1 - 5e-8. Classes are the connected components.

The class of a document is the smallest id in it. Texts without words are each their own class; so are rows without an id,
with a null class. An id stands for one text: repeated rows fall together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.llm.store import few, narrowed, stored
from gridcast.llm.substring_dedup import Texts, encoded, pieces, scrambled, signed

SHINGLE = 5
COORDINATES = 128
BAND = 4
SIMILARITY = 0.8
#: Nodes that share a band are compared in tiles of two chunks, which hold about so many nodes and units of weight each.
CHUNK_NODES = 1024
CHUNK_UNITS = 1 << 20
#: Up to so many links go to every task, as the smallest neighbour of each node.
BROADCAST_LINKS = 100_000
U = np.uint64
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def shingled(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of words of all texts: text number, hash and weight, sorted by text and hash."""
    words = Texts([t.translate(PLAIN) for t in texts])
    first, last = words.first[:-1], words.first[1:]
    n = np.where(last > first, np.maximum(1, last - first - shingle + 1), 0)
    owner = np.repeat(np.arange(len(texts)), n)
    begin = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    code = words.runs[0](begin, np.minimum(begin + shingle, last[owner]))
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])) if len(code) else np.zeros(0, np.int64)
    return owner[new], code[new], np.diff(new, append=len(code)).astype(float)


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers above 0 and at most 1."""
    return ((x >> U(11)).astype(np.float64) + 1) / (1 << 53)


def cells(owner: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every unit of weight as an element of its own, and how much of it is there."""
    n = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(n)), n)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return owner[at], scrambled(code[at] + scrambled(cell.astype(U))), np.minimum(1.0, weight[at] - cell)


def signatures(n_texts: int, owner: np.ndarray, code: np.ndarray, weight: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Per text the earliest dart of every coordinate; rows of texts without elements are zero."""
    out = np.zeros((n_texts, coordinates), dtype=U)
    owner, element, part = cells(owner, code, weight)
    total = np.bincount(owner, weights=part, minlength=n_texts)
    limit = np.where(total > 0, coordinates * (np.log(coordinates) + 2) / np.maximum(total, 1e-300), 0.0)
    open_text = total > 0
    while open_text.any():
        at = np.flatnonzero(open_text[owner])
        earliest = np.full(n_texts * coordinates, np.inf)
        winner = np.zeros(n_texts * coordinates, dtype=U)
        rank, turn = np.zeros(len(at)), 0
        while len(at):
            # A few darts at a time, as long as their ranks stay below the text's limit.
            ids = scrambled(element[at][:, None] ^ scrambled(np.arange(turn, turn + 8, dtype=U) + U(1)))
            ranks = rank[:, None] + np.cumsum(-np.log(unit(ids)), axis=1)
            hit = (ranks < limit[owner[at]][:, None]) & (unit(scrambled(ids ^ U(3))) <= part[at][:, None])
            row, column = np.nonzero(hit)
            dart, when = ids[row, column], ranks[row, column]
            slot = owner[at[row]] * coordinates + (scrambled(dart ^ U(5)) % U(coordinates)).astype(np.int64)
            np.minimum.at(earliest, slot, when)
            first = when == earliest[slot]
            winner[slot[first]] = dart[first]
            rank = ranks[:, -1]
            going = rank < limit[owner[at]]
            at, rank, turn = at[going], rank[going], turn + 8
        full = open_text & np.isfinite(earliest.reshape(n_texts, coordinates)).all(axis=1)
        out[full] = winner.reshape(n_texts, coordinates)[full]
        open_text &= ~full
        limit = np.where(open_text, 2 * limit, limit)
    return out


def bands(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    """One key per band of each row; keys of different bands differ."""
    n = signature.shape[1] // band
    key = np.zeros((len(signature), n), dtype=U)
    for i in range(band):
        key = scrambled(key ^ scrambled(signature[:, i:n * band:band] + U(i)))
    return scrambled(key + scrambled(np.arange(1, n + 1, dtype=U)))


def _sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for table in parts:
        for rows in pieces(table):
            texts = encoded(rows["text"])
            plain = [b" ".join(t.translate(PLAIN).split()) for t in texts]
            owner, code, weight = shingled(texts)
            keys = signed(bands(signatures(len(texts), owner, code, weight)))
            yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "print": [hashlib.md5(p).digest() if p else None for p in plain],
                                "weight": np.bincount(owner, weights=weight, minlength=len(texts)).astype(np.int64), "bands": list(keys)})


def _elements(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for table in parts:
        for rows in pieces(table):
            owner, code, weight = shingled(encoded(rows["text"]))
            owner, element, _ = cells(owner, code, weight)
            cut = np.searchsorted(owner, np.arange(1, len(rows)))
            yield pd.DataFrame({"node": rows["doc_id"].to_numpy(), "elements": np.split(signed(element), cut)})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): node, component (the smallest node), by alternating large and small stars.

    Every step is a grouping to a minimum and a join; a node with many edges is spread over tasks.
    """
    pairs = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark, now = None, _state(pairs)
    while now != mark:
        # Few links meet their minima where they are; with many small partitions each exchange costs more than its rows.
        near = F.broadcast if now[0] <= BROADCAST_LINKS else lambda df: df
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(near(low), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near(low), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = stored(small.select("e.*").filter("u <> v").distinct())
        mark, now = now, _state(pairs)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(pairs: DataFrame) -> tuple:
    return pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two documents given as units of weight."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def alike(pairs: DataFrame, elements: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose documents are similar enough."""
    left = elements.select(F.col("node").alias("a"), F.col("elements").alias("of_a"))
    right = elements.select(F.col("node").alias("b"), F.col("elements").alias("of_b"))
    return pairs.join(left, "a").join(right, "b").filter(similarity(F.col("of_a"), F.col("of_b")) >= least).select("a", "b")


def _like(x: Column, y: Column, least: float) -> Column:
    """Texts are never more similar than the smaller is to the larger in weight."""
    return F.least(x, y) >= least * F.greatest(x, y) - 1e-9


def _matchable(open_nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """For the nodes still to be compared: node, common (how many of its units some other of them has too)."""
    units = elements.join(open_nodes.select("node").distinct(), "node").select("node", F.explode("elements").alias("unit"))
    often = units.groupBy("unit").agg(F.count("*").alias("n")).filter("n > 1").select("unit")
    return units.join(often, "unit").groupBy("node").agg(F.count("*").alias("common"))


def _compare(table: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links (a, b) between nodes of one tile that are alike, in different components, and share no smaller key."""
    nodes, chunk, component = (table[c].to_numpy() for c in ("node", "chunk", "component"))
    weight = np.array([len(e) for e in table["elements"]], dtype=np.float64)

    def together(lists: list[np.ndarray]) -> np.ndarray:
        """How many values each two rows have in common, in stretches of values, so that the table of who holds what stays small."""
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        values, place, often = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        # A value that one row alone holds is in no pair.
        rank = np.cumsum(often > 1) - 1
        keep = often[place] > 1
        owner, place = owner[keep], rank[place[keep]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        total = np.zeros((len(lists), len(lists)), dtype=np.float32)
        for start in range(0, int(place[-1]) + 1 if len(place) else 0, 2048):
            low, high = np.searchsorted(place, [start, start + 2048])
            held = np.zeros((len(lists), 2048), dtype=np.float32)
            held[owner[low:high], place[low:high] - start] = 1
            total += held @ held.T
        return total

    earlier = together([k[k < key] for k, key in zip(table["keys"], table["key"])]) > 0
    common = together(list(table["elements"])).astype(np.float64)
    alike = common >= least * (weight[:, None] + weight[None, :] - common) - 1e-9
    wanted = alike & ~earlier & (component[:, None] != component[None, :]) & (nodes[:, None] < nodes[None, :])
    if table["i"].iloc[0] != table["j"].iloc[0]:
        wanted &= chunk[:, None] != chunk[None, :]
    a, b = np.nonzero(wanted)
    return pd.DataFrame({"a": nodes[a], "b": nodes[b]})


def sketch(elements: Column) -> Column:
    """Two bytes of each unit. Texts have no more units in common than such values, repeats counted."""
    return F.transform(elements, lambda unit: (unit.bitwiseAND(F.lit(0xFFFF)) - 0x8000).cast("smallint"))


def repeats_told(values: np.ndarray) -> np.ndarray:
    """Each value with how often it came before, as one number: lists then have as many in common as the smaller counts add up to."""
    values = np.sort(values.astype(np.int64))
    return values + 0x8000 + (np.arange(len(values)) - np.searchsorted(values, values)) * 0x10000


def _candidates(table: pd.DataFrame, least: float) -> pd.DataFrame:
    """The nodes of one tile that may be alike to another by their sketches."""
    met = _compare(table.assign(elements=[repeats_told(x) for x in table["elements"]]), least)
    found = np.unique(np.concatenate([met["a"], met["b"]])).astype(np.int64)
    return pd.DataFrame({"key": np.full(len(found), table["key"].iloc[0], dtype=np.int64), "node": found})


def tiles(open_nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """The nodes (key, node, weight, component) that share a key, once in each tile (key, i, j).

    The nodes of a key are dealt to chunks of bounded size and weight, each two chunks meet in a tile, and a node's elements go once to
    each of its tiles, not once to each of its pairs. A pair is compared under the smallest key that it shares."""
    sizes = open_nodes.groupBy("key").agg(F.count("*").alias("n"), F.sum("weight").alias("units"), F.min("component").alias("x"), F.max("component").alias("y"))
    chunks = F.ceil(F.greatest(F.col("n") / CHUNK_NODES, F.col("units") / CHUNK_UNITS)).cast("long")
    dealt = open_nodes.join(sizes.filter("x < y").select("key", chunks.alias("chunks")), "key")
    # At most one entry per band.
    held = dealt.groupBy("node").agg(F.first("component").alias("component"), F.sort_array(F.collect_set("key")).alias("keys"),
                                     F.collect_list(F.struct("key", "chunks")).alias("places"))
    full = held.join(elements, "node").select("node", "component", "keys", "elements", F.inline("places"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks"))
    tiled = full.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    # Only smaller keys are looked at.
    return tiled.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "chunk", "component",
                        F.filter("keys", lambda k: k < F.col("key")).alias("keys"), "elements")


def across(open_nodes: DataFrame, elements: DataFrame, least: float) -> DataFrame:
    """Links between the nodes (key, node, weight, component) that share a key.

    All nodes meet by their sketches, which rule out most of them without a doubt; what is left meets by its elements."""
    small = elements.select("node", sketch(F.col("elements")).alias("elements"))
    found = stored(tiles(open_nodes, small).groupBy("key", "i", "j").applyInPandas(
        lambda table: _candidates(table, least), "key long, node long").distinct())
    left = tiles(open_nodes.join(found, ["key", "node"]), elements)
    return left.groupBy("key", "i", "j").applyInPandas(lambda table: _compare(table, least), "a long, b long").distinct()


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """For rows (doc_id, text): doc_id and class_id, one row per row."""
    texts = docs.select("doc_id", "text")
    known = texts.filter("doc_id is not null")
    signs = stored(known.mapInPandas(_sign, "doc_id long, print binary, weight long, bands array<long>"))
    nodes = stored(signs.filter("print is not null").groupBy("print").agg(
        F.min("doc_id").alias("node"), F.first("weight").alias("weight"), F.first("bands").alias("bands")))
    held = nodes.select("node", "weight", F.explode("bands").alias("key"))
    shared = held.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    met = stored(held.join(shared.select("key", "n"), "key"))
    # The node that meets most others is the one its band is compared with: the likeliest original of a family of copies.
    central = met.groupBy("node").agg(F.sum("n").alias("meets"))
    hubs = met.join(central, "node").groupBy("key").agg(F.max_by(F.struct("node", "weight"), F.struct("meets", "node")).alias("hub"))
    starred = met.join(hubs, "key").filter((F.col("node") != F.col("hub.node")) & _like(F.col("weight"), F.col("hub.weight"), least))
    tried = stored(starred.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct())
    needed = stored(met.select(F.col("node").alias("doc_id")).distinct())
    elements = stored(narrowed(known, needed, "doc_id").join(needed, "doc_id").dropDuplicates(["doc_id"]).mapInPandas(
        _elements, "node long, elements array<long>"))
    links = stored(alike(tried, elements, least))
    found = components(links)
    # Bands in which more than one component meets: compare across them.
    placed = met.join(found, "node", "left").select("key", "node", "weight", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
    open_nodes = stored(placed.join(mixed, "key").join(_matchable(placed.join(mixed, "key"), elements), "node"))
    open_nodes = open_nodes.filter(F.col("common") >= least * F.col("weight") - 1e-9)
    more = across(open_nodes, elements, least)
    final = components(links.union(more))
    by_print = nodes.join(final, "node", "left").select("print", F.coalesce("component", "node").alias("class_id"))
    printed = signs.filter("print is not null").join(by_print, "print").select("doc_id", "class_id")
    blank = signs.filter("print is null").select("doc_id", F.col("doc_id").alias("class_id"))
    nameless = texts.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return printed.unionByName(blank).unionByName(nameless)


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class, that of the smallest id; rows without an id stay, repeated rows are one."""
    found = classes(docs, least)
    found = stored(found)
    gone = found.filter("class_id < doc_id").select("doc_id").distinct()
    kept = docs.join(F.broadcast(gone) if few(gone) else gone, "doc_id", "left_anti")
    twice = found.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    if twice.isEmpty():
        return kept
    repeated = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(twice, "doc_id", "left_anti").unionByName(repeated).select(*docs.columns)
