"""Fill-in-middle transformation by content-defined chunk memoization.

A text is a row of units, ``[A-Za-z]+`` or one other code point, and is cut in two places that are given as numbers of units.
A rolling hash over the UTF-8 bytes cuts it into chunks wherever the last 32 bytes say so, so that a passage shared by many
texts falls into the same chunks in all of them, wherever it stands. A chunk's summary (units, code points, whether it begins
and whether it ends with a letter) is all that is needed of it: counts of neighbours are added, less one where letters meet,
and the running counts tell which chunk holds a cut; only that chunk is looked into. Summaries are kept in a cache whose keys
are the chunks' bytes, so a hit is verified by content. A cache lives as long as its task and holds at most
``CACHE_BYTES``; what falls out of it is counted again.

The two places come from four numbers of the sha256 of ``1:`` and the doc_id in decimal digits (a null doc_id: ``1:`` alone).
A null text is an empty one. A text that is empty or holds one of the three marks stays plain. Very long texts are worked whole,
in pieces of bounded size for the hash; a text without a place to cut is one chunk. Repeated rows give repeated results, an
empty table none. Other columns are carried along untouched, whatever their names, unless they have the name of a result:
those are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PER_100 = 10
SPM_PER_100 = 20
SEED = "1:"

#: A chunk is 1,024 bytes on average, 256 at least but for a text's last one.
MASK_BITS = 10
MIN_CHUNK = 256
PIECE = 1 << 20
CACHE_BYTES = 32 << 20
#: What a cached chunk weighs besides its bytes.
ENTRY = 200

_WINDOW = 32
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
# Bytes that continue a code point begin no unit.
_INNER = np.zeros(256, dtype=bool)
_INNER[128:192] = True


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the 32 bytes that end at each place (fewer at the front), by doubling the window."""
    held, width = _GEAR[data], 1
    while width < _WINDOW:
        held[width:] += held[:-width] << np.uint32(width)
        width *= 2
    return held


def cuts(data: np.ndarray, mask_bits: int = MASK_BITS, least: int = MIN_CHUNK) -> list[int]:
    """Ends of the chunks of a text's bytes, its own end last; never inside a code point."""
    size, mask, at = len(data), np.uint32(((1 << mask_bits) - 1) << (32 - mask_bits)), []
    for start in range(0, size, PIECE):
        lead = min(start, _WINDOW - 1)
        marked = rolling(data[start - lead:start + PIECE])[lead:] & mask
        at.append(np.flatnonzero(marked == 0) + start + 1)
    places = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
    places = places[places < size]
    places = places[~_INNER[data[places]]].tolist()
    ends, k = [], 0
    # The next place that is far enough from the last: bisection steps over those that are not.
    while (k := bisect_left(places, (ends[-1] if ends else 0) + least, k)) < len(places):
        ends.append(places[k])
    return [*ends, size] if size else []


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Whether a unit begins at each byte, the text before being unknown: a letter at the front begins one."""
    letter = _LETTER[data]
    starts = ~letter & ~_INNER[data]
    starts[1:] |= letter[1:] & ~letter[:-1]
    starts[:1] |= letter[:1]
    return starts


def summarize(chunk: bytes) -> tuple[int, int, bool, bool]:
    """Units, code points, and whether the chunk begins and ends with a letter."""
    data = np.frombuffer(chunk, dtype=np.uint8)
    return (int(np.count_nonzero(unit_starts(data))), len(data) - int(np.count_nonzero(_INNER[data])),
            bool(_LETTER[data[0]]), bool(_LETTER[data[-1]]))


class Memo:
    """Summaries by content, in two generations: when the young one is full it becomes the old one, and the old one goes."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.young, self.old, self.size = limit // 2, {}, {}, 0
        self.hits = self.misses = 0

    def __call__(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        found = self.young.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        found = self.old.get(chunk)
        if found is None:
            self.misses += 1
            found = summarize(chunk)
        else:
            self.hits += 1
        weight = len(chunk) + ENTRY
        if weight <= self.limit:
            if self.size + weight > self.limit:
                self.young, self.old, self.size = {}, self.young, 0
            self.young[chunk] = found
            self.size += weight
        return found


class Located:
    """A text with the summaries of its chunks combined."""

    def __init__(self, text: bytes, memo: Memo, mask_bits: int = MASK_BITS, least: int = MIN_CHUNK):
        self.text, self.data = text, np.frombuffer(text, dtype=np.uint8)
        self.ends = cuts(self.data, mask_bits, least)
        self.begins = [0, *self.ends[:-1]]
        # Units that begin in the chunks up to each, code points before each, and whether a chunk goes on with a unit.
        self.units, self.chars, self.joined = [], [], []
        units = chars = 0
        open_word = False
        for a, b in zip(self.begins, self.ends):
            n, points, first, last = memo(text[a:b])
            joined = open_word and first
            self.chars.append(chars)
            units, chars, open_word = units + n - joined, chars + points, last
            self.units.append(units)
            self.joined.append(joined)
        self.n, self.n_chars = units, chars

    def chars_before(self, unit: int) -> int:
        """Code points before the unit of this number (from 0): the end of so many units."""
        if unit >= self.n:
            return self.n_chars
        if unit <= 0:
            return 0
        # The first chunk in which more units than that have begun.
        k = bisect_left(self.units, unit + 1)
        part = self.data[self.begins[k]:self.ends[k]]
        place = np.flatnonzero(unit_starts(part))[unit - (self.units[k - 1] if k else 0) + self.joined[k]]
        return self.chars[k] + int(place) - int(np.count_nonzero(_INNER[part[:place]]))


def _drawn(doc_id: Column) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def locate(text: Column, first: Column, second: Column, memo_bytes: int = CACHE_BYTES) -> Column:
    """Of a text: n (units), and low and high, the code points before the units ``first % (n + 1)`` and ``second % (n + 1)``,
    the smaller first."""

    @F.pandas_udf("n long, low long, high long")
    def found(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        memo = Memo(memo_bytes)
        for texts, firsts, seconds in parts:
            rows = []
            for content, x, y in zip(texts, firsts, seconds):
                one = Located(bytes(content), memo)
                low, high = sorted((int(x) % (one.n + 1), int(y) % (one.n + 1)))
                rows.append((one.n, one.chars_before(low), one.chars_before(high)))
            yield pd.DataFrame(rows, columns=["n", "low", "high"])

    return found(text.cast("binary"), first, second)


def rearranged(text: Column, form: Column, low: Column, high: Column) -> Column:
    """The text in its form, cut after ``low`` and ``high`` code points."""
    low, high = low.cast("int"), high.cast("int")
    prefix, middle = F.substring(text, F.lit(1), low), F.substring(text, low + 1, high - low)
    suffix = F.substring(text, high + 1, F.length(text) - high)
    return (F.when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
            .when(form == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(text))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, by its marks alone. No mark can stand in a part or across its edge."""
    second = F.when(form == "psm", F.instr(output, SUFFIX)).otherwise(F.instr(output, PREFIX))
    third, whole = F.instr(output, MIDDLE), F.length(output)
    one = F.substring(output, F.lit(4), second - 4)
    two = F.substring(output, second + 3, third - second - 3)
    middle = F.substring(output, third + 3, whole - third - 2)
    return F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(output)


def transform(docs: DataFrame, plain_per_100: int = PLAIN_PER_100, spm_per_100: int = SPM_PER_100) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars (null if plain) and output, the text a model is trained on."""
    results = ["n", "form", "prefix_chars", "middle_chars", "output"]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    text = F.coalesce(F.col("text"), F.lit(""))
    first, second, plain, order = _drawn(F.col("doc_id"))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = (F.when((text == "") | marked | (plain % 100 >= 100 - plain_per_100), "plain")
            .when(order % 100 < spm_per_100, "spm").otherwise("psm"))
    placed = docs.select(row, text.alias("whole"), form.alias("form"), locate(text, first, second).alias("at"))
    cut = F.col("form") != "plain"
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in results]
    return placed.select(
        *kept, F.col("at.n").alias("n"), "form", F.when(cut, F.col("at.low")).alias("prefix_chars"),
        F.when(cut, F.col("at.high") - F.col("at.low")).alias("middle_chars"),
        rearranged(F.col("whole"), F.col("form"), F.col("at.low"), F.col("at.high")).alias("output"))
