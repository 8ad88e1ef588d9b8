"""Benchmark decontamination: windows of a test set's words, looked up in every training text.

Words are normalised by lower-casing A-Z; a word is a run of digits, letters a-z and non-ASCII characters. A
test item gives one window for every ``size`` consecutive words, or a single shorter one if it has fewer. All
windows go to the tasks as a hash set: a table of flags, at most ``MAX_SLOTS`` of them, addressed by two
parts of a 64-bit hash. Each position of each text is looked up there; the few that pass are verified by their
words, in a join with the windows themselves. A larger test set fills the table and passes more positions to
that join; results do not depend on it.

Null and empty texts have no words and are never contaminated; items without words have no windows. A null
item_id marks words as hit but is not counted as an item. Equal items and repeated rows count each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.llm.store import few, stored

SIZE = 13
MIN_SHARE = 20
MAX_SLOTS = 1 << 22
BROADCAST_WINDOWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    """Normalised words of a text, in order."""
    # lower() is the faster of the two, and the same where there is nothing but ASCII.
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, BETWEEN), ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct windows with the items that have them: item_id, len, gram (array of words)."""
    held = items.select("item_id", plain_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(size))
    spread = held.select("item_id", "words", length.alias("len"), F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("i"))
    return spread.select("item_id", "len", F.slice("words", F.col("i"), F.col("len")).alias("gram")).distinct()


class WindowSet:
    """The hash set of all windows, of bounded size, as a literal of the plan."""

    def __init__(self, windows: DataFrame):
        self.windows = windows.cache()
        per_length = self.windows.groupBy("len").agg(F.count("*").alias("n")).collect()  # at most `size` rows
        self.lengths = sorted(r["len"] for r in per_length)
        self.n_windows = sum(r["n"] for r in per_length)
        slots = 1 << 12
        while slots < min(32 * self.n_windows, MAX_SLOTS):
            slots *= 2
        self.mask = slots - 1
        code = F.xxhash64("gram")
        marked = self.windows.select(F.explode(F.array(*self._slots(code))).alias("slot")).distinct()
        table = bytearray(slots)
        for r in marked.toLocalIterator():  # at most `slots` numbers
            table[r["slot"]] = 1
        self.table = F.lit(table)

    def _slots(self, code: Column) -> tuple[Column, Column]:
        return (code.bitwiseAND(F.lit(self.mask)).cast("int"),
                F.shiftright(code, 32).bitwiseAND(F.lit(self.mask)).cast("int"))

    def candidates(self, words: Column) -> Column:
        """Places in ``words`` whose window may be in the set: array of (pos, len, window)."""
        flag = F.lit(bytearray(b"\x01"))

        def passes(gram: Column) -> Column:
            first, second = self._slots(F.xxhash64(gram))
            return (F.substring(self.table, first + 1, F.lit(1)) == flag) & (F.substring(self.table, second + 1, F.lit(1)) == flag)

        def of_length(length: int) -> Column:
            places = F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - (length - 1))).otherwise(F.array().cast("array<int>"))
            passing = F.filter(places, lambda i: passes(F.slice(words, i, length)))
            return F.transform(passing, lambda i: F.struct(
                i.alias("pos"), F.lit(length).alias("len"), F.concat_ws(" ", F.slice(words, i, length)).alias("window")))

        none = F.array().cast("array<struct<pos:int,len:int,window:string>>")
        return F.concat(none, *map(of_length, self.lengths))

    def by_text(self) -> DataFrame:
        """The windows as join side: window, item_id. Sent whole to the tasks only up to a fixed number."""
        side = self.windows.select(F.concat_ws(" ", "gram").alias("window"), "item_id")
        return F.broadcast(side) if self.n_windows <= BROADCAST_WINDOWS else side


def hits(docs: DataFrame, items: DataFrame, size: int = SIZE, *keep: str) -> DataFrame:
    """One row per row of ``docs`` (columns ``keep`` and text): keep, n_words, spans (pos, len), items."""
    known = WindowSet(item_windows(items, size))
    worded = docs.select(*keep, F.monotonically_increasing_id().alias("row_id"), plain_words(F.col("text")).alias("words"))
    cut = worded.select(*keep, "row_id", F.size("words").cast("long").alias("n_words"), known.candidates(F.col("words")).alias("found"))
    spread = cut.select(*keep, "n_words", "row_id", F.explode_outer("found").alias("at"))
    # A row without candidates gets a key of its own, which no window equals, so that such rows do not meet in one task.
    keyed = spread.select(*keep, "n_words", "row_id", F.col("at.pos").alias("pos"), F.col("at.len").alias("len"),
                          F.coalesce(F.col("at.window"), F.concat(F.lit("\x00"), F.col("row_id").cast("string"))).alias("window"))
    side = known.by_text().withColumn("known", F.lit(True))
    joined = keyed.join(side, "window", "left")
    span = F.when(F.col("known"), F.struct("pos", "len"))
    return joined.groupBy("row_id").agg(
        *(F.first(c).alias(c) for c in (*keep, "n_words")), F.sort_array(F.collect_set(span)).alias("spans"),
        F.sort_array(F.collect_set(F.when(F.col("known"), F.col("item_id").cast("string")))).alias("items"),
    ).drop("row_id")


def covered(spans: Column) -> Column:
    """Number of places inside any of the spans, which are sorted by place."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(state: Column, span: Column) -> Column:
        end = (span["pos"] + span["len"]).cast("long")
        new = F.greatest(F.lit(0).cast("long"), end - F.greatest(state["end"], span["pos"].cast("long")))
        return F.struct((state["n"] + new).alias("n"), F.greatest(state["end"], end).alias("end"))

    return F.aggregate(spans, zero, add)["n"]


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, min_share: int = MIN_SHARE) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, n_words, n_hit, n_items, items, contaminated.

    A document is contaminated if at least one word in ``min_share`` is hit.
    """
    found = hits(docs.select("doc_id", "text"), items, size, "doc_id")
    counted = found.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (min_share * F.col("n_hit") >= F.col("n_words")))


def _verdict_key(docs: DataFrame) -> DataFrame:
    """The whole row, and what its verdict depends on: id and text."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def remove_documents(docs: DataFrame, items: DataFrame, size: int = SIZE, min_share: int = MIN_SHARE) -> DataFrame:
    """``docs`` without its contaminated rows; the others unchanged."""
    keyed = _verdict_key(docs)
    found = hits(keyed.select("key", "text"), items, size, "key")
    n_hit = covered(F.col("spans"))
    bad = found.filter((n_hit > 0) & (min_share * n_hit >= F.col("n_words"))).select("key").distinct()
    bad = stored(bad)
    return keyed.join(F.broadcast(bad) if few(bad) else bad, "key", "left_anti").select("row.*")


def remove_spans(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with every hit word cut out of its text; white space and punctuation stay."""
    keyed = _verdict_key(docs)
    found = hits(keyed.select("key", "text"), items, size, "key").filter(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("spans"))
    joined = keyed.join(found, "key", "left")
    gaps = F.split("text", "[0-9A-Za-z[^\\x00-\\x7F]]+")
    kept_words = F.array_remove(F.split("text", BETWEEN_CASED), "")
    hit = lambda i: F.exists("spans", lambda s: (s["pos"] <= i + 1) & (i + 1 < s["pos"] + s["len"]))
    left = F.transform(kept_words, lambda w, i: F.when(hit(i), "").otherwise(w))
    joint = F.array_join(F.zip_with(gaps, left, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(joint)
    return joined.select("row", text.alias("new")).select(*(F.col("new").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
