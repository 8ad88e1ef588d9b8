"""Line dedup by a segment-partition edit join.

Two lines are alike if at most ``threshold`` insertions, deletions or substitutions of characters turn one into the other.
The threshold is a number, or grows with the length of the shorter line by classes (``GROWING``), each cut by its own. A line is cut into ``threshold + 1`` segments; whatever line is alike holds one of them unchanged, near its place. Distinct lines
are indexed by (length, segment number, segment), and each probes, for every length it may be alike to, the substrings at the
places where that segment can be. Pairs that meet, and whose counts of a few letters allow it, are verified by their edit distance, computed column by column in a
band of ``2 * threshold + 1`` rows, whose differences are the bits of two numbers.

Lines that meet in a segment which many lines share must also meet in one of their rarest grams, near the same place. Each takes the
first of its grams, in one order of all grams, until no ``threshold`` edits can touch them all; of two lines that are alike, the one whose
last gram comes first then has one of its own left in the other, among those the other took. The order is free, and rare grams come first in
it: what a family of lines has from one template is common, and brings only those together that differ from it in little. Of these, pairs go
whose rare grams, missing in the other line on either side, need more edits than are allowed.

A line goes if the same line, or one alike, stands at an earlier place; places are ordered by doc_id (null last) and line
number, and judged on the input. Lines shorter than ``min_chars`` take no part in the edit join; they are kept, or with
``exact_chars`` go as exact repeats from that length on, blank ones aside. Repeated lines are reduced to one before the join. Lines are cut at the line feed; null and empty texts lose nothing. Rows that repeat an id and text are at one place, and
treated alike. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.llm.store import few, let_go, narrowed, remove, stored, written

THRESHOLD = 1
MIN_CHARS = 20
#: From how many characters on, how many edits: about one word replaced in a line of usual length.
GROWING = ((20, 1), (50, 2), (100, 3))
BROADCAST_LINES = 500_000
LETTERS = "enatio"
TALLY_BITS = 3 * len(LETTERS)
#: A segment is common if about so many lines share it, judged by one line in ``ONE_IN``; both ways of meeting find the same pairs.
COMMON = 32
ONE_IN = 8
GRAM = 6
#: The order of grams needs only an idea of how frequent they are: by kind (hash), from one line in ``GRAM_ONE_IN`` that has a common segment.
GRAM_KINDS = 1 << 14
GRAM_ONE_IN = 16


def _segment(length: Column, i: int, threshold: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment i (from 1)."""
    # Ends of the first i - 1 and i segments, rounded down, so that a segment is at most one longer than another.
    parts = threshold + 1
    before, end = (((length * k) / parts).cast("int") for k in (i - 1, i))
    return before + 1, end - before


def _key(i: int, length: Column, piece: Column) -> Column:
    return F.xxhash64(F.lit(i), length, piece)


Threshold = int | Sequence[tuple[int, int]]


def _classes(threshold: Threshold) -> list[tuple[int, int]]:
    """(first length, edits) of each class; lines below the first class belong to it."""
    return [(0, threshold)] if isinstance(threshold, int) else sorted(threshold)


def most_edits(threshold: Threshold) -> int:
    return max(edits for _, edits in _classes(threshold))


def allowed(length: Column, threshold: Threshold) -> Column:
    """The edits allowed to a pair whose shorter line has this length."""
    (_, edits), *longer = _classes(threshold)
    limit = F.lit(edits)
    for first, edits in longer:
        limit = F.when(length >= first, edits).otherwise(limit)
    return limit


def _kept_if(condition: Column, keys: list[Column]) -> Column:
    return F.when(condition, F.array(*keys)).otherwise(F.array().cast("array<bigint>"))


def index_keys(line: Column, length: Column, threshold: Threshold = THRESHOLD) -> Column:
    """The keys under which a line is found: one per segment."""
    limits, found = sorted({edits for _, edits in _classes(threshold)}), []
    for edits in limits:
        keys = []
        for i in range(1, edits + 2):
            start, size = _segment(length, i, edits)
            keys.append(_key(i, length, F.substring(line, start, size)))
        found.append(F.array(*keys) if len(limits) == 1 else _kept_if(allowed(length, threshold) == edits, keys))
    return F.concat(*found) if len(found) > 1 else found[0]


def probe_keys(line: Column, length: Column, threshold: Threshold = THRESHOLD) -> Column:
    """The keys of all lines, as long or shorter, that may be alike.

    Segment i of the other line can be moved only as far as edits before it and edits after it allow, together no more
    than the threshold if segments before it are not to match. Places outside the line give null.
    """
    limits, every, found = sorted({edits for _, edits in _classes(threshold)}), [], []
    for edits in limits:
        for shorter in range(edits + 1):
            other, keys = length - shorter, []
            for i in range(1, edits + 2):
                start, size = _segment(other, i, edits)
                rest = edits + 1 - i
                for move in range(max(-(i - 1), shorter - rest), min(i - 1, shorter + rest) + 1):
                    at = start + move if move else start
                    key = _key(i, other, F.substring(line, at, size))
                    inside = (at >= 1) & (at + size - 1 <= length)
                    keys.append(F.when(inside, key) if edits > 1 else key)
            every += keys
            found.append(_kept_if(allowed(other, threshold) == edits, keys))
    return F.array(*every) if len(limits) == 1 else F.concat(*found)


def tally(line: Column, length: Column) -> Column:
    """How often some frequent letters stand in a line, the last three bits of each count, in one number of ``TALLY_BITS`` bits."""
    total = F.lit(0).cast("long")
    for k, letter in enumerate(LETTERS):
        n = (length - F.length(F.replace(line, F.lit(letter), F.lit("")))) % 8
        total = total + n.cast("long") * (1 << 3 * k)
    return total


def tallies_near(a: Column, b: Column, threshold: int) -> Column:
    """An edit takes one letter away and adds one, at most; lines that are alike cannot differ in more."""
    differ = F.lit(0)
    for k in range(len(LETTERS)):
        apart = F.abs(F.shiftright(a, 3 * k).bitwiseAND(F.lit(7)) - F.shiftright(b, 3 * k).bitwiseAND(F.lit(7)))
        differ = differ + F.least(apart, 8 - apart)
    return differ <= 2 * threshold


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed a single time, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def edit_distance(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """Edit distance of two lines whose lengths differ by at most ``threshold``; exact up to it, above it just larger.

    Bit k of the numbers stands for row j - threshold + k of column j: ``up`` where the value rises from the row above, ``down``
    where it falls. ``same`` has the rows where the diagonal step is free.
    """
    width = 2 * threshold + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    start = F.struct(F.lit(((1 << (threshold + 1)) - 1) << threshold).alias("up"), F.lit(0).alias("down"), F.lit(threshold).alias("cost"))

    def bits(x: Column) -> Column:
        return F.bitwise_not(x).bitwiseAND(F.lit(mask))

    def has(x: Column, bit: Column) -> Column:
        return F.when(x.bitwiseAND(bit) != 0, 1).otherwise(0)

    def matches(j: Column, of_a: Column, of_b: Column) -> Column:
        # A row outside the line reads as null, which equals nothing.
        letter = F.get(of_b, j - 1)
        total = F.lit(0)
        for k in range(width):
            total = total + F.when(F.get(of_a, j - 1 + (k - threshold)) == letter, 1 << k).otherwise(0)
        return total

    def column(j: Column, rows: Column, up: Column, down: Column, cost: Column, equal: Column) -> Column:
        same = ((equal.bitwiseAND(up) + up).bitwiseXOR(up)).bitwiseOR(equal).bitwiseOR(down).bitwiseAND(F.lit(mask))
        right_up, right_down = down.bitwiseOR(bits(same.bitwiseOR(up))), same.bitwiseAND(up)
        # The cost is followed down the lowest diagonal to the last row, and from there along that row.
        bit = F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(0), rows - j + threshold).cast("int"))
        step = F.when(j + threshold <= rows, 1 - has(same, F.lit(top))).otherwise(has(right_up, bit) - has(right_down, bit))
        half = F.shiftright(same, 1)
        return F.struct(right_down.bitwiseOR(bits(half.bitwiseOR(right_up))).alias("up"), half.bitwiseAND(right_up).alias("down"), (cost + step).alias("cost"))

    def over(letters: Column) -> Column:
        def add(state: Column, j: Column) -> Column:
            return _once(matches(j, letters["a"], letters["b"]),
                        lambda equal: column(j, letters["rows"], state["up"], state["down"], state["cost"], equal))

        return F.aggregate(F.sequence(F.lit(1), F.size(letters["b"])), start, add)["cost"]

    return _once(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"), F.length(a).alias("rows")), over)


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """Lines that take part: key (of the row), place, one and two (the line's hash), line. Place sorts as lines do."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("pos"))
    taken = F.length("line") >= min_chars
    if exact_chars is not None:
        taken = taken | (F.length("line") >= exact_chars) & F.col("line").rlike(r"[^\x20\x09-\x0D]")
    cut = docs.select("key", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(taken)
    return cut.select("key", place.alias("place"), F.xxhash64("line").alias("one"), F.xxhash64(F.lit(1), "line").alias("two"), "line")


def _grams(letters: Column) -> Column:
    """The grams of a line's letters, as hashes in their order; none if it is shorter."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(letters) - GRAM), lambda i: F.xxhash64(*(F.get(letters, i + k) for k in range(GRAM))))
    return F.when(F.size(letters) >= GRAM, hashed).otherwise(F.array().cast("array<bigint>"))


def gram_order(lines: DataFrame) -> bytes:
    """One byte for each kind of gram: the logarithm of how often it stands in some of the lines."""
    some = lines.filter(F.pmod("code", F.lit(GRAM_ONE_IN << TALLY_BITS)) < 1 << TALLY_BITS)
    grams = some.select(F.explode(_once(F.split("line", ""), lambda letters: F.array_distinct(_grams(letters)))).alias("gram"))
    order = bytearray(GRAM_KINDS)
    for kind, n in grams.groupBy(F.pmod("gram", F.lit(GRAM_KINDS)).alias("kind")).count().collect():
        order[kind] = min(255, 4 * n.bit_length() + (n << 3 >> n.bit_length() & 3))
    return bytes(order)


def touched(places: Column) -> Column:
    """The fewest edits that touch a gram at each of the places."""
    start = F.struct(F.lit(-GRAM).alias("at"), F.lit(0).alias("n"))
    return F.aggregate(F.array_sort(places), start, lambda s, at: F.when(at >= s["at"] + GRAM, F.struct(at.alias("at"), (s["n"] + 1).alias("n"))).otherwise(s))["n"]


def rare_grams(line: Column, edits: Column, order: bytes) -> Column:
    """The first grams of a line in the order, more than ``edits`` can touch or all it has: rank, gram, first and last place."""
    def placed(grams: Column, turned: Column) -> Column:
        ordered = F.array_sort(F.transform(F.array_distinct(grams), lambda g: F.struct(
            F.substring(F.lit(order), F.pmod(g, F.lit(GRAM_KINDS)).cast("int") + 1, 1).alias("rank"), g.alias("gram"))))
        # Each edit touches at most GRAM of them.
        return F.transform(F.slice(ordered, F.lit(1), edits * GRAM + 1), lambda x: F.struct(
            x["rank"].alias("rank"), x["gram"].alias("gram"), F.array_position(grams, x["gram"]).cast("int").alias("first"),
            (F.size(grams) + 1 - F.array_position(turned, x["gram"])).cast("int").alias("last")))

    return _once(_once(F.split(line, ""), _grams), lambda g: placed(g, F.reverse(g)))


def meeting_grams(rare: Column, length: Column, edits: Column) -> Column:
    """Those of the rare grams that come first, until ``edits`` cannot touch them all; a line with too few has 0 at any place besides."""
    firsts = F.transform(rare, lambda x: x["first"])
    enough = F.filter(rare, lambda x, i: touched(F.slice(firsts, F.lit(1), i)) <= edits)
    taken = F.transform(enough, lambda x: F.struct(x["gram"].alias("gram"), x["first"].alias("first"), x["last"].alias("last")))
    rest = F.array(F.struct(F.lit(0).cast("long").alias("gram"), F.lit(1).alias("first"), (length + 1).alias("last")))
    return F.when(touched(firsts) <= edits, F.concat(taken, rest)).otherwise(taken)


def near_place(x: Column, y: Column, most: int) -> Column:
    """A gram that stays moves by the edits before it."""
    return (x["first"] <= y["last"] + most) & (y["first"] <= x["last"] + most)


def edits_needed(a: Column, b: Column, most: int) -> Column:
    """At least so many edits turn a line into another, as their rare grams show that the other does not have."""
    def missing(of: Column, other: Column) -> Column:
        def known(x: Column) -> Column:
            end = F.try_element_at(other, F.lit(-1))
            return end.isNull() | (F.struct(x["rank"], x["gram"]) <= F.struct(end["rank"], end["gram"]))

        lost = F.filter(of, lambda x: known(x) & ~F.exists(other, lambda y: (x["gram"] == y["gram"]) & near_place(x, y, most)))
        return F.transform(lost, lambda x: x["first"])

    def needed(of_a: Column, of_b: Column) -> Column:
        # An edit touches grams of both only where they stand side by side.
        apart = F.filter(of_a, lambda x: ~F.exists(of_b, lambda y: F.abs(x - y) < GRAM + most))
        return touched(of_b) + touched(apart)

    return _once(F.struct(missing(a, b).alias("a"), missing(b, a).alias("b")), lambda lost: needed(lost["a"], lost["b"]))


def common_segments(distinct: DataFrame, threshold: Threshold = THRESHOLD) -> DataFrame:
    """Segments that many lines share, with the length of those lines."""
    length = F.length("line")
    some = distinct.filter(F.pmod("one", F.lit(ONE_IN)) == 0).select(length.alias("length"), F.explode(index_keys(F.col("line"), length, threshold)).alias("segment"))
    return stored(some.groupBy("segment", "length").count().filter(F.col("count") >= max(2, COMMON // ONE_IN)).select("segment", "length"))


def met_in_common(distinct: DataFrame, common: DataFrame, threshold: Threshold = THRESHOLD) -> DataFrame:
    """Pairs of lines (a, b) that share a common segment and a rare gram."""
    most, length = most_edits(threshold), F.length("line")
    # Only lines as long as those of a common segment, or a little longer, can have it.
    lengths = common.select(F.explode(F.array(*[F.col("length") + k for k in range(most + 1)])).alias("length")).distinct()
    fitting = distinct.withColumn("length", length).join(F.broadcast(lengths), "length", "left_semi")
    keyed = fitting.select("code", index_keys(F.col("line"), length, threshold).alias("own"), probe_keys(F.col("line"), length, threshold).alias("sought"))
    held = keyed.select("code", "own", F.explode(F.array_union("own", "sought")).alias("segment")).filter("segment is not null")
    held = held.withColumn("is_own", F.array_contains("own", F.col("segment"))).drop("own")
    segments = common.select("segment").distinct()
    held = held.join(F.broadcast(segments) if few(segments) else segments, "segment")
    members = stored(held.groupBy("code").agg(F.collect_set(F.when(F.col("is_own"), F.col("segment"))).alias("own"), F.collect_set("segment").alias("held")))
    lines = stored(narrowed(distinct.select("code", "line"), members.select("code"), "code").join(members, "code"))
    edits = allowed(length, threshold)
    listed = stored(lines.select("code", "own", "held", length.alias("length"), edits.alias("edits"), rare_grams(F.col("line"), edits, gram_order(lines)).alias("rare")))
    grams = listed.select("*", F.explode(meeting_grams(F.col("rare"), F.col("length"), F.col("edits"))).alias("gram"))
    left, right = (grams.select(F.col("gram.gram").alias("key"), *(F.col(c).alias(f"{c}_{side}") for c in grams.columns)) for side in "ab")
    limit = F.least("edits_a", "edits_b")
    met = left.filter(F.size("own_a") > 0).drop("held_a").join(right.drop("own_b"), "key").filter(
        (F.col("code_a") != F.col("code_b")) & near_place(F.col("gram_a"), F.col("gram_b"), most) & tallies_near(F.col("code_a"), F.col("code_b"), most)
        & F.arrays_overlap("own_a", "held_b") & (edits_needed(F.col("rare_a"), F.col("rare_b"), most) <= limit))
    return met.select(F.least("code_a", "code_b").alias("a"), F.greatest("code_a", "code_b").alias("b"))


def near_lines(lines: DataFrame, threshold: Threshold = THRESHOLD) -> DataFrame:
    """Lines with a different line alike: one, two, links (how many), earlier (does one of them stand earlier?)."""
    most = most_edits(threshold)
    # A line goes through the shuffle once, as text, which is smaller than its keys; all that follows starts from distinct lines.
    first = lines.groupBy("one", "two").agg(F.first("line").alias("line"), F.min("place").alias("first"))
    length = F.length("line")
    # A key row is two numbers: the segment, and the line's hash, whose last bits are its tally. Counting letters costs more than the keys: once a line.
    code = F.shiftleft(F.shiftrightunsigned("one", TALLY_BITS), TALLY_BITS).bitwiseOR(tally(F.col("line"), length))
    distinct = written(first.withColumn("code", code), "distinct-lines")
    let_go(lines.sparkSession)
    keyed = distinct.select("code", index_keys(F.col("line"), length, threshold).alias("own"), probe_keys(F.col("line"), length, threshold).alias("sought"))
    own = keyed.select("code", F.explode("own").alias("segment"))
    # A line seeks its own segments too, where they are; these rows are there already, and meet each other.
    sought = keyed.select("code", F.explode(F.array_except("sought", "own")).alias("segment")).filter("segment is not null")

    def met(probes: DataFrame) -> DataFrame:
        left, right = own.select(F.col("code").alias("a"), "segment"), probes.select(F.col("code").alias("b"), "segment")
        together = left.join(right, "segment").filter((F.col("a") != F.col("b")) & tallies_near(F.col("a"), F.col("b"), most))
        return together.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    common = common_segments(distinct, threshold)
    segments = common.select("segment").distinct()
    if common.isEmpty():
        together = met(own).union(met(sought))
    else:
        beside = met_in_common(distinct, common, threshold)
        segments = F.broadcast(segments) if few(segments) else segments
        own, sought = (keys.join(segments, "segment", "left_anti") for keys in (own, sought))
        together = met(own).union(met(sought)).union(beside)
    pairs = stored(together.distinct())
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("code")).distinct())
    if wanted.count() <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    letters = F.array(*[length - F.length(F.replace(F.col("line"), F.lit(x), F.lit(""))) for x in LETTERS])
    texts = stored(distinct.join(wanted, "code").withColumn("letters", letters))
    # Pairs and their texts are stored; all other lines take their room no longer.
    for folder in {file.rpartition("/")[0] for file in distinct.inputFiles()}:
        remove(lines.sparkSession, folder)
    left, right = (texts.select(*(F.col(c).alias(f"{c}_{side}") for c in texts.columns)) for side in "ab")
    met = pairs.join(left, F.col("a") == F.col("code_a")).join(right, F.col("b") == F.col("code_b"))
    limit = allowed(F.least(F.length("line_a"), F.length("line_b")), threshold)
    # The whole counts of the letters rule out most of what their last bits let through.
    apart = sum((F.abs(F.get("letters_a", F.lit(k)) - F.get("letters_b", F.lit(k))) for k in range(len(LETTERS))), F.lit(0))
    met = met.filter((F.abs(F.length("line_a") - F.length("line_b")) <= limit) & (apart <= 2 * limit))
    # The distance is work for the processor, not for the disk: dealt to all cores, however few bytes the pairs are.
    cores = lines.sparkSession.sparkContext.defaultParallelism
    alike = met.repartition(2 * cores, "a", "b").filter(
        edit_distance(F.col("line_a"), F.col("line_b"), most) <= limit)
    ends = alike.select(F.explode(F.array(
        F.struct(F.col("one_a").alias("one"), F.col("two_a").alias("two"), (F.col("first_b") < F.col("first_a")).alias("earlier")),
        F.struct(F.col("one_b").alias("one"), F.col("two_b").alias("two"), (F.col("first_a") < F.col("first_b")).alias("earlier")))).alias("e"))
    return ends.select("e.*").groupBy("one", "two").agg(F.count("*").alias("links"), F.bool_or("earlier").alias("earlier"))


def judged(docs: DataFrame, threshold: Threshold = THRESHOLD, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """Per key of (key, doc_id, text) rows with lines to lose or linked: key, removed (line numbers from 0), n_near, links."""
    lines = lines_of(docs, min_chars, exact_chars)
    near = near_lines(lines if exact_chars is None else lines.filter(F.length("line") >= min_chars), threshold)
    known = lines.select("key", "place", "one", "two")
    counted = known.groupBy("one", "two").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last")
    verdict = counted.join(near, ["one", "two"], "full").select(
        "one", "two", "first", F.coalesce("earlier", F.lit(False)).alias("earlier"), F.coalesce("links", F.lit(0)).alias("links"))
    met = known.join(verdict, ["one", "two"])
    copy = F.coalesce(F.col("first") < F.col("place"), F.lit(False))
    return met.distinct().groupBy("key").agg(
        F.sort_array(F.collect_set(F.when(copy | F.col("earlier"), F.col("place.pos")))).alias("removed"),
        F.count_if(~copy & F.col("earlier")).alias("n_near"), F.sum("links").alias("links"))


def dedup_report(docs: DataFrame, threshold: Threshold = THRESHOLD, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_lines, n_removed, n_near (removed only for an edited line), links."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    found = judged(keyed, threshold, min_chars, exact_chars)
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    joined = keyed.select("doc_id", "key", F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines).alias("n_lines")).join(found, "key", "left")
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("removed").cast("long"), zero).alias("n_removed"),
                         F.coalesce("n_near", zero).alias("n_near"), F.coalesce("links", zero).alias("links"))


def remove_lines(docs: DataFrame, threshold: Threshold = THRESHOLD, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """``docs`` without the lines that go; a row whose lines all go, or leave only blanks, goes with them."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    key = F.xxhash64("doc_id", "text").alias("key")
    found = stored(judged(docs.select(key, "doc_id", "text"), threshold, min_chars, exact_chars).filter(F.size("removed") > 0).select("key", "removed"))
    whole = docs.select(row, key)
    keys = stored(found.select("key").distinct())
    parts = [whole]
    if few(keys):
        # Documents that lose nothing need not be shuffled.
        parts = [whole.join(F.broadcast(keys), "key", "left_semi"), whole.join(F.broadcast(keys), "key", "left_anti")]
    joined = parts[0].join(found, "key", "left")
    for rest in parts[1:]:
        joined = joined.unionByName(rest, allowMissingColumns=True)
    text = F.col("row.text")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("removed", i)), "\n")
    changed = F.col("removed").isNotNull()
    left = joined.select("row", F.when(changed, kept).otherwise(text).alias("left"), changed.alias("changed"))
    whole = left.filter(~F.col("changed") | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    return whole.select(*(F.col("left").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
