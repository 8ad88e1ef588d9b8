import random

from pyspark.sql import functions as F

import corpus_pipeline
from gridcast.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice("abé"))
        elif kind == 1 and len(out) > 8:
            del out[at]
        else:
            out[at] = rng.choice("abé")
    return "".join(out)


def lines(rng, n, threshold):
    made = []
    for _ in range(n):
        base = "".join(rng.choice("abcdeé ") for _ in range(rng.randint(9, 26)))
        made += [base, edited(rng, base, rng.randint(0, threshold + 1))]
    rng.shuffle(made)
    return made


def brute(rows, threshold, min_chars):
    """(doc_id, removed, near, links) of documents with non-null ids."""
    first, places = {}, []
    for doc_id, text in sorted(rows):
        for pos, line in enumerate(text.split("\n")):
            if len(line) >= min_chars:
                places.append((doc_id, pos, line))
                first.setdefault(line, (doc_id, pos))
    alike = {a: [b for b in first if a != b and abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold] for a in first}
    out = {doc_id: [0, 0, 0] for doc_id, _ in rows}
    for doc_id, pos, line in places:
        copy = first[line] < (doc_id, pos)
        near = any(first[b] < first[line] for b in alike[line])
        out[doc_id][0] += copy or near
        out[doc_id][1] += near and not copy
        out[doc_id][2] += len(alike[line])
    return {d: tuple(v) for d, v in out.items()}


def test_edit_distance(spark):
    rng = random.Random(3)
    for threshold in (1, 2, 3):
        pairs = [(a, b) for a in lines(rng, 150, threshold) for b in [edited(rng, a, rng.randint(0, threshold + 2))] if abs(len(a) - len(b)) <= threshold]
        df = spark.createDataFrame(pairs, "a string, b string")
        for r in df.withColumn("d", line_dedup.edit_distance(F.col("a"), F.col("b"), threshold)).collect():
            want = distance(r.a, r.b)
            assert r.d == want if want <= threshold else r.d > threshold


def test_join_finds_every_pair(documents):
    rng = random.Random(8)
    for threshold in (1, 2, 3):
        held = lines(rng, 60, threshold)
        rows = [(i, "\n".join(held[i * 4:i * 4 + 4])) for i in range(30)]
        got = line_dedup.dedup_report(documents([(i, t, "s") for i, t in rows]), threshold, 8).collect()
        assert {r.doc_id: (r.n_removed, r.n_near, r.links) for r in got} == brute(rows, threshold, 8)


CLASSES = ((8, 1), (13, 2), (18, 3))


def test_threshold_grows_with_length_and_short_lines_go_as_repeats(documents):
    rng = random.Random(21)
    held = [x for _ in range(2) for x in lines(rng, 120, 3)] + ["Les.", " ", "x", "Les.", "\t", " ", "Les", "x",
                                                               "one line of the longest class", "ne line o the longest clas",
                                                               "twelve chars", "twelve chars!", "seventeen charact", "seventeen, characxt"]
    rng.shuffle(held)
    rows = [(i, "\n".join(held[i * 4:i * 4 + 4])) for i in range(-(-len(held) // 4))]

    def alike(a, b):
        limit = max([edits for first, edits in CLASSES if min(len(a), len(b)) >= first], default=0)
        return min(len(a), len(b)) >= 8 and abs(len(a) - len(b)) <= limit and distance(a, b) <= limit

    first, places = {}, []
    for doc_id, text in rows:
        for pos, line in enumerate(text.split("\n")):
            if line.strip():
                places.append((doc_id, pos, line))
                first.setdefault(line, (doc_id, pos))
    near = {a: [b for b in first if a != b and alike(a, b)] for a in first}
    want = {doc_id: [0, 0, 0] for doc_id, _ in rows}
    for doc_id, pos, line in places:
        copy, earlier = first[line] < (doc_id, pos), any(first[b] < first[line] for b in near[line])
        want[doc_id] = [n + m for n, m in zip(want[doc_id], (copy or earlier, earlier and not copy, len(near[line])))]
    assert {len(a) - len(b) for a in near for b in near[a]} >= {-3, 3} and any(len(a) < 13 <= len(b) for a in near for b in near[a])
    got = line_dedup.dedup_report(documents([(i, t, "s") for i, t in rows]), CLASSES, 8, exact_chars=1).collect()
    assert {r.doc_id: [r.n_removed, r.n_near, r.links] for r in got} == want


def test_stage_removes_a_line_with_one_word_replaced(spark, documents):
    line = "All of the words of this line stand in both documents, in one order, " * 3
    docs = documents([(1, f"Les.\n\n{line}", "s"), (2, f"Les.\n\n{line.replace('the', 'is', 1)}\nnew\n\nend", "s")])
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got == {1: f"Les.\n\n{line}", 2: "\nnew\n\nend"}


LONG = "a line that is long enough to be compared"


def test_removal(documents, clashing):
    docs = documents([
        (1, f"{LONG}\nshort\n{LONG} too", "s"), (2, f"{LONG[:-1]}\nshort", "s"), (3, f"{LONG}\n{LONG[:-1]}", "s"), (4, None, "s"), (5, "", "s"),
        (None, f"{LONG} too\nnew words stand here, never seen before", "s"), (6, f"{LONG}\n ", "s")])
    wide = clashing(docs)
    got = line_dedup.remove_lines(wide)
    assert got.columns == wide.columns
    # 3 and 6 have nothing left; the rows without text lose nothing.
    assert {(r.doc_id, r.text) for r in got.collect()} == {
        (1, f"{LONG}\nshort\n{LONG} too"), (2, "short"), (None, "new words stand here, never seen before"), (4, None), (5, "")}


def test_repeated_rows_and_long_lines(documents):
    huge = "x" * 60_000
    docs = documents([(1, LONG, "s"), (1, LONG, "s"), (2, huge, "s"), (3, huge + "y", "s"), (4, "\n".join([LONG] * 3000), "s")])
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.n_near) for r in line_dedup.dedup_report(docs).collect())
    assert got == [(1, 1, 0, 0), (1, 1, 0, 0), (2, 1, 0, 0), (3, 1, 1, 1), (4, 3000, 3000, 0)]


def test_empty(documents):
    assert line_dedup.dedup_report(documents([])).count() == 0
    assert line_dedup.remove_lines(documents([])).count() == 0


def test_letters_are_counted_once_a_line(spark, documents, monkeypatch):
    kept, write, store = [], line_dedup.written, line_dedup.stored

    def plan(df):
        return df._jdf.queryExecution().analyzed().toString()

    monkeypatch.setattr(line_dedup, "written", lambda df, name: kept.append((df.columns, plan(df))) or write(df, name))
    monkeypatch.setattr(line_dedup, "stored", lambda df: kept.append((df.columns, plan(df))) or store(df))
    found = line_dedup.dedup_report(documents([(1, LONG, "s"), (2, f"{LONG}!", "s")])).collect()
    assert [(r.doc_id, r.n_removed, r.links) for r in sorted(found)] == [(1, 0, 1), (2, 1, 1)]
    # The number is written with the line; nothing that is kept later counts the letters of all lines again.
    (columns, first), *later = kept
    assert "code" in columns and "shiftleft" in first and not any("shiftleft" in p for _, p in later)


def family(rng, n, words):
    """Lines made from one, each with a word or two of it replaced; some alike, some with a gram that repeats, some hardly longer than a gram."""
    made, base = [], [f"{rng.choice('bdkt')}{rng.choice('aeio')}{rng.choice('lmns')}{rng.choice('aeio')}" for _ in range(words)]
    for _ in range(n):
        line = list(base)
        for at in rng.sample(range(words), rng.randint(1, 2)):
            line[at] = "".join(rng.choice("qwxyz") for _ in range(rng.randint(5, 7)))
        made.append(" ".join(line))
    near = [edited(rng, x, rng.randint(1, 3)) for x in rng.sample(made, n // 4)]
    repeats = ["ab" * 30 + edited(rng, "ab" * 8, rng.randint(0, 3)) for _ in range(n // 6)]
    return made + near + repeats + ["abcdefgh" + x for x in ("", "i", "ij", "kl")]


def test_lines_of_one_family_meet_by_what_is_rare(documents, monkeypatch):
    compared, store = [], line_dedup.stored

    def counted(df):
        kept = store(df)
        if kept.columns == ["a", "b"]:
            compared.append(kept.count())
        return kept

    monkeypatch.setattr(line_dedup, "stored", counted)
    monkeypatch.setattr(line_dedup, "COMMON", 6)
    monkeypatch.setattr(line_dedup, "ONE_IN", 1)
    monkeypatch.setattr(line_dedup, "GRAM_ONE_IN", 1)
    rng = random.Random(31)
    for threshold in (1, 3):
        held = family(rng, 90, 14)
        rng.shuffle(held)
        rows = [(i, "\n".join(held[i * 4:i * 4 + 4])) for i in range(-(-len(held) // 4))]
        want = brute(rows, threshold, 8)
        got = line_dedup.dedup_report(documents([(i, t, "s") for i, t in rows]), threshold, 8).collect()
        assert {r.doc_id: (r.n_removed, r.n_near, r.links) for r in got} == want
    # The same result without common segments compares all that share one.
    monkeypatch.setattr(line_dedup, "COMMON", 1 << 30)
    got = line_dedup.dedup_report(documents([(i, t, "s") for i, t in rows]), threshold, 8).collect()
    assert {r.doc_id: (r.n_removed, r.n_near, r.links) for r in got} == want
    assert compared[-2] < compared[-1] / 2, compared
