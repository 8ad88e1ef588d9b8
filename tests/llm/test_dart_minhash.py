import random
import re
from collections import Counter

import numpy as np

from gridcast.llm import dart_minhash as dm


def runs(text, n=5):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(rows, least=0.8):
    held = {i: runs(t) for i, t in rows}
    root = {i: i for i in held}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(held)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if held[a] and held[b] and similarity(held[a], held[b]) >= least:
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {i: find(i) for i in held}


def text(rng, n):
    return " ".join(rng.choice("stone river cloud Amber field light carry seven winter paper candle orange") + str(rng.randrange(30)) for _ in range(n))


def varied(rng, base, n):
    w = base.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(999)}"
    return " ".join(w)


def test_agreement_is_the_weighted_similarity():
    rng = np.random.default_rng(5)
    code = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    one, two = rng.uniform(0, 4, 400), rng.uniform(0, 4, 400)
    one[:40], two[40:80] = 0, 0
    own = np.repeat([0, 1], 400)
    got = dm.signatures(2, own, np.concatenate([code, code]), np.concatenate([one, two]), 4096)
    want = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    assert abs((got[0] == got[1]).mean() - want) < 0.03
    half = dm.signatures(1, own[:400], code, one, 4096)
    assert (half[0] == got[0]).all()  # a text's signature does not hang on its neighbours


def test_shingles_count_repeats():
    owner, code, weight = dm.shingled([b"a b c d e f", b"", b"A b, c", b"x x x x x x x"])
    assert Counter(owner.tolist()) == {0: 2, 2: 1, 3: 1} and weight[owner == 3].tolist() == [3]


def test_classes_match_brute_force(documents):
    rng = random.Random(4)
    rows = []
    for family in range(6):
        base = text(rng, 80)
        rows += [base, base.upper(), *(varied(rng, base, k % 5) for k in range(6))]
    rows += [text(rng, n) for n in (1, 2, 4, 5, 6, 30, 500)] + ["one two", "One, two!", "", "?", None]
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in dm.classes(documents(rows)).collect()}
    assert got == brute(list(enumerate(rows)))


def test_a_chain_and_a_hot_group(documents):
    rng = random.Random(9)
    base = text(rng, 120)
    rows = [base] * 40 + [base + f" tail{i}" for i in range(60)]
    step = text(rng, 100)
    for _ in range(8):
        rows.append(step)
        step = varied(rng, step, 2)
    got = {r.doc_id: r.class_id for r in dm.classes(documents(rows)).collect()}
    assert got == brute(list(enumerate(rows)))


def test_keep_one(documents, clashing):
    same = "these words are the same in all of the rows here"
    rows = [(5, same, "a"), (3, same, "a"), (3, same, "a"), (None, same, "a"), (9, None, "a"), (8, "", "a"), (1, "w " * 70_000, "a"), (2, "quite other words stand in this row alone", "b")]
    docs = clashing(documents(rows))
    kept = dm.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "8", "9", "None"]
    assert dm.keep_one(documents([])).count() == 0 and dm.classes(documents([])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = {r.node: r.component for r in dm.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, **{k: 100 for k in range(101, 160)}}


def test_tiles_of_any_size_find_the_same_links(documents, monkeypatch):
    """Families made from one text by edits: most of their pairs share bands, some are alike, and few are alike to the same one."""
    rng = random.Random(21)
    rows = []
    for _ in range(3):
        base = text(rng, 90)
        rows += [varied(rng, base, rng.choice((1, 3, 5))) for _ in range(25)]
    rows += ["", "one", None]
    want = brute(list(enumerate(rows)))
    for nodes, units in ((1024, 1 << 20), (3, 1 << 20), (1024, 200)):
        monkeypatch.setattr(dm, "CHUNK_NODES", nodes)
        monkeypatch.setattr(dm, "CHUNK_UNITS", units)
        assert {r.doc_id: r.class_id for r in dm.classes(documents(rows)).collect()} == want


def test_sketches_rule_out_no_pair_that_is_alike():
    rng = np.random.default_rng(6)
    for size in (5, 300, 40_000):
        a = rng.integers(-(1 << 62), 1 << 62, size)
        b = np.concatenate([a[: size * 9 // 10], rng.integers(-(1 << 62), 1 << 62, size // 10)])
        short = [dm.repeats_told(((x & 0xFFFF) - 0x8000).astype(np.int16)) for x in (a, b)]
        assert [len(np.unique(x)) for x in short] == [len(a), len(b)]
        assert len(np.intersect1d(*short)) >= len(np.intersect1d(a, b))


def test_only_what_sketches_leave_meets_by_its_elements(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(-(1 << 62), 1 << 62, 200).tolist()
    other = lambda n: rng.integers(-(1 << 62), 1 << 62, n).tolist()
    # 1 and 2 are alike; the others share less than 0.8 with any.
    units = {1: base, 2: base[:190] + other(10)} | {i: base[:120] + other(80) for i in range(3, 40)}
    elements = spark.createDataFrame(list(units.items()), "node long, elements array<long>")
    open_nodes = spark.createDataFrame([(k, i, len(u), i) for i, u in units.items() for k in (5, 9)], "key long, node long, weight long, component long")
    seen, tiles = [], dm.tiles
    monkeypatch.setattr(dm, "tiles", lambda nodes, elements: seen.append(tiles(nodes, elements)) or seen[-1])
    assert [tuple(r) for r in dm.across(open_nodes, elements, 0.8).collect()] == [(1, 2)]
    sketched, whole = seen
    assert sketched.schema["elements"].dataType.elementType.simpleString() == "smallint" and sketched.count() == 2 * len(units)
    assert {(r.key, r.node) for r in whole.collect()} == {(5, 1), (5, 2)}
