import random
import re

import pytest

from gridcast.llm import decontaminate as dc

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, size=13):
    grams = {}
    for item, text in items:
        w = plain(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k:k + n]), set()).add(item)
    out = []
    for i, text in rows:
        w, hit, found = plain(text), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k:k + n])) in grams:
                    hit.update(range(k, k + n))
                    found |= grams[g]
        out.append((i, len(w), len(hit), sorted(str(f) for f in found if f is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def report(docs, held):
    return [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in dc.contamination(docs, held).collect()]


def made(rng, n):
    return [f"{rng.choice('abcdeé')}{rng.randrange(40)}" for _ in range(n)]


def test_same_as_definition(documents, items):
    rng = random.Random(6)
    tests = [(i, made(rng, rng.choice([1, 2, 5, 13, 14, 30]))) for i in range(30)] + [(90, []), (10, made(rng, 20))]
    tests += [(91, list(tests[3][1])), (None, made(rng, 15))]
    rows = []
    for i in range(150):
        w = made(rng, rng.randint(0, 200))
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(tests)[1]
            a, at = rng.randrange(len(item) + 1), rng.randrange(len(w) + 1)
            w[at:at] = item[a // 3:]
        rows.append((i, "".join(x.upper() + rng.choice([" ", ", ", "\n", "-"]) for x in w)))
    held = [(i, " ".join(w)) for i, w in tests]
    got = report(documents([(i, t, "s") for i, t in rows]), items(held))
    assert sorted(got) == sorted(brute(rows, held))


def test_a_full_table_of_flags_changes_nothing(documents, items, monkeypatch):
    monkeypatch.setattr(dc, "MAX_SLOTS", 1 << 12)
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 10)
    rng = random.Random(1)
    held = [(i, " ".join(made(rng, 60))) for i in range(80)]
    rows = [(i, " ".join(made(rng, 50)) + " " + held[i][1][:200]) for i in range(40)]
    assert sorted(report(documents([(i, t, "s") for i, t in rows]), items(held))) == sorted(brute(rows, held))


def test_edges(documents, items, clashing):
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(1, item, "s"), (1, item, "s"), (None, item, "s"), (2, None, "s"), (3, "", "s"), (4, "?!", "s"), (5, ("z " * 100_000) + item, "s"), (6, "clean words only", "s")]
    docs = clashing(documents(rows))
    got = sorted(map(str, report(docs, items([(7, item)]))))
    assert got == sorted(map(str, brute([(i, t) for i, t, _ in rows], [(7, item)])))
    kept = dc.remove_documents(docs, items([(7, item)]))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 6]
    cut = dc.remove_spans(documents([(1, f"Before, {item.upper()}. After", "s"), (2, "clean", "s"), (3, None, "s")]), items([(7, item)]))
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert plain(texts[1]) == ["before", "after"] and texts[1].startswith("Before, ") and texts[2] == "clean" and texts[3] is None


def test_empty(documents, items):
    assert report(documents([]), items([(1, "a b")])) == []
    assert report(documents(["a b"]), items([])) == [(0, 2, 0, [], False)]
    assert report(documents(["a b"]), items([(1, None), (2, "..")])) == [(0, 2, 0, [], False)]
