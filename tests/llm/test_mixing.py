from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridcast.llm import mixing
from gridcast.llm.store import ranked, words


def sized(df):
    return df.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def level_by_rounds(sizes, weights=(5, 2, 1), most=3):
    """Targets by handing out the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    whole, stopped = sum(sizes.values()), set()
    while True:
        rest = whole - sum(most * sizes[s] for s in stopped)
        open_weight = sum(weight[s] for s in names if s not in stopped)
        target = {s: most * sizes[s] if s in stopped else rest * weight[s] / open_weight for s in names}
        over = {s for s in names if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        stopped |= over


def test_targets_follow_weights_and_stops(documents):
    rows = [(i, "w " * (1 + i % 7), s) for i, s in enumerate(["a"] * 5 + ["b"] * 200 + ["c"] * 90 + ["d"] * 3 + [None] * 40)]
    got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(sized(documents(rows))).collect()}
    want = level_by_rounds({s: n for s, (n, _) in got.items()})
    assert {s: t for s, (_, t) in got.items()} == pytest.approx(want)
    assert sum(t for _, t in got.values()) == pytest.approx(sum(n for n, _ in got.values()))


def test_plan_comes_near_and_agrees(documents):
    rows = [(i, "w " * (i * 7919 % 40), s) for i, s in enumerate(["a"] * 60 + ["b"] * 900 + [None] * 100)]
    plan = mixing.mix_plan(sized(documents(rows)))
    first, second = plan.collect(), plan.collect()
    assert sorted(map(str, first)) == sorted(map(str, second)) and len(first) == len(rows)
    taken = Counter()
    for r in first:
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[r.source, r.target] += r.taken
    for (_, target), words_taken in taken.items():
        assert abs(words_taken - target) <= 40


def test_copies_are_boundaries_crossed(documents):
    rows = [(i, "w " * i, "a" if i % 3 else "b") for i in range(1, 50)]
    plan = mixing.mix_plan(sized(documents(rows))).orderBy("source", "size", "doc_id").collect()
    for source in ("a", "b"):
        own = [r for r in plan if r.source == source]
        each = int(own[0].target / own[0].source_size * mixing.UNIT)
        off = documents([]).sparkSession.range(1).select(mixing.offset(F.lit(source)).alias("o")).first().o
        assert [r.copies for r in own] == [((i + 1) * each + off >> 24) - (i * each + off >> 24) for i in range(len(own))]


def test_mix_emits_rows_with_all_columns(documents, clashing):
    rows = [(None, None, None), (1, "", "a"), (2, "x y z", "a"), (2, "x y z", "a"), (3, "p q", "b"), (None, "k", "b"), (7, "v " * 50_000, "c")]
    docs = clashing(documents(rows))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    plan = mixing.mix_plan(sized(docs)).agg(F.sum("copies")).first()[0]
    assert mixed.count() == plan
    assert {r.text for r in mixed.collect()} <= {r[1] for r in rows}


def test_empty(documents):
    assert mixing.mix_plan(sized(documents([]))).count() == 0
    assert mixing.mix(documents([])).count() == 0


def test_ranked_spreads_groups(spark):
    df = spark.range(0, 1000, 1, 7).select(F.when(F.col("id") % 3 > 0, "hot").alias("g"), (F.col("id") * 37 % 1000).alias("v"))
    rows = ranked(df, [F.col("g"), F.col("v")], ["g"]).collect()
    for group in (None, "hot"):
        own = sorted((r.v, r["rank"]) for r in rows if r.g == group)
        assert [k for _, k in own] == list(range(len(own)))
