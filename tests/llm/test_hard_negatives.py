import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridcast.llm import hard_negatives as hn
from gridcast.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_version(rows, step=100):
    """Every anchor against every row, by simple loops."""
    held = {}
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        one = (label, [math.floor(256 * float(np.float32(x))) for x in vector])
        held[vec_id] = min(one, held.get(vec_id, one))
    out = []
    for a, (label, v) in held.items():
        if a % step:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in held.items() if i != a and len(w) == len(v)]
        scored.sort()
        for p, pid in [(-s, i) for s, i, other in scored if other == label][:5]:
            fit = [(i, -s) for s, i, other in scored if other != label and 30 * p <= -100 * s <= 90 * p]
            out += [(a, pid, rank, i, p, s) for rank, (i, s) in enumerate(fit[:10], 1)]
    return sorted(out)


def mined(spark, rows, step=100, **options):
    df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hn.mine(df, label, F.col("vec_id") % step == 0, **options).collect())


def some(n, dim, seed, labels=4, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, dim)) * spread
    label = rng.integers(0, labels, n)
    points = (rng.standard_normal((n, dim)) + centres[label]) / math.sqrt(dim)
    return [(i, p.astype(np.float32).astype(float).tolist(), int(t)) for i, (p, t) in enumerate(zip(points, label))]


def test_intervals_hold_the_scores_and_rule_most_rows_out():
    rng = np.random.default_rng(1)
    for dim in (1, 2, 3, 16, 64, 100):
        values = rng.integers(-90, 90, (800, dim)) * rng.choice([0, 1, 1, 300], (800, 1))
        codes, length, code_length, alignment = hn.encode(values)
        rows = pd.DataFrame({"vec_id": np.arange(800), "label": 0, "content": [v.astype("<i8").tobytes() for v in values],
                             "code": [c.tobytes() for c in codes], "length": length, "code_length": code_length, "alignment": alignment})
        block = hn.Block(rows, dim)
        for query in (*values[:20], np.zeros(dim, dtype=np.int64)):
            lower, upper = block.intervals(query, slice(None))
            scores = values @ query
            assert ((lower <= scores) & (scores <= upper)).all()
        if dim >= 16:
            query = rng.integers(-90, 90, dim)
            size = np.sqrt((query ** 2).sum()) * length
            lower, upper = block.intervals(query, slice(None))
            assert np.median((upper - lower)[size > 0] / size[size > 0]) < 0.7
    turn = hn.rotation(64)
    assert turn.shape == (512, 64) and np.allclose(turn.T @ turn, np.eye(64))


def test_equals_brute_force(spark):
    rows = some(900, 16, 2)
    want = plain_version(rows, 30)
    assert len(want) > 500
    assert mined(spark, rows, 30) == want
    # The blocks are of no consequence.
    assert mined(spark, rows, 30, chunk_rows=50, deck_anchors=4) == want


def test_only_survivors_are_scored():
    rows = some(6000, 64, 3, labels=10)
    values = np.array([[math.floor(256 * x) for x in v] for _, v, _ in rows], dtype=np.int64)
    codes, length, code_length, alignment = hn.encode(values)
    block = hn.Block(pd.DataFrame({"vec_id": np.arange(6000), "label": [r[2] for r in rows], "content": [v.astype("<i8").tobytes() for v in values],
                                   "code": [c.tobytes() for c in codes], "length": length, "code_length": code_length, "alignment": alignment}), 64)
    seen = []

    class Counted:
        def __init__(self, held):
            self.held = held

        def __getitem__(self, places):
            found = self.held[places]
            if not isinstance(places, slice):
                seen.append(len(found))
            return Counted(found) if isinstance(places, slice) else found

    block.values = Counted(block.values)
    for i in range(0, 600, 100):
        ids, scores = block.positives(i, rows[i][2], values[i], 5)
        list(block.negatives(rows[i][2], values[i], scores, 10))
    assert sum(seen) < 0.5 * 6 * 6000


def test_ties_copies_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5] if i % 3 else [0.75, 0.25], i % 2) for i in range(120)]
    rows += [(200, [1.0, 1.0], None), (201, None, 1), (202, [nan, 1.0], 1), (203, [inf, 1.0], 0), (204, [None, 1.0], 0), (None, [1.0, 1.0], 1),
             (205, [], 1), (300, [], 1), (206, [0.0, 0.0], 0), (400, [0.0, 0.0], 1), (207, [1.0, 1.0, 1.0], 1), (500, [1.0, 1.0, 2.0], 1), (208, [0.5, 0.5, 0.5], 3),
             (209, [1e30, 1.0], 1), (2 ** 53 + 1, [2.0, 1.0], 1), (2 ** 53 + 3, [2.0, 1.0], 0)]
    rows += rows[:40] + [(1, [0.5, 0.5], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("dim", "chunk", "deck", "rank", "content", "held"):
        df = df.withColumn(name, F.lit("x"))
    got = mined(spark, df)
    assert got == plain_version([r for r in rows if r[0] != 209])
    assert {a for a, *_ in got} >= {0, 100, 400, 500} and {r[1] for r in got} >= {2 ** 53 + 1, 2 ** 53 + 3}
    assert mined(spark, []) == []
    assert mined(spark, rows[:1]) == []


def test_a_large_group_of_equal_vectors(spark):
    rows = some(300, 8, 5) + [(1000 + i, [0.25] * 8, i % 3) for i in range(700)]
    assert mined(spark, rows, 50) == plain_version(rows, 50)


def test_query_columns(spark, tmp_path):
    rows = some(400, 16, 6)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op13_hard_negatives"](spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_version(rows)
