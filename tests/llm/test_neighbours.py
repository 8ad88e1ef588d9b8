import numpy as np
from pyspark.sql import functions as F

from gridcast.llm import neighbours as nb


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def exact(points, ids, query, k):
    scores = points @ points[query]
    scores[query] = -np.inf
    order = np.lexsort((ids, -scores))[:k]
    return [int(i) for i in ids[order]]


def test_recall_on_vectors_of_unlike_norms(spark):
    rng = np.random.default_rng(3)
    points = (rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))).astype(np.float32).astype(float)
    ids = np.arange(1500)
    rows = [(int(i), p.tolist(), 0) for i, p in zip(ids, points)]
    got = nb.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, k=10).toPandas()
    hits = 0
    for query, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 11)) and query not in set(part["vec_id"])
        assert np.allclose(part["score"], points[part["vec_id"]] @ points[query])
        assert (np.diff(part["score"]) <= 0).all()
        hits += len(set(exact(points, ids, query, 10)) & set(part["vec_id"]))
    assert got["query_id"].nunique() == 30 and hits / 300 >= 0.9


def test_all_leaves_is_exact_and_ties_go_to_small_ids(spark):
    base = np.eye(4, dtype=float)
    rows = [(i, base[i % 3].tolist(), 0) for i in range(90)]
    got = nb.nearest(frame(spark, rows), F.col("vec_id") == 3, k=5, share=2.0 * nb.TREES).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(0, 1.0), (6, 1.0), (9, 1.0), (12, 1.0), (15, 1.0)]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [], 0),
            (8, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0), (9, [0.25, 0.0], 0), (9, [0.25, 0.0], 0)]
    df = frame(spark, rows).withColumn("tree", F.lit(1)).withColumn("rank", F.lit("x"))
    got = nb.nearest(df, F.col("vec_id").isin(0, 2, 3, 4), k=20).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5), (0, 2, 9, 0.25)]
    assert nb.nearest(frame(spark, []), F.lit(True)).count() == 0


def test_one_queue_for_all_trees():
    rng = np.random.default_rng(1)
    forest = nb.Forest.fit(rng.standard_normal((300, 5)).astype(np.float32), 3, 4)
    order = forest.search(rng.standard_normal(5).astype(np.float32), 100.0)
    assert sorted(order) == [(t, n) for t in range(3) for n in range(16)]
    assert [t for t, _ in order[:16]] != sorted(t for t, _ in order[:16])
    assert np.allclose(forest.weights.sum(axis=1), 1)


def test_repeated_ids_count_once(spark):
    rng = np.random.default_rng(5)
    rows = [(i, p, 0) for i, p in enumerate(rng.standard_normal((40, 4)).astype(np.float32).astype(float).tolist())]
    rows += [(i, rows[3][1], 0) for i in range(40, 44)]

    def found(held):
        got = nb.nearest(frame(spark, held), F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect()
        return [(r.query_id, r["rank"], r.vec_id, r.score) for r in got]

    once = found(rows)
    assert len(once) == 15
    # Many copies of one among equal vectors, of the nearest row of a query, and of every row.
    assert found(rows + [rows[3]] * 30) == found(rows + [rows[once[0][2]]] * 30) == found(rows * 2) == once
    # Of two vectors under one id the smaller counts.
    assert found(rows + [(0, [9.0] * 4, 0)]) == once
