import math
import zlib
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from gridcast.llm import sharding as sh
from gridcast.llm.queries import QUERIES


def law(total, good, taken):
    """The whole distribution, in fractions."""
    low, high = max(0, taken + good - total), min(taken, good)
    whole = math.comb(total, taken)
    return {k: Fraction(math.comb(good, k) * math.comb(total - good, taken - k), whole) for k in range(low, high + 1)}


def inverted(total, good, taken, unit):
    summed = Fraction(0)
    for k, p in law(total, good, taken).items():
        summed += p
        if Fraction(unit) < summed:
            return k
    return min(taken, good)


def test_draws_invert_the_law(spark):
    cases = [(total, good, taken, (i or 1e-6) / 37) for total in (0, 1, 2, 7, 40, 900) for good in {0, 1, total // 3, total}
             for taken in {0, 1, total // 2, total} if good <= total and taken <= total for i in (0, 1, 5, 18, 36)]
    df = spark.createDataFrame(cases, "total long, good long, taken long, unit double")
    got = df.select("*", sh.hypergeometric(*(F.col(c) for c in df.columns)).alias("k")).collect()
    assert [r.k for r in got] == [inverted(*r[:4]) for r in got]


def test_draws_of_large_numbers(spark):
    n = 400
    df = spark.range(n).select(sh.hypergeometric(F.lit(10 ** 9), F.lit(10 ** 9 // 16), F.lit(10 ** 6), sh._unit(F.lit(5), "id")).alias("k"))
    drawn = [r.k for r in df.collect()]
    mean, var = sum(drawn) / n, 0.0
    var = sum((k - mean) ** 2 for k in drawn) / n
    want = 10 ** 6 / 16 * 15 / 16 * (1 - 1e-3)
    assert abs(mean - 62_500) < 5 * math.sqrt(want / n) and 0.7 < var / want < 1.4


def test_matrix_sums_and_chances(spark):
    sizes = [5, 0, 3, 1, 9, 2, 4]
    df = spark.createDataFrame(list(enumerate(sizes)), "part long, n long")
    first = Counter()
    for seed in range(8):
        rows = {r.part: r.counts for r in sh.communication_matrix(df, [9, 8, 7], seed).collect()}
        assert [sum(rows[p]) for p in range(7)] == sizes
        assert [sum(c) for c in zip(*rows.values())] == [9, 8, 7]
        first[tuple(rows[4])] += 1
    assert len(first) > 3
    assert sh.communication_matrix(df.limit(0), [0, 0]).count() == 0


def test_matrix_follows_the_law(spark):
    # 2,000 tables of 2 partitions at once, through the draw of one halving: the first cell is hypergeometric.
    drawn = spark.range(2000).select(sh._split(F.array(F.lit(4), F.lit(3), F.lit(3)).cast("array<bigint>"), F.lit(10).cast("long"), F.lit(5).cast("long"), 3, F.col("id"), 1).alias("k")).collect()
    got = Counter(r.k[0] for r in drawn)
    for k, p in law(10, 4, 5).items():
        assert abs(got[k] / 2000 - float(p)) < 5 * math.sqrt(float(p) / 2000)
    assert all(sum(r.k) == 5 and r.k[1] <= 3 and r.k[2] <= 3 for r in drawn)


def test_shuffle_is_uniform(spark):
    """Over many seeds each row comes to each place about as often, and neighbours part."""
    rows = spark.range(0, 12, numPartitions=3)
    at, runs = Counter(), 12
    for seed in range(runs):
        got = sh.shard(rows, 3, seed, cell_rows=2).collect()
        places = {(r.shard, r.slot): r.id for r in got}
        assert sorted(places) == [(s, k) for s in range(3) for k in range(4)]
        at.update((i, s) for (s, _), i in places.items())
    chi = sum((at[i, s] - runs / 3) ** 2 / (runs / 3) for i in range(12) for s in range(3))
    assert chi < 60  # 24 degrees of freedom: about one in 10,000


def test_sizes_slots_and_odd_rows(spark, documents, clashing):
    rows = [(i % 7, "copy", "s") for i in range(300)] + [(None, None, None)] * 40 + [(9, "", "s"), (10, "é" * 100_000, "s")]
    df = clashing(documents(rows)).withColumn("slot", F.lit("x")).withColumn("part", F.lit(3)).withColumn("row.a", F.lit(1)).repartition(5)
    got = sh.shard(df, 16, cell_rows=5)
    assert got.columns == [c for c in df.columns if c != "slot"] + ["shard", "slot"]
    held = got.collect()
    counts = Counter(r.shard for r in held)
    assert sorted(counts) == list(range(16)) and set(counts.values()) == {21, 22} and counts[0] == 22
    for s, n in counts.items():
        assert sorted(r.slot for r in held if r.shard == s) == list(range(n))
    assert Counter((r.doc_id, r.text, r.source) for r in held) == Counter((a, t, s) for a, t, s in rows)
    assert max(Counter(r.shard for r in held if r.doc_id is None).values()) < 12


def test_few_rows_and_none(spark, documents):
    got = sh.shard(documents([(1, "a", "s"), (2, "b", "s")]), 16).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (1, 0)]
    assert sh.shard(documents([]), 16).count() == 0


def test_written_shards(spark, tmp_path):
    path = f"{tmp_path}/out"
    sh.write_shards(spark.range(0, 1000, numPartitions=4).withColumnRenamed("id", "doc_id"), path, 4)
    back = spark.read.parquet(path)
    assert [r["count"] for r in back.groupBy("shard").count().orderBy("shard").collect()] == [250] * 4
    assert back.select("doc_id").distinct().count() == 1000
    one = [r.slot for r in spark.read.parquet(f"{path}/shard=2").collect()]
    assert sorted(one) == list(range(250))


def test_query(spark, documents, tmp_path):
    rows = [(i, f"text {i} é", "s") for i in range(100)] + [(100, None, None), (2 ** 53 + 1, "", "s"), (None, "x", "s")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_sharding"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    held = got.collect()
    want = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows}
    assert {tuple(r[:3]) for r in held} == want and len(held) == len(rows)
    assert {(r.law, r.grown_shard) for r in held} == {("rows", None)}
    counts = Counter(r.shard for r in held)
    assert max(counts.values()) - min(counts.values()) == 1 and len(counts) == 16
    for s, n in counts.items():
        assert sorted(r.slot for r in held if r.shard == s) == list(range(n))
    again = QUERIES["op12_sharding"](spark, str(tmp_path)).collect()
    assert sorted(map(str, held)) == sorted(map(str, again))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
