import time

import pytest
from pyspark.sql import functions as F

from gridcast.plans.memo import ResultStore


@pytest.fixture
def place(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id") * 2).write.parquet(f"{tmp_path}/in")
    return str(tmp_path)


def total(spark, place, least=10):
    return spark.read.parquet(f"{place}/in").filter(F.col("id") >= least).agg(F.sum("v").alias("total"))


def test_second_call_reads_what_the_first_wrote(spark, place):
    store = ResultStore(spark, f"{place}/store")
    first, known = store.fetch(total(spark, place), "total")
    assert not known
    # Another store object, as in a later run; the result is read from its folder, the input is not.
    second, known = ResultStore(spark, f"{place}/store/").fetch(total(spark, place), "total")
    assert known and second.collect() == first.collect() == total(spark, place).collect()
    assert all("/store/total-" in f for f in second.inputFiles())
    assert second.schema == total(spark, place).schema


def test_a_new_session_finds_it(spark, place):
    key = ResultStore(spark, place).key(total(spark, place))
    other = spark.newSession()
    assert ResultStore(other, place).key(total(other, place)) == key


def test_changed_input_is_computed_again(spark, place):
    store = ResultStore(spark, f"{place}/store")
    before = store.fetch(total(spark, place), "total")[0].first()["total"]
    spark.range(1000, 1001).withColumn("v", F.col("id") * 2).write.mode("append").parquet(f"{place}/in")
    after, known = store.fetch(total(spark, place), "total")
    assert not known and after.first()["total"] == before + 2000
    # The same size and content, written anew.
    keys = {store.key(total(spark, place))}
    time.sleep(1.1)
    spark.read.parquet(f"{place}/in").write.parquet(f"{place}/copy")
    spark.read.parquet(f"{place}/copy").write.mode("overwrite").parquet(f"{place}/in")
    keys.add(store.key(total(spark, place)))
    assert len(keys) == 2


def test_other_parameters_and_columns_have_other_keys(spark, place):
    store = ResultStore(spark, place)
    frames = [total(spark, place, 10), total(spark, place, 11), total(spark, place).withColumnRenamed("total", "t"),
              total(spark, place).withColumn("total", F.col("total").cast("double"))]
    many = spark.read.parquet(f"{place}/in").select(*[(F.col("id") + i).alias(f"c{i}") for i in range(60)])
    frames += [many, many.withColumn("c59", F.col("c59") + 1)]
    keys = [store.key(f) for f in frames]
    assert len(set(keys)) == len(keys) and None not in keys


def test_what_changes_by_itself_is_not_kept(spark, place):
    store = ResultStore(spark, f"{place}/store")
    rows = spark.read.parquet(f"{place}/in")
    for frame in (rows.withColumn("r", F.rand()), rows.withColumn("d", F.current_date()), rows.withColumn("t", F.now())):
        assert store.key(frame) is None
        assert store.fetch(frame, "x")[1] is False and store.fetch(frame, "x")[1] is False


def test_half_written_entries_do_not_count(spark, place):
    store = ResultStore(spark, f"{place}/store")
    frame = total(spark, place)
    spark.range(1).write.parquet(f"{place}/store/total-{store.key(frame)}/attempt-0")
    import pathlib

    pathlib.Path(f"{place}/store/total-{store.key(frame)}/attempt-0/_SUCCESS").unlink()
    got, known = store.fetch(frame, "total")
    assert not known and got.columns == ["total"]


def test_odd_folder_names_and_pruning(spark, tmp_path):
    root = f"{tmp_path}/a b[1]{{x}}%20"
    spark.range(10).withColumnRenamed("id", "v").write.parquet(f"{root}/in")
    escaped = root.replace("[", "\\[").replace("]", "\\]").replace("{", "\\{").replace("}", "\\}")
    store = ResultStore(spark, f"{tmp_path}/store")
    frames = [spark.read.parquet(f"{escaped}/in").filter(f"v > {i}") for i in range(3)]
    assert [store.fetch(f, "odd")[1] for f in frames + frames] == [False] * 3 + [True] * 3
    store.fetch(frames[0], "odd-other")
    assert store.prune("odd", keep=1) == 2 and store.prune("odd", keep=1) == 0
    assert sum(store.fetch(f, "odd")[1] for f in frames) == 1
    assert store.fetch(frames[0], "odd-other")[1]
