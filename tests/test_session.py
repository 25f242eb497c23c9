import os

from veilscan.session import clear_scratch, scratch, shared_dir, spread, written


def test_written_tables_and_their_end(spark):
    clear_scratch(spark)
    df = written(spark.range(10), "test")
    assert df.count() == 10
    folder = shared_dir(spark).removeprefix("file://")
    assert [f for f in os.listdir(folder) if f.startswith("test-")]
    assert clear_scratch(spark) == 1 and not [f for f in os.listdir(folder) if f.startswith("test-")]
    assert scratch(spark, "a") != scratch(spark, "a")


def test_spread_only_small_inputs(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores + 3)
    assert spread(many) is many
