from pyspark.sql import functions as F

from corvane.operators import checks, store


def test_a_small_file_is_dealt_over_all_cores_and_a_large_one_is_not(spark, tmp_path, monkeypatch):
    spark.range(500).coalesce(1).write.parquet(f"{tmp_path}/t")
    small = store.spread(spark.read.parquet(f"{tmp_path}/t"))
    assert small.rdd.getNumPartitions() >= 4 and small.count() == 500
    monkeypatch.setattr(store, "SPREAD", 1)
    assert store.spread(spark.read.parquet(f"{tmp_path}/t")).rdd.getNumPartitions() == 1


def test_duplicates_are_sought_in_values_computed_once(spark):
    counted = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def title(x):
        counted.add(1)
        return str(int(x) // 2)

    rows = spark.range(20).select(title.asNondeterministic()(F.col("id")).alias("title"), F.col("id").cast("string").alias("path"))
    assert checks._repeated(rows, "title").count() == 10
    assert counted.value == 20
