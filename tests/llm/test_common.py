from pyspark.sql import functions as F

from lectern.llm.common import join_skewed


def test_rows_of_frequent_keys_are_dealt_evenly(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id")).cast("long").alias("key"), F.col("id").alias("_row"))
        right = left.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.max("_row").alias("top"))
        joined = join_skewed(left, right, "key", 100_000)
        sizes = joined.select(F.spark_partition_id().alias("p"), "top", F.rand().alias("r")).toPandas().groupby("p").size()
        assert len(sizes) == 16 and max(sizes) < 1.2 * 100_000 / 16
        assert joined.where("key = -1 and top = 99998").count() == 50_000
        assert joined.where("key > 0 and top = _row").count() == 40_000 and joined.where("key is null and top is null").count() == 10_000
    finally:
        for name in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
