from pyspark.sql import functions as F

from pairlens.operators import classify as C


def test_no_task_gets_a_class(spark):
    """One class of 2,000 rows: neither step sends its rows through one partition."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 2003, 1, 8).select(F.when(F.col("id") < 2000, "a").when(F.col("id") < 2002, "b").alias("label"), "id")
        most = lambda d: max(r["count"] for r in d.groupBy(F.spark_partition_id().alias("p")).count().collect())
        common = C.common_classes(rows, "label", 3)
        assert common.count() == 2000 and most(common) < 500
        assert most(C.holdout(rows, "label", "id")) < 500
        held = {r.label: r.n for r in C.holdout(rows, "label", "id", 0.5).where("held_out").groupBy("label").agg(F.count("id").alias("n")).collect()}
        assert held == {"a": 1000, "b": 1}  # the class of one row, null, has none
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
