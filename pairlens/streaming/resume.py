"""Incremental scoring: a stream of requests, each key scored once, restartable at any point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pairlens.operators.scoring import score


#: Buckets of keys; a batch reads those of the table that its own keys fall into.
BUCKETS = 256


def scored(spark: SparkSession, out: str) -> DataFrame | None:
    """The table of ``score_stream`` (key, answer, batch, bucket), or None where no batch has been written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder) or not any("batch=" in f.getPath().getName() for f in files.listStatus(folder)):
        return None
    return spark.read.parquet(out)


def score_stream(requests: DataFrame, key: str, scorer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Score a stream of requests into the parquet table ``out`` (key, answer, batch, bucket), each key once.

    The stream keeps no state: a batch leaves out the keys that earlier batches have scored, which it finds in those
    buckets of ``out`` that its own keys fall into (by hash, of ``buckets``). So memory does not grow with the keys seen, and a batch
    reads no more than its buckets of the table. A batch writes its own partition anew and reads only those before
    it, so one that is run again after a failure adds none twice. A key whose answer was null is asked again when it comes again. Keep ``buckets`` for a table's life.
    """
    spark = requests.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        new = df.withColumn("bucket", bucket)
        before = scored(spark, out)
        if before is not None:
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # of ``buckets`` at most
            done = before.where(F.col("bucket").isin(touched) & (F.col("batch") < number) & F.col("answer").isNotNull()).select(key, "bucket")
            new = new.join(done, [key, "bucket"], "left_anti")
        answers = score(new.drop("bucket"), key, scorer)[0].select(key, "answer").dropDuplicates([key])
        answers.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
