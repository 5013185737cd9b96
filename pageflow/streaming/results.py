"""First results as they arrive: a sink that a repeated micro-batch cannot fill twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageflow.operators.jobs import KEYS, first_result

BATCH = "batch"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class FirstResultSink:
    """``foreachBatch`` target that stores the first result of every page below ``path``.

    A micro-batch keeps the first arrival of each page (by ``arrival``) that no earlier batch has
    stored, in a partition ``batch=<id>`` of its own. The partitions are the ledger of batches: a
    batch compares itself with smaller ids only and replaces its own partition as a whole, so a
    batch that comes again, after a failure before or after the commit, stores the same rows once.
    """

    def __init__(self, path: str, arrival: list[str], keys: list[str] = KEYS):
        self.path, self.arrival, self.keys = path, arrival, keys

    def __call__(self, results: DataFrame, batch_id: int) -> None:
        fresh = first_result(results, self.keys, self.arrival)
        if _exists(results.sparkSession, self.path):
            stored = results.sparkSession.read.schema(f"{results.select(*self.keys).schema.toDDL()}, {BATCH} LONG").parquet(self.path)
            fresh = fresh.join(stored.filter(F.col(BATCH) < batch_id).select(*self.keys), self.keys, "left_anti")
        (
            fresh.withColumn(BATCH, F.lit(batch_id).cast("long")).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(self.path)
        )


def store_first_results(results: DataFrame, path: str, checkpoint: str, arrival: list[str]):
    """Starts the stream ``results`` into a :class:`FirstResultSink` at ``path``, over everything available."""
    sink = FirstResultSink(path, arrival)
    return results.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def read_first_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BATCH)
