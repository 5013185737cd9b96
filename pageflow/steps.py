"""Tables written between the steps of operators that iterate."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pageflow.session import checkpoint_dir


def step_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Steps:
    """Scratch tables of one operator below ``spark.checkpoint.dir``.

    A stored step cuts the lineage and survives lost executors. ``drop`` removes a step that a
    later one has replaced.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.paths: dict[int, str] = {}

    def store(self, df: DataFrame) -> DataFrame:
        path = step_path(self.spark, self.name)
        df.write.parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(stored)] = path
        return stored

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            if path := self.paths.pop(id(table), None):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(steps: Steps, df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` stored with ``name``: an increasing number of every row in the order of all rows.

    Rows are range partitioned and sorted, so a group of any size spans tasks; the partition is
    the number's upper part and Spark's running number inside it the lower one. Numbers have gaps
    between partitions. Rows equal in ``order`` stand in any order, the same one from here on.
    """
    tie = "_tie"
    marked = steps.store(df.withColumn(tie, F.monotonically_increasing_id()))
    cut = marked.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    out = steps.store(cut.drop(tie).withColumn(name, F.monotonically_increasing_id()))
    steps.drop(marked)
    return out
