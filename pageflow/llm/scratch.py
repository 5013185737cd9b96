"""Intermediate tables in the shared scratch folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageflow.session import checkpoint_dir, tune

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's settings and Arrow batches that stay small with long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return tune(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, removed when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/pageflow-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session is already gone; nothing else to do at exit
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the scratch folder and read back.

    Cuts the lineage like ``checkpoint()`` and lets several consumers share one computation; a
    lost executor costs only a reread. Columnar, so wide columns can be left unread. The shuffle
    files behind it are dropped as soon as it is written: nobody reads them again.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def same_key(left: Column, right: Column) -> Column:
    """Join condition under which a null key is a key like any other."""
    return left.eqNullSafe(right)


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
