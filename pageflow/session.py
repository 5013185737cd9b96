"""Session settings the jobs rely on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings only: they can be applied to a session someone else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A job, folder or file may hold a third of all rows: let AQE split such join
    # partitions even when that costs an extra exchange for the following aggregate.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# An exchange is cut finely and adaptive execution joins the pieces up to a size, so a task sorts
# and groups about as many rows however large the tables are.
EXCHANGE_PIECES = 200
TASK_SHUFFLE_BYTES = "8m"


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


PIECES = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def bound_tasks(spark: SparkSession) -> SparkSession:
    """A session of its own with the settings of ``spark``, in which exchanges of any size make tasks of a bounded one."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    pieces = max(EXCHANGE_PIECES, int(own.conf.get("spark.sql.shuffle.partitions")))
    own.conf.set(PIECES, str(pieces))
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_SHUFFLE_BYTES)
    return own


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local master may go without: it gets a fresh folder that is removed when the driver
    ends. Anywhere else each machine would write to its own disk, so that is an error.
    """
    context = spark.sparkContext._jsc.sc()
    current = context.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pageflow-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named
