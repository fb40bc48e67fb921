"""Session set-up and the shared folder for checkpoints and hand-over tables."""

from __future__ import annotations

import math
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "halflight", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this toolkit expects; callers add cluster settings."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoints go when nothing refers to them any more
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one hand-over table."""
    return f"{shared_dir(spark).rstrip('/')}/halflight/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a partition that a fit reads again and again, where all cores have one.
PART_ROWS = 100_000


def gathered(df: DataFrame, n: int) -> DataFrame:
    """``df``, ``n`` rows, in as many partitions as its rows and the cores need, and never more than it had.

    Rows of a few numbers come from texts in far more partitions; a fit starts a task on each of them
    hundreds of times.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n / PART_ROWS)))


def is_file(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isFile()


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file that does not exist yet; False if it does. Of two at once one succeeds, where
    the file system creates a file at most once."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        fs.create(hadoop_path, False).close()
    except Py4JJavaError:
        if fs.exists(hadoop_path):
            return False
        raise
    return True
