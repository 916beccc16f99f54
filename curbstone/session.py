"""Session defaults shared by tests, the bench and command-line jobs."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "curbstone", cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session that the cluster gives."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows, narrow ones, up to which a table is sent to all executors once it has been counted.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> tuple[DataFrame, bool]:
    """(df computed once, whether it may be sent to all executors): it is marked for that if it has at most BROADCAST_ROWS rows."""
    df = materialized(df)
    if df.count() <= BROADCAST_ROWS:
        return F.broadcast(df), True
    return df, False


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def materialized(df: DataFrame) -> DataFrame:
    """df for several uses: a Parquet table in the folder that the cluster shares, or persisted where none is set.

    A table is about a fifth of a checkpoint's size, and each use reads only the columns that it needs. It is deleted when the program ends.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        return df.persist()
    path = f"{shared.rstrip('/')}/curbstone/{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
