"""What several of the operators share: words, checkpoints and the shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a session that runs on one machine; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = getattr(spark, "_curbstone_dir", None)
        if not found:
            found = spark._curbstone_dir = tempfile.mkdtemp(prefix="curbstone-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str = "") -> str:
    """A path in the shared folder that nothing has yet; what is there is deleted when the session's program ends."""
    path = f"{shared_dir(spark).rstrip('/')}/curbstone/{name}{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system that Spark itself uses; nothing happens once the session has ended."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def keep(df: DataFrame) -> DataFrame:
    """df computed once and held in the shared folder, so later steps neither recompute it nor lose it with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """As keep(), as a compressed Parquet table: for wide or large rows. The path, if given, is one of new_folder()."""
    path = path or new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
