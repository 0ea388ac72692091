"""Shared folder, written intermediate tables and plan-sized partition counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. A folder of our own only where none is set and all tasks run in the
    driver's process (tests, bench); on a cluster without the setting this is an error, as executors don't share local folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints/talkloom"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back. Lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by written(), once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.written_path)  # type: ignore[attr-defined]
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def scan_partitions(df: DataFrame) -> int:
    """Partitions of df's scan: grows with the input, known from the plan alone."""
    return max(1, df.rdd.getNumPartitions())


def n_words(text) -> F.Column:
    """Number of words in a text column; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def no_columns_lost(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: whatever else a table carries can't clash with the operator's own names."""
    return df.select(*[F.col(f"`{n}`") for n in names])
