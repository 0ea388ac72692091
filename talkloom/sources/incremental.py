"""Scans that parse a file again only when its time of change or its length is another: listings against a state table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of changed files that one read is given.
AT_ONCE = 10_000
_LISTING = "path string, modified timestamp, length long"


def listing(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, modified, length) of the files under root whose names fit pattern; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def changed(now: DataFrame, known: DataFrame) -> DataFrame:
    """Files of now that known lacks, or has with another time or length."""
    return now.join(known, ["path", "modified", "length"], "left_anti")


def refresh(spark: SparkSession, root: str, pattern: str, store: str, number: int, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of all files as of scan `number`: of changed and new files by parse(files (path, value)), which has to keep path; of the others
    those that scan number - 1 has stored; none of files that are gone. Listing and rows are written to store/files/number and
    store/rows/number, so that a scan that is repeated gives the same. The driver sees the paths of changed files, AT_ONCE at a time."""
    now = listing(spark, root, pattern)
    now.write.mode("overwrite").parquet(f"{store}/files/{number}")
    now = spark.read.parquet(f"{store}/files/{number}")
    known = spark.read.parquet(f"{store}/files/{number - 1}") if number else spark.createDataFrame([], _LISTING)
    new, out, batch = changed(now, known), None, []

    def parsed(paths: list[str]) -> DataFrame:
        files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value") if paths else spark.createDataFrame([], "path string, value string")
        return parse(files.withColumn("path", _plain("path")))

    for row in new.select("path").toLocalIterator():
        batch.append(row["path"])
        if len(batch) == AT_ONCE:
            out, batch = parsed(batch) if out is None else out.unionByName(parsed(batch)), []
    if batch or out is None:
        out = parsed(batch) if out is None else out.unionByName(parsed(batch))
    if number:
        same = now.join(known, ["path", "modified", "length"], "left_semi").select(_plain("path").alias("path"))
        out = spark.read.parquet(f"{store}/rows/{number - 1}").join(same, "path", "left_semi").select(*out.columns).unionByName(out)
    out.write.mode("overwrite").parquet(f"{store}/rows/{number}")
    return spark.read.parquet(f"{store}/rows/{number}")


def _plain(path) -> F.Column:
    """One spelling of a path: listings and readers differ in the slashes after the scheme."""
    return F.regexp_replace(path, "^file:/+", "/")
