"""Corpus pipeline: quality, near duplicates, mixing, packing. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm.common import discard, written
from talkloom.llm.mixing import checked, mixture
from talkloom.llm.packing import pack
from talkloom.llm.prefix_join import jaccard_components
from talkloom.llm.quality import classify, row_key
from talkloom.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps: each by its own verdict, also where ids are null or repeat."""
    ship(spark)
    verdicts = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keyed=True)
    out = written(verdicts.where("not keep").select("row_key").distinct(), "rejected")
    key = row_key(*[docs[c] for c in ("doc_id", "text", "source", "lang")])
    return docs.join(checked(out), key == out["row_key"], "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, rows without an id last; of rows of one id that with
    the smallest row key, a hash of what the row holds. Each row counts for itself, also where ids are null or repeat; of equal
    rows one stays. Rows without words are no copies of anything. The order of rows and files doesn't matter."""
    ship(spark)
    key = row_key(*[docs[c] for c in ("doc_id", "text", "source", "lang")])
    rows = written(docs.withColumns({"__row": F.monotonically_increasing_id(), "__key": key}), "rows")
    groups = written(jaccard_components(rows, "__row").select(F.col("doc_id").alias("__row"), "component_id"), "groups")
    who = rows.select("__row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key", "__row").alias("at"))
    first = groups.join(who, "__row").groupBy("component_id").agg(F.min("at").alias("at")).select("at.__row")
    copies = written(groups.select("__row").join(first, "__row", "left_anti"), "copies")
    return rows.join(checked(copies), "__row", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it. Rows count each, also where ids are null or repeat; a null
    source is a source of its own; null and empty texts are never taken; an empty table gives an empty mix."""
    ship(spark)
    return mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of the mix: a row for each piece of each row, also where ids are null or repeat; null and empty texts are pieces of no
    words; an empty table gives none."""
    ship(spark)
    return pack(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("mixing sources", mixed), ("best-fit packing", packed)]
#: The classifier's verdicts are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
            if before is not None:
                discard(before)
            before = docs
    return docs
