"""Tables of records that partial updates change: a snapshot and the deltas after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deltas(updates: DataFrame, key: str, seq: str, fields: list[str]) -> DataFrame:
    """updates (key, seq, fields; null: unchanged) -> (key, a struct (seq, value) for each field), as snapshots have them."""
    return updates.select(key, *[F.when(F.col(f).isNotNull(), F.struct(F.col(seq).cast("long").alias("seq"), F.col(f).alias("value"))).alias(f) for f in fields])


def compacted(changes: DataFrame, key: str, fields: list[str], upto: int | None = None) -> DataFrame:
    """One row for each key: of each field the change with the largest seq (of equal ones the largest value), up to upto. Rows may come
    in any order and more than once; a snapshot keeps each field's seq, so that older deltas that arrive after it change nothing
    that is newer. changes: deltas(), snapshots, or a union of both. A partial aggregate runs before the shuffle."""
    seen = lambda f: F.col(f) if upto is None else F.when(F.col(f)["seq"] <= upto, F.col(f))
    return changes.groupBy(key).agg(*[F.max(seen(f)).alias(f) for f in fields]).where(F.coalesce(*[F.col(f)["seq"] for f in fields]).isNotNull())


def state(snapshot: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A snapshot's values: (key, fields); null where a field has never been set."""
    return snapshot.select(key, *[F.col(f)["value"].alias(f) for f in fields])


def state_at(updates: DataFrame, key: str, seq: str, fields: list[str], upto: int | None = None) -> DataFrame:
    """Each record as it stands after update upto (all, if None): of every field the last value that isn't null."""
    return state(compacted(deltas(updates, key, seq, fields), key, fields, upto), key, fields)


def write_compacted(spark, path: str, new: DataFrame, key: str, fields: list[str], number: int) -> DataFrame:
    """The snapshot `number`: that of number - 1 with new deltas, written under path; the table of snapshot n is path/n, and a run
    that is repeated writes the same rows again."""
    rows = new
    if number > 0:
        rows = spark.read.parquet(f"{path}/{number - 1}").unionByName(new)
    compacted(rows, key, fields).write.mode("overwrite").parquet(f"{path}/{number}")
    return spark.read.parquet(f"{path}/{number}")
