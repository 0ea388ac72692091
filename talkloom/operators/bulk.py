"""Folds of many small groups: each group is a row with its rows as a list, and many come in one Arrow batch."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by keys over as many tasks as there is room for: adaptive execution goes by bytes, and puts few bytes of much work in one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)


def listed(order: list[str], columns: list[str]):
    """Aggregate: a group's columns as structs, in order."""
    return F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))


def unlisted(column: pa.ListArray) -> tuple[list[int], dict[str, list]]:
    """Where each row's structs begin and end in the lists of all rows' fields; null lists are empty."""
    ends = [0]
    for n in column.value_lengths().to_pylist():
        ends.append(ends[-1] + (n or 0))
    flat = column.flatten()
    return ends, {f.name: flat.field(i).to_pylist() for i, f in enumerate(flat.type)}


def mapped(rows: DataFrame, run, schema: str) -> DataFrame:
    """run(batch) -> columns of schema, for each Arrow batch."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def each(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(run(batch), kinds.types, strict=True)], schema=kinds)

    return rows.mapInArrow(each, schema)


def folded(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], run, schema: str) -> DataFrame:
    """run(key, lists of a group's columns in order) -> rows of schema, for each group of keys. A group is what one row holds."""

    def each(batch):
        keyed = [batch.column(k).to_pylist() for k in keys]
        ends, x = unlisted(batch.column("rows"))
        out = [r for i, key in enumerate(zip(*keyed, strict=True)) for r in run(key, *[x[c][ends[i] : ends[i + 1]] for c in columns])]
        return list(zip(*out, strict=True)) if out else [[]] * width

    width = len(StructType.fromDDL(schema))
    return mapped(dealt(rows.select(*dict.fromkeys([*keys, *order, *columns])), *keys).groupBy(*keys).agg(listed(order, columns).alias("rows")), each, schema)
