"""Joins and folds over time without theta joins: interval, as-of and nearest joins, islands, run merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, bucket_ms: int, key: str = "media_id", pad_ms: int = 0) -> DataFrame:
    """Pairs of left (start_ms, end_ms) and right (r_start, r_end) that overlap: end > start on both sides, after padding.

    Both sides are dealt to the time buckets they touch and joined on (key, bucket); a pair counts in the bucket where it
    begins, so that it comes once. Bucket width about the usual interval keeps copies few.
    """
    deal = lambda s, e: F.explode(F.sequence(F.floor(s / bucket_ms), F.floor(F.greatest(s, e) / bucket_ms)))
    ls, le = F.col("start_ms") - pad_ms, F.col("end_ms") + pad_ms
    a = left.withColumn("__b", deal(ls, le))
    b = right.withColumn("__b", deal(F.col("r_start"), F.col("r_end")))
    hit = (F.col("r_end") > ls) & (F.col("r_start") < le)
    return a.join(b, [key, "__b"]).where(hit & (F.col("__b") == F.floor(F.greatest(ls, F.col("r_start")) / bucket_ms))).drop("__b")


def asof_join(left: DataFrame, right: DataFrame, value: str, at: str = "start_ms", key: str = "media_id", tie: str = "pos", early: bool = False) -> DataFrame:
    """left with the value of the last right row (by at, then tie) that does not begin later: one union, one window. early: rows before
    the first right row get that one's."""
    marks = right.select(key, F.col(at).alias("__t"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.struct(F.col(value).alias("v")).alias("__v"))
    asks = left.select(key, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__tie"), F.lit(None).cast(marks.schema["__v"].dataType).alias("__v"), F.struct(*left.columns).alias("__row"))
    both = marks.withColumn("__row", F.lit(None).cast(asks.schema["__row"].dataType)).unionByName(asks)
    w = Window.partitionBy(key).orderBy("__t", "__side", "__tie")
    found = F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if early:
        found = F.coalesce(found, F.first("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return both.withColumn("__v", found).where("__side = 1").select("__row.*", F.col("__v.v").alias(value))


def owner_join(left: DataFrame, cues: DataFrame, look: int = 8, key: str = "media_id", given: str | None = None) -> DataFrame:
    """left (key, start_ms, end_ms, ...) with owner: of the cue that begins last before it and the look - 1 next ones, whose starts
    are no later than its end, the owner of the longest overlap (ties: the first); where none overlaps, of the cue with the
    nearest start (ties: the first). Rows before the first cue look on from that one. cues: (key, start_ms, end_ms, owner, pos),
    pos numbering them by start. Null where a key has no cues. Each cue carries its followers, so that one as-of join does. Rows
    whose column `given` isn't null have their owner there."""
    order = Window.partitionBy(key).orderBy("start_ms", "pos")
    marks = cues.select(
        key,
        "start_ms",
        "pos",
        F.struct(
            F.collect_list(F.struct("start_ms", "end_ms", "owner")).over(order.rowsBetween(0, look - 1)).alias("ahead"),
            F.col("start_ms").alias("at"),
            F.first("owner").over(Window.partitionBy(key, "start_ms").orderBy("pos")).alias("owner"),
            F.lead(F.struct(F.col("start_ms").alias("at"), "owner")).over(order).alias("next"),
        ).alias("__m"),
    )
    found = asof_join(left, marks, "__m", key=key, early=True)
    shared = lambda c: F.least(F.col("end_ms"), c["end_ms"]) - F.greatest(F.col("start_ms"), c["start_ms"])
    none = F.struct(F.lit(0).cast("long").alias("shared"), F.lit(None).cast("string").alias("owner"))
    best = F.aggregate(F.filter("__m.ahead", lambda c: c["start_ms"] <= F.col("end_ms")), none, lambda a, c: F.when(shared(c) > a["shared"], F.struct(shared(c).alias("shared"), c["owner"].alias("owner"))).otherwise(a))
    later = F.abs(F.col("__m.next.at") - F.col("start_ms")) < F.abs(F.col("__m.at") - F.col("start_ms"))
    near = F.when(later, F.col("__m.next.owner")).otherwise(F.col("__m.owner"))
    looked = F.coalesce(best["owner"], near)
    return found.withColumn("owner", looked if given is None else F.when(F.col(given).isNotNull(), F.col(given)).otherwise(looked)).drop("__m")


def island(change: Column, part: list[str], order: list[str]) -> Column:
    """Number of the run a row is in; change marks the first row of each run."""
    return F.sum(F.when(change, 1).otherwise(0)).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def label_runs(rows: DataFrame, part: list[str], order: list[str], label: str) -> DataFrame:
    """Rows with __run: contiguous equal labels share one."""
    w = Window.partitionBy(*part).orderBy(*order)
    return rows.withColumn("__run", island(F.coalesce(F.col(label) != F.lag(label).over(w), F.lit(True)), part, order))


def own_chunk(words: DataFrame, length_ms: int, overlap_ms: int, key: str = "media_id") -> DataFrame:
    """Words of overlapping chunks (key, chunk, start_ms, end_ms; chunk i begins at i * (length - overlap)), each word once: in the
    chunk whose exclusive part, up to half of each overlap, holds its middle."""
    start = F.col("chunk") * (length_ms - overlap_ms)
    last = F.max("chunk").over(Window.partitionBy(key))
    mid = (F.col("start_ms") + F.col("end_ms")) / 2
    lo = F.when(F.col("chunk") == 0, start).otherwise(start + overlap_ms / 2)
    hi = F.when(F.col("chunk") == F.col("__last"), start + length_ms).otherwise(start + length_ms - overlap_ms / 2)
    return words.withColumn("__last", last).where((mid >= lo) & (mid < hi)).drop("__last")


def assign_labels(words: DataFrame, spans: DataFrame, ids: list[str], bucket_ms: int = 10_000) -> DataFrame:
    """(ids, assigned): for each word the label it overlaps longest (ties: the smaller), else that of the nearest span (ties:
    the earlier). spans (media_id, label, r_start, r_end) don't lie within one another."""
    got = interval_join(words, spans, bucket_ms).groupBy(*ids, "label").agg(F.sum(F.least("end_ms", "r_end") - F.greatest("start_ms", "r_start")).alias("o"))
    got = got.groupBy(*ids).agg(F.min_by("label", F.struct((-F.col("o")).alias("o"), "label")).alias("hit"))
    rest = words.join(got, ids, "left_anti").select(*ids, "start_ms", "end_ms")
    mark = spans.select("media_id", F.struct("r_start", "r_end", "label").alias("s"), F.col("r_start").alias("start_ms"), F.col("r_start").alias("pos"))
    rest = asof_join(rest, mark.withColumnRenamed("s", "before"), "before")
    back = mark.select("media_id", F.col("s").alias("after"), (-F.col("start_ms")).alias("start_ms"), F.col("pos"))
    turned = asof_join(rest.withColumnRenamed("start_ms", "from_ms").withColumn("start_ms", -F.col("from_ms")), back, "after")
    d1, d2 = F.col("from_ms") - F.col("before.r_end"), F.col("after.r_start") - F.col("end_ms")
    near = turned.select(*ids, F.when(F.col("before").isNull() | (d2 < d1), F.col("after.label")).otherwise(F.col("before.label")).alias("hit"))
    return got.unionByName(near).withColumnRenamed("hit", "assigned")
