"""Names of one person in several spellings: evidence from how their cues lie to each other, and cues under canonical names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.operators import temporal as T

# fixed values: below this rate of alternation, or above this share of simultaneous speech, two names are one person
ALTERNATION, SIMULTANEOUS = 0.15, 0.5


def counted(cues: DataFrame) -> DataFrame:
    """cues (media_id, name, start_ms, pos) -> (media_id, name, n, first): how often a name comes and where first; blank names don't count."""
    g = cues.where("name <> ''").groupBy("media_id", "name").agg(F.count("*").alias("n"), F.min(F.struct("start_ms", "pos")).alias("at"))
    return g.select("media_id", "name", "n", F.row_number().over(Window.partitionBy("media_id").orderBy("at")).cast("long").alias("first"))


def evidence(cues: DataFrame, pairs: DataFrame, bucket_ms: int = 600_000) -> DataFrame:
    """cues (media_id, name, start_ms, end_ms, pos), pairs (media_id, a, b) -> pairs with alternation, overlap and same. Alternation: swaps
    in the sequence of the two names' cues alone, of the smaller number of cues (at equal starts a's come first). Overlap: time that
    both speak, of the smaller time (0 where one has none). same: hardly any alternation, or much overlap. A pair both of whose
    names don't have cues has no row."""
    x = cues.join(pairs.select("media_id", "a", "b").distinct(), "media_id").where("name = a or name = b").withColumn("pair", F.struct("media_id", "a", "b"))
    mine = F.col("name") == F.col("a")
    swap = F.col("name") != F.lag("name").over(Window.partitionBy("pair").orderBy("start_ms", F.desc(mine), "pos"))
    span = F.col("end_ms") - F.col("start_ms")
    g = x.withColumn("swap", swap).groupBy("pair").agg(
        F.count_if("swap").alias("swaps"), F.count_if(mine).alias("na"), F.count_if(~mine).alias("nb"), F.sum(F.when(mine, span)).alias("air_a"), F.sum(F.when(~mine, span)).alias("air_b")
    )
    both = T.interval_join(x.where(mine).select("pair", "start_ms", "end_ms"), x.where(~mine).select("pair", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end")), bucket_ms, key="pair")
    both = both.groupBy("pair").agg(F.sum(F.least("end_ms", "r_end") - F.greatest("start_ms", "r_start")).alias("shared"))
    g = g.where("na > 0 and nb > 0").join(both, "pair", "left")
    air = F.least("air_a", "air_b")
    alternation, overlap = F.col("swaps") / F.least("na", "nb"), F.when(air > 0, F.coalesce("shared", F.lit(0)) / air).otherwise(0.0)
    return g.select("pair.*", alternation.alias("alternation"), overlap.alias("overlap")).withColumn("same", (F.col("alternation") < ALTERNATION) | (F.col("overlap") > SIMULTANEOUS))


def renamed(cues: DataFrame, canon: DataFrame) -> DataFrame:
    """cues with canon, their name's canonical one (canon: media_id, name, canon); a name without one, also none at all, stays."""
    return cues.join(canon, ["media_id", "name"], "left").withColumn("canon", F.coalesce("canon", "name"))
