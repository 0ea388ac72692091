"""Sound, occupancy and names: WAV files of samples, loudest windows, wide tables, names that are alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.operators import bulk, folds
from talkloom.plans import views as V
from talkloom.plans.catalog import ORACLE, W, occupancy_matrix, query
from talkloom.sources import wav

RATE = 16
_PCM = "s as (select user_id as path, row_number() over (partition by user_id order by ts, event_id) - 1 as i, round(value * 60)::bigint as x, count(*) over (partition by user_id) as len from events)"


def recordings(spark, d) -> DataFrame:
    """(path, content): a WAV file of 16 samples a second for each user, of the user's values."""
    e = V.table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.round(F.col("value") * 60).cast("int").alias("x")))), lambda v: v["x"]).alias("a"))
    return e.select("path", wav.rendered(F.col("a"), RATE).alias("content"))


@query(f"with {_PCM} select path::varchar as path, count(*) as samples, round(sqrt(sum((x / 32768.0::double) ** 2) / count(*) + 1e-12), 6) as rms from s where i >= round_even(0.28 * {RATE}, 0) and i < round_even(1.72 * {RATE}, 0) group by 1")
def wav_slice_rms(spark, d):
    """Slices of decoded WAV files from 0.28 s to 1.72 s, and their loudness."""
    p = wav.slices(wav.decode(recordings(spark, d), RATE, piece_s=0.5), 0.28, 1.72)
    sq = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return p.select("path", F.size("samples").cast("long").alias("samples"), F.round(F.sqrt(sq / F.size("samples") + 1e-12), 6).alias("rms"))


#: Windows of 0.75 s (12 samples) at steps of 0.25 s, in three buckets.
_WIN, _HOP, _N = 12, 4, 3


@query(f"""with {_PCM}, r as (select *, sqrt(greatest(0, sum((x / 32768.0::double) ** 2) over (partition by path order by i rows between current row and {_WIN - 1} following)) / {_WIN} + 1e-12) as rms from s),
 n as (select *, greatest(1, least({_N}, len // {_WIN})) as n from r where i + {_WIN} <= len and len > {_WIN}),
 fl as (select path, quantile_cont(rms, 0.2) as quiet from n where i % {max(_HOP, _WIN // 2)} = 0 and i < greatest(1, len - {_WIN}) group by 1),
 b as (select n.*, b, floor(b * (len / {RATE}::double / n) * {RATE})::bigint as lo, least(len - {_WIN}, floor((b + 1) * (len / {RATE}::double / n) * {RATE})::bigint) as hi from n, range({_N}) t(b) where b < n.n),
 best as (select * from b where i between lo and hi and (i - lo) % {_HOP} = 0 and hi > lo qualify row_number() over (partition by path, b order by round(rms, 9) desc, i) = 1),
 g as (select path, b as bucket, i / {RATE}::double as start, round(rms, 6) as rms from best join fl using (path) where rms >= quiet)
 select path::varchar as path, bucket, start, rms from g union all select distinct path::varchar, 0, 0.0, null from s where path not in (select path from g)""")
def wav_loudest_windows(spark, d):
    """The loudest windows of decoded WAV files, across the edges of pieces; start 0 for short files."""
    w = wav.loudest_windows(wav.decode(recordings(spark, d), RATE, piece_s=0.5), _N, _WIN / RATE, _HOP / RATE)
    return w.withColumn("rms", F.round("rms", 6))


@query(f"select media_id, label, {', '.join(f'max(ms) filter (block = {i}) as b{i}' for i in range(10))} from ({ORACLE['occupancy_matrix']}) group by media_id, label")
def occupancy_pivot(spark, d):
    """How long each label is on in each tenth of a recording, side by side; less than a hundredth is left blank."""
    g = occupancy_matrix(spark, d).groupBy("media_id", "label").pivot("block", list(range(10))).agg(F.first("ms"))
    return g.select("media_id", "label", *[F.col(f"`{i}`").alias(f"b{i}") for i in range(10)])


def titles(spark, d) -> DataFrame:
    """(media_id, name, n, first): titles of a recording's frames as names, with how often and when first they come."""
    s = V.shots(spark, d).select("media_id", "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name")).where("name <> ''")
    return s.groupBy("media_id", "name").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


def name_heads(names: DataFrame) -> DataFrame:
    """names (media_id, name, n, first) -> (media_id, name, head): names by count, then by first appearance; each joins the first head whose
    letters are alike. A recording's names are few."""

    def run(key, name, n, first):
        p = sorted(zip(name, n, first, strict=True), key=lambda x: (-x[1], x[2]))
        return [(*key, *x) for x in folds.name_groups([x[:2] for x in p]).items()]

    return bulk.folded(names, ["media_id"], ["first"], ["name", "n", "first"], run, "media_id long, name string, head string")


def canonical(names: DataFrame, heads: DataFrame, evidence: DataFrame) -> DataFrame:
    """(media_id, name, canon): a name becomes its group's head where there is evidence that both are one person (evidence: media_id,
    a, b, same; a pair in either order), else it stays."""
    both = evidence.where("same").select("media_id", F.explode(F.array(F.struct(F.col("a").alias("name"), F.col("b").alias("head")), F.struct(F.col("b").alias("name"), F.col("a").alias("head")))).alias("p")).select("media_id", "p.*").distinct()
    merged = heads.join(both.withColumn("one", F.lit(True)), ["media_id", "name", "head"], "left")
    return merged.select("media_id", "name", F.when(F.col("one"), F.col("head")).otherwise(F.col("name")).alias("canon"))


@query()
def name_variant_groups(spark, d):
    """Names of a recording that are alike, each with the head of its group."""
    return name_heads(titles(spark, d))
