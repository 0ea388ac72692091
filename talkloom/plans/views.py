"""Conversation-shaped views of the test tables, in Spark and (SQL) in DuckDB. Media time is in whole milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions import text as X
from talkloom.operators import bulk


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def turns(spark, d: str) -> DataFrame:
    """turn(media_id, turn_idx, speaker, text, toks, n, start_ms, end_ms): 400 ms a word, 300 ms between turns."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("turn_idx"), F.col("role").alias("speaker"), "text")
    t = bulk.dealt(t, "media_id").withColumn("toks", X.split_words(F.col("text"))).withColumn("n", F.size("toks").cast("long"))
    w = Window.partitionBy("media_id").orderBy("turn_idx").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("start_ms", F.coalesce(F.sum(F.col("n") * 400 + 300).over(w), F.lit(0)))
    return t.withColumn("end_ms", F.col("start_ms") + F.col("n") * 400)


def words(spark, d: str) -> DataFrame:
    t = turns(spark, d)
    w = t.select("media_id", "turn_idx", "speaker", "start_ms", F.posexplode("toks").alias("k", "word"))
    return w.select("media_id", "turn_idx", "speaker", F.col("k").cast("long").alias("k"), "word", (F.col("start_ms") + 400 * F.col("k")).alias("start_ms"), (F.col("start_ms") + 400 * F.col("k") + 400).alias("end_ms"))


def cues(spark, d: str) -> DataFrame:
    """An imperfect second reading of the words: some dropped, some reversed, 150 ms late, some turns with a wrong owner."""
    t = turns(spark, d).select("media_id", "turn_idx", F.lead("speaker").over(Window.partitionBy("media_id").orderBy("turn_idx")).alias("next"))
    w = words(spark, d).join(t, ["media_id", "turn_idx"]).where("(media_id + 3 * turn_idx + k) % 11 <> 0")
    owner = F.when((F.col("media_id") + F.col("turn_idx")) % 6 == 0, F.coalesce("next", "speaker")).otherwise(F.col("speaker"))
    word = F.when((5 * F.col("media_id") + F.col("turn_idx") + 7 * F.col("k")) % 17 == 0, F.reverse("word")).otherwise(F.col("word"))
    return w.select("media_id", "turn_idx", "k", word.alias("word"), owner.alias("owner"), (F.col("start_ms") + 150).alias("start_ms"), (F.col("end_ms") + 150).alias("end_ms"))


def readings(spark, d: str) -> DataFrame:
    """Turns with what cues() has of them: the word at each place (cued; null if dropped), and the owner. One pass; no word is a row."""
    w = Window.partitionBy("media_id").orderBy("turn_idx")
    at = lambda m, t, k, i: F.col("media_id") * m + F.col("turn_idx") * t + k * i
    cued = F.transform("toks", lambda x, i: F.when(at(1, 3, 1, i) % 11 != 0, F.when(at(5, 1, 7, i) % 17 == 0, F.reverse(x)).otherwise(x)))
    t = turns(spark, d).withColumn("cued", cued).withColumn("next", F.lead("speaker").over(w))  # the window keeps cued from being made anew for each word
    owner = F.when((F.col("media_id") + F.col("turn_idx")) % 6 == 0, F.coalesce("next", "speaker")).otherwise(F.col("speaker"))
    return t.withColumn("owner", owner).drop("next")


def lines(spark, d: str) -> DataFrame:
    """The other transcript's cues: one for each turn, some reaching into the next, some ending early."""
    g = cues(spark, d).groupBy("media_id", "turn_idx", "owner").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("last"))
    g = g.withColumn("end_ms", F.col("last") + F.when(F.col("turn_idx") % 3 == 0, 900).otherwise(-300)).drop("last")
    return g.withColumn("pos", F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "turn_idx")).cast("long"))


def flips(spark, d: str) -> DataFrame:
    """Words with injected label flips."""
    on = F.expr("(k + media_id) % 17 in (0, 1) or (k + media_id) % 29 between 3 and 8")
    return words(spark, d).withColumn("label", F.when(on, F.when(F.col("speaker") == "user", "assistant").otherwise("user")).otherwise(F.col("speaker")))


def segments(spark, d: str) -> DataFrame:
    """Lines of documents, 16 documents a recording: seg(media_id, doc_id, seg_idx, language, text, start_ms, end_ms)."""
    s = table(spark, d, "documents").select(F.expr("doc_id div 16").alias("media_id"), "doc_id", F.col("lang").alias("language"), F.posexplode(F.split("text", "\n")).alias("seg_idx", "text"))
    return s.select("media_id", "doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), "language", "text", (F.col("seg_idx") * 2000).cast("long").alias("start_ms"), (F.col("seg_idx") * 2000 + 1800).cast("long").alias("end_ms"))


def occurrences(spark, d: str) -> DataFrame:
    """Events as intervals, a recording for each user: occ(media_id, event_id, label, start_ms, end_ms, pos)."""
    e = table(spark, d, "events").select(F.col("user_id").alias("media_id"), "event_id", F.col("event_type").alias("label"), F.unix_millis(F.col("ts").cast("timestamp")).alias("start_ms"), F.floor(F.col("value") * 360000).cast("long").alias("dur"))
    e = e.withColumn("end_ms", F.col("start_ms") + F.col("dur"))
    return e.withColumn("pos", F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "event_id")).cast("long")).drop("dur")


def shots(spark, d: str, **of) -> DataFrame:
    """Frames: 25 pages, 12 s apart, are those of one recording, within its length: shot(page_id, media_id, t, html); or, in place of html,
    columns made of it before pages are dealt out."""
    t = turns(spark, d).groupBy("media_id").agg(F.max("end_ms").alias("len"))
    n = t.agg((F.max("media_id") + 1).alias("n"))
    of = of or {"html": F.col("html")}
    p = table(spark, d, "pages").select("page_id", *[c.alias(k) for k, c in of.items()]).crossJoin(F.broadcast(n)).withColumn("media_id", F.expr("page_id div 25 % n"))
    return p.join(t, "media_id").select("page_id", "media_id", F.expr("page_id % 25 * 12000 % (len + 12000)").alias("t"), *of)


#: Other readings of a word c, in Spark's and DuckDB's SQL alike: as recognised (a0), another transcript's (b), and as corrected
#: with its help (a1).
_A0 = "case when (media_id + 3 * turn_idx + k) % 11 = 0 then null when (5 * media_id + turn_idx + 7 * k) % 17 = 0 then reverse(c) when (media_id + turn_idx + k) % 13 = 0 then concat(c, 's') when (media_id + k) % 29 = 0 then concat('zz', c) else c end"
_B = "case when (media_id + turn_idx + 2 * k) % 13 = 0 then null when (media_id + k) % 19 = 0 then reverse(c) when (media_id + 2 * turn_idx + k) % 23 = 0 then concat(c, 's') else c end"
_A1 = "case when a0 is null then null when (media_id + 2 * turn_idx + 3 * k) % 6 = 0 then coalesce(b, a0) when (media_id + turn_idx + 5 * k) % 31 = 0 then concat('qq', c) else a0 end"


def columns(spark, d: str) -> DataFrame:
    """Positional lattice of readings of each word: c (pivot), a0, a1, b; a is a1."""
    x = words(spark, d).select("media_id", "turn_idx", "k", F.col("start_ms").alias("t"), F.lower("word").alias("c"))
    return x.withColumns({"a0": F.expr(_A0), "b": F.expr(_B)}).withColumn("a1", F.expr(_A1)).withColumn("a", F.col("a1"))


TURN = r"""turn_v as (select *, start_ms + n * 400 as end_ms from (select *, coalesce(sum(n * 400 + 300) over (partition by media_id order by turn_idx rows between unbounded preceding and 1 preceding), 0)::bigint as start_ms
 from (select *, len(toks)::bigint as n from (select conv_id as media_id, turn as turn_idx, role as speaker, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as toks from conversations))))"""
WORD = TURN + """, word_v as (select media_id, turn_idx, speaker, k, word, start_ms + 400 * k as start_ms, start_ms + 400 * k + 400 as end_ms from (select media_id, turn_idx, speaker, start_ms, unnest(range(n)) as k, unnest(toks) as word from turn_v))"""
CUE = WORD + """, cue_v as (select media_id, turn_idx, k, case when (5 * media_id + turn_idx + 7 * k) % 17 = 0 then reverse(word) else word end as word,
 case when (media_id + turn_idx) % 6 = 0 then coalesce(nxt, speaker) else speaker end as owner, start_ms + 150 as start_ms, end_ms + 150 as end_ms
 from word_v join (select media_id, turn_idx, lead(speaker) over (partition by media_id order by turn_idx) as nxt from turn_v) using (media_id, turn_idx) where (media_id + 3 * turn_idx + k) % 11 <> 0)"""
LINE = CUE + """, line_v as (select *, row_number() over (partition by media_id order by start_ms, turn_idx) as pos from (select media_id, turn_idx, owner, min(start_ms) as start_ms, max(end_ms) + case when turn_idx % 3 = 0 then 900 else -300 end as end_ms from cue_v group by media_id, turn_idx, owner))"""
FLIP = WORD + """, flip_v as (select *, case when (k + media_id) % 17 in (0, 1) or (k + media_id) % 29 between 3 and 8 then case when speaker = 'user' then 'assistant' else 'user' end else speaker end as label from word_v)"""
SEG = """seg_v as (select doc_id // 16 as media_id, doc_id, lang as language, seg_idx, line as text, seg_idx * 2000 as start_ms, seg_idx * 2000 + 1800 as end_ms
 from (select doc_id, lang, unnest(range(len(string_split(text, chr(10))))) as seg_idx, unnest(string_split(text, chr(10))) as line from documents))"""
OCC = """occ_v as (select *, row_number() over (partition by media_id order by start_ms, event_id) as pos from (select user_id as media_id, event_id, event_type as label, (epoch_us(ts) // 1000)::bigint as start_ms,
 (epoch_us(ts) // 1000)::bigint + floor(value * 360000)::bigint as end_ms from events))"""
COLUMNS = WORD + f""", col_v as (select *, a1 as a from (select *, {_A1} as a1 from (select *, {_A0} as a0, {_B} as b from (select media_id, turn_idx, k, start_ms as t, lower(word) as c from word_v))))"""
SHOT = TURN + """, shot_v as (select page_id, media_id, page_id % 25 * 12000 % (len + 12000) as t, html from (select *, page_id // 25 % (select max(conv_id) + 1 from conversations) as m from pages) p join (select media_id, max(end_ms)::bigint as len from turn_v group by 1) on media_id = m)"""
