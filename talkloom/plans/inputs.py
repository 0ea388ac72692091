"""Scans and parsers over documents of other tools, which are made of the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkloom.functions import text as X
from talkloom.plans import views as V
from talkloom.plans.catalog import W, query
from talkloom.sources import scans

# fixed values: languages that are easily taken for one another
CONFUSABLE = [("cs", "sk"), ("hr", "sr", "bs", "sl"), ("da", "no", "nn", "sv"), ("ru", "uk", "be"), ("es", "gl", "pt"), ("id", "ms")]
_GROUPS = ", ".join(f"({i}, '{x}')" for i, g in enumerate(CONFUSABLE) for x in g)
#: Languages that stand for the documents' own, so that some are confusable.
_AS = "case lang when 'en' then 'da' when 'de' then 'cs' when 'fr' then 'sk' when 'es' then 'no' else lang end"


@query(f"""with l as (select source, {_AS} as language, sum(n_chars)::bigint as c from documents group by all), s as (select *, c::double / sum(c) over (partition by source) as share from l),
 g as (select source, grp, string_agg(distinct s.language, ', ' order by s.language) as note, count(*) as n from s join (values {_GROUPS}) t(grp, language) using (language) where share >= 0.05 group by all) select source, note from g where n > 1""")
def confusable_notes(spark, d):
    """Languages of a source's documents, with a twentieth of it or more, that are easily taken for one another."""
    s = V.table(spark, d, "documents").groupBy("source", F.expr(_AS).alias("language")).agg(F.sum("n_chars").alias("c"))
    s = s.withColumn("share", F.col("c") / F.sum("c").over(W("source"))).where("share >= 0.05")
    groups = spark.createDataFrame([(i, x) for i, g in enumerate(CONFUSABLE) for x in g], "grp int, language string")
    g = s.join(F.broadcast(groups), "language").groupBy("source", "grp").agg(F.array_join(F.sort_array(F.collect_set("language")), ", ").alias("note"), F.count("*").alias("n"))
    return g.where("n > 1").select("source", "note")


def parse_reply(replies, key: str):
    """replies (key, reply, n) -> (key, id, text): [i] lines of a reply; ids beyond n are dropped, the last of an id wins, leaked labels go."""
    lines = replies.select(key, "n", F.posexplode(F.split("reply", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"^\s*\[\d+\]"))
    part = lambda i: F.regexp_extract("line", r"^\s*\[(\d+)\]\s*(.*)$", i)
    p = lines.select(key, "n", "pos", part(1).cast("long").alias("id"), X.strip_label(part(2)).alias("text"))
    return p.where("id between 1 and n").groupBy(key, "id").agg(F.max_by("text", "pos").alias("text"))


@query(f"with {V.TURN} select media_id, turn_idx + 1 as id, array_to_string(toks[1:6], ' ') as text from turn_v")
def numbered_reply_parse(spark, d):
    """Replies to a conversation's numbered lines: labels leak, some ids come twice or are out of range, some lines are noise."""
    t = V.turns(spark, d).withColumn("words", F.array_join(F.slice("toks", 1, 6), " "))
    tag = F.concat(F.lit("["), (F.col("turn_idx") + 1).cast("string"), F.lit("] "))
    label = F.when(F.col("turn_idx") % 2 == 0, "A: ").otherwise(" B : ")
    before = F.when(F.col("turn_idx") % 3 == 1, F.concat(tag, F.lit("first try\n"))).when(F.col("turn_idx") % 3 == 2, F.lit("noise [1] inside\n")).otherwise("")
    g = t.groupBy("media_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("turn_idx", F.concat(before, tag, label, "words").alias("line")))).alias("x"))
    reply = F.concat(F.array_join(F.transform("x", lambda v: v["line"]), "\n"), F.lit("\n[9999] out of range"))
    return parse_reply(g.select("media_id", "n", reply.alias("reply")), "media_id")


_CHAIN = "substr(sha256({0} || '{{\"stage\":\"{1}\",\"beam\":' || {2} || '}}'), 1, 16)"
_CHAINED = (("asr", "user_id % 7"), ("align", "user_id % 3"), ("llm", "user_id % 5"))


@query(f"""with u as (select distinct user_id from events), a as (select *, {_CHAIN.format("''", *_CHAINED[0])} as f1 from u), b as (select *, {_CHAIN.format('f1', *_CHAINED[1])} as f2 from a), c as (select *, {_CHAIN.format('f2', *_CHAINED[2])} as f3 from b)
 select user_id, 1 as pos, 'asr' as stage, f1 as fp from c union all select user_id, 2, 'align', f2 from c union all select user_id, 3, 'llm', f3 from c""")
def stage_fingerprint_chain(spark, d):
    """Each stage's fingerprint covers its settings and the stage before: a run for each user, with settings of its own."""
    u = V.table(spark, d, "events").select("user_id").distinct()
    before, out = F.lit(""), []
    for i, (stage, beam) in enumerate(_CHAINED):
        own = F.to_json(F.struct(F.lit(stage).alias("stage"), F.expr(beam).alias("beam")))
        before = F.substring(F.sha2(F.concat(before, own), 256), 1, 16)
        out.append(F.struct(F.lit(i + 1).alias("pos"), F.lit(stage).alias("stage"), before.alias("fp")))
    return u.select("user_id", F.inline(F.array(*out)))


def subwords_to_words(tokens, key: list[str]):
    """tokens (key, pos, text, start_ms, end_ms, conf) -> (key, i, word, t_ms, conf): tokens without a letter go; a token with a blank before
    it begins a word; a word's time is the middle of its tokens', its confidence their least."""
    letters = tokens.where(F.col("text").rlike(r"\p{L}")).withColumn("i", F.sum(F.col("text").startswith(" ").cast("long")).over(Window.partitionBy(*key).orderBy("pos")))
    g = letters.groupBy(*key, "i").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("x"), F.floor((F.min("start_ms") + F.max("end_ms")) / 2).alias("t_ms"), F.min("conf").alias("conf"))
    return g.select(*key, "i", F.lower(F.trim(F.array_join(F.transform("x", lambda v: v["text"]), ""))).alias("word"), "t_ms", "conf")


@query(f"""with {V.WORD}, h as (select *, (length(word) + 1) // 2 as cut from word_v), t as (select media_id, turn_idx, 2 * k as pos, ' ' || substr(word, 1, cut) as text, start_ms, start_ms + 150 as end_ms, (k % 7) / 10.0::double as conf from h
  union all select media_id, turn_idx, 2 * k + 1, substr(word, cut + 1), start_ms + 150, end_ms, (k % 5) / 10.0::double from h where length(word) > 1),
 l as (select *, sum(starts_with(text, ' ')::int) over (partition by media_id, turn_idx order by pos)::bigint as i from t where regexp_matches(text, '\\p{{L}}'))
 select media_id, turn_idx, i, lower(trim(string_agg(text, '' order by pos), ' ')) as word, ((min(start_ms) + max(end_ms)) // 2)::bigint as t_ms, min(conf) as conf from l group by media_id, turn_idx, i""")
def subword_token_scan(spark, d):
    """Words of their halves as recognisers give them."""
    w = V.words(spark, d).withColumn("cut", F.floor((F.length("word") + 1) / 2).cast("int"))
    row = lambda pos, text, s, e, conf: F.struct(pos.alias("pos"), text.alias("text"), s.alias("start_ms"), e.alias("end_ms"), conf.alias("conf"))
    k, s = F.col("k"), F.col("start_ms")
    both = F.array(row(2 * k, F.concat(F.lit(" "), F.substr("word", F.lit(1), "cut")), s, s + 150, (k % 7) / 10), row(2 * k + 1, F.substr("word", F.col("cut") + 1), s + 150, F.col("end_ms"), (k % 5) / 10))
    return subwords_to_words(w.select("media_id", "turn_idx", F.inline(both)).where("text <> ''"), ["media_id", "turn_idx"])


_PROBED = """select c_custkey as id, case when c_custkey % 4 <> 0 then c_acctbal end as whole, c_custkey % 5 <> 0 as sound, 8000 * (1 + c_custkey % 6) as rate, 1 + c_custkey % 2 as ch, case c_custkey % 3 when 0 then 'mjpeg' when 1 then 'h264' end as pic, c_custkey % 7 = 0 as attached from customer"""


@query(f"""with p as ({_PROBED}) select id::varchar as media_id, coalesce(round(whole, 2), 2.5)::double as duration, 'aac' as codec, rate::integer as sample_rate, ch::integer as channels, coalesce(pic = 'h264' and not attached, false) as has_video,
 case when pic = 'h264' and not attached then 'h264' end as video_codec, case when pic = 'h264' and not attached then 1920 end as width, case when pic = 'h264' and not attached then 1080 end as height from p where sound""")
def media_probe(spark, d):
    """Probe documents, one for each customer: cover art and attached pictures are no video; a file without sound has no row."""
    c = V.table(spark, d, "customer").selectExpr("*", "c_custkey as k")
    video = F.when(F.col("k") % 3 == 2, F.lit(None)).otherwise(F.struct(F.lit("video").alias("codec_type"), F.when(F.col("k") % 3 == 0, "mjpeg").otherwise("h264").alias("codec_name"), F.lit(None).cast("string").alias("sample_rate"), F.lit(None).cast("int").alias("channels"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.lit(None).cast("string").alias("duration"), F.struct((F.col("k") % 7 == 0).cast("int").alias("attached_pic")).alias("disposition")))
    audio = F.when(F.col("k") % 5 != 0, F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), (8000 * (1 + F.col("k") % 6)).cast("string").alias("sample_rate"), (1 + F.col("k") % 2).cast("int").alias("channels"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit("2.5").alias("duration"), F.lit(None).cast("struct<attached_pic: int>").alias("disposition")))
    whole = F.when(F.col("k") % 4 != 0, F.round("c_acctbal", 2).cast("string"))
    doc = F.to_json(F.struct(F.filter(F.array(video, audio), lambda s: s.isNotNull()).alias("streams"), F.struct(whole.alias("duration")).alias("format")))
    return scans.media_probe(c.select(F.col("k").cast("string").alias("media_id"), doc.alias("value")))


@query(f"""with {V.SHOT}, s as (select media_id, page_id, t, row_number() over (partition by media_id order by page_id) - 1 as frame, count(*) over (partition by media_id) as n from shot_v)
 select media_id, frame, printf('%05d.jpg', frame + 1) as path, t + media_id % 3 * 1000 as t_ms from s where frame < n - (media_id % 2)""")
def frame_log_scan(spark, d):
    """Frame logs of recordings: times in the order of the log go to the sorted files; the last frame of some has no file."""
    s = V.shots(spark, d).select("media_id", "page_id", "t", (F.row_number().over(W("media_id", "page_id")) - 1).alias("frame"))
    line = F.format_string("n:%d pts_time:%s%d.%03d x", "frame", F.when(F.col("frame") % 2 == 0, "").otherwise(" "), F.floor(F.col("t") / 1000), F.col("t") % 1000)
    g = s.groupBy("media_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("frame", line.alias("line")))), lambda x: x["line"]), "\n").alias("value"))
    many = F.col("n") - F.col("media_id") % 2
    files = F.when(many > 0, F.reverse(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(many, F.lit(1))), lambda i: F.format_string("%05d.jpg", i)))).otherwise(F.array().cast("array<string>"))
    return scans.frame_times(g.select("media_id", "value", files.alias("files"), (F.col("media_id") % 3 * 1000).alias("start_ms")))


# fixed values: stages of a run and their shares of it
STAGES = [("preprocess", 0.04), ("langid", 0.05), ("asr", 0.32), ("speakers", 0.19), ("screen", 0.12), ("llm", 0.16), ("align", 0.09), ("export", 0.03)]


def progress(stage: str, part) -> F.Column:
    """A run's progress at part (0 to 1) of a stage; unknown stages have none done before them."""
    done, out = 0.0, F.least(F.lit(1.0), part * 0.0)
    rows = []
    for name, weight in STAGES:
        rows.append((name, done, weight))
        done += weight
    at = F.lit(None)
    for name, before, weight in rows:
        at = F.when(F.col(stage) == name, F.lit(before) + F.lit(weight) * part).otherwise(at)
    return F.coalesce(F.least(F.lit(1.0), at), out)


@query("with s as (select * from (values " + ", ".join(f"({i}, '{n}', {w}::double, {sum(x for _, x in STAGES[:i])}::double)" for i, (n, w) in enumerate(STAGES)) + ") as t(pos, stage, weight, before)) select event_id, stage, round(least(1, before + weight * (event_id % 101 / 100.0::double)), 6) as progress from events join s on pos = event_id % 8")
def stage_progress(spark, d):
    """Progress of runs, a report for each event."""
    names = F.array(*[F.lit(n) for n, _ in STAGES])
    e = V.table(spark, d, "events").select("event_id", F.get(names, (F.col("event_id") % 8).cast("int")).alias("stage"))
    return e.withColumn("progress", F.round(progress("stage", F.col("event_id") % 101 / 100), 6))
