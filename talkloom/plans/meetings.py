"""Whole recordings: cues under canonical names, prompts by windows with terms on screen, agreement of all artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.functions import text as X
from talkloom.operators import names as N
from talkloom.operators import similar
from talkloom.plans import views as V
from talkloom.plans.catalog import W, framed, furniture, greedy_windows, query
from talkloom.plans.exports import markdown, named, prompt
from talkloom.plans.owners import aligned_quote
from talkloom.plans.speech import canonical, name_heads
from talkloom.sources import scans, vtt

#: Spellings: one that changes in the middle of a recording, two that take turns, two that speak at once, and another person.
_SPELT = """case when label = 'click' and 2 * pos <= n then 'Jan Novak' when label = 'click' then 'Jan Novák' when label = 'view' and media_id % 2 = 0 and pos % 2 = 0 then 'Petra Malá' when label = 'view' then 'Petra Mala'
 when label = 'purchase' and pos % 5 = 0 then '' when pos % 3 = 0 then 'Eva Dlouha' else 'Eva Dlouhá' end"""
_LONG = "case when label in ('click', 'view') or media_id % 3 > 0 then end_ms else end_ms + 86400000 end"
_ALIKE = [("Jan Novak", "Jan Novák"), ("Petra Mala", "Petra Malá"), ("Eva Dlouha", "Eva Dlouhá")]


def spelt(spark, d) -> DataFrame:
    """Cues of speakers whose names come in several spellings, some of them blank."""
    o = V.occurrences(spark, d).withColumn("n", F.count("*").over(W("media_id")))
    return o.select("media_id", "pos", F.expr(_SPELT).alias("name"), "start_ms", F.expr(_LONG).cast("long").alias("end_ms"))


@query(f"""with {V.OCC}, nm as (select media_id, pos, start_ms, {_LONG}::bigint as end_ms, {_SPELT} as name from (select *, count(*) over (partition by media_id) as n from occ_v)),
 n as (select media_id, name, count(*) as n, sum(end_ms - start_ms) as air, min(pos) as first from nm where name <> '' group by all), alike(p, q) as (values {', '.join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in _ALIKE)}),
 pr as (select x.media_id, x.name as a, y.name as b, least(x.n, y.n) as n, least(x.air, y.air) as air from n x join n y on x.media_id = y.media_id join alike on x.name = p and y.name = q where x.n > y.n or (x.n = y.n and x.first < y.first)),
 sw as (select media_id, a, b, count(*) filter (c) as swaps from (select pr.media_id, a, b, name <> lag(name) over (partition by pr.media_id, a, b order by start_ms, name <> a, pos) as c from nm join pr on nm.media_id = pr.media_id and name in (a, b)) group by all),
 ov as (select pr.media_id, a, b, sum(least(x.end_ms, y.end_ms) - greatest(x.start_ms, y.start_ms)) as shared from pr join nm x on x.media_id = pr.media_id and x.name = a join nm y on y.media_id = pr.media_id and y.name = b and y.end_ms > x.start_ms and y.start_ms < x.end_ms group by all),
 mg as (select media_id, a, b from pr join sw using (media_id, a, b) left join ov using (media_id, a, b) where swaps::double / n < 0.15 or (air > 0 and coalesce(shared, 0)::double / air > 0.5))
 select nm.media_id, pos, name, coalesce(a, name) as canon from nm left join mg on mg.media_id = nm.media_id and mg.b = name""")
def canonical_cues(spark, d):
    """Cues with the canonical names of their speakers: spellings alike are one person only where the conversation shows it."""
    cues = spelt(spark, d)
    names = N.counted(cues)
    heads = name_heads(names)
    pairs = heads.where("name <> head").select("media_id", F.col("head").alias("a"), F.col("name").alias("b"))
    return N.renamed(cues, canonical(names, heads, N.evidence(cues, pairs))).select("media_id", "pos", "name", "canon")


def shown(spark, d) -> DataFrame:
    """(media_id, page_id, t, terms): frames with their terms; every third frame also shows two words of a turn in another spelling."""
    two = F.filter(F.array(*[F.struct(F.get("toks", F.lit(k)).alias("word"), F.floor((F.col("start_ms") + 400 * k) / 12000).alias("slot")) for k in (2, 5)]), lambda x: F.length(x["word"]) >= 5)
    said = V.turns(spark, d).groupBy("media_id").agg(F.flatten(F.collect_list(two)).alias("said"))
    s = framed(spark, d).join(said, "media_id").select("media_id", "said", F.inline("frames"))
    near = F.filter("said", lambda x: (F.col("page_id") % 3 < 2) & (F.abs(x["slot"] - F.floor(F.col("t") / 12000)) <= 1))
    near = F.transform(near, lambda x: F.concat(F.initcap(F.regexp_replace(x["word"], r"[^\p{L}]", "")), F.lit("q")))
    terms = F.concat(F.coalesce(X.screen_tokens(F.col("shown")), F.array().cast("array<string>")), near)
    return s.groupBy("media_id", "page_id", "t").agg(F.array_distinct(F.flatten(F.collect_list(terms))).alias("terms"))


def on_screen(spark, d) -> DataFrame:
    """(media_id, page_id, t, term): terms of frames."""
    return shown(spark, d).select("media_id", "page_id", "t", F.explode("terms").alias("term"))


def prompts(turns: DataFrame, quotes: DataFrame, frames: DataFrame, chrome: DataFrame) -> DataFrame:
    """(media_id, win, prompt): turns (media_id, turn_idx, text, start_ms, end_ms) in windows of 90 s that split none, each with the other
    transcript's reading (quotes: media_id, turn_idx, theirs), under the terms on screen (frames: media_id, t, terms) near the window that
    may correct its words."""
    t = turns.join(greedy_windows(turns.select("media_id", "turn_idx", "start_ms", "end_ms")), ["media_id", "turn_idx"]).join(quotes, ["media_id", "turn_idx"], "left")
    own = t.groupBy("media_id", "win").agg(F.sort_array(F.collect_list(F.struct("turn_idx", "start_ms", "end_ms", "text", "theirs"))).alias("x"))
    windows = own.select("media_id", "win", F.col("x")[0]["start_ms"].alias("start_ms"), F.element_at("x", -1)["end_ms"].alias("end_ms"), F.transform("x", lambda v: v["text"]).alias("texts"))
    terms = similar.window_terms(frames, windows, chrome)
    terms = terms.groupBy("media_id", "win").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    line = lambda v, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] A: "), F.coalesce(v["text"], F.lit("")), F.lit("\n    B: "), F.coalesce(F.nullif(v["theirs"], F.lit("")), F.lit("(none)")))
    p = own.join(terms, ["media_id", "win"], "left")
    return p.select("media_id", "win", prompt(F.size("x").cast("string"), F.array_join(F.transform("x", line), "\n"), F.coalesce("terms", F.array().cast("array<string>"))).alias("prompt"))


@query()
def window_prompts(spark, d):
    """Whole prompts of a run: windows of 90 s, both readings of each line, and terms on screen that may correct them."""
    quotes = aligned_quote(spark, d).select("media_id", "turn_idx", F.col("text").alias("theirs"))
    f = framed(spark, d).where("size(frames) >= 10").select("media_id", F.size("frames").alias("frames"), F.inline("frames"))
    f = f.withColumn("terms", F.array_distinct(F.transform(X.screen_tokens(F.col("shown")), F.lower)))
    chrome = furniture(f).select("media_id", F.col("term").alias("low"))
    return prompts(V.turns(spark, d).select("media_id", "turn_idx", "text", "start_ms", "end_ms"), quotes, shown(spark, d), chrome)


#: Lengths: the last turn of every tenth recording ends 3 s beyond what was transcribed; of every third more was recorded than that.
_USED = "greatest(len - case when media_id % 10 = 4 then 3000 else 0 end, 0)"
_FULL = "case when media_id % 3 = 0 then 5000 else 0 end"


def bundles(spark, d):
    """Turns, artifacts and files of recordings in which faults are planted, by the recording's number."""
    t = V.turns(spark, d).withColumns({"text": F.when(F.col("media_id") % 2 == 0, F.translate("text", "aeu", "áěů")).otherwise(F.col("text")), "language": F.lit("cs")})
    size = t.groupBy("media_id").agg(F.max_by("end_ms", "turn_idx").alias("len")).select("media_id", F.expr(_USED).alias("used_ms")).withColumn("full_ms", F.col("used_ms") + F.expr(_FULL))
    wrong = X.clock(F.col("full_ms"))
    said = F.when(F.col("media_id") % 6 == 3, wrong).otherwise(X.duration_line(F.col("full_ms"), F.col("used_ms"), F.lit(0)))
    heads = size.select("media_id", F.concat(F.lit("# recording\n\n- **Duration:** "), said, F.lit("\n\n---\n\n")).alias("head"))
    none = spark.createDataFrame([], "media_id long, t long, caption string")
    md = markdown(t, heads, none).withColumnRenamed("value", "md")
    names = t.withColumn("speaker", named(F.col("speaker")))
    caps = vtt.render(names.select("media_id", "turn_idx", "speaker", "text", "start_ms", "end_ms")).withColumnRenamed("value", "vtt")
    plain = lambda c: F.translate(c, scans.ACCENTS, "escrzyaieuuntdoESCRZYAIEUUNTDO")
    for rest, damage in ((7, lambda c: F.regexp_replace(c, r"^(?s)(.*?)\n## \[", "$1\n# [")), (8, lambda c: F.regexp_replace(c, r"(?m)^(#+ \[[0-9:]+\] )Ota", "$1O.")), (11, lambda c: F.replace(c, F.lit("w"), F.lit("vv"))), (5, plain)):
        at = {7: 1, 8: 5, 11: 6, 5: 2}[rest]
        md = md.withColumn("md", F.when(F.col("media_id") % rest == at, damage(F.col("md"))).otherwise(F.col("md")))
    caps = caps.withColumn("vtt", F.when(F.col("media_id") % 9 == 2, F.replace("vtt", F.lit("Anna"), F.lit("A."))).otherwise(F.col("vtt")))
    caps = caps.withColumn("vtt", F.when(F.col("media_id") % 6 == 4, plain(F.col("vtt"))).otherwise(F.col("vtt")))
    files = size.select("media_id", F.explode(F.expr("filter(array('result.json', 'transcript.md', case when media_id % 13 = 7 then 'subtitles.srt' end, case when media_id % 12 = 1 then 'speakers.json' end), f -> f is not null)")).alias("file"))
    return names.withColumnRenamed("speaker", "name"), md.join(caps, "media_id").join(size, "media_id"), files


@query(f"""with {V.TURN}, t as (select media_id, turn_idx, speaker, end_ms, case when media_id % 2 = 0 then translate(text, 'aeu', 'áěů') else text end as text from turn_v), g as (select media_id, count(*) as turns, max_by(end_ms, turn_idx) as len from t group by 1),
 s as (select *, {_USED} as used, {_USED} + {_FULL} as full_ms from g), c as (select media_id, count(distinct c)::bigint as n from (select media_id, unnest(regexp_extract_all(text, '[{scans.ACCENTS}]')) as c from t) group by 1),
 h as (select media_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1:5], ' ') as head from t where length(text) > 40 qualify row_number() over (partition by media_id order by turn_idx) <= 6)
 select media_id, 'headings' as fault, turns - 1 as n from g where media_id % 7 = 1 union all select distinct media_id, 'names in md', 1 from t where media_id % 8 = 5 and speaker = 'assistant'
 union all select distinct media_id, 'names in vtt', 1 from t where media_id % 9 = 2 and speaker = 'user' union all select media_id, 'accents in md', n from c where media_id % 5 = 2 union all select media_id, 'accents in vtt', n from c where media_id % 6 = 4
 union all select media_id, 'text', count(*) from h where (media_id % 11 = 6 and contains(head, 'w')) or (media_id % 5 = 2 and regexp_matches(head, '[{scans.ACCENTS}]')) group by 1
 union all select media_id, 'end', len - used from s where used > 0 and len > used + 2000 union all select media_id, 'duration', full_ms from s where media_id % 6 = 3 and used > 0
 union all select media_id, 'subtitles.srt', 1 from g where media_id % 13 = 7 union all select media_id, 'speakers.json', 1 from g where media_id % 12 = 1""")
def dq_cross_artifact(spark, d):
    """Where the artifacts of a recording disagree: headings, names, texts, letters with marks, lengths, files of older versions."""
    return scans.check_agreement(*bundles(spark, d))
