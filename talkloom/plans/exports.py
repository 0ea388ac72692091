"""Whole artifacts: Markdown, WebVTT and JSON of each recording, prompts, turns from labelled words, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions import text as X
from talkloom.operators import folds
from talkloom.operators import temporal as T
from talkloom.plans import scoring
from talkloom.plans import views as V
from talkloom.plans.artifacts import caption_denoise, untimed
from talkloom.plans.catalog import ORACLE, W, candidates, guardrail_verdicts, query
from talkloom.plans.kernels import chunk_cues, crosstalk, met_half_way
from talkloom.plans.owners import aligned_quote
from talkloom.sources import scans, vtt

NAMES = {"user": "Anna", "assistant": "Ota"}


def named(speaker) -> F.Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), speaker), speaker)


def spoken(spark, d) -> DataFrame:
    """Turns with a language: every fifth is in another one, and of every fourth it isn't known."""
    return V.turns(spark, d).withColumn("language", F.when(F.col("turn_idx") % 5 == 3, "sk").when(F.col("turn_idx") % 4 == 1, "").otherwise("cs"))


def header(turns: DataFrame, llm: DataFrame) -> DataFrame:
    """(media_id, head): the lines above a transcript: title, duration, languages by share, speakers, recogniser, and what a model
    changed, where there was one (llm: media_id, mode, changed, rejected)."""
    g = turns.groupBy("media_id").agg(F.max("end_ms").alias("ms"), F.countDistinct("speaker").alias("speakers"))
    lang = turns.groupBy("media_id", "language").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(W("media_id"))
    part = F.format_string("%s %d%%", "language", F.bround(100 * F.col("n") / F.greatest(total, F.lit(1))).cast("long"))
    lang = lang.withColumns({"part": part, "rank": F.row_number().over(W("media_id", [F.desc("n"), "language"]))}).where("rank <= 6")
    lang = lang.groupBy("media_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), ", ").alias("languages"))
    x = g.join(lang, "media_id").join(llm, "media_id", "left")
    model = F.when(~F.coalesce("mode", F.lit("")).isin("", "disabled", "skipped"), F.concat(F.lit("- **LLM "), F.col("mode"), F.lit(":** "), F.col("changed").cast("string"), F.lit(" turns improved, "), F.col("rejected").cast("string"), F.lit(" rejected by guardrail\n")))
    head = F.concat(
        F.lit("# recording "), F.col("media_id").cast("string"), F.lit("\n\n- **Duration:** "), X.duration_line(F.col("ms"), F.col("ms"), F.lit(0)), F.lit("\n- **Languages:** "), F.col("languages"),
        F.lit("\n- **Speakers:** "), F.col("speakers").cast("string"), F.lit(" (from transcript)\n- **ASR:** whisper / large\n"), F.coalesce(model, F.lit("")), F.lit("\n---\n\n"),
    )
    return x.select("media_id", head.alias("head"))


def markdown(turns: DataFrame, heads: DataFrame, notes: DataFrame) -> DataFrame:
    """(media_id, value): heads (media_id, head), then the turns under headings with clock, name and, where it changes, language;
    notes (media_id, t, caption) stand above the first turn that starts no earlier."""
    mark = F.when(X.new_language("language", W("media_id", "turn_idx")), F.concat(F.lit("  `"), F.col("language"), F.lit("`"))).otherwise("")
    body = F.concat(F.lit("## ["), X.clock(F.col("start_ms")), F.lit("] "), F.coalesce(named(F.col("speaker")), F.lit("")), mark, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    lines = turns.select("media_id", "turn_idx", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("t"), body.alias("line"))
    ask = notes.select("media_id", "caption", "t", (-F.col("t")).alias("start_ms"))
    after = turns.select("media_id", F.col("turn_idx").alias("hit"), (-F.col("start_ms")).alias("start_ms"), (-F.col("turn_idx")).alias("pos"))
    shown = T.asof_join(ask, after, "hit").where("hit is not null")
    shown = shown.select("media_id", F.col("hit").alias("turn_idx"), F.lit(0).alias("kind"), "t", F.concat(F.lit("> *screen ["), X.clock(F.col("t")), F.lit("]:* "), F.col("caption"), F.lit("\n")).alias("line"))
    g = lines.unionByName(shown).groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("turn_idx", "kind", "t", "line"))).alias("x"))
    return heads.join(g, "media_id").select("media_id", F.concat("head", F.array_join(F.transform("x", lambda v: v["line"]), "\n")).alias("value"))


def model_stats(spark, d) -> DataFrame:
    """What the guardrail let through, for two of three recordings."""
    v = guardrail_verdicts(spark, d).join(candidates(spark, d), ["media_id", "turn_idx"])
    ok = F.col("verdict") == "ok"
    g = v.groupBy("media_id").agg(F.count_if(ok & (F.col("cand") != F.col("text"))).alias("changed"), F.count_if(~ok).alias("rejected"))
    return g.withColumn("mode", F.when(F.col("media_id") % 3 == 0, "disabled").otherwise("merge"))


@query()
def markdown_transcript(spark, d):
    """Markdown of each recording: head, turns, language marks and screen notes."""
    t = spoken(spark, d)
    return markdown(t, header(t, model_stats(spark, d)), caption_denoise(spark, d).select("media_id", "t", "caption"))


def captions(spark, d) -> DataFrame:
    """Cues of all turns: by word times where there are any, else by the turn's; all that overlap meet half way. Every fourth turn has
    no word times, and the one after it begins before its end."""
    none = F.col("turn_idx") % 4 == 3
    timed = chunk_cues(crosstalk(spark, d).where(~none))
    rest = untimed(V.turns(spark, d).where(none & (F.col("n") > 0)))
    who = V.turns(spark, d).select("media_id", "turn_idx", named(F.col("speaker")).alias("speaker"))
    return met_half_way(timed.unionByName(rest)).join(who, ["media_id", "turn_idx"])


@query()
def vtt_export(spark, d):
    """WebVTT of each recording: cues of bounded length, meeting half way, on two lines."""
    return vtt.render(captions(spark, d), wrap=True)


def export_checks(spark, d) -> DataFrame:
    ends = V.turns(spark, d).groupBy("media_id").agg(F.max("end_ms").alias("duration_ms"))
    return scans.check_vtt(vtt_export(spark, d).join(ends, "media_id"))


@query(f"with {V.TURN} select media_id, true as header, 0::bigint as empty_cues, 0::bigint as past from turn_v where n > 0 group by 1")
def vtt_export_checks(spark, d):
    """The exported captions have a header, no cue without length and none beyond the recording's end."""
    return export_checks(spark, d).select("media_id", "header", "empty_cues", "past")


@query()
def vtt_export_overlaps(spark, d):
    """Exported cues that begin before the end of one before them. Neighbours meet half way, but where a short cue between two goes, as
    it lies within the next one, those two are no neighbours and may keep an overlap."""
    return export_checks(spark, d).select("media_id", "cues", "overlaps")


def result_documents(spark, d) -> DataFrame:
    """(media_id, value): the whole result of each recording as JSON: metadata, speakers with their talk time, names, screen notes and
    turns with words."""
    t = spoken(spark, d)
    words = V.words(spark, d).groupBy("media_id", "turn_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "word", "start_ms", "end_ms"))), lambda w: w.dropFields("k")).alias("words"))
    turns = t.join(words, ["media_id", "turn_idx"], "left").groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("turn_idx", "start_ms", "end_ms", "speaker", named(F.col("speaker")).alias("name"), "language", "text", "words"))).alias("turns"))
    stats = t.groupBy("media_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"), F.count("*").alias("turns"), F.sum("n").alias("words"))
    stats = stats.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("ms")).alias("rank"), "speaker", named(F.col("speaker")).alias("name"), "ms", X.clock(F.col("ms")).alias("clock"), "turns", "words"))), lambda s: s.dropFields("rank")).alias("speakers"))
    share = t.groupBy("media_id", "language").agg(F.sum("n").alias("n")).withColumn("share", F.round(F.col("n") / F.greatest(F.sum("n").over(W("media_id")), F.lit(1)), 6))
    share = share.groupBy("media_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "share")))).alias("shares"))
    screen = caption_denoise(spark, d).groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("t", "caption"))).alias("screen"))
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    x = turns.join(stats, "media_id").join(share, "media_id").join(screen, "media_id", "left").join(model_stats(spark, d), "media_id", "left")
    meta = F.struct(F.aggregate("turns", F.lit(0).cast("long"), lambda a, y: F.greatest(a, y["end_ms"])).alias("duration_ms"), F.struct("shares").alias("languages"), F.struct(F.lit("transcript").alias("source")).alias("speakers_from"), F.struct("mode", "changed", "rejected").alias("llm"))
    none = F.array().cast("array<struct<t: long, caption: string>>")
    return x.select("media_id", F.to_json(F.struct(meta.alias("metadata"), "speakers", names.alias("name_map"), F.coalesce("screen", none).alias("screen"), "turns")).alias("value"))


@query(f"with {V.TURN} select media_id, count(*) as turns, sum(n)::bigint as words, (select count(distinct speaker) from turn_v s where s.media_id = t.media_id) as speakers, max(end_ms)::bigint as duration_ms from turn_v t group by media_id")
def result_json_export(spark, d):
    """Whole result documents, read back."""
    kinds = "metadata struct<duration_ms: long>, speakers array<struct<name: string>>, turns array<struct<words: array<struct<word: string>>>>"
    r = result_documents(spark, d).select("media_id", F.from_json("value", kinds).alias("r"))
    words = F.aggregate("r.turns", F.lit(0).cast("long"), lambda a, t: a + F.greatest(F.coalesce(F.size(t["words"]), F.lit(0)), F.lit(0)))
    return r.select("media_id", F.size("r.turns").cast("long").alias("turns"), words.alias("words"), F.size("r.speakers").cast("long").alias("speakers"), "r.metadata.duration_ms")


@query(f"with {V.TURN}, x as (select doc_id, unnest(string_split_regex(replace(text, '. ', ',' || chr(10)), '[,\n]')) as term, from documents), y as (select doc_id, trim(term, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as term from x) select doc_id, count(distinct term) as terms, sum(length(term))::bigint as chars from (select distinct doc_id, term from y where term <> '') group by 1")
def glossary_split(spark, d):
    """Lists of terms with commas or line feeds between them."""
    t = V.table(spark, d, "documents").select("doc_id", X.split_terms(F.replace("text", F.lit(". "), F.lit(",\n"))).alias("t"))
    return t.where(F.size("t") > 0).select("doc_id", F.size("t").cast("long").alias("terms"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query(f"""with {V.CUE}, c as (select *, row_number() over (partition by media_id order by start_ms, turn_idx, k) - 1 as i, count(*) over (partition by media_id) - 1 as last from cue_v),
 h as (select w.media_id, w.turn_idx, w.k, w.speaker, case when c.word = w.word then c.i end as tw, case when c.word = w.word then w.k end as hk from word_v w left join c using (media_id, turn_idx, k)),
 t as (select media_id, turn_idx, any_value(speaker) as speaker, count(*) as n, min(hk) as k0, max(hk) as k1, min_by(tw, hk) as t0, max_by(tw, hk) as t1 from h group by all having min(hk) is not null),
 q as (select t.media_id, t.turn_idx, coalesce(string_agg(c.word, ' ' order by c.i) filter (c.owner = t.speaker), '') as theirs from t left join c on c.media_id = t.media_id and c.i between greatest(0, t0 - k0) and least(c.last, t1 + n - 1 - k1) group by t.media_id, t.turn_idx),
 p as (select v.media_id, v.turn_idx // 8 as win, count(*) as n, string_agg('[' || (v.turn_idx % 8 + 1) || '] A: ' || text || chr(10) || '    B: ' || coalesce(nullif(theirs, ''), '(none)'), chr(10) order by v.turn_idx) as lines from turn_v v left join q using (media_id, turn_idx) group by all)
 select media_id, win, case when media_id % 2 = 0 then 'Words visible on screen during this passage: alpha, beta' || chr(10) || chr(10) else '' end || n || ' lines, each with both readings:' || chr(10) || chr(10) || lines || chr(10) || chr(10) || 'Return exactly ' || n || ' corrected lines, numbered [1]..[' || n || '].' as prompt from p""")
def prompt_assembly(spark, d):
    """Prompts of eight turns: terms on screen, each line in both readings, and what to return."""
    q = V.turns(spark, d).join(aligned_quote(spark, d).withColumnRenamed("text", "theirs"), ["media_id", "turn_idx"], "left")
    terms = F.when(F.col("media_id") % 2 == 0, F.array(F.lit("alpha"), F.lit("beta")))
    line = F.concat(F.lit("["), (F.col("turn_idx") % 8 + 1).cast("string"), F.lit("] A: "), F.col("text"), F.lit("\n    B: "), F.coalesce(F.nullif("theirs", F.lit("")), F.lit("(none)")))
    p = q.groupBy("media_id", F.expr("turn_idx div 8").alias("win")).agg(F.count("*").cast("string").alias("n"), F.sort_array(F.collect_list(F.struct("turn_idx", line.alias("line")))).alias("x"))
    return p.select("media_id", "win", prompt(F.col("n"), F.array_join(F.transform("x", lambda v: v["line"]), "\n"), terms).alias("prompt"))


def prompt(n, lines, terms) -> F.Column:
    """A prompt of n numbered lines in both readings, with the terms on screen before them if there are any."""
    before = F.when(F.size(terms) > 0, F.concat(F.lit("Words visible on screen during this passage: "), F.array_join(terms, ", "), F.lit("\n\n"))).otherwise("")
    return F.concat(before, n, F.lit(" lines, each with both readings:\n\n"), lines, F.lit("\n\nReturn exactly "), n, F.lit(" corrected lines, numbered [1]..["), n, F.lit("]."))


def turns_from_words(words: DataFrame, segments: DataFrame, gap_ms: int = 800) -> DataFrame:
    """words (media_id, seg, k, word, label, start_ms, end_ms; times may be null), segments (media_id, seg, label, text, start_ms,
    end_ms, language) -> turns (media_id, turn, speaker, language, start_ms, end_ms, text). A segment splits where its words' labels
    change (a word without one has its segment's); a piece lasts from its words' first time to their last, or as its segment where
    none has any; segments without words are pieces themselves; blank ones go. A piece joins the turn before it if that is of the
    same speaker and ended at most gap_ms before; a turn's language is its first piece's. Turns are numbered by their starts."""
    label = F.coalesce(F.when(F.col("label") != "", F.col("label")), F.lit("UNKNOWN"))
    own = segments.select("media_id", "seg", label.alias("seg_label"), F.col("start_ms").alias("seg_start"), F.col("end_ms").alias("seg_end"), "text", "language")
    w = words.where("word is not null and word <> ''").join(own.drop("text"), ["media_id", "seg"]).withColumn("label", F.coalesce(F.when(F.col("label") != "", F.col("label")), "seg_label"))
    w = T.label_runs(w, ["media_id", "seg"], ["k"], "label")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.trim("word").alias("w")))), lambda x: x["w"]), " ")
    pieces = w.groupBy("media_id", "seg", F.col("__run").alias("run")).agg(F.first("label").alias("speaker"), F.first("language").alias("language"), F.coalesce(F.min("start_ms"), F.first("seg_start")).alias("start_ms"), F.coalesce(F.max("end_ms"), F.first("seg_end")).alias("end_ms"), text.alias("text"))
    bare = own.join(w.select("media_id", "seg").distinct(), ["media_id", "seg"], "left_anti").select("media_id", "seg", F.lit(1).cast("long").alias("run"), F.col("seg_label").alias("speaker"), "language", F.col("seg_start").alias("start_ms"), F.col("seg_end").alias("end_ms"), "text")
    p = pieces.unionByName(bare).withColumn("text", X.squeeze(F.col("text"))).where("text <> ''")
    order = ["seg", "run"]
    # within a stretch of one speaker the latest end so far is that of the turn: what ended before a gap ended before all that follows
    p = T.label_runs(p, ["media_id"], order, "speaker").withColumnRenamed("__run", "stretch")
    reach = F.max("end_ms").over(W(["media_id", "stretch"], order).rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("new", F.coalesce(F.col("start_ms") - reach > gap_ms, F.lit(True))).withColumn("turn", T.island(F.col("new"), ["media_id"], order))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "run", "text"))), lambda x: x["text"]), " ")
    head = F.min_by(F.struct("speaker", "language", "start_ms"), F.struct("seg", "run"))
    t = p.groupBy("media_id", "turn").agg(head.alias("h"), F.max("end_ms").alias("end_ms"), joined.alias("text")).select("media_id", "turn", "h.*", "end_ms", "text")
    return t.withColumn("turn", F.row_number().over(W("media_id", ["start_ms", "turn"])).cast("long"))


#: Segments on which turns overlap: long ones with short ones of the other speaker within, gaps of 0.5 to 1.3 s, missing labels.
_OVER = "media_id, turn_idx as seg, case when (media_id + turn_idx) % 11 = 4 then '' when (media_id + turn_idx) % 3 = 0 then 'user' else 'assistant' end as label, text, start_ms - case when turn_idx % 4 = 2 then 2500 when turn_idx % 4 = 3 then 4000 else 0 end + 400 * (turn_idx % 3) as start_ms, end_ms + case when turn_idx % 4 = 1 then 6000 else 0 end as end_ms, case when turn_idx % 3 = 1 then '' else 'cs' end as language"


@query(f"""with {V.TURN}, s as (select {_OVER}, trim(regexp_replace(text, '\\s+', ' ', 'g')) as line from turn_v), q as (select * exclude (label), coalesce(nullif(label, ''), 'UNKNOWN') as label from s where line <> ''),
 c as (select *, sum(case when label = p then 0 else 1 end) over (partition by media_id order by seg) as stretch from (select *, lag(label) over (partition by media_id order by seg) as p from q)),
 r as (select *, max(end_ms) over (partition by media_id, stretch order by seg rows between unbounded preceding and 1 preceding) as reach from c),
 i as (select *, sum(case when reach is null or start_ms - reach > 800 then 1 else 0 end) over (partition by media_id order by seg) as island from r),
 g as (select media_id, island, any_value(label) as speaker, min_by(language, seg) as language, min_by(start_ms, seg) as start_ms, max(end_ms) as end_ms, string_agg(line, ' ' order by seg) as text from i group by all)
 select media_id, row_number() over (partition by media_id order by start_ms, island) as turn, speaker, language, start_ms, end_ms, text from g""")
def overlapping_turns(spark, d):
    """Turns of segments that overlap one another, without words."""
    s = V.turns(spark, d).selectExpr(*_columns(_OVER))
    none = V.words(spark, d).where("false").selectExpr("media_id", "turn_idx as seg", "k", "word", "speaker as label", "start_ms", "end_ms")
    return turns_from_words(none, s)


def _columns(names: str) -> list[str]:
    """The expressions of a select list without commas inside them."""
    return names.split(", ")


@query()
def relabelled_turns(spark, d):
    """Turns built from words after smoothing, absorption and snapping; some words and all of some segments have no times."""
    f = V.flips(spark, d)
    new = folds.relabel(f).select("media_id", "turn_idx", "k", F.col("new_label").alias("l"))
    gone = (F.col("k") % 6 == 0) | (F.col("turn_idx") % 9 == 8)
    w = f.join(new, ["media_id", "turn_idx", "k"]).select("media_id", F.col("turn_idx").alias("seg"), "k", "word", F.col("l").alias("label"), *[F.when(~gone, F.col(c)).alias(c) for c in ("start_ms", "end_ms")])
    s = spoken(spark, d).select("media_id", F.col("turn_idx").alias("seg"), F.col("speaker").alias("label"), "text", "start_ms", "end_ms", "language")
    return turns_from_words(w, s)


@query()
def wording_report(spark, d):
    """A wording comparison as one JSON document: errors where two others agree, the control over all columns, how each reading departs
    from the other two, what the correction did, known bad pairs, the 40 most frequent errors, and the pooled verdict."""
    x = scoring.readings(V.columns(spark, d))
    by = lambda df, key: df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, F.struct(*[c for c in df.columns if c != key]))))))
    listed = lambda df: df.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), *df.columns))))
    top = x.where("bc and not a1c").groupBy(F.col("a1").alias("mine"), F.col("c").alias("ref")).agg(scoring.tally(x, F.lit(True)).alias("n")).orderBy(F.desc("n"), "mine", "ref").limit(40)
    parts = {"witness_error": by(scoring.errors(x), "stream"), "control_error": by(scoring.control(x), "stream"), "legs": by(scoring.departures(x), "engine"), "merge": by(scoring.buckets(x), "bucket"), "known_bad": listed(scoring.bad_pairs(x)), "top_errors": listed(top), "bootstrap": by(scoring.pooled_block_bootstrap(spark, d).withColumn("arms", F.lit("a1 - a0")), "arms")}
    out = None
    for name, df in parts.items():  # one row each
        row = df.toDF(name)
        out = row if out is None else out.crossJoin(F.broadcast(row))
    return out.select(F.to_json(F.struct(*parts)).alias("value"))


@query(f"select stream, witnesses, error, n, verdict from ({{}}) e, ({{}}) p".format(ORACLE["witness_error"], ORACLE["pooled_block_bootstrap"]))
def wording_report_scan(spark, d):
    """The report, read back: errors of each stream and the verdict."""
    kinds = "witness_error map<string, struct<witnesses: long, error: double>>, bootstrap map<string, struct<n: long, verdict: string>>"
    r = wording_report(spark, d).select(F.from_json("value", kinds).alias("r"))
    v = F.element_at("r.bootstrap", F.lit("a1 - a0"))
    return r.select(v["n"].alias("n"), v["verdict"].alias("verdict"), F.explode("r.witness_error").alias("stream", "e")).select("stream", "e.witnesses", "e.error", "n", "verdict")


@query("with r as (select doc_id % 3 as run, avg(quality) as score from labels group by 1) select round(min(score), 6) as lo, round(max(score), 6) as hi, 3::bigint as runs from r")
def noise_floor_report(spark, d):
    """Scores of repeated runs as a JSON document, read back."""
    r = V.table(spark, d, "labels").groupBy(F.expr("doc_id % 3").alias("run")).agg(F.avg("quality").alias("score"))
    doc = r.groupBy().agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("run", "score"))).alias("runs"), F.min("score").alias("lo"), F.max("score").alias("hi"))).alias("value"))
    x = doc.select(F.from_json("value", "runs array<struct<run: long, score: double>>, lo double, hi double").alias("r"))
    return x.select(F.round("r.lo", 6).alias("lo"), F.round("r.hi", 6).alias("hi"), F.size("r.runs").cast("long").alias("runs"))


AUDIO_RATE = 16


@query("with s as (select user_id as media_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, round(value * 100)::bigint as x from events) select media_id, count(*) as samples, round(sqrt(sum(x * x)::bigint / count(*)::double + 1e-12), 6) as rms from s where i >= round_even(0.28 * 16, 0) and i < round_even(1.72 * 16, 0) group by 1")
def audio_slice_rms(spark, d):
    """Slices of sample arrays from 0.28 s to 1.72 s at 16 samples a second, and their loudness."""
    e = V.table(spark, d, "events").groupBy(F.col("user_id").alias("media_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("x")))), lambda v: v["x"]).alias("a"))
    e = e.select("media_id", audio_slice(F.col("a"), 0.28, 1.72, AUDIO_RATE).alias("a")).where(F.size("a") > 0)
    return e.select("media_id", F.size("a").cast("long").alias("samples"), F.round(rms(F.col("a")), 6).alias("rms"))


def audio_slice(samples, start_s: float, end_s: float, rate: int) -> F.Column:
    """Samples from one time to another; times go to the nearest sample."""
    lo = round(start_s * rate)
    return F.slice(samples, lo + 1, max(0, round(end_s * rate) - lo))


def rms(samples) -> F.Column:
    """Root mean square of an array; 0 of an empty one."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples) + 1e-12)).otherwise(0.0)
