"""Reviews of a run: rejected texts, fragments with samples, cuts with turns, words by changed turns, interpolated times, lean results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkloom.operators import temporal as T
from talkloom.plans import views as V
from talkloom.plans.catalog import ORACLE, W, guardrail_verdicts, query, sentence_cut_integrity, speaker_diagnostics
from talkloom.sources import scans


@query(f"with g as ({ORACLE['guardrail_verdicts']}) select media_id, turn_idx, verdict from g where verdict <> 'ok' order by media_id, turn_idx limit 50")
def rejections(spark, d):
    """The first 50 texts that the guardrail rejects."""
    return guardrail_verdicts(spark, d).where("verdict <> 'ok'").orderBy("media_id", "turn_idx").limit(50)


@query(f"""with {V.TURN}, g as (select speaker, median(n * 400) < 2000 or count(*) < 15 as fragment from turn_v group by 1), r as (select speaker, text, row_number() over (partition by speaker order by media_id, turn_idx) as nth from turn_v)
 select speaker, fragment, list(text order by nth) as samples from r join g using (speaker) where nth <= 3 group by all""")
def fragment_samples(spark, d):
    """Each speaker's first three texts, and whether the speaker looks like a fragment of another: the three smallest of each task meet."""
    t = V.turns(spark, d).select("speaker", "text", "media_id", "turn_idx", F.pmod("media_id", F.lit(64)).alias("part"))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("media_id", "turn_idx"))
    t = t.withColumn("nth", first("speaker", "part")).where("nth <= 3").withColumn("nth", first("speaker")).where("nth <= 3")
    s = t.groupBy("speaker").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]).alias("samples"))
    return s.join(speaker_diagnostics(spark, d).select("speaker", "fragment"), "speaker")


@query(f"with {V.TURN}, c as ({ORACLE['sentence_cut_integrity']}), t as (select media_id, count(*) as turns, count(*) filter (n <= 5) as short_turns from turn_v group by 1) select t.media_id, changes, cuts, rate, turns, short_turns from t left join c using (media_id)")
def cut_report(spark, d):
    """Cuts inside sentences, with all turns and those of at most five words."""
    t = V.turns(spark, d).groupBy("media_id").agg(F.count("*").alias("turns"), F.count_if(F.col("n") <= 5).alias("short_turns"))
    return t.join(sentence_cut_integrity(spark, d), "media_id", "left").select("media_id", "changes", "cuts", "rate", "turns", "short_turns")


@query(ORACLE["word_to_closest_turn"].replace("join turn_v t on t.media_id = w.media_id and", "join turn_v t on t.media_id = w.media_id and (t.media_id + t.turn_idx) % 3 = 0 and"))
def word_to_changed_turn(spark, d):
    """The closest of the changed turns within a quarter of a second of a word; a third of the turns are changed."""
    w = V.words(spark, d).selectExpr("media_id", "turn_idx as wt", "k", "start_ms + 650 as mid").selectExpr("*", "mid as start_ms", "mid + 1 as end_ms")
    t = V.turns(spark, d).where("(media_id + turn_idx) % 3 = 0").selectExpr("media_id", "turn_idx", "start_ms as ts", "end_ms as te", "start_ms - 250 as r_start", "end_ms + 251 as r_end")
    x = T.interval_join(w, t, 10_000).withColumn("dist", F.expr("case when mid between ts and te then 0L else least(abs(mid - ts), abs(mid - te)) end"))
    rn = F.row_number().over(W(["media_id", "wt", "k"], ["dist", F.abs(F.col("mid") - F.col("ts")), "turn_idx"]))
    return x.withColumn("rn", rn).where("rn = 1").select("media_id", "wt", "k", "turn_idx", "dist")


@query(f"with {V.TURN}, e as (select *, end_ms + case when turn_idx % 3 = 0 then 900 else -200 * (turn_idx % 2) end as till from turn_v where n > 0) select media_id, turn_idx, unnest(range(n)) as k, unnest(list_transform(range(n), lambda k: floor(start_ms + (till - start_ms) * (2 * k + 1) / (2.0::double * n))::bigint)) as t_ms from e")
def interpolated_word_times(spark, d):
    """Times of a cue's words, spread evenly between its start and end, whatever their number."""
    t = V.turns(spark, d).where("n > 0").withColumn("till", F.expr("end_ms + case when turn_idx % 3 = 0 then 900 else -200 * (turn_idx % 2) end"))
    t = t.select("media_id", "turn_idx", "start_ms", "till", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    return t.select("media_id", "turn_idx", "k", F.floor(F.col("start_ms") + (F.col("till") - F.col("start_ms")) * (2 * F.col("k") + 1) / (2.0 * F.col("n"))).alias("t_ms"))


@query(f"with {V.TURN} select media_id, count(*) as turns, true as lean from turn_v group by 1")
def result_without_words(spark, d):
    """Result documents as a reader asks for them, without words."""
    from talkloom.plans.exports import result_documents

    kinds = "turns array<struct<turn_idx: long, speaker: string, text: string, words: array<struct<word: string>>>>"
    r = result_documents(spark, d).select("media_id", F.from_json("value", kinds).alias("r")).select("media_id", scans.without_words(F.col("r.turns")).alias("turns"))
    return r.select("media_id", F.size("turns").cast("long").alias("turns"), (~F.contains(F.to_json(F.struct("turns")), F.lit('"words"'))).alias("lean"))
