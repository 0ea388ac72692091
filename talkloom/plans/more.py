"""Further queries: review, scoring, quality checks, artifacts, and engine built-ins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from talkloom.functions import forms
from talkloom.functions import text as X
from talkloom.operators import similar
from talkloom.operators import temporal as T
from talkloom.plans import views as V
from talkloom.plans.catalog import _CAND, _VOICE, ONE_VOICE, W, candidates, interval_overlap_pairs, query, voice_pair_similarity


@query(f"""with {V.OCC}, n as (select media_id, label, count(*) as turns, sum(end_ms - start_ms)::bigint as air from occ_v group by all), sw as (select media_id, a, b, count(*) as swaps from (select o.media_id, a, b, label <> lag(label) over (partition by o.media_id, a, b order by pos) as s
 from occ_v o join (select distinct x.label as a, y.label as b from occ_v x, occ_v y where x.label < y.label and x.media_id = y.media_id) p on o.label in (a, b)) where s group by all),
 ov as (select a.media_id, a.label as a, b.label as b, sum(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms))::bigint as shared from occ_v a join occ_v b on a.media_id = b.media_id and a.label < b.label and b.end_ms > a.start_ms and b.start_ms < a.end_ms group by all)
 select sw.media_id, sw.a, sw.b, round(swaps::double / least(na.turns, nb.turns), 6) as alternation, round(coalesce(shared, 0)::double / least(na.air, nb.air), 6) as overlap, swaps::double / least(na.turns, nb.turns) < 0.15 or coalesce(shared, 0)::double / least(na.air, nb.air) > 0.5 as same
 from sw join n na on na.media_id = sw.media_id and na.label = a join n nb on nb.media_id = sw.media_id and nb.label = b left join ov on ov.media_id = sw.media_id and ov.a = sw.a and ov.b = sw.b""")
def name_variant_evidence(spark, d):
    """Two names are one person if they hardly alternate, or speak at the same time for long."""
    o = V.occurrences(spark, d)
    n = o.groupBy("media_id", "label").agg(F.count("*").alias("turns"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("air"))
    pair = n.select("media_id", F.col("label").alias("a"), F.col("turns").alias("ta"), F.col("air").alias("aa")).join(n.select("media_id", F.col("label").alias("b"), F.col("turns").alias("tb"), F.col("air").alias("ab")), "media_id").where("a < b")
    x = o.join(pair.select("media_id", "a", "b"), "media_id").where("label = a or label = b")
    x = x.withColumn("s", F.col("label") != F.lag("label").over(W(["media_id", "a", "b"], "pos")))
    x = x.groupBy("media_id", "a", "b").agg(F.count_if("s").alias("swaps")).where("swaps > 0").join(pair, ["media_id", "a", "b"]).join(interval_overlap_pairs(spark, d).drop("n"), ["media_id", "a", "b"], "left")
    alt, ov = F.col("swaps") / F.least("ta", "tb"), F.coalesce("shared_ms", F.lit(0)) / F.least("aa", "ab")
    return x.select("media_id", "a", "b", F.round(alt, 6).alias("alternation"), F.round(ov, 6).alias("overlap"), ((alt < 0.15) | (ov > 0.5)).alias("same"))


@query(f"""with recursive {_VOICE}, v as (select *, vec_id * 7919 % 1000 as talk from voice_v), l as (select a.media_id, a.vec_id as a, b.vec_id as b from v a join v b on a.media_id = b.media_id and a.vec_id <> b.vec_id where round(list_cosine_similarity(a.e, b.e), 6) >= {ONE_VOICE}),
 r as (select media_id, a as x, a as y from l union select r.media_id, x, b from r join l on l.media_id = r.media_id and l.a = r.y) select r.media_id, x as vec_id, arg_max(y, (talk, -y)) as keep from r join v on v.vec_id = r.y group by r.media_id, x""")
def voice_components(spark, d):
    """Voices of a recording that are alike, directly or by others; of each such group the one that talks most names all."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        groups: list[dict] = []
        for a, b, ta, tb in zip(p["a"], p["b"], p["ta"], p["tb"], strict=True):
            met = [g for g in groups if a in g or b in g]
            groups = [g for g in groups if g not in met] + [{a: ta, b: tb} | {k: v for g in met for k, v in g.items()}]
        rows = [(p["media_id"].iloc[0], x, min(g, key=lambda v: (-g[v], v))) for g in groups for x in g]
        return pd.DataFrame(rows, columns=["media_id", "vec_id", "keep"])

    talk = V.table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") * 7919 % 1000).alias("t"))
    pairs = voice_pair_similarity(spark, d).where(F.col("cosine") >= ONE_VOICE).join(talk.selectExpr("vec_id as a", "t as ta"), "a").join(talk.selectExpr("vec_id as b", "t as tb"), "b")
    return pairs.groupBy("media_id").applyInPandas(run, "media_id long, vec_id long, keep long")


_CHANGES = f"""with {V.FLIP}, mine as (select media_id, start_ms as t from (select *, label <> lag(label) over (partition by media_id order by turn_idx, k) as c from flip_v) where c), ref as (select media_id, start_ms as t from (select *, speaker <> lag(speaker) over (partition by media_id order by turn_idx, k) as c from flip_v) where c)"""


@query(_CHANGES + ", e as (select m.media_id, m.t, min(abs(m.t - r.t)) as err from mine m join ref r using (media_id) group by all) select media_id, count(*) as changes, (list_sort(list(err)))[count(*) // 2 + 1]::bigint as median_ms from e group by media_id")
def boundary_error(spark, d):
    """Distance of each change of label to the nearest real one; upper medians."""
    w = W("media_id", ["turn_idx", "k"])
    f = V.flips(spark, d).withColumns({"m": F.col("label") != F.lag("label").over(w), "r": F.col("speaker") != F.lag("speaker").over(w)})
    t = F.when(F.col("r"), F.col("start_ms"))
    order = W("media_id", "start_ms")
    f = f.withColumns({"before": F.max(t).over(order.rangeBetween(Window.unboundedPreceding, 0)), "after": F.min(t).over(order.rangeBetween(0, Window.unboundedFollowing))}).where("m")
    err = F.least(F.col("start_ms") - F.col("before"), F.col("after") - F.col("start_ms"))
    g = f.select("media_id", err.alias("err")).where("err is not null").groupBy("media_id").agg(F.count("*").alias("changes"), F.sort_array(F.collect_list("err")).alias("x"))
    return g.select("media_id", "changes", F.get("x", F.floor(F.col("changes") / 2).cast("int")).alias("median_ms"))


@query(_CAND + r""" gl as (select list_distinct(flatten(list(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1)))) as terms from benchmark), t as (select media_id, turn_idx, regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1) as o, regexp_extract_all(lower(cand), '([\p{L}\p{N}_]+)', 1) as n, terms from cand_v, gl)
 select media_id, turn_idx, case when len(list_intersect(list_filter(list_distinct(n), lambda x: not list_contains(o, x)), terms)) = 0 then 'pass' when len(n) - len(o) > 1 then 'screen-term-inserted' else 'screen-term-applied' end as verdict from t""")
def substitution_guard(spark, d):
    """A candidate may swap a word for a glossary term, not add one."""
    gl = V.table(spark, d, "benchmark").select(F.explode(X.word_tokens(F.col("text"))).alias("term")).distinct()
    t = candidates(spark, d).select("media_id", "turn_idx", X.word_tokens(F.col("text")).alias("o"), X.word_tokens(F.col("cand")).alias("n"))
    new = t.select("media_id", "turn_idx", F.explode(F.array_except("n", "o")).alias("term")).join(gl, "term", "left_semi").groupBy("media_id", "turn_idx").agg(F.count("*").alias("added"))
    v = F.when(F.col("added").isNull(), "pass").when(F.size("n") - F.size("o") > 1, "screen-term-inserted").otherwise("screen-term-applied")
    return t.join(new, ["media_id", "turn_idx"], "left").select("media_id", "turn_idx", v.alias("verdict"))


@query()
def headroom(spark, d):
    """Turns with both texts; those where readings of a word differ in substance; those that candidates change; those of both kinds."""
    c = candidates(spark, d).where("text <> '' and cand <> ''").select("media_id", "turn_idx", (F.col("text") != F.col("cand")).alias("changed"))
    w = V.columns(spark, d).where("b is not null and b <> c").where(forms.substantive(F.col("c"), F.col("b"))).select("media_id", "turn_idx", F.lit(True).alias("differs")).distinct()
    x = c.join(w, ["media_id", "turn_idx"], "left").withColumn("differs", F.coalesce("differs", F.lit(False)))
    return x.agg(F.count("*").alias("both"), F.count_if("differs").alias("substantive"), F.count_if("changed").alias("changed"), F.count_if(F.col("differs") & F.col("changed")).alias("changed_substantive"))


@query()
def word_equivalence_class(spark, d):
    x = V.columns(spark, d).where("a is not null and b is not null")
    return x.withColumn("kind", forms.equivalence(F.col("a"), F.col("b"))).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"with {V.SHOT} select v.media_id, v.turn_idx, count(*) as frames from turn_v v join shot_v f on f.media_id = v.media_id and f.t between v.start_ms - 30000 and v.end_ms + 30000 group by all")
def pad_window_frames(spark, d):
    f = V.shots(spark, d).selectExpr("media_id", "t as r_start", "t + 1 as r_end")
    t = V.turns(spark, d).selectExpr("media_id", "turn_idx", "start_ms", "end_ms + 1 as end_ms")
    return T.interval_join(t, f, 60_000, pad_ms=30_000).groupBy("media_id", "turn_idx").agg(F.count("*").alias("frames"))


@query(f"with {V.SHOT} select f.media_id, f.page_id, min(v.turn_idx) as turn_idx from shot_v f join turn_v v on v.media_id = f.media_id and v.start_ms >= f.t group by all")
def screen_note_interleave(spark, d):
    """Each frame goes before the first turn that starts at or after it; frames after the last turn's start go nowhere."""
    f = V.shots(spark, d).selectExpr("media_id", "page_id", "-t as start_ms")
    t = V.turns(spark, d).selectExpr("media_id", "turn_idx as hit", "-start_ms as start_ms", "-turn_idx as pos")
    return T.asof_join(f, t, "hit").where("hit is not null").select("media_id", "page_id", F.col("hit").alias("turn_idx"))


@query(f"""with {V.SEG}, b as (select media_id, doc_id, seg_idx, case when (doc_id + seg_idx) % 4 = 1 then '' else language end as language from seg_v),
 x as (select *, last_value(nullif(language, '') ignore nulls) over (partition by media_id order by doc_id, seg_idx rows between unbounded preceding and 1 preceding) as p from b) select media_id, doc_id, seg_idx, language from x where language <> '' and p is distinct from language""")
def language_change_marker(spark, d):
    """Segments whose language is known and another than the last known one; of some it isn't known."""
    s = V.segments(spark, d).withColumn("language", F.when((F.col("doc_id") + F.col("seg_idx")) % 4 == 1, "").otherwise(F.col("language")))
    return s.withColumn("new", X.new_language("language", W("media_id", ["doc_id", "seg_idx"]))).where("new").select("media_id", "doc_id", "seg_idx", "language")


@query("with n as (select count(*) as n from pages), x as (select page_id, row_number() over (order by page_id) - 1 as r from pages) select distinct page_id from x, n, range(40) t(i) where r = floor(i * n / 40)")
def even_spread_cap(spark, d):
    """At most 40 pages at even steps. Ranks: pages of a range of ids before, and within the range."""
    p = V.table(spark, d, "pages").select("page_id", F.expr("page_id div 4096").alias("range"))
    ranges = p.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = p.join(ranges, "range").select("page_id", (F.col("before") + F.row_number().over(W("range", "page_id")) - 1).alias("r"))
    at = spark.range(40).crossJoin(F.broadcast(ranges.agg(F.sum("n").alias("n")))).select(F.expr("cast(floor(id * n / 40) as bigint)").alias("r")).distinct()
    return x.join(F.broadcast(at), "r").select("page_id")


@query("select event_type, count(*) as n, (list_sort(list(value)))[count(*) // 2 + 1] as upper_median from events group by 1")
def llm_run_stats(spark, d):
    """Upper medians without gathering values: equal values are counted, counts summed by ranges of values, and the middle one is
    looked for in its range alone."""
    v = V.table(spark, d, "events").groupBy("event_type", "value").agg(F.count("*").alias("n")).withColumn("range", F.floor("value"))
    r = v.groupBy("event_type", "range").agg(F.sum("n").alias("n"))
    r = r.withColumns({"before": F.coalesce(F.sum("n").over(W("event_type", "range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(W("event_type"))})
    r = r.withColumn("left", F.floor(F.col("total") / 2) - F.col("before")).where("left >= 0 and left < n").drop("n", "before")
    x = v.join(r, ["event_type", "range"]).withColumn("upto", F.sum("n").over(W(["event_type", "range"], "value")))
    return x.where("left < upto and left >= upto - n").select("event_type", F.col("total").alias("n"), F.col("value").alias("upper_median"))


@query(f"with {V.CUE}, x as (select *, max(end_ms) over (partition by media_id order by start_ms, turn_idx, k rows between unbounded preceding and 1 preceding) as before, max(end_ms) over (partition by media_id) - 1000 as stop from cue_v) select media_id, count(*) filter (end_ms <= start_ms) as empty_cues, count(*) filter (start_ms < before) as overlaps, count(*) filter (end_ms > stop) as past from x group by media_id")
def dq_cue_times(spark, d):
    w = W("media_id", ["start_ms", "turn_idx", "k"]).rowsBetween(Window.unboundedPreceding, -1)
    x = V.cues(spark, d).withColumns({"before": F.max("end_ms").over(w), "stop": F.max("end_ms").over(W("media_id")) - 1000})
    return x.groupBy("media_id").agg(F.count_if(F.col("end_ms") <= F.col("start_ms")).alias("empty_cues"), F.count_if(F.col("start_ms") < F.col("before")).alias("overlaps"), F.count_if(F.col("end_ms") > F.col("stop")).alias("past"))


@query()
def near_miss_terms(spark, d):
    """On-screen terms like, but not the same as, words spoken in a window of 90 s: of at least four letters, on at least two
    frames within 30 s of it, neither furniture nor a piece of another term; for each window the 20 closest."""
    from talkloom.plans.catalog import chrome_terms

    f = V.shots(spark, d, terms=F.array_distinct(X.screen_tokens(F.regexp_replace("html", "<[^>]+>", " ")))).select("media_id", "page_id", "t", F.explode("terms").alias("term")).withColumn("low", F.lower("term"))
    inner = similar.inner_terms(f.select("media_id", "low").distinct())
    chrome = chrome_terms(spark, d).select("media_id", F.col("term").alias("low"))
    f = f.where(F.length("low") >= 4).join(chrome, ["media_id", "low"], "left_anti").join(inner, ["media_id", "low"], "left_anti")
    win = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("t") - 30_000) / 90_000)), F.floor((F.col("t") + 30_000) / 90_000)))
    seen = f.withColumn("win", win).groupBy("media_id", "win", "term", "low").agg(F.count("*").alias("n")).where("n >= 2")
    spoken = V.words(spark, d).select("media_id", F.floor(F.col("start_ms") / 90_000).alias("win"), F.explode(X.screen_tokens(F.lower("word"))).alias("s")).distinct()
    seen = seen.join(spoken.select("media_id", "win", F.col("s").alias("low")), ["media_id", "win", "low"], "left_anti")
    x = similar.near_pairs(seen, spoken, ["media_id", "win"], "low", "s", 0.55)
    x = x.groupBy("media_id", "win", "term", "n").agg(F.max("ratio").alias("ratio")).where("ratio between 0.55 and 0.97")
    return x.withColumn("rank", F.row_number().over(W(["media_id", "win"], [F.desc("ratio"), F.desc("n"), F.desc("term")]))).where("rank <= 20").withColumn("ratio", F.round("ratio", 6))


@query("select l_returnflag, count(distinct l_suppkey) as suppliers, sum(case when l_linestatus = 'O' then 1 else 0 end)::bigint as o, sum(case when l_linestatus = 'F' then 1 else 0 end)::bigint as f from lineitem group by 1")
def distinct_and_pivot(spark, d):
    t = V.table(spark, d, "lineitem")
    return t.groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_linestatus") == "O").alias("o"), F.count_if(F.col("l_linestatus") == "F").alias("f"))


@query("(select c_nationkey as k from customer intersect select s_nationkey from supplier) except select n_nationkey from nation where n_regionkey = 0")
def set_operations(spark, d):
    c, s, n = (V.table(spark, d, t) for t in ("customer", "supplier", "nation"))
    return c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey")).exceptAll(n.where("n_regionkey = 0").select("n_nationkey"))


@query("with s as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 10 minute then 0 else 1 end as c from events), g as (select *, sum(c) over (partition by user_id order by ts, event_id) as run from s) select user_id, run::bigint as run, count(*) as n from g group by user_id, run")
def session_runs(spark, d):
    w = W("user_id", ["ts", "event_id"])
    e = V.table(spark, d, "events").withColumn("c", ~F.coalesce(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 10 minutes"), F.lit(False)))
    return e.withColumn("run", T.island(F.col("c"), ["user_id"], ["ts", "event_id"])).groupBy("user_id", "run").agg(F.count("*").alias("n"))
