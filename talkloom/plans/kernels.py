"""Queries whose operators are sequential kernels or artifacts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from talkloom.operators import bulk, folds
from talkloom.plans import views as V
from talkloom.plans.catalog import QUERIES, W, query, removal_reason  # noqa: F401
from talkloom.sources import vtt


@query()
def smooth_absorb_snap(spark, d):
    return folds.relabel(V.flips(spark, d))


def _loops(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([folds.collapse_loop(t) for t in texts], columns=["text", "n"])


@query()
def consecutive_duplicate_drop(spark, d):
    """Lines of documents as cleaned: without empty and boilerplate ones, loops collapsed, and without those that the last kept ones
    repeat."""

    def run(key, at, texts, norms):
        return [(*key, i, t) for i, t, ok in zip(at, texts, folds.keep_lines(norms), strict=True) if ok]

    s = V.segments(spark, d).where(removal_reason(F.col("text"), F.col("language")).isNull())
    s = s.select("doc_id", "seg_idx", F.pandas_udf(_loops, "text string, n int")(F.trim("text"))["text"].alias("text"))
    norm = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_]+", " "))
    return bulk.folded(s.withColumn("norm", norm), ["doc_id"], ["seg_idx"], ["seg_idx", "text", "norm"], run, "doc_id long, seg_idx long, text string")


@query()
def loop_collapse(spark, d):
    s = V.segments(spark, d).select("doc_id", "seg_idx", F.pandas_udf(_loops, "text string, n int")("text").alias("x"))
    return s.where("x.n > 0").select("doc_id", "seg_idx", "x.n", "x.text")


def chunk_cues(words):
    """words (media_id, turn_idx, k, word, start_ms, end_ms) -> cues (media_id, turn_idx, cue, start_ms, end_ms, text): chunks of
    each turn's timed words, a recording at a time."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for turn, q in p.sort_values(["turn_idx", "k"]).groupby("turn_idx", sort=False):
            rows += [(p["media_id"].iloc[0], turn, i, *c) for i, c in enumerate(folds.cue_chunks(list(zip(q["word"], q["start_ms"], q["end_ms"], strict=True))))]
        return pd.DataFrame(rows, columns=["media_id", "turn_idx", "cue", "start_ms", "end_ms", "text"])

    w = words.select("media_id", "turn_idx", "k", F.trim("word").alias("word"), "start_ms", "end_ms").where("word <> '' and start_ms is not null and end_ms is not null")
    return w.groupBy("media_id").applyInPandas(run, "media_id long, turn_idx long, cue long, start_ms long, end_ms long, text string")


def met_half_way(cues):
    """Of two cues that follow one another and overlap, also across turns, both meet in the middle; what then has no length, and blank
    ones, go."""
    order = Window.partitionBy("media_id").orderBy("turn_idx", "cue")
    before, after = F.lag("end_ms").over(order), F.lead("start_ms").over(order)
    c = cues.withColumns({"s": F.when(before > F.col("start_ms"), F.floor((before + F.col("start_ms")) / 2)).otherwise(F.col("start_ms")), "e": F.when(after < F.col("end_ms"), F.floor((after + F.col("end_ms")) / 2)).otherwise(F.col("end_ms"))})
    return c.where("e > s and trim(text) <> ''").select("media_id", "turn_idx", "cue", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), "text")


def timed_cues(words):
    """Cues of timed words, where they overlap meeting half way."""
    return met_half_way(chunk_cues(words))


def crosstalk(spark, d):
    """Words whose turns begin up to 900 ms early when their number is a multiple of four: they overlap the turn before, but don't begin
    before it, as turns are in order of their starts."""
    before = F.coalesce(F.lag("n").over(W("media_id", "turn_idx")), F.lit(0)) * 400
    early = F.when(F.col("turn_idx") % 4 == 0, F.least(F.lit(900), before)).otherwise(0)
    w = V.words(spark, d).join(V.turns(spark, d).select("media_id", "turn_idx", early.alias("early")), ["media_id", "turn_idx"])
    return w.withColumns({"start_ms": F.col("start_ms") - F.col("early"), "end_ms": F.col("end_ms") - F.col("early")}).drop("early")


@query()
def vtt_cues(spark, d):
    return timed_cues(crosstalk(spark, d))


def swap_counts(rows, key="media_id", order="pos"):
    """(key, turns, swaps): for each key the rows of each label and the changes from one label to another, as maps: all that
    collapsing labels needs to know."""
    w = W(key, order)
    x = rows.select(key, "label", F.lag("label").over(w).alias("was"))
    turns = x.groupBy(key, "label").agg(F.count("*").alias("n")).groupBy(key).agg(F.collect_list(F.struct("label", "n")).alias("turns"))
    swaps = x.where("was <> label").groupBy(key, F.least("was", "label").alias("a"), F.greatest("was", "label").alias("b")).agg(F.count("*").alias("n"))
    return turns.join(swaps.groupBy(key).agg(F.collect_list(F.struct("a", "b", "n")).alias("swaps")), key, "left")


def collapsed(counts, fold, schema="media_id long, label string, target string"):
    """counts of swap_counts() through fold(turns, swaps) -> label map, a row for each label."""

    def run(batches):
        for p in batches:
            rows = []
            for key, turns, swaps in zip(p["media_id"], p["turns"], p["swaps"], strict=True):
                to = fold({t["label"]: int(t["n"]) for t in turns}, {(x["a"], x["b"]): int(x["n"]) for x in (() if swaps is None else swaps)})
                rows += [(key, x, to[x]) for x in sorted(to)]
            yield pd.DataFrame(rows, columns=["media_id", "label", "target"])

    return counts.mapInPandas(run, schema)


@query()
def collapse_to_target(spark, d):
    return collapsed(swap_counts(V.occurrences(spark, d)), lambda turns, swaps: folds.collapse_to(turns, swaps, 3))


@query(f"with {V.TURN} select media_id, row_number() over (partition by media_id order by turn_idx) - 1 as cue_idx, speaker, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text, start_ms, end_ms from turn_v where n > 0")
def vtt_parse_roundtrip(spark, d):
    return vtt.parse(vtt.render(V.turns(spark, d).where("n > 0")))


@query(f"with {V.TURN} select media_id, count(*) as turns, max(end_ms)::bigint as duration_ms from turn_v group by 1")
def result_json_scan(spark, d):
    """Result documents written and read back."""
    doc = vtt.result_json(V.turns(spark, d)).select("media_id", F.from_json("value", "metadata struct<duration_ms: long>, turns array<struct<turn_idx: long, text: string>>").alias("r"))
    return doc.select("media_id", F.size("r.turns").cast("long").alias("turns"), "r.metadata.duration_ms")
