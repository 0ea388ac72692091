"""WebVTT reader and writer, and JSON artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions import text as X
from talkloom.sources import docx

_TIME = r"(\d{2}:\d{2}:\d{2}[.,]\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}[.,]\d{3})"


def parse(files: DataFrame) -> DataFrame:
    """files (media_id, value): whole WebVTT texts -> (media_id, cue_idx, speaker, text, start_ms, end_ms).

    Blocks without a time line and cues without text are left out; a cue without a voice has the speaker ''.
    """
    raw = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n")
    b = files.select("media_id", F.posexplode(F.split(raw, r"\n\s*\n")).alias("block", "b")).where(F.col("b").rlike(_TIME))
    body = F.regexp_replace("b", r"(?s)^.*?-->[^\n]*\n?", "")
    b = b.select("media_id", "block", X.parse_timestamp(F.regexp_extract("b", _TIME, 1)).alias("start_ms"), X.parse_timestamp(F.regexp_extract("b", _TIME, 2)).alias("end_ms"), body.alias("body"))
    voices = F.regexp_extract_all("body", F.lit(r"(?s)(<v [^>]*>.*?(?:</v>|$))"), F.lit(1))
    b = b.select("*", F.posexplode(F.when(F.size(voices) > 0, voices).otherwise(F.array("body"))).alias("span", "v"))
    b = b.select("media_id", "block", "span", "start_ms", "end_ms", X.clean_name(F.regexp_extract("v", "^<v ([^>]*)>", 1)).alias("speaker"), X.squeeze(X.unescape(X.strip_tags(F.col("v")))).alias("text"))
    order = F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "block", "span"))
    return b.where("text <> ''").select("media_id", (order - 1).cast("long").alias("cue_idx"), "speaker", "text", "start_ms", "end_ms")


def load(spark, path: str) -> DataFrame:
    """Cues (media_id, speaker, text, start_ms, end_ms) of the transcript files that path names, by their suffix: .vtt or .docx. Any
    other suffix, and files without a cue, are errors."""
    suffix = path.rstrip("*/").rsplit(".", 1)[-1].lower()
    if suffix == "vtt":
        cues = read(spark, path)
    elif suffix == "docx":
        cues = docx.parse(spark.read.format("binaryFile").load(path).select(F.col("path").alias("media_id"), "content"))
    else:
        raise ValueError(f"unsupported transcript format .{suffix}: .vtt or .docx are read")
    files = spark.read.format("binaryFile").load(path).select("path")
    none = files.join(cues.select(F.regexp_replace("media_id", "^file:/+", "").alias("m")).distinct(), F.regexp_replace("path", "^file:/+", "") == F.col("m"), "left_anti").limit(5).collect()
    if none:
        raise ValueError(f"no cues in {[r['path'] for r in none]}")
    return cues.select("media_id", F.when(F.trim("speaker") == "", "SPEAKER_00").otherwise(F.col("speaker")).alias("speaker"), "text", "start_ms", "end_ms")


def read(spark, path: str) -> DataFrame:
    """Cues of all files under path; media_id is the file's path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("media_id"), "value")
    return parse(files)


def render(turns: DataFrame, wrap: bool = False) -> DataFrame:
    """turns or cues (media_id, turn_idx, speaker, text, start_ms, end_ms; cue, if there is one) -> (media_id, value): one WebVTT text
    per recording; with wrap, texts on two lines."""
    text = X.wrapped(X.split_words(F.col("text"))) if wrap else X.squeeze(F.col("text"))
    cue = F.concat(X.timestamp(F.col("start_ms")), F.lit(" --> "), X.timestamp(F.col("end_ms")), F.lit("\n<v "), X.escape(F.col("speaker")), F.lit(">"), X.escape(text), F.lit("</v>"))
    order = [c for c in ("turn_idx", "cue") if c in turns.columns]
    g = turns.select("media_id", F.struct(*order).alias("at"), cue.alias("c")).groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("at", "c"))).alias("c"))
    return g.select("media_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("c", lambda x: x["c"]), "\n\n"), F.lit("\n")).alias("value"))


def result_json(turns: DataFrame) -> DataFrame:
    """(media_id, value): one nested result document per recording."""
    t = turns.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("turn_idx", "start_ms", "end_ms", "speaker", "text"))).alias("turns"), F.array_sort(F.collect_set("speaker")).alias("speakers"), F.max("end_ms").alias("duration_ms"))
    return t.select("media_id", F.to_json(F.struct(F.struct("duration_ms").alias("metadata"), "speakers", "turns")).alias("value"))


def synthetic(turns: DataFrame, every: int = 17) -> DataFrame:
    """(media_id, value): captions as foreign tools write them, for tests: CRLF, cue ids, entities, one name in every varied."""
    odd = F.pmod(F.col("media_id") + F.col("turn_idx"), F.lit(every)) == 0
    name = F.when(odd, F.concat("speaker", F.lit(" (guest)"))).otherwise(F.col("speaker"))
    plain = render(turns.withColumn("speaker", name).select("media_id", "turn_idx", "speaker", "text", "start_ms", "end_ms"))
    blocks = F.split("value", "\n\n")
    numbered = F.transform(blocks, lambda b, i: F.when(i > 0, F.concat(F.lit("cue-"), i.cast("string"), F.lit("\n"), b)).otherwise(b))
    return plain.select("media_id", F.replace(F.array_join(numbered, "\n\n"), F.lit("\n"), F.lit("\r\n")).alias("value"))
