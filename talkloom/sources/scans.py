"""Readers of result folders, recogniser output, media probes and frame logs; JSON-lines audit; checks of artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.functions import text as X

RESULT = """name_map map<string, string>, speakers array<string>, turns array<struct<turn_idx: long, start_ms: long, end_ms: long, speaker: string, text: string, language: string>>,
 metadata struct<duration_ms: long, generated_at: string, source: struct<name: string, has_video: boolean>, languages: struct<shares: map<string, double>>, speakers_from: struct<source: string>, llm: struct<mode: string>>"""
# fixed values: codecs of pictures in sound files
COVER_ART = ["mjpeg", "png", "bmp", "gif", "webp"]
_PROBE = """streams array<struct<codec_type: string, codec_name: string, sample_rate: string, channels: int, width: int, height: int, duration: string, disposition: struct<attached_pic: int>>>,
 `format` struct<duration: string, format_name: string, bit_rate: string, size: string>"""
_PTS = r"pts_time:\s*([0-9.]+)"
_TIMES = r"(?m)^(\d{2}:\d{2}:\d{2}[.,]\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}[.,]\d{3})"
# fixed values: a turn's heading in Markdown; hours have two digits or more
_HEADING = r"(?m)^## \[\d{2,}:\d{2}:\d{2}\] "


def summaries(files: DataFrame) -> DataFrame:
    """files (name, value): whole result documents -> one row of summary each, the newest first; unreadable ones are left out."""
    r = files.select("name", F.from_json("value", RESULT).alias("r")).where("r is not null and (r.turns is not null or r.metadata is not null)")
    m = F.col("r.metadata")
    count = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("long")
    return r.select(
        "name", F.coalesce(m["source"]["name"], F.col("name")).alias("title"), F.coalesce(m["duration_ms"], F.lit(0)).alias("duration_ms"), count(F.col("r.turns")).alias("turns"), count(F.col("r.speakers")).alias("speakers"),
        m["languages"]["shares"].alias("languages"), F.coalesce(m["speakers_from"]["source"], F.lit("?")).alias("speakers_from"), F.coalesce(m["llm"]["mode"], F.lit("")).alias("llm"), F.coalesce(m["generated_at"], F.lit("")).alias("generated_at"), F.coalesce(m["source"]["has_video"], F.lit(False)).alias("has_video"),
    ).orderBy(F.desc("generated_at"), "name")


def result_folders(spark: SparkSession, root: str) -> DataFrame:
    """summaries() of root/*/result.json; a result's name is its folder's."""
    files = spark.read.text(f"{root}/*/result.json", wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("name"), "value")
    return summaries(files)


def without_words(turns: Column) -> Column:
    """Turns without their words."""
    return F.transform(turns, lambda t: t.dropFields("words"))


def recogniser_json(files: DataFrame) -> DataFrame:
    """files (media_id, value): documents with transcription[].offsets in milliseconds -> segments."""
    doc = F.from_json("value", "transcription array<struct<offsets: struct<`from`: long, `to`: long>, text: string>>")
    s = files.select("media_id", F.posexplode(doc["transcription"]).alias("seg_idx", "s"))
    at = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return s.select("media_id", F.col("seg_idx").cast("long").alias("seg_idx"), at("s.offsets.from").alias("start_ms"), at("s.offsets.to").alias("end_ms"), F.trim(F.coalesce("s.text", F.lit(""))).alias("text"))


def run_segments(segments: DataFrame, runs: DataFrame, least_ms: int = 500) -> DataFrame:
    """Segments (media_id, run, text, language, start_ms, end_ms: from the run's start) on the recording's time. Runs shorter than
    least_ms and blank segments are left out; a segment without a language has its run's. runs: media_id, run, run_language, run_start, run_end."""
    r = runs.where(F.col("run_end") - F.col("run_start") >= least_ms)
    x = segments.join(r, ["media_id", "run"]).withColumn("text", F.trim("text")).where("text <> ''")
    return x.select("media_id", "run", (F.col("start_ms") + F.col("run_start")).alias("start_ms"), (F.col("end_ms") + F.col("run_start")).alias("end_ms"), "text", F.coalesce(F.when(F.col("language") != "", F.col("language")), "run_language").alias("language"))


def media_probe(files: DataFrame) -> DataFrame:
    """files (media_id, value): probe documents -> sound and picture properties of each with a sound stream. Cover art is no video."""
    p = files.select("media_id", F.from_json("value", _PROBE).alias("p"))
    of = lambda kind: F.get(F.filter("p.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    p = p.withColumns({"a": of("audio"), "v": of("video")}).where("a is not null")
    real = F.col("v").isNotNull() & (F.coalesce(F.col("v.disposition.attached_pic"), F.lit(0)) == 0) & ~F.coalesce(F.col("v.codec_name").isin(COVER_ART), F.lit(False))
    return p.select(
        "media_id", F.coalesce(F.nullif("p.format.duration", F.lit("")), "a.duration", F.lit("0")).cast("double").alias("duration"), F.coalesce("a.codec_name", F.lit("?")).alias("codec"), F.coalesce(F.col("a.sample_rate").cast("int"), F.lit(0)).alias("sample_rate"), F.coalesce("a.channels", F.lit(0)).alias("channels"),
        real.alias("has_video"), F.when(real, F.coalesce("v.codec_name", F.lit("?"))).alias("video_codec"), F.when(real, F.coalesce("v.width", F.lit(0))).alias("width"), F.when(real, F.coalesce("v.height", F.lit(0))).alias("height"),
    )


def frame_times(logs: DataFrame) -> DataFrame:
    """logs (media_id, value, files array<string>, start_ms) -> frames: the logged times in order, paired with the sorted files as far as both go."""
    t = F.transform(F.regexp_extract_all("value", F.lit(_PTS), F.lit(1)), lambda x: F.round(x.cast("double") * 1000).cast("long"))
    f = logs.select("media_id", "start_ms", F.arrays_zip(F.sort_array("files").alias("path"), t.alias("t")).alias("z"))
    x = f.select("media_id", "start_ms", F.posexplode("z").alias("frame", "z")).where("z.path is not null and z.t is not null")
    return x.select("media_id", "frame", "z.path", (F.col("z.t") + F.col("start_ms")).alias("t_ms"))


def write_audit(removed: DataFrame, path: str, append: bool = False) -> None:
    """Removed rows as JSON lines."""
    removed.write.mode("append" if append else "overwrite").json(path)


def check_lines(lines: DataFrame, schema: str) -> DataFrame:
    """lines (media_id, line_no, value) -> those that are no JSON objects of this schema, by number."""
    bad = F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    return lines.withColumn("p", bad).where("p is null or p._corrupt is not null").select("media_id", "line_no")


def missing_keys(files: DataFrame, required: list[str]) -> DataFrame:
    """(media_id, key): required keys that a document (media_id, value) lacks; all of them if it isn't one."""
    have = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    return files.select("media_id", F.explode(F.array_except(F.array(*map(F.lit, required)), have)).alias("key"))


def check_vtt(files: DataFrame) -> DataFrame:
    """files (media_id, value, duration_ms) -> counts of what is wrong with each: header, empty cues, overlaps, cues beyond the end."""
    pair = F.arrays_zip(F.regexp_extract_all("value", F.lit(_TIMES), F.lit(1)).alias("s"), F.regexp_extract_all("value", F.lit(_TIMES), F.lit(2)).alias("e"))
    cues = F.transform(pair, lambda x: F.struct(X.parse_timestamp(x["s"]).alias("s"), X.parse_timestamp(x["e"]).alias("e")))
    f = files.withColumn("cues", cues)
    fold = F.aggregate("cues", F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("n")), lambda a, c: F.struct(F.greatest(a["last"], c["e"]).alias("last"), (a["n"] + F.when(c["s"] < a["last"], 1).otherwise(0)).alias("n")))
    size = lambda c: F.size(c).cast("long")
    return f.select("media_id", F.col("value").startswith("WEBVTT").alias("header"), size(F.col("cues")).alias("cues"), size(F.filter("cues", lambda c: c["e"] <= c["s"])).alias("empty_cues"), fold["n"].alias("overlaps"), size(F.filter("cues", lambda c: c["e"] > F.col("duration_ms") + 2000)).alias("past"))


def check_markdown(files: DataFrame) -> DataFrame:
    """files (media_id, value) -> title, headings, and characters that stand for bytes that couldn't be read."""
    return files.select("media_id", F.col("value").startswith("# ").alias("title"), F.regexp_count("value", F.lit(_HEADING)).cast("long").alias("headings"), F.regexp_count("value", F.lit("�")).cast("long").alias("unreadable"))


# fixed values: letters with marks, and files that older versions wrote
ACCENTS = "ěščřžýáíéúůňťďóĚŠČŘŽÝÁÍÉÚŮŇŤĎÓ"
STALE = ["transcript.txt", "subtitles.srt", "subtitles.vtt", "minutes.docx", "speakers.json"]


def check_agreement(turns: DataFrame, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """What the artifacts of a recording disagree on: (media_id, fault, n), one row for each fault.

    turns (media_id, turn_idx, name, text, end_ms); artifacts (media_id, md, vtt, used_ms, full_ms); files (media_id, file). Faults:
    `headings` (n: headings in the Markdown, other than the turns), `names in md` (n: names that no line which begins with # has: words of
    the turns don't count, as a name may be a piece of one), `names in vtt` (n: names that aren't there), `text`
    (n: of the first six turns over 40 characters, those whose first five words aren't in the Markdown), `accents in md`, `accents in
    vtt` (n: letters with marks in the turns, none of which is left), `end` (n: how far the last turn ends beyond the transcribed
    span, where that's over 2 s), `duration` (n: whole length, which the Markdown states though over a second of it wasn't
    transcribed), and the name of each file left by an older version (n: 1). Null lengths count as 0, null texts as empty.
    """
    t = turns.withColumn("text", F.coalesce("text", F.lit("")))
    order = Window.partitionBy("media_id").orderBy("turn_idx")
    long = t.where(F.length("text") > 40).withColumn("r", F.row_number().over(order)).where("r <= 6")
    head = F.array_join(F.slice(X.split_words(F.col("text")), 1, 5), " ")
    heads = long.groupBy("media_id").agg(F.collect_list(head).alias("heads"))
    accents = t.select("media_id", F.explode(F.regexp_extract_all("text", F.lit(f"([{ACCENTS}])"), F.lit(1))).alias("c")).groupBy("media_id").agg(F.collect_set("c").alias("accents"))
    g = t.groupBy("media_id").agg(F.count("*").alias("turns"), F.collect_set("name").alias("names"), F.max_by("end_ms", "turn_idx").alias("end"))
    none = F.array().cast("array<string>")
    x = g.join(heads, "media_id", "left").join(accents, "media_id", "left").join(artifacts, "media_id")
    x = x.withColumns({c: F.coalesce(c, none) for c in ("heads", "accents")} | {c: F.coalesce(c, F.lit("")) for c in ("md", "vtt")} | {c: F.coalesce(c, F.lit(0)) for c in ("used_ms", "full_ms")})
    x = x.withColumn("plain", X.squeeze(F.col("md"))).withColumn("headings", F.regexp_count("md", F.lit(_HEADING)).cast("long"))
    lacking = lambda names, blob: F.size(F.filter(names, lambda v: ~F.contains(blob, v))).cast("long")
    count = lambda bad, n, fault: F.when(bad, F.struct(F.lit(fault).alias("fault"), n.cast("long").alias("n")))
    lost = lambda blob: (F.size("accents") > 0) & (lacking(F.col("accents"), blob) == F.size("accents"))
    part = (F.col("used_ms") > 0) & (F.col("full_ms") > 0) & (F.abs(F.col("used_ms") - F.col("full_ms")) > 1000)
    stated = F.regexp_extract("md", r"(?m)\*\*Duration:\*\* (\d+:\d{2}:\d{2})\s*$", 1) == X.clock(F.col("full_ms"))
    x = x.withColumn("named", F.array_join(F.regexp_extract_all("md", F.lit(r"(?m)^(#.*)"), F.lit(1)), "\n"))
    faults = [count(F.col("headings") != F.col("turns"), F.col("headings"), "headings")]
    for kind, places in (("md", "named"), ("vtt", "vtt")):
        faults.append(count(lacking(F.col("names"), F.col(places)) > 0, lacking(F.col("names"), F.col(places)), f"names in {kind}"))
        faults.append(count(lost(F.col(kind)), F.size("accents"), f"accents in {kind}"))
    faults.append(count(lacking(F.col("heads"), F.col("plain")) > 0, lacking(F.col("heads"), F.col("plain")), "text"))
    faults.append(count((F.col("used_ms") > 0) & (F.col("end") > F.col("used_ms") + 2000), F.col("end") - F.col("used_ms"), "end"))
    faults.append(count(part & stated, F.col("full_ms"), "duration"))
    found = x.select("media_id", F.inline(F.filter(F.array(*faults), lambda f: f.isNotNull())))
    return found.unionByName(files.where(F.col("file").isin(STALE)).select("media_id", F.col("file").alias("fault"), F.lit(1).cast("long").alias("n")))
