"""Transcripts in DOCX: paragraphs with `Name  M:SS` header lines."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
HEADER = r"^(.*?)\s{1,}((?:\d{1,2}:)?\d{1,2}:\d{2})\s*$"


def paragraphs(content: bytes) -> list[str]:
    """Paragraph texts of a document; none if it isn't one."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    return ["".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in root.iter(f"{_W}p")]


def parse(files: DataFrame) -> DataFrame:
    """files (media_id, content) -> cues. A header sets the speaker and time of the lines after it. A cue ends where the next
    one begins, half a second after its start at least and a minute at most; the last lasts 5 seconds."""

    def read(frames):
        for f in frames:
            rows = [(m, i, t) for m, c in zip(f["media_id"], f["content"], strict=True) for i, t in enumerate(paragraphs(bytes(c))) if t]
            yield pd.DataFrame(rows, columns=["media_id", "i", "line"])

    lines = files.select("media_id", "content").mapInPandas(read, "media_id string, i long, line string")
    time = F.split(F.regexp_extract("line", HEADER, 2), ":")
    seconds = F.aggregate(time, F.lit(0).cast("long"), lambda a, x: a * 60 + x.cast("long"))
    head = F.when(F.col("line").rlike(HEADER), F.struct(F.regexp_extract("line", HEADER, 1).alias("speaker"), (seconds * 1000).alias("start_ms")))
    w = Window.partitionBy("media_id").orderBy("i")
    x = lines.withColumn("head", head).withColumn("h", F.last("head", ignorenulls=True).over(w)).where("head is null and h is not null")
    x = x.select("media_id", "i", "h.speaker", "h.start_ms", F.col("line").alias("text"))
    following = F.lead("start_ms").over(Window.partitionBy("media_id").orderBy("start_ms", "i"))
    end = F.when(following.isNull(), F.col("start_ms") + 5000).otherwise(F.greatest(F.col("start_ms") + 500, F.least(following, F.col("start_ms") + 60_000)))
    return x.withColumn("end_ms", end).select("media_id", "i", "speaker", "text", "start_ms", "end_ms")
