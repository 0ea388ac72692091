"""Transcript files as a data source: spark.read.format("transcript"), after register(spark).

The path is a file, or a folder that is read with all that it holds, but for names that begin with a dot or an underscore. Any
address that pyarrow knows can be given (a local or mounted folder, s3://, gs://, hdfs://). Files are dealt to partitions of about
`bytes` bytes (option, 32 MB) by size, and each is opened once. Cues are those of the readers in vtt and docx, in the order of their
starts; a cue without a speaker is the `speaker` option's (SPEAKER_00). A suffix other than .vtt and .docx, and a file without a
cue, are errors, or, with the options `unknown` and `empty` set to skip, are left out.
"""

from __future__ import annotations

import html
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from talkloom.sources import docx, vtt

SCHEMA = "media_id string, cue_idx long, speaker string, text string, start_ms long, end_ms long"
_VOICE = r"(?s)<v [^>]*>.*?(?:</v>|\Z)"


def _squeezed(text: str) -> str:
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")


def _ms(stamp: str) -> int:
    h, m, s = stamp.replace(",", ".").split(":")
    return (int(h) * 60 + int(m)) * 60_000 + round(float(s) * 1000)


def captions(content: bytes) -> list[tuple]:
    """(speaker, text, start_ms, end_ms) of a WebVTT file's cues; bytes that are no UTF-8 are replaced."""
    raw = re.sub("\r\n?", "\n", content.decode("utf-8", "replace").removeprefix("﻿"))
    out = []
    for block in re.split(r"\n[ \t\n\x0b\f\r]*\n", raw):
        time = re.search(vtt._TIME, block, re.ASCII)
        if time:
            body = block[time.end() :].partition("\n")[2]
            for voice in re.findall(_VOICE, body) or [body]:
                name = re.match("<v ([^>]*)>", voice)
                text = _squeezed(html.unescape(re.sub("<[^>]+>", "", voice)))
                who = re.sub("[<>`\r\n]", "", html.unescape(name[1])) if name else ""
                if text:
                    out.append((_squeezed(who), text, _ms(time[1]), _ms(time[2])))
    return sorted(out, key=lambda c: c[2])


def headed(content: bytes) -> list[tuple]:
    """The same of a DOCX file: a header line sets speaker and time of the lines after it, and the next cue's start ends one."""
    at, out = None, []
    for line in filter(None, docx.paragraphs(content)):
        head = re.match(docx.HEADER, line, re.ASCII)
        if head:
            seconds = 0
            for part in head[2].split(":"):
                seconds = 60 * seconds + int(part)
            at = (head[1], 1000 * seconds)
        elif at:
            out.append((at[0], line, at[1]))
    out.sort(key=lambda c: c[2])
    ends = [max(c[2] + 500, min(n[2], c[2] + 60_000)) for c, n in zip(out, out[1:])] + [c[2] + 5000 for c in out[-1:]]
    return [(*c, end) for c, end in zip(out, ends, strict=True)]


FORMATS = {".vtt": captions, ".docx": headed}


def _format(path: str):
    return FORMATS.get(os.path.splitext(path)[1].lower())


class Files(InputPartition):
    """The files of one task."""

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class TranscriptReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.speaker, self.size = options.get("path", ""), options.get("speaker", "SPEAKER_00"), int(options.get("bytes", 32 << 20))
        self.unknown, self.empty = options.get("unknown", "error"), options.get("empty", "error")
        if not self.path or not {self.unknown, self.empty} <= {"error", "skip"} or self.size <= 0:
            raise ValueError("a path is needed; unknown and empty are error or skip, and bytes is positive")

    def files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if re.match("[a-z0-9]+:", self.path) else (fs.LocalFileSystem(), os.path.abspath(self.path))

    def partitions(self) -> list[InputPartition]:
        store, root = self.files()
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"no such path: {self.path}")
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        shown = lambda f: not any(p[:1] in "._" for p in f.path[len(root) :].split("/") if p)
        found = sorted(((f.path, f.size or 0) for f in found if f.is_file and shown(f)))
        strange = [p for p, _ in found if not _format(p)]
        if strange and self.unknown == "error":
            raise ValueError(f"unsupported transcript format: {strange[:5]}; .vtt and .docx are read")
        parts, room = [], 0
        for path, size in found:
            if _format(path):
                if not parts or size > room:
                    parts.append([])
                    room = self.size
                parts[-1].append(path)
                room -= size
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self.files()
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                cues = _format(path)(f.read())
            if not cues and self.empty == "error":
                raise ValueError(f"no cues in {path}")
            speaker, text, start, end = (list(x) for x in zip(*cues)) if cues else ([], [], [], [])
            columns = [[path] * len(cues), range(len(cues)), [s if s.strip() else self.speaker for s in speaker], text, start, end]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            names = ["media_id", "cue_idx", "speaker", "text", "start_ms", "end_ms"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


class Transcripts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcript"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TranscriptReader:
        return TranscriptReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Transcripts)
