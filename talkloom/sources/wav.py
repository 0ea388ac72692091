"""RIFF/WAV files as rows of samples, slices of them, and the loudest windows by prefix sums."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a window, between windows, and of a piece of samples.
WINDOW_S, HOP_S, PIECE_S = 30.0, 5.0, 5.0
SCHEMA = "path string, rate int, piece long, at long, samples array<float>"


def parse(raw: bytes, name: str = "") -> tuple[int, np.ndarray]:
    """(rate, mono samples as float32 in [-1, 1]) of a WAV file: 8, 16, 24 or 32 bit integers, or floats; channels are averaged."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError(f"{name}: no RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(raw):
        kind, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        body = raw[at + 8 : at + 8 + size]
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            form = (struct.unpack_from("<H", body, 24)[0] if code == 0xFFFE else code, channels, rate, bits)
        elif kind == b"data":
            if form is None:
                raise ValueError(f"{name}: data before its format")
            return form[2], _mono(body, *form, name)
        at += 8 + size + size % 2
    raise ValueError(f"{name}: no data")


def _mono(body: bytes, code: int, channels: int, rate: int, bits: int, name: str) -> np.ndarray:
    wide = bits // 8
    body = body[: len(body) // max(1, wide * channels) * wide * channels]  # a file that is cut short ends with a whole frame
    if code == 3 and bits in (32, 64):
        x = np.frombuffer(body, f"<f{wide}").astype(np.float64)
    elif code == 1 and bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(np.float64) - 128) / 128
    elif code == 1 and bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    elif code == 1 and bits in (16, 32):
        x = np.frombuffer(body, f"<i{wide}") / float(1 << (bits - 1))
    else:
        raise ValueError(f"{name}: format {code} with {bits} bits isn't read")
    return x.reshape(-1, channels).mean(axis=1).astype(np.float32)


def render(samples: np.ndarray, rate: int) -> bytes:
    """A mono file of 16-bit samples; of 32-bit floats on the same scale, where a sample is louder than 16 bits can say."""
    loud = len(samples) and (samples.max() > 32767 or samples.min() < -32768)
    code, wide = (3, 4) if loud else (1, 2)
    body = ((samples / 32768).astype("<f4") if loud else samples.astype("<i2")).tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, code, 1, rate, wide * rate, wide, 8 * wide) + b"data" + struct.pack("<I", len(body)) + body


def decode(files: DataFrame, rate: int | None = None, piece_s: float = PIECE_S) -> DataFrame:
    """files (path, content) -> (path, rate, piece, at, samples): pieces of piece_s seconds, the first sample of each at `at`. A file of
    another rate than the one asked for, or that isn't WAV, is an error; files without samples have no rows; null contents none."""

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if raw is None:
                    continue
                own, x = parse(raw, path)
                if rate is not None and own != rate:
                    raise ValueError(f"{path}: {own} samples a second, not {rate}")
                step = max(1, round(piece_s * own))
                for k in range(-(-len(x) // step)):
                    part = x[k * step : (k + 1) * step]
                    lists = pa.ListArray.from_arrays(np.array([0, len(part)], np.int32), pa.array(part))
                    yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([own], pa.int32()), pa.array([k], pa.int64()), pa.array([k * step], pa.int64()), lists], ["path", "rate", "piece", "at", "samples"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def load(spark, path: str, rate: int | None = None) -> DataFrame:
    """decode() of the .wav files under path."""
    return decode(spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content"), rate)


def slices(pieces: DataFrame, start_s: float, end_s: float) -> DataFrame:
    """(path, rate, samples): samples from one time to another, whose times go to the nearest sample (half to even); none beyond the end."""
    lo, hi = (F.bround(F.lit(float(t)) * F.col("rate")).cast("long") for t in (start_s, end_s))
    first = F.greatest(F.lit(0).cast("long"), lo - F.col("at"))
    n = F.greatest(F.lit(0).cast("long"), F.least(F.size("samples").cast("long"), hi - F.col("at")) - first)
    part = F.slice("samples", (first + 1).cast("int"), n.cast("int"))
    p = pieces.where((F.col("at") < hi) & (F.col("at") + F.size("samples") > lo)).select("path", "rate", "at", part.alias("part"))
    return p.groupBy("path", "rate").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("samples"))


def _squares(samples) -> F.Column:
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def loudest_windows(pieces: DataFrame, n: int, window_s: float = WINDOW_S, hop_s: float = HOP_S) -> DataFrame:
    """(path, bucket, start, rms): of each of a file's n equal buckets (as many as windows fit, if fewer) the loudest window that begins in
    it at steps of hop_s, if it isn't among the quietest fifth of all; start 0 for a file no longer than a window, or where none is left.

    Squares are summed for each piece and over the pieces before it; a window's is the difference of two prefix sums, of which
    each looks into one piece only. No task holds more of a file than a piece."""
    sums = pieces.select("path", "rate", "piece", "at", "samples", F.size("samples").alias("size"), _squares(F.col("samples")).alias("own"))
    before = Window.partitionBy("path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0.0)))
    files = sums.groupBy("path").agg(F.max("rate").alias("rate"), F.max(F.col("at") + F.col("size")).alias("len"), F.max("piece").alias("last"), F.max("size").alias("step"))
    files = files.withColumns({"win": F.floor(window_s * F.col("rate")), "hop": F.floor(hop_s * F.col("rate"))})
    long = files.where(F.col("len") / F.col("rate") > window_s).withColumn("n", F.greatest(F.lit(1), F.least(F.lit(n), F.floor(F.col("len") / F.col("rate") / window_s).cast("int"))))
    bucket = long.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    edge = lambda b: F.floor(b * (F.col("len") / F.col("rate") / F.col("n")) * F.col("rate"))
    bucket = bucket.withColumns({"lo": edge(F.col("bucket")), "hi": F.least(F.col("len") - F.col("win"), edge(F.col("bucket") + 1))}).where("hi > lo")
    fine = bucket.withColumn("pos", F.explode(F.sequence("lo", "hi", "hop")))
    coarse = long.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.col("len") - F.col("win")) - 1, F.greatest("hop", F.floor(F.col("win") / 2))))).withColumn("bucket", F.lit(-1))
    asked = fine.select("path", "bucket", "pos", "win", "last", "step").unionByName(coarse.select("path", "bucket", "pos", "win", "last", "step"))
    ends = asked.select("path", "bucket", "pos", "win", "last", "step", F.explode(F.array(F.struct(F.col("pos").alias("p"), F.lit(-1.0).alias("sign")), F.struct((F.col("pos") + F.col("win")).alias("p"), F.lit(1.0).alias("sign")))).alias("e"))
    ends = ends.select("path", "bucket", "pos", "win", "e.*", F.least("last", F.floor(F.col("e.p") / F.col("step"))).alias("piece"))
    upto = F.col("before") + _squares(F.slice("samples", F.lit(1), F.least(F.col("p") - F.col("at"), F.col("size").cast("long")).cast("int")))
    got = ends.join(sums, ["path", "piece"]).groupBy("path", "bucket", "pos", "win").agg(F.sum(F.col("sign") * upto).alias("sq"))
    got = got.withColumn("rms", F.sqrt(F.greatest(F.lit(0.0), F.col("sq")) / F.col("win") + 1e-12))
    floor = got.where("bucket < 0").groupBy("path").agg(F.percentile("rms", F.lit(0.2)).alias("quiet"))
    best = got.where("bucket >= 0").groupBy("path", "bucket").agg(F.min_by(F.struct("pos", "rms"), F.struct((-F.round("rms", 9)).alias("r"), "pos")).alias("b"))
    best = best.join(floor, "path").where("b.rms >= quiet").select("path", F.col("bucket").cast("long").alias("bucket"), F.col("b.pos").alias("pos"), F.col("b.rms").alias("rms"))
    none = files.join(best.select("path").distinct(), "path", "left_anti").select("path", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("double").alias("rms"))
    return best.unionByName(none).join(files.select("path", "rate"), "path").select("path", "bucket", (F.col("pos") / F.col("rate")).alias("start"), "rms")


def rendered(samples, rate: int) -> F.Column:
    """The WAV file of an array of samples, of which 32768 is full scale."""
    return F.pandas_udf(lambda s: pd.Series([render(np.asarray(x), rate) for x in s]), "binary")(samples)
