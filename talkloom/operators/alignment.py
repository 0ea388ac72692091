"""Windowed sequence-alignment join of two readings of the same speech."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.operators import bulk
from talkloom.operators.folds import matches

WINDOW_MS, PAD_MS = 60_000, 10_000


def windows(rows: DataFrame) -> DataFrame:
    """rows with win, once for each window of 60 s whose padding their time t falls into."""
    return rows.withColumn("win", F.explode(F.sequence(F.floor((F.col("t") - PAD_MS) / WINDOW_MS), F.floor((F.col("t") + PAD_MS) / WINDOW_MS))))


def align(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """ours (media_id, i, w, t), theirs (media_id, i, w, t, owner) -> (media_id, i, tw, owner) of our words that match.

    Both sides stand in each window of 60 s whose padding they fall into; a window decides about the words whose own time is
    inside it, so that each word is matched once and work is linear in the recording's length. A window is a row, and many come
    in one Arrow batch.
    """

    def run(batch):
        (ea, a), (eb, b) = bulk.unlisted(batch.column("a")), bulk.unlisted(batch.column("b"))
        media, out = batch.column("media_id").to_pylist(), ([], [], [], [])
        for n, win in enumerate(batch.column("win").to_pylist()):
            p, q = ea[n], eb[n]
            for i, j in matches(a["w"][p : ea[n + 1]], b["w"][q : eb[n + 1]]):
                if a["t"][p + i] // WINDOW_MS == win:
                    for x, v in zip(out, (media[n], a["i"][p + i], b["i"][q + j], b["owner"][q + j]), strict=True):
                        x.append(v)
        return out

    a = bulk.dealt(windows(ours), "media_id", "win").groupBy("media_id", "win").agg(bulk.listed(["t", "i"], ["w"]).alias("a"))
    b = bulk.dealt(windows(theirs), "media_id", "win").groupBy("media_id", "win").agg(bulk.listed(["t", "i"], ["w", "owner"]).alias("b"))
    return bulk.mapped(a.join(b, ["media_id", "win"]), run, "media_id long, i long, tw long, owner string")
