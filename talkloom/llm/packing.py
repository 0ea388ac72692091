"""Conflict-constrained best-fit packing.

Documents are cut into pieces of the capacity at most and packed, longest first. Open bins stand in the order of their room;
the search starts at the tightest bin that holds the piece and goes on to the next until one is compatible, and opens a new
bin if none is. Each bin carries a bitmap of its duplicate clusters (each at most once) and PER_SOURCE bitmaps of its sources
(bit s of the j-th is set when j + 1 pieces come from source s). Shards of SHARD_ROWS rows are packed on their own, so that
memory and time of a task stay the same at any size.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import n_words, written

CAPACITY, PER_SOURCE, SHARD_ROWS = 4096, 4, 16_384
SCHEMA = "doc_id long, piece int, start_word long, n_words long, bin_id long, bin_offset long"


def pack_rows(rows: list[tuple], capacity: int, per_source: int, shard: int = 0) -> list[tuple]:
    """rows (doc_id, size, source, cluster) -> (doc_id, piece, start_word, n_words, bin_id, bin_offset)."""
    pieces = []
    for d, n, source, cluster in rows:
        for k, at in enumerate(range(0, max(n, 1), capacity)):
            pieces.append((-min(capacity, n - at), d is None, d or 0, k, at, source, cluster))
    pieces.sort(key=lambda p: (*p[:5], p[5] is None, p[5] or "", p[6]))
    least = -pieces[-1][0] if pieces else 0
    sources: dict = {}
    clusters: dict = {}
    open_bins: list[tuple[int, int]] = []  # (room, bin), ascending
    seen: list[int] = []
    planes: list[list[int]] = []
    out = []
    for length, no_id, d, k, at, source, cluster in pieces:
        n = -length
        s, c = 1 << sources.setdefault(source, len(sources)), 1 << clusters.setdefault(cluster, len(clusters))
        i = bisect_left(open_bins, (n, -1))
        while i < len(open_bins) and (seen[open_bins[i][1]] & c or planes[open_bins[i][1]][-1] & s):
            i += 1
        if i < len(open_bins):
            room, b = open_bins.pop(i)
        else:
            room, b = capacity, len(seen)
            seen.append(0)
            planes.append([0] * per_source)
        seen[b] |= c
        for j, plane in enumerate(planes[b]):
            if not plane & s:
                planes[b][j] |= s
                break
        if room - n >= least:
            insort(open_bins, (room - n, b))
        out.append((None if no_id else d, k, at, n, (shard << 32) | b, capacity - room))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, per_source: int = PER_SOURCE, cluster_col: str | None = None) -> DataFrame:
    """One row for each piece of each document: its words from start_word on, its bin and its place there.

    A duplicate cluster is the documents whose words agree but for case and white space, or those that agree in cluster_col, such
    as the classes of near duplicates; pieces of one document are of one cluster too. Null and empty texts have one piece of 0 words; a null source is a source. Repeated rows are packed each, in
    different bins. An empty table gives no rows. Other columns aren't read.
    """
    from pyspark import TaskContext

    text = F.col(f"`{text_col}`")
    same = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " ")) if cluster_col is None else F.col(f"`{cluster_col}`")
    meta = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), n_words(text).alias("size"), F.col(f"`{source_col}`").cast("string").alias("source"), F.xxhash64(same).alias("cluster"))
    meta = written(meta, "sizes")
    shards = max(1, -(-meta.count() // SHARD_ROWS))

    def run(frames):
        rows = [r for f in frames for r in zip(f["doc_id"].astype("object").where(f["doc_id"].notna(), None), f["size"], f["source"].where(f["source"].notna(), None), f["cluster"], strict=True)]
        if rows:
            packed = pack_rows([(None if d is None else int(d), int(n), s, int(c)) for d, n, s, c in rows], capacity, per_source, TaskContext.get().partitionId())
            out = pd.DataFrame(packed, columns=["doc_id", "piece", "start_word", "n_words", "bin_id", "bin_offset"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return meta.repartition(shards).mapInPandas(run, SCHEMA)
