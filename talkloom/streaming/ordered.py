"""Folds over a key's rows in event-time order, on a stream: rows wait in list state until the watermark has passed them.

Whatever the files, micro-batches and restarts, a key's rows are folded in order of (time, seq), so that each stream gives what
its batch twin gives. Rows later than the watermark are dropped by Spark. State: a key's waiting rows, bounded by the watermark's
delay, and what the fold remembers. Timers end what has been silent for long; they work by event time (time to live of state
goes by the wall clock, and would make results depend on it). The session has to use the RocksDB state store, see `use_rocksdb`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from talkloom.operators.folds import MEMORY, MOST_SEEN

ENDED = ("done", "error")
SILENCE_MS, TURN_GAP_MS = 600_000, 800


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that timers and several states of one operator need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """A fold over rows (at_us, seq, *fields). Subclasses say what they remember and what a row, and silence, make of it."""

    fields: str  # of a waiting row after at_us and seq
    columns: list[str]  # of the result, without the key's

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at_us long, seq long, {self.fields}")
        self.remember(handle)

    def remember(self, handle) -> None:
        raise NotImplementedError

    def take(self, row: tuple) -> list[tuple]:
        """Result rows of the next row."""
        raise NotImplementedError

    def ends_at(self) -> int | None:
        """The millisecond after which the key is over if no row comes; None if it isn't open."""
        return None

    def end(self) -> list[tuple]:
        """Result rows of the key's end; its memory goes."""
        return []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(None if x is None or x != x else x for x in r) for p in rows for r in p.itertuples(index=False, name=None)]
        self.waiting.appendList([(int(r[len(key)]), int(r[len(key) + 1]), *r[len(key) + 2 :]) for r in new])
        due = min(int(r[len(key)]) for r in new) // 1000 + 1
        if not any(t <= due for t in self.handle.listTimers()):
            self.handle.registerTimer(due)
        yield self.table(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto, out = timerValues.getCurrentWatermarkInMs(), []
        rows = sorted(map(tuple, self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] // 1000 < upto]  # rows of the watermark's own millisecond may still come
        for r in ready:
            if (end := self.ends_at()) is not None and r[0] // 1000 > end:
                out += self.end()
            out += self.take(r)
        if ready:
            self.waiting.put(rows[len(ready) :]) if len(ready) < len(rows) else self.waiting.clear()
        if (end := self.ends_at()) is not None and end < upto:
            out += self.end()
        later = [rows[len(ready)][0] // 1000 + 1] if len(ready) < len(rows) else []
        if (end := self.ends_at()) is not None:
            later.append(end + 1)
        if later:
            self.handle.registerTimer(min(later))
        yield self.table(key, out)

    def table(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*self.keys, *self.columns]).astype(object)

    def __init__(self, keys: list[str]):
        self.keys = keys

    def close(self) -> None:
        pass


def _run(rows: DataFrame, keys: list[str], at: str, seq: str, fields: list, processor: InOrder, result: str, late: str) -> DataFrame:
    timed = rows.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    timed = timed.select(*keys, F.unix_micros("__at").alias("at_us"), F.col(seq).cast("long").alias("seq"), *fields, "__at")
    return timed.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=result, outputMode="Append", timeMode="EventTime")


class _Feed(InOrder):
    fields = "status string, stage string, progress double"
    columns = ["at_us", "seq", "status", "stage", "progress"]

    def __init__(self, keys, silence_ms: int):
        super().__init__(keys)
        self.silence_ms = silence_ms

    def remember(self, handle) -> None:
        self.last = handle.getValueState("last", "at_us long, status string, stage string, progress double, over boolean")

    def take(self, row) -> list[tuple]:
        at, seq, status, stage, progress = row[:5]
        last = self.last.get() if self.last.exists() else None
        over = bool(last and last[4])
        new = not over and (last is None or tuple(last[1:4]) != (status, stage, progress))
        self.last.update((at, status, stage, progress, over or status in ENDED))
        return [(at, seq, status, stage, progress)] if new else []

    def ends_at(self) -> int | None:
        return self.last.get()[0] // 1000 + self.silence_ms if self.last.exists() else None

    def end(self) -> list[tuple]:
        at, over = self.ends_at(), self.last.get()[4]
        self.last.clear()
        return [] if over else [(at * 1000, None, "gone", None, None)]


def job_feed(events: DataFrame, silence_ms: int = SILENCE_MS, late: str = "10 minutes") -> DataFrame:
    """A stream of events (job, seq, at, status, stage, progress) -> what a follower of a job is told: (job, at_us, seq, status, stage,
    progress) where status, stage or progress (to three digits) change, nothing after done or error, and `gone` once a job has
    been silent for silence_ms; what comes after that is a new life of the job."""
    fields = ["status", "stage", F.round("progress", 3).alias("progress")]
    return _run(events, ["job"], "at", "seq", fields, _Feed(["job"], silence_ms), "job long, at_us long, seq long, status string, stage string, progress double", late)


def job_feed_batch(events: DataFrame, silence_ms: int = SILENCE_MS, until_us: int | None = None) -> DataFrame:
    """What job_feed() gives, of a table; with until_us, as of that watermark. Null jobs are one job, as in the stream; equal (at, seq)
    stand in no order."""
    e = events.select("job", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), F.col("seq").cast("long").alias("seq"), "status", "stage", F.round("progress", 3).alias("progress"))
    if until_us is not None:
        e = e.where(F.expr("at_us div 1000") < until_us // 1000)
    w = Window.partitionBy("job").orderBy("at_us", "seq")
    new = F.coalesce(F.expr("at_us div 1000") - F.lag(F.expr("at_us div 1000")).over(w) > silence_ms, F.lit(True))
    e = e.withColumn("new", new).withColumn("life", F.sum(F.col("new").cast("long")).over(w))
    life = Window.partitionBy("job", "life").orderBy("at_us", "seq")
    told = F.struct("status", "stage", "progress")
    ended = F.coalesce(F.col("status").isin(*ENDED), F.lit(False))
    e = e.withColumns({"over": F.coalesce(F.max(ended).over(life.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)), "change": F.col("new") | ~told.eqNullSafe(F.lag(told).over(life)), "ended": ended})
    out = e.where(~F.col("over") & F.col("change")).select("job", "at_us", "seq", "status", "stage", "progress")
    gone = e.groupBy("job", "life").agg(F.max(F.expr("at_us div 1000")).alias("ms"), F.max("ended").alias("ended")).withColumn("ms", F.col("ms") + silence_ms)
    if until_us is not None:
        gone = gone.withColumn("last", F.max("life").over(Window.partitionBy("job"))).where((F.col("ms") < until_us // 1000) | (F.col("life") < F.col("last")))
    gone = gone.where("not ended")
    return out.unionByName(gone.select("job", (F.col("ms") * 1000).alias("at_us"), F.lit(None).cast("long").alias("seq"), F.lit("gone").alias("status"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("double").alias("progress")))


class _Repeats(InOrder):
    fields = "norm string, text string"
    columns = ["seq", "text"]

    def remember(self, handle) -> None:
        self.kept = handle.getListState("kept", "norm string")

    def take(self, row) -> list[tuple]:
        _, seq, norm, text = row[:4]
        kept = [x[0] for x in self.kept.get()] if self.kept.exists() else []
        if norm and kept.count(norm) >= MOST_SEEN:
            return []
        self.kept.put([(x,) for x in [*kept, norm or ""][-MEMORY:]])
        return [(seq, text)]


def drop_repeats(lines: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of lines (media_id, seq, at, norm, text) without those that a recording's last MEMORY kept ones have MOST_SEEN times;
    lines without a word stay: (media_id, seq, text)."""
    return _run(lines, ["media_id"], "at", "seq", ["norm", "text"], _Repeats(["media_id"]), "media_id long, seq long, text string", late)


class _Turns(InOrder):
    fields = "speaker string, end_us long, text string"
    columns = ["seq", "speaker", "start_us", "end_us", "text"]

    def __init__(self, keys, gap_ms: int):
        super().__init__(keys)
        self.gap_ms = gap_ms

    def remember(self, handle) -> None:
        self.open = handle.getValueState("open", "seq long, speaker string, start_us long, end_us long, text string")

    def take(self, row) -> list[tuple]:
        at, seq, speaker, end, text = row[:5]
        held = self.open.get() if self.open.exists() else None
        if held and held[1] == speaker and at - held[3] <= self.gap_ms * 1000:
            self.open.update((held[0], speaker, held[2], max(held[3], end), f"{held[4]} {text}"))
            return []
        self.open.update((seq, speaker, at, end, text))
        return [tuple(held)] if held else []

    def ends_at(self) -> int | None:
        return self.open.get()[3] // 1000 + self.gap_ms + 1 if self.open.exists() else None

    def end(self) -> list[tuple]:
        held = tuple(self.open.get())
        self.open.clear()
        return [held]


def assemble_turns(pieces: DataFrame, gap_ms: int = TURN_GAP_MS, late: str = "10 minutes") -> DataFrame:
    """A stream of pieces (media_id, seq, speaker, at, end_at, text) -> turns (media_id, seq, speaker, start_us, end_us, text): pieces of
    one speaker that follow one another at most gap_ms after the turn's end are one turn; a turn is told once the watermark has
    passed its end by more than that, or when the next begins. seq is its first piece's."""
    fields = ["speaker", F.unix_micros(F.col("end_at").cast("timestamp")).alias("end_us"), "text"]
    return _run(pieces, ["media_id"], "at", "seq", fields, _Turns(["media_id"], gap_ms), "media_id long, seq long, speaker string, start_us long, end_us long, text string", late)


def assemble_turns_batch(pieces: DataFrame, gap_ms: int = TURN_GAP_MS) -> DataFrame:
    """What assemble_turns() gives, of a table."""
    p = pieces.select("media_id", F.col("seq").cast("long").alias("seq"), "speaker", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), F.unix_micros(F.col("end_at").cast("timestamp")).alias("end_us"), "text")
    w = Window.partitionBy("media_id").orderBy("at_us", "seq")
    p = p.withColumn("other", ~F.coalesce(F.col("speaker") == F.lag("speaker").over(w), F.lit(False)))
    p = p.withColumn("run", F.sum(F.col("other").cast("long")).over(w))
    run = Window.partitionBy("media_id", "run").orderBy("at_us", "seq")
    reach = F.max("end_us").over(run.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("turn", F.sum(F.coalesce(F.col("at_us") - reach > gap_ms * 1000, F.lit(True)).cast("long")).over(w))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at_us", "seq", "text"))), lambda x: x["text"]), " ")
    return p.groupBy("media_id", "turn").agg(F.min_by("seq", F.struct("at_us", "seq")).alias("seq"), F.min("speaker").alias("speaker"), F.min("at_us").alias("start_us"), F.max("end_us").alias("end_us"), text.alias("text")).drop("turn")


def spoken_sessions(pieces: DataFrame, gap_ms: int = TURN_GAP_MS, late: str = "10 minutes") -> DataFrame:
    """Each speaker's stretches of speech, whoever else speaks meanwhile: (media_id, speaker, start_us, end_us, pieces). Session windows
    whose gap is each piece's own length and gap_ms, as silence counts from the end of a piece. Of streams and tables alike."""
    ms = (F.unix_micros(F.col("end_at").cast("timestamp")) - F.unix_micros("__at")).cast("long") / 1000
    p = pieces.withColumn("__at", F.col("at").cast("timestamp")).withWatermark("__at", late)
    gap = F.concat((ms.cast("long") + gap_ms).cast("string"), F.lit(" milliseconds"))
    g = p.groupBy(F.session_window("__at", gap).alias("w"), "media_id", "speaker").agg(F.max("end_at").alias("end_at"), F.count("*").alias("pieces"))
    return g.select("media_id", "speaker", F.unix_micros("w.start").alias("start_us"), F.unix_micros(F.col("end_at").cast("timestamp")).alias("end_us"), "pieces")
