"""Streams against their batch twins: late and reordered files, several micro-batches, a restart; changelogs and their compaction."""

import random

import pytest
from pyspark.sql import functions as F

from talkloom.operators import changelog, folds
from talkloom.plans import streams
from talkloom.streaming import ordered

D = "/root/testdata/sf0.001"
LATE = "400 days"  # rows come in any order, so that none is too late


@pytest.fixture(scope="module")
def stateful(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    ordered.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)


def run(spark, tmp_path, rows, make, last, late, files=3, restart=True, shuffled=True):
    """make(stream, late) over rows in several files, each a micro-batch, in no order; with a stop between. last: a row far in the future,
    which ends what is open."""
    rows = rows.collect()
    if shuffled:
        random.Random(3).shuffle(rows)
    schema, src, out, check = last.schema, tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()

    def put(i, part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        q = make(stream, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None

    for i in range(files):
        put(i, rows[i::files] if shuffled else rows[i * len(rows) // files : (i + 1) * len(rows) // files])
        if i == files // 2 and restart:
            go()
    put(files, last.collect())
    go()
    go()
    return spark.read.parquet(out)


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_feed_equals_batch(stateful, tmp_path):
    spark = stateful
    e = streams.job_events(spark, D).where("job < 6").withColumn("at", F.col("at").cast("timestamp"))
    last = spark.createDataFrame([(-1, -1, None, "running", "asr", 0.0)], e.schema).withColumn("at", F.lit("2031-01-01").cast("timestamp"))
    last = spark.createDataFrame(last.collect(), e.schema)
    got = run(spark, tmp_path, e, lambda s, late: ordered.job_feed(s, streams.SILENCE_MS, late), last, LATE)
    want = ordered.job_feed_batch(e, streams.SILENCE_MS)
    assert rows_of(got.where("job >= 0").select(want.columns)) == rows_of(want)
    assert want.where("status = 'gone'").count() > 0 and got.where("job < 0").count() == 0


def test_duplicates_equal_the_fold(stateful, tmp_path):
    spark, r = stateful, random.Random(8)
    rows = [(m, i, r.choice(["a b", "c", "", "d e", None, "c c"])) for m in range(4) for i in range(60)]
    lines = spark.createDataFrame(rows, "media_id long, seq long, text string").withColumns({"at": F.timestamp_seconds(F.col("seq") * 5 + 1_700_000_000), "norm": F.coalesce("text", F.lit(""))}).select("media_id", "seq", "at", "norm", "text")
    last = spark.createDataFrame([(-1, 0, __import__("datetime").datetime(2031, 1, 1), "x", "x")], lines.schema)
    got = run(spark, tmp_path, lines, ordered.drop_repeats, last, LATE)
    want = []
    for m in range(4):
        own = [x for x in rows if x[0] == m]
        want += [(m, i, t) for (_, i, t), ok in zip(own, folds.keep_lines([t or "" for _, _, t in own])) if ok]
    assert sorted((x.media_id, x.seq, x.text or "") for x in got.where("media_id >= 0").collect()) == sorted((m, i, t or "") for m, i, t in want)
    assert len(want) < len(rows)


def test_turns_equal_batch(stateful, tmp_path):
    spark = stateful
    p = streams.speech_pieces(spark, D).where("media_id < 6").select("media_id", "seq", "at", "end_at", "speaker", "text")
    far = __import__("datetime").datetime(2031, 1, 1)
    last = spark.createDataFrame([(-1, 0, far, far, "A", "x")], p.schema)
    got = run(spark, tmp_path, p, lambda s, late: ordered.assemble_turns(s, streams.GAP_MS, late), last, "45 days", files=2)
    want = ordered.assemble_turns_batch(p, streams.GAP_MS)
    assert rows_of(got.where("media_id >= 0").select(want.columns)) == rows_of(want)


def test_sessions_equal_batch(stateful, tmp_path):
    spark = stateful
    p = streams.speech_pieces(spark, D).where("media_id < 6").select("media_id", "seq", "at", "end_at", "speaker", "text")
    far = __import__("datetime").datetime(2031, 1, 1)
    last = spark.createDataFrame([(-1, 0, far, far, "A", "x")], p.schema)
    got = run(spark, tmp_path, p, lambda s, late: ordered.spoken_sessions(s, streams.GAP_MS, late), last, LATE, files=2, restart=False)
    want = ordered.spoken_sessions(p, streams.GAP_MS)
    assert rows_of(got.where("media_id >= 0").select(want.columns)) == rows_of(want)


def test_feed_by_hand(spark):
    rows = [("done", 1), ("done", 2), ("running", 3), ("running", 30), ("running", 31), ("error", 32), ("error", 60), ("queued", 100)]
    e = spark.createDataFrame([(1, i, s, "x", 0.1234567 if i else 0.12349, t) for i, (s, t) in enumerate(rows)], "job long, seq long, status string, stage string, progress double, t long").withColumn("at", F.timestamp_seconds("t"))
    got = sorted((r.at_us // 10**6, r.status) for r in ordered.job_feed_batch(e, 10_000).collect())
    assert got == [(1, "done"), (30, "running"), (32, "error"), (60, "error"), (100, "queued"), (110, "gone")]
    assert ordered.job_feed_batch(e, 10_000, 105 * 10**6).where("status = 'gone'").count() == 0
    assert ordered.job_feed_batch(e.limit(0), 10_000).count() == 0


def test_changelog_by_hand_and_compaction(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.randrange(5), i, r.choice([None, "a", "b"]), r.choice([None, None, float(i)])) for i in range(200)] + [(9, 500, None, None)]
    u = spark.createDataFrame(rows, "id long, seq long, status string, score double")
    fields = ["status", "score"]

    def brute(upto):
        out = {}
        for i, seq, a, b in rows:
            if seq <= upto and (a is not None or b is not None):
                old = out.get(i, (None, None))
                out[i] = (a if a is not None else old[0], b if b is not None else old[1])
        return out

    for upto in (0, 10, 77, 1000):
        got = {x.id: (x.status, x.score) for x in changelog.state_at(u, "id", "seq", fields, upto).collect()}
        assert got == brute(upto)
    parts = [u.where("seq % 3 = 1"), u.where("seq % 3 = 0"), u.where("seq % 3 = 2"), u.limit(50)]  # out of order, and some again
    for n, p in enumerate(parts):
        snapshot = changelog.write_compacted(spark, str(tmp_path / "log"), changelog.deltas(p, "id", "seq", fields), "id", fields, n)
    assert {x.id: (x.status, x.score) for x in changelog.state(snapshot, "id", fields).collect()} == brute(1000)
    assert snapshot.count() == snapshot.select("id").distinct().count()
