"""Kernels and sources behind the artifact queries, against plain rules."""

import json

import pytest

from talkloom.functions import forms
from talkloom.functions import text as X
from talkloom.operators import folds, temporal
from talkloom.plans import artifacts
from talkloom.sources import scans, vtt
from talkloom.stages import StageTables, TransientFailure, fingerprints


def test_word_classes(spark):
    from pyspark.sql import functions as F

    rows = [("a", "a", "identical"), ("být", "byt", "diacritic"), ("malý", "malej", "register"), ("já", "ty", "function"), ("projekt", "projektu", "inflection"), ("pes", "kočka", "different"), (None, "x", None)]
    got = spark.createDataFrame([r[:2] for r in rows], "a string, b string").select(forms.equivalence(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [r[2] for r in rows]
    pairs = [("já", "ty", False), ("abc", "xyz", False), ("pondělí", "pondeli", False), ("faktura", "kočka", True)]
    got = spark.createDataFrame([r[:2] for r in pairs], "a string, b string").select(forms.substantive(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [r[2] for r in pairs]
    assert spark.range(1).select(forms.slug(F.lit("Příliš  žluťoučký_kůň: 1.mp4"))).first()[0] == "prilis-zlutoucky-kun-1mp4"


def test_chunks_and_lines(spark):
    from pyspark.sql import functions as F

    for text in ("", "one", "word " * 60, "x" * 100 + " tail", "a " * 90):
        words = text.split()
        df = spark.createDataFrame([(words,)], "w array<string>")
        chunks = df.select(X.chunked(F.col("w"))).first()[0]
        assert " ".join(chunks).split() == words and all(len(c) <= 84 or " " not in c for c in chunks)
        assert all(len(a) + 1 + len(b.split()[0]) > 84 for a, b in zip(chunks, chunks[1:]))
        lines = df.select(X.wrapped(F.col("w"))).first()[0].split("\n")
        assert len(lines) <= 2 and " ".join(lines).split() == words and (len(lines[0]) <= 42 or " " not in lines[0])


def test_untimed_cues_share_the_time(spark):
    t = spark.createDataFrame([(1, 0, ("word " * 40).split(), 1000, 9000)], "media_id long, turn_idx long, toks array<string>, start_ms long, end_ms long")
    rows = sorted(map(tuple, artifacts.untimed(t).select("cue", "start_ms", "end_ms").collect()))
    assert rows[0][1] == 1000 and rows[-1][2] == 9000 and all(a[2] == b[1] for a, b in zip(rows, rows[1:]))


def test_captions():
    shown = folds.shown_captions([(0, "A window"), (10_000, "Other text 123"), (50_000, "A window!"), (60_000, "Something else"), (70_000, ""), (200_000, "Quite new")])
    assert shown == [True, False, False, True, False, True]
    assert folds.shown_captions([]) == []


def test_collapse_rows_prefers_like_voices_on_ties():
    from tests.test_folds import counts

    assert set(folds.collapse_rows(*counts(list("ABACBCAB")), {}, 3).values()) == set("ABC")
    to = folds.collapse_rows(*counts(list("ABCABC")), {"A": [1, 0], "B": [0, 1], "C": [0.1, 1]}, 2)
    assert len(set(to.values())) == 2
    tie = folds.collapse_rows(*counts(list("AXBXC")), {"A": [1, 0], "B": [0, 1], "C": [0, 2], "X": [1, 1]}, 3)  # A, B, C never meet
    assert tie["C"] == tie["B"] != tie["A"]


def test_token_times():
    assert folds.token_times(["a", "b", "c", "d"], [("a", 5), ("c", 50)], 0, 400) == [5, 150, 50, 350]
    assert folds.token_times(["q"], [], 0, 10) == [5]


def test_labels_by_overlap_then_nearest(spark):
    words = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 900, 1300), (1, 2, 5000, 5100), (1, 3, 1500, 1550)], "media_id long, k long, start_ms long, end_ms long")
    spans = spark.createDataFrame([(1, "a", 200, 1000), (1, "b", 1000, 1400), (1, "c", 1700, 2000)], "media_id long, label string, r_start long, r_end long")
    got = {r["k"]: r["assigned"] for r in temporal.assign_labels(words, spans, ["media_id", "k"]).collect()}
    assert got == {0: "a", 1: "b", 2: "c", 3: "b"}


def test_result_folders_skip_what_cannot_be_read(spark, tmp_path):
    for name, value in (("one", json.dumps({"metadata": {"generated_at": "2024-01-02", "source": {"name": "One"}}, "speakers": ["a"], "turns": [{"turn_idx": 0}]})), ("two", "{broken"), ("three", json.dumps({"metadata": {"generated_at": "2024-02-02"}, "turns": []}))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "result.json").write_text(value)
    (tmp_path / "empty").mkdir()
    got = scans.result_folders(spark, str(tmp_path)).collect()
    assert [(r["name"], r["title"], r["turns"], r["speakers"]) for r in got] == [("three", "three", 0, 0), ("one", "One", 1, 1)]


def test_reexport_keeps_stored_names(spark):
    doc = json.dumps({"name_map": {"A": "Jan", "B": "Eva"}, "turns": [{"turn_idx": 0, "start_ms": 0, "end_ms": 900, "speaker": "A", "text": "Hi."}, {"turn_idx": 1, "start_ms": 900, "end_ms": 1900, "speaker": "B", "text": "Yes."}]})
    out = artifacts.reexported(spark.createDataFrame([("m", doc)], "media_id string, value string"), {"B": "Petra", "A": " "})
    got = {r["artifact"]: r["value"] for r in out.collect()}
    assert "<v Jan>Hi." in got["vtt"] and "<v Petra>Yes." in got["vtt"] and "] Petra" in got["md"]


def test_audit_lines_append_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "empty")], "seg long, reason string")
    scans.write_audit(rows, str(tmp_path / "a"))
    scans.write_audit(rows, str(tmp_path / "a"), append=True)
    assert spark.read.json(str(tmp_path / "a")).count() == 2


def test_stage_tables_are_reused_until_settings_before_them_change(spark, tmp_path):
    built = []

    def build(name):
        built.append(name)
        return spark.range(3)

    def run(beam, gap, force=False):
        s = StageTables(spark, str(tmp_path), [("asr", {"beam": beam}), ("turns", {"gap": gap})], force)
        for name in ("asr", "turns"):
            assert s.table(name, lambda n=name: build(n)).count() == 3
        return s

    run(5, 800), run(5, 800)
    assert built == ["asr", "turns"]
    s = run(5, 900)
    assert built == ["asr", "turns", "turns"] and s.remove_stale("turns") == 1
    run(6, 900)
    assert built[-2:] == ["asr", "turns"] and fingerprints([("a", {})]) == fingerprints([("a", {})])

    def fails():
        raise TransientFailure(spark.range(1))

    s = StageTables(spark, str(tmp_path), [("llm", {})])
    assert s.table("llm", fails).count() == 1 and not s.fresh("llm")


def test_stream_join_and_sliding_windows_agree_with_batch(spark, tmp_path):
    from talkloom.streaming import jobs

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = jobs.followed_by(stream, "view", "purchase", "6 hours").writeStream.format("memory").queryName("pairs").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("pairs").collect())) == sorted(map(tuple, jobs.followed_by(e, "view", "purchase", "6 hours").collect()))
    done = jobs.work_through(stream, lambda b: jobs.sliding_counts(b).selectExpr("window.start", "event_type", "n"), str(tmp_path / "out"), str(tmp_path / "ck"))
    done.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).agg({"n": "sum"}).first()[0] == 4 * e.count()


def test_windows_and_sessions_on_a_stream(spark, tmp_path):
    from talkloom.streaming import jobs

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for name, f in (("tumbling", jobs.windowed_counts), ("gaps", jobs.sessions)):
        q = f(stream).writeStream.outputMode("append" if name == "gaps" else "complete").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, jobs.windowed_counts(e).collect()))
    whole = set(map(tuple, jobs.sessions(e).collect()))
    assert set(map(tuple, spark.table("gaps").collect())) <= whole and spark.table("gaps").count() > 0


def test_vtt_checks_find_faults(spark):
    text = "00:00:01.000 --> 00:00:01.000\nx\n\n00:00:00.500 --> 00:00:09.000\ny\n"
    got = scans.check_vtt(spark.createDataFrame([("m", text, 5000)], "media_id string, value string, duration_ms long")).first()
    assert tuple(got) == ("m", False, 2, 1, 1, 1)
    assert vtt.parse(spark.createDataFrame([("m", text)], "media_id string, value string")).count() == 2


@pytest.mark.parametrize("argv", [["list"]])
def test_cli_lists_queries(argv, capsys):
    from talkloom.cli import main

    assert main(argv) == 0 and "speaker_stats" in capsys.readouterr().out.split()
