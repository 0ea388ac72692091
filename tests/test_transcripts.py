"""The data source of transcripts against the native readers, its options and errors; names, prompts and agreement by hand."""

import difflib
from collections import Counter

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

from talkloom.functions import text as X
from talkloom.operators import names as N
from talkloom.plans import meetings
from talkloom.plans import views as V
from talkloom.plans.catalog import ORACLE, chrome_terms
from talkloom.plans.owners import aligned_quote
from talkloom.sources import docx, scans, transcripts, vtt
from tests.test_brute import rows_by
from tests.test_sources import document

D = "/root/testdata/sf0.001"
QUIRKS = [
    "﻿WEBVTT\r\n\r\ncue-1\r\n00:00:01.000 --> 00:00:02,500\r\n<v A &amp; B>One</v><v C<x>>Two</v>\r\n\r\nnote only\r\n\r\n00:00:03.000 --> 00:00:04.000\r\nplain &lt;b&gt;\r\n\r\n00:00:05.000 --> 00:00:06.000\r\n<v D></v>\r\n",
    "WEBVTT\n\n01:00:09.999 --> 01:00:10.001 align:start\n<v  Jan  `Novák` >caf&eacute;\t x &#233; <i>y</i>\n \n\n00:00:07.000 --> 00:00:08.000\n<v Eva>no end\n<v Ota>next</v> rest\n",
    "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nb\n\n00:00:01.000 --> 00:00:03.000\n&nbsp;\n\n00:00:01.000 --> 00:00:02.000\na",
]


def test_data_source_equals_the_native_readers(spark, tmp_path):
    transcripts.register(spark)
    (tmp_path / "deep").mkdir()
    for i, text in enumerate(QUIRKS):
        (tmp_path / f"{'deep/' * (i % 2)}{i}.vtt").write_bytes(text.encode())
    (tmp_path / "d.DOCX").write_bytes(document(["Title", "Jan Novak  0:05", "Hello.", "Petra  1:00:10", "Yes.", "No.", "Jan Novak 0:07", "back"]))
    for r in vtt.render(V.turns(spark, D).where("media_id < 5 and n > 0")).collect():
        (tmp_path / f"t{r.media_id}.vtt").write_text(r.value)
    (tmp_path / "_hidden.txt").write_text("x")
    (tmp_path / ".x").mkdir()
    (tmp_path / ".x" / "a.txt").write_text("x")
    df = spark.read.format("transcript").option("bytes", 300).load(str(tmp_path))
    assert [f.simpleString() for f in df.schema] == [f.simpleString() for f in spark.range(0).select(*[F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in transcripts.SCHEMA.split(", ")]).schema]
    name = lambda p: p.rsplit("/", 1)[-1]
    got = sorted((name(r.media_id), r.speaker, r.text, r.start_ms, r.end_ms, r.cue_idx) for r in df.collect())
    files = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path), wholetext=True, pathGlobFilter="*.vtt").select(F.col("_metadata.file_path").alias("media_id"), "value")
    cues = [(name(r.media_id), r.speaker or "SPEAKER_00", r.text, r.start_ms, r.end_ms, r.cue_idx) for r in vtt.parse(files).collect()]
    binary = spark.read.format("binaryFile").load(str(tmp_path / "d.DOCX")).select(F.col("path").alias("media_id"), "content")
    own = sorted(docx.parse(binary).collect(), key=lambda r: (r.start_ms, r.i))
    assert got == sorted(cues + [("d.DOCX", r.speaker, r.text, r.start_ms, r.end_ms, i) for i, r in enumerate(own)])
    assert len(got) > 20 and df.rdd.getNumPartitions() > 3
    assert spark.read.format("transcript").load("file://" + str(tmp_path)).count() == len(got)


def test_data_source_errors_and_options(spark, tmp_path):
    transcripts.register(spark)
    read = lambda **o: spark.read.format("transcript").options(**o).load(str(tmp_path))
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nhello\n")
    assert [r.speaker for r in read(speaker="nobody").collect()] == ["nobody"]
    (tmp_path / "b.vtt").write_text("WEBVTT\n")
    (tmp_path / "e.vtt").write_bytes(b"")
    with pytest.raises(Exception, match="no cues in"):
        read().collect()
    assert read(empty="skip").count() == 1
    (tmp_path / "c.srt").write_text("x")
    with pytest.raises(Exception, match="unsupported transcript format"):
        read(empty="skip").collect()
    assert read(empty="skip", unknown="skip").count() == 1
    for bad in ({"empty": "maybe"}, {"bytes": "0"}):
        with pytest.raises(Exception, match="error or skip"):
            read(**bad).collect()
    with pytest.raises(Exception, match="no such path"):
        spark.read.format("transcript").load(str(tmp_path / "none")).collect()


def by_hand(cues, a, b):
    """Alternation and overlap of two names' cues (name, start, end), which are in the order of their starts."""
    x, y = [c for c in cues if c[0] == a], [c for c in cues if c[0] == b]
    both = sorted(x + y, key=lambda c: c[1])
    swaps = sum(p[0] != q[0] for p, q in zip(both, both[1:]))
    shared = sum(max(0, min(p[2], q[2]) - max(p[1], q[1])) for p in x for q in y)
    air = min(sum(c[2] - c[1] for c in z) for z in (x, y))
    return swaps / min(len(x), len(y)), shared / air if air else 0.0


def test_canonical_cues_by_hand(spark):
    cues = rows_by(meetings.spelt(spark, D))
    got = {(r.media_id, r.pos): r.canon for r in meetings.canonical_cues(spark, D).collect()}
    merged = kept = 0
    for m, rows in cues.items():
        rows.sort(key=lambda r: (r.start_ms, r.pos))
        n = Counter(r.name for r in rows if r.name)
        canon, groups, key = {}, [], lambda s: "".join(c for c in s.lower() if "a" <= c <= "z")
        for name in sorted(n, key=lambda s: -n[s]):
            head = next((g for g in groups if difflib.SequenceMatcher(None, key(name), key(g)).ratio() >= 0.82), None)
            if head is None:
                groups.append(name)
            else:
                alternation, overlap = by_hand([(r.name, r.start_ms, r.end_ms) for r in rows], head, name)
                if alternation < 0.15 or overlap > 0.5:
                    canon[name] = head
                    merged += 1
                else:
                    kept += 1
        assert all(got[m, r.pos] == canon.get(r.name, r.name) for r in rows)
    assert merged > 3 and kept > 3 and len(got) == sum(map(len, cues.values()))


def test_evidence_of_silent_and_missing_names(spark):
    cues = spark.createDataFrame([(1, "a", 0, 0, 0), (1, "b", 0, 10, 1), (1, "a", 20, 20, 2), (1, None, 5, 9, 3)], "media_id long, name string, start_ms long, end_ms long, pos long")
    pairs = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (1, "a", "x")], "media_id long, a string, b string")
    assert [tuple(r) for r in N.evidence(cues, pairs).collect()] == [(1, "a", "b", 2.0, 0.0, False)]
    assert N.evidence(cues.limit(0), pairs).count() == 0 and N.counted(cues).count() == 2
    canon = spark.createDataFrame([(1, "b", "a")], "media_id long, name string, canon string")
    assert sorted(str(r.canon) for r in N.renamed(cues, canon).collect()) == ["None", "a", "a", "a"]


def test_window_prompts_by_hand(spark):
    turns, quotes = rows_by(V.turns(spark, D)), {(r.media_id, r.turn_idx): r.text for r in aligned_quote(spark, D).collect()}
    frames, chrome = rows_by(meetings.on_screen(spark, D)), {(r.media_id, r.term) for r in chrome_terms(spark, D).collect()}
    tokens = lambda text: [x.lower() for x in regex.findall(X.ON_SCREEN, text)]
    got = {(r.media_id, r.win): r.prompt for r in meetings.window_prompts(spark, D).collect()}
    want, shown = {}, 0
    for m, rows in turns.items():
        rows.sort(key=lambda r: r.turn_idx)
        windows, opened = [[]], None
        for r in rows:
            opened = r.start_ms if opened is None else opened
            windows[-1].append(r)
            if r.end_ms - opened >= 90_000:
                windows.append([])
                opened = None
        vocabulary = {f.term.lower() for f in frames[m]}
        for w, own in enumerate(filter(None, windows)):
            spoken = set(tokens(" ".join(r.text for r in own)))
            near = [f for f in frames[m] if own[0].start_ms - 30_000 <= f.t <= own[-1].end_ms + 30_000]
            seen, scored = Counter(f.term for f in near if (m, f.term.lower()) not in chrome), []
            for term, n in seen.items():
                low = term.lower()
                if low in spoken or len(low) < 4 or n < 2 or any(low != v and low in v for v in vocabulary) or not spoken:
                    continue
                best = max(difflib.SequenceMatcher(None, low, s).ratio() for s in spoken)
                if 0.55 <= best <= 0.97:
                    scored.append((best, n, term))
            terms = [t for _, _, t in sorted(scored, reverse=True)[:20]]
            shown += bool(terms)
            lines = "\n".join(f"[{i}] A: {r.text}\n    B: {quotes.get((m, r.turn_idx)) or '(none)'}" for i, r in enumerate(own, 1))
            head = "Words visible on screen during this passage: " + ", ".join(terms) + "\n\n" if terms else ""
            want[m, w] = f"{head}{len(own)} lines, each with both readings:\n\n{lines}\n\nReturn exactly {len(own)} corrected lines, numbered [1]..[{len(own)}]."
    assert got == want and shown >= 3


def test_agreement_of_artifacts(spark):
    turns = spark.createDataFrame([(1, 0, "Eva", "Příliš žluťoučký kůň úpěl ďábelské ódy a pak dál", 4000), (1, 1, "Ota", None, 9000), (2, 0, "Eva", "x", 5)], "media_id long, turn_idx long, name string, text string, end_ms long")
    good = "# r\n\n- **Duration:** 00:00:09\n\n## [00:00:00] Eva\n\nPříliš žluťoučký kůň  úpěl\nďábelské ódy a pak dál\n\n## [00:00:05] Ota\n"
    kind = "media_id long, md string, vtt string, used_ms long, full_ms long"
    files = spark.createDataFrame([(1, "result.json"), (1, "minutes.docx")], "media_id long, file string")
    faults = lambda a, f=files.limit(0): sorted((r.fault, r.n) for r in scans.check_agreement(turns, spark.createDataFrame(a, kind), f).collect())
    assert faults([(1, good, "WEBVTT Eva Ota ř", 9000, 9000)]) == []
    assert faults([(1, good, "WEBVTT Eva", 9000, 9000)], files) == [("accents in vtt", len(set("říšžťčýůňúěďáéó"))), ("minutes.docx", 1), ("names in vtt", 1)]
    assert faults([(1, good, "Eva Ota ř", 6999, 9000)]) == [("duration", 9000), ("end", 2001)]
    assert faults([(1, good.replace("## [00:00:05]", "#"), "Eva Ota ř", None, None)]) == [("headings", 1)]
    assert [f for f, _ in faults([(2, None, None, 5, 5)])] == ["headings", "names in md", "names in vtt"]


def test_names_inside_of_words_and_long_recordings_against_sql(spark, tmp_path):
    """A word that holds a name, or comes to hold it without its marks, isn't the speaker's name; hours of three digits; no text."""
    long = "Ota w otázka pokračuje dál a dál, jak se zdá"
    rows = [(37, 0, "user", "Ótara"), (37, 1, "assistant", "x"), (13, 0, "assistant", long), (3, 0, "user", "a " * 900_001), (3, 1, "assistant", long), (22, 0, "user", "y"), (22, 1, "user", None), (22, 2, "assistant", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    sql = "with conversations as (select * from read_parquet('" + str(tmp_path / "conversations.parquet") + "/*.parquet')), " + ORACLE["dq_cross_artifact"].removeprefix("with ")
    want = sorted(duckdb.connect().execute(sql).fetchall())
    assert sorted(map(tuple, meetings.dq_cross_artifact(spark, str(tmp_path)).collect())) == want
    assert (37, "names in md", 1) in want and (22, "headings", 2) in want
