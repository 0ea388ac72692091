"""Queries without SQL against plain Python over whole recordings, on the smallest tables; whole artifacts against their texts."""

import difflib
from collections import defaultdict

import pytest

from talkloom.operators import folds
from talkloom.plans import catalog, exports, kernels, owners, scoring
from talkloom.plans import views as V
from talkloom.sources import vtt

D = "/root/testdata/sf0.001"


def rows_by(df, key="media_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


def test_attribution_equals_windowed_alignment_by_hand(spark):
    ours, theirs, cues = rows_by(V.words(spark, D)), rows_by(V.cues(spark, D)), rows_by(V.lines(spark, D))
    want = {}
    for m, w in ours.items():
        w.sort(key=lambda r: (r.start_ms, r.turn_idx, r.k))
        t = sorted(theirs[m], key=lambda r: (r.start_ms, r.turn_idx, r.k))
        line = sorted(cues[m], key=lambda r: r.pos)
        mid = lambda r: (r.start_ms + r.end_ms) // 2
        matched = {}
        for at in range(0, max(map(mid, w)) + 60_000, 60_000):
            a = [i for i, r in enumerate(w) if at - 10_000 <= mid(r) < at + 70_000]
            b = [j for j, r in enumerate(t) if at - 10_000 <= mid(r) < at + 70_000]
            for block in difflib.SequenceMatcher(None, [w[i].word.lower() for i in a], [t[j].word.lower() for j in b], autojunk=False).get_matching_blocks():
                for k in range(block.size):
                    i, j = a[block.a + k], b[block.b + k]
                    if at <= mid(w[i]) < at + 60_000:
                        matched[i] = j

        def clock(r):
            i = max([0] + [n for n, c in enumerate(line) if c.start_ms <= r.start_ms])
            shared = [(-(min(r.end_ms, c.end_ms) - max(r.start_ms, c.start_ms)), n) for n, c in enumerate(line[i : i + 8], i) if c.start_ms <= r.end_ms]
            best = min([x for x in shared if x[0] < 0], default=None)
            return line[best[1]].owner if best else min(line, key=lambda c: (abs(c.start_ms - r.start_ms), c.pos)).owner

        for i, r in enumerate(w):
            near = min(matched, key=lambda x: (abs(x - i), x), default=None)
            own = t[matched[near]].owner if near is not None and abs(near - i) <= 8 else clock(r)
            want[m, r.turn_idx, r.k] = (matched[i] + 1 if i in matched else None, own)
    got = {(r.media_id, r.turn_idx, r.k): (r.tw, r.owner) for r in owners.sequence_align_attribution(spark, D).collect()}
    assert got == want and all(o for _, o in got.values())
    s = owners.speaker_accuracy(spark, D).first()
    assert s.matched == sum(tw is not None for tw, _ in want.values()) and s.their_words == sum(map(len, theirs.values()))


def test_relabelling_equals_the_folds_over_a_recording(spark):
    got = {(r.media_id, r.turn_idx, r.k): r.new_label for r in kernels.smooth_absorb_snap(spark, D).collect()}
    for w in rows_by(V.flips(spark, D)).values():
        w.sort(key=lambda r: (r.turn_idx, r.k))
        x = folds.absorb_short(folds.smooth_flips([r.label for r in w]), [r.start_ms for r in w], [r.end_ms for r in w])
        assert [got[r.media_id, r.turn_idx, r.k] for r in w] == folds.snap_boundaries(x, [r.word for r in w])


def test_cues_meet_half_way_also_across_turns(spark):
    got = sorted(map(tuple, kernels.vtt_cues(spark, D).select("media_id", "turn_idx", "cue", "start_ms", "end_ms", "text").collect()))
    want = []
    for m, w in rows_by(kernels.crosstalk(spark, D)).items():
        by = defaultdict(list)
        for r in sorted(w, key=lambda r: (r.turn_idx, r.k)):
            by[r.turn_idx].append((r.word, r.start_ms, r.end_ms))
        cues = [[m, t, i, *c] for t in sorted(by) for i, c in enumerate(folds.cue_chunks(by[t]))]
        for a, b in zip(cues, cues[1:]):
            if b[3] < a[4]:
                a[4] = b[3] = (a[4] + b[3]) // 2
        want += [tuple(c) for c in cues if c[4] > c[3]]
    assert got == sorted(want)
    assert all(a[4] <= b[3] for a, b in zip(got, got[1:]) if a[0] == b[0])


def test_columns_equal_alignment_by_hand(spark):
    pivot, others = scoring.streams(spark, D)
    c, o = rows_by(pivot), rows_by(others)
    got = {(r.media_id, r.i): (r.a0, r.a1, r.b) for r in scoring.column_build(spark, D).collect()}
    for m in list(c)[:6]:
        x = sorted(c[m], key=lambda r: (r.t, r.i))
        for at in range(0, x[-1].t + 1, 60_000):
            near = [r for r in x if at - 10_000 <= r.t < at + 70_000]
            found = {}
            for s, most in scoring.SKEW.items():
                y = sorted((r for r in o[m] if r.stream == s and at - 10_000 <= r.t < at + 70_000), key=lambda r: (r.t, r.i))
                found[s] = {i: y[j].w for i, j in scoring.pairs_of([r.w for r in near], [r.w for r in y]) if abs(near[i].t - y[j].t) <= most}
            for i, r in enumerate(near):
                if at <= r.t < at + 60_000:
                    assert got[m, r.i] == tuple(found[s].get(i) for s in ("a0", "a1", "b"))
    assert scoring.pairs_of(["a", "xylo", "b"], ["a", "zzz", "xylos", "b"]) == [(0, 0), (1, 2), (2, 3)]
    e = {r.stream: r for r in scoring.built_witness_error(spark, D).collect()}
    assert e["a0"].witnesses > 1000 and 0 < e["a1"].error < 0.5


def test_duplicates_after_cleaning(spark):
    got = defaultdict(list)
    for r in kernels.consecutive_duplicate_drop(spark, D).collect():
        got[r.doc_id].append((r.seg_idx, r.text))
    kept = rows_by(catalog.boilerplate_filter(spark, D), "doc_id")
    import re

    for d, lines in kept.items():
        lines.sort(key=lambda r: r.seg_idx)
        texts = [folds.collapse_loop(r.text.strip(" "))[0] for r in lines]
        norms = [re.sub(r"[^\w]+", " ", t.lower()).strip(" ") for t in texts]
        assert sorted(got[d]) == [(r.seg_idx, t) for r, t, ok in zip(lines, texts, folds.keep_lines(norms)) if ok]


def test_turns_from_words(spark):
    words = [("m", 0, 0, " Hello", "A", 100, 300), ("m", 0, 1, "you.", "A", None, None), ("m", 0, 2, "Yes", "B", None, None), ("m", 1, 0, "sure", None, 2000, 2400), ("m", 1, 1, "", "C", 1, 2), ("m", 3, 0, "end", "B", 9000, 9100)]
    segments = [("m", 0, "A", "Hello you. Yes", 50, 1900, "cs"), ("m", 1, "B", "sure", 1950, 2500, "sk"), ("m", 2, None, "  no  words ", 3000, 3500, ""), ("m", 3, "B", "end", 8900, 9200, "cs"), ("m", 4, "B", " ", 9200, 9300, "cs")]
    got = [tuple(r)[1:] for r in built(spark, words, segments)]
    assert got == [(1, "B", "cs", 50, 2400, "Yes sure"), (2, "A", "cs", 100, 300, "Hello you."), (3, "UNKNOWN", "", 3000, 3500, "no words"), (4, "B", "cs", 9000, 9100, "end")]


def built(spark, words, segments):
    w = spark.createDataFrame(words, "media_id string, seg long, k long, word string, label string, start_ms long, end_ms long")
    s = spark.createDataFrame(segments, "media_id string, seg long, label string, text string, start_ms long, end_ms long, language string")
    return sorted(exports.turns_from_words(w, s).select("media_id", "turn", "speaker", "language", "start_ms", "end_ms", "text").collect())


def test_a_long_turn_of_another_speaker_joins_nothing(spark):
    """A 0 to 10 s, B 4 to 5 s, B 6 to 7 s: the second B is a second after the first, whatever A does."""
    segments = [("m", 0, "A", "a", 0, 10_000, ""), ("m", 1, "B", "b", 4000, 5000, ""), ("m", 2, "B", "c", 6000, 7000, ""), ("m", 3, "B", "d", 7800, 8000, "")]
    assert [(r.speaker, r.start_ms, r.end_ms, r.text) for r in built(spark, [], segments)] == [("A", 0, 10_000, "a"), ("B", 4000, 5000, "b"), ("B", 6000, 8000, "c d")]


def test_turns_of_any_segments_equal_appending(spark):
    """Random segments, pushed one by one onto the last turn, and sorted by start at the end."""
    import random

    r, segments, want = random.Random(4), [], []
    for m in range(40):
        turns = []
        for i in range(30):
            start = r.randrange(0, 20_000)
            row = (f"m{m}", i, r.choice(["A", "B", None, ""]), r.choice(["x y", " ", f"t{i}"]), start, start + r.randrange(0, 4000), r.choice(["", "cs"]))
            segments.append(row)
            who, text = row[2] or "UNKNOWN", " ".join(row[3].split())
            if not text:
                continue
            if turns and turns[-1][1] == who and start - turns[-1][4] <= 800:
                turns[-1][4] = max(turns[-1][4], row[5])
                turns[-1][5] += " " + text
            else:
                turns.append([row[0], who, row[6], start, row[5], text])
        turns.sort(key=lambda t: t[3])
        want += [(t[0], i + 1, *t[1:3], *t[3:]) for i, t in enumerate(turns)]
    assert [tuple(x) for x in built(spark, [], segments)] == sorted(want)


def test_windows_of_a_long_recording(spark):
    from pyspark.sql import functions as F

    t = spark.range(100_000).select(F.lit(1).cast("long").alias("media_id"), F.col("id").alias("turn_idx"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + F.pmod("id", F.lit(7)) * 30_000).alias("end_ms"))
    got = {r.turn_idx: r.win for r in catalog.greedy_windows(t).collect()}
    opened, win = None, 0
    for i in range(100_000):
        opened = i * 1000 if opened is None else opened
        assert got[i] == win
        if i * 1000 + i % 7 * 30_000 - opened >= 90_000:
            opened, win = None, win + 1


def test_captions_with_untimed_turns(spark):
    from talkloom.plans.artifacts import untimed
    from talkloom.plans.kernels import chunk_cues, crosstalk

    got = sorted(map(tuple, exports.captions(spark, D).select("media_id", "turn_idx", "cue", "start_ms", "end_ms").collect()))
    none = "turn_idx % 4 = 3"
    every = [tuple(r) for x in (chunk_cues(crosstalk(spark, D).where(f"not {none}")), untimed(V.turns(spark, D).where(f"{none} and n > 0"))) for r in x.select("media_id", "turn_idx", "cue", "start_ms", "end_ms").collect()]
    cues, met = [list(c) for c in sorted(every)], 0
    for a, b in zip(cues, cues[1:]):
        if a[0] == b[0] and b[3] < a[4]:
            met += a[1] % 4 == 3
            a[4] = b[3] = (a[4] + b[3]) // 2
    kept = [tuple(c) for c in cues if c[4] > c[3]]
    assert got == kept and met > 5
    for r in exports.vtt_export_overlaps(spark, D).collect():
        own = [c for c in kept if c[0] == r.media_id]
        assert (r.cues, r.overlaps) == (len(own), sum(c[3] < max(x[4] for x in own[:i]) for i, c in enumerate(own) if i))


def test_language_marks_follow_the_last_known_one(spark):
    rows = [(1, i, "x", f"t{i}", lang, i * 1000, i * 1000 + 500, 1) for i, lang in enumerate(["", "cs", "", "cs", "sk", "", "sk", "cs"])]
    t = spark.createDataFrame(rows, "media_id long, turn_idx long, speaker string, text string, language string, start_ms long, end_ms long, n long")
    heads, notes = spark.createDataFrame([(1, "")], "media_id long, head string"), spark.createDataFrame([], "media_id long, t long, caption string")
    marks = [x.rpartition("`")[0].rpartition("`")[2] for x in exports.markdown(t, heads, notes).first().value.split("\n") if x.startswith("## ")]
    assert marks == ["", "cs", "", "", "sk", "", "", "cs"]


def test_name_heads_and_canonical_names(spark):
    from talkloom.plans import speech

    names = spark.createDataFrame([(1, "Jan Novak", 40, 0), (1, "Jan Novák", 9, 1), (1, "Petra Mala", 30, 2), (1, "Jan Novak (guest)", 3, 3), (2, "Jan Novák", 1, 0)], "media_id long, name string, n long, first long")
    heads = speech.name_heads(names)
    assert {(r.media_id, r.name): r.head for r in heads.collect()} == {(1, "Jan Novak"): "Jan Novak", (1, "Jan Novák"): "Jan Novak", (1, "Petra Mala"): "Petra Mala", (1, "Jan Novak (guest)"): "Jan Novak (guest)", (2, "Jan Novák"): "Jan Novák"}
    e = spark.createDataFrame([(1, "Jan Novak", "Jan Novák", True), (1, "Jan Novak", "Petra Mala", True)], "media_id long, a string, b string, same boolean")
    assert {(r.media_id, r.name): r.canon for r in speech.canonical(names, heads, e).collect()}[1, "Jan Novák"] == "Jan Novak"
    assert speech.canonical(names, heads, e.where("false")).where("canon <> name").count() == 0


def test_markdown_text(spark):
    t = spark.createDataFrame([(1, 0, "user", "Ahoj.", "cs", 0, 4000, 1), (1, 1, "assistant", "Dobre.", "sk", 5000, 65_000, 1), (1, 2, "x", "No.", "sk", 70_000, 71_000, 1)], "media_id long, turn_idx long, speaker string, text string, language string, start_ms long, end_ms long, n long")
    llm = spark.createDataFrame([(1, "merge", 2, 1)], "media_id long, mode string, changed long, rejected long")
    notes = spark.createDataFrame([(1, 4500, "a window"), (1, 99_000, "late")], "media_id long, t long, caption string")
    got = exports.markdown(t, exports.header(t, llm), notes).first().value
    assert got == (
        "# recording 1\n\n- **Duration:** 00:01:11\n- **Languages:** sk 67%, cs 33%\n- **Speakers:** 3 (from transcript)\n- **ASR:** whisper / large\n- **LLM merge:** 2 turns improved, 1 rejected by guardrail\n\n---\n\n"
        "## [00:00:00] Anna  `cs`\n\nAhoj.\n\n> *screen [00:00:04]:* a window\n\n## [00:00:05] Ota  `sk`\n\nDobre.\n\n## [00:01:10] x\n\nNo.\n"
    )
    none = exports.markdown(t, exports.header(t, llm.where("mode = 'no'")), notes.limit(0)).first().value
    assert "LLM" not in none and "screen" not in none


def test_transcripts_are_read_by_suffix(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<v Jan &amp; Eva>caf&eacute; &#233;</v>\n")
    got = vtt.load(spark, str(tmp_path / "a.vtt")).collect()
    assert [(r.speaker, r.text, r.start_ms) for r in got] == [("Jan & Eva", "café é", 1000)]
    (tmp_path / "b.vtt").write_text("WEBVTT\n")
    with pytest.raises(ValueError, match="no cues"):
        vtt.load(spark, str(tmp_path / "b.vtt"))
    with pytest.raises(ValueError, match="unsupported"):
        vtt.load(spark, str(tmp_path / "c.txt"))
    (tmp_path / "d.vtt").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nhello\n")
    assert vtt.load(spark, str(tmp_path / "d.vtt")).first().speaker == "SPEAKER_00"


def test_word_classes():
    from talkloom.functions.forms import same_word

    assert same_word("malý", "malej") and same_word("cafe", "café") and same_word("a", "tam") and same_word("serveru", "serverem")
    assert not same_word("dum", "strom") and not same_word("on", "dum") and not same_word("krab", "kraba"[:5] + "tice")
