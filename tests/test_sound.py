"""WAV files of all formats, slices, loudest windows; similarity joins; bootstrap draws; against brute force."""

import difflib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.functions import text as X
from talkloom.operators import similar
from talkloom.plans import scoring
from talkloom.sources import wav


def riff(code, bits, channels, rate, body, extra=b""):
    fmt = struct.pack("<HHIIHH", code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + extra
    chunks = b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def test_formats():
    x = np.array([[-0.5, 0.5], [0.25, 0.25], [-1.0, 0.0]])
    want = x.mean(axis=1)
    whole24 = b"".join(int(v * (1 << 23)).to_bytes(3, "little", signed=True) for v in x.ravel())
    for code, bits, body, extra in ((1, 16, (x * 32768).astype("<i2").tobytes(), b""), (1, 32, (x * 2**31).astype("<i4").tobytes(), b""), (1, 24, whole24, b""), (1, 8, (x * 128 + 128).astype(np.uint8).tobytes(), b""), (3, 32, x.astype("<f4").tobytes(), b""), (3, 64, x.astype("<f8").tobytes(), b""), (0xFFFE, 32, x.astype("<f4").tobytes(), struct.pack("<HHIH", 22, 32, 3, 3) + bytes(14))):
        rate, got = wav.parse(riff(code, bits, 2, 8000, body, extra))
        assert rate == 8000 and np.allclose(got, want)
        assert len(wav.parse(riff(code, bits, 2, 8000, body[:-1], extra))[1]) == 2  # cut short: whole frames only
    for bad in (b"", b"RIFF0000WAVE", riff(2, 4, 1, 8000, b"ab"), b"OggS" + bytes(40)):
        with pytest.raises(ValueError):
            wav.parse(bad)


def brute_windows(x, rate, n, window_s, hop_s):
    total, win, hop = len(x) / rate, int(window_s * rate), int(hop_s * rate)
    loud = lambda a: float(np.sqrt(np.mean(np.square(x[a : a + win], dtype=np.float64)) + 1e-12))
    if total <= window_s:
        return [0.0]
    n = max(1, min(n, int(total // window_s)))
    floor = np.percentile([loud(i) for i in range(0, max(1, len(x) - win), max(hop, win // 2))], 20)
    out = []
    for b in range(n):
        lo, hi = int(b * (total / n) * rate), min(len(x) - win, int((b + 1) * (total / n) * rate))
        if hi > lo:
            best = max(range(lo, hi + 1, hop), key=lambda p: (round(loud(p), 9), -p))
            if loud(best) >= floor:
                out.append(best / rate)
    return out or [0.0]


def test_slices_and_loudest_windows(spark, tmp_path):
    r = np.random.default_rng(5)
    files = {"long": np.concatenate([r.integers(-s, s, 700) for s in (100, 9000, 300, 20000, 50, 4000)]), "short": r.integers(-99, 99, 500), "silent": np.zeros(2500, int), "one": np.array([7]), "edge": r.integers(-500, 500, 1000)}
    for name, x in files.items():
        (tmp_path / f"{name}.wav").write_bytes(wav.render(x, 100))
    p = wav.load(spark, str(tmp_path), 100)
    got = {}
    for row in wav.loudest_windows(p, 4, 10.0, 2.0).collect():
        got.setdefault(row.path.rsplit("/", 1)[-1][:-4], []).append(row.start)
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_windows((x / 32768).astype(np.float32), 100, 4, 10.0, 2.0) for k, x in files.items()}
    for a, b in ((0.0, 1.0), (4.985, 5.015), (0.005, 0.015), (39.0, 99.0), (90.0, 99.0), (3.0, 3.0)):
        cut = {r.path.rsplit("/", 1)[-1][:-4]: r.samples for r in wav.slices(p, a, b).collect()}
        for k, x in files.items():
            want = (x[round(a * 100) : round(b * 100)] / 32768).astype(np.float32)
            assert np.array_equal(np.array(cut.get(k, []), np.float32), want)
    with pytest.raises(Exception, match="samples a second"):
        wav.load(spark, str(tmp_path), 16_000).count()


def test_bounds_lose_no_pair_and_spare_python(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdeř1") for _ in range(r.randrange(0, 12))) for _ in range(120)]
    a = spark.createDataFrame([(1, w) for w in words[:60]], "k int, a string")
    b = spark.createDataFrame([(1, w) for w in words[60:]], "k int, b string")
    got = {(x.a, x.b): x.ratio for x in similar.near_pairs(a, b, ["k"], "a", "b", 0.55).collect()}
    for x in words[:60]:
        for y in words[60:]:
            if X.ratio(x, y) >= 0.55 and x + y:
                assert abs(got[x, y] - X.ratio(x, y)) < 1e-12
    assert len(got) < 0.5 * 3600
    vocab = spark.createDataFrame([(m, w) for m in (1, 2) for w in words[: 60 * m]], "media_id long, low string")
    want = {(m, x) for m in (1, 2) for x in words[: 60 * m] if x and any(x != y and x in y for y in words[: 60 * m])}
    assert {(x.media_id, x.low) for x in similar.inner_terms(vocab).collect()} == want


def test_bootstrap_draws_are_uniform(spark):
    """Intervals against NumPy's own resampling, and point estimates and verdicts by hand."""
    r = np.random.default_rng(3)
    rows = [(1, k, int(r.integers(0, 30)), int(r.integers(0, 30) + 5 * (k < 40)), 100, 3, 4) for k in range(90)] + [(2, k, 10, 3, 50, 9, 1) for k in range(5)] + [(3, 0, 1, 2, 10, 1, 1)]
    b = spark.createDataFrame(rows, "media_id long, block long, ea long, eb long, n long, a_only long, b_only long")
    got = {x.media_id: x for x in scoring.bootstrap(b).collect()}
    pooled = scoring.pooled_bootstrap(b).first()
    for key, own in ((1, [x for x in rows if x[0] == 1]), (None, rows)):
        e, n = np.array([x[3] - x[2] for x in own]), np.array([x[4] for x in own])
        at = r.integers(0, len(own), (20_000, len(own)))
        delta = np.sort(e[at].sum(axis=1) / n[at].sum(axis=1))
        x = pooled if key is None else got[key]
        assert abs(x.lo - delta[500]) < 0.006 and abs(x.hi - delta[19_500]) < 0.006 and abs(x.point - e.sum() / n.sum()) < 1e-6
    assert got[2].verdict == "better" and got[2].lo == got[2].hi == -0.14 and (got[2].a_only, got[2].b_only) == (45, 5)
    assert got[3].verdict == "worse" and (pooled.blocks, pooled.n) == (96, 9260)
    assert scoring.bootstrap(b.limit(0)).count() == 0
    t = scoring._poisson()
    assert abs(t[0] / 2**32 - 0.36788) < 1e-4 and abs(t[1] / 2**32 - 0.73576) < 1e-4 and t == sorted(t)


def test_best_ratios_equal_all_pairs():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeěz") for _ in range(rng.randint(1, 9)))
    terms, words = [word() for _ in range(60)], sorted({word() for _ in range(80)})
    want = [max(difflib.SequenceMatcher(None, t, w).ratio() for w in words) for t in terms]
    for lo, hi in ((0.55, 0.97), (0.0, 1.0), (0.8, 0.8)):
        got = similar.best_ratios(terms, words, lo, hi)
        assert [g if lo <= g <= hi else None for g in got] == [w if lo <= w <= hi else None for w in want]
    assert similar.best_ratios(terms, [], 0.5, 1) == [-1.0] * 60 and similar.best_ratios([], words, 0.5, 1) == []
