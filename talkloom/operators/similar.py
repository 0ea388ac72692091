"""Joins by similarity ratio behind upper bounds, and pieces of longer terms."""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions import text as X
from talkloom.operators import bulk


def numbered_letters(word) -> Column:
    """A word's characters, each with how many of it come before: two words share as many of these as characters, repeats counted."""
    chars = F.split(word, "")
    chars = F.filter(chars, lambda c: c != "")
    sorted_ = F.array_sort(chars)
    return F.transform(sorted_, lambda c, i: F.concat(c, (i - F.array_position(sorted_, c) + 1).cast("string")))


def bound(a: Column, b: Column, letters_a: Column, letters_b: Column) -> Column:
    """No ratio of two words is above this: twice the characters that they have in common, in any order, over all."""
    return 2 * F.size(F.array_intersect(letters_a, letters_b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))


def near_pairs(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, least: float) -> DataFrame:
    """Pairs of left (on, a, ...) and right (on, b, ...) with ratio, those of at least `least` whole: pairs whose lengths, or whose letters,
    can't reach it never get to Python. Letters are counted once for each row before the join."""
    x = left.withColumn("__a", numbered_letters(F.col(a))).join(right.withColumn("__b", numbered_letters(F.col(b))), on)
    close = F.least(F.length(a), F.length(b)) * 2 >= (F.length(a) + F.length(b)) * least
    x = x.where(close).where(bound(F.col(a), F.col(b), F.col("__a"), F.col("__b")) >= least).drop("__a", "__b")
    return x.withColumn("ratio", X.similarity(a, b))


def pieces(low) -> set[str]:
    """Those of some terms that are a piece of another: one run of an Aho-Corasick automaton over them, so that time is linear in their
    length."""
    import ahocorasick

    terms, found = sorted(set(low) - {""}), set()
    machine = ahocorasick.Automaton()
    for t in terms:
        machine.add_word(t, t)
    if terms:
        machine.make_automaton()
        for t in terms:
            found |= {x for _, x in machine.iter(t) if x != t}
    return found


def inner_terms(vocabulary: DataFrame) -> DataFrame:
    """vocabulary (media_id, low) -> those terms that are a piece of another of the same recording. A recording's terms are what one task
    holds."""
    return bulk.folded(vocabulary, ["media_id"], ["low"], ["low"], lambda key, low: [(*key, x) for x in sorted(pieces(low))], "media_id long, low string")


def _letters(words: list[str], place: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(place), len(words)), np.int16)
    for i, w in enumerate(words):
        for c in w:
            out[place[c], i] += 1
    return out


def best_ratios(terms: list[str], words: list[str], lo: float, hi: float) -> list[float]:
    """Each term's best ratio to a word, where that is from lo to hi; else any number outside. Words are tried by the bound of their letters,
    as long as it is above the best so far."""
    if not terms or not words:
        return [-1.0] * len(terms)
    place = {c: i for i, c in enumerate(sorted({c for x in (terms, words) for w in x for c in w}))}
    common = np.zeros((len(terms), len(words)), np.int16)
    for a, b in zip(_letters(terms, place), _letters(words, place), strict=True):
        common += np.minimum(a[:, None], b)
    most = 2.0 * common / np.add.outer([len(x) for x in terms], [len(x) for x in words])
    order = np.argsort(-most, axis=1, kind="stable")
    known: dict[int, difflib.SequenceMatcher] = {}  # what it finds out about its second word is kept
    out = []
    for term, row, at in zip(terms, most, order, strict=True):
        best = -1.0
        for j in at:
            if row[j] < lo or row[j] <= best or best > hi:
                break
            if j not in known:
                known[j] = difflib.SequenceMatcher(None, "", words[j])
            known[j].set_seq1(term)
            best = max(best, known[j].ratio())
        out.append(best)
    return out


def window_terms(frames: DataFrame, windows: DataFrame, chrome: DataFrame, pad_ms: int = 30_000, least_frames: int = 2, limit: int = 20, lo: float = 0.55, hi: float = 0.97) -> DataFrame:
    """Terms on screen that may correct what a window's words say -> (media_id, win, term, n, ratio, rank).

    frames (media_id, t, terms), each term once a frame; windows (media_id, win, start_ms, end_ms, texts), which may overlap; chrome (media_id, low), furniture. A term counts where it's on least_frames
    frames within pad_ms of the window, both ends included, has four letters, isn't spoken there, is no piece of another term of the
    recording, and its best ratio to a spoken word is from lo to hi. The closest, then the most frequent, then the last by name stay.
    A recording is one row, and one after the other is what a task holds: terms are never shuffled but with their frames.
    """
    long = F.filter(F.transform("terms", lambda x: F.struct(x.alias("term"), F.lower(x).alias("low"))), lambda x: F.length(x["low"]) >= 4)
    f = frames.groupBy("media_id").agg(F.collect_list(F.struct("t", long.alias("terms"))).alias("frames"))
    w = windows.groupBy("media_id").agg(F.collect_list(F.struct("win", "start_ms", "end_ms", "texts")).alias("windows"))
    c = chrome.groupBy("media_id").agg(F.collect_set("low").alias("chrome"))

    def run(batch):
        out = []
        for i, (key, dull) in enumerate(zip(batch.column("media_id").to_pylist(), batch.column("chrome").to_pylist(), strict=True)):
            shown, spans = batch.column("frames")[i].values, batch.column("windows")[i].values.to_pylist()
            ends, x = bulk.unlisted(shown.field("terms"))
            frame = [(t, list(zip(x["term"][a:b], x["low"][a:b], strict=True))) for t, a, b in zip(shown.field("t").to_pylist(), ends, ends[1:], strict=False)]
            away = pieces(x["low"]) | set(dull or ())
            for span in spans:
                if span["start_ms"] is None or span["end_ms"] is None:
                    continue
                n = Counter(y for t, own in frame if t is not None and span["start_ms"] - pad_ms <= t <= span["end_ms"] + pad_ms for y in own)
                own_words = set(span["spoken"] or ())
                seen = [(*y, k) for y, k in n.items() if k >= least_frames and y[1] not in away and y[1] not in own_words]
                ratios = best_ratios([low for _, low, _ in seen], sorted(own_words), lo, hi)
                found = sorted(((r, k, term) for r, (term, _, k) in zip(ratios, seen, strict=True) if lo <= r <= hi), reverse=True)
                out += [(key, span["win"], term, k, r, rank) for rank, (r, k, term) in enumerate(found[:limit], 1)]
        return list(zip(*out, strict=True)) if out else [[]] * 6

    none = F.array().cast("array<string>")
    spoken = lambda texts: F.array_distinct(F.flatten(F.transform(texts, lambda x: F.coalesce(F.transform(X.screen_tokens(x), F.lower), none))))
    x = w.join(f, "media_id").join(c, "media_id", "left")
    said = F.transform("windows", lambda v: F.struct(*[v[c].alias(c) for c in ("win", "start_ms", "end_ms")], spoken(v["texts"]).alias("spoken")))  # only where there are frames
    return bulk.mapped(x.select("media_id", "frames", "chrome", said.alias("windows")), run, "media_id long, win long, term string, n long, ratio double, rank int")
