import random
from collections import Counter

from talkloom.operators import folds as f


def test_smoothing_runs_left_to_right():
    assert f.smooth_flips(list("ABABA")) == list("AAAAA")
    assert f.smooth_flips(list("AABBBA")) == list("AABBBA")
    assert f.smooth_flips(list("AABBCC")) == list("AABBCC")
    assert f.smooth_flips([None, "A", None]) == [None, "A", None]
    assert f.smooth_flips(["A", None, "A"]) == list("AAA")


def test_short_runs_between_two_labels_look_at_words_before_and_after():
    at = [0, 1000, 2000, 3000, 4000]
    assert f.absorb_short(list("AABCC"), at, [900, 1900, 2300, 3900, 4900]) == list("AACCC")
    assert f.absorb_short(list("AAABC"), at, [900, 1900, 2900, 3300, 4900]) == list("AAAAC")
    assert f.absorb_short(list("ABCCC"), at, [900, 1300, 2900, 3900, 4900]) == list("ACCCC")
    assert f.absorb_short(list("A"), [0], [100]) == ["A"]
    assert f.absorb_short(list("ABA"), [None, None, 5], [1, None, 9000]) == list("ABA")
    assert f.absorb_short(["A", "B", None], [0, 1000, 2000], [900, 1100, 5000]) == ["A", "A", None]


def test_boundaries_snap_to_the_closest_sentence_end_but_never_stay():
    words = ["a", "b.", "c", "d", "e", "f"]
    assert f.snap_boundaries(list("AAABBB"), words) == list("AABBBB")
    assert f.snap_boundaries(list("AABBBB"), words) == list("AABBBB")  # on an end already, no other near
    assert f.snap_boundaries(list("AABBBB"), ["a. ", "b.", "c", "d", "e", "f"]) == list("ABBBBB")


def test_duplicate_memory():
    assert f.keep_lines(["x"] * 5) == [True, True, False, False, False]
    assert f.keep_lines(["x", "x", "a", "b", "c", "d", "x"])[-1]
    assert f.keep_lines([""] * 5) == [True] * 5
    memory: list = []
    parts = [f.keep_lines(p, memory) for p in (["x", "y"], ["x", "x"], ["", "", "", "x"])]
    assert sum(parts, []) == f.keep_lines(["x", "y", "x", "x", "", "", "", "x"])


def test_loops():
    assert f.collapse_loop("ano " * 10) == ("ano ano ano", 1)
    assert f.collapse_loop("one two " * 5 + "tail") == ("one two one two one two", 2)
    assert f.collapse_loop("start " + "a b " * 6) == ("start a b a b a b a b a b a b ", 0) or f.collapse_loop("start " + "a b " * 6)[1] == 2
    assert f.collapse_loop("a b c") == ("a b c", 0)
    text, n = f.collapse_loop("x y x y q r x y x y s t")
    assert (text, n) == ("x y x y x y q r s t", 2)


def test_cues_break_by_length_time_and_sentence():
    words = [(w, i * 400, i * 400 + 400) for i, w in enumerate(("word " * 60).split())]
    cues = f.cue_chunks(words)
    assert all(len(t) <= f.CUE_CHARS and b - a <= f.CUE_MS for a, b, t in cues)
    assert " ".join(t for _, _, t in cues).split() == [w for w, _, _ in words]
    assert f.cue_chunks([]) == []


def collapse_rows_by_hand(labels, target):
    """Merging over the rows themselves."""
    to = {x: x for x in labels}
    while len(set(to.values())) > target:
        now = [to[x] for x in labels]
        n, meets = Counter(now), Counter(tuple(sorted(p)) for p in zip(now, now[1:]) if p[0] != p[1])
        names = sorted(n)
        _, a, b = min((meets[a, b] / min(n[a], n[b]), a, b) for i, a in enumerate(names) for b in names[i + 1 :])
        keep, gone = (a, b) if n[a] >= n[b] else (b, a)
        to = {x: keep if y == gone else y for x, y in to.items()}
    return to


def counts(labels):
    return Counter(labels), Counter(tuple(sorted(p)) for p in zip(labels, labels[1:]) if p[0] != p[1])


def test_collapse_needs_counts_alone():
    random.seed(3)
    for _ in range(60):
        labels = random.choices("ABCDEF", k=random.randrange(1, 60))
        for target in (1, 2, 3):
            assert f.collapse_to(*counts(labels), target) == collapse_rows_by_hand(labels, target)
    assert f.name_groups([("Jan Novak", 40), ("Jan Novák", 9), ("Petra Mala", 30)]) == {"Jan Novak": "Jan Novak", "Petra Mala": "Petra Mala", "Jan Novák": "Jan Novak"}
