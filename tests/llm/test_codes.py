"""Vector codes, collocations and BPE: brute force, the tokenizers library, edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from talkloom.llm import bpe, collocations, vector_code

DOCS = "doc_id long, text string, lang string, source string, block long, words string, ids binary, decoded string"


# --- vector codes -----------------------------------------------------------------------------------------------------------


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """rows (vec_id, integers, label) -> (codes, errors, books), by plain loops."""
    size = max(len(v) for _, v, _ in rows)
    width = -(-size // parts)
    vs = [list(v) + [0] * (width * parts - len(v)) for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[vs[i][p * width : (p + 1) * width] for i in order] for p in range(parts)]

    def near(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in books[p]]
        return min(range(len(d)), key=lambda e: (d[e], e)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for v in vs:
                x = v[p * width : (p + 1) * width]
                own[near(p, x)[0]].append(x)
            for e, xs in own.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    got = [[near(p, v[p * width : (p + 1) * width]) for p in range(parts)] for v in vs]
    return ["".join(f"{e:02x}" for e, _ in g) for g in got], [sum(d for _, d in g) for g in got], books


@pytest.mark.parametrize("dims", [16, 20, 48])
def test_vector_codes_match_plain_loops(spark, dims):
    r = random.Random(dims)
    rows = [(i * 3, [r.choice([-1.5, -0.0039, 0.0, 0.25, 0.26]) if i % 2 else r.uniform(-2, 2) for _ in range(dims)], r.choice([1, 2, None])) for i in range(150)]
    rows += [rows[5], rows[5], (None, [0.5] * dims, None), (None, [0.5] * dims, 7), (3, [9.0] * (dims - 3), 1)]
    bad = [(500, None, 1), (501, [], 1), (502, [None] * dims, 1), (503, [float("nan")] * dims, 1), (504, [float("inf")] * dims, 1), (505, [1.0] * (dims - 1) + [None], None)]
    schema = "vec_id long, embedding array<double>, label int, code string, v int, n int"
    df = spark.createDataFrame([(*x, "c", 1, 2) for x in rows + bad], schema).repartition(5)
    got = vector_code.compress(df).collect()
    ints = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in rows]
    codes, errors, books = brute_codes(ints)
    by = collections.Counter()
    for (_, _, label), e in zip(ints, errors, strict=True):
        by[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    want = collections.Counter((i, c, e, by[label], digest) for (i, _, label), c, e in zip(ints, codes, errors, strict=True))
    assert collections.Counter(map(tuple, got)) == want


def test_vector_codes_of_few_none_and_huge(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert vector_code.compress(spark.createDataFrame([], schema)).count() == 0
    assert vector_code.compress(spark.createDataFrame([(1, [float("nan")], "a")], schema)).count() == 0
    big = [(i, [float(2**30 * (i % 5)), float(i)] * 8, "a") for i in range(9)]
    got = {x.vec_id: (x.code, x.error) for x in vector_code.compress(spark.createDataFrame(big, schema)).collect()}
    codes, errors, _ = brute_codes([(i, [int(256 * x) for x in v], a) for i, v, a in big])
    assert got == {i: (c, e) for (i, _, _), c, e in zip(big, codes, errors, strict=True)}


def test_nearest_breaks_ties_and_prunes_nothing_that_wins():
    r = np.random.default_rng(2)
    for width in (1, 3, 4, 9):
        book, x = r.integers(-3, 4, (64, width)), r.integers(-4, 5, (500, width))
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        entry, best = vector_code.nearest(x, book)
        assert (entry == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        entry, best = vector_code.nearest(x.astype(object), book.astype(object))
        assert (entry == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_decoded_vectors_are_the_named_entries(spark):
    df = spark.createDataFrame([(i, [i / 7] * 32, 0) for i in range(80)], "vec_id long, embedding array<double>, label int")
    kept = vector_code.quantized(df)
    books = vector_code.codebooks(kept)
    for row in vector_code.decode(vector_code.encode(kept, books), books).collect():
        assert sum((a - b) ** 2 for a, b in zip(row.v, row.approx, strict=True)) == row.error


# --- collocations -----------------------------------------------------------------------------------------------------------


def brute_collocations(rows, least, longest, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        often = {p: c for p, c in own.items() if c >= least}
        inside = collections.Counter()
        for p, c in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], c)
        scored = []
        for p, a in often.items():
            if len(p) > 1 and 100 * inside[p] < 80 * a:
                score, _, left, right = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    vocab = ["a", "b", "c", "A", "dd", "É", "é", "x\x1cy", "\x00", "z'", "…", "w1", "w2", "w3"]
    for _ in range(n):
        yield "".join(r.choice(vocab) + r.choice([" ", " ", "  ", "\t", " ", ".", ", ", "\n", "\x0b", " ", " "]) for _ in range(r.choice([0, 1, 2, 5, 40, 200])))


def test_collocations_match_plain_counts(spark):
    rows = [(t, ["en", "de", None, ""][i % 4]) for i, t in enumerate(texts(3, 160))]
    rows += [(None, "en"), ("", "en"), (".,;", "fr"), ("one", "fr"), ("a " * 5000, "und"), ("a b " * 300 + "!", None), ("same phrase here " * 4, "xx"), ("same phrase here " * 4, "xx")]
    df = spark.createDataFrame([(i, t, lang, "s", 1, "w", b"", "") for i, (t, lang) in enumerate(rows)], DOCS).repartition(7)
    for least, longest, top, slab in ((3, 4, 12, 400), (2, 5, 500, 1 << 20), (6, 2, 3, 50), (4, 3, 7, 1)):
        got = sorted(map(tuple, collocations.collocations(df, least, longest, top, slab).collect()))
        assert got == brute_collocations(rows, least, longest, top), (least, longest)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, None, None, None, None)], DOCS)).count() == 0


def test_postings_and_packing():
    words, stream = collocations.postings(b"A b, a\t\tb\n\nc")
    assert [words.to_pylist()[i] if i >= 0 else None for i in stream] == [b"a", b"b", None, b"a", b"b", None, b"c"]
    for a in ([], [0], [5, -3, 1 << 62, -(1 << 62)], list(range(1000))):
        assert collocations.unpack(collocations.pack(np.array(a, np.int64))).tolist() == a


# --- BPE --------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.no_padding(), t.no_truncation()
    return path, t


def hard_texts():
    r = random.Random(4)
    yield from [None, "", " ", "\n", "a", "  two  spaces \n\n", "it's I'LL we'Ve", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y ", "<|endoftext|", "é" * 30, "日本語 テキスト", "​﻿　x", "🏳️‍🌈👩‍👩‍👧", "\x00\x1c\x1f\x85", "12345 ٣٤ ½", "x" * 70_000, "ab" * 9000 + " " * 5000 + "!", "퟿￿\U0010ffff"]
    for n in (3, 10, 60, 400):
        for _ in range(120):
            yield "".join(r.choice("ab") for _ in range(n))
            yield "".join(r.choice(" etaoinshr\n'.,<|endoftext|>ABž中") for _ in range(n))
            yield "".join(chr(r.choice([r.randrange(32, 0x700), r.randrange(0x1F300, 0x1F700), r.randrange(0x4E00, 0x9000)])) for _ in range(n))


def test_bpe_is_the_library_s(spark, library):
    path, t = library
    rows = [(i, x, "en", "s", 1, "w", b"x", "y") for i, x in enumerate(hard_texts())]
    rows += [rows[10], rows[10], (None, "no id", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = collections.Counter(map(tuple, bpe.digests(df, path).collect()))
    want = collections.Counter()
    for row in rows:
        ids = t.encode(row[1] or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert back == (row[1] or "")
        want[row[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert got == want
    assert bpe.digests(spark.createDataFrame([], DOCS), path).count() == 0
    kept = bpe.decode(bpe.encode(df, path), path)
    assert kept.columns == ["doc_id", "text", "lang", "source", "block", "words", "ids", "decoded"]


def test_tokens_and_their_joins_are_the_library_s(library):
    path, t = library
    vocab = bpe.vocabulary(open(path, encoding="utf-8").read())
    r = random.Random(6)
    tokens = sorted(vocab.of)
    for _ in range(4000):
        raw = b"".join(r.choice(tokens) for _ in range(r.choice([1, 2, 3, 6])))
        text = raw.decode("utf-8", "ignore")
        assert np.frombuffer(vocab.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_decoding_of_any_ids(library):
    path, t = library
    vocab = bpe.vocabulary(open(path, encoding="utf-8").read())
    r = np.random.default_rng(1)
    for _ in range(300):
        ids = r.integers(0, 50257, 20).astype(np.uint32)
        assert vocab.decode(ids)[0].tobytes().decode("utf-8", "replace") == t.decode(ids.tolist(), skip_special_tokens=False)
    assert vocab.decode(np.array([4294967295, 0], np.uint32))[0].tobytes() == vocab.decode(np.array([0], np.uint32))[0].tobytes()


def test_tables_are_bounded_and_odd_files_refused(library, monkeypatch):
    path, t = library
    text = open(path, encoding="utf-8").read()
    monkeypatch.setattr(bpe, "PAIRS", 50), monkeypatch.setattr(bpe, "PRETOKENS", 20)
    vocab = bpe.Vocabulary(text)
    sample = " ".join(f"word{i}ing th{i % 7}ousand" for i in range(500))
    assert np.frombuffer(vocab.encode(sample), "<u4").tolist() == t.encode(sample, add_special_tokens=False).ids
    assert len(vocab.pairs) <= 50 and len(vocab.codes) <= 20
    with pytest.raises(ValueError):
        bpe.Vocabulary(text.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'))
