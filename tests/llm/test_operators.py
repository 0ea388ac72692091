"""Edge cases and brute force for the operators of the llm subpackage."""

import collections
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from talkloom.llm import chat, components, gif, lm_score, mixing, packing, prefix_join, quality, queries, topk, url_filter, warc
from talkloom.llm.common import written

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node long, part int, component string"
random.seed(5)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(random.choice(VOCAB) for _ in range(n))


def edited(text, n):
    w = text.split()
    for _ in range(n):
        w[random.randrange(len(w))] = f"x{random.random()}"
    return " ".join(w)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty, white and short texts, ties, repeated rows, a long text, near copies, clashing column names."""
    base, long = prose(120), prose(20_000)
    texts = [None, "", " \n\t", "One", "one", "a b c d", "A B C D", "a b c d e", base, base, base.upper(), edited(base, 1), edited(base, 4), edited(base, 40), prose(120), long, edited(long, 300), "ž " * 7, "x" * 70_000]
    rows = [(i, t, "en", "s1" if i % 3 else None, 1, 2, 3, 4, "c") for i, t in enumerate(texts)]
    rows += [rows[8], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def sets(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    s = {d: sets(t) for d, t in rows if d is not None}
    up = {d: d for d in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
            p, q = sorted((find(a), find(b)))
            up[q] = p
    return {d: (len(s[d]), find(d)) for d in s}


def test_join_edge_and_brute_force(spark, edge, empty):
    got = prefix_join.jaccard_components(edge).collect()
    want = brute_components([(r.doc_id, r.text) for r in edge.collect()])
    assert len(got) == edge.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert prefix_join.jaccard_components(empty).count() == 0


def test_join_of_large_clusters(spark):
    """Lists longer than the first round pairs whole, near misses between clusters, and sets that differ but in their tails."""
    a, b = prose(90), prose(90)
    star = prose(60)  # linked by what they have in common, hardly with one another
    mixed = [" ".join(a.split()[:k] + b.split()[k:]) for k in range(0, 90, 3)]
    texts = [edited(a, k) for k in (0, 1, 1, 2, 3, 5) for _ in range(50)] + [edited(b, 2) for _ in range(60)] + mixed + [edited(star, 2) for _ in range(150)] + [star] * 3
    rows = [(7 * i % 1499, t) for i, t in enumerate(texts)] + [(2000 + i, a) for i in range(100)]
    got = prefix_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    same = [r for r in got if r.doc_id >= 2000]
    assert {(r.set_id, r.n_copies) for r in same} == {(min(d for d, t in rows if sets(t) == sets(a)), sum(sets(t) == sets(a) for _, t in rows))}


def test_join_of_many_near_copies(spark):
    rows = [(i, edited(b, k)) for b in (prose(80), prose(30), prose(300)) for i, k in ((random.randrange(10**6), random.choice([0, 1, 2, 3, 6])) for _ in range(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in prefix_join.jaccard_components(df).collect()}
    assert got == brute_components(rows)


def test_common_shingles_stay_out_of_the_second_round(spark):
    """A shingle that is far above chance counts as frequent whatever the mean, and is joined on only where the bound can't do without."""
    from talkloom.llm import prefix_kernel as pk
    from talkloom.llm.shingle import distinct, flat

    sketch = np.random.default_rng(1).poisson(460, 1 << pk.SKETCH_BITS)
    usual = (pk.levels(sketch) > 0).mean()
    sketch[:50] += 400
    assert pk.levels(sketch)[:50].all() and usual < 1e-3
    word = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, word(i, 40) + " " + word("common", 60)) for i in range(150)] + [(1000 + i, word(i % 150, 39) + f" z{i} " + word("common", 60)) for i in range(450)]
    texts = [t.encode() for _, t in rows]
    g, cut = flat(texts, 5)
    counts = np.bincount((g >> np.uint64(64 - pk.SKETCH_BITS)).astype(np.int64), minlength=1 << pk.SKETCH_BITS)
    level = type("Level", (), {"value": pk.levels(counts)})
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "component": [0] * len(rows)})
    (out,) = prefix_join._emitted(5, level, {}, 0.0)([batch])
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in out.column("ids").to_pylist()])
    length = np.concatenate([np.frombuffer(x, np.int32) for x in out.column("lengths").to_pylist()])
    assert set(ids) == {i for i, _ in rows} and np.bincount(ids, length).max() < 2 * 60  # each in two buckets; of 96, 56 are common
    assert [len(x) for x in out.column("tokens").to_pylist()] == [8 * np.frombuffer(x, np.int32).sum() for x in out.column("lengths").to_pylist()]
    own, at = distinct(*flat([b"a b c d e f a b c d e", b"", b"a b", b"A  b c d e"], 5))
    assert np.diff(at).tolist() == [6, 0, 1, 1] and own[-1] in own[:6]
    got = prefix_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_repeated_sets_are_joined_once(spark):
    rows = [(i, " ".join(f"v{(i % 40) // 2}y{j}" for j in range(30 + i % 2))) for i in range(2000)] + [(None, "p q r")] * 3
    got = prefix_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {i: i % 40 - i % 2 for i in range(2000)} and len(got) == 2003


def test_first_round_joins_a_star_without_forming_its_pairs():
    from talkloom.llm import prefix_kernel as pk

    random.seed(2)
    n = 3000
    docs = [list(range(60))] + [list({*random.sample(range(60), 53), *(1000 + 20 * i + k for k in range(7))}) for i in range(n)]
    token, doc = np.concatenate([np.array(sorted(d), np.uint64) for d in docs]), np.repeat(np.arange(n + 1), [len(d) for d in docs])
    got = [x for x in pk.candidates(token, doc, np.full(n + 1, 60), pk.bucket(60), 1, keep=0.0, most=pk.LONG_LIST)]
    pairs = set()
    for x, y, common in got[:-1]:
        keep = pk.first_pairs(x, y, common)
        pairs |= set(zip(x[keep].tolist(), y[keep].tolist()))
    assert {y for x, y in pairs if x == 0} == set(range(1, n + 1)) and len(pairs) < 8 * n and len(got[-1][0]) == n + 1


def test_group_pairs_expand_to_members():
    """All with all where these are few; else everyone of the larger group has a partner, and everyone of the smaller one too."""
    from talkloom.llm import prefix_kernel as pk

    begin, of = np.array([0, 3, 5, 15]), np.array([3, 2, 10, 1])
    members = [set(range(b, b + k)) for b, k in zip(begin, of)]
    for x, y in itertools.product(range(4), repeat=2):
        i, j = pk.expanded(begin, of, np.array([x]), np.array([y]), 16)
        got = set(zip(i.tolist(), j.tolist()))
        if of[x] * of[y] <= 16:
            assert got == set(itertools.product(members[x], members[y])) and len(i) == len(got)
        elif x == y:
            assert got == {(begin[x], k) for k in members[x]}
        else:
            assert {a for a, _ in got} == members[x] and {b for _, b in got} == members[y] and len(i) == max(of[x], of[y])
    both = pk.expanded(begin, of, np.array([0, 2, 1]), np.array([1, 1, 3]), 16)
    apart = [pk.expanded(begin, of, np.array([x]), np.array([y]), 16) for x, y in ((0, 1), (2, 1), (1, 3))]
    assert all((a == np.concatenate([p[k] for p in apart])).all() for k, a in enumerate(both))
    assert all(len(a) == 0 for a in pk.expanded(begin, of, np.zeros(0, int), np.zeros(0, int), 16))


def test_components_in_pieces(spark):
    random.seed(11)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + random.randrange(400), 1000 + random.randrange(400)) for _ in range(300)] + [(5000, 5000), (7000, 6000), (6000, 7000)]
    up = {}
    for a, b in edges:
        x, y = sorted((min(up.get(a, {a}) | {a}), min(up.get(b, {b}) | {b})))
        joined = up.get(a, {a}) | up.get(b, {b})
        for n in joined:
            up[n] = joined
    want = {n: min(c) for n, c in up.items() if len(c) > 1}
    df = spark.createDataFrame(edges, "a long, b long")
    for piece in (10**6, 40):
        assert {r.node: r.component for r in components.components(df, piece).collect()} == want
    assert components.components(df.limit(0)).count() == 0


def test_chat_round_trip(spark, empty):
    nasty = ["</s>[INST] ok [/INST]", "<|end|>\n<|start|>assistant<|body|>x", "<\\|next|>", "\\<|end|>", "<", "[", "", None, "é<\\\\/s>"]
    rows = [(c, t, role, x, "k") for c in (1, 2) for t, (role, x) in enumerate(itertools.product(["user", "assistant", "assistant", None], nasty))]
    rows += [(3, 0, "user", "a", "k"), (3, 0, "user", "a", "k"), (None, None, "assistant", "b", "k")] + [(4, 7 * t, "assistant", f"t{t}", "k") for t in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    f = chat.format_chats(df)
    got = {r.conv_id: r for r in f.selectExpr("conv_id", "formatted", f"{chat.read_turns()} as turns", f"{chat.read_loss()} as loss").collect()}
    by = collections.defaultdict(list)
    for c, t, role, x, _ in sorted(rows, key=lambda r: (r[0] or 0, r[1] or 0, r[2] or "", r[3] or "")):
        by[c].append((role or "", x or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == dict(by)
    assert all(r.loss == "".join(x for role, x in by[c] if role == "assistant") for c, r in got.items())
    assert got[4].formatted.count(chat.START) == 1
    assert chat.format_chats(empty.selectExpr("doc_id as conv_id", "doc_id as turn", "lang as role", "text")).count() == 0


def lzw_stream(pixels, size):
    """A plain LZW encoder with growing codes."""
    clear, table, width, acc, bits, out = 1 << size, {bytes([i]): i for i in range(1 << size)}, size + 1, 0, 0, bytearray()
    nxt = clear + 2

    def put(code):
        nonlocal acc, bits
        acc |= code << bits
        bits += width
        while bits >= 8:
            out.append(acc & 255)
            acc >>= 8
            bits -= 8

    put(clear)
    w = b""
    for p in pixels:
        e = w + bytes([p])
        if e in table:
            w = e
            continue
        put(table[w])
        if nxt < 4096:
            table[e] = nxt
            nxt += 1
            if nxt > 1 << width and width < 12:
                width += 1
        else:
            put(clear)
            table, nxt, width = {bytes([i]): i for i in range(clear)}, clear + 2, size + 1
        w = bytes([p])
    put(table[w])
    put(clear + 1)
    out.append(acc & 255)
    return bytes(out)


def test_lzw_streams():
    for size, n in ((8, 20_000), (2, 5000), (4, 40_000)):
        px = bytes(random.choice([0, 1, 2, 3, 3, 3]) if random.random() < 0.9 else random.randrange(1 << size) for _ in range(n))
        assert gif.lzw(lzw_stream(px, size), size, n).tobytes() == px
        assert gif.lzw_encode(px, size)[:400] == lzw_stream(px, size)[:400] and gif.lzw(gif.lzw_encode(px, size), size, n).tobytes() == px
    for n in (1, 2, 253, 3838, 3839, 3840, 3841, 7680, 12_288):
        px = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
        assert gif.lzw(gif.lzw_encode(px), 8, n).tobytes() == px and gif.lzw(gif.lzw_encode(px), 8, n + 1) is None
    one = bytes(60_000)  # grows one entry a code; a dictionary that is never cleared goes on with 12 bits
    assert gif.lzw(gif.lzw_encode(one), 8, len(one)).tobytes() == one
    late = np.concatenate([[256], np.arange(5000) % 250, [257]])
    width = np.concatenate([[9], gif._widths(8), np.full(905, 12)])[: len(late)]
    bits = "".join(format(int(c), f"0{w}b")[::-1] for c, w in zip(late, width))
    packed = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    assert gif.lzw(packed, 8, 5000).tolist() == (np.arange(5000) % 250).tolist()


def test_cut_and_hostile_gifs(spark):
    text = prose(4000).encode()
    raw = gif.write_gif(gif.payload_of(text))
    whole = [f["canvas"].tobytes() for f in gif.read_gif(raw)]
    assert len(whole) == 3 or len(whole) == -(-len(gif.payload_of(text)) // (192 * 64))
    for cut in [*range(0, 900), *range(900, len(raw), 97)]:
        got = [f["canvas"].tobytes() for f in gif.read_gif(raw[:cut])]
        assert got == whole[: len(got)] and (cut < len(raw) - 1) >= (len(got) < len(whole))
    random.seed(9)
    for _ in range(300):  # any damage is defined: some frames, no error
        bad = bytearray(raw)
        for _ in range(4):
            bad[random.randrange(len(bad))] = random.randrange(256)
        assert len(list(gif.read_gif(bytes(bad)))) <= 400
    huge = b"GIF89a" + b"\xff\xff\xff\xff\xf7\0\0" + raw[13:]
    assert list(gif.read_gif(huge)) == []
    media = spark.createDataFrame([(1, 5, None), (2, None, bytearray(b"no gif")), (None, 3, bytearray(raw[:400])), (4, 4, bytearray(huge))], "doc_id long, n_bytes long, media binary")
    assert {(r.doc_id, r.payload_bytes) for r in gif.digests(media).collect()} == {(1, 0), (2, 0), (None, 0), (4, 0)}
    assert gif.frames(media).count() == 0


def test_gif_disposal_and_transparency():
    head = b"GIF89a" + bytes([2, 0, 1, 0, 0x80, 0, 0]) + bytes([255, 0, 0, 0, 0, 255])

    def frame(px, disposal, clear=None):
        data = lzw_stream(px, 2)
        return b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 5, 0, clear or 0, 0]) + b"\x2c" + bytes([0, 0, 0, 0, 2, 0, 1, 0, 0, 2, len(data)]) + data + b"\0"

    got = [(f["start_ms"], f["canvas"][0].tolist()) for f in ({**f, "canvas": f["canvas"].copy()} for f in gif.read_gif(head + frame([0, 0], 1) + frame([1, 0], 3, 0) + frame([1, 1], 2) + frame([0, 1], 0, 0) + b"\x3b"))]
    red, blue, none = [255, 0, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert got == [(0, [red, red]), (50, [blue, red]), (100, [blue, blue]), (150, [none, blue])]
    assert list(gif.read_gif(b"no gif")) == []


def test_gif_media(spark, edge, empty):
    import hashlib
    import zlib

    got = gif.digests(gif.store_texts(edge)).collect()
    assert len(got) == edge.count()
    text = {r.doc_id: (r.text or "").encode() for r in edge.collect()}
    for r in got:
        if r.doc_id is not None:
            p = gif.payload_of(text[r.doc_id])
            colour = collections.Counter((b >> 5) * 36 // 64 * 16 + (b >> 2 & 7) * 36 // 64 * 4 + (b & 3) * 85 // 64 for b in p)
            assert r.feature == ",".join(str(colour[i]) for i in range(64))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert gif.frames(gif.store_texts(edge)).where("size(colours) = 64").count() >= edge.count()
    assert gif.digests(gif.store_texts(empty)).count() == 0


def test_topk_brute_force(spark):
    rng = np.random.default_rng(3)
    v = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.1, 1, 5])]) for i in range(450)]
    v += [(500, v[3][1]), (501, v[3][1]), (600, None), (700, []), (800, [float("nan")] * 8), (900, [None] * 8), (None, [1.0] * 8), (100, v[100][1]), (1000, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1.0) for r in v], "vec_id long, embedding array<double>, norm double")
    ok = [(i, [math.floor(1024 * x) for x in e]) for i, e in v if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    want = set()
    for q, e in {i: x for i, x in reversed(ok) if i % 100 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(e, x)), i) for i, x in ok if i != q)[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk.exact_topk(df).collect()} == want
    assert topk.exact_topk(df.limit(0)).count() == 0


def test_lm_scores_brute_force(spark, edge, empty):
    df = edge.where("doc_id is not null and doc_id <> 8").withColumn("is_target", F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("doc_id") % 2 == 0))
    rows = [(r.doc_id, (r.text or "").encode().lower().split(), bool(r.is_target)) for r in df.collect()]
    big, hist = ([collections.Counter(), collections.Counter()] for _ in range(2))
    own = {}
    for d, w, t in rows:
        s = [b"\0<", *w, b"\0>"] if w else []
        own[d] = collections.Counter(zip(s, s[1:])), collections.Counter(s[:-1])
        for k in (0, 1) if t else (1,):
            big[k].update(own[d][0])
            hist[k].update(own[d][1])
    v, beta = len(hist[1]), lm_score.BETA
    got = {r.doc_id: r.score for r in lm_score.cross_entropy_difference(df).collect()}
    for d, w, t in rows:
        if not w:
            assert got[d] is None
            continue
        loss = [sum(-tf * math.log((big[k][b] - mine * tf + beta / v) / (hist[k][b[0]] - mine * own[d][1][b[0]] + beta)) for b, tf in own[d][0].items()) for k, mine in ((0, t), (1, 1))]
        assert got[d] == pytest.approx((loss[0] - loss[1]) / (len(w) + 1), abs=1e-6)
    assert lm_score.cross_entropy_difference(edge.withColumn("is_target", F.lit(True))).count() == edge.count()
    assert lm_score.cross_entropy_difference(empty.withColumn("is_target", F.lit(True))).count() == 0


def test_warc_audit(spark):
    rows = [(i, f"u{i}", "h" * (i % 50), 1) for i in range(9000)] + [(7, "u7", "h" * 7, 1), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, idx long")
    a, b = warc.replicas(pages)
    got = warc.audit(a, b).collect()
    assert len(got) == len(rows)
    assert {r.page_id for r in got if r.status == "corrupt"} == {i for i in range(0, 9000, 97)}
    cut = warc.audit(a, a.where("page_id < 8990")).where("status <> 'ok'")
    assert {(r.page_id, r.status) for r in cut.collect()} == {(i, "missing") for i in range(8990, 9000)} | {(None, "missing")}
    assert {r.status for r in warc.audit(a.where("page_id < 4096"), a).where("page_id > 4095").collect()} == {"extra"}
    assert warc.audit(a.limit(0), a.limit(0)).count() == 0


def test_warc_audit_locates_records_lost_and_added_in_the_middle(spark):
    rows = [(i, f"u{i}", f"h{i}") for i in range(6000) if i not in (700, 5000)] + [(1000, "u1000", "x"), (None, None, "p"), (None, None, "q")]
    a, _ = warc.replicas(spark.createDataFrame(rows, "page_id long, url string, html string"))
    other = [r for r in rows if r[0] not in (100, 4500) and r[2] != "p"] + [(700, "u", "h"), (5000, "u", "h"), (2000, "u2000", "y")]
    other = [(i, u, "z" * 9) if i == 3000 else (i, u, h) for i, u, h in other if (i, h) != (1000, "h1000")]
    b, _ = warc.replicas(spark.createDataFrame(other, "page_id long, url string, html string"))
    got = warc.audit(a, b).collect()
    bad = collections.Counter((r.page_id, r.status) for r in got if r.status != "ok")
    assert bad == collections.Counter({(100, "missing"): 1, (4500, "missing"): 1, (None, "missing"): 1, (1000, "missing"): 1, (3000, "corrupt"): 1, (700, "extra"): 1, (5000, "extra"): 1, (2000, "extra"): 1})
    assert len(got) == len(rows) + 3 and {r.page_id: r.idx for r in got if r.status == "ok"}[699] == 699


def test_warc_repeated_records_and_ids(spark):
    """A third without ids, a third of one id, many equal ones; damage among them."""
    rows = [((None, 7, i)[i % 3], "u", f"h{i % 40 if i % 2 else i}") for i in range(3000)]
    a, _ = warc.replicas(spark.createDataFrame(rows, "page_id long, url string, html string"))
    lost = rows[:30] + rows[36:-6] + [(7, "u", "new"), (None, "u", "new")]
    b, _ = warc.replicas(spark.createDataFrame(lost, "page_id long, url string, html string"))
    got = warc.audit(a, b).collect()
    key = lambda t: collections.Counter((r.page_id, r.hash) for r in t.collect())
    left, more = key(a) - key(b), key(b) - key(a)
    bad = collections.Counter(r.status for r in got if r.status != "ok")
    assert bad["corrupt"] + bad["missing"] == sum(left.values()) and bad["corrupt"] + bad["extra"] == sum(more.values()) and bad["corrupt"] == 1
    assert len(got) == len(rows) + bad["extra"]
    by = collections.defaultdict(list)
    for r in got:
        if r.status != "extra":
            by[r.archive].append(r)
    for own in by.values():  # places are gapless and offsets add up
        own.sort(key=lambda r: r.idx)
        assert [r.idx for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]


def test_warc_reader(spark, tmp_path):
    import gzip

    rows = [(1, "http://a/é", "<p>žluť\r\n\r\n</p>"), (2, "", ""), (3, "http://c", "WARC/1.0\r\n\r\n" * 3), (None, None, None), (4, "u", "x" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = [r.x.encode() for r in df.select(warc.record(F.col("page_id"), F.col("url"), F.col("html")).alias("x")).collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(made))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    (tmp_path / "c.warc").write_bytes(b"".join(made)[:-5])
    (tmp_path / "d.warc").write_bytes(b"nothing")
    got = collections.defaultdict(list)
    for r in warc.read_warc(spark.read.format("binaryFile").load(str(tmp_path))).collect():
        got[r.path[-10:].split("/")[-1]].append(r)
    assert {k: len(v) for k, v in got.items()} == {"a.warc": 5, "b.warc.gz": 5, "c.warc": 4}
    for own in got.values():
        own.sort(key=lambda r: r.offset)
        assert [(r.offset, r.length) for r in own] == [(sum(map(len, made[:i])), len(made[i])) for i in range(len(own))]
        assert [(r.uri, bytes(r.body).decode()) for r in own] == [(u or "", h or "") for _, u, h in rows[: len(own)]]
        assert all(r.date == warc.DATE and r.type == "resource" for r in own) and own[0].record_id == "<urn:page:1>"


def test_mixing_targets_and_quotas(spark, edge, empty):
    for df in (edge, spark.read.parquet(f"{D}/documents.parquet")):
        rows = mixing.plan(df).collect()
        assert len(rows) == df.count()
        src = {(r.source_size, r.target) for r in rows}
        assert sum(t for _, t in src) == pytest.approx(1.5 * sum(s for s, _ in src)) or len(src) < 3
        assert all(r.taken == r.size * len(r.shards) and r.taken <= 2 * r.size for r in rows)
        assert sorted(map(str, rows)) == sorted(map(str, mixing.plan(df).collect()))
    assert mixing.mixture(df).columns == df.columns
    assert mixing.mixture(df).count() == sum(len(r.shards) for r in rows)
    assert mixing.plan(empty).count() == 0 and mixing.mixture(empty).count() == 0


def test_mixture_takes_rows_not_ids(spark):
    """A third of the rows without an id, a third of repeated ids, some equal rows."""
    rows = [((None, i % 20, 10**6 + i)[i % 3], f"t{i if i < 2900 else 2900 + i % 2} " + "w " * (i % 9), "en", "abc"[i % 7 % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    plan = mixing.plan(df).collect()
    size = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in "abc"}
    target = {r.source_size: r.target for r in plan}
    taken = {n: sum(r.taken for r in plan if r.source_size == n) for n in target}
    assert sorted(size.values()) == sorted(target)
    got = mixing.mixture(df).collect()
    words = collections.Counter()
    for r in got:
        words[size[r.source]] += len(r.text.split())
    assert words == taken and all(0 <= target[n] - taken[n] < 2 for n in target)
    copies, given = collections.Counter((r.doc_id, r.text, r.lang, r.source) for r in got), collections.Counter(rows)
    assert all(n <= 2 * given[k] for k, n in copies.items())
    assert len({tuple(r.shards) for r in plan if r.doc_id is None}) > 8
    assert sorted(map(str, plan)) == sorted(map(str, mixing.plan(df.repartition(2, "text")).collect()))


def brute_targets(sizes):
    """Shares by weight, what goes beyond twice a source's size reshared until nothing does."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        factor = left / sum(weight[s] for s in free)
        over = {s for s in free if factor * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: factor * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over
    return target


def test_mixing_equals_targets_by_hand(spark, edge):
    import re

    for df in (edge, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        docs = df.collect()
        size = [len(re.findall("[^\\x20\\x09-\\x0D]+", r.text or "")) for r in docs]
        sizes = collections.Counter()
        for r, n in zip(docs, size):
            sizes[r.source] += n
        want, rows = brute_targets(sizes), mixing.plan(df).collect()
        key = lambda rows: collections.Counter((d, n, s, round(t, 3)) for d, n, s, t in rows)
        assert key((r.doc_id, r.size, r.source_size, r.target) for r in rows) == key((r.doc_id, n, sizes[r.source], want[r.source]) for r, n in zip(docs, size))
        of = {r.doc_id: r.source for r in docs}
        taken, copies = collections.Counter(), collections.defaultdict(set)
        for r in rows:
            if r.doc_id is not None:
                copies[of[r.doc_id]].add(len(r.shards))
                taken[of[r.doc_id]] += r.taken
                assert r.taken == r.size * len(r.shards)
        for s, got in taken.items():  # whole passes, and one more of some documents; what is left holds no small document
            if None not in {r.doc_id for r in docs}:
                assert got <= want[s] + 1 and want[s] - got <= max(200, 0.05 * want[s])
            assert max(copies[s]) - min(copies[s]) <= 1


def test_targets_equal_sql_on_edge_rows(spark, edge):
    """Sources that reach their most, one by one and all at once, without words, and null."""
    import duckdb

    several = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 5), ("b", 900), ("c", 40), ("d", 0), ("e", 300), (None, 7), ("f", 2)])]
    alone = [(1, "one two", "x"), (2, None, None)]
    for df in (edge.select("doc_id", "text", "source"), *(spark.createDataFrame(r, "doc_id long, text string, source string") for r in (several, alone))):
        con = duckdb.connect()
        con.register("documents", df.toArrow())
        key = lambda r: tuple((x is None, x) for x in r)
        want = sorted(con.execute(f"select doc_id, size, source_size, target from ({mixing.TARGETS_SQL})").fetchall(), key=key)
        got = sorted((tuple(r) for r in mixing.plan(df).select("doc_id", "size", "source_size", "target").collect()), key=key)
        assert len(got) == len(want) and all(a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-12) for a, b in zip(got, want, strict=True))


def test_split_keeps_quotas(spark):
    q = spark.createDataFrame([(1, 1000), (2, 37), (3, 0), (4, 5)], "index int, quota long")
    got = mixing.split(q, 4).collect()
    assert {i: sum(r.quota for r in got if r["index"] == i) for i in (1, 2, 3, 4)} == {1: 1000, 2: 37, 3: 0, 4: 5}
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.quota
        assert r.quota >= 0
    assert max(size.values()) - min(size.values()) <= 1 and len(size) == 16


def test_packing_is_best_fit_without_conflicts(spark, edge, empty):
    rows = [(i, random.randrange(1, 900), random.choice("abc"), random.randrange(200)) for i in range(600)]
    got = packing.pack_rows(rows, 1000, 2)
    kind = {r[0]: r for r in rows}
    bins = collections.defaultdict(list)
    for d, _, _, n, b, at in got:  # in packing order: no compatible bin was tighter
        fits = [(1000 - sum(x[1] for x in v), k) for k, v in bins.items() if 1000 - sum(x[1] for x in v) >= n and kind[d][3] not in {kind[x[0]][3] for x in v} and sum(kind[x[0]][2] == kind[d][2] for x in v) < 2]
        assert (min(fits)[0] == 1000 - sum(x[1] for x in bins[b])) if fits else b not in bins
        assert at == sum(x[1] for x in bins[b])
        bins[b].append((d, n))
    out = packing.pack(edge, capacity=512).collect()
    assert sum(r.n_words for r in out) == edge.select(F.sum(F.size(F.expr("filter(split(coalesce(text, ''), '[ \\t\\n]+'), x -> x <> '')")))).first()[0]
    assert packing.pack(empty).count() == 0
    # classes of near duplicates as clusters: no bin has two of one; several shards are packed apart; bins are well filled
    docs = spark.createDataFrame([(i, prose(random.randrange(20, 200)), f"s{i % 40}", i // 3) for i in range(600)], "doc_id long, text string, source string, near long")
    out = packing.pack(docs, capacity=1000, cluster_col="near").collect()
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.bin_id].append(r)
    assert all(len({r.doc_id // 3 for r in v}) == len(v) for v in bins.values())
    assert sum(r.n_words for r in out) >= 0.9 * 1000 * len(bins)
    many = docs.selectExpr("doc_id", "'a b' as text", "source").crossJoin(spark.range(30)).selectExpr("doc_id * 30 + id as doc_id", "concat(text, doc_id, ' ', id) as text", "source")
    shards = {r.bin_id >> 32 for r in packing.pack(many).collect()}
    assert shards == {0, 1}


def test_url_rules_and_trees(spark):
    cases = [("http://a.net/x", "net/", "block"), ("HTTP://WWW.Example.NET/en/1?x", "example.net/en/", "allow"), ("http://example.com/de/", "example.com/de/", "block"), ("http://x.org/fr/1#a", "org/fr/", "allow"), ("http://anet/x", None, None), ("http://a.net", None, None), (None, None, None), ("no url", None, None), ("http://x.org/fr", None, None)]
    pages = spark.createDataFrame([(i, u, "z") for i, (u, _, _) in enumerate(cases)], "page_id long, url string, length string")
    none = spark.createDataFrame([], "id long, label int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, none).collect()}
    for i, (_, rule, verdict) in enumerate(cases):
        assert got[i].rule == rule and got[i].verdict == (verdict or "allow")
    assert (got[1].host, got[1].path, got[6].host, got[7].path) == ("www.example.net", "/en/1", "", "")
    urls = [(i, f"http://s{i % 7}.com/" + ("a/b/c/d/" if i % 2 else "x") + f"?p={i}", i % 2) for i in range(200)]
    df = spark.createDataFrame(urls, "page_id long, url string, label int")
    out = url_filter.filter_urls(df, df.where("page_id < 120").selectExpr("page_id as id", "label")).where("page_id >= 120").collect()
    assert sum((r.verdict == "block") == bool(r.page_id % 2) for r in out) >= 0.95 * len(out)
    assert url_filter.filter_urls(df.limit(0), none).count() == 0


def test_url_parts_and_rules_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view pages as select * from '/root/testdata/sf0.01/pages.parquet'")
    want = {r[0]: r[1:] for r in con.execute(url_filter.RULES_SQL).fetchall()}
    got = queries.QUERIES["op8_url_filter"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(want)
    for r in got:
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ({verdict} if rule else {"allow", "block"})


def test_trees_decide_where_urls_tell(spark):
    """Labels follow the look of URLs but for a tenth; half of the pages are held out. Rows repeat and some URLs are very long."""
    random.seed(4)
    rows = []
    for i in range(3000):
        bad = i % 4 == 0
        url = f"http://h{i % 50}.com/" + ("-".join(random.choice("0123456789") for _ in range(9)) + "?a=1&b=2" if bad else "/".join(random.choices(VOCAB, k=3)))
        rows.append((i, url, int(bad) if random.random() > 0.05 else int(not bad)))
    rows += [(5000, "http://x.com/" + "a1/" * 70_000, 0), (5001, None, 0)] + rows[:20]
    df = spark.createDataFrame(rows, "page_id long, url string, label int")
    out = url_filter.filter_urls(df, df.where("page_id % 2 = 0").selectExpr("page_id as id", "label")).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.page_id % 2 and r.page_id < 3000] + [r for r in out if r.page_id % 2 == 0 and r.page_id < 3000]
    bad, good = [r.verdict == "block" for r in held if r.page_id % 4 == 0], [r.verdict == "block" for r in held if r.page_id % 4]
    assert sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.05 * len(good)


def test_cut_needs_more_than_chance(spark):
    random.seed(1)
    noise = spark.createDataFrame([(random.random() - 1.5, float(random.random() < 0.25)) for _ in range(800)], "score double, label double")
    assert url_filter.cut(noise) == 0.0
    rare = spark.createDataFrame([(-2.0 + (i % 10 == 0), float(i % 10 == 0)) for i in range(500)], "score double, label double")
    assert url_filter.cut(rare) == -1.5


def test_suffix_statistics_cover_all_labelled_pages(spark, monkeypatch):
    """Labels follow the suffix alone, and most suffixes aren't in the sample that trees are fitted to. A page's own label doesn't
    count toward its suffix's rate, so that each suffix has twelve."""
    monkeypatch.setattr(url_filter, "SAMPLE", 40)
    rows = [(12 * i + k, f"http://s{1000 + i * 7}.com/x", i % 2) for i in range(100) for k in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, label int")
    got = url_filter.filter_urls(df, df.selectExpr("page_id as id", "label")).collect()
    want = {i: y for i, _, y in rows}
    assert len(got) == len(rows) and sum((r.verdict == "block") == bool(want[r.page_id]) for r in got) >= 0.99 * len(got)


def test_quality_on_held_out_labels(spark, edge, empty):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    hold = known.where("doc_id % 3 = 0")
    got = quality.classify(docs, known.where("doc_id % 3 <> 0")).select("doc_id", "keep").join(hold, "doc_id").collect()
    clean = [r.keep for r in got if r.quality == 1 and not r.toxic]
    assert sum(clean) >= 0.98 * len(clean)
    bad = [not r.keep for r in got if r.quality == 0]
    assert sum(bad) >= 0.9 * len(bad)
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, known.where("doc_id % 3 <> 0")).select("doc_id", "keep").join(known.where("doc_id % 3 = 0"), "doc_id").collect()
    toxic, clean = [not r.keep for r in got if r.toxic], [r.keep for r in got if r.quality == 1 and not r.toxic]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) >= 0.99 * len(clean)
    assert all(r.keep for r in quality.classify(edge, labels(spark)).collect())
    assert quality.classify(edge, labels(spark, [(3, 0, 0), (3, 1, 0), (4, None, 1)])).where("not keep").select("doc_id").distinct().count() >= 1
    assert quality.classify(empty, labels(spark)).count() == 0


def test_shapes_and_buckets_by_hand(edge):
    """What arrays over slabs say of each text, against plain Python over that text alone."""
    np.seterr(over="ignore")
    texts = [(r.text or "").encode() for r in edge.collect()] + [b"a b!! B!! 12|3", b"!!! ...", "réeux réeuxment Réeux,".encode(), b"\n\nx\n"]
    slab = quality.Slab(texts)
    shape = slab.shape()
    strip = bytes(np.flatnonzero(quality._STRIP).tolist())
    d, k = slab.buckets()
    for i, t in enumerate(texts):
        w = t.split()
        if not w:
            assert shape[i].tolist() == [1, -1, *[0] * 8]
            assert not (d == i).any()
            continue
        low = t.lower() if t.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in t)
        lw, letters = low.split(), sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in t)
        want = [1, math.log(len(w)) / 5 - 1, len(set(lw)) / len(w), sum(x[-1:] in b"!#$%&*+/<=>@\\^_`{|}~" for x in w) / len(w), sum(65 <= b <= 90 for b in t) / max(1, letters), max(1, letters) / len(t), len(t) / len(w) / 10, sum(a == b for a, b in zip(lw, lw[1:])) / max(1, len(w) - 1), sum(48 <= b <= 57 for b in t) / len(t), 10 * t.count(b"|") / len(t)]
        assert shape[i].tolist() == pytest.approx(want)
        own = {x.strip(strip) for x in lw} - {b""}
        assert (d == i).sum() == len(own)
        assert len(np.unique(k[d == i])) == pytest.approx(len({x[:n] + b"/%d" % n for x in own for n in quality.BEGINNINGS if len(x) > n} | own), rel=0.01)  # buckets may be shared by chance
    a, b = (quality.Slab([x]).buckets()[1] for x in ("réeuxment".encode(), b"..R\xc3\xa9eux-"))
    assert set(a.ravel().tolist()) & set(b.ravel().tolist())  # same beginning
    alone = np.concatenate([quality.Slab([t]).shape() for t in texts])
    assert np.allclose(alone, shape)


def test_rates_are_shrunk_by_hand(spark):
    """Site and path rates and the combined probability, from each row's own evidence, in plain Python."""
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, known).join(docs.select("doc_id", "source", "lang"), "doc_id").join(known.withColumnRenamed("toxic", "is_toxic"), "doc_id", "left").collect()
    p = lambda x: 1 / (1 + math.exp(-x))
    bad = {r.doc_id: float(r.quality == 0 or r.is_toxic == 1) if r.quality is not None else 1 - (1 - p(r.low)) * (1 - p(r.toxic)) for r in rows}
    total = sum(bad.values()) / len(rows)

    def groups(key):
        n, b = collections.Counter(), collections.Counter()
        for r in rows:
            n[key(r)] += 1
            b[key(r)] += bad[r.doc_id]
        return n, b

    def strength(n, b, mean):
        g = [(n[x], b[x] / n[x], mean(x)) for x in n if n[x] > 1]
        chance = [m * (1 - m) for _, _, m in g]
        spread = max(0, (sum(k * (r - m) ** 2 for k, r, m in g) - sum(chance)) / sum(k for k, _, _ in g))
        return min(1000, max(20, sum(chance) / len(g) / spread - 1)) if spread else 1000

    n, b = groups(lambda r: r.source)
    k = strength(n, b, lambda x: total)
    site = {x: (b[x] + k * total) / (n[x] + k) for x in n}
    n, b = groups(lambda r: (r.source, r.lang))
    k = strength(n, b, lambda x: site[x[0]])
    path = {x: (b[x] + k * site[x[0]]) / (n[x] + k) for x in n}
    logit = lambda x: math.log(x / (1 - x))
    for r in rows:
        at = path[r.source, r.lang]
        shift = logit(at) - logit(total)
        assert (r.site_rate, r.path_rate) == pytest.approx((site[r.source], at), abs=2e-5)
        reject = 1 - (1 - p(r.low + shift)) * (1 - p(r.toxic + shift))
        assert r.p_reject == pytest.approx(reject, abs=2e-4)
        assert r.known_bad == (None if r.quality is None else r.quality == 0 or r.is_toxic == 1)
        assert r.keep == (not r.known_bad if r.known_bad is not None else r.p_reject <= 0.5)


def test_pipeline_whole(spark):
    """run() against its parts: what quality keeps, one of each brute-force group, whole passes of the mix, all words packed."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = quality.classify(docs, spark.read.parquet(f"{D}/labels.parquet")).where("keep").select("doc_id")
    one = brute_components([(r.doc_id, r.text) for r in docs.join(kept, "doc_id").collect()])
    mix = {r.doc_id: r for r in mixing.plan(docs.where(F.col("doc_id").isin([d for d, (_, c) in one.items() if c == d]))).collect()}
    out = corpus_pipeline.run(spark, D).collect()
    words = collections.Counter()
    for r in out:
        words[r.doc_id] += r.n_words
    assert +words == +collections.Counter({d: r.taken for d, r in mix.items()})
    assert collections.Counter(r.doc_id for r in out if r.piece == 0) == collections.Counter({d: len(r.shards) for d, r in mix.items() if r.shards})
    assert sorted(map(tuple, corpus_pipeline.run(spark, D).select("doc_id", "piece", "n_words").collect())) == sorted((r.doc_id, r.piece, r.n_words) for r in out)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    a = corpus_pipeline.quality(spark, docs, D)
    assert a.columns == docs.columns and 0 < a.count() < docs.count()
    b = corpus_pipeline.near_duplicates(spark, a, D)
    want = brute_components([(r.doc_id, r.text) for r in a.collect()])
    assert {r.doc_id for r in b.collect()} == {d for d, (_, c) in want.items() if c == d}
    c = corpus_pipeline.mixed(spark, b, D)
    assert c.columns == docs.columns
    assert corpus_pipeline.packed(spark, c, D).where("piece = 0").count() == c.count()


def test_quality_stage_filters_rows_by_their_own_verdict(spark):
    where = "/root/testdata/sf0.01"
    docs = written(spark.read.parquet(f"{where}/documents.parquet").limit(400), "test")
    docs = docs.unionAll(docs.withColumn("doc_id", F.lit(None).cast("long"))).unionAll(docs.withColumn("doc_id", F.lit(10**9).cast("long")))
    verdicts = quality.classify(docs, spark.read.parquet(f"{where}/labels.parquet")).collect()
    for i in (None, 10**9):
        assert {r.keep for r in verdicts if r.doc_id == i} == {True, False}
    kept = corpus_pipeline.quality(spark, docs, where).collect()
    assert collections.Counter(r.doc_id for r in kept) == collections.Counter(r.doc_id for r in verdicts if r.keep)


def test_one_bad_id_changes_no_other_choice(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    text = prose(60)
    own = spark.createDataFrame([(5, text, "en", "s", 1), (3, text, "en", "s", 1), (None, text, "aa", "s", 1), (8, text, "en", "s", 1), (8, text, "aa", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    own = own.withColumn("doc_id", F.col("doc_id") + 10**6)
    plain = collections.Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs.unionByName(own.where("doc_id % 1000 in (3, 5)")), D).collect())
    bad = spark.createDataFrame([(None, prose(50), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    every = docs.unionByName(own).unionByName(bad)
    for df in (every, every.orderBy(F.desc("n_chars")), every.repartition(5, "text")):
        assert collections.Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, D).collect()) == plain + collections.Counter({None: 1})
    assert plain[10**6 + 3] == 1 and plain[10**6 + 5] == 0


def test_sample_is_bounded_where_an_id_repeats(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 100)
    rows = spark.range(50_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text of "), (F.col("id") % 5000).cast("string")).alias("text"), F.lit("s").alias("site"), F.lit("en").alias("path"))
    rows = rows.unionByName(spark.range(30).select("id", F.lit("other words").alias("text"), F.lit("s").alias("site"), F.lit("en").alias("path")).withColumnRenamed("id", "doc_id"))
    pick = spark.range(30).select(F.col("id").alias("doc_id"), F.lit(1).alias("known_quality"), F.lit(0).alias("known_toxic"))
    got = [quality.bounded(df, pick).select("text").collect() for df in (rows, rows.repartition(9))]
    assert sorted(got[0]) == sorted(got[1]) and len(got[0]) == 100


def test_many_sources(spark):
    r = random.Random(11)
    rows = [(i, " w" * r.choice([1, 3, 20]), f"s{r.randrange(700):05d}" if i % 9 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, got = brute_targets(sizes), mixing.plan(df).collect()
    taken = collections.Counter()
    for x in got:
        taken[rows[x.doc_id][2]] += x.taken
        assert abs(x.target - want[rows[x.doc_id][2]]) < 1e-6 and x.taken <= 2 * x.size
    assert sum(abs(taken[s] - want[s]) for s in sizes) < 0.2 * sum(want.values())


def test_stages_on_edge_rows(spark, edge, empty):
    kept = corpus_pipeline.near_duplicates(spark, edge, D).collect()
    rows = [(i, r.text) for i, r in enumerate(edge.collect())]
    want = brute_components(rows)
    assert len(kept) == sum(c == i for i, (_, c) in want.items())  # ids are null and repeat: rows count
    assert collections.Counter(frozenset(sets(r.text)) for r in kept).most_common(1)[0][0] == frozenset()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, D).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edge, D).columns == edge.columns


def test_oracle_sql(spark):
    from tests.test_catalog import compare

    for name, sql in queries.ORACLE.items():
        compare(spark, queries.QUERIES[name], sql)
