"""Array kernels of the grouped prefix join: prefixes, parts, overlap counting, verification.

Order of shingles: those that a fixed-size count sketch calls frequent come last, the rest by hash. Any order that all
documents share is right; this one keeps common passages out of the prefixes.

A document of n shingles keeps its first q = n - floor(KEEP * n) as prefix, in the second round besides all that aren't frequent
(q may be chosen for each document). Documents that link have R = ceil(3(nx+ny)/7)
shingles in common, so their prefixes have at least R - max(nx-qx, ny-qy) in common (all later ones lie beyond one of the
two prefixes). Linked sizes differ by a factor of 4/3 at most: a document stands in its size bucket and, as a guest, in the
next. A bucket's prefixes are split by hash into classes; by the pigeonhole principle some class holds its share of the
common ones. A part is one class of one bucket. A bucket of many documents has more classes (up to FINER times as many), and
only beyond that are its documents dealt to pairs of blocks.
"""

from __future__ import annotations

import numpy as np

from talkloom.llm.shingle import mix

SKETCH_BITS = 20
KEEP = 0.65
MAX_CLASSES = 1024
#: Documents of a bucket that one part may hold, with their prefixes or with whole sets; larger buckets have more classes, then
#: pairs of blocks.
BLOCK_DOCS, WHOLE_DOCS, FINER = 60_000, 20_000, 4
#: Best partners of a document that a part emits at once; the others follow when the components of these are known.
FIRST_PAIRS = 3
#: Postings of a token that are all paired in the first round; in longer lists each meets its next WINDOW ones and the PIVOTS
#: documents of the list that have least besides shingles of long lists: what a group of near copies has in common.
LONG_LIST, WINDOW, PIVOTS = 64, 4, 4
#: Members of a group, and pairs of members of two groups, up to which all are paired; beyond it each has one partner.
MEMBERS, MEMBER_PAIRS = 4, 16


def levels(sketch: np.ndarray) -> np.ndarray:
    """For each counter of the sketch 0, or for those above what chance puts into one the power of two of the count. Chance is told by the
    spread, not by the mean alone: a share of the mean would grow with the input, and with it the lists of shingles below it."""
    mean = sketch.sum() / len(sketch)
    return np.where(sketch > np.minimum(4 * mean, mean + 8 * np.sqrt(mean)) + 16, np.log2(np.maximum(sketch, 1)) + 1, 0).astype(np.uint8)


def ordered(g: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Shingles as keys: level, then hash."""
    return (level[(g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (mix(g) >> np.uint64(6))


def prints(own: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set (sorted, bounds: cut); zeros for empty ones."""
    n = np.diff(cut)
    out, some = np.zeros((2, len(n)), np.uint64), n > 0
    if some.any():
        out[0, some] = np.bitwise_xor.reduceat(mix(own), cut[:-1][some])
        out[1, some] = np.add.reduceat(mix(own * np.uint64(0x9E3779B97F4A7C15) + np.repeat(n, n).astype(np.uint64)), cut[:-1][some])
    return out[0], out[1]


def bucket(n):
    """Size bucket, of one size or of an array of them."""
    b = (np.log(n) / np.log(4 / 3)).astype(np.int64)
    return b + ((4 / 3) ** (b + 1) <= n)


def classes(b: int, finer: int = 1, keep: float = KEEP) -> int:
    """Classes of a bucket: a document has about 34 shingles of its prefix in each, or with whole sets as prefix up to 256: where that
    is all it has, counts are exact."""
    return int(min(MAX_CLASSES, max(1, finer * (4 / 3) ** b / (96 if keep else 128))))


def prefix_length(n, keep: float = KEEP):
    return n - np.floor(keep * np.asarray(n)).astype(np.int64)


def splits(sizes: np.ndarray, docs: int = BLOCK_DOCS) -> dict[int, tuple[int, int]]:
    """bucket -> (finer, blocks) for the buckets of more than docs documents, its own and guests, given documents per bucket."""
    many = -(-(sizes + np.concatenate(([0], sizes[:-1]))) // docs)
    return {int(b): (int(min(m, FINER)), int(-(-m // FINER))) for b, m in enumerate(many) if m > 1}


def parts_of(n: np.ndarray, prefix: np.ndarray, token: np.ndarray, salt: np.ndarray, split: dict[int, tuple[int, int]], keep: float = KEEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, document, token), a part's tokens of one document in one run of those of the part: for each bucket a document stands in, each class, and each
    pair of blocks with its own. n, prefix, salt: of each document; token: their prefixes one after the other."""
    finer, blocks = (np.array([split.get(q, (1, 1))[i] for q in range(256)]) for i in (0, 1))
    of = np.array([classes(q, int(f), keep) for q, f in enumerate(finer)])
    doc, low, out = np.repeat(np.arange(len(n)), prefix), token & np.uint64(0xFFFFFFFF), []
    for q in (bucket(n), bucket(n) + 1):
        cls = ((low * of[q][doc].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        s = blocks[q]
        base, mine, times = q[doc] * MAX_CLASSES + cls, (salt % s.astype(np.uint64)).astype(np.int64), s[doc]
        d, t, base = np.repeat(doc, times), np.repeat(token, times), np.repeat(base, times)
        o = np.arange(len(d)) - np.repeat(np.cumsum(times) - times, times)
        out.append(((base << 32) + np.minimum(mine[d], o) * s[d] + np.maximum(mine[d], o), d, t))
    part, doc, token = (np.concatenate(x) for x in zip(*out, strict=True))
    return part, doc, token


def least(nx: np.ndarray, ny: np.ndarray, rx: np.ndarray, ry: np.ndarray) -> np.ndarray:
    """Prefix shingles that documents of these sizes, of which rx and ry lie beyond the prefixes, have in common at least, if they link."""
    return -(-3 * (nx + ny) // 7) - np.maximum(rx, ry)


def candidates(token: np.ndarray, doc: np.ndarray, n: np.ndarray, b: int, c: int, group: np.ndarray | None = None, keep: float = KEEP, most: int | None = None, room: int = 1_000_000, rest: np.ndarray | None = None):
    """Pairs of one part's documents with enough common tokens: yields (x, y, common), x before y. doc: index into n, which
    ascends. With group, pairs within a group aren't formed at all. With most, a posting that has more partners than that
    meets the next WINDOW of them, and all in its list meet the list's PIVOTS; the last item yielded is then (those documents
    whose lists were cut, None, None).
    Works through about room co-occurrences at a time. rest: shingles beyond each document's prefix, where keep doesn't tell."""
    rest = n - prefix_length(n, keep) if rest is None else rest
    place = np.arange(len(n), dtype=np.int32)
    if group is not None:  # documents of a group stand together
        place[np.lexsort((np.arange(len(n)), group))] = np.arange(len(n), dtype=np.int32)
    at = np.argsort(place)
    p = place[doc]
    o = np.lexsort((p, token))
    token, p = token[o], p[o]
    size, i = len(token), np.arange(len(token), dtype=np.int32)
    head = np.concatenate(([True], token[1:] != token[:-1])) if size else np.zeros(0, bool)
    rank = np.cumsum(head, dtype=np.int64) - 1
    cuts = np.append(np.flatnonzero(head), size)
    end = cuts[1:][rank].astype(np.int32)
    if group is None:  # the later ones of its token whose size is at most 4/3 of its own
        last = np.searchsorted(n, (4 * n) // 3, "right")
        begin, stop = i + 1, np.searchsorted(rank * (len(n) + 1) + p, rank * (len(n) + 1) + last[p], "left").astype(np.int32)
    else:
        g = group[at[p]]
        other = np.append(np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | head[1:]))) if size else [], size).astype(np.int32)
        begin, stop = other[np.searchsorted(other, i, "right")], end
    reach = np.maximum(0, np.minimum(stop, end) - begin)
    long, pivot, lead = np.zeros(len(cuts) - 1 if size else 0, bool), np.zeros((0, PIVOTS), np.int32), np.zeros(size, bool)
    if most is not None:
        long[rank[reach > most]] = True
        cut = np.unique(at[p[long[rank]]]) if size else np.zeros(0, np.int64)
        reach = np.where(reach > most, WINDOW, reach)
        shared = np.flatnonzero(long[rank])
        few = np.bincount(p, minlength=len(n)) - np.bincount(p[shared], minlength=len(n))
        shared = shared[np.lexsort((p[shared], few[p[shared]], rank[shared]))]
        first = np.searchsorted(rank[shared], np.flatnonzero(long))
        pivot = np.zeros((len(long), PIVOTS), np.int32)
        if len(shared):
            top = shared[first[:, None] + np.arange(PIVOTS)]
            pivot[long], lead[top] = p[top], True
        reach[lead] = 0
    del token, head, end, stop
    met = reach + PIVOTS * long[rank]
    by_doc = np.argsort(p, kind="stable")
    by_doc = by_doc[met[by_doc] > 0]
    cum = np.cumsum(met[by_doc], dtype=np.int64)
    edges = np.flatnonzero(np.concatenate(([True], np.diff(p[by_doc]) != 0))) if len(by_doc) else np.zeros(0, np.int64)
    guest_top, big = (4 / 3) ** b, np.int64(len(n) + 1)
    j = 0
    while j < len(by_doc):
        k = int(np.searchsorted(cum, (cum[j - 1] if j else 0) + room, "right"))
        e = np.searchsorted(edges, k, "right") - 1
        k = int(edges[e]) if k < len(by_doc) and edges[e] > j else (int(edges[e + 1]) if k < len(by_doc) and e + 1 < len(edges) else len(by_doc))
        own, r = by_doc[j:k], reach[by_doc[j:k]].astype(np.int64)
        to = np.repeat(begin[own] - np.cumsum(r) + r, r) + np.arange(r.sum())
        once = ~lead[to]  # a list's pivots are met as such
        x, y = np.repeat(p[own], r)[once], p[to[once]]
        own = own[long[rank[own]]]
        px, py = np.repeat(p[own], PIVOTS), pivot[rank[own]].ravel()
        once = ~np.repeat(lead[own], PIVOTS) | (px < py)
        x, y = np.concatenate((x, px[once])), np.concatenate((y, py[once]))
        code, common = np.unique(np.minimum(x, y).astype(np.int64) * big + np.maximum(x, y), return_counts=True)
        x, y = at[code // big], at[code % big]
        x, y = np.minimum(x, y), np.maximum(x, y)
        ok = (n[y] >= guest_top) & (3 * n[y] <= 4 * n[x]) & (common * c >= least(n[x], n[y], rest[x], rest[y])) & (x != y)
        yield x[ok], y[ok], common[ok]
        j = k
    if most is not None:
        yield cut, None, None


def first_pairs(x: np.ndarray, y: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Marks the pairs that are among the FIRST_PAIRS with most in common of either of the two."""
    keep = np.zeros(len(x), bool)
    for mine, other in ((x, y), (y, x)):
        o = np.lexsort((other, -common, mine))
        rank = np.arange(len(o)) - np.searchsorted(mine[o], mine[o])
        keep[o[rank < FIRST_PAIRS]] = True
    return keep


def expanded(begin: np.ndarray, of: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of groups (x, y) -> pairs of members (i, j): all with all up to most of them, else as many as the larger one has, a
    member of one with the member of the other that stands at its place, round and round (of the same group: its first one).
    A group g has the members begin[g], begin[g] + 1, ..., of[g] in number."""
    a, b = of[x], of[y]
    whole = a * b <= most
    n = np.where(whole, a * b, np.maximum(a, b))
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide, left, right = np.repeat(b, n), np.repeat(a, n), np.repeat(whole, n)
    one = np.where(right, k // wide, np.where(np.repeat(x == y, n), 0, k % left))
    return np.repeat(begin[x], n) + one, np.repeat(begin[y], n) + k % wide


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, for sorted distinct keys."""
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 75 * (len(both) - common)
