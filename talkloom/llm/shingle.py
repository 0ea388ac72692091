"""Vectorised word and shingle hashing over many texts at once.

Words are the runs of non-white-space bytes of the lower-cased (A-Z only) text. A word's 64-bit hash is a polynomial over
random byte values, so that one cumulative sum gives all words of a block; a shingle's hash chains its words' hashes.
Memory: blocks of BLOCK bytes, whatever the size of a text.
"""

from __future__ import annotations

import hashlib

import numpy as np

BLOCK = 1 << 20
LONG = 1 << 16
K = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256)
_LOW[65:91] += 32
_BYTE = mix((_LOW.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_CHAIN = np.uint64(0x9FB21C651E98DF25)


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + LONG + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW, _INV = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _edges(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate(([1], _WS[b].view(np.int8), [1])).astype(np.int8))
    return b, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def running(b: np.ndarray) -> np.ndarray | None:
    """Running sums from which span_hashes() takes any span of b at once; None where b is longer than the table of powers."""
    if len(b) > BLOCK + LONG:
        return None
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * _POW[: len(b)], dtype=np.uint64)))


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the spans [start, end) of bytes b, which stand in order of their starts; equal bytes (but for A-Z), equal hash.
    sums: running(b), where more than one set of spans is wanted."""
    if sums is not None and (not len(start) or (end - start).max() <= LONG):
        return mix((sums[end] - sums[start]) * _INV[start] + (end - start).astype(np.uint64))
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        lo = start[i]
        if end[i] - lo > LONG:  # a word longer than any block
            out[i] = int.from_bytes(hashlib.blake2b(b[lo : end[i]].tobytes().lower(), digest_size=8).digest(), "little")
            i += 1
            continue
        j = max(int(np.searchsorted(start, lo + BLOCK, "left")), i + 1)
        s, e = start[i:j] - lo, end[i:j] - lo
        if (e - s).max() > LONG:
            j = i + int(np.argmax((e - s) > LONG))
            s, e = s[: j - i], e[: j - i]
        v = _BYTE[b[lo : lo + e.max()]]
        v *= _POW[: len(v)]
        c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)))
        out[i:j] = mix((c[e] - c[s]) * _INV[s] + (e - s).astype(np.uint64))
        i = j
    return out


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end offsets and hashes of the words of raw, in order."""
    b, start, end = _edges(raw)
    return start, end, span_hashes(b, start, end, running(b))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of raw, in order."""
    start, _, h = word_spans(raw)
    return start, h


def slabs(texts: list, size: int = BLOCK):
    """Consecutive index ranges of texts that hold about size bytes each."""
    i, n, room = 0, len(texts), 0
    for j, t in enumerate(texts):
        room += len(t or b"")
        if room >= size:
            yield i, j + 1
            i, room = j + 1, 0
    if i < n:
        yield i, n


def words_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts (bytes or None), and the bounds of each text's own in them."""
    raw = b"\n".join(t or b"" for t in texts)
    at = np.concatenate(([0], np.cumsum([len(t or b"") + 1 for t in texts])))
    start, h = word_hashes(raw)
    return h, np.searchsorted(start, at)


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on."""
    acc = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        acc = acc * _CHAIN + h[j : j + len(acc)]
    return mix(acc + np.uint64(k))


def flat(texts: list, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of all texts, repeats included, and the bounds of each text's own in them; a text with fewer words
    has one for the whole sequence."""
    h, cut = words_of(texts)
    g, begin, n = ngrams(h, k), cut[:-1], np.diff(cut)
    m = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    end = np.cumsum(m)
    at = np.repeat(begin - end + m, m) + np.arange(m.sum())
    out = g[np.minimum(at, len(g) - 1)] if len(g) else np.zeros(len(at), np.uint64)
    for d in np.flatnonzero((n > 0) & (n < k)):
        out[end[d] - 1] = ngrams(h[begin[d] : begin[d] + n[d]], int(n[d]))[0]
    return out, np.concatenate(([0], end))


def distinct(x: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's own values (bounds: cut) in order, each once, and their bounds. x is sorted in place."""
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        x[a:b].sort()
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    new[cut[:-1][cut[:-1] < len(x)]] = True
    return x[new], np.concatenate(([0], np.cumsum(new)))[cut]
