"""MD5 of many short messages at once: the draws of a bootstrap are named by billions of them."""

from __future__ import annotations

import numpy as np

_K = [int(abs(np.sin(i + 1.0)) * 2**32) for i in range(64)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def endings(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each text with MD5's end mark, their lengths) for md5_words()."""
    raw = [t.encode() for t in texts]
    out = np.zeros((len(raw), max(map(len, raw)) + 1), np.uint8)
    for row, r in zip(out, raw, strict=True):
        row[: len(r)], row[len(r)] = np.frombuffer(r, np.uint8), 0x80
    return out, np.array([len(r) for r in raw], np.uint32)


def md5_words(heads: list[str], tails: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The four 32-bit words, as hexadecimal digits read, of the MD5 of each head with each tail (endings()), in that order. Together
    they are at most 55 bytes long."""
    tail, length = tails
    block = np.zeros((len(heads), len(tail), 64), np.uint8)
    for m, head in zip(block, heads, strict=True):
        h = head.encode()
        if len(h) + tail.shape[1] > 56:
            raise ValueError(f"{head}: too long")
        m[:, : len(h)], m[:, len(h) : len(h) + tail.shape[1]] = np.frombuffer(h, np.uint8), tail
        m[:, 56:60] = ((len(h) + length) * 8).astype("<u4").view(np.uint8).reshape(-1, 4)
    words = block.reshape(-1, 64).view("<u4")
    w = [x if (x := np.ascontiguousarray(words[:, i])).any() else None for i in range(16)]
    n = len(words)
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, spare = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:  # (b & c) | (~b & d)
            g = i
            np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:  # (d & b) | (~d & c)
            g = (5 * i + 1) % 16
            np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
        else:  # c ^ (b | ~d)
            g = 7 * i % 16
            np.bitwise_or(np.invert(d, out=f), b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        f += np.uint32(_K[i])
        if w[g] is not None:
            f += w[g]
        np.left_shift(f, np.uint32(_TURN[i]), out=spare)
        f >>= np.uint32(32 - _TURN[i])
        f |= spare
        f += b
        a, d, c, b, f = d, c, b, f, a
    return [(x + np.uint32(v)).byteswap() for x, v in zip((a, b, c, d), _START, strict=True)]
