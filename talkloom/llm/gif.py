"""Media columns: animated GIF. Texts become 8-bit samples in frames of 256 colours; any GIF decodes to timed frames.

The writer is a plain dictionary LZW: codes grow from 9 to 12 bits, and the dictionary is cleared when it is full. The reader takes
any stream. Bits are packed and unpacked by array arithmetic; only the dictionary itself is walked code by code. Frames are ROW
pixels wide and MOST_ROWS high at most. Canvases are composed by the disposal and transparency rules.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW, MOST_ROWS, DELAY_CS = 192, 64, 10
#: Pixels of a screen or a frame beyond which a file isn't decoded: its header alone could ask for 4 billion.
MOST_PIXELS = 1 << 26
_FULL = 4096
#: Three bits of red and green, two of blue: each sample has a colour of its own.
_COLOURS = np.stack([np.arange(256) >> 5, np.arange(256) >> 2 & 7, np.arange(256) & 3], axis=1) * [36, 36, 85]
_PALETTE = _COLOURS.astype(np.uint8).tobytes()


@functools.lru_cache(16)
def _widths(size: int, n: int = _FULL) -> np.ndarray:
    """Bits of the first n codes after a clear code: the dictionary has clear, stop and one entry for each code but the first."""
    entries = (1 << size) + 1 + np.arange(n)
    entries[0] += 1
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, size + 1, 12)


def lzw_encode(pixels: bytes, size: int = 8) -> bytes:
    """LZW stream of pixels below 2**size."""
    clear = 1 << size
    runs, own, table, nxt = [], [], {}, clear + 2
    put, look, prefix = own.append, table.get, pixels[0]
    for p in pixels[1:]:
        code = look(longer := prefix << 8 | p)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        prefix = p
        if nxt < _FULL:
            table[longer] = nxt
            nxt += 1
        else:
            put(clear)
            runs.append(own)
            own, table, nxt = [], {}, clear + 2
            put, look = own.append, table.get
    own += (prefix, clear + 1)
    runs.append(own)
    codes = np.concatenate([np.array([clear]), *map(np.array, runs)])
    width = np.concatenate([[size + 1]] + [_widths(size)[: len(r)] for r in runs])
    at = np.cumsum(width) - width
    x, byte = codes << (at & 7), at >> 3
    total = int(at[-1] + width[-1] + 7) // 8
    return sum(np.bincount(byte + k, (x >> 8 * k) & 255, minlength=total + 2) for k in range(3)).astype(np.uint8).tobytes()[:total]


def _sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def write_gif(payload: bytes) -> bytes:
    """payload (a positive multiple of ROW bytes) as the frames of an animation, top row first."""
    rows = len(payload) // ROW
    out = [b"GIF89a", struct.pack("<HHBBB", ROW, min(rows, MOST_ROWS), 0xF7, 0, 0), _PALETTE]
    for top in range(0, rows, MOST_ROWS):
        h = min(MOST_ROWS, rows - top)
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, DELAY_CS, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, ROW, h, 0), b"\x08", _sub_blocks(lzw_encode(payload[top * ROW : (top + h) * ROW]))]
    return b"".join([*out, b"\x3b"])


def _codes(data: np.ndarray, bit: int, width: np.ndarray) -> np.ndarray:
    """Codes of these widths from a bit on, as far as data (with two bytes to spare at its end) has whole ones."""
    end = bit + np.cumsum(width)
    end = end[end <= 8 * (len(data) - 2)]
    at = end - width[: len(end)]
    x = data[at >> 3] | data[(at >> 3) + 1] << 8 | data[(at >> 3) + 2] << 16
    return (x >> (at & 7)) & ((1 << width[: len(end)]) - 1)


def lzw(stream: bytes, size: int, n: int) -> np.ndarray | None:
    """The n pixels of an LZW stream of that minimum code size; None if it has fewer, or a code that can't be.

    The entry that a code adds is what the code before it gave and one pixel more; it is read from the pixels themselves, so that
    the dictionary is no more than the places where codes begin."""
    clear, data = 1 << size, np.frombuffer(stream + b"\0\0", np.uint8).astype(np.int64)
    width, bit, ended = _widths(size), 0, False
    out, begins = bytearray(), []
    while len(out) < n and not ended:
        codes = _codes(data, bit, width)
        special = np.flatnonzero((codes == clear) | (codes == clear + 1))
        many = int(special[0]) if len(special) else len(codes)
        if not _expand(codes[:many].tolist(), clear, begins, out):
            return None
        if len(special):
            bit += int(width[: many + 1].sum())
            ended = codes[many] == clear + 1
            begins, width = [], _widths(size)
        else:
            bit += int(width[:many].sum())
            ended = many < len(width)
            width = np.full(_FULL, 12)
    return np.frombuffer(bytes(out[:n]), np.uint8) if len(out) >= n else None


def _expand(codes: list[int], clear: int, begins: list[int], out: bytearray) -> bool:
    """Adds the pixels of codes to out and their begins to begins; False at a code that has no entry yet."""
    first, at, begin, pixel = clear + 2, len(out), begins.append, out.append
    for code in codes:
        begin(at)
        if code < clear:
            pixel(code)
            at += 1
            continue
        i = code - first
        if i + 1 >= len(begins):
            return False
        lo, hi = begins[i], begins[i + 1] + 1
        if hi <= at:
            out += out[lo:hi]
        else:  # the entry that this very code completes
            out += out[lo:at]
            pixel(out[lo])
        at += hi - lo
    return True


class _Cut(Exception):
    """The file ends, or goes wrong, here."""


class _Bytes:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise _Cut
        self.at += n
        return self.raw[self.at - n : self.at]

    def blocks(self) -> bytes:
        got = []
        while n := self.take(1)[0]:
            got.append(self.take(n))
        return b"".join(got)

    def palette(self, packed: int) -> np.ndarray | None:
        return np.frombuffer(self.take(3 * (2 << (packed & 7))), np.uint8).reshape(-1, 3) if packed & 0x80 else None


def read_gif(raw: bytes):
    """Frames in order: dicts of frame, start_ms, delay_ms, disposal, left, top, width, height and canvas (RGBA array of the
    whole screen with the frame drawn; it changes with the next frame). Bytes that are no GIF have none; a file that is cut, or
    goes wrong, ends with its last whole frame; one of a screen or frame over MOST_PIXELS ends there."""
    try:
        yield from _read(_Bytes(raw))
    except _Cut:
        return


def _read(b: _Bytes):
    if b.take(6) not in (b"GIF87a", b"GIF89a"):
        raise _Cut
    width, height, packed, _, _ = struct.unpack("<HHBBB", b.take(7))
    palette = b.palette(packed)
    if width * height > MOST_PIXELS:
        raise _Cut
    canvas = np.zeros((height, width, 4), np.uint8)
    clock = number = disposal = delay = 0
    transparent = None
    while (kind := b.take(1)[0]) != 0x3B:
        if kind == 0x21:
            label, data = b.take(1)[0], b.blocks()
            if label == 0xF9 and len(data) >= 4:
                disposal, delay = (data[0] >> 2) & 7, 10 * (data[1] | data[2] << 8)
                transparent = data[3] if data[0] & 1 else None
            continue
        if kind != 0x2C:
            raise _Cut
        left, top, w, h, local = struct.unpack("<HHHHB", b.take(9))
        own = b.palette(local)
        colours = palette if own is None else own
        size, data = b.take(1)[0], b.blocks()
        if colours is None or not 1 <= size <= 11 or w * h > MOST_PIXELS or (index := lzw(data, size, w * h)) is None:
            raise _Cut
        index = index.reshape(h, w)
        if local & 0x40:  # interlaced: rows 0, 8, ..; 4, 12, ..; 2, 6, ..; 1, 3, ..
            rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            index = index[np.argsort(rows)]
        index = index[: max(0, height - top), : max(0, width - left)]
        before = canvas.copy() if disposal == 3 else None
        place = canvas[top : top + index.shape[0], left : left + index.shape[1]]
        opaque = np.full((len(colours), 4), 255, np.uint8)
        opaque[:, :3] = colours
        drawn = opaque[index if len(colours) == 256 else np.minimum(index, len(colours) - 1)]
        if transparent is None:
            place[:] = drawn
        else:
            seen = index != transparent
            place[seen] = drawn[seen]
        yield {"frame": number, "start_ms": clock, "delay_ms": delay, "disposal": disposal, "left": left, "top": top, "width": w, "height": h, "canvas": canvas}
        clock, number = clock + delay, number + 1
        if disposal == 2:
            place[:] = 0
        elif disposal == 3:
            canvas = before
        disposal, delay, transparent = 0, 0, None


_RED, _GREEN, _BLUE = (np.arange(256) // 36 << 5).astype(np.uint8), (np.arange(256) // 36 << 2).astype(np.uint8), (np.arange(256) // 85).astype(np.uint8)


def samples(canvas: np.ndarray) -> bytes:
    """The samples that the writer's colours stand for."""
    return (_RED[canvas[..., 0]] | _GREEN[canvas[..., 1]] | _BLUE[canvas[..., 2]]).tobytes()


def colour_bins(canvas: np.ndarray) -> np.ndarray:
    """Histogram of 64 colours, two bits a channel, over the pixels that are drawn."""
    top = canvas >> 6
    colour = (top[..., 0] << 4 | top[..., 1] << 2 | top[..., 2])[canvas[..., 3] > 0]
    return np.bincount(colour, minlength=64)


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(ROW, -(-len(text) // ROW) * ROW), b" ")


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _store(batches):
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary()).to_pylist()
        for i in range(0, len(texts), 256):
            own = [t or b"" for t in texts[i : i + 256]]
            yield pa.RecordBatch.from_arrays([ids.slice(i, len(own)).cast(pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array([write_gif(payload_of(t)) for t in own], pa.binary())], schema=_MEDIA)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as an animation. Null texts are empty: one row of spaces. A null id stays null;
    repeated rows each have a row; equal texts have equal media. An empty table gives none; other columns aren't read."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _frames(batches):
    kinds = [("doc_id", pa.int64()), *((c, pa.int32()) for c in ("frame", "start_ms", "delay_ms", "disposal", "left", "top", "width", "height")), ("canvas", pa.binary()), ("colours", pa.list_(pa.int64()))]
    for batch in batches:
        for d, raw in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            for f in read_gif(raw or b""):
                row = {"doc_id": d} | f | {"canvas": f["canvas"].tobytes(), "colours": colour_bins(f["canvas"]).tolist()}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema(kinds))


def frames(media: DataFrame) -> DataFrame:
    """One row per frame of each media value: its times, place and disposal, the composed canvas and its colour histogram."""
    return media.select("doc_id", "media").mapInArrow(_frames, "doc_id long, frame int, start_ms int, delay_ms int, disposal int, left int, top int, width int, height int, canvas binary, colours array<long>")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _digest(batches):
    for batch in batches:
        rows = []
        for d, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
            sha, size, tail, bins, raw = hashlib.sha256(), 0, b"", np.zeros(64, np.int64), raw or b""
            for f in read_gif(raw):
                drawn = f["canvas"][f["top"] : f["top"] + f["height"], f["left"] : f["left"] + f["width"]]
                own = samples(drawn)
                sha.update(own)
                size += len(own)
                tail = (tail + own)[-16:]
                bins += colour_bins(drawn)
            rows.append((d, n, size, sha.hexdigest(), zlib.crc32(tail), len(raw), hashlib.sha256(raw).hexdigest(), ",".join(map(str, bins))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DIGEST.types, strict=True)], schema=_DIGEST)


def digests(media: DataFrame) -> DataFrame:
    """What stored texts hold, read back from their frames; feature is the colour histogram (64 colours) of all of them. Media that
    are null, or no GIF of the writer's, have what their frames give; without any, no samples."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
