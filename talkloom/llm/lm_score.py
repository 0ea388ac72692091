"""LM scoring by cross-entropy difference: matched target and background bigram models over one vocabulary.

p(w | h) = (c(h, w) + BETA / V) / (c(h) + BETA), V being the distinct words of the corpus, for the target's counts and for
everybody's. A document's score is the mean over its words (and end) of the target's loss minus the background's; its own
words are taken out of both models' counts first. Negative: more like the target.

Documents are counted in chunks; a chunk's bigrams and histories are dealt to parts by hash. Parts sum the counts of all
chunks first. A second pass deals out the entries with their documents; each part scores them with its counts, and sums go back
by chunk.
Parts grow in number with the input. A part of more than PART_BYTES (words that most documents have) is split by chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import discard, scan_partitions, written
from talkloom.llm.mixing import checked
from talkloom.llm.shingle import mix, slabs, words_of

BETA, CHUNK_WORDS, CHUNK_DOCS, PART_BYTES = 200.0, 600_000, 4096, 32_000_000
_HIST = np.uint64(1 << 63)
_START, _END = np.uint64(0x5354415254), np.uint64(0x454E44)
_BLOCK_SQL = "part int, chunk long, room long, keys binary, ct binary, cb binary, runs binary, docs binary, tf binary, flags binary"
_BLOCK = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("room", pa.int64()), *((c, pa.binary()) for c in ("keys", "ct", "cb", "runs", "docs", "tf", "flags"))])


def _pack(a: np.ndarray) -> bytes:
    """Compressed by planes of bytes: small numbers cost about a byte. Sorted keys are packed as their differences."""
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def _unpack(x: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(size, -1).T).view(kind).ravel()


def entries(h: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, document) of every bigram and history of the words h, cut into documents; documents without words have none."""
    seq, doc = [], []
    for d, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if b > a:
            seq.append(np.concatenate(([_START], h[a:b], [_END])))
            doc.append(np.full(b - a + 2, d))
    if not seq:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s, d = np.concatenate(seq), np.concatenate(doc)
    ok = d[1:] == d[:-1]
    prev, nxt, d = s[:-1][ok], s[1:][ok], d[:-1][ok]
    hist = mix(prev + np.uint64(1)) | _HIST
    return np.concatenate((mix(prev * np.uint64(0x9FB21C651E98DF25) + nxt) & ~_HIST, hist)), np.concatenate((d, d))


def _blocks(parts: int, whole: bool):
    """Rows of chunks by part: keys and counts; with whole, keys and entries instead, and the documents themselves as part -1."""

    def deal(chunk, ids, flags, sizes, key, doc):
        target = np.array(flags, bool)
        if whole:
            null = np.array([i is None for i in ids], np.uint8)
            yield (-1, chunk, 0, np.array([-1 if i is None else i for i in ids], np.int64).tobytes(), None, None, None, null.tobytes(), np.array(sizes, np.int64).tobytes(), None)
        if not len(key):
            return
        o = np.lexsort((doc, key))
        key, doc = key[o], doc[o]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))))
        tf = np.diff(np.concatenate((first, [len(key)])))
        key, doc = key[first], doc[first]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        runs = np.diff(np.concatenate((at, [len(key)])))
        cb, ct, own = np.add.reduceat(tf, at), np.add.reduceat(tf * target[doc], at), key[at]
        part = (((own & ~_HIST) >> np.uint64(31)) * np.uint64(parts)) >> np.uint64(32)
        edge = np.concatenate((at, [len(key)]))
        flag = np.packbits(target).tobytes()
        for kind in (False, True):
            of = np.flatnonzero((own >= _HIST) == kind)
            cut = np.flatnonzero(part[of][1:] != part[of][:-1]) + 1
            for lo, hi in zip([0, *cut], [*cut, len(of)], strict=True) if len(of) else ():  # the parts that this chunk has
                p, a, b = int(part[of[lo]]), of[lo], of[hi - 1] + 1
                e = slice(edge[a], edge[b])
                if whole:
                    yield (p, chunk, 0, _pack(np.diff(own[a:b], prepend=np.uint64(0))), None, None, _pack(runs[a:b].astype(np.uint32)), _pack(doc[e].astype(np.uint16)), _pack(tf[e].astype(np.uint32)), flag)
                else:
                    yield (p, chunk, 6 * int(edge[b] - edge[a]), _pack(np.diff(own[a:b], prepend=np.uint64(0))), _pack(ct[a:b].astype(np.uint32)), _pack(cb[a:b].astype(np.uint32)), None, None, None, None)

    def run(batches):
        np.seterr(over="ignore")
        chunk = TaskContext.get().partitionId() << 32
        ids, flags, sizes, keys, docs = [], [], [], [], []

        def done():
            nonlocal chunk
            rows = list(deal(chunk, ids, flags, sizes, np.concatenate(keys), np.concatenate(docs))) or [(0, chunk, 0, *[None] * 7)]
            chunk += 1
            for x in (ids, flags, sizes, keys, docs):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOCK.types, strict=True)], schema=_BLOCK)

        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            own, flag = batch.column("doc_id").to_pylist(), batch.column("is_target").to_pylist()
            for i, j in slabs(texts):
                for a in range(i, j, CHUNK_DOCS):
                    b = min(j, a + CHUNK_DOCS)
                    if len(ids) + b - a > CHUNK_DOCS:
                        yield done()
                    h, cut = words_of(texts[a:b])
                    k, d = entries(h, cut)
                    keys.append(k), docs.append(d + len(ids))
                    ids.extend(own[a:b]), flags.extend(flag[a:b]), sizes.extend(np.diff(cut).tolist())
                    if sum(map(len, keys)) > 2 * CHUNK_WORDS:
                        yield done()
        if ids:
            yield done()

    return run


def _counts(table: pa.Table) -> pa.Table:
    rows = [r for r in table.select(["keys", "ct", "cb"]).to_pylist() if r["keys"] is not None]
    key, ct, cb = (np.concatenate([np.zeros(0, k), *(np.cumsum(_unpack(r[c], k), dtype=k) if c == "keys" else _unpack(r[c], k) for r in rows)]) for c, k in (("keys", np.uint64), ("ct", np.uint32), ("cb", np.uint32)))
    o = np.argsort(key, kind="stable")
    key, ct, cb = key[o], ct[o].astype(np.int64), cb[o].astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    ct, cb = (np.add.reduceat(x, at) if len(at) else x for x in (ct, cb))
    room = sum(table.column("room").to_pylist())
    return pa.table({"part": table.column("part").slice(0, 1), "mkeys": pa.array([_pack(np.diff(key[at], prepend=np.uint64(0)))], pa.binary()), "mt": pa.array([_pack(ct)], pa.binary()), "mb": pa.array([_pack(cb)], pa.binary()), "hist": pa.array([int((key[at] >= _HIST).sum())], pa.int64()), "splits": pa.array([max(1, -(-room // PART_BYTES))], pa.int64())})


def gain(tf, target, ct, cb, hist, v: float):
    """Log ratio of target and background for tf occurrences whose own counts are taken out."""
    t, b, a = ct - tf * target, cb - tf, np.where(hist, BETA, BETA / v)
    return tf * np.where(hist, -1.0, 1.0) * (np.log(t + a) - np.log(b + a))


_SUMS_SQL = "chunk long, docs binary, sums binary, ids binary, nulls binary, sizes binary"


def _scores(v: float):
    def run(model: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        if model.num_rows and blocks.num_rows:
            m = model.to_pylist()[0]
            keys, mt, mb = np.cumsum(_unpack(m["mkeys"], np.uint64), dtype=np.uint64), _unpack(m["mt"], np.int64), _unpack(m["mb"], np.int64)
        for i in range(blocks.num_rows):
            r = blocks.slice(i, 1).to_pylist()[0]
            if r["part"] < 0:
                out.append((r["chunk"], None, None, r["keys"], r["docs"], r["tf"]))
            elif r["keys"] is not None:
                own, runs, doc, tf = (_unpack(r[c], k) for c, k in (("keys", np.uint64), ("runs", np.uint32), ("docs", np.uint16), ("tf", np.uint32)))
                own = np.cumsum(own, dtype=np.uint64)
                at = np.repeat(np.searchsorted(keys, own), runs)
                target = np.unpackbits(np.frombuffer(r["flags"], np.uint8))[doc]
                g = np.bincount(doc, gain(tf.astype(np.int64), target.astype(np.int64), mt[at], mb[at], np.repeat(own >= _HIST, runs), v))
                d = np.unique(doc)
                out.append((r["chunk"], d.tobytes(), g[d].tobytes(), None, None, None))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64(), *[pa.binary()] * 5], strict=True)], names=["chunk", "docs", "sums", "ids", "nulls", "sizes"])

    return run


def _gather(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    own = next(r for r in rows if r["ids"] is not None)
    ids, null, n = np.frombuffer(own["ids"], np.int64), np.frombuffer(own["nulls"], np.uint8), np.frombuffer(own["sizes"], np.int64)
    total = np.zeros(len(ids))
    for docs, sums in sorted((r["docs"], r["sums"]) for r in rows if r["ids"] is None):
        total[np.frombuffer(docs, np.uint16)] += np.frombuffer(sums)
    return pa.table({"doc_id": pa.array(ids, mask=null.astype(bool)), "n_words": pa.array(n), "score": pa.array(-total / (n + 1), mask=n == 0)})


def cross_entropy_difference(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "is_target") -> DataFrame:
    """(doc_id, n_words, score) for every row. Null and wordless texts have a null score. Null flags are false; without any
    target the score compares with an empty model. Ids may be null or repeat. An empty table gives none. Other columns aren't
    read."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{target_col}`"), F.lit(False)).alias("is_target"))
    parts = max(8, 2 * scan_partitions(docs))
    counted = d.mapInArrow(_blocks(parts, False), _BLOCK_SQL).select("part", "room", "keys", "ct", "cb")
    model = written(counted.groupBy("part").applyInArrow(_counts, "part int, mkeys binary, mt binary, mb binary, hist long, splits long"), "model")
    v = float(max(1, model.agg(F.sum("hist")).first()[0] or 1))
    left = model.select("part", F.explode(F.sequence(F.lit(0), (F.col("splits") - 1).cast("int"))).alias("sub"), "mkeys", "mt", "mb")
    splits = checked(model.select("part", "splits"))
    right = d.mapInArrow(_blocks(parts, True), _BLOCK_SQL).join(splits, "part", "left")
    sub = F.pmod(F.xxhash64("chunk"), F.when(F.col("part") < 0, F.lit(parts)).otherwise(F.coalesce("splits", F.lit(1)))).cast("int")
    right = right.select("part", sub.alias("sub"), "chunk", "keys", "runs", "docs", "tf", "flags")
    sums = left.groupBy("part", "sub").cogroup(right.groupBy("part", "sub")).applyInArrow(_scores(v), _SUMS_SQL)
    out = written(sums.groupBy("chunk").applyInArrow(_gather, "doc_id long, n_words long, score double"), "scores")
    discard(model)
    return out
