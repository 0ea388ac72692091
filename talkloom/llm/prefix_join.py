"""N-gram Jaccard join: grouped prefix join with connected components of the links.

1. One pass takes each document's set of shingles: its size, a print of 128 bits that stands for it, and counts of shingles in a
   sketch of fixed size (frequent ones go last in the order of shingles). Equal sets are one, whatever their number.
2. One pass emits each set's prefix, split into parts by size bucket and class (see prefix_kernel).
3. In a part, sets with identical prefixes and size are one group. Group pairs are filtered by the shingles that their prefixes
   have in common: for each group its best few, and from long lists of a frequent shingle the neighbours alone.
4. Group pairs, and groups themselves, are expanded to members, all with all where these are few, else each with its opposite
   one; whole sets are verified; links give components. Members of groups with more pairs than the best, of large groups and
   of cut lists are noted.
5. The noted sets are joined again, now with all their shingles as prefix but for frequent ones that the bound can do without (few near
   misses stay), all pairs of different components this time and no others, and verified.

Nothing is dropped: a pair that is never verified lies within one component already. Pairs within a large group of near
copies are never all formed.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm import prefix_kernel as pk
from talkloom.llm.common import discard, scan_partitions, written
from talkloom.llm.components import components
from talkloom.llm.shingle import K, distinct, flat, mix, slabs

#: Ids are broadcast up to this number (8 MB); beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Groups of copies that are broadcast at most.
HEAVY_GROUPS = 500_000
_SLICES = 64
_PART = pa.schema([("part", pa.int64()), ("ids", pa.binary()), ("prints", pa.binary()), ("groups", pa.binary()), ("sizes", pa.binary()), ("rests", pa.binary()), ("lengths", pa.binary()), ("tokens", pa.binary())])
_PART_SQL = "part long, ids binary, prints binary, groups binary, sizes binary, rests binary, lengths binary, tokens binary"


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column("text").cast(pa.binary()).to_pylist()


_FEATURES_SQL = "doc_id long, n_shingles long, f1 long, f2 long, slice int, counts binary"
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])


def _featured(k: int):
    """A row for each document (slice null), and at a task's end rows of its sketch and of its documents per size bucket."""

    def run(batches):
        np.seterr(over="ignore")
        sketch, sizes = np.zeros(1 << pk.SKETCH_BITS, np.int64), np.zeros(256, np.int64)
        for batch in batches:
            texts = _texts(batch)
            n, f1, f2 = (np.zeros(len(texts), t) for t in (np.int64, np.uint64, np.uint64))
            for i, j in slabs(texts):
                own, cut = distinct(*flat(texts[i:j], k))
                n[i:j], (f1[i:j], f2[i:j]) = np.diff(cut), pk.prints(own, cut)
                sizes += np.bincount(pk.bucket(n[i:j][n[i:j] > 0]), minlength=256)
                sketch += np.bincount((own >> np.uint64(64 - pk.SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            nulls = [pa.nulls(len(texts), t) for t in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), *nulls], schema=_FEATURES)
        if sizes.any():
            rows = [zlib.compress(x.tobytes(), 1) for x in np.split(sketch, _SLICES)] + [zlib.compress(sizes.tobytes())]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(rows), pa.int64())] * 4, pa.array(range(_SLICES + 1), pa.int32()), pa.array(rows, pa.binary())], schema=_FEATURES)

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes())], pa.binary())})


def frequencies(features: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sketch (2**SKETCH_BITS counters, whatever the input) and the documents per size bucket."""
    rows = features.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(_add, "slice int, counts binary").collect()
    got = {r["slice"]: np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64) for r in rows}
    if not got:
        return np.zeros(1 << pk.SKETCH_BITS, np.int64), np.zeros(256, np.int64)
    return np.concatenate([got[i] for i in range(_SLICES)]), got[_SLICES]


def _packed(held: list[tuple]) -> pa.RecordBatch:
    """Rows of _PART: the documents (ids, f1, f2, groups, sizes, rests) of each part with their tokens. held: documents' columns and
    their parts, documents and tokens, by slabs."""
    docs = [np.concatenate(x) for x in zip(*(h[:6] for h in held), strict=True)]
    first = np.cumsum([0, *(len(h[0]) for h in held)])
    part, doc, token = (np.concatenate([h[i] + first[j] if i == 7 else h[i] for j, h in enumerate(held)]) for i in (6, 7, 8))
    o = np.argsort(part, kind="stable")
    part, doc, token = part[o], doc[o], token[o]
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    own, of = doc[at], np.diff(np.append(at, len(part))).astype(np.int32)
    new = np.ones(len(at), bool)
    new[1:] = part[at][1:] != part[at][:-1]
    row = np.flatnonzero(new)
    rows, tokens = np.append(row, len(at)), np.append(at[row], len(part))
    binary = lambda x, bounds: pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((bounds * x.dtype.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
    ids, f1, f2, groups, sizes, rests = (x[own] for x in docs)
    prints = np.stack((f1, f2), 1).ravel()
    return pa.RecordBatch.from_arrays([pa.array(part[at[row]]), binary(ids, rows), binary(prints, 2 * rows), binary(groups, rows), binary(sizes, rows), binary(rests, rows), binary(of, rows), binary(token, tokens)], schema=_PART)


def _emitted(k: int, level, split: dict[int, tuple[int, int]], keep: float = pk.KEEP, most: int = 1_000_000):
    """keep 0: all shingles that aren't frequent are in the prefix too."""

    def run(batches):
        np.seterr(over="ignore")
        held, seen, room = [], set(), 0
        for batch in batches:
            texts, ids, group = _texts(batch), batch.column("doc_id"), batch.column("component")
            known, ids, group = (x.to_numpy(zero_copy_only=False) for x in (ids.is_valid(), ids.fill_null(0), group.fill_null(0)))
            for i, j in slabs(texts):
                g, cut = flat(texts[i:j], k)
                key, cut = distinct(pk.ordered(g, level.value), cut)
                n, (f1, f2) = np.diff(cut), pk.prints(key, cut)
                new = (n > 0) & known[i:j]
                for d, own in zip(np.flatnonzero(new).tolist(), zip(f1[new].tolist(), f2[new].tolist(), strict=True), strict=True):
                    if own in seen:
                        new[d] = False
                    seen.add(own)
                if not new.any():
                    continue
                prefix = pk.prefix_length(n)
                if not keep:
                    usual = np.concatenate(([0], np.cumsum(key < np.uint64(1 << 58))))[cut]
                    prefix = np.maximum(prefix, np.diff(usual))
                begin, n, prefix, f1, f2 = (x[new] for x in (cut[:-1], n, prefix, f1, f2))
                token = key[np.repeat(begin - np.cumsum(prefix) + prefix, prefix) + np.arange(prefix.sum())]
                parts = pk.parts_of(n, prefix, token, f1 & np.uint64(0xFFFFFFFF), split, keep)
                held.append((ids[i:j][new], f1, f2, group[i:j][new], n.astype(np.int32), (n - prefix).astype(np.int32), *parts))
                room += len(parts[0])
                if room > most:
                    yield _packed(held)
                    held, room = [], 0
        if held:
            yield _packed(held)

    return run


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """All bytes of a binary column, in order, as numbers."""
    out = [np.zeros(0, kind)]
    for c in column.chunks:
        if len(c):
            at = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset : c.offset + len(c) + 1]
            out.append(np.frombuffer(c.buffers()[2], np.uint8, int(at[-1] - at[0]), int(at[0])).view(kind))
    return np.concatenate(out) if len(out) != 2 else out[1]


def _part_pairs(first: bool, split: dict[int, tuple[int, int]]):
    """Steps 3 and 5 for one part. first: pairs (a, b) of each group's best few, and (a, null) for the sets that are noted;
    else all pairs of different components, by whole sets."""

    def run(table: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        part = table.column("part")[0].as_py()
        ids, prints, group, n, beyond, length, token = (_joined(table.column(c), k) for c, k in (("ids", np.int64), ("prints", np.uint64), ("groups", np.int64), ("sizes", np.int32), ("rests", np.int32), ("lengths", np.int32), ("tokens", np.uint64)))
        f1, f2 = prints[0::2], prints[1::2]
        order = np.lexsort((ids, f2, f1, n))
        same = (f1[order][1:] == f1[order][:-1]) & (f2[order][1:] == f2[order][:-1]) & (n[order][1:] == n[order][:-1])
        keep = order[np.concatenate(([True], ~same))]  # one of equal sets, by size
        start = np.cumsum(length) - length
        token = np.concatenate([token[a : a + k] for a, k in zip(start[keep], length[keep], strict=True)])
        ids, n, beyond, length, group = ids[keep], n[keep].astype(np.int64), beyond[keep].astype(np.int64), length[keep], group[keep]
        q = (part >> 32) // pk.MAX_CLASSES
        share = pk.KEEP if first else 0.0
        c = pk.classes(q, split.get(q, (1, 1))[0], share)
        got, noted = [], np.zeros(len(ids), bool)
        if first:  # groups: identical prefixes and size
            at = np.cumsum(length) - length
            mark = np.add.reduceat(mix(token + np.uint64(1)), at)
            o = np.lexsort((mark, length, n))
            new = np.concatenate(([True], (np.diff(n[o]) != 0) | (np.diff(length[o]) != 0) | (mark[o][1:] != mark[o][:-1])))
            begin = np.flatnonzero(new)
            of, heads = np.diff(np.append(begin, len(o))), o[begin]  # members of each group, in o from begin on
            again = of > pk.MEMBERS  # groups whose members aren't all verified
            i, j = pk.expanded(begin, of, *[np.flatnonzero(of > 1)] * 2, pk.MEMBERS**2)
            got.append((ids[o[i[i < j]]], ids[o[j[i < j]]]))
            token, length = np.concatenate([token[at[h] : at[h] + length[h]] for h in heads]), length[heads]
            for x, y, common in pk.candidates(token, np.repeat(np.arange(len(heads)), length), n[heads], q, c, keep=share, most=pk.LONG_LIST):
                if y is None:
                    again[x] = True
                    continue
                best = pk.first_pairs(x, y, common)
                more = ~best | (of[x] * of[y] > pk.MEMBER_PAIRS)
                again[x[more]] = again[y[more]] = True
                i, j = pk.expanded(begin, of, x[best], y[best], pk.MEMBER_PAIRS)
                got.append((ids[o[i]], ids[o[j]]))
            noted[o] = np.repeat(again, of)
        else:
            for x, y, _ in pk.candidates(token, np.repeat(np.arange(len(ids)), length), n, q, c, group, share, rest=beyond):
                got.append((ids[x], ids[y]))
        x, y = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in (0, 1))
        rest = ids[noted]
        return pa.table({"a": pa.array(np.concatenate((np.minimum(x, y), rest))), "b": pa.concat_arrays([pa.array(np.maximum(x, y)), pa.nulls(len(rest), pa.int64())])})

    return run


def _sets(k: int, level):
    def run(batches):
        np.seterr(over="ignore")
        for batch in batches:
            texts = _texts(batch)
            for i, j in slabs(texts):
                g, cut = flat(texts[i:j], k)
                key, cut = distinct(pk.ordered(g, level.value), cut)
                keys = [key[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(i, j - i).cast(pa.int64()), "keys": pa.array(keys, pa.binary())})

    return run


def _verified(batches):
    for batch in batches:
        x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
        ok = [pk.linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids (distinct)."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id")


def _links(docs: DataFrame, pairs: DataFrame, k: int, level) -> DataFrame:
    """Pairs (a, b) of doc_ids whose whole sets link."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct(), "ids")
    sets = written(_among(docs, ids).mapInArrow(_sets(k, level), "doc_id long, keys binary"), "sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("keys").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("keys").alias("y")), "b")
    out = written(both.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long").distinct(), "links")
    discard(sets), discard(ids)
    return out


def _with_groups(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """rows (f1, f2, ...) with their group's columns. Groups of very many rows, of which there can be no more than HEAVY_GROUPS, are
    broadcast, so that no task of the other join holds more than their share of rows."""
    heavy = F.broadcast(groups.where(F.col("copies") > max(1000, total // HEAVY_GROUPS)))
    rest = rows.join(heavy.select("f1", "f2"), ["f1", "f2"], "left_anti").join(groups, ["f1", "f2"])
    return rows.join(heavy, ["f1", "f2"]).unionByName(rest)


def _per_bucket(sets: DataFrame) -> np.ndarray:
    """Number of sets (n: shingles) per size bucket, within one."""
    out = np.zeros(256, np.int64)
    for r in sets.groupBy(F.floor(F.log("n") / math.log(4 / 3)).alias("b")).count().collect():
        out[r["b"]] = r["count"]
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id, n_copies) for every row of docs; links are Jaccard similarities of 0.75 and more.
    set_id is the smallest id of the rows whose sets equal this one's, n_copies their number.

    Null or wordless text: 0 shingles, linked with nothing, its own component. Fewer than k words: one shingle. Repeated rows
    each appear. A row with a null id links nothing of itself: its component is that of rows with an equal set, null if none of
    them has an id. An empty table gives an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    features = written(docs.mapInArrow(_featured(k), _FEATURES_SQL), "features")
    sketch, sizes = frequencies(features)
    level = spark.sparkContext.broadcast(pk.levels(sketch))
    split = pk.splits(sizes)

    rows = features.where("slice is null").drop("slice", "counts")
    some = rows.where("n_shingles > 0")
    groups = written(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.min("n_shingles").alias("n")), "groups")
    total = int(sizes.sum())
    owner = written(_with_groups(some, groups, total).select("doc_id", "node", "n_shingles").distinct(), "owner")

    n = max(4 * scan_partitions(docs), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def pairs_of(texts: DataFrame, first: bool, split: dict[int, tuple[int, int]]) -> DataFrame:
        parts = texts.mapInArrow(_emitted(k, level, split, pk.KEEP if first else 0.0), _PART_SQL)
        return written(parts.repartition(n, "part").groupBy("part").applyInArrow(_part_pairs(first, split), "a long, b long").distinct(), "pairs")

    one = docs
    if groups.count() <= min(BROADCAST_IDS, 0.7 * total):  # many copies: one of each set stands for all
        split = pk.splits(_per_bucket(groups.where("node is not null")))
        one = docs.join(F.broadcast(groups.select(F.col("node").alias("doc_id")).distinct()), "doc_id")
    found = pairs_of(one.withColumn("component", F.lit(0).cast("long")), True, split)
    first = _links(docs, found.where("b is not null"), k, level)

    def nodes(pairs: DataFrame) -> DataFrame:
        a, b = (owner.select(F.col("doc_id").alias(c), F.col("node").alias(f"node_{c}")) for c in "ab")
        return pairs.join(a, "a").join(b, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    edges = written(nodes(first), "edges")
    known = written(components(edges), "components")
    rest = found.where("b is null").select(F.col("a").alias("doc_id")).distinct().join(owner, "doc_id").join(known, "node", "left")
    rest = written(rest.groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component"), F.max("n_shingles").alias("n")), "rest")
    more = pairs_of(_among(docs, rest.drop("n")), False, pk.splits(_per_bucket(rest), pk.WHOLE_DOCS))
    second = _links(docs, more, k, level)
    if second.isEmpty():
        final = known
    else:
        final = written(components(edges.unionAll(nodes(second))), "components")
        discard(known)
    for table in (found, more, first, second, edges, rest, owner):
        discard(table)
    classes = groups.join(final, "node", "left").select("f1", "f2", "copies", F.coalesce("component", "node").alias("component_id"), F.col("node").alias("set_id"))
    columns = ("doc_id", "n_shingles", "component_id", "set_id", F.col("copies").alias("n_copies"))
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("set_id"), F.lit(1).cast("long").alias("n_copies"))
    return _with_groups(some, classes, total).select(*columns).unionByName(empty)
