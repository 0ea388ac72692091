"""Phrase collocation mining over vertical positional inverted lists.

Texts are cut into blocks of one language and about SLAB bytes. A block holds, for each frequent phrase, the list of positions at
which it occurs; a list's length is the phrase's exact frequency there. A level makes phrases one word longer: the list of a
phrase of k words is merge-joined, k positions on, with the postings of the adjacent word, and only where the last k words are
frequent as well (their list holds the next position). A block's list lengths are then summed over all blocks: entries are dealt
out by phrase, packed into one row for a block and part, and each part gives the frequent phrases, with ids, and to each block
those of its own that are frequent. So a block never sees more than its own phrases, and no table of phrases is broadcast.

Everything exact: words are compared by their bytes, phrases by (id of the first words, id of the last word).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm.common import discard, scan_partitions, written

LEAST, LONGEST, NUMERATOR, COVERED, TOP = 30, 4, 2_000_000, 80, 2000
#: Bytes of text in a block; bytes that a task holds back for blocks of all languages; parts of entries for each partition of the scan.
SLAB, HELD, PARTS_EACH = 8 << 20, 32 << 20, 2
#: White space inside pieces, and what ends a piece.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 32]] = 1
_CLASS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_CODEC = pa.Codec("zstd", compression_level=1)


def pack(a: np.ndarray) -> bytes:
    """Integers as bytes, turned so that bytes of equal weight stand together, compressed."""
    raw = np.ascontiguousarray(a.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True) if raw else b""


def unpack(raw: bytes | None) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    flat = np.frombuffer(_CODEC.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view(np.int64).ravel()


def postings(raw: bytes) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of lower-cased texts, and for each position the index of its word, or -1 where a piece ends."""
    b = np.frombuffer(raw.lower(), np.uint8)
    kind = _CLASS[b]
    word = kind == 0
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    ends = np.cumsum(kind == 2, dtype=np.int64)[start]
    offsets = np.concatenate(([0], np.cumsum(end - start)))
    binary = pa.large_binary() if offsets[-1] >= 1 << 31 else pa.binary()
    at = pa.py_buffer(offsets.astype(np.int64 if binary == pa.large_binary() else np.int32))
    coded = pa.Array.from_buffers(binary, len(start), [None, at, pa.py_buffer(b[word])]).dictionary_encode()
    place = np.arange(len(start)) + np.cumsum(np.diff(ends, prepend=ends[0]) > 0)
    out = np.full(place[-1] + 1, -1, np.int64)
    out[place] = coded.indices.to_numpy()
    return coded.dictionary, out


def _blocks(slab: int):
    def run(batches):
        seq = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def block(lang):
            nonlocal seq
            words, stream = postings(b"\n".join(held.pop(lang)))
            del size[lang]
            count = np.bincount(stream[stream >= 0], minlength=len(words))
            one = np.array([0, len(words)], np.int32)
            lists = [pa.ListArray.from_arrays(one, x) for x in (words.cast(pa.string()), pa.array(count, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([lang], pa.string()), *lists, pa.array([pack(stream)], pa.binary())], ["block", "lang", "words", "counts", "stream"])
            seq += 1

        for batch in batches:
            for text, lang in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if not text:
                    continue
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= slab:
                    yield from block(lang)
                elif sum(size.values()) >= HELD:
                    yield from block(max(sorted(size), key=size.__getitem__))
        for lang in sorted(held):
            yield from block(lang)

    return run


def occurrences(words: np.ndarray, lists: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a listed phrase of k words can grow, and for each the key of the longer phrase. words and lists give
    for each position its frequent word and the frequent phrase of k words that begins there, or -1. This is the merge-join of
    every list, k positions on, with the postings of each word that is adjacent, where the next position is listed too."""
    n = len(words) - k
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((lists[:n] >= 0) & (lists[1 : n + 1] >= 0) & (words[k:] >= 0))
    return at, lists[at] * (int(words.max()) + 1) + words[at + k]


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence the slot of its key (in order of first occurrence), and the keys. A slot's occurrences are its list."""
    return pd.factorize(key)


def _part(prefix: np.ndarray, word: np.ndarray, parts: int) -> np.ndarray:
    h = prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)


STATE = "block long, part int, words binary, word_ids binary, lists binary, list_ids binary, prefix binary, word binary, n binary, slot binary"
FOUND = "block long, prefix_id long, word_id long, f long, phrase_id long, slots binary, ids binary"


def _dealt(block: int, words: np.ndarray, word_ids: np.ndarray, lists: np.ndarray, list_ids: np.ndarray, k: int, parts: int, last: bool):
    """The block's lists for the next level, then its entries of this level (phrases of k + 1 words) for each part."""
    at, key = occurrences(words, lists, k)
    if not len(at):
        return
    names = STATE.replace(" long", "").replace(" int", "").replace(" binary", "").split(", ")

    def row(*values):
        types = (pa.int64(), pa.int32(), *[pa.binary()] * 8)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    if not last:
        same = lists is words  # phrases of one word
        yield row(block, None, pack(words), pack(word_ids), None if same else pack(lists), None if same else pack(list_ids), None, None, None, None)
    own, keys = _counted(key)
    n = np.bincount(own, minlength=len(keys))
    many = int(words.max()) + 1
    prefix, word = list_ids[keys // many], word_ids[keys % many]
    part = _part(prefix, word, parts)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    cut = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))
    for p in np.flatnonzero(np.diff(cut)):
        mine = order[cut[p] : cut[p + 1]]
        yield row(block, int(p), None, None, None, None, pack(prefix[mine]), pack(word[mine]), pack(n[mine]), pack(mine))


def _first(parts: int):
    """Level 2, from a block's stream and its frequent words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.Table.from_batches([], _arrow(STATE))
        stream = unpack(left.column("stream")[0].as_py())
        local, ids = (right.column(c).to_numpy().astype(np.int64) for c in ("local", "word_id"))
        order = np.argsort(local)
        to = np.full(max(int(stream.max(initial=0)), int(local.max())) + 2, -1, np.int64)
        to[local[order]] = np.arange(len(order))
        words = to[stream]  # -1 stays -1
        return pa.Table.from_batches(list(_dealt(left.column("block")[0].as_py(), words, ids[order], words, ids[order], 1, parts, False)), _arrow(STATE))

    return run


def _next(k: int, parts: int, last: bool):
    """Level k + 1, from a block's lists of level k - 1 and those of its phrases of k words that are frequent."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.Table.from_batches([], _arrow(STATE))
        words, word_ids, lists, list_ids = (unpack(left.column(c)[0].as_py()) for c in ("words", "word_ids", "lists", "list_ids"))
        at, key = occurrences(words, words if k == 2 else lists, k - 1)
        own, keys = _counted(key)
        slots = np.concatenate([unpack(x) for x in right.column("slots").to_pylist()])
        ids = np.concatenate([unpack(x) for x in right.column("ids").to_pylist()])
        order = np.argsort(slots)
        to = np.full(len(keys), -1, np.int64)
        to[slots[order]] = np.arange(len(order))
        longer = np.full(len(words), -1, np.int64)
        longer[at] = to[own]
        # only stretches that a frequent phrase covers go on, each ended by a gap
        live = np.zeros(len(words) + 1, np.int64)
        begins = np.flatnonzero(longer >= 0)
        np.add.at(live, begins, 1)
        np.add.at(live, begins + k, -1)
        live = np.cumsum(live)[:-1] > 0
        keep = live | np.concatenate(([False], live[:-1]))
        words = np.where(live, words, -1)[keep]
        used = np.unique(words[words >= 0])
        words = np.where(words >= 0, np.searchsorted(used, words), -1)
        return pa.Table.from_batches(list(_dealt(left.column("block")[0].as_py(), words, word_ids[used], longer[keep], ids[order], k, parts, last)), _arrow(STATE))

    return run


def _frequent(least: int, last: bool):
    """Sums a part's entries over blocks: rows of frequent phrases, and for each block the slots and ids of its own."""

    def run(table: pa.Table) -> pa.Table:
        cols = [[unpack(x) for x in table.column(c).to_pylist()] for c in ("prefix", "word", "n", "slot")]
        cut = np.concatenate(([0], np.cumsum([len(x) for x in cols[0]])))
        prefix, word, n, slot = (np.concatenate(c) for c in cols)
        (p, prefixes), (w, words) = pd.factorize(prefix), pd.factorize(word)
        own, keys = _counted(p * len(words) + w)
        f = np.zeros(len(keys), np.int64)
        np.add.at(f, own, n)
        ok = f >= least
        ids = (int(table.column("part")[0].as_py()) << 40) + np.cumsum(ok) - 1
        many, found = int(ok.sum()), keys[ok]
        out = {"block": pa.nulls(many, pa.int64()), "prefix_id": pa.array(prefixes[found // len(words)]), "word_id": pa.array(words[found % len(words)]), "f": pa.array(f[ok]), "phrase_id": pa.array(ids[ok]), "slots": pa.nulls(many, pa.binary()), "ids": pa.nulls(many, pa.binary())}
        tables = [pa.table(out)]
        if not last and many:
            rows = []
            for block, a, b in zip(table.column("block").to_pylist(), cut[:-1], cut[1:], strict=True):
                keep = ok[own[a:b]]
                if keep.any():
                    rows.append((block, None, None, None, None, pack(slot[a:b][keep]), pack(ids[own[a:b][keep]])))
            tables.append(pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [x.type for x in out.values()], strict=True)], list(out)))
        return pa.concat_tables(tables)

    return run


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, slab: int = SLAB) -> tuple[DataFrame, DataFrame]:
    """(lang, n): words of each language; and (lang, size, phrase, f): all phrases of 1 to longest words that occur least times or
    more in their language. Null texts are empty, null languages are 'und', repeated rows count each; an empty table gives none.
    A text is cut nowhere but at the ends of pieces. Memory of a task: a block, or one text if that is longer."""
    spark = docs.sparkSession
    parts = PARTS_EACH * scan_partitions(docs)
    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).where(F.length("text") > 0)
    blocks = written(texts.mapInArrow(_blocks(slab), "block long, lang string, words array<string>, counts array<long>, stream binary"), "blocks")
    each = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "w")).select("block", "lang", "local", F.col("w.words").alias("w"), F.col("w.counts").alias("c"))
    sizes = written(each.groupBy("lang").agg(F.sum("c").alias("n")), "sizes")
    words = written(each.groupBy("lang", "w").agg(F.sum("c").alias("f")).where(F.col("f") >= least).withColumn("word_id", F.monotonically_increasing_id()), "words")
    own = each.select("block", "lang", "local", "w").join(words, ["lang", "w"]).select(F.col("block").alias("of"), "local", "word_id")
    level = words.select("lang", F.lit(1).alias("size"), F.col("w").alias("phrase"), "f", F.col("word_id").alias("phrase_id"))
    levels, scratch = [level], [blocks]
    state, back, kernel = blocks.select("block", "stream"), own, _first(parts)
    for k in range(2, longest + 1):
        moved = written(state.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(kernel, STATE), "lists")
        entries = moved.where(F.col("part").isNotNull()).select("block", "part", "prefix", "word", "n", "slot")
        found = written(entries.groupBy("part").applyInArrow(_frequent(least, k == longest), FOUND), "phrases")
        names = words.select("word_id", F.col("w").alias("last"))
        new = found.where(F.col("block").isNull()).join(levels[-1].select(F.col("phrase_id").alias("prefix_id"), "lang", F.col("phrase").alias("head")), "prefix_id").join(names, "word_id")
        levels.append(written(new.select("lang", F.lit(k).alias("size"), F.concat_ws(" ", "head", "last").alias("phrase"), "f", "phrase_id"), "level"))
        state = moved.where(F.col("part").isNull()).select("block", "words", "word_ids", "lists", "list_ids")
        back = found.where(F.col("block").isNotNull()).select(F.col("block").alias("of"), "slots", "ids")
        for x in scratch:
            discard(x)
        scratch, kernel = [moved, found], _next(k, parts, k + 1 == longest)
    for x in scratch:
        discard(x)
    every_level = levels[0]
    for x in levels[1:]:
        every_level = every_level.unionAll(x)
    return sizes, every_level.drop("phrase_id")


def _subphrases(phrase, size, least_size: int):
    """All shorter stretches of at least least_size words of a phrase."""
    w = F.split(phrase, " ")
    made = F.transform(F.sequence(F.lit(least_size), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice(w, i, k), " ")))
    return F.array_distinct(F.flatten(made))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, slab: int = SLAB) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score; score = floor(2000000 a / (l + r)) at the cut
    that makes it least (ties: the first cut). Phrases of which a longer one keeps four fifths or more are left out. Ties in rank go
    by a, then by the phrase's bytes. Sums are decimal where they may pass 64 bits."""
    sizes, phrases = frequent_phrases(docs, least, longest, slab)
    spark = docs.sparkSession
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    longer = phrases.where("size > 2").select("lang", "f", F.explode(_subphrases(F.col("phrase"), F.col("size"), 2)).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    kept = phrases.where("size > 1").join(longer, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (wide("cover") * 100 < wide("f") * COVERED))
    w = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size", w.alias("w"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    one = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(one.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(one.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr(f"(cast({NUMERATOR} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    best = best.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents where text is not null),
w as materialized (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as l from pieces),
g as (select lang, 1 as size, unnest(l) as phrase from w
      union all select lang, k, unnest(list_transform(range(1, len(l) - k + 2), lambda i: array_to_string(l[i : i + k - 1], ' '))) from w, range(2, 5) t(k) where len(l) >= k),
f as materialized (select lang, size, phrase, count(*) as f from g group by all having count(*) >= 30),
n as (select lang, sum(len(l))::bigint as n from w group by lang having sum(len(l)) > 0),
c as materialized (select *, string_split(phrase, ' ') as l from f where size > 1),
s as (select distinct lang, phrase as longer, f, array_to_string(l[i : i + k - 1], ' ') as phrase from c, range(2, 4) t(k), range(1, 4) u(i) where k < size and i + k - 1 <= size),
m as (select lang, phrase, max(f) as cover from s group by all),
kept as (select c.* from c left join m using (lang, phrase) where cover is null or 100 * cover::hugeint < 80 * f::hugeint),
cuts as (select kept.lang, kept.phrase, kept.f as a, k, x.f as l, y.f as r, (2000000 * kept.f::hugeint // (x.f + y.f)::hugeint)::bigint as score
         from kept, range(1, 4) t(k), f x, f y where k < kept.size and x.lang = kept.lang and x.phrase = array_to_string(kept.l[1 : k], ' ') and y.lang = kept.lang and y.phrase = array_to_string(kept.l[k + 1 : kept.size], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from best join n using (lang) qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000"""
