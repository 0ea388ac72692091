"""Quality classifier with hierarchical empirical Bayes over sites and paths.

Evidence of a document: two classifiers fitted to at most SAMPLE labelled documents (those of smallest hash). Low quality is a
logistic model of text shape; toxicity comes from the strongest hashed words and word beginnings, of those that are more
frequent in toxic documents than chance allows for that many buckets. How much they say is fitted across two halves of the
sample, each scored by the words of the other.  All documents' evidence is then summed by site and by path (grouped aggregation, labelled documents count
with their labels); a path's rate is shrunk toward its site's, a site's toward the global rate, with strengths estimated from
the spread of the rates. A document's log odds are its own plus what its path has over the global rate.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import written
from talkloom.llm.mixing import checked
from talkloom.llm.shingle import mix, running, slabs, span_hashes, word_spans

SAMPLE, BITS, SLICES, TOP = 20_000, 20, 16, 3
#: Bytes of a word's beginnings that count as words too, where the word is longer.
BEGINNINGS = (4, 5, 6, 7)
SHAPE = ("intercept", "log words", "distinct", "symbol ends", "capitals", "letters", "mean length", "repeats", "digits", "bars")
_ALPHA, _CAPS, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_CAPS[65:91] = True
_DIGIT[48:58] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in "!#$%&*+/<=>@\\^_`{|}~"]] = True
_STRIP = np.zeros(256, bool)
_STRIP[[*b".,;:!?\"'()[]{}*#$%&|-_ \t\n\r\x0b\x0c"]] = True
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _prefix_sums(marks: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))


class Slab:
    """About a megabyte of texts at once: words, their hashes and buckets as arrays, with the text that each belongs to."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        raw = b"\n".join(texts)
        self.b = np.frombuffer(raw, np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.start, self.end, self.h = word_spans(raw)
        self.doc = np.searchsorted(self.at, self.start, "right") - 1
        self.words = np.bincount(self.doc, minlength=self.n)

    def _share(self, of: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        c = _prefix_sums(of)
        return (c[np.minimum(self.at[1:] - 1, len(self.b))] - c[self.at[:-1]]).astype(float)

    def shape(self) -> np.ndarray:
        """What texts look like, as numbers of about -1 to 1 (SHAPE)."""
        n, size = np.maximum(self.words, 1), np.maximum(self.at[1:] - 1 - self.at[:-1], 1)
        letters = np.maximum(1, self._share(_ALPHA[self.b]))
        o = np.lexsort((self.h, self.doc))
        h, d = self.h[o], self.doc[o]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, bool)
        distinct = np.bincount(d[new], minlength=self.n)
        ends = np.bincount(self.doc[_ENDS[self.b[self.end - 1]]], minlength=self.n) if len(self.end) else np.zeros(self.n)
        again = (self.h[1:] == self.h[:-1]) & (self.doc[1:] == self.doc[:-1])
        repeats = np.bincount(self.doc[1:][again], minlength=self.n) / np.maximum(1, n - 1)
        out = np.column_stack((np.ones(self.n), np.log(n) / 5 - 1, distinct / n, ends / n, self._share(_CAPS[self.b]) / letters, letters / size, size / n / 10, repeats, self._share(_DIGIT[self.b]) / size, self._share(self.b == 124) / size * 10))
        out[self.words == 0] = [1.0, -1, *[0] * (len(SHAPE) - 2)]
        return out

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, buckets) for each different word of a text: one row of buckets for the word, bare of symbols at its ends, and for
        its beginnings (BEGINNINGS bytes; the word's own again where it is no longer)."""
        bare = np.flatnonzero(~_STRIP[self.b])
        lo = np.searchsorted(bare, self.start)
        hi = np.searchsorted(bare, self.end) - 1
        ok = lo <= hi
        s, e, d = bare[lo[ok]], bare[hi[ok]] + 1, self.doc[ok]
        sums = running(self.b)
        h = span_hashes(self.b, s, e, sums)
        _, first = np.unique((d.astype(np.uint64) << np.uint64(44)) ^ (h >> np.uint64(20)), return_index=True)
        first.sort()
        s, e, d, h = s[first], e[first], d[first], h[first]
        out = np.empty((len(s), 1 + len(BEGINNINGS)), np.int64)
        out[:, 0] = mix(h) >> np.uint64(64 - BITS)
        for i, k in enumerate(BEGINNINGS, 1):
            longer = e - s > k
            out[:, i] = out[:, 0]
            out[longer, i] = mix(span_hashes(self.b, s[longer], s[longer] + k, sums) + np.uint64(k) * _SALT) >> np.uint64(64 - BITS)
        return d, out

    def halves(self) -> np.ndarray:
        """The half of the sample that each text is in; copies are in the same one."""
        out = np.zeros(self.n, np.uint64)
        np.bitwise_xor.at(out, self.doc, self.h)
        return (mix(out) >> np.uint64(63)).astype(np.int64)

    def strongest(self, strength: np.ndarray) -> np.ndarray:
        """1, and the TOP strongest words of each text, a word by the strongest of its buckets; strength: one row of buckets for each text's half, or for all."""
        d, k = self.buckets()
        x = (strength[self.halves()[d][:, None], k] if strength.ndim == 2 else strength[k]).max(axis=1, initial=0)
        d, x = d[x > 0], x[x > 0]
        o = np.lexsort((-x, d))
        d, x = d[o], x[o]
        rank = np.arange(len(d)) - np.searchsorted(d, d)
        out = np.zeros((self.n, TOP + 1))
        out[:, 0] = 1
        out[d[rank < TOP], 1 + rank[rank < TOP]] = x[rank < TOP]
        return out


def _slabs(batches):
    """(batch, first row, slab) of all rows, about a megabyte of text at a time."""
    for batch in batches:
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        for i, j in slabs(texts):
            yield batch, i, Slab(texts[i:j])


def _count(batches):
    counts = np.zeros((2, 2, 1 << BITS), np.int32)  # half, toxic
    x, y = [], []
    np.seterr(over="ignore")
    for batch, i, slab in _slabs(batches):
        q, t = (np.array(batch.column(c).slice(i, slab.n).to_pylist(), np.int64) for c in ("quality", "toxic"))
        d, k = slab.buckets()
        own = np.unique((np.repeat(d, k.shape[1]) << BITS) | k.ravel())  # each bucket of a text once
        d, k = own >> BITS, own & ((1 << BITS) - 1)
        np.add.at(counts, (slab.halves()[d], t[d], k), 1)
        x.append(slab.shape())
        y.append(np.column_stack((q, t)))
    if x:
        rows = [zlib.compress(a.tobytes(), 1) for a in np.split(counts, SLICES, axis=2)]
        extra = np.column_stack((np.concatenate(x), np.concatenate(y).astype(float))).tobytes()
        yield pa.RecordBatch.from_pydict({"slice": pa.array([*range(SLICES), -1], pa.int32()), "data": pa.array([*rows, extra], pa.binary())})


def _sum(table: pa.Table) -> pa.Table:
    i, data = table.column("slice")[0].as_py(), table.column("data").to_pylist()
    out = b"".join(data) if i < 0 else zlib.compress(sum(np.frombuffer(zlib.decompress(d), np.int32) for d in data).astype(np.int32).tobytes(), 1)
    return pa.table({"slice": pa.array([i], pa.int32()), "data": pa.array([out], pa.binary())})


def strengths(t: np.ndarray, c: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log odds of toxicity per bucket that t toxic and c other documents have; 0 unless its likelihood ratio against chance
    is beyond the number of buckets tried."""
    t, c, rate = t.astype(float), c.astype(float), (n1 + 0.5) / (n1 + n0 + 1)
    n = np.maximum(t + c, 1)
    ratio = t * np.log(np.maximum(t, 1e-9) / n / rate) + c * np.log(np.maximum(c, 1e-9) / n / (1 - rate))
    ok = (t >= 3) & (t / n > rate) & (ratio > np.log(max(2, int((t >= 3).sum()))))
    return np.where(ok, np.maximum(0, np.log((t + 0.5) / (n1 + 1)) - np.log((c + 0.5) / (n0 + 1))), 0).astype(np.float32)


def _crossed(shared):
    def run(batches):
        np.seterr(over="ignore")
        other = np.stack(shared.value[::-1])  # each half is scored by the words of the other
        for batch, i, slab in _slabs(batches):
            rows = np.column_stack((slab.strongest(other), batch.column("toxic").slice(i, slab.n).to_pylist()))
            yield pa.RecordBatch.from_pydict({"row": pa.array([r.astype(float).tobytes() for r in rows], pa.binary())})

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(labelled: DataFrame) -> dict:
    """labelled: text, quality, toxic; at most SAMPLE rows. The model: weights of shape and of the strongest buckets, and one
    strength per bucket."""
    rows = labelled.mapInArrow(_count, "slice int, data binary").groupBy("slice").applyInArrow(_sum, "slice int, data binary").collect()
    got = {r["slice"]: bytes(r["data"]) for r in rows}
    none = np.array([-3.0] + [0.0] * 20)
    if -1 not in got:
        return {"shape": none[: len(SHAPE)], "toxic": none[: TOP + 1], "strength": np.zeros(1 << BITS, np.float32)}
    xy = np.frombuffer(got[-1]).reshape(-1, len(SHAPE) + 2)
    xy = xy[np.lexsort(xy.T)]
    counts = np.concatenate([np.frombuffer(zlib.decompress(got[i]), np.int32).reshape(2, 2, -1) for i in range(SLICES)], axis=2)
    n1, n0 = float(xy[:, -1].sum()), float((1 - xy[:, -1]).sum())
    halves = [strengths(counts[k, 1], counts[k, 0], n1 / 2, n0 / 2) for k in (0, 1)]
    shared = labelled.sparkSession.sparkContext.broadcast(halves)
    crossed = np.array(sorted(np.frombuffer(bytes(r["row"])).tolist() for r in labelled.mapInArrow(_crossed(shared), "row binary").collect()))
    shared.unpersist()
    return {"shape": logistic(xy[:, : len(SHAPE)], 1 - xy[:, -2]), "toxic": logistic(crossed[:, :-1], crossed[:, -1]), "strength": strengths(counts[:, 1].sum(axis=0), counts[:, 0].sum(axis=0), n1, n0)}


def evidence(texts: list[bytes], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of low quality and of toxicity."""
    slab = Slab(texts)
    return slab.shape() @ model["shape"], slab.strongest(model["strength"]) @ model["toxic"]


def _score(model):
    def run(batches):
        np.seterr(over="ignore")
        m = model.value
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            got = [evidence(texts[i:j], m) for i, j in slabs(texts)]
            low, toxic = (np.concatenate([g[i] for g in got]) if got else np.zeros(0) for i in (0, 1))
            own = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in own] + [pa.array(low, pa.float64()), pa.array(toxic, pa.float64())], names=[*own, "low", "toxic"])

    return run


def _p(x):
    return 1 / (1 + F.exp(-x))


def _logit(p):
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, n: str, bad: str, mean) -> float:
    """Prior strength from the spread of group rates beyond what chance makes; large when there is none."""
    r = groups.select(F.col(n).alias("n"), (F.col(bad) / F.col(n)).alias("r"), mean.alias("m")).where("n > 1").agg(F.sum(F.col("n") * (F.col("r") - F.col("m")) ** 2), F.sum(F.col("m") * (1 - F.col("m"))), F.sum("n"), F.avg(F.col("m") * (1 - F.col("m"))), F.count("*")).first()
    if not r[4] or not r[2]:
        return 1000.0
    spread = max(0.0, (r[0] - r[1]) / r[2])
    return float(min(1000.0, max(20.0, r[3] / spread - 1))) if spread > 0 else 1000.0


def row_key(doc_id, text, site, path):
    """SHA-256 of all that a verdict depends on; nulls differ from every value. Rows of one key have one verdict."""
    parts = [c.cast(t) for c, t in ((doc_id, "long"), (text, "string"), (site, "string"), (path, "string"))]
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in parts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def bounded(d: DataFrame, pick: DataFrame) -> DataFrame:
    """(text, quality, toxic) of the rows whose ids pick has: SAMPLE at most, by the hash of the id, then by row key, also where an
    id repeats; of rows that agree in all that a verdict depends on, one."""
    key = row_key(*[F.col(c) for c in ("doc_id", "text", "site", "path")])
    rows = d.join(F.broadcast(pick), "doc_id").withColumn("sample_key", key)  # pick: at most SAMPLE ids
    first = rows.select("doc_id", "sample_key").distinct().orderBy(F.xxhash64("doc_id"), "sample_key").limit(SAMPLE)
    rows = rows.join(F.broadcast(first.select("sample_key")), "sample_key").dropDuplicates(["sample_key"])
    return rows.select("text", F.col("known_quality").alias("quality"), F.col("known_toxic").alias("toxic"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang", keyed: bool = False) -> DataFrame:
    """(doc_id, low, toxic, site_rate, path_rate, p_reject, known_bad, keep) for every row: log odds of the document's own evidence,
    the shrunk rates of its site and path (a site's path_col values), the combined probability of low quality or toxicity, all
    by the method, also for labelled rows; what the label says (null without one); and whether the document stays: by its label
    where it has one, else by p_reject. labels: doc_id, quality, toxic; null labels don't count; of a repeated one the worst holds.

    Null texts count as empty; null sites and paths are groups of their own. Repeated rows each have a row. Without labels
    nothing is known and all stay. An empty table gives none. Other columns aren't read. keyed adds row_key, by which a row
    finds its own verdict where ids are null or repeat.
    """
    spark = docs.sparkSession
    col = lambda c, t: F.col(f"`{c}`").cast(t)
    d = docs.select(col(id_col, "long").alias("doc_id"), col(text_col, "string").alias("text"), col(site_col, "string").alias("site"), col(path_col, "string").alias("path"))
    own = ["row_key"] if keyed else []
    if keyed:
        d = d.withColumn("row_key", row_key(*[F.col(c) for c in ("doc_id", "text", "site", "path")]))
    known = labels.where("quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("known_quality"), F.max("toxic").alias("known_toxic"))
    known = written(known, "labels")
    pick = known.join(d.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id")).limit(SAMPLE)
    model = spark.sparkContext.broadcast(fit(bounded(d, pick)))
    rows = written(d.mapInArrow(_score(model), "doc_id long, site string, path string, " + "row_key binary, " * keyed + "low double, toxic double"), "evidence")
    rows = rows.join(checked(known), "doc_id", "left")
    bad = F.when(F.col("known_quality").isNotNull(), ((F.col("known_quality") == 0) | (F.col("known_toxic") == 1)).cast("double")).otherwise(1 - (1 - _p(F.col("low"))) * (1 - _p(F.col("toxic"))))
    paths = written(rows.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum(bad).alias("bad")), "paths")
    total = paths.agg(F.sum("bad") / F.sum("n")).first()[0]
    total = 0.5 if total is None else float(total)
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    k = _strength(sites, "n", "bad", F.lit(total))
    sites = written(sites.select(F.col("site").alias("of"), ((F.col("bad") + k * total) / (F.col("n") + k)).alias("site_rate")), "sites")
    paths = paths.join(checked(sites), F.col("site").eqNullSafe(F.col("of"))).drop("of")
    k = _strength(paths, "n", "bad", F.col("site_rate"))
    rates = paths.select(F.col("site").alias("of"), F.col("path").alias("at"), "site_rate", ((F.col("bad") + k * F.col("site_rate")) / (F.col("n") + k)).alias("path_rate"))
    rates = checked(written(rates, "rates"))
    out = rows.join(rates, F.col("site").eqNullSafe(F.col("of")) & F.col("path").eqNullSafe(F.col("at")))
    shift = _logit(F.col("path_rate")) - _logit(F.lit(total))
    p = 1 - (1 - _p(F.col("low") + shift)) * (1 - _p(F.col("toxic") + shift))
    known_bad = (F.col("known_quality") == 0) | (F.col("known_toxic") == 1)
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("low", "toxic", "site_rate", "path_rate")], F.round(p, 6).alias("p_reject"), known_bad.alias("known_bad"), F.coalesce(~known_bad, p <= 0.5).alias("keep"), *own)
