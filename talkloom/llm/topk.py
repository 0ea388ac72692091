"""Exact top-k search by inner product: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are dealt out by ranges of their length and stand in descending order. Queries come in blocks of bounded size, each
broadcast over one scan. A query starts with the k-th best score among the SEED longest vectors; a vector is passed over
when the product of the lengths is below the k-th best, or when the product in the first HEAD rotated dimensions plus the
product of the rests' lengths is. What remains is scored exactly. Tasks send k rows a query at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm.common import discard, scan_partitions, written

HEAD, SEED, BLOCK, STEP = 16, 4096, 4096, 1024


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v, norm): v = floor(scale * x). Vectors that are null, empty or hold null, NaN or infinite components, and rows
    without an id, are left out. Shorter vectors count as ending in zeros."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    df = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    df = df.where(F.coalesce(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False)))
    df = df.select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))
    return df.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat, n = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths())
    out = np.zeros((len(n), dim))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _gram(dim: int):
    def run(batches):
        g = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column("v"), dim)
            g += m.T @ m
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim), pa.int32()), "row": pa.array([r.tobytes() for r in g], pa.binary())})

    def add(table):
        return pa.table({"i": table.column("i").slice(0, 1), "row": pa.array([sum(np.frombuffer(x) for x in table.column("row").to_pylist()).tobytes()], pa.binary())})

    return run, add


def _best(q, ids, score, k):
    """The k best of each q: highest score, then smallest id. Equal (q, id, score) rows stay."""
    o = np.lexsort((ids, -score, q))
    q, ids, score = q[o], ids[o], score[o]
    if not len(q):
        return q, ids, score
    first = np.maximum.accumulate(np.where(np.concatenate(([True], q[1:] != q[:-1])), np.arange(len(q)), 0))
    keep = np.arange(len(q)) - first < k
    return q[keep], ids[keep], score[keep]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: floats hold them below 2**53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a @ b.T).astype(np.int64) if top < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


def _scan(shared, dim: int, k: int):
    def run(batches):
        qid, qv, rot, least = shared.value
        least = least.copy()
        qlen, qr = np.linalg.norm(qv, axis=1), qv @ rot
        qrest = np.sqrt((qr[:, HEAD:] ** 2).sum(axis=1))
        top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                norm, ids = part.column("norm").to_numpy(), part.column("vec_id").to_numpy()
                slack = 1e-9 * (1 + qlen * norm.max())
                live = np.flatnonzero(qlen * norm.max() + slack >= least)
                if not len(live):
                    continue
                v = _matrix(part.column("v"), dim)
                r = v @ rot
                bound = qr[live, :HEAD] @ r[:, :HEAD].T + np.outer(qrest[live], np.sqrt((r[:, HEAD:] ** 2).sum(axis=1)))
                q, c = np.nonzero(bound + slack[live, None] >= least[live, None])
                if 4 * len(q) > bound.size:
                    score = _products(qv[live], v)[q, c]
                else:
                    score = np.concatenate([(qv[live[q[i : i + 65536]]].astype(np.int64) * v[c[i : i + 65536]].astype(np.int64)).sum(axis=1) for i in range(0, len(q), 65536)] or [np.zeros(0, np.int64)])
                q = live[q]
                ok = (score >= least[q]) & (ids[c] != qid[q])
                top = _best(*(np.concatenate(x) for x in zip(top, (q[ok], ids[c][ok], score[ok]), strict=True)), k)
                full = np.flatnonzero(np.bincount(top[0], minlength=len(qid)) >= k)
                low = np.full(len(qid), np.iinfo(np.int64).max)
                np.minimum.at(low, top[0], top[2])
                least[full] = np.maximum(least[full], low[full])
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(qid[top[0]]), "vec_id": pa.array(top[1]), "score": pa.array(top[2])})

    return run


def exact_topk(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by every, its k best others by integer inner
    product; ties go to smaller ids; all, if there are fewer. Vectors of the query's own id are left out. Repeated rows are
    candidates each; of a repeated query id, the smallest vector asks. An empty table gives no rows. Scores have to fit a long."""
    spark = vectors.sparkSession
    clean = quantized(vectors, id_col, vec_col, scale)
    n = max(scan_partitions(vectors), int(spark.conf.get("spark.sql.shuffle.partitions")) if vectors.isStreaming else 1)
    table = written(clean.repartitionByRange(n, F.desc("norm")).sortWithinPartitions(F.desc("norm")), "vectors")
    schema = "query_id long, vec_id long, score long"
    asks = table.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    dim, many = table.agg(F.max(F.size("v"))).first()[0], asks.count()
    if not many:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    run, add = _gram(dim)
    rows = table.select("v").mapInArrow(run, "i int, row binary").groupBy("i").applyInArrow(add, "i int, row binary").collect()
    gram = np.stack([np.frombuffer(bytes(r["row"])) for r in sorted(rows, key=lambda r: r["i"])])
    rot = np.linalg.eigh(gram)[1][:, ::-1]  # right singular vectors, the largest first
    seed = table.select("vec_id", "v", "norm").orderBy(F.desc("norm")).limit(SEED).toArrow()
    sid, sv = seed.column("vec_id").to_numpy(), _matrix(seed.column("v").combine_chunks(), dim)
    found = []
    blocks = -(-many // BLOCK)
    asks = written(asks, "asks")
    for b in range(blocks):
        own = asks.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        if not own.num_rows:
            continue
        qid, qv = own.column("vec_id").to_numpy(), _matrix(own.column("v").combine_chunks(), dim)
        least = np.full(len(qid), float("-inf"))
        for i in range(0, len(qid), 256):
            s = np.where(sid[None, :] == qid[i : i + 256, None], np.iinfo(np.int64).min, _products(qv[i : i + 256], sv))
            if (sid[None, :] != qid[i : i + 256, None]).sum(axis=1).min() >= k:
                least[i : i + 256] = np.partition(s, -k, axis=1)[:, -k]
        # shorter vectors can't be among the best of any query of this block: the table is sorted by length, so that its row groups are skipped
        qlen = np.maximum(np.linalg.norm(qv, axis=1), 1e-300)
        shortest = float((least / qlen).min()) * (1 - 1e-9) if np.isfinite(least).all() else float("-inf")
        shared = spark.sparkContext.broadcast((qid, qv, rot, least))
        found.append(written(table.where(F.col("norm") >= shortest).select("vec_id", "v", "norm").mapInArrow(_scan(shared, dim, k), schema), "found"))
        shared.unpersist()
    discard(table), discard(asks)
    every_row = found[0]
    for x in found[1:]:
        every_row = every_row.unionAll(x)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every_row.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = len(embedding)),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10"""
