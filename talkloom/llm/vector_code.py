"""Vector code compression: product codes of integer vectors, found by partial-distance search.

A vector is cut into equal parts; each part position has a codebook. An entry's distance to a part is summed dimension by
dimension, in descending order of the codebook's variance. The first entry that leads after the first dimension is completed
first; a mask then drops entries whose sum so far is strictly larger than the best complete distance, until what is left is
complete. Ties go to lower indexes. All arithmetic is on integers: 64-bit where sums fit, Python's own beyond.

Training sums parts by entry in tasks, then by (part, entry, dimension); only codebooks, whose size the parameters fix, come to
the driver.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talkloom.llm.common import discard, written
from talkloom.llm.mixing import checked

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest component whose distances are summed in 64 bits, for up to 2**12 dimensions; rows searched at once.
_SMALL, _ROWS = 1 << 24, 4096


def quantized(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): v = floor(scale * x), for vectors that are neither null nor empty and hold no null, NaN or infinite
    component; rows without an id stay. Components beyond 64 bits count as the nearest 64-bit integer."""
    x = F.col(f"`{vec_col}`").cast("array<double>")
    ok = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))), F.lit(False)) & (F.size(x) > 0)
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return embeddings.where(ok).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), v.alias("v"))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x (integers) the index of its nearest entry in book, and its squared distance."""
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    total = (x[:, :1] - book[None, :, 0]) ** 2
    lead = total.argmin(axis=1)
    best = ((x - book[lead]) ** 2).sum(axis=1)
    row, entry = np.nonzero(total <= best[:, None])
    total = total[row, entry]
    for d in range(1, x.shape[1]):
        total = total + (x[row, d] - book[entry, d]) ** 2
        keep = total <= best[row]
        row, entry, total = row[keep], entry[keep], total[keep]
    order = np.lexsort((entry, total, row)) if total.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], total[i], entry[i])), np.int64)
    row, entry, total = row[order], entry[order], total[order]
    first = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    return entry[first], total[first]


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of integers, with zeros after the end of shorter ones."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.asarray(column.value_lengths(), np.int64)
    out = np.zeros((len(n), width), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out if not len(flat) or max(-int(flat.min()), int(flat.max())) <= _SMALL else out.astype(object)


def _searched(batch, books: list[np.ndarray], width: int):
    """(part, rows, indexes, distances) for each part position of a batch."""
    for at in range(0, batch.num_rows, _ROWS):
        x = _rows(batch.column("v").slice(at, _ROWS), width * len(books))
        for p, book in enumerate(books):
            own = x[:, p * width : (p + 1) * width]
            yield at, p, own, *nearest(own, book if own.dtype == book.dtype else book.astype(object))


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part position, from vectors (vec_id, v) as quantized() gives them. They start as the parts of the
    entries smallest vec_ids (then, and without ids last, the smallest vectors); each round moves every entry to the floor of its parts' mean.
    The vectors' longest length counts, rounded up to a multiple of parts. Fewer rows make fewer entries, no rows none."""
    from decimal import Decimal

    size = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-size // parts)
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    whole = np.array([[*r["v"], *[0] * (width * parts - len(r["v"]))] for r in first], object).reshape(len(first), width * parts)
    books = [_narrow(whole[:, p * width : (p + 1) * width]) for p in range(parts)]
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds if len(first) else 0):
        shared = context.broadcast(books)

        def sums(batches, shared=shared):
            total: dict[tuple[int, int], list] = {}
            for batch in batches:
                for _, p, own, entry, _d in _searched(batch, shared.value, width):
                    for e in np.unique(entry):
                        mine = own[entry == e]
                        got = total.setdefault((p, int(e)), [0, [0] * width])
                        got[0] += len(mine)
                        got[1] = [a + int(b) for a, b in zip(got[1], mine.sum(axis=0), strict=True)]
            keys = sorted(total)
            yield pa.RecordBatch.from_pydict({"part": pa.array([k[0] for k in keys], pa.int32()), "entry": pa.array([k[1] for k in keys], pa.int32()), "n": pa.array([total[k][0] for k in keys], pa.int64()), "sums": pa.array([[Decimal(x) for x in total[k][1]] for k in keys], pa.list_(pa.decimal128(38, 0)))})

        moved = vectors.select("v").mapInArrow(sums, "part int, entry int, n long, sums array<decimal(38,0)>").select("part", "entry", "n", F.posexplode("sums").alias("d", "s"))
        rows = moved.groupBy("part", "entry", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # parts x entries x width
        books = [b.astype(object) for b in books]
        for r in rows:
            books[r["part"]][r["entry"], r["d"]] = int(r["s"]) // r["n"]
        books = [_narrow(b) for b in books]
        shared.unpersist()
    return books


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if all(abs(x) <= _SMALL for x in book.flat) else book


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vectors with code (a byte for each part) and error (the sum of squared distances, null beyond 64 bits)."""
    width, shared = books[0].shape[1], vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            code = np.zeros((batch.num_rows, len(books)), np.uint8)
            error = np.zeros(batch.num_rows, object)
            for at, p, own, entry, d in _searched(batch, shared.value, width):
                code[at : at + len(own), p] = entry
                error[at : at + len(own)] += d.astype(object)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())], [*batch.schema.names, "code", "error"])

    return vectors.mapInArrow(run, StructType([*vectors.schema.fields]).add("code", "binary").add("error", "long"))


def decode(codes: DataFrame, books: list[np.ndarray], code_col: str = "code") -> DataFrame:
    """codes with approx: the vector of the entries that a code names, in Spark expressions."""

    def entry(p):
        table = F.from_json(F.lit(json.dumps([[int(x) for x in e] for e in books[p]])), "array<array<bigint>>")
        return F.get(table, F.conv(F.hex(F.substring(code_col, p + 1, 1)), 16, 10).cast("int"))

    return codes.withColumn("approx", F.flatten(F.array(*[entry(p) for p in range(len(books))])))


def fingerprint(books: list[np.ndarray]) -> str:
    """Hex digest of all entries' components as decimal numbers, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.flat).encode()).hexdigest()


def compress(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each vector that is kept. Left out: null and empty vectors,
    and those with null, NaN or infinite components. Rows without an id, and repeated rows, are vectors like others; shorter
    vectors count as ending in zeros; null labels are one label. An empty table gives no rows."""
    spark = embeddings.sparkSession
    kept = written(quantized(embeddings, id_col, vec_col, label_col), "vectors")
    books = codebooks(kept)
    if not books[0].size:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = written(encode(kept.select("vec_id", "label", "v"), books).drop("v"), "codes")
    discard(kept)
    by = checked(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    joined = coded.join(by, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


COMPRESS_SQL = """
with v as materialized (select row_number() over () as row_id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = len(embedding)),
w as (select (max(len(v)) // 16)::bigint as width from v),
p as materialized (select row_id, vec_id, i as part, v[i * width + 1 : i * width + width] as x from v, w, range(16) t(i)),
b0 as materialized (select part, e, x as c from (select part, x, row_number() over (partition by part order by vec_id nulls last, row_id) - 1 as e from p) where e < 64),
a0 as materialized (select row_id, part, any_value(x) as x, min((list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c))::bigint * 64 + e) as best from p join b0 using (part) group by row_id, part),
s0 as (select part, best % 64 as e, count(*) as n, d, sum(x[d])::bigint as s from a0, w, range(1, width + 1) r(d) group by part, best % 64, d),
b1 as materialized (select b0.part, b0.e, coalesce(m.c, b0.c) as c from b0 left join (select part, e, list(((s - ((s % n) + n) % n) // n)::double order by d) as c from s0 group by part, e) m on m.part = b0.part and m.e = b0.e),
a1 as materialized (select row_id, part, any_value(x) as x, min((list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c))::bigint * 64 + e) as best from p join b1 using (part) group by row_id, part),
s1 as (select part, best % 64 as e, count(*) as n, d, sum(x[d])::bigint as s from a1, w, range(1, width + 1) r(d) group by part, best % 64, d),
b2 as materialized (select b1.part, b1.e, coalesce(m.c, b1.c) as c from b1 left join (select part, e, list(((s - ((s % n) + n) % n) // n)::double order by d) as c from s1 group by part, e) m on m.part = b1.part and m.e = b1.e),
a2 as (select row_id, part, min((list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c))::bigint * 64 + e) as best from p join b2 using (part) group by row_id, part),
r as (select row_id, string_agg(lpad(lower(to_hex(best % 64)), 2, '0'), '' order by part) as code, sum(best // 64)::bigint as error from a2 group by row_id),
h as (select sha256(string_agg(x::bigint::varchar, ',' order by part, e, d)) as digest from (select part, e, unnest(c) as x, unnest(range(len(c))) as d from b2))
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, digest as codebooks_sha256 from r join v using (row_id), h"""
