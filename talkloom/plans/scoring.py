"""Scores of transcripts against one another, over columns: a pivot's words (c) and what other readings (a0, a1, b) have there."""

from __future__ import annotations

import difflib
import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions import digests, forms
from talkloom.functions import text as X
from talkloom.operators import alignment, bulk
from talkloom.plans import views as V
from talkloom.plans.catalog import W, query

# fixed values: words that look technical or foreign
TECHNICAL = "^[a-z]*(sh|ck|w|x|q|oo|ee|ea)[a-z]*$"
#: Milliseconds that a pair's times may differ by, for each reading; the window of an alignment and what it reaches into others.
SKEW = {"a0": 4000, "a1": 4000, "b": 8000}
WINDOW_MS, LEAST_RATIO = alignment.WINDOW_MS, 0.45
BLOCK_MS, DRAWS, ALARM = 60_000, 5000, 50


_ratio = functools.lru_cache(50_000)(X.ratio)


def pairs_of(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Positions that opcodes pair: equal words, replacements of equal length by place, others each with its most similar free word."""
    out = []
    for op, i0, i1, j0, j1 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if i1 - i0 == j1 - j0:
            out += zip(range(i0, i1), range(j0, j1), strict=True)
        elif op == "replace":
            free = list(range(j0, j1))
            for i in range(i0, i1):
                best = max(free, key=lambda j: (_ratio(x[i], y[j]), -j), default=None)
                if best is not None and _ratio(x[i], y[best]) > LEAST_RATIO:
                    out.append((i, best))
                    free.remove(best)
    return out


def build(pivot: DataFrame, others: DataFrame, skew: dict[str, int] | None = None) -> DataFrame:
    """pivot (media_id, i, w, t), others (media_id, stream, i, w, t) -> a row for each pivot word: media_id, i, t, c and a column for
    each stream of skew. Alignment runs in windows of 60 s with 10 s on either side; a window decides about its own words."""
    skew = skew or SKEW

    def run(batch):
        ends, x = bulk.unlisted(batch.column("x"))
        read = {s: bulk.unlisted(batch.column(s)) for s in skew}
        media, out = batch.column("media_id").to_pylist(), [[] for _ in range(4 + len(skew))]
        for n, win in enumerate(batch.column("win").to_pylist()):
            a, b = ends[n], ends[n + 1]
            found = []
            for s, most in skew.items():
                at, y = read[s]
                p, q = at[n], at[n + 1]
                found.append({i: y["w"][p + j] for i, j in pairs_of(x["w"][a:b], y["w"][p:q]) if abs(x["t"][a + i] - y["t"][p + j]) <= most})
            for i in range(b - a):
                if x["t"][a + i] // WINDOW_MS == win:
                    for o, v in zip(out, (media[n], x["i"][a + i], x["t"][a + i], x["w"][a + i], *[f.get(i) for f in found]), strict=True):
                        o.append(v)
        return out

    a = bulk.dealt(alignment.windows(pivot), "media_id", "win").groupBy("media_id", "win").agg(bulk.listed(["t", "i"], ["w"]).alias("x"))
    b = bulk.dealt(alignment.windows(others), "media_id", "win").groupBy("media_id", "win").agg(*[F.sort_array(F.collect_list(F.when(F.col("stream") == s, F.struct("t", "i", "w")))).alias(s) for s in skew])
    return bulk.mapped(a.join(b, ["media_id", "win"], "left"), run, "media_id long, i long, t long, c string, " + ", ".join(f"{s} string" for s in skew))


def streams(spark, d) -> tuple[DataFrame, DataFrame]:
    """The pivot's words and three other readings of them with clocks of their own."""
    late = {"a0": 150, "a1": 150, "b": 3000}
    pivot, x = (V.columns(spark, d).withColumn("i", F.row_number().over(W("media_id", ["turn_idx", "k"])).cast("long")) for _ in range(2))
    others = x.select("media_id", "i", "t", F.explode(F.array(*[F.struct(F.lit(s).alias("stream"), F.col(s).alias("w"), F.lit(ms).alias("late")) for s, ms in late.items()])).alias("x"))
    others = others.where("x.w is not null").select("media_id", "x.stream", "i", "x.w", (F.col("t") + F.col("x.late")).alias("t"))
    return pivot.select("media_id", "i", F.col("c").alias("w"), "t"), others


@query()
def column_build(spark, d):
    """Columns of four readings by windowed opcodes."""
    return build(*streams(spark, d))


_F = ", ".join(f"'{w}'" for w in forms.FUNCTION_WORDS)


def _same(a: str, b: str) -> str:
    """SQL of forms.same() for the test readings, of which none but prefixes of one another are alike but not equal."""
    n, m = f"least(length({a}), length({b}))", f"(length({a}) + length({b}))"
    return f"({a} = {b} or strip_accents({a}) = strip_accents({b}) or ({a} in ({_F}) and {b} in ({_F})) or ({n} >= 5 and (starts_with({a}, {b}) or starts_with({b}, {a})) and 2.0::double * {n} / {m} >= 0.8))"


_SAME = f"with {V.COLUMNS}, s as (select *, {_same('b', 'c')} as bc, {_same('a0', 'c')} as a0c, {_same('a1', 'c')} as a1c, {_same('a0', 'b')} as a0b, {_same('a1', 'b')} as a1b, {_same('a0', 'a1')} as a01 from col_v)"


def judged(x: DataFrame) -> DataFrame:
    """Columns with what counts as the same word: bc, a0c, a1c, a0b, a1b, a01; null where a reading has no word."""
    pairs = {"bc": ("b", "c"), "a0c": ("a0", "c"), "a1c": ("a1", "c"), "a0b": ("a0", "b"), "a1b": ("a1", "b"), "a01": ("a0", "a1")}
    return x.withColumns({n: forms.same(F.col(p), F.col(q)) for n, (p, q) in pairs.items()})  # one call each: those not asked for are pruned


def readings(x: DataFrame) -> DataFrame:
    """judged() columns, each combination of words once, with how often it comes (n): Python judges words, not their repeats."""
    return judged(x.groupBy("c", "a0", "a1", "b").agg(F.count("*").alias("n")))


def tally(x: DataFrame, hit) -> F.Column:
    """Aggregate: how many columns hit; of readings(), by their numbers."""
    return F.coalesce(F.sum(F.when(hit, F.col("n") if "n" in x.columns else F.lit(1).cast("long"))), F.lit(0))


def _streams(x: DataFrame, name: str) -> DataFrame:
    s = x.agg(tally(x, F.lit(True)).alias("n"), *[f for k in ("a0", "a1") for f in (tally(x, F.col(k).isNull()).alias(f"{k}_m"), tally(x, ~F.col(f"{k}c")).alias(f"{k}_s"))])
    row = lambda k: F.struct(F.lit(k).alias("stream"), F.col("n").alias(name), F.col(f"{k}_m").alias("missing"), F.col(f"{k}_s").alias("substituted"), F.round((F.col(f"{k}_m") + F.col(f"{k}_s")) / F.greatest(F.col("n"), F.lit(1)), 6).alias("error"))
    return s.select(F.inline(F.array(row("a0"), row("a1"))))


def errors(x: DataFrame) -> DataFrame:
    """(stream, witnesses, missing, substituted, error) of a0 and a1 where b and c agree; x: judged columns or readings. One pass."""
    return _streams(x.where("bc"), "witnesses")


@query(_SAME + " " + " union all ".join(f"select '{k}' as stream, count(*) as witnesses, count(*) filter ({k} is null) as missing, count(*) filter (not {k}c) as substituted, round((count(*) filter ({k} is null) + count(*) filter (not {k}c))::double / greatest(count(*), 1), 6) as error from s where bc" for k in ("a0", "a1")))
def witness_error(spark, d):
    return errors(readings(V.columns(spark, d)))


def control(x: DataFrame) -> DataFrame:
    """errors() against c over all columns, whatever b says: a change is real only if this falls as well."""
    return _streams(x, "columns")


@query(_SAME + " " + " union all ".join(f"select '{k}' as stream, count(*) as columns, count(*) filter ({k} is null) as missing, count(*) filter (not {k}c) as substituted, round((count(*) filter ({k} is null) + count(*) filter (not {k}c))::double / greatest(count(*), 1), 6) as error from s" for k in ("a0", "a1")))
def control_error(spark, d):
    return control(readings(V.columns(spark, d)))


@query()
def built_witness_error(spark, d):
    """The error over columns that alignment has built, not over the lattice that it should find."""
    return errors(readings(column_build(spark, d)))



@query(_SAME + " " + " union all ".join(f"select '{j}' as engine, count(*) filter ({w}) as judged, round(count(*) filter ({w} and not coalesce({j} is not null and {hit}, false))::double / greatest(count(*) filter ({w}), 1), 6) as departs from s" for j, w, hit in (("a0", "bc", "a0b"), ("b", "a0c", "a0b"), ("c", "a0b", "a0c"))))
def leave_one_out(spark, d):
    """Each reading where the other two agree, and how often it departs from them: one pass."""
    return departures(readings(V.columns(spark, d)))


def departures(x: DataFrame) -> DataFrame:
    legs = (("a0", "bc", "a0b"), ("b", "a0c", "a0b"), ("c", "a0b", "a0c"))
    s = x.agg(*[tally(x, F.col(w)).alias(f"n_{j}") for j, w, _ in legs], *[tally(x, F.col(w) & ~F.coalesce(F.col(hit), F.lit(False))).alias(f"d_{j}") for j, w, hit in legs])
    return s.select(F.inline(F.array(*[F.struct(F.lit(j).alias("engine"), F.col(f"n_{j}").alias("judged"), F.round(F.col(f"d_{j}") / F.greatest(F.col(f"n_{j}"), F.lit(1)), 6).alias("departs")) for j, _, _ in legs])))


@query(_SAME + f", g as (select b as bad, c as good, count(*) as n, (sum(count(*)) over ())::bigint as total from s where a1c and not bc group by b, c) select *, total < {ALARM} as alarm from g order by n desc, bad, good limit 8")
def known_bad_pairs(spark, d):
    """Words that two readings agree on and the third has wrong: the eight most frequent, how many there are, and whether there are
    so few that the alignment must be broken."""
    return bad_pairs(readings(V.columns(spark, d)))


def bad_pairs(x: DataFrame) -> DataFrame:
    g = x.where("a1c and not bc").groupBy(F.col("b").alias("bad"), F.col("c").alias("good")).agg(tally(x, F.lit(True)).alias("n"))
    top = g.orderBy(F.desc("n"), "bad", "good").limit(8)
    return top.crossJoin(F.broadcast(g.agg(F.sum("n").alias("total")))).withColumn("alarm", F.col("total") < ALARM)


_BUCKET = "case when a1b then case when bc then 'imported_good' when a0c then 'imported_bad' else 'imported_unwitnessed' end else 'independent_change' end"


@query(_SAME + f" select {_BUCKET} as bucket, count(*) as n from s where not a01 group by 1")
def merge_buckets(spark, d):
    """What a correction changed: taken from the other transcript, rightly, wrongly or without a witness, or made up."""
    return buckets(readings(V.columns(spark, d)))


def buckets(x: DataFrame) -> DataFrame:
    return x.where("not a01").groupBy(F.expr(_BUCKET).alias("bucket")).agg(tally(x, F.lit(True)).alias("n"))


@query(_SAME + f""", e as (select *, row_number() over (partition by a1, c order by t, media_id, turn_idx, k) as nth from s where bc and not a1c),
 g as (select regexp_matches(a1, '{TECHNICAL}') or regexp_matches(c, '{TECHNICAL}') as technical, a1 as mine, c as ref, count(*) as n, list_sort(list(t) filter (nth <= 3)) as times from e group by all)
 select technical, mine, ref, n, times, row_number() over (partition by technical order by n desc, mine, ref)::integer as rank from g qualify row_number() over (partition by technical order by n desc, mine, ref) <= 12""")
def ranked_errors_topk(spark, d):
    """The most frequent errors where two others agree, technical and other ones apart, with their first three times: of each of
    64 parts of a pair's times first, so that no task holds a frequent pair's."""
    e = judged(V.columns(spark, d)).where("bc and not a1c").select(F.col("a1").alias("mine"), F.col("c").alias("ref"), "t", "media_id", "turn_idx", "k")
    g = e.groupBy("mine", "ref").agg(F.count("*").alias("n")).withColumn("technical", F.col("mine").rlike(TECHNICAL) | F.col("ref").rlike(TECHNICAL))
    top = g.withColumn("rank", F.row_number().over(W("technical", [F.desc("n"), "mine", "ref"]))).where("rank <= 12")
    nth = lambda *by: F.row_number().over(Window.partitionBy("mine", "ref", *by).orderBy("t", "media_id", "turn_idx", "k"))
    first = e.join(F.broadcast(top.select("mine", "ref")), ["mine", "ref"]).withColumn("part", F.pmod(F.hash("media_id", "turn_idx"), F.lit(64)))
    first = first.withColumn("nth", nth("part")).where("nth <= 3").withColumn("nth", nth()).where("nth <= 3").groupBy("mine", "ref").agg(F.sort_array(F.collect_list("t")).alias("times"))
    return top.join(first, ["mine", "ref"]).select("technical", "mine", "ref", "n", "times", "rank")


@query(_SAME + f", v as (select distinct a1 from s where a1 is not null) select c as term, count(*) as n from s where bc and (regexp_matches(c, '{TECHNICAL}') or length(c) > 6) and c not in (select a1 from v) group by c")
def glossary_candidates(spark, d):
    """Words that two readings agree on and ours never has."""
    r = readings(V.columns(spark, d))
    x = r.where("bc").where(F.col("c").rlike(TECHNICAL) | (F.length("c") > 6)).groupBy("c").agg(tally(r, F.lit(True)).alias("n"))
    have = V.columns(spark, d).where("a1 is not null").select(F.col("a1").alias("c")).distinct()
    return x.join(have, "c", "left_anti").withColumnRenamed("c", "term")


def blocks(flags: DataFrame) -> DataFrame:
    """flags (media_id, t, fa, fb): whether two arms are wrong at each witness column -> sums of 60 s blocks: errors of either arm,
    columns, and those that one arm alone has wrong."""
    one = lambda e: F.count_if(F.expr(e))
    return flags.groupBy("media_id", F.floor(F.col("t") / BLOCK_MS).alias("block")).agg(F.sum("fa").cast("long").alias("ea"), F.sum("fb").cast("long").alias("eb"), F.count("*").alias("n"), one("fa = 1 and fb = 0").alias("a_only"), one("fb = 1 and fa = 0").alias("b_only"))


_VERDICT = "case when lo <= 0 and hi >= 0 then 'not resolvable' when hi < 0 then 'better' else 'worse' end"


#: Messages whose MD5 are taken at once.
AT_ONCE = 20_000


@functools.lru_cache(128)
def _slots(k: int, lo: int, hi: int):
    return digests.endings([f"{d}|{s}" for d in range(lo, hi) for s in range(k)])


def drawn(media, e: list[int], n: list[int]) -> tuple[float, float]:
    """Ends of the interval of a recording's blocks, with errors e and columns n."""
    k = len(e)
    if k == 1:  # all draws are the same
        return e[0] / n[0], e[0] / n[0]
    e, n, step, out = np.array(e), np.array(n), max(1, AT_ONCE // k), []
    for lo in range(0, DRAWS, step):
        pick = digests.md5_words([f"{media}|"], _slots(k, lo, min(DRAWS, lo + step)))[0] % np.uint32(k)
        out.append(e[pick].reshape(-1, k).sum(axis=1) / n[pick].reshape(-1, k).sum(axis=1))
    v = np.sort(np.concatenate(out))
    return float(v[int(0.025 * DRAWS)]), float(v[int(0.975 * DRAWS)])


def bootstrap(b: DataFrame) -> DataFrame:
    """blocks() -> for each recording the difference b - a of the arms, the ends of its 95 % interval over DRAWS resamples of its blocks
    with replacement, the columns that one arm alone has wrong, and the verdict. Slot s of draw d takes the block that the MD5 of
    (recording, d, s) names: uniform, and the same everywhere. A recording's blocks are bounded by its length; draws are arrays."""
    g = bulk.dealt(b, "media_id").groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("block", (F.col("eb") - F.col("ea")).alias("e"), "n"))).alias("x"), (F.sum(F.col("eb") - F.col("ea")) / F.sum("n")).alias("point"), F.sum("a_only").alias("a_only"), F.sum("b_only").alias("b_only"))

    def run(batch):
        at, x = bulk.unlisted(batch.column("x"))
        ends = [drawn(m, x["e"][p:q], x["n"][p:q]) for m, p, q in zip(batch.column("media_id").to_pylist(), at, at[1:], strict=False)]
        return [batch.column("media_id"), batch.column("point"), [v[0] for v in ends], [v[1] for v in ends], batch.column("a_only"), batch.column("b_only")]

    out = bulk.mapped(g, run, "media_id long, point double, lo double, hi double, a_only long, b_only long").withColumn("verdict", F.expr(_VERDICT))
    return out.select("media_id", *[F.round(c, 6).alias(c) for c in ("point", "lo", "hi")], "a_only", "b_only", "verdict")


def _poisson() -> list[int]:
    """Upper ends, of 2**32, of the values 0, 1, 2, ... of a Poisson variable of mean 1."""
    p, total, out = math.exp(-1), 0.0, []
    for k in range(13):
        total += p
        out.append(int(total * 2**32))
        p /= k + 1
    return out


_WEIGHT = "case " + " ".join(f"when u < {t} then {k}" for k, t in enumerate(_poisson())) + " else 13 end"


def pooled_bootstrap(b: DataFrame) -> DataFrame:
    """blocks() of all recordings as one comparison: (point, lo, hi, a_only, b_only, blocks, n, verdict). A draw gives each block a
    Poisson weight, read off the MD5 of (recording, block, draw), which is resampling with replacement for many blocks; all draws are
    summed in one pass, with partial sums before the shuffle: DRAWS rows from each task. Draws without a block don't count."""
    upto = np.array([t for t in _poisson() if t < 2**32], np.uint32)

    def run(batches):
        tails, sums = digests.endings([str(g) for g in range(DRAWS // 4)]), None
        for batch in batches:
            media, block, e, n = (batch.column(c).to_pylist() for c in ("media_id", "block", "e", "n"))
            for lo in range(0, len(media), AT_ONCE // (DRAWS // 4)):
                some = slice(lo, lo + AT_ONCE // (DRAWS // 4))
                words = digests.md5_words([f"{m}|{k}|" for m, k in zip(media[some], block[some], strict=True)], tails)
                w = np.stack([np.searchsorted(upto, u, "right").reshape(-1, DRAWS // 4) for u in words], axis=2)  # block, g, word
                got = np.tensordot(np.array([e[some], n[some]], float), w.reshape(len(w), -1).astype(float), 1)
                sums = got if sums is None else sums + got
        if sums is not None:  # whole numbers below 2**53
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(DRAWS)), *[pa.array(x.astype(np.int64)) for x in sums]], ["d", "e", "n"])

    x = bulk.dealt(b.select("media_id", "block", (F.col("eb") - F.col("ea")).alias("e"), "n"), "media_id", "block").mapInArrow(run, "d long, e long, n long")
    x = x.groupBy("d").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).where("n > 0").select((F.col("e") / F.col("n")).alias("delta"))
    v = x.agg(F.sort_array(F.collect_list("delta")).alias("v")).selectExpr("v[cast(floor(0.025 * size(v)) as int)] as lo", "v[cast(floor(0.975 * size(v)) as int)] as hi")
    s = b.agg((F.sum(F.col("eb") - F.col("ea")) / F.sum("n")).alias("point"), F.sum("a_only").alias("a_only"), F.sum("b_only").alias("b_only"), F.count("*").alias("blocks"), F.sum("n").alias("n"))
    return s.crossJoin(F.broadcast(v)).select(*[F.round(c, 6).alias(c) for c in ("point", "lo", "hi")], "a_only", "b_only", "blocks", "n", F.expr(_VERDICT).alias("verdict"))


def arms(spark, d) -> DataFrame:
    """blocks() of the raw and the corrected reading where two others agree."""
    wrong = lambda c: 1 - F.coalesce(F.col(c), F.lit(False)).cast("int")
    return blocks(judged(V.columns(spark, d)).where("bc").select("media_id", "t", wrong("a0c").alias("fa"), wrong("a1c").alias("fb")))


_BLOCKS = _SAME + f""", fl as (select media_id, t, 1 - coalesce(a0c, false)::int as fa, 1 - coalesce(a1c, false)::int as fb from s where bc),
 b as (select media_id, t // {BLOCK_MS} as block, sum(fa)::bigint as ea, sum(fb)::bigint as eb, count(*) as n, count(*) filter (fa = 1 and fb = 0) as a_only, count(*) filter (fb = 1 and fa = 0) as b_only from fl group by all)"""


@query(_BLOCKS + f""", o as (select *, row_number() over (partition by media_id order by block) - 1 as i, count(*) over (partition by media_id) as k from b), m as (select media_id, max(k) as k from o group by 1),
 dr as (select media_id, d, ('0x' || substr(md5(media_id || '|' || d || '|' || s), 1, 8))::bigint % k as i from m, range({DRAWS}) t(d), lateral (select unnest(range(k)) as s)),
 r as (select media_id, d, sum(eb - ea)::double / sum(n)::double as delta from dr join o using (media_id, i) group by all),
 e as (select media_id, list_sort(list(delta))[{int(0.025 * DRAWS) + 1}] as lo, list_sort(list(delta))[{int(0.975 * DRAWS) + 1}] as hi from r group by 1),
 p as (select media_id, sum(eb - ea)::double / sum(n)::double as point, sum(a_only)::bigint as a_only, sum(b_only)::bigint as b_only from b group by 1)
 select media_id, round(point, 6) as point, round(lo, 6) as lo, round(hi, 6) as hi, a_only, b_only, {_VERDICT} as verdict from p join e using (media_id)""")
def paired_block_bootstrap(spark, d):
    """Whether the corrected reading is better than the raw one where two others agree, for each recording."""
    return bootstrap(arms(spark, d))


@query(_BLOCKS + f""", h as (select eb - ea as e, n, g, md5(media_id || '|' || block || '|' || g) as h from b, range({DRAWS // 4}) t(g)),
 x as (select e, n, 4 * g + j as d, ('0x' || substr(h, (8 * j + 1)::int, 8))::bigint as u from h, range(4) t(j)), w as (select *, {_WEIGHT} as w from x),
 r as (select d, sum(w * e)::double / sum(w * n)::double as delta from w where w > 0 group by d), v as (select list_sort(list(delta)) as v from r),
 e as (select v[floor(0.025 * len(v))::int + 1] as lo, v[floor(0.975 * len(v))::int + 1] as hi from v),
 p as (select sum(eb - ea)::double / sum(n)::double as point, sum(a_only)::bigint as a_only, sum(b_only)::bigint as b_only, count(*) as blocks, sum(n)::bigint as n from b)
 select round(point, 6) as point, round(lo, 6) as lo, round(hi, 6) as hi, a_only, b_only, blocks, n, {_VERDICT} as verdict from p, e""")
def pooled_block_bootstrap(spark, d):
    """The same for all recordings together."""
    return pooled_bootstrap(arms(spark, d))
