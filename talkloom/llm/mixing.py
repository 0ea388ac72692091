"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. Spark expressions only.

Documents of a source stand in the order of a hash; running sums of their words cut that order into blocks of about BLOCK words.
A source's target gives whole passes over its blocks and a rest; the rest takes blocks in order up to the edge block, and of that
one the documents that still fit (looking a few blocks on). That makes an exact quota of block draws for each source, and draws hold about equally many
words. The tree halves the output shards level by level; a node's quotas are split by exact hypergeometric draws, one source
after the other, seeded by node and source. At the leaves each source's draws are cut into disjoint runs of its permuted blocks.
In a shard, documents stand in the order of another hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm.common import discard, n_words, written

WEIGHTS = (3, 1, 2)
#: Words of a block (fewer in small sources, which have 16 blocks); documents of a bin, in which running sums begin; blocks that the last documents are looked for in.
SHARE, MOST, BLOCK, BIN, REACH, SEED = 1.5, 2, 4096, 64, 8, 17
#: Draws of a shard (about a million words), at which the tree stops splitting; at least 2**4 shards.
SHARD_DRAWS = 256
#: Words of the mix in one of its partitions, about 12 MB; more only where that would make over MOST_PARTITIONS of them.
PARTITION_WORDS, MOST_PARTITIONS = 2_000_000, 100_000
#: Rows up to which a table of sources, or a plan, is broadcast.
BROADCAST_ROWS = 1_000_000
_SPAN, _TREE_HEAD, _RUN = 1024, 6, 128

#: Targets in DuckDB's SQL: sources in the order in which they reach their most; the first k of them do, and the others share the rest.
TARGETS_SQL = r"""with d as (select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as size from documents),
 s as (select source, sum(size)::bigint as source_size from d group by source),
 w as (select *, [3.0::double, 1.0::double, 2.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, 2.0::double * source_size as top from s),
 o as (select *, row_number() over (order by top / weight, source nulls last) as k from w),
 f as (select k, top, weight, (1.5::double * sum(source_size::double) over () - coalesce(sum(top) over (order by k rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by k rows between current row and unbounded following) as factor from o),
 c as (select coalesce((select factor from f where factor * weight <= top order by k limit 1), 'infinity'::double) as factor)
 select doc_id, size::bigint as size, source_size, least(top, factor * weight) as target from d join o on d.source is not distinct from o.source cross join c"""


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= rows else df


def numbered(sources: DataFrame) -> DataFrame:
    """sources with index: 1, 2, ... by code point, null last. Ranges of sources are counted, then numbered each for itself."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(sources.repartitionByRange(n, F.asc_nulls_last("source")).withColumn("range", F.spark_partition_id()), "ranges")
    sizes, before, ahead = dealt.groupBy("range").count().collect(), 0, {}  # a row for each partition
    for r in sorted(sizes):
        ahead[r["range"]], before = before, before + r["count"]
    offset = F.lit(0) if not ahead else F.element_at(F.create_map(*[F.lit(x) for kv in ahead.items() for x in kv]), F.col("range"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.asc_nulls_last("source")))
    return dealt.withColumn("index", (offset + inside).cast("int")).drop("range")


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST, weights=WEIGHTS) -> DataFrame:
    """sources (source, source_size, n) -> with index, weight and target: a common factor times the weight, at most most times the
    size. What is above that is shared out again among the others, until none is above: one sum over the sources each time."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = written(numbered(sources).withColumn("weight", F.get(w, F.pmod(F.col("index") - 1, F.lit(len(weights))))), "weighed")
    top = F.lit(float(most)) * F.col("source_size")
    total, factor, full = float(s.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:
        above = F.lit(factor) * F.col("weight") > top if full >= 0 else F.lit(False)
        r = s.agg(F.count_if(above), F.sum(F.when(above, top)), F.sum(F.when(~above, F.col("weight")))).first()
        if r[0] == full or not r[2]:
            break
        full, factor = r[0], (share * total - (r[1] or 0.0)) / r[2]
    return s.withColumn("target", F.least(top, F.lit(factor) * F.col("weight")))


# One hypergeometric draw: of N draws left, K are the source's, n go to the left half; u is uniform. The probabilities follow
# from their ratios, from ten deviations below the mean (or the least possible) on.
_DRAW = """aggregate(array(named_struct('tot', {N}, 'K', {K}, 'n', {n}, 'u', {u})), cast(0 as bigint), (z, h) ->
  aggregate(array(named_struct(
      'lo', greatest(cast(0 as bigint), h.n - (h.tot - h.K), cast(floor(h.n * h.K / greatest(h.tot, 1) - 10 * sqrt(cast(h.n as double) * h.K / greatest(h.tot, 1) * (h.tot - h.K) / greatest(h.tot, 1) * (h.tot - h.n) / greatest(h.tot - 1, 1)) - 2) as bigint)),
      'hi', least(h.K, h.n, cast(ceil(h.n * h.K / greatest(h.tot, 1) + 10 * sqrt(cast(h.n as double) * h.K / greatest(h.tot, 1) * (h.tot - h.K) / greatest(h.tot, 1) * (h.tot - h.n) / greatest(h.tot - 1, 1)) + 2) as bigint)))), cast(0 as bigint), (y, r) ->
    aggregate(sequence(r.lo, r.hi), named_struct('w', 1.0D, 'cum', 0.0D, 'pick', r.hi, 'at', h.u * aggregate(sequence(r.lo, r.hi), named_struct('w', 1.0D, 'cum', 0.0D),
        (a, k) -> named_struct('w', a.w * (h.K - k) * (h.n - k) / greatest(cast(1 as double), (k + 1.0D) * (h.tot - h.K - h.n + k + 1)), 'cum', a.cum + a.w), a -> a.cum)),
      (a, k) -> named_struct('w', a.w * (h.K - k) * (h.n - k) / greatest(cast(1 as double), (k + 1.0D) * (h.tot - h.K - h.n + k + 1)), 'cum', a.cum + a.w, 'pick', if(a.cum < a.at and a.cum + a.w >= a.at, k, a.pick), 'at', a.at), a -> a.pick)))"""


def split(quotas: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """quotas (index, quota) -> (shard, index, quota): 2**depth shards of nearly equal draws, quotas kept exactly. Nodes carry the
    sources that they have draws of, so that a leaf's row is no longer than a shard; below the first levels nodes are dealt out."""
    nodes = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("index", "quota"))).alias("q")).select(F.lit(0).cast("long").alias("node"), "q")
    draw = _DRAW.format(N="b.tot", K="s.quota", n="b.n", u=f"(pmod(xxhash64({seed}, level, node, s.index), 1048576) + 0.5D) / 1048576")
    for level in range(depth):
        if level == _TREE_HEAD:
            nodes = nodes.repartition("node")
        nodes = nodes.withColumn("level", F.lit(level)).withColumn("N", F.expr("aggregate(q, cast(0 as bigint), (a, x) -> a + x.quota)"))
        # sources come in runs, so that what has been drawn is copied once a run and not once a source
        run = f"""aggregate(r, named_struct('tot', a.tot, 'n', a.n, 'out', cast(array() as array<bigint>)), (b, s) ->
            aggregate(array({draw}), b, (e, x) -> named_struct('tot', e.tot - s.quota, 'n', e.n - x, 'out', concat(e.out, array(x)))))"""
        left = f"""flatten(aggregate(transform(sequence(0, (size(q) - 1) div {_RUN}), i -> slice(q, cast(i * {_RUN} + 1 as int), {_RUN})), named_struct('tot', N, 'n', N div 2, 'out', cast(array() as array<array<bigint>>)), (a, r) ->
            aggregate(array({run}), a, (g, h) -> named_struct('tot', h.tot, 'n', h.n, 'out', concat(g.out, array(h.out))))).out)"""
        nodes = nodes.withColumn("left", F.expr(left))
        nodes = nodes.selectExpr("inline(array(named_struct('node', 2 * node, 'q', filter(transform(q, (x, i) -> named_struct('index', x.index, 'quota', left[i])), x -> x.quota > 0)), named_struct('node', 2 * node + 1, 'q', filter(transform(q, (x, i) -> named_struct('index', x.index, 'quota', x.quota - left[i])), x -> x.quota > 0))))").where("size(q) > 0")
    return nodes.selectExpr("node as shard", "inline(q)")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) for every row: size in words, the source's size and target, the words
    the mix takes of the row (whole copies), and the shard of each copy.

    Null texts have size 0; a null source is a source of its own, the last. Ids may be null or repeat: rows count each. An
    empty table gives an empty result. Other columns aren't read. The same table gives the same result.
    """
    return _plan(docs.withColumn("__row", F.monotonically_increasing_id()), id_col, text_col, source_col, share, most).drop("row", "key")


def _keys(d: DataFrame) -> DataFrame:
    """d (row, same, ...) with key: a hash of same, which equal rows share, and of a row's rank among them. Rows are ranked within
    the partition that row tells, and partitions of a repeated hash are put one after the other."""
    d = d.withColumn("part", F.shiftright("row", 33)).withColumn("rank", F.row_number().over(Window.partitionBy("same", "part").orderBy("row")))
    before = F.sum("n").over(Window.partitionBy("same").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = d.groupBy("same", "part").agg(F.count("*").alias("n")).withColumn("ahead", before).where("ahead > 0").drop("n")
    d = d.join(checked(written(ahead, "ahead")), ["same", "part"], "left")
    return d.withColumn("key", F.xxhash64("same", F.col("rank") + F.coalesce("ahead", F.lit(0)))).drop("same", "part", "rank", "ahead")


def _plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, most: int = MOST) -> DataFrame:
    """plan() of docs with __row, a number of each row from monotonically_increasing_id(); with row, that number, and key."""
    own = [F.col(f"`{c}`") for c in (id_col, text_col, source_col)]
    same = F.xxhash64(*[x for c in own for x in (c, c.isNull())])
    d = docs.select(own[0].alias("doc_id"), own[2].alias("source"), n_words(own[1]).alias("size"), F.col("__row").alias("row"), same.alias("same"))
    sizes = written(d, "sizes")
    d = keys = written(_keys(sizes), "keys")
    s = targets(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), share, most)
    s = s.withColumns({"bins": F.ceil(F.col("n") / BIN), "width": F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.ceil(F.col("source_size") / 16))), "passes": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")})
    s = s.withColumn("rest", F.floor(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    s = s.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("width"))))
    s = written(s.withColumn("edge", F.when(F.col("rest") > 0, F.floor(F.col("rest") / F.col("width")))), "sources")
    kept = s.select("source", "index", "source_size", "target", "bins", "width", "blocks", "passes", "rest", "edge").withColumnRenamed("source", "of")
    d = d.join(checked(kept), d["source"].eqNullSafe(kept["of"])).drop("source", "of")
    d = d.withColumn("at", F.xxhash64("key", F.lit(SEED))).withColumn("bin", F.pmod("at", F.col("bins")))

    # words ahead of each document in its source's order: within bins, then over bins and spans of bins
    b = d.groupBy("index", "bin").agg(F.sum("size").alias("size")).withColumn("span", F.floor(F.col("bin") / _SPAN))
    before = Window.partitionBy("index", "span").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    spans = b.groupBy("index", "span").agg(F.sum("size").alias("of"))
    spans = spans.withColumn("ahead", F.coalesce(F.sum("of").over(Window.partitionBy("index").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("of")
    b = b.withColumn("own", F.coalesce(F.sum("size").over(before), F.lit(0))).join(spans, ["index", "span"]).select("index", "bin", (F.col("ahead") + F.col("own")).alias("ahead"))
    b = written(b, "bins")
    inside = Window.partitionBy("index", "bin").orderBy("at", "row").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(checked(b), ["index", "bin"]).withColumn("start", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = written(d.withColumn("block", F.least(F.floor(F.col("start") / F.col("width")), F.col("blocks") - 1)).drop("ahead", "at", "bin", "bins"), "ordered")
    # documents that end before the edge block have their copy; of those in it and a few blocks on, those that fit, in order
    sure = F.col("start") + F.col("size") <= F.col("edge") * F.col("width")
    brim = d.where("edge is not null and size > 0").where(~sure & (F.col("start") < (F.col("edge") + REACH) * F.col("width")))
    brim = brim.groupBy("index").agg((F.first("rest") - F.min("start")).alias("left"), F.sort_array(F.collect_list(F.struct("block", F.xxhash64("key", F.lit(SEED + 1)).alias("key"), "row", "size"))).alias("rows"))
    picked = brim.selectExpr(
        "index",
        """inline(aggregate(rows, named_struct('left', left, 'got', cast(array() as array<struct<row: bigint, block: bigint>>)), (a, x) ->
             if(x.size <= a.left, named_struct('left', a.left - x.size, 'got', concat(a.got, array(named_struct('row', x.row, 'block', x.block)))), a)).got)""",
    )
    picked = written(picked, "picked")

    last = s.join(picked.groupBy("index").agg(F.max("block").alias("last")), "index", "left").withColumn("last", F.greatest(F.col("edge") - 1, "last"))
    quotas = last.select("index", "blocks", (F.col("passes") * F.col("blocks") + F.coalesce(F.col("last") + 1, F.lit(0))).alias("quota"))
    draws = quotas.agg(F.sum("quota")).first()[0] or 0
    depth = max(4, (-(-draws // SHARD_DRAWS) - 1).bit_length()) if draws else 0
    runs = split(quotas.where("quota > 0").select("index", "quota"), depth).withColumn("end", F.sum("quota").over(Window.partitionBy("index").orderBy("shard")))
    units = runs.join(checked(quotas.select("index", "blocks")), "index").selectExpr("index", "shard", "blocks", "explode(sequence(end - quota, end - 1)) as draw")
    units = units.groupBy("index", F.expr("draw % blocks").alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("draw", "shard"))), lambda x: x["shard"]).alias("shards"))

    out = d.join(checked(picked.select("row", F.lit(1).alias("picked"))), "row", "left").join(units, ["index", "block"], "left")
    copies = (F.col("passes") + F.when(sure & (F.col("size") > 0), 1).otherwise(F.coalesce("picked", F.lit(0)))).cast("int")
    out = written(out.select("row", "key", "doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), F.coalesce(F.slice("shards", 1, F.greatest(copies, F.lit(0))), F.array().cast("array<long>")).alias("shards")), "plan")
    for t in (b, d, s, sizes, keys, picked):
        discard(t)
    return out


def mixture(docs: DataFrame, id_col: str = "doc_id", **kinds) -> DataFrame:
    """docs as mixed: each row as often as the plan takes that row, shard by shard, shuffled within; the columns of docs. Shards are
    of about equal words and go to partitions in order, so that partitions are about equal too."""
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    p = _plan(rows, id_col, **kinds)
    words, shards = p.agg(F.sum("taken"), F.max(F.array_max("shards"))).first()
    words, shards = words or 0, (shards or 0) + 1
    n = max(1, -(-words // max(PARTITION_WORDS, words // MOST_PARTITIONS)))
    p = p.where("size(shards) > 0").select(F.col("row").alias("__row"), F.col("key").alias("__key"), F.col("shards").alias("__shards"))
    out = rows.join(checked(p), "__row").withColumn("__shard", F.explode("__shards"))
    out = out.repartitionById(n, F.floor(F.col("__shard") * n / shards).cast("int"))
    return out.sortWithinPartitions("__shard", F.xxhash64("__key", "__shard", F.lit(SEED))).select(*docs.columns)
