"""URL filter: longest-match rules, else gradient-boosted trees on lexical features. DataFrame and SQL expressions only.

Trees are fitted to at most SAMPLE labelled URLs (those of smallest hash) by histogram boosting: each level of a tree is one
aggregation of gradients by node, feature and bin; the driver sees those sums alone, and takes the leaves from the last of them.
Scoring is one nested CASE per tree. A fifth of the sample isn't fitted to: on it the cut between allow and block is chosen where
recall and false positives differ most, if they differ by more than chance allows; else it is at even odds. The suffix rate that
a labelled URL is fitted or judged with comes from the labels of other folds than its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import discard, written
from talkloom.llm.mixing import checked

SAMPLE, ROUNDS, DEPTH, BINS, RATE, RIDGE, FOLDS = 20_000, 8, 2, 8, 0.3, 1.0, 5
#: Standard errors by which recall must exceed false positives for the cut to be moved.
CLEAR = 3.0
FEATURES = ("length", "depth", "digits", "entropy", "params", "hyphens", "labels", "suffix_pages", "suffix_rate")
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: ruled() in DuckDB's SQL.
RULES_SQL = """with p as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
 h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as own from p),
 x as (select page_id, translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(own) + 1), '^[^?#]*') as path from h),
 r(verdict, rule, h, p) as (values ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/'))
 select page_id, host, path, (select arg_max(rule, length(rule)) from r where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) as rule,
        (select arg_max(verdict, length(rule)) from r where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) as verdict from x"""


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UP, _LOW), F.lit("")), F.coalesce(path, F.lit(""))


def match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: -len(x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, r) if rule is None else rule.when(fits, r)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"),) * 2


def ruled(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row, by the rules alone: where none fits, rule and verdict are null."""
    host, path = parts(F.col("url"))
    p = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    return p.select("*", rule.alias("rule"), verdict.alias("verdict"))


def features(pages: DataFrame) -> DataFrame:
    """Adds the lexical features of url (null: an empty one) and the suffix: the last two labels of the host."""
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(u, ""))
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return pages.select(
        "*",
        F.length(u).cast("double").alias("length"),
        (F.regexp_count("path", F.lit("/"))).cast("double").alias("depth"),
        (F.regexp_count(u, F.lit("[0-9]")) / n).alias("digits"),
        F.round(entropy, 6).alias("entropy"),
        F.regexp_count(u, F.lit("[?&][^=&]*=")).cast("double").alias("params"),
        F.regexp_count("host", F.lit("-")).cast("double").alias("hyphens"),
        (F.regexp_count("host", F.lit("[.]")) + 1).cast("double").alias("labels"),
        F.regexp_extract("host", r"[^.]*[.]?[^.]*$", 0).alias("suffix"),
    )


def fit(sample: DataFrame, rounds: int = ROUNDS) -> tuple[float, list[dict]]:
    """sample: FEATURES and label (0/1) -> the base score and the trees. A tree maps a node (1 the root, 2i and 2i+1 its
    children) to (feature, threshold) or to a leaf's value."""
    n, ones = sample.agg(F.count("*"), F.sum("label")).first()
    if not n or not ones or ones == n:
        return (4.0 if n and ones == n else -4.0), []
    base = math.log(ones / (n - ones))
    cuts = sample.agg(*[F.percentile_approx(f, [(i + 1) / (BINS + 1) for i in range(BINS)], 10_000).alias(f) for f in FEATURES]).first()
    trees: list[dict] = []
    binned = written(sample.select(*FEATURES, "label", F.array(*[_below(f, cuts[f]) for f in FEATURES]).alias("bins")), "bins")
    for _ in range(rounds):
        tree: dict = {1: None}
        p = 1 / (1 + F.exp(-score(base, trees)))
        rows = binned.select(*FEATURES, "bins", (F.col("label") - p).alias("g"), (p * (1 - p)).alias("h"))
        for level in range(DEPTH):
            cells = rows.select(_node(tree, level).alias("node"), "g", "h", F.posexplode("bins").alias("f", "bin"))
            sums = cells.groupBy("node", "f", "bin").agg(F.round(F.sum("g"), 6).alias("g"), F.round(F.sum("h"), 6).alias("h")).collect()
            for k in [k for k, x in tree.items() if x is None]:
                own = [r for r in sums if r["node"] == k]
                g, h = (sum(r[c] for r in own if r["f"] == 0) for c in "gh")
                best = (1e-6, None, None)
                for i, f in enumerate(FEATURES):
                    gl = hl = 0.0
                    for b in range(BINS):
                        gl += sum(r["g"] for r in own if r["f"] == i and r["bin"] == b)
                        hl += sum(r["h"] for r in own if r["f"] == i and r["bin"] == b)
                        gained = gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE)
                        if gained > best[0] + 1e-9:
                            best = (gained, (f, float(cuts[f][b])), ((gl, hl), (g - gl, h - hl)))
                tree[k] = best[1] or RATE * g / (h + RIDGE)
                for child, (x, y) in zip((2 * k, 2 * k + 1), best[2] or (), strict=False):
                    tree[child] = None if level < DEPTH - 1 else RATE * x / (y + RIDGE)
        trees.append(tree)
    discard(binned)
    return base, trees


def cut(held: DataFrame) -> float:
    """held: score and label of URLs that weren't fitted to -> the score above which a URL is blocked."""
    rows = held.groupBy(F.round("score", 2).alias("score")).agg(F.sum("label").alias("ones"), F.count("*").alias("n")).orderBy(F.desc("score")).collect()
    ones = sum(r["ones"] for r in rows)
    zeros = sum(r["n"] for r in rows) - ones
    best, at, hit, false = 0.0, 0.0, 0.0, 0.0
    for r, following in zip(rows, rows[1:]) if ones and zeros else ():
        hit, false = hit + r["ones"], false + r["n"] - r["ones"]
        x, y = hit / ones, false / zeros
        error = math.sqrt((x * (1 - x) + 0.25 / ones) / ones + (y * (1 - y) + 0.25 / zeros) / zeros)
        if x - y > best and x - y > CLEAR * error:
            best, at = x - y, (r["score"] + following["score"]) / 2
    return float(at)


def _below(feature: str, cuts: list[float]) -> Column:
    """The bin of a feature: how many cuts are below it."""
    return sum((F.when(F.col(feature) > c, 1).otherwise(0) for c in cuts), F.lit(0))


def _node(tree: dict, level: int) -> Column:
    """The node of a row after that many levels."""

    def at(k: int, depth: int) -> Column:
        if depth == level or not isinstance(tree.get(k), tuple):
            return F.lit(k)
        f, c = tree[k]
        return F.when(F.col(f) <= c, at(2 * k, depth + 1)).otherwise(at(2 * k + 1, depth + 1))

    return at(1, 0)


def score(base: float, trees: list[dict]) -> Column:
    """Log odds of block."""

    def value(tree: dict, k: int) -> Column:
        x = tree.get(k, 0.0)
        return F.when(F.col(x[0]) <= x[1], value(tree, 2 * k)).otherwise(value(tree, 2 * k + 1)) if isinstance(x, tuple) else F.lit(float(x))

    out = F.lit(float(base))
    for t in trees:
        out = out + value(t, 1)
    return out


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row. labels (id, label): labelled ids; label 1 is to be blocked.

    suffix_pages is the number of pages of a URL's suffix, suffix_rate the shrunk rate of block among all its labelled ones (of
    other folds). Null URLs have empty parts and are scored as empty. Repeated rows each have a row; of a repeated label the
    largest holds. Without labels of both kinds the trees are empty and the base decides (no labels: allow). An empty table gives
    none.
    """
    p = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    host, path = parts(F.col("url"))
    p = features(p.withColumns({"host": host, "path": path}))
    known = labels.groupBy(F.col("id").alias("page_id")).agg(F.max("label").cast("double").alias("label"))
    known = written(known.withColumn("fold", F.pmod(F.xxhash64("page_id"), F.lit(FOLDS))), "labels")
    fold = F.col("fold").eqNullSafe(F.col("of"))
    # suffix statistics cover all pages and all labels; only the trees are fitted to a sample
    s = p.select("page_id", "suffix").join(checked(known), "page_id", "left").groupBy("suffix", "fold")
    s = written(s.agg(F.count("*").cast("double").alias("pages"), F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones")), "suffixes")
    overall = s.agg(F.coalesce(F.sum("ones") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0))).first()[0]
    whole = s.groupBy("suffix").agg(F.sum("pages").alias("suffix_pages"), F.sum("n").alias("all_n"), F.sum("ones").alias("all_ones"))
    rates = whole.join(s.where("fold is not null").select("suffix", F.col("fold").alias("of"), "n", "ones"), "suffix").unionByName(whole.withColumns({"of": F.lit(None).cast("long"), "n": F.lit(0).cast("long"), "ones": F.lit(0.0)}))
    rate = (F.col("all_ones") - F.col("ones") + 10 * overall) / (F.col("all_n") - F.col("n") + 10)
    rates = written(rates.select(F.col("suffix").alias("of_suffix"), "of", "suffix_pages", F.round(rate, 6).alias("suffix_rate")), "rates")
    rated = lambda t: t.join(checked(rates), (t["suffix"] == rates["of_suffix"]) & fold)
    sample = written(p.join(checked(known), "page_id").orderBy(F.xxhash64("page_id"), "url").limit(SAMPLE), "sample")
    fitted = written(rated(sample).select(*FEATURES, "label", "fold"), "fitted")
    base, trees = fit(fitted.where("fold <> 0"))
    at = cut(fitted.where("fold = 0").select(score(base, trees).alias("score"), "label"))
    scored = rated(p.join(checked(known), "page_id", "left")).select("page_id", "host", "path", *FEATURES)
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    method = F.when(score(base, trees) > at, "block").otherwise("allow")
    discard(sample), discard(fitted), discard(s)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.round(score(base, trees), 6).alias("score"))
