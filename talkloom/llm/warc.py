"""WARC archives with Merkle trees: fixity audit of replicas, and a reader.

A record is a WARC resource record of a page. Records stand in archives of FILE_IDS ids, in order, at known offsets. A tree's
leaf is a slot, the id's place among its archive's ids, which all replicas share whatever records they lack; it hashes the
SHA-256 of its records, in pieces where there are many. A node above hashes the slots and hashes of up to FAN children and the
bytes they cover; offsets are kept beside, as one lost record moves all later ones. Every level is a table of its own, an FAN-th of
the one below. The audit compares roots and goes down only where hashes differ: of the lower levels it compares children of
damaged branches alone; records of damaged slots are compared by id.
"""

from __future__ import annotations

import gzip
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm.common import discard, written
from talkloom.llm.mixing import checked

FILE_IDS, FAN, LEVELS = 4096, 16, 3
DATE = "2024-01-01T00:00:00Z"


def record(page_id: Column, url: Column, body: Column, date: str = DATE) -> Column:
    """The bytes of a record. Null parts are empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    return F.concat(F.lit(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records_of(raw: bytes):
    """(offset, length, headers, body) of each whole record of an archive's bytes, plain or gzipped (offsets are then those of the
    plain bytes); header names in lower case. What isn't a whole record ends it."""
    if raw[:2] == b"\x1f\x8b":
        try:
            raw = gzip.decompress(raw)
        except (OSError, EOFError, zlib.error):
            return
    at = 0
    while raw.startswith(b"WARC/", at):
        end = raw.find(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")[1:] if end >= 0 else []
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = headers.get("content-length", "")
        stop = end + 8 + int(n) if n.isdecimal() else len(raw) + 1
        if stop > len(raw) or raw[stop - 4 : stop] != b"\r\n\r\n":
            return
        yield at, stop - at, headers, raw[end + 4 : stop - 4]
        at = stop


_READ = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("uri", pa.string()), ("body", pa.binary())])


def _read(batches):
    for batch in batches:
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            for at, n, h, body in records_of(raw or b""):
                row = (path, at, n, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-date"), h.get("warc-target-uri"), body)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _READ.types, strict=True)], schema=_READ)


def read_warc(files: DataFrame) -> DataFrame:
    """files (path, content), as spark.read.format("binaryFile") gives them -> a row for each record. A file is read by one task, so
    archives should stay below a gigabyte, as is usual."""
    return files.select("path", "content").mapInArrow(_read, "path string, offset long, length long, type string, record_id string, date string, uri string, body binary")


def leaves(records: DataFrame, null_archives: int = 1) -> DataFrame:
    """records (page_id, length, hash) -> (archive, slot, idx, page_id, start, length, hash): places in the archives; idx and start
    are those in this replica. Records without an id go to null_archives archives of their own (-1, -2, ...), archive and slot by
    their hashes; repeated ids stand in the order of their hashes.

    Equal records are counted before they are placed, and places are summed over slots, then over the first digits of hashes in a
    slot, then within those: no window holds more of a repeated id than a 4096-th of its different records.
    """
    h = F.xxhash64("hash")
    archive = F.when(F.col("page_id").isNull(), -1 - F.pmod(F.shiftright(h, 12), F.lit(null_archives))).otherwise(F.floor(F.col("page_id") / FILE_IDS))
    slot = F.pmod(F.coalesce("page_id", h), F.lit(FILE_IDS)).cast("long")
    d = records.select(archive.cast("long").alias("archive"), slot.alias("slot"), F.substring("hash", 1, 3).alias("piece"), "page_id", "hash", "length")
    d = d.groupBy("archive", "slot", "piece", "page_id", "hash", "length").agg(F.count("*").alias("copies"))

    def ahead(t, part, *order):
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return t.withColumns({c: F.coalesce(F.sum(of).over(w), F.lit(0)) for c, of in (("n0", "n"), ("b0", "b"))})

    pieces = d.groupBy("archive", "slot", "piece").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("length")).alias("b"))
    slots = ahead(pieces.groupBy("archive", "slot").agg(F.sum("n").alias("n"), F.sum("b").alias("b")), ["archive"], "slot").select("archive", "slot", F.col("n0").alias("n1"), F.col("b0").alias("b1"))
    pieces = ahead(pieces, ["archive", "slot"], "piece").join(slots, ["archive", "slot"]).select("archive", "slot", "piece", (F.col("n0") + F.col("n1")).alias("n1"), (F.col("b0") + F.col("b1")).alias("b1"))
    d = ahead(d.withColumns({"n": F.col("copies"), "b": F.col("copies") * F.col("length")}), ["archive", "slot", "piece"], "hash", "length").join(pieces, ["archive", "slot", "piece"])
    d = d.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return d.select("archive", "slot", (F.col("n0") + F.col("n1") + F.col("i")).alias("idx"), "page_id", (F.col("b0") + F.col("b1") + F.col("i") * F.col("length")).alias("start"), "length", "hash")


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels from the slots up to one root for each archive, each written: (archive, slot, hash, start, end, bytes)."""
    span = (F.min("start").alias("start"), F.max("end").alias("end"), F.sum("bytes").alias("bytes"))
    same = leaf.withColumn("end", F.col("start") + F.col("length")).groupBy("archive", "slot", "hash").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("length").alias("bytes"))
    parts = lambda c: F.array_join(F.sort_array(F.collect_list(c)), ",")
    piece = same.groupBy("archive", "slot", F.substring("hash", 1, 3).alias("piece")).agg(F.sha2(parts(F.concat("hash", F.lit("*"), F.col("n").cast("string"))), 256).alias("hash"), *span)
    level = piece.groupBy("archive", "slot").agg(F.sha2(parts(F.concat("piece", F.lit(":"), "hash")), 256).alias("hash"), *span)
    out = [written(level, "level")]
    for k in range(LEVELS):
        at = F.floor(F.col("slot") / FAN) if k < LEVELS - 1 else F.lit(0).cast("long")
        child = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", "hash"))), lambda x: F.concat(x["slot"].cast("string"), F.lit(":"), x["hash"])), ",")
        level = out[-1].groupBy("archive", at.alias("at")).agg(child.alias("c"), *span)
        out.append(written(level.select("archive", F.col("at").alias("slot"), F.sha2(F.concat("c", F.format_string(":%d", "bytes")), 256).alias("hash"), "start", "end", "bytes"), "level"))
    return out


def damage(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """(archive, slot) of slots that differ."""
    bad = None
    for k in range(LEVELS, -1, -1):
        x, y = (t[k].select("archive", "slot", F.col("hash").alias(h)) for t, h in ((a, "ha"), (b, "hb")))
        if bad is not None:  # children of the branches that differ
            above = F.floor(F.col("slot") / FAN) if k < LEVELS - 1 else F.lit(0).cast("long")
            up = checked(bad.select("archive", F.col("slot").alias("up")))
            x, y = (t.withColumn("up", above).join(up, ["archive", "up"], "left_semi").drop("up") for t in (x, y))
        both = x.join(y, ["archive", "slot"], "full_outer").where(~F.col("ha").eqNullSafe(F.col("hb")))
        found = written(both.select("archive", "slot"), "damage")
        if bad is not None:
            discard(bad)
        bad = found
    return bad


def differing(la: DataFrame, lb: DataFrame, slots: DataFrame) -> DataFrame:
    """(archive, idx, status) of the records in those slots that have no equal in the other replica: corrupt, missing (in b) or
    extra (in b, with b's idx). Equal records of an id go together first, by their numbers, then what is left of the id, in order.
    A record without an id has nothing but its hash to know it by: a changed one is missing, and an extra one."""
    slots = checked(slots)
    x, y = (t.join(slots, ["archive", "slot"], "left_semi").groupBy("archive", "slot", "page_id", "hash").agg(F.count("*").alias(f"n{k}"), F.min("idx").alias(f"i{k}")) for t, k in ((la, "a"), (lb, "b")))
    y = y.select("archive", "slot", "hash", F.col("page_id").alias("page_b"), "nb", "ib")
    both = x.join(y, (x["archive"] == y["archive"]) & (x["slot"] == y["slot"]) & (x["hash"] == y["hash"]) & x["page_id"].eqNullSafe(y["page_b"]), "full_outer")
    both = both.select(F.coalesce(x["archive"], y["archive"]).alias("archive"), F.coalesce("page_id", "page_b").alias("page_id"), F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"), "ia", "ib")
    rank = F.row_number().over(Window.partitionBy("archive", "page_id").orderBy("idx")).alias("rank")

    def left(mine, other, at):  # copies that the other one has no equal of
        rest = both.where(F.col(mine) > F.col(other)).select("archive", "page_id", F.explode(F.sequence(F.col(at) + F.col(other), F.col(at) + F.col(mine) - 1)).alias("idx"))
        return rest.select("archive", "idx", "page_id", rank)

    a, b = left("na", "nb", "ia"), left("nb", "na", "ib").select(F.col("archive").alias("archive_b"), F.col("idx").alias("idx_b"), F.col("page_id").alias("page_b"), F.col("rank").alias("rank_b"))
    out = a.join(b, (F.col("page_id") == F.col("page_b")) & (F.col("rank") == F.col("rank_b")), "full_outer")
    status = F.when(F.col("idx_b").isNull(), "missing").when(F.col("idx").isNull(), "extra").otherwise("corrupt")
    return written(out.select(F.coalesce("archive", "archive_b").alias("archive"), F.coalesce("idx", "idx_b").alias("idx"), status.alias("status")), "differing")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each record of replica a (records as leaves() takes them): its place and whether b agrees; extra records of b too. Replicas
    may be empty, ids null or repeated (see leaves()); other columns aren't read."""
    nulls = max(t.where("page_id is null").count() for t in (a, b))
    la, lb = (written(leaves(t, max(1, -(-nulls // FILE_IDS))), "leaves") for t in (a, b))
    ta, tb = tree(la), tree(lb)
    slots = damage(ta, tb)
    bad = checked(differing(la, lb, slots).select("archive", "idx", "status"))
    for t in (*ta, *tb, slots):
        discard(t)
    columns = ("page_id", "archive", "idx", "start", "length", F.col("hash").alias("record_sha256"))
    own = la.join(bad.where("status <> 'extra'"), ["archive", "idx"], "left").select(*columns, F.coalesce("status", F.lit("ok")).alias("status"))
    return own.unionAll(lb.join(bad.where("status = 'extra'"), ["archive", "idx"]).select(*columns, "status"))


def replicas(pages: DataFrame, every: int = 97) -> tuple[DataFrame, DataFrame]:
    """Records of pages, and of a replica in which the last character of every 97th page's body is another one."""
    rotten = F.when(F.pmod("page_id", F.lit(every)) == 0, F.concat(F.expr("substring(html, 1, length(html) - 1)"), F.lit("\u0001"))).otherwise(F.col("html"))
    rec, rot = record(F.col("page_id"), F.col("url"), F.col("html")), record(F.col("page_id"), F.col("url"), rotten)
    both = written(pages.select("page_id", F.octet_length(rec).cast("long").alias("la"), F.sha2(rec, 256).alias("ha"), F.octet_length(rot).cast("long").alias("lb"), F.sha2(rot, 256).alias("hb")), "records")
    return both.select("page_id", F.col("la").alias("length"), F.col("ha").alias("hash")), both.select("page_id", F.col("lb").alias("length"), F.col("hb").alias("hash"))


AUDIT_SQL = rf"""
with r as (select page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) as rec from pages),
h as (select page_id, page_id // 4096 as archive, strlen(rec)::bigint as length, sha256(rec) as record_sha256 from r)
select page_id, archive::bigint as archive, (row_number() over w - 1)::bigint as idx, coalesce(sum(length) over (partition by archive order by page_id rows between unbounded preceding and 1 preceding), 0)::bigint as start,
  length, record_sha256, case when page_id % 97 = 0 then 'corrupt' else 'ok' end as status
from h window w as (partition by archive order by page_id)"""
