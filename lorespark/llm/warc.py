"""WARC: Merkle fixity audit of replicas.

A replica is a table of stored records: shard, the offset at which its file holds the record, the page's id and the bytes.
Every record is hashed with its place (shard, offset, length). The leaves whose offsets lie in one range of ``RANGE`` bytes
are hashed, in order, into a node; ``FANOUT`` neighbouring ranges into their parent, up to one root per shard. Ranges are
of offsets, not of counts, so a lost record changes the nodes above its own place and no other. An audit compares roots,
and below them only the children of nodes that differ.

The levels of all replicas are one table each, cut once; a comparison is one aggregation over what is left of a level.

:func:`write` and :func:`read` turn records into WARC files and back.

Cases: a null or empty html is a record with an empty body; null ids and urls are written as empty fields, and a null
page_id stays null. Repeated rows are records of their own: the order in a shard is (page_id, digest). Ids must be integers
or cast to them. Very long records are hashed whole. Records that only one replica has are reported as missing or extra; of
a replica that stores two records at one place, the place is reported as corrupt. Two empty replicas have no findings.
Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.llm.common import cut

FANOUT = 16
RANGE = 1 << 16  # bytes of a file whose records are one node
SHARD_RECORDS = 1024
DATE = "2024-01-01T00:00:00Z"  # of records whose source has none


def _record(page: Column, url: Column, html: Column) -> Column:
    """A WARC/1.0 resource record; its id is a name-based one, made from the page's id and address."""
    d = F.sha2(F.concat_ws("|", page, url), 256)
    parts = [F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), F.concat_ws("-", *parts), F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, html, F.lit("\r\n\r\n"))


def records(pages: DataFrame, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """(shard, page_id, record): pages as WARC records. A shard holds a range of ``shard_records`` page ids, so that adding pages at the end changes no earlier shard."""
    page = F.col("page_id").cast("long")
    shard = F.coalesce(F.floor(page / shard_records), F.lit(-1)).cast("long")
    return pages.select(shard.alias("shard"), page.alias("page_id"), _record(F.coalesce(page.cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).alias("record"))


def laid_out(recs: DataFrame, *kept: Column | str) -> DataFrame:
    """(shard, offset, page_id, digest, length) of records in the order in which a shard stores them, and what else is
    ``kept``. Only these go through the window over the shard: without ``record`` no text is shuffled."""
    small = recs.select("shard", "page_id", F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("length"), *kept)
    w = Window.partitionBy("shard").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return small.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))


def layout(pages: DataFrame, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """(shard, offset, page_id, record): pages as a replica stores them."""
    return laid_out(records(pages, shard_records), "record").select("shard", "offset", "page_id", "record")


def leaves(replica: DataFrame) -> DataFrame:
    """(shard, seq, page_id, offset, length, hash) of what a replica stores, whatever another one does; seq is the offset."""
    return hashed(replica.filter("record IS NOT NULL").select("shard", "offset", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest")))


def hashed(stored: DataFrame) -> DataFrame:
    """Leaves of records of which digest and length are known."""
    h = F.sha2(F.concat_ws(":", "shard", "offset", "length", "digest"), 256)
    return stored.select("shard", F.col("offset").alias("seq"), "page_id", "offset", "length", h.alias("hash"))


def parents(level: DataFrame, width: int | None) -> DataFrame:
    """The next level of all replicas: the ordered hashes of the nodes in one range, hashed together. Without ``width``, one root a shard."""
    up = F.floor(F.col("seq") / width).cast("long") if width else F.lit(0).cast("long")
    g = level.groupBy("replica", "shard", up.alias("up")).agg(F.array_sort(F.collect_list(F.struct("seq", "hash"))).alias("kids"))
    h = F.sha2(F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["seq"].cast("string"), k["hash"])), ";"), 256)
    return g.select("replica", "shard", F.col("up").alias("seq"), h.alias("hash"))


def tree(a: DataFrame, b: DataFrame, span: int = RANGE, fanout: int = FANOUT) -> list[tuple[DataFrame, int | None]]:
    """Levels of both replicas, leaves first, roots last, each with the width that leads to its parents."""
    level = cut(a.withColumn("replica", F.lit("a")).unionByName(b.withColumn("replica", F.lit("b"))), "warc-leaves")
    out, longest = [], level.agg(F.max("seq")).first()[0] or 0
    widths = [span]
    while longest // span >= fanout:
        widths.append(fanout)
        longest //= fanout
    for width in (*widths, None):
        out.append((level, width))
        level = cut(parents(level, width), "warc-level")
    return [*out, (level, None)]


def audit(levels: list[tuple[DataFrame, int | None]]) -> DataFrame:
    """Leaves that differ: (shard, page_id, offset, length, finding) with finding corrupt, missing or extra (in b)."""
    bad = None
    for k in range(len(levels) - 1, -1, -1):
        level, width = levels[k]
        if bad is not None:
            up = F.floor(F.col("seq") / width).cast("long") if width else F.lit(0).cast("long")
            level = level.withColumn("up", up).join(bad.select("shard", F.col("seq").alias("up")), ["shard", "up"], "left_semi")
        of = lambda r, c: F.array_sort(F.collect_list(F.when(F.col("replica") == r, F.col(c))))
        if k:
            bad = cut(level.groupBy("shard", "seq").agg(of("a", "hash").alias("x"), of("b", "hash").alias("y")).filter("x <> y").select("shard", "seq"), "warc-bad")
            continue
        last = level.groupBy("shard", "offset").agg(of("a", "hash").alias("x"), of("b", "hash").alias("y"), *[F.min_by(c, F.struct("replica", "length", "page_id")).alias(c) for c in ("page_id", "length")])
        kind = F.when(F.size("y") == 0, "missing").when(F.size("x") == 0, "extra").otherwise("corrupt")
        return last.filter("x <> y").select("shard", "page_id", "offset", "length", kind.alias("finding"))
    raise ValueError("a tree has at least two levels")


def audit_pages(pages: DataFrame) -> DataFrame:
    """Lays pages out as WARC shards and locates the faults of a replica: about one record in 128 has a changed byte, one in 128 is lost."""
    draw = F.substring(F.sha2(F.concat(F.lit("fault"), F.col("page_id").cast("string")), 256), 1, 2)
    changed = F.sha2(F.when(draw.isin("02", "03"), F.concat(F.lit("w"), F.expr("substring(record, 2)"))).otherwise(F.col("record")), 256)
    a = cut(laid_out(records(pages), changed.alias("found"), F.coalesce(draw.isin("00", "01"), F.lit(False)).alias("lost")), "warc-layout")
    return audit(tree(hashed(a), hashed(a.filter("NOT lost").withColumn("digest", F.col("found")))))


def write(records: DataFrame, path: str) -> None:
    """One WARC file a shard under ``path``. Lines end where records do: the text writer puts back each record's last line feed."""
    whole = records.repartition("shard").sortWithinPartitions("shard", "offset")
    whole.select("shard", F.expr("substring(record, 1, length(record) - 1)").alias("value")).write.partitionBy("shard").text(path, lineSep="\n")


_LENGTH = re.compile(rb"content-length:\s*(\d+)", re.I)


def split_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of a WARC file, plain or with a gzip member for each record (the offset is then that of the member)."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            z = zlib.decompressobj(31)
            yield at, z.decompress(data[at:])
            at = len(data) - len(z.unused_data)
            continue
        head = data.find(b"\r\n\r\n", at)
        m = _LENGTH.search(data, at, head) if head >= 0 else None
        if not m:
            raise ValueError(f"no WARC record at byte {at}")
        stop = head + 4 + int(m[1]) + 4
        yield at, data[at:stop]
        at = stop


def read(spark: SparkSession, path: str) -> DataFrame:
    """(shard, offset, record) of all WARC files under ``path``: a replica as it is stored. A file is one row, of 2 GB at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, data in zip(b.column(0), b.column(1)):
                got = list(split_records(data.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()] * len(got), pa.int64()), pa.array([x for x, _ in got], pa.int64()), pa.array([r.decode("utf-8", "replace") for _, r in got])], names=["shard", "offset", "record"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    shard = F.regexp_extract("path", r"shard=(-?\d+)", 1).try_cast("long")
    return files.select(shard.alias("shard"), "content").mapInArrow(run, "shard long, offset long, record string")


def oracle(shard_records: int = SHARD_RECORDS) -> str:
    """The planted faults and their places, in DuckDB SQL."""
    return f"""
WITH d AS (SELECT *, sha256(coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')) AS d FROM pages),
r AS (SELECT CAST(floor(page_id / {shard_records}) AS BIGINT) AS shard, page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
  || 'WARC-Record-ID: <urn:uuid:' || substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-' || substr(d, 17, 4) || '-' || substr(d, 21, 12) || '>' || chr(13) || chr(10)
  || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
  || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM d),
p AS (SELECT shard, page_id, CAST(strlen(record) AS BIGINT) AS length,
  CAST(coalesce(sum(strlen(record)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  substr(sha256('fault' || page_id), 1, 2) AS draw FROM r WINDOW w AS (PARTITION BY shard ORDER BY page_id, sha256(record)))
SELECT shard, page_id, "offset", length, CASE WHEN draw IN ('00', '01') THEN 'missing' ELSE 'corrupt' END AS finding FROM p WHERE draw IN ('00', '01', '02', '03')"""
