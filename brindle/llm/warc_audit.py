"""Merkle fixity audit of replicas of WARC archives.

``warc_records(pages)`` lays pages out as WARC/1.0 resource records in archives of bounded size, with byte offsets and SHA-256
digests. ``fixity_audit(a, b)`` compares two replicas of such records, (archive, offset, length, digest):

* a leaf hashes the ordered (offset, length, digest) of the records that start in one range of ``LEAF_BYTES`` bytes, a node those of
  ``FANOUT`` ordered children; ranges go by offset, so a lost record changes its own branch only;
* roots are compared per archive; then, level by level, only the children of nodes that differ are read, paired and compared,
  down to the records of differing leaves. What lies below equal nodes is never paired.

Both replicas bring records of their own: a digest is taken from the bytes that a replica holds (``warc_digests``).

Returns records that differ: archive, offset, status (corrupt, missing in b, extra in b), digest_a, digest_b. Nothing is gathered beyond one node's
children; copies of one record at one offset are compared as a set. Null urls and bodies count as empty; pages with a null
page_id are dealt to archives below 0 by the first 16 bits of their digest, so they don't meet in one; equal page_ids are
ordered by digest; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import materialize

ARCHIVE_PAGES, LEAF_BYTES, FANOUT = 1000, 1 << 16, 16


def warc_records(pages: DataFrame, archive_pages: int = ARCHIVE_PAGES, body: bool = False) -> DataFrame:
    """archive, page_id, length, digest, offset, and with ``body`` the record itself."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    record = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), text("url"), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text("html")).cast("string"), F.lit("\r\n\r\n"), text("html"), F.lit("\r\n\r\n"))
    rows = pages.select("page_id", record.alias("record")).select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), *(["record"] if body else []))
    nowhere = -1 - F.conv(F.substring("digest", 1, 4), 16, 10).cast("long")
    rows = rows.withColumn("archive", F.coalesce(F.expr(f"page_id div {archive_pages}"), nowhere).cast("long"))
    before = Window.partitionBy("archive").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def warc_digests(records: DataFrame) -> DataFrame:
    """archive, offset, length, digest of the bytes in ``record``, a replica's own."""
    return records.select("archive", "offset", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))


def _tree(records: DataFrame) -> list[DataFrame]:
    """Both replicas' nodes (replica, archive, node, h), written level by level, leaves first."""
    end = records.agg(F.max("offset")).first()[0] or 0
    leaf = F.concat_ws(":", "offset", "length", "digest")
    level = records.withColumns({"leaf": leaf, "node": F.expr(f"offset div {LEAF_BYTES}")})
    level = level.groupBy("replica", "archive", "node").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "leaf"))), lambda x: x.leaf), ","), 256).alias("h"))
    levels = [materialize(level)]
    while end // (LEAF_BYTES * FANOUT ** (len(levels) - 1)):
        up = levels[-1].withColumn("parent", F.expr(f"node div {FANOUT}"))
        children = F.array_sort(F.collect_list(F.struct(F.col("node").alias("n"), "h")))
        levels.append(materialize(up.groupBy("replica", "archive", F.col("parent").alias("node")).agg(F.sha2(F.array_join(F.transform(children, lambda x: F.concat_ws(":", x.n, x.h)), ","), 256).alias("h"))))
    return levels


def _differing(nodes: DataFrame) -> DataFrame:
    of = lambda r: F.max(F.when(F.col("replica") == r, F.col("h")))
    return nodes.groupBy("archive", "node").agg(of("a").alias("ha"), of("b").alias("hb")).filter(~F.col("ha").eqNullSafe(F.col("hb"))).select("archive", "node")


def fixity_audit(a: DataFrame, b: DataFrame) -> DataFrame:
    cols = ["archive", "offset", "length", "digest"]
    records = materialize(a.select(F.lit("a").alias("replica"), *cols).unionByName(b.select(F.lit("b").alias("replica"), *cols)))
    levels = _tree(records)
    open_ = materialize(_differing(levels[-1]))
    for level in reversed(levels[:-1]):
        below = level.withColumn("parent", F.expr(f"node div {FANOUT}")).join(open_.withColumnRenamed("node", "parent"), ["archive", "parent"], "left_semi")
        open_ = materialize(_differing(below))
    suspect = records.withColumn("node", F.expr(f"offset div {LEAF_BYTES}")).join(open_, ["archive", "node"], "left_semi")
    own = lambda r: F.array_join(F.array_sort(F.collect_list(F.when(F.col("replica") == r, F.col("digest")))), ",").alias(f"digest_{r}")
    each = suspect.groupBy("archive", "offset").agg(own("a"), own("b")).filter("digest_a <> digest_b")
    status = F.when(F.col("digest_b") == "", "missing").when(F.col("digest_a") == "", "extra").otherwise("corrupt")
    return each.select("archive", "offset", status.alias("status"), "digest_a", "digest_b")
