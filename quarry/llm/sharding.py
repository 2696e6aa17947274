"""Sharding by extendible hashing, in DataFrame functions alone.

Documents are hashed; a bucket is the set of hashes that share a prefix of bits. A bucket within the
byte limit is a shard, one above it splits on its next bit, and no other bucket is touched. The
directory is worked out on sums of bytes by prefix, which shrink the table before anything moves:
first on prefixes a few bits longer than the limit needs on average, then, for prefixes that are
still too large, on the whole hash, then on bits that number the rows of one hash, so that rows of
one key, however many, split as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import staged

#: Bits of the key's hash, and of the hash of the row's number, which follow one another.
KEY_BITS, ROW_BITS = 60, 60
#: Bytes that a shard of the production query may hold.
LIMIT = 1 << 20


def _prefix(bits: Column, depth: Column) -> Column:
    return F.substring(bits, F.lit(1), depth)


def key_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5 as a string of 0 and 1."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, KEY_BITS // 4)
    return F.lpad(F.conv(digits, 16, 2), KEY_BITS, "0")


def _cells(rows: DataFrame, depth: int) -> DataFrame:
    return rows.groupBy(_prefix(F.col("bits"), F.lit(depth)).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_rows"))


def directory(cells: DataFrame, limit: int, low: int, depth: int) -> DataFrame:
    """(cell, shard_id, shard_bytes) of each cell whose bucket fits the limit at ``depth`` bits or fewer.

    Every cell adds its bytes to its prefixes; a prefix that fits under a parent that does not is a
    shard. Buckets above ``low`` bits are known to be too large, so no sum is made for them.
    """
    levels = F.sequence(F.lit(low), F.lit(depth))
    sums = cells.select(F.explode(F.transform(levels, lambda d: F.substring(F.col("cell"), F.lit(1), d))).alias("prefix"), "bytes").groupBy("prefix").agg(F.sum("bytes").alias("bytes"))
    sums = staged(sums, "bucket-sums")
    small = sums.filter(F.col("bytes") <= limit)
    large = sums.filter(F.col("bytes") > limit).select(F.col("prefix").alias("parent"))
    leaves = small.withColumn("parent", F.expr("substring(prefix, 1, length(prefix) - 1)"))
    roots = leaves.filter(F.length("prefix") == low)
    leaves = roots.unionByName(leaves.filter(F.length("prefix") > low).join(large, "parent", "left_semi"))
    named = leaves.select(F.col("prefix").alias("shard_id"), F.col("bytes").alias("shard_bytes"))
    # Only the lengths that shards have are looked up, each cell under its own prefixes.
    lengths = sorted(r["n"] for r in named.select(F.length("shard_id").alias("n")).distinct().collect())
    if not lengths:
        return cells.select("cell", F.lit("").alias("shard_id"), F.lit(0).cast("long").alias("shard_bytes")).limit(0)
    own = F.array(*[F.substring("cell", 1, n) for n in lengths])
    return cells.select("cell", F.explode(own).alias("shard_id")).join(named, "shard_id").select("cell", "shard_id", "shard_bytes")


def shards(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, shard_id, shard_bytes) of each row of ``docs``.

    ``shard_id`` is the shard's hash prefix in 0 and 1, empty if all fits into one shard. A shard
    above the limit holds one row that is itself above it. Null and empty texts have no bytes, null
    keys are one key, rows with one key share a shard as long as they fit, and then split by row. An
    empty table gives no rows.
    """
    sized = docs.select(F.col("doc_id"), F.col(key).alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    numbered = sized.withColumn("row", F.monotonically_increasing_id())
    rows = staged(numbered.select("doc_id", "bytes", F.concat(key_bits(F.col("key")), F.lpad(F.conv(F.substring(F.md5(F.col("row").cast("string")), 1, ROW_BITS // 4), 16, 2), ROW_BITS, "0")).alias("bits")), "sharded-rows")
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    even = max(0, math.ceil(math.log2(max(total, 1) / limit)))
    found, left, low = None, rows, 0
    for depth in (min(KEY_BITS, even + 6), KEY_BITS, KEY_BITS + min(ROW_BITS, even + 6), KEY_BITS + ROW_BITS):
        if depth < low:
            continue
        cells = staged(_cells(left, depth), "cells")
        named = directory(cells, limit, low, depth)
        over = cells.filter(F.col("bytes") > limit).select("cell")
        if depth == KEY_BITS + ROW_BITS:  # one row a cell: it is above the limit by itself
            named = named.unionByName(cells.filter(F.col("bytes") > limit).select("cell", F.col("cell").alias("shard_id"), F.col("bytes").alias("shard_bytes")))
        here = left.withColumn("cell", _prefix(F.col("bits"), F.lit(depth)))
        placed = here.join(named, "cell").select("doc_id", F.col("bytes").alias("n_bytes"), "shard_id", "shard_bytes")
        found = placed if found is None else found.unionByName(placed)
        if depth == KEY_BITS + ROW_BITS or over.isEmpty():
            return found
        left, low = staged(here.join(over, "cell", "left_semi").select("doc_id", "bytes", "bits"), "oversized-rows"), depth + 1
    return found


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard of at most 1 MiB of text."""
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::UBIGINT), {KEY_BITS}, '0') AS bits
  FROM documents),
nodes AS (
  SELECT substr(bits, 1, k) AS prefix, sum(n_bytes)::BIGINT AS bytes
  FROM d, (SELECT unnest(range(0, {KEY_BITS + 1})) AS k) GROUP BY 1),
first_fit AS (
  SELECT d.doc_id, d.n_bytes, min(length(n.prefix)) AS k
  FROM d JOIN (SELECT unnest(range(0, {KEY_BITS + 1})) AS k) s ON true
  JOIN nodes n ON n.prefix = substr(d.bits, 1, s.k) AND n.bytes <= {LIMIT} GROUP BY 1, 2)
SELECT f.doc_id, f.n_bytes, substr(d.bits, 1, f.k) AS shard_id, n.bytes AS shard_bytes
FROM first_fit f JOIN d USING (doc_id) JOIN nodes n ON n.prefix = substr(d.bits, 1, f.k)
"""
