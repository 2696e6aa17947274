"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source's mean repetition rate is its target share of the output divided by its share of the
input, both in bytes of text. Each document draws its number of copies by inverting the Poisson
distribution of that mean at a uniform number hashed from seed and doc_id; it is exploded by the
count, and all copies are shuffled globally by a hash of seed, doc_id, copy and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spread_join, staged
from .words import free_name, let

#: Tables of at most this many sources (a row has at most about 4 KB) are broadcast, larger ones are shuffled.
BROADCAST_SOURCES = 2000
#: A larger mean is drawn as a sum of equal Poisson parts of at most this mean, so that exp(-mean) is never zero.
PART = 256.0
SEED = "mix-1"
_UNIT = 1 << 52


def _uniform(*parts: Column) -> Column:
    """In [0, 1), from the first 13 hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(_UNIT))


def tempered_weights(docs: DataFrame, by: str = "source", power: float = 0.5) -> DataFrame:
    """(by, weight): each source's bytes of text to a power below one, which lifts small sources."""
    sizes = docs.groupBy(by).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("double").alias("bytes"))
    return sizes.select(by, F.pow("bytes", F.lit(power)).alias("weight"))


def rates(docs: DataFrame, weights: DataFrame, by: str = "source", scale: float = 1.0) -> DataFrame:
    """(by, rate): the mean number of copies of a source's documents, for ``scale`` times the input's bytes.

    Only sources of the input count; one without a weight has rate 0, one without any bytes rate 0.
    A null source is a source like any other. ``weights`` has one row for each source.
    """
    sizes = docs.groupBy(by).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("double").alias("bytes"))
    other = weights.select(F.col(by).alias("w_by"), F.col("weight").cast("double").alias("weight"))
    both = sizes.join(other, sizes[by].eqNullSafe(other["w_by"]), "left").select(sizes[by], "bytes", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = both.agg(F.sum("bytes").alias("bytes"), F.sum("weight").alias("weight")).first()
    share = F.col("weight") / F.lit(total["weight"] or 1.0) * F.lit((total["bytes"] or 0.0) * scale)
    return both.select(by, F.coalesce(F.round(F.try_divide(share, F.col("bytes")), 9), F.lit(0.0)).alias("rate"))


def distribution(rate: Column) -> Column:
    """The cumulative Poisson distribution of a mean of at most ``PART``, as far as it is below 1 in doubles."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))
    step = lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + acc["p"] * rate / k)).alias("sums"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["sums"])


def replicate(docs: DataFrame, weights: DataFrame, by: str = "source", scale: float = 1.0, seed: str = SEED) -> DataFrame:
    """``docs`` with each row as often as its Poisson count, plus copy (from 1) and n_copies, shuffled globally.

    The count depends on seed and doc_id alone: rows with equal doc_id and source have equal counts,
    also where doc_id is null. Null and empty texts are drawn like others of their source. Columns
    named copy or n_copies are replaced. An empty table stays empty.
    """
    q_by, q_parts, q_sums = (free_name(docs, n) for n in ("q_by", "q_parts", "q_sums"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    rate = rates(docs, weights, by, scale).withColumn("parts", parts)
    table = staged(rate.select(F.col(by).alias(q_by), F.col("parts").alias(q_parts), distribution(F.col("rate") / F.col("parts")).alias(q_sums)), "rates")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draw = lambda part: let(_uniform(F.lit(seed), key, part.cast("string")), lambda u: F.size(F.filter(q_sums, lambda s: s <= u)))
    n = F.aggregate(F.sequence(F.lit(1), F.col(q_parts)), F.lit(0), lambda acc, k: acc + draw(k))
    if table.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(table), docs[by].eqNullSafe(table[q_by]))
    else:
        q_n = free_name(docs, "q_n")
        held = staged(docs.groupBy(F.col(by).alias(q_by)).agg(F.count("*").alias(q_n)), "source-rows")
        sized = table.join(held.withColumnRenamed(q_by, q_by + "_"), table[q_by].eqNullSafe(F.col(q_by + "_"))).drop(q_by + "_").withColumnRenamed(q_by, by)
        joined = spread_join(docs, sized, by, q_n, docs.count(), key)
    counted = joined.withColumn("n_copies", n)
    copies = counted.filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    order = F.xxhash64(F.lit(seed), key, "copy", "text")
    return copies.drop(q_by, q_parts, q_sums).repartition(order).sortWithinPartitions(order)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document, the sources weighted by the square root of their bytes: doc_id, source, copy, n_copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return replicate(docs, tempered_weights(docs)).select("doc_id", "source", "copy", "n_copies")


SQL = f"""
WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0))::DOUBLE AS bytes FROM documents GROUP BY source),
totals AS (SELECT sum(bytes) AS bytes, sum(pow(bytes, 0.5)) AS weight FROM sizes),
rates AS (SELECT s.source, coalesce(round(pow(s.bytes, 0.5) / t.weight * t.bytes / nullif(s.bytes, 0), 9), 0.0) AS rate FROM sizes s, totals t),
terms AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS s
  FROM (SELECT source, k, exp(-rate) * CASE WHEN k = 0 THEN 1.0 ELSE exp(k * ln(rate) - lgamma(k + 1)) END AS p
        FROM rates, (SELECT unnest(range(0, 400)) AS k) WHERE rate > 0 OR k = 0)),
drawn AS (
  SELECT d.doc_id, d.source,
    ('0x' || substr(md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, 'null') || '|1'), 1, 13))::BIGINT::DOUBLE / {_UNIT}.0 AS u
  FROM documents d),
counts AS (
  SELECT d.doc_id, d.source, (SELECT count(*) FROM terms t WHERE t.source = d.source AND t.s <= d.u)::INTEGER AS n_copies FROM drawn d)
SELECT doc_id, source, unnest(range(1, n_copies + 1))::INTEGER AS copy, n_copies FROM counts WHERE n_copies > 0
"""
