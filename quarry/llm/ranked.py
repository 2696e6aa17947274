"""Ranked lexical search over postings in buckets of their terms.

The index is a table of postings, written in folders by the hash of the term: a row holds a term, and of one
run of documents those that have it, with counts. A search reads only the buckets of its terms, joins the items'
terms, scores each match in integers, sums by item and document, and keeps the first ranks of each item. The
postings that match are dealt by document before they meet the items, so sums and ranks are made where they
lie and no table of all items and documents is shuffled. Items are searched in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_words import slices, words_of
from .shared import new_folder, release, small_batches, staged
from .words import ascii_lower

BUCKETS, BUCKET_PARTS = 64, 4
#: Terms of items that are searched at once; they are broadcast.
BLOCK_TERMS = 100_000
TOP = 50
#: Fixed values of the score: the weight's scale, the count's scale and slope, and the share of the length in it.
WEIGHT_SCALE, COUNT_SCALE, COUNT_SLOPE, LENGTH_SLOPE, LENGTH_BASE, LENGTH_SHARE = 1000, 1_000_000_000, 1000, 20, 50, 50
#: Bytes of text whose documents share one line for each term.
LINE_BYTES = 1 << 23


def posting_rows(texts: DataFrame) -> DataFrame:
    """Of (row, doc_id, text): lines (term, n, docs, counts), one for each term of a slice of a batch: the n rows that have it,
    and how often; and one without a term that holds all rows, their numbers of terms and their doc_ids."""
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=LINE_BYTES):
                yield lines(part)
        release()

    def lines(part: pa.RecordBatch) -> pa.RecordBatch:
        w = words_of(part.column("text"))
        rows = part.column("row").to_numpy()
        lengths = np.bincount(w.row, minlength=len(rows))
        order = np.argsort(w.hashes, kind="stable")  # by term, then by row
        h, r = w.hashes[order], w.row[order]
        new_term = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
        first = np.flatnonzero(new_term | np.concatenate([[True], r[1:] != r[:-1]])) if len(h) else np.empty(0, np.int64)
        counts = np.diff(np.concatenate([first, [len(h)]]))
        heads = np.flatnonzero(new_term)
        terms = [w.data[a:b].tobytes().decode("utf-8") for a, b in zip(w.starts[order[heads]].tolist(), w.ends[order[heads]].tolist())]
        offsets = np.concatenate([np.searchsorted(first, heads), [len(first)], [len(first) + len(rows)]]).astype(np.int32)
        docs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([rows[r[first]], rows])))
        held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([counts, lengths]).astype(np.int32)))
        n = pa.array(np.diff(offsets))
        ids = pa.ListArray.from_arrays(pa.array([*[None] * len(terms), 0, len(rows)], pa.int32()), part.column("doc_id"))
        return pa.RecordBatch.from_arrays([pa.array([*terms, None], pa.string()), n, docs, held, ids], names=["term", "n", "docs", "counts", "ids"])

    return texts.select("row", "doc_id", "text").mapInArrow(run, f"term string, n int, docs array<long>, counts array<int>, ids array<{id_type}>")


@dataclass
class Postings:
    """An index: its table of postings in buckets, its documents (row, doc_id, n) with a term, their number N and all their terms L."""

    table: DataFrame
    docs: DataFrame
    n_docs: int
    n_terms: int
    buckets: int

    def of(self, terms: DataFrame) -> DataFrame:
        """The postings of a small table with a column ``term``, with its other columns; only the terms' buckets are read."""
        asked = terms.withColumn("bucket", bucket_of(F.col("term"), self.buckets))
        folders = [r[0] for r in asked.select("bucket").distinct().collect()]  # as many as there are buckets at most
        return self.table.filter(F.col("bucket").isin(folders)).join(F.broadcast(asked), ["bucket", "term"]).drop("bucket")


def bucket_of(term, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(docs: DataFrame, buckets: int = BUCKETS) -> Postings:
    """The postings of all documents, written to the shared folder. Needs doc_id and text; rows are told apart by number.

    A bucket is written by several tasks, which share the rows of its terms by documents, so a frequent term is spread.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    path = new_folder(spark, "postings")
    with small_batches(spark):
        lines = posting_rows(rows)
        dealt = lines.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(bucket_of(F.col("term"), buckets)))
        parts = max(BUCKET_PARTS, rows.rdd.getNumPartitions() // 8)  # more for more documents, so that a part stays small
        part = F.pmod(F.xxhash64(F.get("docs", F.lit(0))), F.lit(parts))
        dealt.withColumn("part", part).repartition("bucket", "part").sortWithinPartitions("bucket", "term").drop("part").write.partitionBy("bucket").parquet(path)
    table = spark.read.schema(f"term string, n int, docs array<long>, counts array<int>, ids array<{rows.schema['doc_id'].dataType.simpleString()}>, bucket int").parquet(path)
    each = table.filter("bucket = -1").select(F.explode(F.arrays_zip("docs", "counts", "ids")).alias("d"))
    lengths = each.select(F.col("d.docs").alias("row"), F.col("d.ids").alias("doc_id"), F.col("d.counts").cast("long").alias("length")).filter("length > 0")
    total = lengths.agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("terms")).first()
    return Postings(table.filter("bucket >= 0").drop("ids"), lengths, total["docs"], total["terms"], buckets)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item; rows of one item_id, null included, are texts of one item."""
    pieces = F.split(ascii_lower(F.coalesce("text", F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return items.select("item_id", F.explode(F.array_distinct(F.filter(pieces, lambda t: t != ""))).alias("term")).distinct()


def scored(index: Postings, asked: DataFrame) -> DataFrame:
    """(item_id, row, doc_id, score) of every document with a score for one block of (item_id, term), made where a document's matches lie."""
    terms = staged(asked.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "terms")
    found = index.of(terms).groupBy("term_id").agg(F.sum("n").alias("df"))
    weight = F.floor(WEIGHT_SCALE * F.log(F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighted = staged(terms.join(found.select("term_id", weight.alias("w")).filter("w > 0"), "term_id"), "weights")
    matches = index.of(weighted).select("term_id", "w", F.explode(F.arrays_zip("docs", "counts")).alias("p")).select("term_id", "w", F.col("p.docs").alias("row"), F.col("p.counts").cast("long").alias("tf"))
    own = matches.repartition("row").join(index.docs.hint("shuffle_hash"), "row")  # a document's matches and its length meet in one task
    m = f"({LENGTH_BASE} + ({LENGTH_SHARE} * length * {index.n_docs}L) div {max(1, index.n_terms)}L)"
    share = F.expr(f"w * (({COUNT_SCALE}L * tf) div ({COUNT_SLOPE}L * tf + {LENGTH_SLOPE}L * {m}))")
    by_item = F.broadcast(asked.join(terms, "term").select("term_id", "item_id"))
    return own.select("row", "doc_id", "term_id", share.alias("s")).join(by_item, "term_id").groupBy("row", "doc_id", "item_id").agg(F.sum("s").alias("score")).filter("score > 0")


def ranked(index: Postings, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest-scoring documents of each item, ties by ascending doc_id.

    Needs item_id and text of ``items``; other columns are left aside. Items without terms, or whose terms no
    document has, have no rows. Null and empty documents have no terms and do not count. Repeated doc_ids are
    documents of their own, ranked by row among themselves; null doc_ids come last among equal scores. Rows of one
    item_id are one item. Blocks of items are dealt by the hash of item_id, so that a block's terms can be broadcast.
    """
    asked = staged(item_terms(items), "item-terms")
    blocks = max(1, -(-asked.count() // block_terms))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    parts = []
    for b in range(blocks):
        block = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        parts.append(scored(index, block).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the 50 best documents for each benchmark item."""
    return ranked(build(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term"
SQL = f"""WITH t AS (SELECT r, doc_id, {_TERMS} FROM (SELECT row_number() OVER () AS r, * FROM documents)),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT r, count(*) AS n FROM t GROUP BY r),
c AS (SELECT count(*) AS N_docs, sum(n)::BIGINT AS L FROM d),
w AS (SELECT term, floor(1000 * ln((2 * N_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} FROM benchmark)),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * N_docs) // L))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d USING (r), c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50"""
