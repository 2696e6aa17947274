"""Exact top-k by a bit-sliced index.

Components are quantised to integers and written, block by block of rows, as bitmaps: one for each
bit of each component. A query's scores are sums of these bitmaps: a component's slices, shifted for
each binary digit of the query's own component, are added column by column with carry-save adders,
which leaves the scores of all rows of the block as bit slices of their own. From the most
significant slice down, rows that must be among the best are split from rows that cannot be; rows
still equal at the last slice are the boundary, resolved by the smaller id.
"""

from __future__ import annotations

from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import staged

#: Rows of an index block, and queries of a query block (4 MB at 64 components); a cell of the search is one of each.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 8192
#: Queries of a block at least, where smaller blocks are made to give every core a cell.
LEAST_QUERIES = 128
#: Quantised components are 64-bit integers; beyond that magnitude they are read as it.
LARGEST = (1 << 63) - 1
#: Scores travel as two numbers, the score divided by this and the rest, as they may have more than 63 bits.
PART = 1 << 62
_INDEX = "dims int, block long, ids binary, low binary, width int, slices binary"
_QUERY = "dims int, q_block long, q_ids binary, q_values binary"
_HITS = "query_id long, vec_id long, high long, low long"


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    values = F.transform(vector, lambda x: F.greatest(F.lit(-LARGEST), F.floor(F.lit(scale) * x.cast("double"))))
    return F.when(finite, values)


def vectors(rows: DataFrame, scale: float) -> DataFrame:
    """(vec_id, v) of the rows that take part: those with an id whose vectors are whole and finite."""
    return rows.select(F.col("vec_id").cast("long"), quantised(F.col("embedding"), scale).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")


def _matrices(batches, size: int):
    """(dims, ids, values) of up to ``size`` rows of equal dimension, from Arrow batches of (vec_id, v)."""
    held: dict[int, list] = {}
    for b in batches:
        ids, lists = b.column(0).to_numpy(), b.column(1)
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        dims = np.diff(offsets)
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            mine = flat[(offsets[at][:, None] + np.arange(d)[None, :]).ravel()].reshape(len(at), d)
            old = held.pop(d, None)
            ids_d, mine = (ids[at], mine) if old is None else (np.concatenate([old[0], ids[at]]), np.concatenate([old[1], mine]))
            while len(ids_d) >= size:
                yield d, ids_d[:size], mine[:size]
                ids_d, mine = ids_d[size:], mine[size:]
            if len(ids_d):
                held[d] = [ids_d, mine]
    for d, (ids, mine) in held.items():
        yield d, ids, mine


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index: a row for each block with its ids, the least value of each component, and the bit slices
    of the values above it. Each task slices the rows it reads, so nothing is moved."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        for dims, ids, values in _matrices(batches, block_rows):
            order = np.argsort(ids, kind="stable")
            ids, values = ids[order], values[order]
            low = values.min(0) if dims else np.zeros(0, np.int64)
            above = values.view(np.uint64) - low.view(np.uint64)  # of up to 64 bits, whatever the signs
            width = int(above.max()).bit_length() if dims else 0
            words = -(-len(ids) // 64) * 64
            bits = np.zeros((dims, width, words), np.uint8)
            for k in range(width):
                bits[:, k, : len(ids)] = ((above >> np.uint64(k)) & np.uint64(1)).T
            packed = np.packbits(bits, axis=-1, bitorder="little")
            block = (part << 32) + made
            made += 1
            yield pa.RecordBatch.from_pydict({"dims": pa.array([dims], pa.int32()), "block": [block], "ids": [ids.astype("<i8").tobytes()], "low": [low.astype("<i8").tobytes()], "width": pa.array([width], pa.int32()), "slices": [packed.tobytes()]})

    return rows.select("vec_id", "v").mapInArrow(run, _INDEX)


def query_blocks(queries: DataFrame, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Queries gathered to blocks of equal dimension."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        for dims, ids, values in _matrices(batches, block_queries):
            block = (part << 32) + made
            made += 1
            yield pa.RecordBatch.from_pydict({"dims": pa.array([dims], pa.int32()), "q_block": [block], "q_ids": [ids.astype("<i8").tobytes()], "q_values": [values.astype("<i8").tobytes()]})

    return queries.select("vec_id", "v").mapInArrow(run, _QUERY)


def _added(columns: list[list[np.ndarray]]) -> np.ndarray:
    """Adds bitmaps given by their binary weight: carry-save adders turn three of a column into one and a carry."""
    out: list[np.ndarray] = []
    carries: list[np.ndarray] = []
    k = 0
    while k < len(columns) or carries:
        stack = [x for x in (columns[k] if k < len(columns) else []) if len(x)] + carries
        carries = []
        one = np.concatenate(stack) if stack else None
        while one is not None and len(one) > 1:
            n = len(one) // 3
            if n:
                a, b, c = one[:n], one[n : 2 * n], one[2 * n : 3 * n]
                ab = a ^ b
                carries.append((a & b) | (ab & c))
                one = np.concatenate([ab ^ c, one[3 * n :]])
            else:
                carries.append((one[0] & one[1])[None])
                one = (one[0] ^ one[1])[None]
        out.append(one[0] if one is not None else None)
        k += 1
    words = next(x for x in out if x is not None).shape[-1]
    return np.stack([x if x is not None else np.zeros(words, np.uint64) for x in out])


def score_slices(slices: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, int]:
    """Bit slices of the rows' scores, and what is to be added to each. ``slices`` is components x bits x words.

    A negative component adds the complements of the slices instead: -x = ~x - (2 ** bits - 1).
    """
    dims, width, words = slices.shape
    top = int(np.abs(query).max()).bit_length() if dims else 0
    if not top or not width:
        return np.zeros((1, words), np.uint64), 0
    negative = query < 0
    size = np.abs(query)
    signed = slices ^ np.where(negative, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None, None]
    constant = -sum(size[negative].tolist()) * ((1 << width) - 1)
    columns: list[list[np.ndarray]] = [[] for _ in range(top + width - 1)]
    for k in range(top):
        mine = signed[(size >> k) & 1 == 1]
        for j in range(width):
            columns[k + j].append(mine[:, j])
    return _added(columns), constant


def best_rows(scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of the bitmap ``rows`` (all if fewer), ties to the first: from the highest slice
    down, the rows that have the bit are taken whole while they fit, else the others drop out."""
    sure, equal, need = np.zeros_like(rows), rows, k
    for s in scores[::-1]:
        ones = equal & s
        n = int(np.bitwise_count(ones).sum())
        if n > need:
            equal = ones
        else:
            sure |= ones
            need -= n
            equal = equal & ~s
            if not need:
                break
    places = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    return np.concatenate([places(sure), places(equal)[:need]])


def _exact(bits: np.ndarray, added: int) -> list[int]:
    """The numbers whose binary digits are the columns of ``bits``, lowest first, and what is added to each."""
    if len(bits) < 62:
        return [x + added for x in (bits.astype(np.int64) << np.arange(len(bits))[:, None]).sum(0).tolist()]
    return [sum(b << k for k, b in enumerate(column)) + added for column in bits.T.tolist()]


def _search_cell(block, queries: pd.DataFrame, k: int):
    ids, low = np.frombuffer(block.ids, "<i8"), np.frombuffer(block.low, "<i8").tolist()
    words = -(-len(ids) // 64)
    slices = np.frombuffer(block.slices, np.uint8).view(np.uint64).reshape(block.dims, block.width, words)
    valid = np.zeros(words * 64, np.uint8)
    valid[: len(ids)] = 1
    valid = np.packbits(valid, bitorder="little").view(np.uint64)
    for q in queries.itertuples():
        query_ids = np.frombuffer(q.q_ids, "<i8")
        values = np.frombuffer(q.q_values, "<i8").reshape(len(query_ids), block.dims)
        places, totals, asked = [], [], []
        for query_id, query in zip(query_ids.tolist(), values, strict=True):
            scores, constant = score_slices(slices, query)
            rows = valid.copy()
            a, b = np.searchsorted(ids, [query_id, query_id + 1])
            for own in range(a, b):
                rows[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
            at = best_rows(scores, rows, k)
            bits = (scores[:, at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
            totals += _exact(bits, constant + sum(map(mul, query.tolist(), low)))
            places.append(at)
            asked += [query_id] * len(at)
        parts = [divmod(x, PART) for x in totals]
        found = np.concatenate(places) if places else np.zeros(0, np.int64)
        yield pd.DataFrame({"query_id": asked, "vec_id": ids[found], "high": [h for h, _ in parts], "low": [x for _, x in parts]})


def search(index: DataFrame, queries: DataFrame, k: int, rows: int, n_queries: int, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): of all rows but the query's own, the k largest inner products.

    Index and queries are dealt into a grid of cells, so that a task holds a few blocks of each. Blocks
    of queries are as large as memory allows, as the index is sent once for each; smaller ones are made
    only while cells are fewer than cores. Each cell gives k rows a query, from which the best k are ranked.
    """
    across, down = max(1, -(-rows // block_rows)), max(1, -(-n_queries // block_queries))
    cores = index.sparkSession.sparkContext.defaultParallelism
    down = max(down, min(-(-n_queries // min(LEAST_QUERIES, block_queries)), -(-2 * cores // across)))
    block_queries = max(1, -(-n_queries // down))
    ours = index.withColumn("i", F.pmod(F.xxhash64("block"), F.lit(across))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    theirs = query_blocks(queries.repartition(down), block_queries).withColumn("j", F.pmod(F.xxhash64("q_block"), F.lit(down)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))

    def cell(blocks: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        found = [x for b in blocks.itertuples() for x in _search_cell(b, qs[qs["dims"] == b.dims], k)] if len(qs) else []
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "high": [], "low": []}).astype("int64")

    hits = ours.groupBy("i", "j").cogroup(theirs.groupBy("i", "j")).applyInPandas(cell, _HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    whole = F.when(F.col("high") >= 2, F.lit(LARGEST)).when(F.col("high") < -2, F.lit(-LARGEST)).otherwise(F.shiftleft("high", 62).bitwiseOR(F.col("low")))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", whole.alias("score"))


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best rows for each query, a row whose vec_id is divisible by ``every``.

    Vectors that are null or hold null or non-finite components take no part, nor do rows with a
    null vec_id; vectors of other lengths are not compared. Scores of any size are ranked exactly; one
    that a long cannot hold is given as the largest (or smallest) that it can. Rows with the query's vec_id are its own.
    Where a vec_id is repeated, its smallest vector is the query, and each row is a candidate. Empty
    tables give no rows. Only vec_id and embedding are read.
    """
    rows = vectors(embeddings, scale)
    asked = staged(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    index = staged(build_index(rows, block_rows), "bit-slices")
    held = index.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)).alias("n")).first()["n"] // 8
    return search(index, asked, k, held, asked.count(), block_rows)


def op2_bit_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the 5 best of all embeddings for each fiftieth."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
