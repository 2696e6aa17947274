"""Packing by non-negative least squares over shallow length combinations.

Documents are cut into whole windows and one rest. Rests are counted in bins of a few tokens; their
histogram has at most ``window / unit`` counts at any size of input, so the plan is made on the
driver. It lists the ways in which one, two or three bins fill the window exactly, solves how often
each is to be used (non-negative least squares against the histogram), rounds these numbers down,
and packs what is left greedily, largest first. The plan says which ranks of each bin go to which
sequences; Spark ranks the pieces and joins them to it.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import release, small_batches, staged
from .tokens import encoder, id_type, text_blocks

#: Tokens by which rests are binned: a sequence wastes less than this for each piece it holds.
UNIT = 8
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, bin int, ord long, ids binary"
_PLAN = "bin int, lo long, hi long, first_sequence long, slot int"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, unit: int = UNIT, keep_ids: bool = False) -> DataFrame:
    """The pieces of every whole text: encoded, ended by ``end_id``, cut at each full window.

    Null and empty texts are one piece that holds ``end_id`` alone; a null doc_id stays null;
    repeated rows are cut each for itself; only doc_id and text are read. ``part`` and ``ord``
    number the pieces of a bin within the task that made them. With ``keep_ids`` the ids come along.
    """

    def cut(batches):
        enc = encoder(tokenizer)
        width = id_type(max(enc._tok.get_vocab_size(), end_id + 1))
        end = np.array([end_id], width)
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            texts, keys = batch["text"].tolist(), batch["doc_id"].tolist()
            for a, b in text_blocks(texts):
                out = []
                for key, raw in zip(keys[a:b], enc.encode(texts[a:b]), strict=True):
                    ids = np.concatenate([np.frombuffer(raw, enc.dtype).astype(width, copy=False), end])
                    wide = ids.astype("<u4").tobytes()
                    for start in range(0, len(ids), window):
                        n = min(window, len(ids) - start)
                        size = -(-n // unit)
                        out.append((key, start, n, zlib.crc32(wide[4 * start : 4 * (start + n)]), len(ids), part, size, seen[size], ids[start : start + n].tobytes() if keep_ids else None))
                        seen[size] += 1
                made = pd.DataFrame(out, columns=[x.split()[0] for x in _PIECE.split(", ")])
                made["doc_id"] = made["doc_id"].astype("Int64")
                yield made
            release()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(cut, _PIECE)


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with the least ||a x - b||: columns join while they lower the residual, and leave at zero."""
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[on] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9:
            break
        on[best] = True
        while True:
            trial = np.zeros_like(x)
            trial[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            low = on & (trial <= 0)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x += step * (trial - x)
            on &= x > 1e-12
            x[~on] = 0
        x = trial
    return x


def combinations(bins: int) -> list[tuple[int, ...]]:
    """One, two or three bins that fill the window exactly."""
    pairs = [(a, bins - a) for a in range(bins - 1, (bins - 1) // 2, -1)]
    triples = [(a, b, bins - a - b) for a in range(bins - 2, 0, -1) for b in range(min(a, bins - a - 1), 0, -1) if bins - a - b <= b]
    return [(bins,), *pairs, *triples]


def plan(histogram: dict[int, int], bins: int) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a sequence, number of such sequences), covering the histogram exactly."""
    left = np.zeros(bins + 1, np.int64)
    for k, n in histogram.items():
        left[k] += n
    out = []
    if full := int(left[bins]):
        out.append(((bins,), full))
        left[bins] = 0
    if total := int(left.sum()):
        usable = [c for c in combinations(bins) if all(left[k] for k in c)]
        a = np.zeros((bins + 1, len(usable)))
        for j, c in enumerate(usable):
            for k in c:
                a[k, j] += 1
        x = nonnegative_least_squares(a, left / total) * total if usable else np.zeros(0)
        for j in np.argsort(-x, kind="stable"):
            need = Counter(usable[j])
            if n := min(int(x[j]), *(int(left[k]) // m for k, m in need.items())):
                out.append((usable[j], n))
                for k, m in need.items():
                    left[k] -= m * n
    while left.any():  # each round uses up at least one bin, but for less than a sequence's worth
        trial, room, chosen = left.copy(), bins, []
        while (fits := np.flatnonzero(trial[: room + 1])).size:
            k = int(fits[-1])
            m = min(int(trial[k]), room // k)
            chosen += [k] * m
            trial[k] -= m
            room -= k * m
        need = Counter(chosen)
        n = min(int(left[k]) // m for k, m in need.items())
        out.append((tuple(chosen), n))
        for k, m in need.items():
            left[k] -= m * n
    return out


def pack(cut: DataFrame, window: int = 2048, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to staged ``pieces``; offsets are gapless from 0 in each sequence.

    The order in which equal bins fill their places is that of (part, ord). No piece is left out;
    an empty table gives no sequences.
    """
    spark, bins = cut.sparkSession, window // unit
    counts = cut.groupBy("part", "bin").agg(F.count("*").alias("n"))
    base = F.sum("n").over(Window.partitionBy("bin").orderBy("part")) - F.col("n")
    histogram = {r["bin"]: r["n"] for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    rows, used, first = [], Counter(), 0
    for chosen, n in plan(histogram, bins):
        for slot, k in enumerate(chosen):
            rows.append((k, used[k], used[k] + n, first, slot))
            used[k] += n
        first += n
    places = spark.createDataFrame(rows, _PLAN)  # as many rows as the plan, whose size the window bounds
    ranked = cut.join(counts.withColumn("base", base).select("part", "bin", "base"), ["part", "bin"]).withColumn("rank", F.col("base") + F.col("ord"))
    placed = ranked.join(F.broadcast(places), (ranked["bin"] == places["bin"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("lo")).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))


def packed_pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, unit: int = UNIT) -> DataFrame:
    """Every piece of every document with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    with small_batches(docs.sparkSession):
        cut = staged(pieces(docs, tokenizer, end_id, window, unit).drop("ids"), "pieces")
    return pack(cut, window, unit).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def packed_sequences(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, unit: int = UNIT) -> DataFrame:
    """The sequences themselves: sequence_id, ids (little-endian unsigned, at most a window), doc_ids and offsets of the pieces."""
    with small_batches(docs.sparkSession):
        cut = staged(pieces(docs, tokenizer, end_id, window, unit, keep_ids=True), "pieces")
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))
    one = pack(cut, window, unit).groupBy("sequence_id").agg(held.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return one.select("sequence_id", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.offset").alias("offsets"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every piece of every document, packed into windows of 2048."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
