"""SimHash near-duplicates: 64-bit fingerprints, multi-index hashing, connected components.

Links are found between distinct fingerprints only, so copies cost nothing. Each fingerprint is cut
into segments; by the pigeonhole principle two fingerprints within the distance agree, in at least
one segment, within that segment's small Hamming ball. Every fingerprint is stored once for each
segment and looks up each value in the ball around it. Rows that meet under one value are verified
by their complete distance and give a star to the smallest member of each linked set, never all
pairs. A value under which too many rows meet is refined: of four blocks of the remaining bits at
least one is equal, so those rows meet again under longer keys, exactly, until each key is small.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import skew_join, spread_join, staged
from .words import ascii_lower, let, windows, words

BITS = 64
#: More rows than this under one key are refined; four refinements leave at most 2 ** 14 fingerprints a key.
HOT_ROWS = 8192
REFINEMENTS = 4
_LANES = np.uint64(0x0101010101010101)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shingle_hashes(text, size: int = 3):
    """XXH64 (seed 42) of each run of ``size`` lower-cased words, repeats included; fewer words: of them all."""
    ws = words(ascii_lower(text))
    return let(ws, lambda w: F.when(F.size(w) >= size, windows(w, size, lambda x: F.xxhash64(F.concat_ws(" ", *x))))
               .when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>")))


def majority_bits(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits set in over half of them. Eight byte-wide counters share a word."""
    out = np.zeros(len(sizes), np.uint64)
    at = np.flatnonzero(sizes)
    if not len(at):
        return out
    sizes, starts = sizes[at], starts[at]
    chunks = (sizes + 254) // 255
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    within = np.arange(chunks.sum()) - np.repeat(first, chunks)
    cuts = np.repeat(starts, chunks) + 255 * within
    fp = np.zeros(len(at), np.uint64)
    for k in range(8):
        sums = np.add.reduceat((values >> np.uint64(k)) & _LANES, cuts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first)
        for lane in range(8):
            fp |= (2 * counts[:, lane] > sizes).astype(np.uint64) << np.uint64(8 * lane + k)
    out[at] = fp
    return out


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) of each document. Null and wordless texts have fingerprint zero; repeated rows stay."""

    def vote(batches):
        for b in batches:
            lists = b.column(1).combine_chunks() if isinstance(b.column(1), pa.ChunkedArray) else b.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy().view(np.uint64)[offsets[0] : offsets[-1]]
            fp = majority_bits(values, offsets[:-1] - offsets[0], np.diff(offsets))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), shingle_hashes(F.col("text"), size).alias("h"))
    return rows.mapInArrow(vote, "doc_id long, fp long")


def segments(distance: int, count: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, ball radius) of each segment. If every segment exceeded its radius, the
    sum would exceed the distance; a radius of -1 needs no look-up and is left out."""
    edges = [round(k * BITS / count) for k in range(count + 1)]
    base, rest = divmod(distance, count)
    found = [(a, b - a, base if k <= rest else base - 1) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    return [s for s in found if s[2] >= 0]


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _blocks(mask: int, count: int) -> list[int]:
    bits = [b for b in range(BITS) if mask >> b & 1]
    edges = [round(k * len(bits) / count) for k in range(count + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(edges, edges[1:])]


def meeting_rows(fps: DataFrame, distance: int, parts: list[tuple[int, int, int]]) -> DataFrame:
    """(path, key, fp, member): each fingerprint under its own value of each segment, as member, and
    under every other value of the ball around it, looking for members."""
    fp = F.col("fp")
    rows = []
    for k, (low, width, radius) in enumerate(parts):
        own = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        rows += [F.struct(F.lit(k).alias("path"), F.xxhash64(F.lit(k), own.bitwiseXOR(F.lit(flip).cast("long"))).alias("key"), F.lit(flip == 0).alias("member")) for flip in _ball(width, radius)]
    return fps.select("fp", F.explode(F.array(*rows)).alias("r")).select("r.path", "r.key", "fp", "r.member")


def _stars(keys: np.ndarray, fps: np.ndarray, member: np.ndarray, distance: int):
    """(a, b) of rows sorted by key: each fingerprint and the smallest of those it is linked with under its key."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    found = []
    small = np.repeat(sizes, sizes) <= 64
    heads = np.repeat(starts, sizes)
    lengths = np.repeat(sizes, sizes)
    ours = np.flatnonzero(member & (lengths > 1) & small)  # each member against all rows of its small group
    for block in np.array_split(ours, max(1, int(lengths[ours].sum()) // 2_000_000 + 1)) if len(ours) else []:
        n = lengths[block]
        i = np.repeat(block, n)
        j = np.repeat(heads[block], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ok = (np.bitwise_count(fps[i] ^ fps[j]) <= distance) & (fps[i] != fps[j])
        found.append((i[ok], j[ok]))
    for s, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        group = fps[s : s + n]
        ours = np.flatnonzero(member[s : s + n])
        for block in np.array_split(ours, len(ours) * n // 4_000_000 + 1) if len(ours) else []:
            i, j = np.nonzero(np.bitwise_count(group[block][:, None] ^ group[None, :]) <= distance)
            i = block[i]
            ok = group[i] != group[j]
            found.append((i[ok] + s, j[ok] + s))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*found))
    label = np.arange(len(fps))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    at = np.flatnonzero(label != np.arange(len(label)))
    return fps[at].view(np.int64), fps[label[at]].view(np.int64)


def _verify(rows: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) from rows that meet under a key; a task holds about one batch and its last key's rows."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def stars(table):
            key = table.column("key").to_numpy()
            fps = table.column("fp").to_numpy().view(np.uint64)
            a, b = _stars(key, fps, table.column("member").to_numpy(), distance)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if cut:
                held[-1] = batch.slice(0, cut)
                yield stars(pa.Table.from_batches(held))
                held = [batch.slice(cut)]
        if held:
            yield stars(pa.Table.from_batches(held))

    dealt = rows.select("key", "fp", "member").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, distance: int = 3, count: int = 3, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, such that two fingerprints within ``distance`` bits
    are always in one connected component, and no others are joined."""
    parts = segments(distance, count)
    masks = {k: ((1 << width) - 1) << low for k, (low, width, _) in enumerate(parts)}  # bits that a path has fixed
    rows, edges = meeting_rows(fps, distance, parts), None
    for level in range(REFINEMENTS + 1):
        hot = staged(rows.groupBy("key").count().filter(F.col("count") > hot_rows).select("key"), "hot-keys")
        last = level == REFINEMENTS or hot.isEmpty()
        calm = rows if last else rows.join(hot, "key", "left_anti")
        found = _verify(calm, distance)
        edges = found if edges is None else edges.unionByName(found)
        if last:
            break
        # More keys of equal bits: the differing bits are at most ``distance``, so of one block more than that one is equal.
        finer, options = {}, []
        for path, fixed in sorted(masks.items()):
            for block in _blocks(((1 << BITS) - 1) & ~fixed, distance + 1):
                finer[len(finer)] = fixed | block
                options.append((path, len(finer) - 1, block))
        by_path = F.array(*[F.array(*[F.struct(F.lit(c).alias("path"), F.lit(_signed(m)).alias("block")) for p, c, m in options if p == path]) for path in sorted(masks)])
        rows = (
            rows.join(hot, "key", "left_semi")
            .select("fp", "member", "key", F.explode(F.get(by_path, F.col("path"))).alias("r"))
            .select("r.path", F.xxhash64("key", "r.path", F.col("fp").bitwiseAND(F.col("r.block"))).alias("key"), "fp", "member")
        )
        masks = finer
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge, the root being one fixed node of its component.

    Each round sends every node to the smallest neighbour of its smallest neighbour, rewrites the
    edges to these and drops loops; what is left shrinks until no edge remains. Every round is
    written to the shared folder, so lineage stays short and a lost executor repeats one round.
    """
    live = staged(edges.filter("a != b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        down = staged(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("to")), "steps")
        twice = skew_join(down, down.select(F.col("node").alias("to"), F.col("to").alias("then")), "to", "left", by="node")
        step = staged(twice.select("node", F.coalesce("then", "to").alias("root")), "steps")
        rounds.append(step)
        for end, other in (("a", "b"), ("b", "a")):  # a hub has an edge to each of its nodes
            live = skew_join(live, step.withColumnRenamed("node", end), end, by=other).drop(end).withColumnRenamed("root", end)
            live = live if end == "b" else staged(live, "half-edges")
        live = staged(live.filter("a != b").select("a", "b").distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0]
    for step in rounds[1:]:
        then = step.select(F.col("node").alias("root"), F.col("root").alias("then"))
        out = staged(skew_join(out, then, "root", "left", by="node").select("node", F.coalesce("then", "root").alias("root")), "roots")
    return out


def near_duplicates(docs: DataFrame, distance: int = 3, size: int = 3, count: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of each document: the smallest doc_id reachable over links of at
    most ``distance`` differing bits, itself included.

    Needs doc_id and text; other columns are left aside. Null and empty texts have fingerprint zero
    and are linked like any other; a null doc_id is linked too but names a component only where
    there is no other (then null); repeated rows stay; an empty table gives no rows.
    """
    rows = staged(fingerprints(docs, size), "fingerprints")
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    root = components(links(fps.select("fp"), distance, count)).withColumnRenamed("node", "fp")
    rooted = staged(fps.join(root, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    least = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), "least")
    named = spread_join(rooted, least, "root", "m", fps.count(), F.col("fp")).select("fp", "n", "component_id")  # a large component or
    return spread_join(rows, named, "fp", "n", rows.count(), F.col("doc_id")).select("doc_id", "fp", "component_id")  # many copies may be hot


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's fingerprint and component."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
