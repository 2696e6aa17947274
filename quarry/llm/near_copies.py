"""Near copies by SimHash: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

At that similarity about every seventh bit of two fingerprints differs, too many for balls around
whole segments. So the fingerprint is long, and the small Hamming ball within a segment is taken over
the bits whose votes were closest, as these are the ones that differ. Each text is stored under every
value of its balls; two texts meet where their differing bits of a segment are within both balls. Width
and number of segments follow from the number of rows, such that tables stay sparse and a pair at the
threshold is missed with at most the stated chance, at every size. Texts that meet are held together by
their complete distance, as a forest: a key of m texts writes at most m - 1 links. What hangs together is
then compared by the shingles themselves, in cells of bounded size; a text is only compared with groups that
it is not yet in, so a template with any number of copies writes one link for each, never pairs, and no pair
below the similarity is linked.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, skew_join, small_batches, staged
from .simhash import components, shingle_hashes
from .words import free_name

WORDS, SIMILARITY = 5, 0.8
#: Chance that a pair exactly at the similarity meets in no segment.
MISSED = 0.01
#: Bits of the fingerprint that the distance is taken over.
CHECKED = 256
#: Rows of a key that one task compares; keys with more are dealt to cells of two blocks each.
HOT_ROWS = 4096
#: Hot keys that are broadcast; more are shuffled.
FEW_KEYS = 100_000
#: Shingles and texts of a block of the exact check.
BLOCK_SHINGLES, BLOCK_TEXTS = 65_536, 512
#: Rows of a key that are compared pair by pair, many keys at once; more by a search from text to text.
FEW_ROWS = 64
_LANES = np.uint64(0x0101010101010101)
_PRINT = "row long, doc_id long, tie long, digest binary, n int, bits binary, unsure binary"
_MEET = "key long, node long, f0 long, f1 long, f2 long, f3 long"


def flip_rate(similarity: float) -> float:
    """Expected share of differing bits for two sets of one size and that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@lru_cache(maxsize=32)
def shape(rows: int, similarity: float = SIMILARITY, missed: float = MISSED) -> tuple[int, int, int]:
    """(width, count, unsure): segments wide enough for a few rows a key, as many as the chance of a miss
    needs, and the bits of a ball, chosen for the fewest stored rows. Votes are drawn as correlated normals."""
    width = min(32, max(16, math.ceil(math.log2(max(rows, 1))) - 2))
    rng, cosine = np.random.default_rng(7), 2 * similarity / (1 + similarity)
    a = rng.normal(size=(40_000, width))
    b = cosine * a + math.sqrt(1 - cosine**2) * rng.normal(size=a.shape)
    differ = (a > 0) != (b > 0)
    rank = lambda v: np.argsort(np.argsort(np.abs(v), axis=1), axis=1)
    closest = np.minimum(rank(a), rank(b))
    found = []
    for unsure in range(1, 6):
        meets = 1 - (differ & (closest >= unsure)).any(axis=1).mean()
        count = max(-(-CHECKED // width), math.ceil(math.log(missed) / math.log(1 - meets)))
        found.append((count << unsure, width, count, unsure))
    return min(found)[1:]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _votes(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """How many hashes of each run have each of 64 * ``words`` bits. Eight byte-wide counters share a word."""
    chunks = (sizes + 254) // 255
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    cuts = np.repeat(starts, chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(first, chunks))
    out = np.empty((len(sizes), 64 * words), np.int32)
    for j in range(words):
        mixed = _mixed(values + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        for k in range(8):
            sums = np.add.reduceat((mixed >> np.uint64(k)) & _LANES, cuts)
            counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int32), first)
            out[:, 64 * j + k : 64 * j + 64 : 8] = counts
    return out


def _prints(rows: DataFrame, width: int, count: int, unsure: int) -> DataFrame:
    """Of each row: a digest of its set of shingles, their number, the fingerprint, and each segment's closest bits."""
    words = -(-width * count // 64)

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy().view(np.uint64)
            sets = [np.unique(flat[a:b]) for a, b in zip(offsets, offsets[1:])]
            sizes = np.array([len(s) for s in sets], np.int64)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            bits, loose = [b""] * len(sets), [b""] * len(sets)
            at = np.flatnonzero(sizes)
            for part in np.array_split(at, int(sizes.sum()) // 250_000 + len(at) // 500 + 1) if len(at) else []:
                if not len(part):
                    continue
                n = sizes[part]
                votes = _votes(np.concatenate([sets[i] for i in part]), np.cumsum(n) - n, n, words)
                held = np.packbits(2 * votes > n[:, None], axis=1, bitorder="little")
                margin = np.abs(2 * votes[:, : width * count] - n[:, None]).reshape(len(part), count, width)
                near = np.argpartition(margin, unsure, axis=2)[:, :, :unsure].astype(np.uint8)
                for k, i in enumerate(part.tolist()):
                    bits[i], loose[i] = held[k].tobytes(), near[k].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(loose, pa.binary())], names=[x.split()[0] for x in _PRINT.split(", ")])
        release()

    return rows.mapInArrow(run, _PRINT)


def _meeting_rows(nodes: DataFrame, width: int, count: int, unsure: int) -> DataFrame:
    """Each text under every value of each segment's ball, with the bits that its distance is taken over."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                n = some.num_rows
                raw = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(n, -1)
                near = np.frombuffer(b"".join(some.column(2).to_pylist()), np.uint8).reshape(n, count, unsure).astype(np.uint64)
                bits = np.unpackbits(raw, axis=1, bitorder="little", count=width * count).reshape(n, count, width).astype(np.uint64)
                own = (bits << np.arange(width, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
                flips = [reduce(np.bitwise_xor, [np.uint64(1) << near[:, :, u] for u in range(unsure) if f >> u & 1], np.zeros_like(own)) for f in range(1 << unsure)]
                values = np.stack([own ^ f for f in flips], axis=2) | (np.arange(count, dtype=np.uint64)[None, :, None] << np.uint64(32))
                keys, each = _mixed(values.ravel()).view(np.int64), count << unsure
                four = raw[:, : CHECKED // 8].copy().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(some.column(0).to_numpy(), each)), *[pa.array(np.repeat(four[:, k], each)) for k in range(4)]], names=[x.split()[0] for x in _MEET.split(", ")])
        release()

    return nodes.select("node", "bits", "unsure").mapInArrow(run, _MEET)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of differing bits of each row of ``a`` from each row of ``b``."""
    return sum(np.bitwise_count(a[:, None, k] ^ b[None, :, k]).astype(np.int32) for k in range(a.shape[1]))


def _search(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over rows at most ``distance`` bits apart: a search that meets each row once, from the first row on."""
    left, found_a, found_b = np.arange(len(prints)), [], []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            some, frontier = frontier[:64], frontier[64:]
            near = _apart(prints[some], prints[left]) <= distance
            hit = near.any(axis=0)
            found_a.append(some[near[:, hit].argmax(axis=0)])
            found_b.append(left[hit])
            frontier, left = np.concatenate([frontier, left[hit]]), left[~hit]
    none = [np.empty(0, np.int64)]
    return np.concatenate(found_a or none), np.concatenate(found_b or none)


def _forest(keys: np.ndarray, nodes: np.ndarray, prints: np.ndarray, distance: int) -> np.ndarray:
    """(a, b) of rows, sorted by key, such that rows of a key at most ``distance`` bits apart hang together; fewer than rows."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    found_a, found_b = [], []
    for start, n in zip(starts[sizes > FEW_ROWS].tolist(), sizes[sizes > FEW_ROWS].tolist()):
        a, b = _search(prints[start : start + n], distance)
        found_a.append(a + start)
        found_b.append(b + start)
    later = np.repeat(starts + sizes, sizes) - np.arange(len(keys)) - 1  # later rows of the same key
    rows = np.flatnonzero((later > 0) & (np.repeat(sizes, sizes) <= FEW_ROWS))
    upto = np.cumsum(later[rows])
    for block in np.split(rows, np.searchsorted(upto, np.arange(400_000, int(upto[-1]) if len(upto) else 0, 400_000))):
        m = later[block]
        i = np.repeat(block, m)
        j = i + 1 + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        ok = (np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int32) <= distance) if len(i) else np.empty(0, bool)
        i, j = i[ok], j[ok]
        label = np.arange(len(keys)) if len(i) else None
        while len(i):  # the smallest row of what hangs together, by steps from label to label
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if np.array_equal(before, label):
                break
        if len(i):
            member = np.unique(j)
            found_a.append(label[member])
            found_b.append(member)
    if not found_a:
        return np.empty((0, 2), np.int64)
    a, b = nodes[np.concatenate(found_a)], nodes[np.concatenate(found_b)]
    pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _meeting_links(rows: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) of the texts that meet; a task holds about one batch and its last key's rows."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def links():
            t = pa.Table.from_batches(held)
            prints = np.stack([t.column(f"f{k}").to_numpy() for k in range(4)], axis=1).view(np.uint64)
            found = _forest(t.column("key").to_numpy(), t.column("node").to_numpy(), prints, distance)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if cut:
                held[-1] = batch.slice(0, cut)
                yield links()
                held = [batch.slice(cut)]
        if held:
            yield links()
        held.clear()
        release()

    dealt = rows.select("key", "node", "f0", "f1", "f2", "f3").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _dealt(meeting: DataFrame, n: int, hot_rows: int) -> DataFrame:
    """The meeting rows; those of a hot key go to one cell for each other block of that key.

    All keys are counted: first by groups of keys (as many as rows), then one by one in groups with enough rows.
    """
    group = F.col("key").bitwiseAND(F.lit((1 << max(10, math.ceil(math.log2(max(n, 2))))) - 1))
    crowded = staged(meeting.groupBy(group.alias("of")).count().filter(F.col("count") > hot_rows).select("of"), "crowded-keys")
    n_crowded = crowded.count()
    if not n_crowded:
        return meeting
    small = (lambda t: F.broadcast(t)) if n_crowded <= FEW_KEYS else (lambda t: t)
    counts = meeting.select("key", group.alias("of")).join(small(crowded), "of", "left_semi").groupBy("key").count().filter(F.col("count") > hot_rows)
    hot = staged(counts.select("key", F.ceil(F.col("count") / (hot_rows / 2)).cast("int").alias("blocks")), "hot-keys")
    few = hot.count() <= FEW_KEYS
    rows = meeting.join(F.broadcast(hot) if few else hot, "key", "left")
    own = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    return rows.withColumn("c", F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(cells))).select(F.col("c").alias("key"), "node", "f0", "f1", "f2", "f3")


_CELL = ("cell", "root", "node", "grp", "h", "bits")


def _linked(cells: DataFrame, similarity: float, distance: int) -> DataFrame:
    """Links (a, b) of the texts of each cell whose sets of shingles are that similar, fewer than texts. A text is
    compared with texts of its ``root`` whose fingerprints are close and that are not in its group yet."""

    def check(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in frame.sort_values("node").groupby("root", sort=False):
            sets, nodes = own["h"].tolist(), own["node"].to_numpy()
            sizes = np.array([len(x) for x in sets])
            prints = np.frombuffer(b"".join(x[: CHECKED // 8] for x in own["bits"]), np.uint64).reshape(len(nodes), -1)
            label = np.unique(own["grp"].to_numpy(), return_inverse=True)[1]
            for i in range(1, len(nodes)):
                other = np.flatnonzero(label[:i] != label[i])
                if not len(other):
                    continue
                apart = _apart(prints[i : i + 1], prints[other])[0]
                fits = (apart <= distance) & (np.minimum(sizes[other], sizes[i]) >= similarity * np.maximum(sizes[other], sizes[i]))
                other = other[fits][np.argsort(apart[fits], kind="stable")]
                while len(other):
                    j = int(other[0])
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both >= similarity * (sizes[i] + sizes[j] - both):
                        out.append((nodes[j], nodes[i]))
                        label[label == label[j]] = label[i]
                    other = other[1:]
                    other = other[label[other] != label[i]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return cells.select(*_CELL).groupBy("cell").applyInPandas(check, "a long, b long")


def _blocks(n, m):
    return F.greatest(F.lit(1), F.ceil(n / BLOCK_SHINGLES), F.ceil(m / BLOCK_TEXTS)).cast("int")


def _grouped(placed: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``placed`` with the group that each text is in by the links so far."""
    joined = components(links).withColumnRenamed("root", "of_grp")
    return staged(placed.drop("grp").join(joined, "node", "left").withColumn("grp", F.coalesce("of_grp", "node")).drop("of_grp"), name)


def _similar(near: DataFrame, classes: DataFrame, texts: DataFrame, size: int, similarity: float, distance: int) -> DataFrame:
    """Links between texts whose sets of shingles are that similar; a text has few, however many are like it.

    What hangs together by ``near`` is one cell if it is small. Else it is cut into blocks: texts are compared
    within their block, then one text of each group with those of other blocks, again in blocks as long as these
    are several and groups are joined; and what still is not one group, block by block, but for the texts of its
    largest group among themselves.
    """
    hung = skew_join(classes.select("node", "n", "bits"), components(near), "node")
    sums = hung.groupBy("root").agg(F.sum("n").alias("sum_n"), F.count("*").alias("m")).withColumn("blocks", _blocks(F.col("sum_n"), F.col("m")))
    sums = staged(sums, "hung-together")
    total = sums.agg(F.coalesce(F.sum("sum_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()
    shared = max(1, 2 * total["n"] // BLOCK_SHINGLES, 2 * total["m"] // BLOCK_TEXTS)
    placed = staged(skew_join(hung, sums.select("root", "blocks"), "root", by="node").withColumn("grp", F.col("node")), "placed")
    sets = staged(texts.join(placed.select("node"), "node", "left_semi").select("node", F.array_sort(F.array_distinct(shingle_hashes(F.col("text"), size))).alias("h")), "sets")
    block = lambda salt, count: F.pmod(F.xxhash64(F.lit(salt), "node"), count).cast("int")
    cell = F.when(F.col("blocks") == 1, F.xxhash64(F.lit("small"), F.pmod(F.xxhash64("root"), F.lit(shared)))).otherwise(F.xxhash64(F.lit("block"), "root", block("first", F.col("blocks"))))
    links = staged(_linked(placed.withColumn("cell", cell).join(sets, "node"), similarity, distance), "links")
    many = placed.filter("blocks > 1")
    if many.isEmpty():
        return links
    for turn in range(64):
        grouped = _grouped(many, links, "grouped")
        one = grouped.groupBy("root", "grp").agg(F.min(F.struct("node", "n", "bits")).alias("t")).select("root", "grp", "t.node", "t.n", "t.bits")
        counts = one.groupBy("root").agg(F.sum("n").alias("sum_n"), F.count("*").alias("m"))
        counts = staged(counts.select("root", _blocks(F.col("sum_n"), F.col("m")).alias("blocks")), "groups")
        chosen = skew_join(one, counts, "root", by="node")
        found = staged(_linked(chosen.withColumn("cell", F.xxhash64(F.lit(f"one {turn}"), "root", block(f"one {turn}", F.col("blocks")))).join(sets, "node"), similarity, distance), "links")
        links = links.unionByName(found)
        if counts.filter("blocks > 1").isEmpty() or found.isEmpty():  # each turn leaves about one group a block of the turn before
            break
    grouped = _grouped(many, links, "grouped")
    sizes = grouped.groupBy("root", "grp").agg(F.count("*").alias("m"), F.sum("n").alias("sum_n"))
    main = staged(sizes.groupBy("root").agg(F.max(F.struct("m", "sum_n", "grp")).alias("main"), (F.sum("m") - F.max("m")).alias("rest_m"), F.sum("sum_n").alias("all_n"), F.count("*").alias("groups")).filter("groups > 1"), "several-groups")
    if main.isEmpty():
        return links
    shape_of = main.select("root", F.col("main.grp").alias("main"), _blocks(F.col("main.sum_n"), F.col("main.m")).alias("of_main"), _blocks(F.col("all_n") - F.col("main.sum_n"), F.col("rest_m")).alias("of_rest"))
    sided = skew_join(grouped, shape_of, "root", by="node")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    own = block("rest", F.col("of_rest"))
    rest = F.concat(F.transform(upto(F.col("of_main")), lambda j: F.xxhash64(F.lit("main"), "root", own, j)), F.transform(upto(F.col("of_rest")), lambda j: F.xxhash64(F.lit("rest"), "root", F.least(own, j), F.greatest(own, j))))
    largest = F.transform(upto(F.col("of_rest")), lambda i: F.xxhash64(F.lit("main"), "root", i, block("main", F.col("of_main"))))
    crossed = sided.withColumn("cell", F.explode(F.when(F.col("grp") == F.col("main"), largest).otherwise(rest)))
    return links.unionByName(staged(_linked(crossed.join(sets, "node"), similarity, distance), "links"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, size: int = WORDS, missed: float = MISSED, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest doc_id, of one doc_id that with the smallest hash
    of its text, of equal rows any one.

    A group is what hangs together by links: texts whose sets of shingles (of ``size`` lower-cased
    words; shorter texts have one, of all their words) have at least this Jaccard similarity. Texts
    without words are equal to each other and to no other. A null doc_id comes after all others and is
    kept where its group has no other. Rows are told apart by their number, never by doc_id, so rows of
    one doc_id with other texts stay. An empty table stays empty; other columns are left as they are.
    """
    name = free_name(docs, "q_row")
    rows = staged(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    n = rows.count()
    shaped = shape(1 << math.ceil(math.log2(max(n, 1))), similarity, missed)
    hashed = rows.select(F.col(name).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"), shingle_hashes(F.col("text"), size).alias("h"))
    with small_batches(docs.sparkSession):
        prints = staged(_prints(hashed, *shaped), "prints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "row")).alias("best")
    classes = staged(prints.groupBy("digest").agg(best, F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("unsure").alias("unsure")).withColumn("node", F.col("best.row")), "classes")
    nodes = classes.filter("n > 0").select("node", "bits", "unsure")
    rate = flip_rate(similarity)
    distance = int(CHECKED * rate + 3.5 * math.sqrt(CHECKED * rate * (1 - rate)))
    near = staged(_meeting_links(_dealt(_meeting_rows(nodes, *shaped), n, hot_rows), distance).distinct(), "near")
    texts = rows.select(F.col(name).alias("node"), "text")
    root = components(_similar(near, classes, texts, size, similarity, distance))
    kept = classes.join(root, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    gone = staged(prints.select("row").join(kept, "row", "left_anti").withColumnRenamed("row", name), "dropped")
    return rows.join(gone, name, "left_anti").drop(name).select(*[f"`{c}`" for c in docs.columns])
