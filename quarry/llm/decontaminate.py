"""Benchmark decontamination by winnowing.

A window is a run of item words (an item with fewer is one window). Of all k-grams of a text, only the
minimum of each sliding run of k-grams is kept, by hash. The run is as long as a window holds k-grams, so a
window that occurs in a document brings at least one kept k-gram that item and document share. Kept k-grams
of documents first meet a bitmap of the items' hashes (its size follows from their number and is bounded),
and those that stay are extended to the windows around them, which join the items' windows by their whole
text. So every shared window is found, and nothing else is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_words import Words, mixed, slices, words_of
from .shared import release, small_batches, staged

WINDOW, GRAM = 10, 5
#: Distinct windows that are broadcast; more are shuffled.
FEW_WINDOWS = 200_000
#: Bits of the bitmap: 16 for each hash, within these powers of two (128 KiB to 16 MiB).
BITMAP_POWERS = (20, 27)
_BLOCK = 15  # bits of a position within one block of the bitmap: 4096 bytes
NAMES = ["row", "id", "n_words", "start", "words", "text"]


def gram_size(words: int) -> int:
    return min(GRAM, words)


def kept_grams(w: Words, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the k-grams that winnowing keeps for windows of that many words: of each run of
    k-grams that a window holds the minimum, the last of equal ones."""
    k = gram_size(words)
    runs = len(w.hashes) - words + 1
    if runs < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = np.zeros(len(w.hashes) - k + 1, np.uint64)
    for t in range(k):
        grams += w.hashes[t : t + len(grams)] * np.uint64((2 * t + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    grams = mixed(grams ^ np.uint64(words))
    best, at = grams[:runs].copy(), np.zeros(runs, np.int64)
    for t in range(1, words - k + 1):
        other = grams[t : t + runs]
        lower = other <= best
        np.copyto(best, other, where=lower)
        at[lower] = t
    whole = np.flatnonzero(w.row[:runs] == w.row[words - 1 : words - 1 + runs])  # windows of one row
    chosen = np.zeros(len(grams), bool)
    chosen[whole + at[whole]] = True
    places = np.flatnonzero(chosen)
    return places, grams[places]


def _windows_around(w: Words, places: np.ndarray, words: int) -> np.ndarray:
    """First words of the windows that hold one of the k-grams at ``places``."""
    starts = np.unique(places[:, None] - np.arange(words - gram_size(words) + 1)[None, :])
    starts = starts[(starts >= 0) & (starts + words <= len(w.row))]
    return starts[w.row[starts] == w.row[starts + words - 1]]


def _window_rows(rows: DataFrame, lengths: list[int], bitmap: np.ndarray | None) -> DataFrame:
    """Of (row, id, text): one line (row, id, n_words) for each row, and a line (row, start, words, text) for each
    window: every one without a bitmap, else those around a kept k-gram whose hash is in it."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield from found(part)
        release()

    def found(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        w = words_of(part.column("text"))
        ids = part.column("row").to_numpy()
        n = np.bincount(w.row, minlength=len(ids)).astype(np.int64)
        none = pa.nulls(len(ids), pa.int32())
        yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array(n), none, none, pa.nulls(len(ids), pa.string())], names=NAMES)
        first = np.cumsum(n) - n
        for words in lengths:
            if bitmap is None:
                starts = np.arange(max(0, len(w.row) - words + 1))
                starts = starts[(w.row[starts] == w.row[starts + words - 1]) & ((n[w.row[starts]] == words) | (words == WINDOW))]  # fewer words: one window of them all
            else:
                places, hashes = kept_grams(w, words)
                slot = hashes & np.uint64(8 * len(bitmap) - 1)
                hit = (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
                starts = _windows_around(w, places[hit.astype(bool)], words)
            for some in np.array_split(starts, len(starts) // 20_000 + 1):
                k = len(some)
                if k:
                    of = w.row[some]
                    texts = pa.array([w.text(i, words) for i in some.tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.nulls(k, part.schema.field("id").type), pa.nulls(k, pa.int64()), pa.array((some - first[of]).astype(np.int32)), pa.array(np.full(k, words, np.int32)), texts], names=NAMES)

    return rows.select("row", "id", "text").mapInArrow(run, f"row long, id {id_type}, n_words long, start int, words int, text string")


def _gram_rows(windows: DataFrame) -> DataFrame:
    """The hash of the k-gram that winnowing keeps of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words in np.unique(batch.column("words").to_numpy()).tolist():
                some = batch.filter(pc.equal(batch.column("words"), words))
                out.append(kept_grams(words_of(some.column("text")), words)[1].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.empty(0, np.int64))], names=["hash"])

    return windows.select("words", "text").mapInArrow(run, "hash long")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The bitmap of the hashes, built by Spark in blocks of 4096 bytes; its size is bounded, however many hashes there are."""
    n = max(1, hashes.count())
    power = min(max((16 * n).bit_length(), BITMAP_POWERS[0]), BITMAP_POWERS[1])
    slot = F.col("hash").bitwiseAND(F.lit((1 << power) - 1))
    blocks = hashes.select(F.shiftright(slot, _BLOCK).alias("block"), slot.bitwiseAND(F.lit((1 << _BLOCK) - 1)).alias("bit"))
    out = np.zeros(1 << power - 3, np.uint8)
    for r in blocks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        out[r["block"] << _BLOCK - 3 : r["block"] + 1 << _BLOCK - 3] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, contaminated) of each document.

    Needs doc_id and text of ``docs``, item_id and text of ``items``; other columns are left aside. A word is
    hit where any occurrence of a window covers it; ``item_ids`` are the items with a window in the document,
    as strings in order. Null and empty texts have no words. Documents are told apart by row, so repeated and
    null doc_ids stay rows of their own. Rows of one item_id are texts of one item; items without an id hit
    words but are not counted. Empty tables give no rows, or documents without hits.
    """
    spark = docs.sparkSession
    numbered = lambda t, key: t.select(F.monotonically_increasing_id().alias("row"), key.alias("id"), F.col("text").cast("string").alias("text"))
    bench = staged(numbered(items, F.col("item_id").cast("string")), "items")
    with small_batches(spark):
        sizes = _window_rows(bench, [], None).select(F.least("n_words", F.lit(WINDOW)).alias("n")).distinct().collect()  # eleven values at most
        lengths = sorted(r["n"] for r in sizes if r["n"])
        of_items = staged(_window_rows(bench, lengths, None).filter("words IS NOT NULL").select("row", "words", "text"), "item-windows")
        windows = staged(of_items.select("words", "text").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
        bitmap = _bitmap(_gram_rows(windows).distinct())
        found = staged(_window_rows(numbered(docs, F.col("doc_id")), lengths, bitmap), "document-windows")
    few = windows.count() <= FEW_WINDOWS
    known = F.broadcast(windows.select("text", "window")) if few else windows.select("text", "window")
    hits = staged(found.filter("words IS NOT NULL").select("row", "start", "words", "text").join(known, "text").select("row", "start", "words", "window"), "hits")
    spans = F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("words")).alias("end"))))
    longer = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["upto"], x["start"]))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto"))
    counted = hits.groupBy("row").agg(F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), longer, lambda s: s["n"]).cast("long").alias("n_hit"))
    of_window = of_items.join(known, "text").join(bench.select("row", F.col("id").alias("item_id")), "row").filter("item_id IS NOT NULL").select("window", "item_id").distinct()
    listed = hits.select("row", "window").distinct().join(of_window, "window").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = found.filter("words IS NULL").select("row", F.col("id").alias("doc_id"), "n_words").join(counted, "row", "left").join(listed, "row", "left")
    held = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(held).cast("long").alias("n_items"), held.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: what each document shares with the benchmark."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), {WINDOW}) AS m, array_to_string(w[s + 1 : s + least(len(w), {WINDOW})], ' ') AS t FROM (SELECT item_id, w, unnest(range(0, len(w) - least(len(w), {WINDOW}) + 1)) AS s FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT r, s, m, array_to_string(w[s + 1 : s + m], ' ') AS t FROM (SELECT r, w, m, unnest(range(0, len(w) - m + 1)) AS s FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
h AS (SELECT r, s, m, t FROM dw SEMI JOIN iw USING (m, t)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS p FROM h) GROUP BY r),
i AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM (SELECT DISTINCT r, m, t FROM h) JOIN iw USING (m, t) WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)"""
