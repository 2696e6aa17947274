"""Token-ID / binary output: flat unsigned integer files with 64-bit document offsets, memory-mapped.

A dataset is a folder of shards in ascending document order. Shard ``k`` is three flat files:

* ``k.bin``  the ids, little-endian unsigned, 16 bits if every id fits, else 32;
* ``k.idx``  the offsets in ids, little-endian unsigned 64-bit: one for each document, then the end;
* ``k.doc``  the document ids, little-endian signed 64-bit (0 where null; nulls come first).

Texts are dealt by range of doc_id and encoded where their shard is written, so ids are written once.
``manifest`` (Parquet, one row for each shard) has the counts and, from prefix sums in two levels,
each shard's first document and first id in the whole dataset.
"""

from __future__ import annotations

import itertools
import os
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_folder, small_batches, task_files
from .tokens import encoder, id_type, text_blocks

_SHARD = "shard int, file string, n_docs long, n_null long, n_tokens long, width int"
MANIFEST = f"{_SHARD}, first_doc long, first_token long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Bytes of text for each shard that is written.
SHARD_BYTES = 32 << 20
#: Shards whose counts are summed up together, before the sums of such runs are.
RUN = 4096


def _based(counts: DataFrame) -> DataFrame:
    """Adds first_doc and first_token: sums over the shards before, within runs of shards and over the runs."""
    rows = counts.withColumn("run", (F.col("shard") / RUN).cast("int"))
    before = Window.partitionBy("run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("run").agg(F.sum("n_docs").alias("n"), F.sum("n_tokens").alias("t"))
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row for each 4096 shards
    bases = runs.select("run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t"))
    both = rows.withColumn("d", F.coalesce(F.sum("n_docs").over(before), F.lit(0))).withColumn("k", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return both.join(bases, "run").select(*counts.columns, (F.col("d") + F.col("n")).alias("first_doc"), (F.col("k") + F.col("t")).alias("first_token"))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes whole texts, appends ``end_id`` to each document and writes the shards; returns the manifest.

    ``docs`` needs doc_id and text; other columns are left aside. A null text counts as empty, a
    null doc_id comes before all others, rows with equal doc_id are ordered by a hash of their text
    (equal rows are the same document twice, and both are kept), an empty table gives no shard. A
    task that runs again writes files of another name, and the manifest names those that count.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    shards = max(spark.sparkContext.defaultParallelism, -(-total // shard_bytes))
    ordered = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches):
        enc = encoder(tokenizer)
        width = id_type(max(enc._tok.get_vocab_size(), end_id + 1))
        end = np.array([end_id], width).tobytes()
        store, top = task_files(folder)
        store.create_dir(top, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        sizes, n_null = [np.zeros(1, np.int64)], 0
        with store.open_output_stream(f"{top}/{name}.bin") as ids, store.open_output_stream(f"{top}/{name}.doc") as keys:
            for batch in batches:
                n_null += batch.column(0).null_count
                keys.write(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                texts = batch.column(1).to_pylist()
                for a, b in text_blocks(texts):
                    made = enc.encode(texts[a:b])
                    if enc.dtype != width:
                        made = [np.frombuffer(x, enc.dtype).astype(width).tobytes() for x in made]
                    ids.write(end.join(made) + end)
                    sizes.append(np.array([len(x) // width.itemsize + 1 for x in made], np.int64))
        cuts = np.cumsum(np.concatenate(sizes))
        with store.open_output_stream(f"{top}/{name}.idx") as idx:
            idx.write(cuts.astype("<u8").tobytes())
        if len(cuts) > 1:
            values = {"shard": pa.array([shard], pa.int32()), "file": [name], "n_docs": [len(cuts) - 1], "n_null": [n_null], "n_tokens": [int(cuts[-1])], "width": pa.array([width.itemsize], pa.int32())}
            yield pa.RecordBatch.from_pydict(values)

    counts = f"{folder}/counts"
    with small_batches(spark):
        ordered.select("doc_id", "text").mapInArrow(write, _SHARD).write.parquet(counts)
    _based(spark.read.schema(_SHARD).parquet(counts)).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def mapped(uri: str, dtype: np.dtype) -> np.ndarray:
    """The flat file as an array: memory-mapped where the shared folder is mounted, else read."""
    store, path = task_files(uri)
    if store.type_name == "local":
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of a dataset: doc_id, start (ids before it), n_tokens and the CRC-32 of its ids as 32-bit integers."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    n = max(1, manifest.count())

    def read(batches):
        for batch in batches:
            for s in batch.itertuples():
                at = f"{folder}/{s.file}"
                ids, offsets, keys = mapped(f"{at}.bin", np.dtype(f"<u{s.width}")), mapped(f"{at}.idx", np.dtype("<u8")), mapped(f"{at}.doc", np.dtype("<i8"))
                for a in range(0, s.n_docs, 20_000):
                    cut = offsets[a : min(a + 20_000, s.n_docs) + 1].astype(np.int64)
                    doc = pd.Series(keys[a : a + len(cut) - 1].astype(np.int64)).astype("Int64")
                    doc[: max(0, s.n_null - a)] = pd.NA
                    crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in itertools.pairwise(cut.tolist())]
                    yield pd.DataFrame({"doc_id": doc, "start": cut[:-1] + s.first_token, "n_tokens": np.diff(cut), "ids_crc32": crc})

    return manifest.repartition(n, "shard").mapInPandas(read, READ)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document of ``documents`` through the files, with its start and CRC."""
    import public_tokenizers

    folder = new_folder(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, folder)
