"""Sources outside Parquet: work trees, git text output, evaluation questions, embedding services."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..schemas import QUESTION

BATCH, RETRIES = 32, 3


def work_tree(spark: SparkSession, root: str, project_id: str) -> DataFrame:
    """The readable files of a folder: project_id, path (from the root), language, category, size, content, content_hash.

    Skipped paths, empty, oversized and binary files are left out before their text is decoded.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = F.regexp_replace(F.col("path"), "^.*?" + _escaped(root.rstrip("/").split("://")[-1]) + "/", "")
    named = raw.select(inside.alias("path"), "content")
    kept = named.filter(paths.skip_reason(F.col("path"), F.col("content")).isNull())
    return kept.select(F.lit(project_id).alias("project_id"), "path", paths.language(F.col("path")).alias("language"), paths.category(F.col("path")).alias("category"), F.length("content").alias("size"), F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("content"))


def _escaped(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def commit_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Commits from NUL-separated lines: sha, author, email, authored_at, parents, message."""
    f = F.split(line, "\x00")
    return lines.select(f[0].alias("sha"), f[1].alias("author"), f[2].alias("email"), F.try_to_timestamp(f[3]).alias("authored_at"), F.filter(F.split(f[4], " "), lambda p: p != "").alias("parents"), f[5].alias("message"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation questions from JSON files, each an array or an object with ``questions``."""
    item = f"struct<{QUESTION}>"
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    listed = F.coalesce(F.from_json("value", f"struct<questions:array<{item}>>")["questions"], F.from_json("value", f"array<{item}>"))
    return raw.select(F.explode(listed).alias("q")).select("q.*")


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], dims: int, batch: int = BATCH, retries: int = RETRIES, wait: float = 1.0) -> DataFrame:
    """``chunk_id`` and ``embedding`` of each chunk, texts sent in batches in order.

    ``embed`` raises ``ConnectionError`` for what may be tried again; waits double up to 30 seconds.
    A wrong number of vectors or dimensions is an error.
    """

    def call(texts: list[str]) -> list[list[float]]:
        for attempt in range(retries + 1):
            try:
                out = embed(texts)
                break
            except ConnectionError:
                if attempt == retries:
                    raise
                time.sleep(min(30.0, wait * 2**attempt))
        if len(out) != len(texts) or any(len(v) != dims for v in out):
            raise ValueError("the service returned other vectors than were asked for")
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                yield pd.DataFrame({"chunk_id": part["chunk_id"].tolist(), "embedding": call(part["content"].tolist())})

    return chunks.select("chunk_id", "content").mapInPandas(run, "chunk_id string, embedding array<double>")


def signed(body: str = "body", signature: str = "signature", secret: str = "secret"):
    """Column: whether ``sha256=`` and the HMAC of the raw body is the signature; false without one."""
    import hashlib
    import hmac

    @F.pandas_udf("boolean")
    def run(bodies: pd.Series, given: pd.Series, secrets: pd.Series) -> pd.Series:
        return pd.Series([bool(g) and hmac.compare_digest("sha256=" + hmac.new(s.encode(), (b or "").encode(), hashlib.sha256).hexdigest(), g) for b, g, s in zip(bodies, given, secrets)])

    return run(F.col(body), F.col(signature), F.col(secret))
