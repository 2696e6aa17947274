"""The search front end: one project's index, and the four modes of searching it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fusion, lexical, semantic, structural

MODES = ("hybrid", "semantic", "lexical", "symbol")
#: Most items of an answer, and how many times more each mode asks of its retrievers.
MAX_LIMIT, DEFAULT_LIMIT, HYBRID_FETCH, SEMANTIC_FETCH = 50, 10, 4, 3


class NotFound(LookupError):
    """No such project."""


class BadRequest(ValueError):
    """An argument out of range."""


@dataclass
class Index:
    """The tables of an index; every question names a project, and only its rows answer."""

    files: DataFrame
    chunks: DataFrame
    symbols: DataFrame
    vectors: DataFrame

    def of(self, project_id: str) -> "Index":
        if not project_id:
            raise BadRequest("a project is needed")
        own = [t.filter(F.col("project_id") == project_id) for t in (self.files, self.chunks, self.symbols, self.vectors)]
        if own[0].limit(1).isEmpty():
            raise NotFound(project_id)
        return Index(*own)


    def across(self, project_ids: list[str] | None = None) -> "Index":
        """Several projects, or all, as one index. Paths begin with their project, so that equal ones stay apart."""
        tables = (self.files, self.chunks, self.symbols, self.vectors)
        own = [t if project_ids is None else t.filter(F.col("project_id").isin(project_ids)) for t in tables]
        return Index(*[t.withColumn("path", F.concat_ws(":", "project_id", "path")) for t in own])


def clamped(limit: int | None) -> int:
    return max(1, min(MAX_LIMIT, DEFAULT_LIMIT if limit is None else limit))


def merged(index: Index, query: str, vector: list[float], limit: int) -> DataFrame:
    """All places that the three retrievers found for a hybrid query, with their scores."""
    n = limit * HYBRID_FETCH
    return fusion.merge(
        semantic.nearest(index.vectors, vector, n, key="path").select("path", "start_line", "score"),
        lexical.search(index.chunks, query, n).select("path", "start_line", "score"),
        lexical.name_search(index.symbols, query, limit).select("path", "start_line", "score"),
    )


_CONTENT = ("project_id", "chunk_id", "file_id", "language", "symbol", "kind", "end_line", "content", "chunk_type")


def with_content(places: DataFrame, index: Index) -> DataFrame:
    """The few ``places`` of an answer with the chunk that begins at each (the first by chunk_id); nulls where none does."""
    keys = ["path", "start_line"]
    fields = [c for c in _CONTENT if c in index.chunks.columns]
    held = index.chunks.join(F.broadcast(places.select(*keys)), keys, "left_semi")  # an answer has at most 50 places
    one = held.groupBy(*keys).agg(F.min(F.struct("chunk_id", *[c for c in fields if c != "chunk_id"])).alias("c"))
    return places.join(one, keys, "left").select(*places.columns, *[F.col(f"c.{c}").alias(c) for c in fields])


def reranked(items: DataFrame, rerank: Callable[[list[str]], list[float]]) -> DataFrame:
    """``items`` (with content) ordered by what ``rerank`` makes of their texts, all in one call; an answer has at most 50."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(reranked=[float(x) for x in rerank(frame["content"].fillna("").tolist())])

    scored = items.coalesce(1).mapInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in items.schema)}, reranked double")
    return scored.orderBy(F.desc("reranked"), "path", "start_line")


def search(index: Index, query: str, mode: str = "hybrid", limit: int | None = None, vector: list[float] | None = None) -> DataFrame:
    """(path, start_line, score, hybrid, provenance) of the best places for a query, by mode."""
    k = clamped(limit)
    if mode not in MODES:
        raise BadRequest(f"mode is one of {', '.join(MODES)}")
    if mode in ("hybrid", "semantic") and vector is None:
        raise BadRequest("this mode needs the query's vector")
    if mode == "hybrid":
        return fusion.ranked(merged(index, query, vector, k), k).drop("ordinal")
    if mode == "semantic":
        hits = semantic.nearest(index.vectors, vector, k * SEMANTIC_FETCH, key="path").orderBy(F.desc("score"), "path").limit(k)
    elif mode == "lexical":
        hits = lexical.search(index.chunks, query, k)
    else:
        hits = structural.search(index.symbols, query, k).withColumn("score", F.lit(1.0))
    source = {"semantic": "vector"}.get(mode, mode)
    return hits.select("path", "start_line", "score", F.col("score").alias("hybrid"), F.array(F.lit(source)).alias("provenance"))
