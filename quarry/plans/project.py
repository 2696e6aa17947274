"""The questions one may ask about a project, each within its limits; every answer holds that project's rows alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analytics, context, fusion, structural
from .search import BadRequest, Index, merged, search

#: Fixed values: (default, most) items of an answer.
LIMITS = {"symbols": (50, 200), "references": (50, 100), "tests": (25, 50), "files": (50, 200), "context": (8, 12)}


def limited(what: str, limit: int | None) -> int:
    default, most = LIMITS[what]
    if limit is not None and limit < 1:
        raise BadRequest("a limit is at least 1")
    return min(most, default if limit is None else limit)


@dataclass
class Project:
    """A project of an index."""

    index: Index
    project_id: str

    def __post_init__(self):
        self.own = self.index.of(self.project_id)

    def search(self, query: str, mode: str = "hybrid", limit: int | None = None, vector: list[float] | None = None) -> DataFrame:
        return search(self.own, query, mode, limit, vector)

    def context(self, query: str, vector: list[float], limit: int | None = None) -> DataFrame:
        """The bundle of a hybrid search of three times the limit."""
        k = limited("context", limit)
        best = fusion.ranked(merged(self.own, query, vector, 3 * k), 3 * k)
        rows = analytics.numbered(best, F.desc("hybrid"), "ordinal")
        named = rows.join(self.own.symbols.select("path", "start_line", F.col("qualified_name").alias("symbol")), ["path", "start_line"], "left")
        typed = named.join(self.own.chunks.select("path", "start_line", "chunk_type"), ["path", "start_line"], "left")
        return context.bundle(typed.select("n", "path", "start_line", "symbol", "chunk_type"), self.own.symbols, self.own.files, self.own.chunks, k)

    def symbols(self, query: str = "", limit: int | None = None, **filters) -> DataFrame:
        return structural.search(self.own.symbols, query, limited("symbols", limit), **filters)

    def references(self, target: str, limit: int | None = None) -> DataFrame:
        return structural.references(self.own.symbols, target, limited("references", limit))

    def dependencies(self, name: str) -> DataFrame:
        return structural.dependencies(self.own.symbols, name)

    def tests(self, target: str | None = None, limit: int | None = None) -> DataFrame:
        return structural.tests(self.own.files, self.own.chunks, target, limited("tests", limit))

    def files(self, page: int = 1, size: int | None = None, path: str | None = None, language: str | None = None) -> DataFrame:
        """One page of files by path, each with its numbers of chunks and symbols."""
        rows = self.own.files
        if path:
            rows = rows.filter(F.col("path").contains(path))
        if language:
            rows = rows.filter(F.col("language") == language)
        found = analytics.page(rows, ["path"], page, limited("files", size))
        ids = F.broadcast(found.select("file_id"))  # the page bounds it
        for name, children in (("n_chunks", self.own.chunks), ("n_symbols", self.own.symbols)):
            found = analytics.with_child_count(found, children.join(ids, "file_id", "left_semi"), "file_id", name)
        return found.orderBy("path")

    def stats(self) -> DataFrame:
        """One row: numbers of files, chunks, symbols and vectors."""
        parts = [("files", self.own.files), ("chunks", self.own.chunks), ("symbols", self.own.symbols), ("vectors", self.own.vectors)]
        rows = [t.select(F.lit(name).alias("what")) for name, t in parts]
        both = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
        return both.agg(*[F.count_if(F.col("what") == name).alias(name) for name, _ in parts])

    def languages(self) -> DataFrame:
        return analytics.counts_by(self.own.files, "language")
