"""Sinks: runs of a stored index, which append what has changed, appended metrics, teardown of a project, reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import history, indexing, postings, structural
from ..schemas import METRIC_EVENT, METRICS
from .store import Conflict, Snapshot, Store

_STATE = "project_id string, path string, content_hash string, status string, indexed_at timestamp"
#: Runs of one index that may be overtaken by others before one gives up.
ATTEMPTS = 5


def current_version(spark: SparkSession, folder: str) -> int | None:
    """The newest version of a stored index from 0 on, null before the first run."""
    version = Store(spark, folder).snapshot().version
    return version - 1 if version else None


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the current version."""
    return Store(spark, folder).read(name).drop("segment")


def derived(held: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Posting blocks and edges of a segment's chunks and symbols."""
    return {"postings": postings.blocks(held["chunks"]), "edges": structural.edge_rows(held["symbols"])}


def run_index(spark: SparkSession, folder: str, files: DataFrame, mode: str = "incremental", embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Brings the index in ``folder`` to the state of ``files``; returns one row of counters.

    ``files`` has project_id, file_id, path, language, category and content. Files that have not changed
    keep their rows (but in the modes full and reembed); the others are written as one new segment, with their
    symbols, chunks, posting blocks, edges and, by ``embed`` of the chunks, vectors. What they replace, and files that
    are gone, is marked as deleted; files that cannot be parsed are marked failed and cut into blocks. A run that was
    overtaken by another begins again on what that one has committed.
    """
    return _run(spark, folder, lambda state: (files, state.select("project_id", "path").join(files.select("project_id", "path"), ["project_id", "path"], "left_anti")), mode, embed)


def run_commit(spark: SparkSession, folder: str, project_id: str, files: DataFrame, head: str, commits: DataFrame, diff: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Brings one project to the commit ``head``, whose files are ``files``.

    If the commit that was indexed last is an ancestor of ``head``, only the paths of ``diff`` (status A, M or D and path, from
    that commit to ``head``) are looked at; else, as after a rewritten history, all files of the project are.
    """
    own = files.filter(F.col("project_id") == project_id)
    known = Store(spark, folder).snapshot().heads.get(project_id)
    pair = spark.createDataFrame([(known, head)], "ancestor string, descendant string")
    by_diff = known is not None and history.is_ancestor(commits, pair).first()["is_ancestor"]

    def wanted(state: DataFrame) -> tuple[DataFrame, DataFrame]:
        mine = state.filter(F.col("project_id") == project_id).select("project_id", "path")
        if not by_diff:
            return own, mine.join(own.select("path"), "path", "left_anti").select("project_id", "path")
        return own.join(diff.filter("status <> 'D'").select("path"), "path", "left_semi"), mine.join(diff.filter("status = 'D'").select("path"), "path", "left_semi").select("project_id", "path")

    return _run(spark, folder, wanted, "incremental", embed, {project_id: head})


def remove_project(spark: SparkSession, folder: str, project_id: str) -> None:
    """Takes all files of a project, with all that hangs on them, out of the index."""
    empty = spark.createDataFrame([], "project_id string, file_id long, path string, language string, category string, content string")
    _run(spark, folder, lambda state: (empty, state.filter(F.col("project_id") == project_id).select("project_id", "path")), "incremental", None)


def _run(spark: SparkSession, folder: str, wanted, mode: str, embed, heads: dict[str, str] | None = None) -> DataFrame:
    store = Store(spark, folder)
    for attempt in range(ATTEMPTS):
        try:
            return _once(store, wanted, mode, embed, heads)
        except Conflict:
            if attempt == ATTEMPTS - 1:
                raise


def _once(store: Store, wanted, mode: str, embed, heads: dict[str, str] | None) -> DataFrame:
    staging = f"{store.folder}/staging/{uuid.uuid4().hex}"
    try:
        return _staged(store, staging, wanted, mode, embed, heads)
    finally:
        store.remove(staging)


def _staged(store: Store, staging: str, wanted, mode: str, embed, heads: dict[str, str] | None) -> DataFrame:
    spark, base = store.spark, store.snapshot()
    state = store.read("files", base).select("project_id", "path", "content_hash", "status", "indexed_at") if base.segments else spark.createDataFrame([], _STATE)
    files, gone = wanted(state)
    now = files.filter(~paths.skipped(F.col("path"))).withColumn("content_hash", indexing.content_hash(F.col("content")))
    # A file that is to be skipped is gone for the index too, if it was in it.
    gone = gone.unionByName(state.select("project_id", "path").join(files.filter(paths.skipped(F.col("path"))).select("project_id", "path"), ["project_id", "path"], "left_semi")).distinct()

    def keep(rows: DataFrame) -> DataFrame:
        path = f"{staging}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    plan = keep(indexing.planned(now, state, mode))
    work, gone = plan.filter("outcome = 'process'").drop("outcome"), keep(gone)
    symbols, chunks, failed = indexing.index_rows_and_failures(work, keep)
    errors = failed.groupBy("file_id").agg(F.min("error").alias("error"))
    marked = work.drop("content").join(errors, "file_id", "left").withColumn("status", F.when(F.col("error").isNull(), "indexed").otherwise("failed")).withColumn("indexed_at", F.current_timestamp())
    tables = {"files": marked, "symbols": symbols, "chunks": postings.numbered(chunks)}
    made = (lambda held: derived(held) | {"vectors": embed(held["chunks"])}) if embed else derived
    after = store.append(base, tables, work.select("project_id", "path").unionByName(gone), made, heads)
    fresh = Snapshot(after.version, [s for s in after.segments if s not in base.segments], [], after.schemas)
    counters = indexing.run_counters(plan, store.read("chunks", fresh), store.read("symbols", fresh), gone)
    row = counters.withColumn("failed", F.lit(store.read("files", fresh).filter("status = 'failed'").count()))
    return spark.createDataFrame(row.collect(), row.schema)  # one row


def compact(spark: SparkSession, folder: str) -> None:
    """Merges segments of like size; a run that commits meanwhile wins, and the merge is tried again later."""
    Store(spark, folder).compact(derived)


def append_metrics(events: DataFrame, folder: str) -> None:
    """Appends (name, project_id, value, recorded_at) events; names outside the vocabulary are left out."""
    fields = [x.split()[0] for x in METRIC_EVENT.split(", ")]
    events.filter(F.col("name").isin(*METRICS)).select(*fields).write.mode("append").parquet(folder)


def without_project(tables: dict[str, DataFrame], project_id: str) -> dict[str, DataFrame]:
    """Each table without a project's rows, to be written in its place; rows of no project stay."""
    return {name: t.filter(~F.col("project_id").eqNullSafe(F.lit(project_id))) for name, t in tables.items()}


def report(cases: DataFrame, floor: float = 0.5) -> DataFrame:
    """(n, line): an evaluation as lines of fixed width, a heading, a line for each question and one for the means.

    ``cases`` has id, recall_5, recall_10 and error; the lines of a report are few.
    """
    number = lambda c: F.when(F.col(c).isNull(), "     -").otherwise(F.format_string("%6.3f", F.col(c)))
    line = F.concat(F.rpad(F.col("id"), 24, " "), number("recall_5"), F.lit(" "), number("recall_10"), F.lit(" "), F.coalesce("error", F.lit("")))
    means = cases.agg(F.avg("recall_5").alias("recall_5"), F.avg("recall_10").alias("recall_10"))
    verdict = F.when(F.coalesce("recall_10", F.lit(0.0)) >= floor, "passed").otherwise("failed")
    last = means.select(F.lit(2).alias("part"), F.lit("").alias("id"), F.concat(F.rpad(F.lit("mean"), 24, " "), number("recall_5"), F.lit(" "), number("recall_10"), F.lit(" "), verdict).alias("line"))
    head = means.select(F.lit(0).alias("part"), F.lit("").alias("id"), F.concat(F.rpad(F.lit("question"), 24, " "), F.lit(" at 5   at 10")).alias("line"))
    rows = cases.select(F.lit(1).alias("part"), "id", line.alias("line")).unionByName(head).unionByName(last)
    return rows.orderBy("part", "id").select("line")
