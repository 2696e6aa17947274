"""Index building: change detection against the stored state, staged rewrites, run counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from . import chunking, parsing

MODES = ("initial", "incremental", "full", "reembed")


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, status): A for added, M for changed, D for gone, by path and content_hash; unchanged paths are left out.

    A renamed file is the old path gone and the new one added.
    """
    keys = keys or ["project_id", "path"]
    a = old.select(*keys, F.col("content_hash").alias("before"))
    b = new.select(*keys, F.col("content_hash").alias("after"))
    both = a.join(b, keys, "full_outer")
    status = F.when(F.col("before").isNull(), "A").when(F.col("after").isNull(), "D").when(F.col("before") != F.col("after"), "M")
    return both.withColumn("status", status).filter("status IS NOT NULL").select(*keys, "status")


def changes_from_diff(lines: DataFrame, line: str = "line") -> DataFrame:
    """(status, path) from NUL-separated ``--name-status -z`` output: a rename is D of the old and A of the new path."""
    parts = F.split(F.regexp_replace(line, "\x00$", ""), "\x00")
    walked = F.aggregate(
        parts,
        F.struct(F.lit("").alias("s"), F.lit(None).cast("string").alias("old"), F.array().cast("array<struct<status:string,path:string>>").alias("out")),
        lambda acc, p: F.when(acc["s"] == "", F.struct(F.substring(p, 1, 1).alias("s"), F.lit(None).cast("string").alias("old"), acc["out"].alias("out")))
        .when(acc["s"].isin("R", "C") & acc["old"].isNull(), F.struct(acc["s"].alias("s"), p.alias("old"), acc["out"].alias("out")))
        .when(acc["s"] == "R", F.struct(F.lit("").alias("s"), F.lit(None).cast("string").alias("old"), F.concat(acc["out"], F.array(F.struct(F.lit("D").alias("status"), acc["old"].alias("path")), F.struct(F.lit("A").alias("status"), p.alias("path")))).alias("out")))
        .otherwise(F.struct(F.lit("").alias("s"), F.lit(None).cast("string").alias("old"), F.concat(acc["out"], F.array(F.struct(F.when(acc["s"] == "C", "A").otherwise(acc["s"]).alias("status"), p.alias("path")))).alias("out"))),
        lambda acc: acc["out"],
    )
    return lines.select(F.explode(walked).alias("c")).select("c.*")


def planned(files: DataFrame, state: DataFrame, mode: str = "incremental") -> DataFrame:
    """``files`` (with content_hash) and outcome: skip where nothing changed since it was indexed, else process."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    known = state.select("project_id", "path", F.col("content_hash").alias("known_hash"), F.col("status").alias("known_status"), "indexed_at")
    both = files.join(known, ["project_id", "path"], "left")
    same = F.coalesce((F.col("known_hash") == F.col("content_hash")) & (F.col("known_status") == "indexed") & F.col("indexed_at").isNotNull(), F.lit(False))
    skip = same if mode in ("initial", "incremental") else F.lit(False)
    return both.withColumn("outcome", F.when(skip, "skip").otherwise("process")).drop("known_hash", "known_status", "indexed_at")


def replaced(stored: DataFrame, fresh: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows without those of keys that are gone or fresh, and the fresh ones."""
    out = stored.join(gone.select(*keys).unionByName(fresh.select(*keys)).distinct(), keys, "left_anti")
    return out.unionByName(fresh, allowMissingColumns=True)


def index_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, chunks) of files that are to be processed, as ``index_rows_and_failures``."""
    return index_rows_and_failures(files)[:2]


def index_rows_and_failures(files: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda t: t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, chunks, failures) of files that are to be processed; every line of a file that is not blank lies in a chunk.
    ``keep`` may write what was parsed and read it back, so that files are parsed once.

    Markdown is cut at headings, each a symbol too; parsed languages at declarations, and what lies
    between two of them into blocks; the rest, and files that cannot be parsed, into blocks. A chunk's
    symbol is the last declared one of that qualified name. Failures are (file_id, path, error).
    """
    found = keep(parsing.declarations(files, paths.PARSED))
    failed = found.filter("kind = 'error'").select("file_id", "path", F.substring("name", 1, 2000).alias("error"))
    symbols = parsing.with_file_relations(found.filter("kind <> 'error'"))
    sections = chunking.sections(files.filter("language = 'markdown'"))
    declared = symbols.filter("NOT (kind = 'module' AND start_line = 1 AND end_line = 1)").select("file_id", "qualified_name", F.col("kind").alias("s_kind"), "start_line", "end_line")
    of_file = declared.groupBy("file_id").agg(F.collect_list(F.struct(F.col("qualified_name").alias("symbol"), F.col("s_kind").alias("kind"), "start_line", "end_line")).alias("ds"))
    sliced = text.bound(F.split("content", "\n"), lambda lines: F.transform("ds", lambda d: F.struct(d["symbol"].alias("symbol"), d["kind"].alias("kind"), d["start_line"].alias("start_line"), d["end_line"].alias("end_line"), F.array_join(F.slice(lines, d["start_line"], d["end_line"] - d["start_line"] + 1), "\n").alias("content"))))
    cut = files.join(of_file, "file_id").select("file_id", F.explode_outer(sliced).alias("d")).select("file_id", "d.symbol", "d.kind", "d.start_line", "d.end_line", "d.content")  # a text is split once
    spans = declared.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start_line", (-F.col("end_line")).alias("minus_end")))).alias("spans"))
    plain = files.filter("language <> 'markdown'").join(spans, "file_id", "left")
    blocks = chunking.blocks_between(plain).withColumn("symbol", F.lit(None).cast("string")).withColumn("kind", F.lit("module"))
    docs = sections.withColumn("symbol", F.concat(F.lit("docs:"), F.col("heading"))).drop("heading")
    chunks = cut.unionByName(blocks).unionByName(docs).filter("content rlike '[^ \\\\s]'")
    named = chunks.join(files.select("project_id", "file_id", "path", "language", "category"), "file_id")
    typed = named.withColumn("chunk_type", paths.chunk_type(F.when(F.col("language") == "markdown", "documentation").otherwise("code"), F.col("category"))).withColumn("content_hash", content_hash(F.col("content")))
    once = typed.dropDuplicates(["file_id", "content_hash", "start_line"])
    of_docs = parsing.section_symbols(sections.join(files.select("project_id", "file_id", "path", "language"), "file_id"))
    return symbols.unionByName(of_docs), once.withColumn("chunk_id", chunking.chunk_id(F.col("file_id"), F.col("content"), F.col("start_line"))), failed


def marked_failed(stored: DataFrame, failures: DataFrame) -> DataFrame:
    """The stored files, those that failed with status and error set; failures of files that are not stored change nothing."""
    late = failures.groupBy("file_id").agg(F.min(F.substring("error", 1, 2000)).alias("new_error"))
    both = stored.join(late, "file_id", "left")
    status = F.when(F.col("new_error").isNotNull(), "failed").otherwise(F.col("status"))
    return both.select(*[c for c in stored.columns if c not in ("status", "error")], status.alias("status"), F.coalesce("new_error", F.col("error") if "error" in stored.columns else F.lit(None).cast("string")).alias("error"))


def payload(chunks: DataFrame) -> DataFrame:
    """Adds the module of each chunk's symbol: what stands before the first point of its name."""
    return chunks.withColumn("module", F.substring_index("symbol", ".", 1))


def run_counters(plan: DataFrame, chunks: DataFrame, symbols: DataFrame, gone: DataFrame) -> DataFrame:
    """One row: files processed, skipped and deleted, chunks and symbols written."""
    files = plan.agg(F.count_if(F.col("outcome") == "process").alias("processed"), F.count_if(F.col("outcome") == "skip").alias("skipped"))
    parts = [files, gone.agg(F.count("*").alias("deleted")), chunks.agg(F.count("*").alias("chunks")), symbols.agg(F.count("*").alias("symbols"))]
    rows = [p.select(F.to_json(F.struct("*")).alias("j")) for p in parts]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    fields = ["processed", "skipped", "deleted", "chunks", "symbols"]
    return both.agg(*[F.max(F.get_json_object("j", f"$.{f}").cast("long")).alias(f) for f in fields])


def current_vectors(vectors: DataFrame, version: int) -> DataFrame:
    """Vectors of the current embedding version; rewriting these purges the others."""
    return vectors.filter(F.col("embedding_version") == version)


def new_commits(stored: DataFrame, log: DataFrame) -> DataFrame:
    """The stored commits and those of the log that are new, messages cut to 2000 characters."""
    fresh = log.join(stored.select("repository_id", "sha"), ["repository_id", "sha"], "left_anti").dropDuplicates(["repository_id", "sha"])
    return stored.unionByName(fresh.select("repository_id", "sha", "author", F.substring("message", 1, 2000).alias("message"), "authored_at"))


def resolved_symbol(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds the id of each chunk's symbol: of the file's symbols of that qualified name the last one."""
    last = symbols.groupBy("file_id", F.col("qualified_name").alias("symbol")).agg(F.max_by("symbol_id", F.struct("start_line", "symbol_id")).alias("own_symbol_id"))
    return chunks.join(last, ["file_id", "symbol"], "left")


def default_settings(projects: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Each project's embedding settings, or the environment's where they are null, empty or zero."""
    return projects.withColumns({k: text.or_default(F.col(k), F.lit(v)) for k, v in defaults.items()})
