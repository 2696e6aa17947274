"""The engine's entities as read from a folder of Parquet tables.

A document is a file of the project named by its source; its path has a folder and an ending that
follow from its id, so that every language and category occurs. Each line of three words or more is
a symbol: its first word is the name, the second its parent, and the following words, taken in
pairs, are what it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import chunking

FOLDERS = ["lib", "docs", "tests", "node_modules", "app", "vendor", "pkg"]
ENDINGS = [".py", ".ts", ".go", ".md", ".json", ".test.ts", ".yaml", ".rst", ".java", "_test.go", ".png", ".unknown"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], key) -> F.Column:
    """The value at the remainder of a key. Those of negative keys count from the end, and there is none at 0, as in the SQL's lists."""
    place = (key % len(values) + 1).cast("int")
    return F.when(place != 0, F.element_at(F.array(*[F.lit(v) for v in values]), place))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, file_id, path, language, category, size, content of every document; a path of which a part is missing is null."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), _pick(FOLDERS, F.col("doc_id")), F.lit("/doc_"), F.col("doc_id").cast("string"), _pick(ENDINGS, F.col("doc_id")))
    about = F.transform(F.array(path), lambda p: F.struct(p.alias("path"), paths.language(p).alias("language"), paths.category(p).alias("category")))[0]  # the path is made once
    return d.select(F.col("source").alias("project_id"), F.col("doc_id").alias("file_id"), about.alias("a"), F.col("text").alias("content")).select(
        "project_id", "file_id", "a.path", "a.language", "a.category", F.coalesce(F.octet_length("content"), F.lit(0)).alias("size"), "content"
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, file_id, path, symbol_id, name, qualified_name, kind, start_line, calls, imports, extends."""
    lines = F.split(text.token_lines(F.col("content")), "\n")
    # Lines are laid out once, and a column that is not asked for is not made; the outer form keeps Spark from splitting a text a second time in a filter.
    ws = files(spark, sf_dir).select("project_id", "file_id", "path", F.posexplode_outer(lines).alias("k", "line")).withColumn("line", F.trim("line"))
    name, both = F.substring_index("line", " ", 1), F.substring_index("line", " ", 2)
    parent, rest = F.substring(both, F.length(name) + 2, F.length(both)), F.substring(F.col("line"), F.length(both) + 2, F.length("line"))
    return ws.filter(rest != "").select(
        "project_id", "file_id", "path", F.concat_ws(":", F.col("file_id").cast("string"), (F.col("k") + 1).cast("string")).alias("symbol_id"), name.alias("name"),
        F.concat_ws(".", parent, name).alias("qualified_name"), F.when(F.col("k") % 2 == 0, "function").otherwise("class").alias("kind"), (F.col("k") + 1).alias("start_line"),
        F.split(F.regexp_replace(rest, "([^ ]+) ([^ ]+)", "$1.$2"), " ").alias("calls"), F.array(parent).alias("imports"), F.array().cast("array<string>").alias("extends"),
    )


CHUNK_LINES = 40


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, file_id, path, language, chunk_id, chunk_type, start_line, end_line, content: blocks of lines of every file."""
    own = files(spark, sf_dir).filter(F.col("content").rlike("[^ \\t\\r\\n]"))
    starts = own.select("project_id", "file_id", "path", "language", "category", F.explode_outer(chunking.line_blocks(F.col("content"), CHUNK_LINES)).alias("b"))
    return starts.select(
        "project_id", "file_id", "path", "language", F.concat_ws(":", F.col("file_id").cast("string"), F.col("b.start_line").cast("string")).alias("chunk_id"), F.col("category").alias("chunk_type"),
        "b.start_line", "b.end_line", "b.content",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as vectors of the first chunk of the file of that number: vec_id, path, start_line, embedding, label."""
    own = files(spark, sf_dir).select("project_id", F.col("file_id").alias("vec_id"), "path")
    return table(spark, sf_dir, "embeddings").join(own, "vec_id").withColumn("start_line", F.lit(1))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda t: t <> '')"


_BASE = "regexp_replace(path, '.*/', '')"
_LANGUAGE = "CASE " + " ".join("WHEN " + " OR ".join(f"suffix({_BASE}, '{e}')" for e in endings) + f" THEN '{name}'" for name, endings in paths.LANGUAGES.items()) + " ELSE 'text' END"
_CATEGORY = f"""CASE WHEN regexp_matches({_BASE}, '{paths.TEST_NAMES}') THEN 'test'
  WHEN regexp_matches({_BASE}, '{paths.DOCUMENT_NAMES}') OR regexp_matches(path, '^docs?/') THEN 'documentation'
  WHEN regexp_matches({_BASE}, '{paths.SETTING_NAMES}') THEN 'configuration' ELSE 'code' END"""
#: SQL of the two views above, for the queries' oracles.
FILES_SQL = f"""files AS (
  SELECT project_id, file_id, path, {_LANGUAGE} AS language, {_CATEGORY} AS category, coalesce(strlen(content), 0)::INTEGER AS size, content
  FROM (SELECT source AS project_id, doc_id AS file_id, text AS content,
    source || '/' || {_list(FOLDERS)}[(doc_id % {len(FOLDERS)} + 1)::INTEGER] || '/doc_' || doc_id || {_list(ENDINGS)}[(doc_id % {len(ENDINGS)} + 1)::INTEGER] AS path FROM documents))"""
SYMBOLS_SQL = f"""{FILES_SQL},
lines AS (SELECT project_id, file_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM files),
token_lines AS (SELECT project_id, file_id, path, n, {sql_tokens("line")} AS w FROM lines),
symbols AS (
  SELECT project_id, file_id, path, file_id || ':' || n AS symbol_id, w[1] AS name, w[2] || '.' || w[1] AS qualified_name,
    CASE WHEN n % 2 = 1 THEN 'function' ELSE 'class' END AS kind, n::INTEGER AS start_line,
    list_transform(range(0, (len(w) - 3) // 2 + 1), lambda i: array_to_string(w[3 + 2 * i : 4 + 2 * i], '.')) AS calls, [w[2]] AS imports
  FROM token_lines WHERE len(w) >= 3)"""

CHUNKS_SQL = f"""{FILES_SQL},
chunk_starts AS (
  SELECT project_id, file_id, path, language, category, string_split(content, chr(10)) AS ls,
    unnest(range(0, len(string_split(content, chr(10))), {CHUNK_LINES})) AS a
  FROM files WHERE regexp_matches(content, '[^ \\t\\r\\n]')),
chunks AS (
  SELECT project_id, file_id, path, language, file_id || ':' || (a + 1) AS chunk_id, category AS chunk_type, (a + 1)::INTEGER AS start_line,
    least(a + {CHUNK_LINES}, len(ls))::INTEGER AS end_line, array_to_string(ls[a + 1 : a + {CHUNK_LINES}], chr(10)) AS content
  FROM chunk_starts)"""
