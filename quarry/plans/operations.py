"""Queries over jobs, deliveries, keys, commits and the index, beside those of the catalog; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import analytics, fusion, history, indexing, jobs, structural
from ..sources import tables
from ..sources.tables import CHUNKS_SQL, FILES_SQL, SYMBOLS_SQL, table
from .catalog import _FUSED, _IS_TEST, CUTOFF, QUERIES, SQL, _merged, query  # noqa: F401 (the queries of both)
from .search import Index, with_content

_JOBS = "SELECT event_id AS job_id, user_id AS project_id, event_type AS type, CASE WHEN floor(value)::BIGINT % 2 = 0 THEN 'queued' ELSE 'completed' END AS status, ts AS t FROM events WHERE event_id % 3 = 0"


def _jobs(spark, sf):
    e = table(spark, sf, "events").filter("event_id % 3 = 0")
    status = F.when(F.floor("value") % 2 == 0, "queued").otherwise("completed")
    return e.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("project_id"), F.col("event_type").alias("type"), status.alias("status"), F.col("ts").alias("at"))


@query(f"""WITH j AS ({_JOBS}), r AS (SELECT event_id AS request_id, user_id AS project_id, event_type AS type, ts AS t FROM events WHERE event_id % 3 = 1),
a AS (SELECT project_id, type, arg_max(job_id, (t, job_id)) AS running FROM j WHERE status = 'queued' GROUP BY 1, 2),
f AS (SELECT project_id, type, arg_min(request_id, (t, request_id)) AS first FROM r GROUP BY 1, 2)
SELECT request_id, coalesce(running, first) AS job_id, running IS NULL AND request_id = first AS created FROM r JOIN f USING (project_id, type) LEFT JOIN a USING (project_id, type)""")
def jobs_enqueue(spark, sf):
    """Which job serves each request: an active one of its project and type, or one that is made."""
    requests = table(spark, sf, "events").filter("event_id % 3 = 1").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("project_id"), F.col("event_type").alias("type"), F.col("ts").alias("at"))
    return jobs.enqueued(requests, _jobs(spark, sf))


@query("""WITH i AS (SELECT DISTINCT l_orderkey * 2 AS job_id FROM lineitem), j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'queued' END AS status FROM orders)
SELECT job_id, CASE WHEN status IS NULL THEN 'not_found' WHEN status = 'failed' THEN 'retried' ELSE 'refused' END AS outcome, CASE WHEN status = 'failed' THEN 'queued' ELSE status END AS status FROM i LEFT JOIN j USING (job_id)""")
def jobs_retry(spark, sf):
    """What becomes of retries: only failed and cancelled jobs are queued again."""
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("queued")
    known = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"))
    return jobs.retried(known, table(spark, sf, "lineitem").select((F.col("l_orderkey") * 2).alias("job_id")))


_REPOS = "SELECT s_suppkey AS project_id, 'https://github.com/team' || (s_suppkey % 7) || '/' || replace(s_name, '#', '-') || CASE WHEN s_suppkey % 2 = 1 THEN '.git' ELSE '' END AS repo_url FROM supplier"
_PUSHES = """SELECT c_custkey AS push_id, n AS full_name, CASE WHEN c_custkey % 2 = 1 THEN 'https://github.com/' || n END AS html_url, CASE WHEN c_custkey % 3 = 0 THEN 'https://github.com/' || n || '.git' END AS clone_url
FROM (SELECT c_custkey, 'team' || (c_custkey % 200 % 7) || '/Supplier-' || lpad((c_custkey % 200)::VARCHAR, 9, '0') AS n FROM customer)"""


@query(f"""WITH r AS ({_REPOS}), p AS ({_PUSHES}),
u AS (SELECT push_id, unnest([0, 1, 2, 3]) AS place, unnest([html_url, clone_url, 'https://github.com/' || full_name, 'git@github.com:' || full_name || '.git']) AS url FROM p),
h AS (SELECT push_id, 0 AS pass, place, project_id FROM u JOIN r ON r.repo_url = u.url
  UNION ALL SELECT push_id, 1, place, project_id FROM u JOIN r ON contains(r.repo_url, regexp_replace(regexp_replace(u.url, '\\.git$', ''), '^https?://', '')))
SELECT push_id, arg_min(project_id, (pass, place, project_id)) AS project_id FROM p LEFT JOIN h USING (push_id) GROUP BY 1""")
def push_projects(spark, sf):
    """The project of each push, by its addresses."""
    repos = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("project_id"), F.concat(F.lit("https://github.com/team"), (F.col("s_suppkey") % 7).cast("string"), F.lit("/"), F.replace("s_name", F.lit("#"), F.lit("-")), F.when(F.col("s_suppkey") % 2 == 1, ".git").otherwise("")).alias("repo_url"))
    k = F.col("c_custkey") % 200
    name = F.concat(F.lit("team"), (k % 7).cast("string"), F.lit("/Supplier-"), F.lpad(k.cast("string"), 9, "0"))
    html, clone = (F.concat(F.lit("https://github.com/"), name, F.lit(end)) for end in ("", ".git"))
    pushes = table(spark, sf, "customer").select(F.col("c_custkey").alias("push_id"), name.alias("full_name"), F.when(F.col("c_custkey") % 2 == 1, html).alias("html_url"), F.when(F.col("c_custkey") % 3 == 0, clone).alias("clone_url"))
    return jobs.push_projects(pushes, repos)


def _blob(raw: bytes) -> str:
    return f"unhex('{raw.hex()}')"


_INNER, _OUTER = jobs.hmac_pads("a test's secret")


@query(f"SELECT s_suppkey, sha256({_blob(_OUTER)} || unhex(sha256({_blob(_INNER)} || encode('webhook:' || s_suppkey)))) AS secret FROM supplier")
def webhook_secrets(spark, sf):
    """The webhook secret of every project."""
    return table(spark, sf, "supplier").select("s_suppkey", jobs.webhook_secret(F.col("s_suppkey"), "a test's secret").alias("secret"))


@query("""WITH k AS (SELECT c_custkey AS key_id, c_nationkey AS project_id, sha256(c_name) AS key_hash FROM customer WHERE c_custkey % 3 <> 0),
t AS (SELECT o_orderkey AS token_id, 'Customer#' || lpad((o_custkey * 2)::VARCHAR, 9, '0') AS token FROM orders)
SELECT token_id, key_id, project_id FROM t JOIN k ON k.key_hash = sha256(t.token)""")
def api_key_owners(spark, sf):
    """The keys that presented tokens belong to; revoked ones do not count."""
    c = table(spark, sf, "customer")
    keys = c.select(F.col("c_custkey").alias("key_id"), F.col("c_nationkey").alias("project_id"), text.key_hash(F.col("c_name")).alias("key_hash"), F.when(F.col("c_custkey") % 3 == 0, F.lit(CUTOFF)).alias("revoked_at"))
    tokens = table(spark, sf, "orders").select(F.col("o_orderkey").alias("token_id"), F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("token"))
    return jobs.key_owners(keys, tokens)


@query("""SELECT s_suppkey AS token_id, c_custkey FROM supplier JOIN customer ON s_suppkey % 10 = 0 OR c_nationkey = s_nationkey""")
def api_key_rows(spark, sf):
    """The rows that each key may see: its project's, or all without a project."""
    owners = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("token_id"), F.when(F.col("s_suppkey") % 10 != 0, F.col("s_nationkey")).alias("project_id"))
    return jobs.scoped(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("project_id")), owners).select("token_id", "c_custkey")


@query("SELECT p_partkey, 'dA/' || p_name || 'é\\' AS path FROM part")
def git_paths(spark, sf):
    """Paths of git's output without their octal escapes."""
    return table(spark, sf, "part").select("p_partkey", text.unescaped_path(F.concat(F.lit("d\\101/"), "p_name", F.lit("\\351\\"))).alias("path"))


@query("""WITH RECURSIVE c AS (SELECT s_suppkey AS sha FROM supplier),
q AS (SELECT s_suppkey AS descendant, unnest([s_suppkey // 8, s_suppkey, s_suppkey + 1, 1]) AS ancestor FROM supplier WHERE s_suppkey % 10 = 0),
r AS (SELECT descendant AS tip, descendant AS sha FROM (SELECT DISTINCT descendant FROM q) UNION SELECT tip, sha // 2 FROM r WHERE sha // 2 >= 1)
SELECT DISTINCT q.ancestor, q.descendant, r.sha IS NOT NULL AS is_ancestor FROM q LEFT JOIN r ON r.tip = q.descendant AND r.sha = q.ancestor""")
def commit_ancestry(spark, sf):
    """Whether one commit is an ancestor of another."""
    s = F.col("s_suppkey")
    half = F.floor(s / 2).cast("string")
    commits = table(spark, sf, "supplier").select(s.cast("string").alias("sha"), F.array(F.when(s > 1, half).otherwise("")).alias("parents"))
    asked = table(spark, sf, "supplier").filter("s_suppkey % 10 = 0").select(F.explode(F.array(F.floor(s / 8).cast("string"), s.cast("string"), (s + 1).cast("string"), F.lit("1"))).alias("ancestor"), s.cast("string").alias("descendant"))
    return history.is_ancestor(commits, asked).select(F.col("ancestor").cast("long").alias("ancestor"), F.col("descendant").cast("long").alias("descendant"), "is_ancestor")


@query("SELECT o_orderkey, o_custkey AS repository_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def project_commits(spark, sf):
    """The commits of one project's repositories."""
    repositories = table(spark, sf, "customer").select(F.col("c_custkey").alias("repository_id"), F.col("c_mktsegment").alias("project_id"))
    return history.project_commits(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("repository_id")), repositories, "BUILDING")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders)::INTEGER AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 40 LIMIT 20")
def page_with_total(spark, sf):
    """A page and the number of all rows."""
    page = analytics.page_with_total(table(spark, sf, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 3, 20)
    return page.select("o_orderkey", F.col("total").cast("int").alias("total"))


@query(f"""WITH {CHUNKS_SQL} SELECT c.file_id, count(*)::BIGINT AS mentions FROM chunks c JOIN files f USING (file_id) WHERE {_IS_TEST.replace("path", "f.path")} AND contains(lower(f.path), 'o') AND contains(c.content, 'o') GROUP BY 1""")
def test_mentions(spark, sf):
    """How many chunks of each test file mention a target."""
    return structural.mentions(tables.files(spark, sf), tables.chunks(spark, sf), "o")


@query(f"WITH {CHUNKS_SQL} SELECT file_id, regexp_replace(path, '.*/', '') AS name, path AS qualified_name, 'test' AS kind, language FROM files WHERE {_IS_TEST} AND contains(lower(path), 'o') AND file_id IN (SELECT file_id FROM chunks WHERE contains(content, 'o')) ORDER BY path, file_id LIMIT 25")
def test_hits(spark, sf):
    """The found test files as symbols."""
    return structural.test_hits(tables.files(spark, sf), tables.chunks(spark, sf), "o").select("file_id", "name", "qualified_name", "kind", "language")


@query(f"WITH {SYMBOLS_SQL} SELECT split_part(qualified_name, '.', 1) AS module, count(*)::BIGINT AS n FROM symbols GROUP BY 1")
def payload_modules(spark, sf):
    """Symbols by the module of their payload."""
    named = tables.symbols(spark, sf).select(F.col("qualified_name").alias("symbol"))
    return analytics.counts_by(indexing.payload(named), "module")


@query(f"""SELECT count_if(o_orderstatus = 'O')::BIGINT AS queue_depth, count_if(o_orderstatus = 'F' AND o_orderdate >= DATE '1997-01-01')::BIGINT AS recent_failures,
(SELECT count(*) FROM supplier WHERE s_nationkey = 3)::BIGINT AS failed_repositories FROM orders""")
def health(spark, sf):
    """Queue depth, recent failures and failed repositories."""
    status = F.when(F.col("o_orderstatus") == "O", "waiting").when(F.col("o_orderstatus") == "F", "failed").otherwise("completed")
    own = table(spark, sf, "orders").select(status.alias("status"), F.col("o_orderdate").alias("at"))
    repositories = table(spark, sf, "supplier").select(F.when(F.col("s_nationkey") == 3, "failed").otherwise("synced").alias("status"))
    return analytics.health(own, repositories, F.lit("1997-01-01").cast("date")).select("queue_depth", "recent_failures", "failed_repositories")


@query("SELECT vec_id FROM embeddings WHERE label = 2")
def vectors_current(spark, sf):
    """Vectors of one version; the others would be purged."""
    return indexing.current_vectors(table(spark, sf, "embeddings").withColumnRenamed("label", "embedding_version"), 2).select("vec_id")


@query(f"""WITH {FILES_SQL}, l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line FROM files WHERE content IS NOT NULL)
SELECT file_id, count(*)::BIGINT AS lines, count(*)::BIGINT AS covered FROM l WHERE regexp_matches(line, '[^ \\t\\n\\r\\f\\v]') GROUP BY 1""")
def index_coverage(spark, sf):
    """Of each file its lines that are not blank, and how many of them lie in a chunk of the index: all."""
    files = tables.files(spark, sf)
    chunks = indexing.index_rows(files)[1].select("file_id", F.explode(F.sequence("start_line", "end_line")).alias("n")).distinct()
    lines = files.select("file_id", F.posexplode(F.split("content", "\n")).alias("k", "line")).filter(F.col("line").rlike(r"[^ \t\n\r\f\x0B]")).select("file_id", (F.col("k") + 1).alias("n"))
    both = lines.join(chunks.withColumn("hit", F.lit(1)), ["file_id", "n"], "left")
    return both.groupBy("file_id").agg(F.count("*").alias("lines"), F.count("hit").alias("covered"))


@query(f"WITH {_FUSED}, b AS (SELECT * FROM merged ORDER BY hybrid DESC, ord LIMIT 10) SELECT b.path, b.start_line::INTEGER AS start_line, chunk_id, file_id, language, end_line, chunk_type, sha256(content) AS content_hash FROM b LEFT JOIN chunks c ON c.path = b.path AND c.start_line = b.start_line")
def hybrid_items(spark, sf):
    """The best places of a hybrid search with the chunks that lie there."""
    index = Index(tables.files(spark, sf), tables.chunks(spark, sf), tables.symbols(spark, sf), tables.vectors(spark, sf))
    found = with_content(fusion.ranked(_merged(spark, sf), 10), index)
    return found.select("path", "start_line", "chunk_id", "file_id", "language", "end_line", "chunk_type", F.sha2("content", 256).alias("content_hash"))


@query(f"""WITH {FILES_SQL} SELECT language, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes FROM files WHERE NOT (len(list_intersect(string_split(path, '/'), {tables._list(paths.SKIPPED_FOLDERS)})) > 0 OR regexp_matches(path, '{paths.SKIPPED_ENDINGS}')) GROUP BY 1""")
def indexed_languages(spark, sf):
    """Files and bytes by language of what an index takes in."""
    return tables.files(spark, sf).filter(~paths.skipped(F.col("path"))).groupBy("language").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes"))


@query("SELECT p_partkey, CASE WHEN n >= 1000000 THEN format('{:.1f}M', n / 1000000.0) WHEN n >= 1000 THEN format('{:.1f}k', n / 1000.0) ELSE n::VARCHAR END AS n FROM (SELECT p_partkey, p_partkey * p_partkey * 3 AS n FROM part)")
def compact_numbers(spark, sf):
    """Numbers as they are shown."""
    n = F.col("p_partkey") * F.col("p_partkey") * 3
    return table(spark, sf, "part").select("p_partkey", text.compact_number(n).alias("n"))


@query("""SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago
FROM (SELECT event_id, epoch(date_trunc('second', TIMESTAMP '2025-01-01'))::BIGINT - floor(epoch(ts))::BIGINT AS s FROM events)""")
def relative_times(spark, sf):
    """Times as they are shown, seen from one moment."""
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    return table(spark, sf, "events").select("event_id", text.relative_time(F.col("ts").cast("timestamp"), now).alias("ago"))
