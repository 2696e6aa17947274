import datetime as dt
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import jobs
from quarry.plans.search import Index, reranked, search, with_content
from quarry.schemas import DELIVERY, JOB_EVENT
from quarry.sources import files, sinks, tables
from quarry.streaming import events


def test_work_tree(spark, tmp_path):
    for name, data in {"src/a.py": b"x = 1\n", "node_modules/b.js": b"x", "empty.py": b"", "bin.py": b"a\x00b", "docs/n.md": "é".encode()}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: r for r in files.work_tree(spark, str(tmp_path), "p").collect()}
    assert set(got) == {"src/a.py", "docs/n.md"} and got["docs/n.md"].content == "é" and got["src/a.py"].language == "python"
    assert got["src/a.py"].content_hash == hashlib.sha256(b"x = 1\n").hexdigest()


def test_commit_log_and_questions(spark, tmp_path):
    lines = spark.createDataFrame([("s\x00An\x00a@x\x002024-05-01T10:00:00+02:00\x00p1 p2\x00subject",)], "line string")
    r = files.commit_log(lines).first()
    assert (r.sha, r.parents, r.message, r.authored_at) == ("s", ["p1", "p2"], "subject", dt.datetime(2024, 5, 1, 8))
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "query": "q", "expected_files": ["x"]}]))
    (tmp_path / "b.json").write_text(json.dumps({"questions": [{"id": "2", "query": "r"}, {"id": "3"}]}, indent=1))
    (tmp_path / "c.txt").write_text("no")
    assert sorted((q.id, q.query) for q in files.questions(spark, str(tmp_path)).collect()) == [("1", "q"), ("2", "r"), ("3", None)]


def test_embedding_batches_and_retries(spark):
    chunks = spark.createDataFrame([(str(i), "x" * i) for i in range(70)], "chunk_id string, content string").coalesce(1)

    def embed(texts, failed=[]):  # noqa: B006
        if not failed:
            failed.append(1)
            raise ConnectionError
        assert len(texts) <= 32
        return [[float(len(t)), 1.0] for t in texts]

    got = {r.chunk_id: r.embedding for r in files.embedded(chunks, embed, 2, wait=0.0).collect()}
    assert got == {str(i): [float(i), 1.0] for i in range(70)}
    with pytest.raises(Exception, match="other vectors"):
        files.embedded(chunks, lambda texts: [[1.0]] * len(texts), 2).collect()


def test_signatures(spark):
    good = "sha256=" + hmac.new(b"k", b"body", hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([("body", good, "k"), ("bodY", good, "k"), ("body", good, "other"), ("body", None, "k"), ("body", good.replace("sha256", "sha1"), "k")], "body string, signature string, secret string")
    assert [r[0] for r in rows.select(files.signed()).collect()] == [True, False, False, False, False]


def run(query_of, spark, name):
    query = query_of.writeStream.format("memory").queryName(name).trigger(availableNow=True)
    return query


def write_json(folder, rows):
    folder.mkdir(exist_ok=True)
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in rows))


def test_deliveries_once(spark, tmp_path):
    at = "2024-01-01T00:00:0{}Z"
    write_json(tmp_path / "d", [{"delivery_id": "1", "received_at": at.format(1)}, {"delivery_id": "1", "received_at": at.format(2)}, {"delivery_id": "2", "received_at": at.format(3)}, {"received_at": at.format(4)}, {"received_at": at.format(5)}])
    stream = events.once(events.json_stream(spark, str(tmp_path / "d"), DELIVERY))
    run(stream, spark, "deliveries").option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    ids = [r.delivery_id for r in spark.table("deliveries").collect()]
    assert sorted(ids, key=str) == ["1", "2", None, None]


def test_debounce_and_windows(spark, tmp_path):
    t = lambda s: (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)).isoformat() + "Z"
    write_json(tmp_path / "p", [{"project_id": "a", "received_at": t(s)} for s in (0, 1, 2, 10, 11)] + [{"project_id": "z", "received_at": t(9999)}])
    stream = events.debounced(events.json_stream(spark, str(tmp_path / "p"), "project_id string, received_at timestamp"))
    run(stream, spark, "runs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    assert sorted((r.project_id, r.n) for r in spark.table("runs").collect()) == [("a", 2), ("a", 3)]
    batch = spark.createDataFrame([("m", 1.0, dt.datetime(2024, 1, 1, 5, 30)), ("m", 3.0, dt.datetime(2024, 1, 1, 5, 59)), ("m", 5.0, dt.datetime(2024, 1, 1, 6))], "name string, value double, recorded_at timestamp")
    assert sorted((r.w.start.hour, r.n, r.mean) for r in events.metric_windows(batch).collect()) == [(5, 2, 2.0), (6, 1, 5.0)]


def test_job_states(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    write_json(tmp_path / "j", [{"job_id": j, "status": s, "at": t(n).isoformat() + "Z"} for j, s, n in (("1", "queued", 0), ("1", "running", 1), ("1", "completed", 5), ("1", "running", 6), ("2", "running", 2), ("2", "cancelled", 3))])
    stream = events.job_states(events.json_stream(spark, str(tmp_path / "j"), JOB_EVENT))
    run(stream, spark, "jobs").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    got = {r.job_id: (r.status, r.started_at, r.completed_at) for r in spark.table("jobs").collect()}
    assert got == {"1": ("completed", t(1), t(5)), "2": ("cancelled", t(2), None)}
    assert events.advance(("failed", t(1), t(2)), [("queued", t(3)), ("running", t(4))]) == ("running", t(4), None)
    assert F is not None


def test_index_runs_replace_and_keep(spark, tmp_path):
    folder, schema = str(tmp_path / "index"), "project_id string, file_id long, path string, language string, category string, content string"
    first = [("p", 1, "a.py", "python", "code", "def a():\n    return 1\n"), ("p", 2, "b.py", "python", "code", "x = 1"), ("p", 3, "c.md", "markdown", "documentation", "# T\ntext"), ("p", 4, "node_modules/x.js", "javascript", "code", "var x")]
    one = sinks.run_index(spark, folder, spark.createDataFrame(first, schema), "initial").first()
    assert (one.processed, one.skipped, one.deleted, one.failed) == (3, 0, 0, 0) and one.chunks == 3
    then = [first[0], ("p", 2, "b.py", "python", "code", "def broken(:"), ("q", 5, "n.py", "python", "code", "y = 2")]
    two = sinks.run_index(spark, folder, spark.createDataFrame(then, schema)).first()
    assert (two.processed, two.skipped, two.deleted, two.failed) == (2, 1, 1, 1)
    files_now = {r.path: r.status for r in sinks.stored(spark, folder, "files").collect()}
    assert files_now == {"a.py": "indexed", "b.py": "failed", "n.py": "indexed"}
    assert {r.path for r in sinks.stored(spark, folder, "chunks").collect()} == {"a.py", "b.py", "n.py"}
    assert sinks.current_version(spark, folder) == 1
    assert sinks.run_index(spark, folder, spark.createDataFrame(then, schema), "full").first().processed == 3


def test_other_sinks(spark, tmp_path):
    events = spark.createDataFrame([("queue_depth", "p", 1.0), ("other", "p", 2.0)], "name string, project_id string, value double").withColumn("recorded_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    for _ in range(2):
        sinks.append_metrics(events, str(tmp_path / "m"))
    assert [r.name for r in spark.read.parquet(str(tmp_path / "m")).collect()] == ["queue_depth"] * 2
    left = sinks.without_project({"jobs": spark.createDataFrame([("p", 1), ("q", 2), (None, 3)], "project_id string, id int")}, "p")
    assert sorted(r.id for r in left["jobs"].collect()) == [2, 3]
    lines = [r.line for r in sinks.report(spark.createDataFrame([("b", 0.5, 1.0, None), ("a", None, None, "lost")], "id string, recall_5 double, recall_10 double, error string")).collect()]
    assert [x.split() for x in lines] == [["question", "at", "5", "at", "10"], ["a", "-", "-", "lost"], ["b", "0.500", "1.000"], ["mean", "0.500", "1.000", "passed"]]


def test_webhook_secrets_are_hmacs(spark):
    for secret in ("s", "k" * 100):
        got = spark.createDataFrame([("p1",)], "id string").select(jobs.webhook_secret(F.col("id"), secret).alias("s")).first().s
        assert got == hmac.new(secret.encode(), b"webhook:p1", hashlib.sha256).hexdigest()
    assert spark.range(1).select(jobs.webhook_secret(F.col("id"), "s", "all").alias("s")).first().s == "all"


def test_search_across_projects_and_content(spark, sf_dir):
    index = Index(tables.files(spark, sf_dir), tables.chunks(spark, sf_dir), tables.symbols(spark, sf_dir), tables.vectors(spark, sf_dir))
    found = search(index.across(), "that the", "lexical", 5)
    items = with_content(found, index.across()).collect()
    assert len(items) == 5 and all(r.path.startswith(f"{r.project_id}:") and "the" in r.content.lower() for r in items)
    best = reranked(with_content(found, index.across()), lambda texts: [-len(t) for t in texts]).collect()
    assert [len(r.content) for r in best] == sorted(len(r.content) for r in items)
