import datetime as dt
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import analytics, chunking, evaluation, fusion, indexing, jobs, lexical, parsing, structural
from quarry.plans.project import Project
from quarry.plans.search import BadRequest, Index, NotFound, clamped, search
from quarry.schemas import SYMBOL

HIT = "path string, start_line int, score double"


def hits(spark, rows):
    return spark.createDataFrame(rows, HIT)


def merged(spark, vector=(), lexical=(), symbol=()):
    found = fusion.merge(*[hits(spark, list(x)) for x in (vector, lexical, symbol)])
    return {(r.path, r.start_line): r for r in found.collect()}


def test_fusion_worked_numbers(spark):
    one = merged(spark, lexical=[("a", 1, 2.0)])["a", 1]
    assert one.score == 1 and one.hybrid == pytest.approx(0.75) and one.provenance == ["lexical"]
    both = merged(spark, [("a", 1, 0.8)], [("a", 1, 0.5)])["a", 1]
    assert both.hybrid == pytest.approx(1.6055) and both.provenance == ["vector", "lexical"]
    three = merged(spark, [("v", 1, 0.9), ("s", 1, 0.6)], [("s", 1, 0.5)])
    assert three["s", 1].hybrid == pytest.approx(1.5055) and three["v", 1].hybrid == pytest.approx(0.85)
    assert merged(spark, symbol=[("y", 3, 3.0)])["y", 3].hybrid == pytest.approx(0.3 * 1.3 / 60)


def test_fusion_counts_before_the_limit(spark):
    found = fusion.merge(hits(spark, [("a", 1, 3.0), ("b", 1, 2.0), ("c", 1, 1.0)]), hits(spark, [("a", 1, 2.0), ("d", 1, 1.0)]), hits(spark, []))
    assert fusion.ranked(found, 2).count() == 2
    assert tuple(fusion.source_counts(found).first()) == (3, 2, 0)


def updated(vector, lexical, symbol, w=0.45):
    """The merge as a sequence of updates."""
    items = {}
    for source, rows, weight in (("vector", vector, 1.0), ("lexical", lexical, 1.1)):
        top = rows[0][2] if rows else 0
        for i, (p, n, s) in enumerate(rows):
            part = s / top if top > 0 else 0.0
            if (p, n) in items:
                x = items[p, n]
                x["prov"].append(source)
                x["score"] = max(x["score"], part)
                x["h"] += weight / (60 + i)
            else:
                items[p, n] = {"score": part, "h": part, "prov": [source]}
    for p, n, _ in symbol:
        rank = [(a, b) for a, b, _ in symbol].index((p, n))
        if (p, n) in items:
            items[p, n]["prov"].append("symbol")
            items[p, n]["h"] += 1.3 / (60 + rank)
        else:
            items[p, n] = {"score": 1.0, "h": 1.3 / (60 + rank), "prov": ["symbol"]}
    return {k: ((1 - w) * ("vector" in x["prov"]) * x["score"] + w * ("lexical" in x["prov"]) * x["score"] + (0.15 * len(x["prov"]) if len(x["prov"]) > 1 else 0) + 0.3 * x["h"]) for k, x in items.items()}


def test_fusion_equals_sequential_updates(spark):
    rng = random.Random(2)
    for _ in range(6):
        sources = []
        for low in (-1, -1, 1):
            places = rng.sample([(p, n) for p in "abcd" for n in (1, 5)], rng.randrange(0, 7))
            scores = sorted((rng.randrange(low, 9) / 4 for _ in places), reverse=True)
            sources.append(sorted([(p, n, s) for (p, n), s in zip(places, scores)], key=lambda r: (-r[2], r[0], r[1])))
        want = updated(*sources)
        got = merged(spark, *sources)
        assert {k: r.hybrid for k, r in got.items()} == pytest.approx(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["x", "", " "]), min_size=1, max_size=400), st.integers(25, 150))
def test_blocks_cover_every_line_once(lines, size):
    found = chunking.block_ends(lines, size)
    assert [a for a, _ in found] == [0, *(b + 1 for _, b in found[:-1])] and found[-1][1] == len(lines) - 1
    assert all(b - a < size for a, b in found)


def test_block_ends():
    assert chunking.block_ends(["x"] * 307) == [(0, 149), (150, 299), (300, 306)]
    lines = ["x"] * 300
    lines[130] = ""
    assert chunking.block_ends(lines)[0] == (0, 130)


def test_chunks_and_sections(spark):
    files = spark.createDataFrame([(1, "intro\n# One\ntext\n## Two\n\n# Empty?"), (2, "  \n "), (3, None), (4, "a\nb\nc")], "file_id long, content string")
    got = {(r.file_id, r.heading, r.kind, r.start_line, r.end_line) for r in chunking.sections(files).collect()}
    assert got == {(1, None, "module", 1, 1), (1, "One", "section", 2, 3), (1, "Two", "section", 4, 5), (1, "Empty?", "section", 6, 6), (4, None, "module", 1, 3)}
    assert {(r.file_id, r.start_line, r.content) for r in chunking.blocks(files, 2).filter("file_id = 4").collect()} == {(4, 1, "a\nb"), (4, 3, "c")}
    assert chunking.blocks(files.filter("file_id IN (2, 3)")).count() == 0
    overlapping = spark.createDataFrame([(1, 1, "a\nb\nc"), (1, 2, "b"), (1, 4, "d")], "file_id long, start_line int, content string")
    assert chunking.reconstructed(overlapping).first().content == "a\nb\nc\nd"


PYTHON = '''import os
from ..notify import send

LIMIT = 3

class Service(Base):
    async def cancel(self, id):
        order = Order.find(id)
        return notify.send_expiring(order)

    def items(self):
        return Order.all()

def main():
    Service().cancel(1)
'''
TYPESCRIPT = """import { Order } from "./model";

export class OrderService extends Base {
  async cancelOrder(id: string) {
    const order = await Order.findById(id);
    notify.sendExpiring(order);
  }
  listPending() {
    return Order.find();
  }
}
"""


def test_parsing():
    got = {s["qualified_name"]: s for s in parsing.parse("a/service.py", "python", PYTHON)}
    assert {k: s["kind"] for k, s in got.items()} == {"service.py": "module", "LIMIT": "constant", "Service": "class", "Service.cancel": "method", "Service.items": "method", "main": "function"}
    assert got["service.py"]["imports"] == ["os", "..notify"] and got["Service"]["extends"] == ["Base"]
    assert got["Service.cancel"]["calls"] == ["Order.find", "notify.send_expiring"] and got["Service.cancel"]["start_line"] == 7
    got = {s["qualified_name"]: s for s in parsing.parse("b/service.ts", "typescript", TYPESCRIPT)}
    assert got["service.ts"]["imports"] == ["./model"] and got["OrderService"]["extends"] == ["Base"] and (got["OrderService"]["start_line"], got["OrderService"]["end_line"]) == (3, 11)
    assert "Order.findById" in got["OrderService.cancelOrder"]["calls"] and got["OrderService.listPending"]["calls"] == ["Order.find"]
    assert parsing.parse("x.py", "python", "def (") == []


def symbol_rows(spark):
    base = dict(project_id="p", file_id=1, path="src/a.ts", language="typescript", start_line=1, end_line=9, parent_name=None)
    rows = [
        dict(base, symbol_id="1", name="cancelOrder", qualified_name="OrderService.cancelOrder", kind="method", calls=["Order.findById", "notify.sendExpiring"], imports=["./model"], extends=[]),
        dict(base, symbol_id="2", name="listPending", qualified_name="OrderService.listPending", kind="method", calls=["Order.find"], imports=[], extends=[]),
        dict(base, symbol_id="3", name="Order", qualified_name="Order", kind="interface", calls=[], imports=[], extends=None),
        dict(base, symbol_id="4", name="find", qualified_name="Repo.find", kind="method", calls=[], imports=[], extends=[]),
    ]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SYMBOL.split(', ')) for r in rows], SYMBOL)


def test_structural(spark):
    s = symbol_rows(spark)
    names = lambda df: {r.qualified_name for r in df.collect()}
    assert names(structural.references(s, "Order.find")) == {"OrderService.listPending"}
    assert names(structural.references(s, "Order")) == {"OrderService.cancelOrder", "OrderService.listPending"}
    assert names(structural.references(s, "notify.sendExpiring")) == {"OrderService.cancelOrder"}
    assert names(structural.find(s, "listPending")) == {"OrderService.listPending"} and structural.find(s, "none").count() == 0
    assert structural.dependencies(s, "OrderService.cancelOrder").first().imports == ["./model"]
    assert {(r.call, r.callee) for r in structural.callees(s, s).collect()} == {("Order.findById", None), ("notify.sendExpiring", None), ("Order.find", "Repo.find")}
    assert names(structural.search(s, "Order", 10, kind="interface")) == {"Order"} and structural.search(s, "", 10).count() == 4
    files = spark.createDataFrame([(1, "tests/orders.test.ts"), (2, "src/orders.ts"), (3, "lib/tests/Order_x.py")], "file_id long, path string")
    chunks = spark.createDataFrame([(1, "cancelOrder of orders"), (2, "orders"), (3, "order")], "file_id long, content string")
    assert [r.file_id for r in structural.tests(files, chunks).collect()] == [3, 1]
    assert [r.file_id for r in structural.tests(files, chunks, "orders").collect()] == [1] and structural.tests(files, chunks, "zzz").count() == 0


def test_lexical(spark):
    chunks = spark.createDataFrame([("1", "a", 1, "alpha beta alpha"), ("2", "b", 1, "alpha"), ("3", "c", 1, "beta_x"), ("4", "d", 1, None)], "chunk_id string, path string, start_line int, content string")
    assert [r.chunk_id for r in lexical.search(chunks, "ALPHA", 5).collect()] == ["1", "2"]
    assert [r.chunk_id for r in lexical.search(chunks, "alpha beta", 5).collect()] == ["1"]
    assert {r.chunk_id for r in lexical.search(chunks, "alpha beta_x", 5, match="any").collect()} == {"1", "2", "3"}
    assert lexical.search(chunks, " -- ", 5).count() == 0
    assert lexical.search(chunks, "beta", 5).first().score == pytest.approx(0.0607927, abs=1e-7)
    s = symbol_rows(spark)
    assert [r.name for r in lexical.name_search(s, "order", 5).collect()] == ["Order", "cancelOrder", "listPending"]
    assert lexical.name_search(s, "%", 5).count() == 0 and lexical.name_search(s, " ", 5).count() == 0


def test_evaluation(spark):
    rows = spark.createDataFrame(
        [(["./a", "b"], ["A"], ["a", "a", "c"], ["A.b", None], ["b"], None), ([], [], [], [], [], None), (["z"], ["q"], [], [], [], "failed")],
        "expected_files array<string>, expected_symbols array<string>, paths array<string>, symbols array<string>, bundle array<string>, error string",
    )
    r = evaluation.passes(evaluation.summary(rows)).first()
    assert (r.questions, r.failed, r.recall_files_5, r.recall_symbols_5, r.context_hit_rate, r.passed) == (3, 1, 0.75, 1.0, 0.5, True)
    assert evaluation.summary(rows.filter("error IS NOT NULL")).first().recall_files_5 is None


def test_p95(spark):
    t = dt.datetime(2024, 1, 2)
    rows = [("one", 5.0, t)] + [("twenty", float(i), t) for i in range(20)] + [("more", float(i), t) for i in range(21)] + [("same", 1.0, t)] * 100 + [("old", 1.0, t - dt.timedelta(days=9))]
    events = spark.createDataFrame(rows, "name string, value double, recorded_at timestamp_ntz")
    got = {r["name"]: r.p95 for r in analytics.metric_summaries(events, since=F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    assert got == {"one": 5.0, "twenty": 19.0, "more": 19.0, "same": 1.0}


def test_delivery_status_order(spark):
    rows = spark.createDataFrame([(True, "x", True, "p", True, True, "1"), (False, "x", False, None, False, False, "0"), (False, "push", False, None, False, False, "0"), (False, "push", True, None, False, True, "1"), (False, "push", True, "p", False, True, "1"), (False, "push", True, "p", True, False, "1"), (False, "push", True, "p", True, True, "000"), (False, "push", True, "p", True, True, "1a")], "a boolean, b string, c boolean, d string, e boolean, f boolean, g string")
    got = [r[0] for r in rows.select(analytics.delivery_status(*[F.col(c) for c in "abcdefg"])).collect()]
    assert got == ["duplicate", "ignored", "failed", "failed", "failed", "ignored", "ignored", "processed"]


def test_incremental_run(spark):
    def files(rows):
        f = spark.createDataFrame([("p", i, path, "python", "code", text) for i, path, text in rows], "project_id string, file_id long, path string, language string, category string, content string")
        return f.withColumn("content_hash", indexing.content_hash(F.col("content")))

    first = files([(1, "a.py", "def f():\n    g()\n"), (2, "b.py", "x = 1\n"), (3, "c.py", "class C:\n    pass\n")])
    empty = spark.createDataFrame([], "project_id string, path string, content_hash string, status string, indexed_at timestamp_ntz")
    plan = indexing.planned(first, empty, "initial")
    assert plan.filter("outcome = 'process'").count() == 3
    symbols, chunks = indexing.index_rows(first)
    assert {r.qualified_name for r in symbols.collect()} == {"a.py", "f", "C"} - {"a.py"} and chunks.count() == 3
    state = first.withColumn("status", F.lit("indexed")).withColumn("indexed_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    second = files([(1, "a.py", "def f():\n    g()\n"), (2, "b2.py", "x = 1\n"), (3, "c.py", "class D:\n    pass\n")])
    outcome = {r.path: r.outcome for r in indexing.planned(second, state).collect()}
    assert outcome == {"a.py": "skip", "b2.py": "process", "c.py": "process"}
    assert {r.outcome for r in indexing.planned(second, state, "full").collect()} == {"process"}
    diff = {(r.path, r.status) for r in indexing.snapshot_diff(state, second).collect()}
    assert diff == {("b.py", "D"), ("b2.py", "A"), ("c.py", "M")}
    gone = indexing.snapshot_diff(state, second).filter("status = 'D'")
    stored = indexing.replaced(state.select("project_id", "path", "content_hash"), second.filter("path <> 'a.py'").select("project_id", "path", "content_hash"), gone, ["project_id", "path"])
    assert {r.path for r in stored.collect()} == {"a.py", "b2.py", "c.py"}
    counters = indexing.run_counters(indexing.planned(second, state), chunks, symbols, gone).first()
    assert (counters.processed, counters.skipped, counters.deleted, counters.chunks, counters.symbols) == (2, 1, 1, 3, 2)
    with pytest.raises(ValueError):
        indexing.planned(second, state, "other")


def test_diff_text(spark):
    lines = spark.createDataFrame([("M\x00a\x00A\x00b c\x00R100\x00old\x00new\x00D\x00gone\x00C75\x00x\x00y\x00",)], "line string")
    got = [(r.status, r.path) for r in indexing.changes_from_diff(lines).collect()]
    assert got == [("M", "a"), ("A", "b c"), ("D", "old"), ("A", "new"), ("D", "gone"), ("A", "y")]


def test_commits_are_added_once(spark):
    stored = spark.createDataFrame([("r", "1", "a", "m", None)], "repository_id string, sha string, author string, message string, authored_at timestamp")
    log = spark.createDataFrame([("r", "1", "a", "other", None), ("r", "2", "b", "x" * 3000, None)], "repository_id string, sha string, author string, message string, authored_at timestamp")
    got = {r.sha: r.message for r in indexing.new_commits(stored, log).collect()}
    assert got["1"] == "m" and len(got["2"]) == 2000


def test_search_is_scoped(spark):
    files = spark.createDataFrame([("p", 1, "a"), ("q", 2, "b")], "project_id string, file_id long, path string")
    chunks = spark.createDataFrame([("p", "1", 1, "a", 1, "alpha one"), ("q", "2", 2, "b", 1, "alpha two")], "project_id string, chunk_id string, file_id long, path string, start_line int, content string")
    vectors = spark.createDataFrame([("p", "a", 1, [1.0, 0.0]), ("q", "b", 1, [1.0, 0.0])], "project_id string, path string, start_line int, embedding array<double>")
    index = Index(files, chunks, symbol_rows(spark), vectors).of("p")
    for mode in ("lexical", "semantic", "hybrid"):
        assert {r.path for r in search(index, "alpha", mode, vector=[1.0, 0.0]).collect()} == {"a"}
    assert search(index, "Order", "symbol", 2).count() == 2
    assert (clamped(None), clamped(999), clamped(0)) == (10, 50, 1)
    typed = Index(files, chunks.withColumn("chunk_type", F.lit("documentation")), symbol_rows(spark), vectors)
    one = Project(typed, "p")
    assert tuple(one.stats().first()) == (1, 1, 4, 1)
    page = one.files().first()
    assert (page.path, page.n_chunks, page.n_symbols) == ("a", 1, 4)
    sections = {r.section for r in one.context("alpha", [1.0, 0.0]).collect()}
    assert "doc" in sections and one.references("Order").count() == 2 and one.tests().count() == 0
    with pytest.raises(BadRequest):
        search(index, "x", "other")
    with pytest.raises(BadRequest):
        search(index, "x", "hybrid")
    with pytest.raises(NotFound):
        index.of("nobody")


def test_every_line_lies_in_a_chunk(spark):
    text = "import os\n\nX = 1\n\ndef a():\n    return 1\n\nprint(a())\n\nclass B:\n    def c(self):\n        pass\n\n    def d(self):\n        pass\n\nif __name__ == '__main__':\n    a()\n"
    rows = [("p", 1, "a.py", "python", "code", text), ("p", 2, "b.md", "markdown", "documentation", "before\n# One\nx\n\n## Two\ny"), ("p", 3, "c.py", "python", "code", "def broken(:\n  x"), ("p", 4, "d.py", "python", "code", ""), ("p", 5, "e.txt", "text", "documentation", "one\ntwo")]
    files = spark.createDataFrame(rows, "project_id string, file_id long, path string, language string, category string, content string")
    symbols, chunks, failed = indexing.index_rows_and_failures(files)
    held = {}
    for c in chunks.collect():
        held.setdefault(c.file_id, set()).update(range(c.start_line, c.end_line + 1))
    for _, i, _, _, _, content in rows:
        assert {n for n, line in enumerate(content.split("\n"), 1) if line.strip()} <= held.get(i, set())
    assert {(s.name, s.kind, s.start_line, s.end_line) for s in symbols.collect() if s.file_id == 2} == {("One", "section", 2, 4), ("Two", "section", 5, 6)}
    assert [(f.file_id, f.error.split(":")[0]) for f in failed.collect()] == [(3, "SyntaxError")]
    stored = files.select("file_id", "path").withColumn("status", F.lit("indexed"))
    marked = {r.file_id: (r.status, bool(r.error)) for r in indexing.marked_failed(stored.filter("file_id < 5"), failed).collect()}
    assert marked == {1: ("indexed", False), 2: ("indexed", False), 3: ("failed", True), 4: ("indexed", False)}


def test_hidden_edges_of_files_put_together(spark):
    rows = [(1, 1, "a\nb\nc"), (1, 2, "b\nc\nd"), (1, 3, "c"), (1, 5, "e\nf"), (2, 1, "x")]
    got = {r.file_id: r.content for r in chunking.reconstructed(spark.createDataFrame(rows, "file_id long, start_line int, content string")).collect()}
    assert got == {1: "a\nb\nc\nd\ne\nf", 2: "x"}


def test_an_owner_of_many_projects_brings_few_candidates(spark):
    """Each push meets the projects whose name begins as its own; a name may be the beginning of a longer one."""
    projects = [(i, f"https://github.com/big/app{i}" + (".git" if i % 2 else "")) for i in range(120)] + [(500, "git@github.com:big/other"), (501, "https://github.com/big/"), (502, "plain"), (503, None)]
    pushes = [(i, f"big/app{i}", None, None) for i in range(0, 240, 2)] + [(900, "big/oth", None, None), (901, "", "https://github.com/big/", None), (902, None, None, None), (903, "plain", "plain", None)]
    p = spark.createDataFrame(projects, "project_id int, repo_url string")
    asked = spark.createDataFrame(pushes, "push_id int, full_name string, html_url string, clone_url string")
    got = {r.push_id: r.project_id for r in jobs.push_projects(asked, p).collect()}

    def plain(full, html, clone):
        urls = [html, clone, *(["https://github.com/" + full, f"git@github.com:{full}.git"] if full is not None else [])]
        for test in (lambda url, repo: repo == url, lambda url, repo: re.sub("^https?://", "", re.sub(r"\.git$", "", url)) in repo):
            for url in urls:
                if hits := [i for i, repo in projects if url and repo and test(url, repo)]:
                    return min(hits)

    assert got == {i: plain(*rest) for i, *rest in pushes}
    tried = asked.select(F.concat(F.lit("https://github.com/"), "full_name").alias("url")).filter("url LIKE '%/app%'")
    assert jobs.part_candidates(tried, p).count() < 3 * 120  # of 120 * 120


def test_percentiles_of_skewed_values(spark, monkeypatch):
    """Far values, equal values, both signs and extremes; few values are ordered, however they lie."""
    monkeypatch.setattr(analytics, "FEW", 40)
    rng = random.Random(3)
    rows = [("far", rng.random()) for _ in range(3000)] + [("far", 1e12), ("far", -1e12)]
    rows += [("wide", rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 308)) for _ in range(1000)]
    rows += [("equal", float(rng.randrange(3))) for _ in range(1000)] + [("one", 5.0)] + [("none", None)]
    rows += [("endless", x) for x in [float("inf")] * 5 + [rng.random() for _ in range(995)]]
    events = spark.createDataFrame(rows, "name string, value double").repartition(3)
    got = {r["name"]: r.p95 for r in analytics.metric_summaries(events).collect()}
    want = {}
    for name in {"far", "wide", "equal", "one", "endless"}:
        values = sorted(v for n, v in rows if n == name)
        want[name] = values[min(len(values) - 1, int(len(values) * 0.95))]
    assert got == want


def test_tokens_see_their_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(n, n % 3 if n % 4 else None) for n in range(24)], "row_id long, project_id long")
    owners = spark.createDataFrame([(1, 0), (2, 2), (3, None), (4, 9), (5, None), (6, None)], "token_id long, project_id long")
    want = {(t, n) for t, p in [(1, 0), (2, 2), (3, None), (4, 9), (5, None), (6, None)] for n in range(24) if p is None or (n % 4 and n % 3 == p)}
    counted = {t: sum(1 for a, _ in want if a == t) for t in range(1, 7)}
    for free in (1000, 1):
        monkeypatch.setattr(jobs, "FREE", free)
        found = [(r["token_id"], r["row_id"]) for r in jobs.scoped(rows, owners).collect()]
        assert len(found) == len(want) and set(found) == want
    assert dict(map(tuple, jobs.visible(rows, owners).collect())) == counted
    assert jobs.scoped(rows, owners.filter("project_id = 9")).count() == 0
    assert dict(map(tuple, jobs.visible(rows.limit(0), owners).collect())) == dict.fromkeys(range(1, 7), 0)


def test_a_text_too_deep_for_the_parser_is_a_failed_file(monkeypatch):
    deep = "(" * 150 + "-" * 20_000 + "1"
    assert [s["kind"] for s in parsing.parse_or_error("a.py", "python", "x = " + "-" * 100_000 + "1")] == ["error"]
    assert [s["kind"] for s in parsing.parse_or_error("a.py", "python", deep)] == ["error"]
    (found,) = parsing.parse_or_error("a.py", "python", "a " * 10 + "lambda x: " * 20_000)
    assert found["kind"] == "error"

    def full(*_):
        raise MemoryError

    monkeypatch.setattr(parsing, "_python", full)
    with pytest.raises(MemoryError):  # a worker that has run out of memory is no fault of the file
        parsing.parse_or_error("a.py", "python", "x = 1")


def test_every_line_of_a_text_too_deep_for_the_parser_lies_in_a_chunk(spark):
    content = "\n".join(["x = 1"] * 200 + ["x = " + "-" * 100_000 + "1"] + ["y = 2"] * 200)
    files = spark.createDataFrame([("p", 1, "a.py", "python", "code", content)], "project_id string, file_id long, path string, language string, category string, content string")
    _, chunks, failed = indexing.index_rows_and_failures(files)
    assert [r.file_id for r in failed.collect()] == [1]
    assert {n for r in chunks.collect() for n in range(r.start_line, r.end_line + 1)} == set(range(1, 402))


def test_rows_of_one_project_are_dealt_to_as_many_tasks_as_their_pairs_need(spark, monkeypatch):
    monkeypatch.setattr(jobs, "PAIRS", 1000, raising=False)
    rows = spark.range(1000).select(F.col("id").alias("row_id"), F.lit(7).cast("long").alias("project_id"))
    owners = spark.createDataFrame([(t, 7 if t < 20 else None) for t in range(25)], "token_id long, project_id long")
    made = [r["count"] for r in jobs.scoped(rows, owners).groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(made) == 25_000 and len(made) >= 25 and max(made) <= 1_000
