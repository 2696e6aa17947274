import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import paths, text
from quarry.functions import vectors as vec


def values(spark, column, inputs, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in inputs], f"x {kind}").select(column(F.col("x"))).collect()]


def test_languages(spark):
    want = {"a.ts": "typescript", "a.tsx": "tsx", "a.js": "javascript", "b/a.py": "python", "a.go": "go", "a.md": "markdown", "a.mdx": "markdown", "a.yaml": "yaml", "a.json": "json", "a.toml": "toml", "Dockerfile": "dockerfile", "MyDockerfile": "dockerfile", "Dockerfile.dev": "text", "x/Makefile": "makefile", "logo.xyz": "text", "a.h": "c", "a.hpp": "cpp", "a.cs": "csharp", "a.css": "css"}
    assert values(spark, paths.language, list(want)) == list(want.values())


def test_categories(spark):
    want = {
        "orders.test.ts": "test", "orders.spec.ts": "test", "test_orders.py": "test", "orders_test.py": "test", "src/__tests__/orders.ts": "code", "README.md": "documentation", "docs/guide.txt": "documentation", "notes.rst": "documentation", "docs/x.py": "documentation",
        "package.json": "configuration", "config.yaml": "configuration", "pyproject.toml": "configuration", "Dockerfile": "configuration", ".env": "configuration", ".env.local": "configuration", "Makefile": "configuration", "requirements.txt": "documentation", "src/orders/service.ts": "code", "lib/notify.py": "code",
    }
    assert values(spark, paths.category, list(want)) == list(want.values())


def test_skips(spark):
    want = {"src/a.py": False, "node_modules/x/a.js": True, "a/vendor/b.go": True, "vendored/b.go": False, "img/a.png": True, "a.PNG": False, "yarn.lock": True, ".gitignore": True, "x/.gitignore": True}
    assert values(spark, paths.skipped, list(want)) == list(want.values())
    rows = spark.createDataFrame([("a.py", b"x"), ("a.py", b""), ("a.py", b"a\x00b"), ("dist/a.py", b"x"), ("a.py", b"x" * 1_000_001)], "path string, content binary")
    assert [r[0] for r in rows.select(paths.skip_reason(F.col("path"), F.col("content"))).collect()] == [None, "empty", "binary", "path", "size"]


def test_slugs(spark):
    want = {"My Cool Project": "my-cool-project", "user/api-server": "user-api-server", "-hello-": "hello", "": "project", "  ": "project", "項目": "project", "!!!": "project", "x" * 80: "x" * 60, "café": "caf", "React 18": "react-18"}
    assert values(spark, text.slugify, list(want)) == list(want.values())


def test_addresses(spark):
    want = {"https://a/b": "https://a/b", " http://a ": "http://a", "git@github.com:a/b.git": "git@github.com:a/b.git", "ssh://x": "ssh://x", "file:///x": "file:///x", "github.com/owner/repo": "https://github.com/owner/repo", "owner/repo": None, "example.com/a/b": None}
    assert values(spark, text.normalized_url, list(want)) == list(want.values())
    assert values(spark, text.provider, ["https://GitHub.com/a", "git@gitlab.com:x", "bitbucket.org/a/b", "x"]) == ["github", "gitlab", "bitbucket", "generic"]


def test_small_text_functions(spark):
    assert values(spark, text.tokens, ["Foo_bar.Baz-9", "", None]) == [["foo_bar", "baz", "9"], [], None]
    assert text.query_terms("The the  Foo-bar") == ["the", "foo", "bar"] and text.like_pattern("a%b_") == r"a\%b\_"
    assert values(spark, text.plain_path, ["./a/b", "a/./b"]) == ["a/b", "a/./b"]
    assert values(spark, lambda x: text.or_default(x, F.lit("d")), ["", None, "0", "v"]) == ["d", "d", "d", "v"]
    assert values(spark, text.distinct_kept, [["b", "", "a", "b", None]], "array<string>") == [["b", "a"]]


def fnv(s):
    h = 2166136261
    for c in s:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def test_hash_embedding(spark):
    seed, raw = fnv("hello world"), []
    for _ in range(64):
        seed = (seed * 1103515245 + 12345) & 0xFFFFFFFF
        raw.append(seed / 0xFFFFFFFF * 2 - 1)
    norm = math.sqrt(sum(x * x for x in raw))
    assert values(spark, vec.hash_embedding, ["hello world"])[0] == pytest.approx([x / norm for x in raw])


def test_cosine_of_nothing_is_null(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in row.select(vec.cosine(F.col("a"), F.col("b"))).collect()] == [None, 1.0]


def test_sealed_texts_open_again(spark):
    row = spark.createDataFrame([("secret", "k" * 32)], "t string, k string")
    assert row.select(text.opened(text.sealed(F.col("t"), F.col("k")), F.col("k"))).first()[0] == "secret"
    assert row.select(F.length(text.sealed(F.lit("abc"), F.col("k")))).first()[0] == 31
