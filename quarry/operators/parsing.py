"""Declarations of source files as symbols and chunks.

Python files are read with the standard ``ast`` module. Files of the other parsed languages are read
by patterns of declaration lines, a block ending where its braces close; other files give no
symbols. A file that cannot be parsed gives no symbols and is cut into blocks.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARSED = "struct<name:string,qualified_name:string,kind:string,start_line:int,end_line:int,parent_name:string,calls:array<string>,imports:array<string>,extends:array<string>>"
_FIELDS = ["name", "qualified_name", "kind", "start_line", "end_line", "parent_name", "calls", "imports", "extends"]
_WORDS = r"(?:export|default|public|private|protected|internal|static|abstract|final|async|pub(?:\(\w+\))?|unsafe|override|sealed|virtual|inline|const)\s+"
_DECLARED = [
    ("class", re.compile(rf"^\s*(?:{_WORDS})*(?:class|struct|record|object|impl)\s+([A-Za-z_]\w*)(.*)")),
    ("interface", re.compile(rf"^\s*(?:{_WORDS})*(?:interface|trait)\s+([A-Za-z_]\w*)(.*)")),
    ("enum", re.compile(rf"^\s*(?:{_WORDS})*enum\s+([A-Za-z_]\w*)(.*)")),
    ("type", re.compile(rf"^\s*(?:{_WORDS})*(?:type|typedef)\s+([A-Za-z_]\w*)(.*)")),
    ("module", re.compile(rf"^\s*(?:{_WORDS})*(?:namespace|module|mod)\s+([A-Za-z_]\w*)(.*)")),
    ("function", re.compile(rf"^\s*(?:{_WORDS})*(?:function\*?|func|fn|def)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)(.*)")),
    ("method", re.compile(rf"^\s+(?:{_WORDS})*(?:[\w<>\[\],.]+\s+)?(?!(?:if|for|while|switch|catch|return|else|new)\b)([A-Za-z_]\w*)\s*(\([^;]*\)[^;]*\{{.*)")),
]
_CALL = re.compile(r"(?<![\w.])((?:new\s+)?[A-Za-z_][\w]*(?:(?:\.|::|->)[A-Za-z_]\w*)*)\s*\(")
_NOT_CALLS = frozenset("if for while switch catch return function func fn def class elif with assert not and or in lambda new".split())
_IMPORT = re.compile(r"""^\s*(?:import|export)\b[^'"]*['"]([^'"]+)['"]|^\s*#include\s*[<"]([^>"]+)[>"]|^\s*(?:pub\s+)?use\s+([\w:\\]+)|^\s*using\s+([\w.]+)|^\s*import\s+(?:static\s+)?([\w.]+)|^\s*"([^"]+)"$""")


def _symbol(name, parent, kind, start, end, calls=(), imports=(), extends=()):
    return dict(zip(_FIELDS, [name, f"{parent}.{name}" if parent else name, kind, start, end, parent, list(dict.fromkeys(calls)), list(dict.fromkeys(imports)), list(dict.fromkeys(extends))]))


def _module(path: str, calls, imports):
    return [_symbol(path.rsplit("/", 1)[-1], None, "module", 1, 1, calls, imports)] if calls or imports else []


def _python(path: str, text: str) -> list[dict]:
    tree, out = ast.parse(text), []

    def called(node) -> list[str]:
        found = [n for n in ast.walk(node) if isinstance(n, ast.Call)]
        return [ast.unparse(n.func) for n in sorted(found, key=lambda n: (n.lineno, n.col_offset)) if isinstance(n.func, (ast.Name, ast.Attribute))]

    def imported(nodes) -> list[str]:
        return [x for n in nodes for x in ([a.name for a in n.names] if isinstance(n, ast.Import) else ["." * n.level + (n.module or "")] if isinstance(n, ast.ImportFrom) else [])]

    def visit(body, parent, inside):
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(node, ast.ClassDef)
                first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                kind = "class" if is_class else "method" if inside else "function"
                out.append(_symbol(node.name, parent, kind, first, node.end_lineno, called(node), imported(ast.walk(node)), [ast.unparse(b) for b in node.bases] if is_class else []))
                visit(node.body, node.name, is_class)
            elif parent is None and isinstance(node, (ast.Assign, ast.AnnAssign)):
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                out.extend(_symbol(t.id, None, "constant", node.lineno, node.end_lineno) for t in targets if isinstance(t, ast.Name) and t.id.isupper())

    visit(tree.body, None, False)
    loose = [n for n in tree.body if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    return _module(path, [c for n in loose for c in called(n)], imported(loose)) + out


def _braced(path: str, text: str) -> list[dict]:
    lines, out, open_ones, covered = text.split("\n"), [], [], set()
    starts = list(accumulate((len(x) + 1 for x in lines), initial=0))  # where each line begins
    balance = list(accumulate((x.count("{") - x.count("}") for x in lines), initial=0))
    called = [(c.start(1), c.group(1)) for c in _CALL.finditer(text) if c.group(1) not in _NOT_CALLS]  # found once a file
    places = [at for at, _ in called]
    imports = [next(g for g in m.groups() if g) for m in map(_IMPORT.match, lines) if m]
    for i, line in enumerate(lines):
        open_ones = [d for d in open_ones if d[1] >= i]
        for kind, pattern in _DECLARED:
            if m := pattern.match(line):
                end, opened = i, False
                for j in range(i, len(lines)):
                    opened = opened or "{" in lines[j]
                    end = j
                    if balance[j + 1] <= balance[i] and (opened or lines[j].rstrip().endswith(";") or j > i + 3):
                        break
                end = end if opened else i
                parent = open_ones[-1][0] if open_ones else None
                inside = called[bisect_left(places, starts[i]) : bisect_left(places, starts[end + 1])]
                calls = [c.replace("new ", "") for _, c in inside if c != m.group(1)]
                heritage = re.findall(r"\b(?:extends|implements)\s+([\w., <>]+)|:\s*(?:public\s+)?([A-Z]\w*)", m.group(2)) if kind in ("class", "interface") else []
                extends = [x.strip() for a, b in heritage for x in re.split(r",|\bimplements\b|\bextends\b", a or b) if x.strip()]
                kind = "method" if kind == "function" and parent and any(d[2] == "class" for d in open_ones) else kind
                out.append(_symbol(m.group(1), parent, kind, i + 1, end + 1, calls, [], extends))
                open_ones.append((m.group(1), end, kind))
                covered.update(range(i, end + 1))
                break
    outside = "\n".join(x for i, x in enumerate(lines) if i not in covered and not _IMPORT.match(x))
    calls = [c.group(1) for c in _CALL.finditer(outside) if c.group(1) not in _NOT_CALLS]
    return _module(path, calls, imports) + out


def parse_or_error(path: str, language: str, text: str) -> list[dict]:
    """As ``parse``, but a file that cannot be parsed gives one row of the kind ``error``, whose name says why."""
    try:
        return _python(path, text) if language == "python" else _braced(path, text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        if isinstance(e, MemoryError) and not e.args:  # the parser says that a text is nested too deeply; a worker without memory says nothing
            raise
        return [_symbol(f"{type(e).__name__}: {e}", None, "error", 1, 1)]


def parse(path: str, language: str, text: str) -> list[dict]:
    """The symbols of one file; a declaration's qualified name has its nearest parent's plain name. None where it cannot be parsed."""
    return [s for s in parse_or_error(path, language, text) if s["kind"] != "error"]


def declarations(files: DataFrame, parsed: tuple[str, ...]) -> DataFrame:
    """The symbols of files of the ``parsed`` languages: file_id, path, language and the symbol's fields; errors as ``parse_or_error`` gives them."""

    @F.pandas_udf(f"array<{_PARSED}>")
    def run(paths: pd.Series, languages: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([parse_or_error(p, g, t or "") for p, g, t in zip(paths, languages, texts)])

    found = files.filter(F.col("language").isin(*parsed)).withColumn("s", F.explode(run("path", "language", "content")))
    return found.select("project_id", "file_id", "path", "language", F.concat_ws(":", F.col("file_id").cast("string"), F.col("s.start_line").cast("string"), "s.qualified_name").alias("symbol_id"), "s.*")


def symbols(files: DataFrame, parsed: tuple[str, ...]) -> DataFrame:
    """The symbols alone; files that cannot be parsed have none."""
    return declarations(files, parsed).filter("kind <> 'error'")


def section_symbols(sections: DataFrame) -> DataFrame:
    """The symbols of markdown sections that have a heading, by its name."""
    none = F.array().cast("array<string>")
    return sections.filter("heading IS NOT NULL").select(
        "project_id", "file_id", "path", "language", F.concat_ws(":", F.col("file_id").cast("string"), F.col("start_line").cast("string"), "heading").alias("symbol_id"),
        F.col("heading").alias("name"), F.col("heading").alias("qualified_name"), F.lit("section").alias("kind"), "start_line", "end_line", F.lit(None).cast("string").alias("parent_name"),
        none.alias("calls"), none.alias("imports"), none.alias("extends"),
    )


def with_file_relations(symbols: DataFrame) -> DataFrame:
    """Top-level symbols also have the calls and imports of their file's module symbol, each once."""
    module = symbols.filter("kind = 'module' AND start_line = 1 AND end_line = 1").groupBy("file_id").agg(F.first("calls").alias("file_calls"), F.first("imports").alias("file_imports"))
    both = symbols.join(module, "file_id", "left")
    empty = F.array().cast("array<string>")
    add = lambda own, of: F.when(F.col("parent_name").isNull(), F.array_distinct(F.concat(F.col(own), F.coalesce(of, empty)))).otherwise(F.col(own))
    return both.withColumn("calls", add("calls", F.col("file_calls"))).withColumn("imports", add("imports", F.col("file_imports"))).drop("file_calls", "file_imports")
