"""What a path says about a file: language, category, and whether it is indexed at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages in order of declaration, each with the endings of its base names.
LANGUAGES = {
    "typescript": [".ts", ".mts", ".cts"], "tsx": [".tsx"], "javascript": [".js", ".mjs", ".cjs", ".jsx"], "python": [".py"], "go": [".go"], "rust": [".rs"],
    "java": [".java"], "c": [".c", ".h"], "cpp": [".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx"], "csharp": [".cs"], "php": [".php"], "ruby": [".rb"],
    "bash": [".sh", ".bash", ".zsh"], "json": [".json", ".jsonc"], "css": [".css", ".scss", ".sass", ".less"], "html": [".html", ".htm", ".vue", ".svelte"],
    "markdown": [".md", ".mdx", ".markdown"], "yaml": [".yaml", ".yml"], "toml": [".toml"], "sql": [".sql"],
    "dockerfile": ["Dockerfile", "Containerfile"], "makefile": ["Makefile", "makefile", "GNUMakefile"],
}
#: Languages whose declarations are parsed; files of the others are cut into blocks.
PARSED = ("typescript", "tsx", "javascript", "python", "go", "rust", "java", "c", "cpp", "csharp", "php", "ruby", "bash")
#: Folders and endings that are never indexed.
SKIPPED_FOLDERS = [
    ".git", "node_modules", ".venv", "venv", "dist", "build", "target", ".next", "__pycache__", ".cache", "coverage", ".pytest_cache",
    "vendor", "bower_components", ".terraform", "Pods", ".gradle", ".idea", ".vscode",
]
SKIPPED_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "bmp", "tiff", "woff", "woff2", "ttf", "otf", "eot", "mp4", "mp3", "mov", "avi", "pdf", "zip", "gz", "tar", "tgz",
    "bz2", "7z", "jar", "war", "class", "pyc", "o", "a", "so", "dylib", "dll", "exe", "wasm", "lock", "lockb",
]
SKIPPED_NAMES = [".gitignore", ".dockerignore", ".gitmodules"]
#: What marks base names of each category: words between points, endings, beginnings and whole names.
TEST_WORDS, TEST_PIECES = ["test", "spec", "tests"], [".test.", ".spec.", "__tests__"]
DOCUMENT_EXTENSIONS = ["md", "mdx", "markdown", "rst", "txt", "adoc"]
SETTING_EXTENSIONS = ["json", "jsonc", "yaml", "yml", "toml", "ini", "cfg", "conf", "config", "properties", "env", "editorconfig", "gitignore", "dockerignore", "lock", "lockb"]
SETTING_WHOLE = ["Dockerfile", "Containerfile", "Makefile", "makefile", "GNUMakefile", "go.mod", "go.sum", "Pipfile"]
SETTING_STARTS = [".env", "vitest.config", "jest.config", "next.config", "eslint.config", "prettier.config"]


def _plain(names: list[str]) -> str:
    return "|".join(n.replace(".", r"\.") for n in names)


#: The patterns made of them; the first category that fits decides.
SKIPPED_ENDINGS = rf"\.({_plain(SKIPPED_EXTENSIONS)})$"
TEST_NAMES = rf"\.({_plain(TEST_WORDS)})\.[a-z0-9]+$|_test\.[a-z0-9]+$|^test_|{_plain(TEST_PIECES)}"
DOCUMENT_NAMES = rf"\.({_plain(DOCUMENT_EXTENSIONS)})$"
SETTING_NAMES = rf"\.({_plain(SETTING_EXTENSIONS)})$|^({_plain(SETTING_WHOLE)})$|^({_plain(SETTING_STARTS)})"
#: Pieces of a path that make it a test file to the structural search.
TEST_PATHS = [".test.", ".spec.", "_test.", "__tests__", "/tests/", "/test/"]
MAX_BYTES = 1_000_000


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language(path: Column) -> Column:
    """The first language one of whose endings the base name has, else ``text``."""
    base, out = base_name(path), None
    for name, endings in LANGUAGES.items():
        fits = base.rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("text")


def category(path: Column) -> Column:
    base = base_name(path)
    return (
        F.when(base.rlike(TEST_NAMES), "test")
        .when(base.rlike(DOCUMENT_NAMES) | path.rlike("^docs?/"), "documentation")
        .when(base.rlike(SETTING_NAMES), "configuration")
        .otherwise("code")
    )


def chunk_type(own: Column, of_file: Column) -> Column:
    """Documentation if either says so, else the file's test or configuration, else code."""
    return F.when((own == "documentation") | (of_file == "documentation"), "documentation").when(of_file.isin("test", "configuration"), of_file).otherwise("code")


def skipped(path: Column) -> Column:
    folders = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in SKIPPED_FOLDERS]))
    return folders | base_name(path).rlike(SKIPPED_ENDINGS) | base_name(path).isin(SKIPPED_NAMES)


def is_test_path(path: Column) -> Column:
    return reduce(lambda a, b: a | b, (path.contains(x) for x in TEST_PATHS)) | path.startswith("test_")


def skip_reason(path: Column, content: Column) -> Column:
    """Why a file (its bytes) is not indexed: path, size, empty or binary; null if it is."""
    n = F.length(content)
    return F.when(skipped(path), "path").when(n > MAX_BYTES, "size").when(n == 0, "empty").when(F.position(F.lit(b"\x00"), content) > 0, "binary")
