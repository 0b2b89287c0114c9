"""Source files from folders: listed on the driver, read by the executors."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import glob_regex
from tessera.operators.languages import NOT_SOURCE, SPECIAL_NAMES, extension_map
from tessera.operators.routing import ignore_regexes

# Folders that hold no own source, and the marks of a binary file.
DEFAULT_EXCLUDES = [
    "node_modules", ".git", ".hg", ".svn", "dist", "build", "out", "target", "vendor", "venv",
    ".venv", "env", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", "coverage", ".next", ".nuxt", ".gradle",
    ".idea", ".vscode", "bin", "obj", "Pods", ".dart_tool", "bower_components", "third_party",
]
# The same for a workspace of several folders.
WORKSPACE_EXCLUDES = [
    "node_modules", ".git", "venv", ".venv", "env", "__pycache__", "dist", "build", "out", "target",
    "bin", "obj", ".next", ".nuxt", "vendor", "Pods", ".gradle", ".idea", ".vscode-test", "coverage",
    ".dart_tool", "_build", "deps", ".mypy_cache", ".pytest_cache", ".tox", "site-packages", ".terraform",
]
PROBE_BYTES = 8192
MOST_IGNORE_FILES = 2000


class IgnoreRules:
    """Nested ignore files: each acts below its own folder, later patterns override earlier ones, ! takes back."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, bool, re.Pattern]] = []
        self.files = 0

    def add(self, base: str, text: str) -> None:
        if self.files >= MOST_IGNORE_FILES:
            return
        self.files += 1
        for raw in text.splitlines():
            line = raw.rstrip()
            if not line or line.startswith("#"):
                continue
            back = line.startswith("!")
            for r in ignore_regexes(line.removeprefix("!")):
                self.rules.append((base, back, re.compile(r)))

    def ignores(self, path: str) -> bool:
        out = False
        for base, back, regex in self.rules:
            if (not base or path.startswith(base + "/")) and regex.match(path[len(base) + 1 if base else 0 :]):
                out = not back
        return out


def _language(name: str, extra: tuple[str, ...]) -> str | None:
    base = name.lower()
    ext = base[base.rfind(".") :] if "." in base else ""
    if base in SPECIAL_NAMES:
        return SPECIAL_NAMES[base]
    if not ext or ext in NOT_SOURCE:
        return None
    if ext == ".ipynb":
        return "notebook:python"
    return extension_map().get(ext) or (f"tier2:{ext[1:]}" if ext in [e.lower() for e in extra] else None)


def list_files(root: str, excludes: tuple[str, ...] = (), extra_extensions: tuple[str, ...] = (), folders: tuple[str, ...] = tuple(DEFAULT_EXCLUDES)) -> list[tuple[str, str, str]]:
    """(absolute path, path below root, language key) of each source file, by path.

    Links are not followed, folders that can't be read are passed over, excluded and dot folders are not entered.
    """
    out, ignore, globs = [], IgnoreRules(), [re.compile(glob_regex(g)) for g in excludes]
    for folder, below, names in os.walk(root, followlinks=False):
        base = os.path.relpath(folder, root).replace(os.sep, "/")
        base = "" if base == "." else base
        if ".gitignore" in names:
            try:
                with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                    ignore.add(base, f.read())
            except OSError:
                pass
        join = lambda n, base=base: f"{base}/{n}" if base else n
        below[:] = sorted(d for d in below if d not in folders and not d.startswith(".") and not os.path.islink(os.path.join(folder, d)) and not ignore.ignores(join(d)))
        for n in names:
            path, full = join(n), os.path.join(folder, n)
            key = _language(n, extra_extensions)
            if key and not os.path.islink(full) and not any(g.match(path) for g in globs) and not ignore.ignores(path):
                out.append((full, path, key))
    return sorted(out, key=lambda x: x[1])


def list_roots(roots: list[str], excludes: tuple[str, ...] = (), extra_extensions: tuple[str, ...] = ()) -> list[tuple[str, str, str]]:
    """The same for a workspace: each folder has its own ignore files, and paths begin with its name where there are several."""
    out = []
    for root in roots:
        name = os.path.basename(os.path.abspath(root))
        out += [(full, f"{name}/{path}" if len(roots) > 1 else path, key) for full, path, key in list_files(root, excludes, extra_extensions, tuple(WORKSPACE_EXCLUDES))]
    return sorted(out, key=lambda x: x[1])


def read_files(spark: SparkSession, listed: list[tuple[str, str, str]], max_kb: int = 1024) -> DataFrame:
    """path, language_key, text and skip_reason of listed files. The folder must be one that all executors see.

    A file is too large, binary (a NUL among its first bytes) or unreadable, in this order, or has its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, reasons = [], []
            for full in batch.column(0).to_pylist():
                text = reason = None
                try:
                    if os.path.islink(full):
                        reason = "link"
                    elif os.path.getsize(full) > max_kb * 1024:
                        reason = "too large"
                    else:
                        with open(full, "rb") as f:
                            data = f.read()
                        if b"\0" in data[:PROBE_BYTES]:
                            reason = "binary"
                        else:
                            text = data.decode("utf-8", "replace")
                except OSError as e:
                    reason = f"unreadable ({e.strerror})"
                texts.append(text)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(reasons, pa.string())], names=["path", "language_key", "text", "skip_reason"])

    paths = spark.createDataFrame(listed, "full string, path string, language_key string")
    return paths.repartition(max(1, min(len(listed) // 64, 10_000))).mapInArrow(run, "path string, language_key string, text string, skip_reason string")


def read_folder(spark: SparkSession, root: str, **options) -> DataFrame:
    return read_files(spark, list_files(root, **options))


def read_store(spark: SparkSession, url: str, max_kb: int = 1024) -> DataFrame:
    """The same from any store that Spark reads (path, text and skip_reason), without a listing of its own. Spark leaves out names that start with _ or a dot."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(url)
    large, binary = F.col("length") > max_kb * 1024, F.contains(F.substring("content", 1, PROBE_BYTES), F.unhex(F.lit("00")))
    reason = F.when(large, "too large").when(binary, "binary")
    return raw.select("path", F.when(reason.isNull(), F.decode("content", "UTF-8")).alias("text"), reason.alias("skip_reason"))
