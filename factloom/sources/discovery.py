"""Java files of a repository folder: walked without following links, guarded, bounded, attributed to modules, decoded strictly.

The walk is the driver's, as Spark's file sources do not tell links from files; it holds one small row per file and is bounded by the
scan's limits. Contents are read by the executors, which have to reach the folder.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import ident
from factloom.plans.model import FactError

#: Fixed values of the model: folders that hold no sources unless they lie in a source tree.
SKIPPED = frozenset((".git", ".gradle", "build", "out", "target"))
_TREE = ("src", "main", "java")
PARSE_DIAGNOSTIC = "project_id string, code string, path string, line int, column int, message string"


@dataclass(frozen=True)
class ScanLimits:
    """Budgets of a scan. They fail it, they never shorten it."""

    max_files: int = 10_000
    max_file_bytes: int = 2 << 20
    max_total_bytes: int = 100 << 20
    max_depth: int = 32

    def __post_init__(self):
        if min(self.max_files, self.max_file_bytes, self.max_total_bytes, self.max_depth) < 1 or self.max_total_bytes < self.max_file_bytes:
            raise ValueError("limits have to be positive, and the total at least that of a file")


@dataclass(frozen=True)
class Discovery:
    root: str
    files: list[tuple[str, str, int]]  # path, module path, bytes
    poms: list[str]
    diagnostics: list[tuple[str, str, int, int, str]]  # code, path, line, column, message


def _module(root: str, parts: tuple[str, ...]) -> str | None:
    """The folder in front of the first src/main/java, if it holds a pom.xml; '.' for the root."""
    for i in range(len(parts) - 3):
        if parts[i : i + 3] == _TREE:
            return ("/".join(parts[:i]) or ".") if _regular(os.path.join(root, *parts[:i], "pom.xml")) else None
    return None


def _regular(path: str) -> bool:
    try:
        return stat.S_ISREG(os.lstat(path).st_mode)
    except OSError:
        return False


def discover(root: str, limits: ScanLimits = ScanLimits()) -> Discovery:
    """Files sorted by path, POMs of their modules, and what was passed over. Limits and a bad root raise a FactError."""
    if os.path.islink(root):
        raise FactError("java.path.root-symlink")
    if not os.path.isdir(root):
        raise FactError("java.path.invalid-root")
    root = os.path.abspath(root)
    files: list[tuple[str, str, int]] = []
    diagnostics: list[tuple[str, str, int, int, str]] = []
    total = 0
    passed = lambda code, parts, what: diagnostics.append((code, "/".join(parts), 1, 1, what))
    todo: list[tuple[str, ...]] = [()]
    while todo:
        folder = todo.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, *folder)), key=lambda e: e.name)
        except OSError:
            passed("java.path.unreadable", folder, "repository entry was unreadable")
            continue
        for e in entries:
            parts = (*folder, e.name)
            if len(parts) > limits.max_depth:
                raise FactError("java.limit.depth")
            source = e.name.endswith(".java")
            if e.is_symlink():
                within = any(parts[i : i + 3] == _TREE for i in range(len(parts) - 3))
                if os.path.isdir(e.path) or (source and within):
                    passed("java.path.symlink", parts, "symbolic link was skipped")
                continue
            if e.is_dir(follow_symlinks=False):
                if e.name not in SKIPPED or _module(root, (*parts, "")) is not None:
                    todo.append(parts)
                continue
            module = _module(root, parts) if source else None
            if module is None:
                continue
            if not e.is_file(follow_symlinks=False):
                passed("java.path.special-file", parts, "non-regular Java source was skipped")
                continue
            size = e.stat(follow_symlinks=False).st_size
            if size > limits.max_file_bytes:
                raise FactError("java.limit.file-bytes")
            if len(files) >= limits.max_files:
                raise FactError("java.limit.files")
            total += size
            if total > limits.max_total_bytes:
                raise FactError("java.limit.total-bytes")
            files.append(("/".join(parts), module, size))
    files.sort()
    poms = sorted({"pom.xml" if m == "." else f"{m}/pom.xml" for _, m, _ in files})
    return Discovery(root, files, poms, sorted(diagnostics))


def read_texts(spark: SparkSession, root: str, paths: DataFrame, code: str = "java", limit: int = ScanLimits.max_file_bytes) -> tuple[DataFrame, DataFrame]:
    """(paths with a column text, diagnostics): the files' contents in strict UTF-8, read where the tasks run.

    A file that is no UTF-8 has no row but a diagnostic; so has one that became a link, left the root, or grew over the limit meanwhile.
    paths: project_id, path and what else is to be kept.
    """
    import pyarrow as pa

    real = os.path.realpath(root)

    def one(path: str) -> tuple[str | None, str | None]:
        full = os.path.join(root, path)
        try:
            if os.path.islink(full):
                return None, f"{code}.path.symlink"
            if not os.path.realpath(full).startswith(os.path.join(real, "")):
                return None, f"{code}.path.escape"
            if not _regular(full):
                return None, f"{code}.path.special-file"
            data = Path(full).read_bytes()
            if len(data) > limit:
                return None, f"{code}.limit.file-bytes"
            return data.decode("utf-8"), None
        except UnicodeDecodeError:
            return None, f"{code}.encoding.invalid"
        except OSError:
            return None, f"{code}.parse.failed"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(p) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=[*b.schema.names, "text", "problem"])

    schema = ", ".join(f"`{n}` {t}" for n, t in paths.dtypes) + ", text string, problem string"
    read = paths.mapInArrow(run, schema)
    bad = read.where("problem is not null").select("project_id", F.col("problem").alias("code"), "path", F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("file could not be read as UTF-8 text within the root").alias("message"))
    return read.where("problem is null").drop("problem"), bad


def attributed(files: DataFrame, poms: DataFrame) -> DataFrame:
    """project_id, path, module_path of Java files below a module's src/main/java, for paths in tables; others are dropped.

    files, poms: project_id, path. The module is what stands in front of the first src/main/java, if the project has a POM there.
    """
    module = F.when(F.col("path").startswith("src/main/java/"), ".").otherwise(F.regexp_extract("path", r"^(.*?)/src/main/java/", 1))
    java = files.select("project_id", "path").distinct().where(F.col("path").endswith(".java")).withColumn("module_path", module).where("module_path <> ''")
    at = poms.where("path = 'pom.xml' or path like '%/pom.xml'").select("project_id", F.when(F.col("path") == "pom.xml", ".").otherwise(F.regexp_replace("path", "/pom.xml$", "")).alias("module_path"))
    return java.join(at.distinct(), ["project_id", "module_path"], "left_semi").select("project_id", "path", "module_path")


def budgets(files: DataFrame, path: str = "repository_path", size: str = "byte_size") -> DataFrame:
    """project_id, n_files, n_bytes, largest, depth: what the budgets of a scan count, per project."""
    depth = F.size(F.split(ident.norm_path(path), "/"))
    return files.groupBy("project_id").agg(F.count("*").alias("n_files"), F.sum(size).alias("n_bytes"), F.max(size).alias("largest"), F.max(depth).cast("long").alias("depth"))


def over_budget(counted: DataFrame, limits: ScanLimits = ScanLimits()) -> DataFrame:
    """project_id, code of each budget that budgets() found broken."""
    checks = (("depth", "depth", limits.max_depth), ("n_files", "files", limits.max_files), ("largest", "file-bytes", limits.max_file_bytes), ("n_bytes", "total-bytes", limits.max_total_bytes))
    codes = F.array_compact(F.array(*(F.when(F.col(c) > most, F.lit(f"java.limit.{name}")) for c, name, most in checks)))
    return counted.select("project_id", F.explode(codes).alias("code"))
