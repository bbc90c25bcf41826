"""The file manifest: which paths of a tree belong to it, and guards over their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: languages by extension, and folders that are not descended into
EXTENSIONS = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript"}
IGNORED = ["node_modules", "venv", "env", "__pycache__", "dist", "build", "target", "vendor"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column, extensions: dict[str, str] | None = None) -> Column:
    """The language of a path's extension, whatever its letter case; null if it has none."""
    pairs = [F.lit(x) for kv in (extensions or EXTENSIONS).items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def is_pruned(path: Column, ignored: list[str] | None = None) -> Column:
    """Whether a folder of the path is ignored or hidden; the file's own name is not looked at."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(folders, lambda d: d.startswith(".") | d.isin(*(ignored or IGNORED)))


def manifest(files: DataFrame, extensions: dict[str, str] | None = None, ignored: list[str] | None = None) -> DataFrame:
    """(repo_id, path, language, size_bytes) of the files that discovery keeps, each once; sizes are the contents' own."""
    size = F.coalesce(F.octet_length("content").cast("bigint"), F.col("size_bytes"))
    kept = files.where(F.col("path").isNotNull() & ~is_pruned(F.col("path"), ignored)).select("repo_id", "path", language(F.col("path"), extensions).alias("language"), size.alias("size_bytes"))
    return kept.where("language is not null").distinct()


def size_check(entries: DataFrame, limit: int) -> DataFrame:
    """(repo_id, files, total_bytes, too_large): only matched files count; a repository fails above the limit, not at it."""
    return entries.groupBy("repo_id").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("total_bytes")).withColumn("too_large", F.col("total_bytes") > limit)


def ascii_violations(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no) of each line with a character other than tab and the printable ASCII ones."""
    lines = rows.where(F.col(text).rlike(r"[^\t\n -~]")).select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    return lines.where(F.col("line").rlike(r"[^\t -~]")).select(key, (F.col("n") + 1).alias("line_no")).distinct()


def guarded_paths(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Paths that a guard refuses, as LIKE patterns."""
    bad = F.lit(False)
    for p in patterns:
        bad = bad | F.col("path").like(p)
    return files.where(bad).select("path").distinct()
