"""A Python data source that walks a source tree, and a driver-side helper that clones one.

Spark's own file listing hides names that begin with an underscore or a dot, so package initialisers would be lost; this
source prunes folders only.  One partition is one top-level entry; contents are read only when asked for.
"""

from __future__ import annotations

import logging
import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from codeloom.operators.manifest import EXTENSIONS, IGNORED


class SourceError(Exception):
    """A tree that can't be fetched, is too large, or holds what can't be read."""


class _Subtree(InputPartition):
    def __init__(self, root: str, entry: str) -> None:
        self.root, self.entry = root, entry


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.content = options.get("content", "false").lower() == "true"
        given = options.get("extensions")
        self.extensions = dict(x.split("=", 1) for x in given.split(",")) if given else EXTENSIONS
        self.ignored = set(options["ignored"].split(",")) if options.get("ignored") else set(IGNORED)

    def _pruned(self, name: str) -> bool:
        return name.startswith(".") or name in self.ignored

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise SourceError(f"no such folder: {self.root}")
        return [_Subtree(self.root, e.name) for e in sorted(os.scandir(self.root), key=lambda e: e.name) if not (e.is_dir() and self._pruned(e.name))] or [_Subtree(self.root, "")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.entry:
            return
        top = Path(partition.root) / partition.entry
        if top.is_file():
            yield from self._file(top, partition.root)
            return
        for folder, folders, names in os.walk(top):
            folders[:] = sorted(d for d in folders if not self._pruned(d))
            for n in sorted(names):
                yield from self._file(Path(folder) / n, partition.root)

    def _file(self, path: Path, root: str) -> Iterator[tuple]:
        language = self.extensions.get(path.suffix.lower())
        if language is None:
            return
        try:
            size = path.stat().st_size
            content = path.read_bytes() if self.content else None
        except OSError as e:
            logging.getLogger(__name__).warning("%s can't be read and is passed over: %s", path, e)
            return
        relative = path.relative_to(root).as_posix()
        yield (relative, language, size, content) if self.content else (relative, language, size)


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``: path, language, size_bytes, and content where option content is true.

    Options: extensions (``.py=python,.pyi=python``), ignored (folder names, separated by commas).
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        base = "path string, language string, size_bytes bigint"
        return base + ", content binary" if self.options.get("content", "false").lower() == "true" else base

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def discover(spark: SparkSession, root: str, content: bool = False, max_bytes: int | None = None, extensions: dict[str, str] | None = None) -> DataFrame:
    """The manifest of a tree, sorted by path; an error if the matched files have more than ``max_bytes``."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("content", str(content).lower())
    if extensions:
        reader = reader.option("extensions", ",".join(f"{k}={v}" for k, v in extensions.items()))
    found = reader.load(root)
    if max_bytes is not None:
        total = found.agg({"size_bytes": "sum"}).first()[0] or 0
        if total > max_bytes:
            raise SourceError(f"the tree has {total} bytes; the limit is {max_bytes}")
    return found.orderBy("path")


def from_sources(spark: SparkSession, sources: list[tuple[str, str]], repo_id: int = 0) -> DataFrame:
    """In-memory sources as a files relation: (path, text) pairs."""
    rows = [(i, repo_id, path, None, len(text.encode()), text) for i, (path, text) in enumerate(sources)]
    return spark.createDataFrame(rows, "file_id bigint, repo_id int, path string, language string, size_bytes bigint, content string")


class Clone:
    """A repository cloned to a fresh folder, which stays until ``close``.

    The clone is made on the driver; on a cluster ``parent`` must name a folder that all executors see, since they read the tree.
    """

    def __init__(self, url: str, branch: str | None = None, shallow: bool = True, depth: int = 1, timeout: int = 600, parent: str | None = None) -> None:
        self.url = Path(url).resolve().as_uri() if os.path.isdir(url) else url  # a depth needs an address, not a path
        self.branch, self.depth, self.timeout = branch, (depth if depth > 0 else 1) if shallow else 0, timeout
        self.path: str | None = None
        self.parent = parent

    def command(self, target: str) -> list[str]:
        return ["git", "clone", *(["--depth", str(self.depth)] if self.depth else []), *(["--branch", self.branch] if self.branch else []), "--", self.url, target]

    def fetch(self) -> str:
        """The folder of the clone; any failure removes it and raises SourceError."""
        self.path = tempfile.mkdtemp(prefix="clone-", dir=self.parent)
        try:
            done = subprocess.run(self.command(self.path), capture_output=True, text=True, timeout=self.timeout, check=False)
            if done.returncode:
                raise SourceError(f"git clone failed: {done.stderr.strip()}")
            return self.path
        except SourceError:
            self.close()
            raise
        except (OSError, subprocess.SubprocessError) as e:
            self.close()
            raise SourceError(f"git clone failed: {e}") from e

    def close(self) -> None:
        path, self.path = self.path, None
        if path:
            shutil.rmtree(path, ignore_errors=True)

    def __enter__(self) -> str:
        return self.fetch()

    def __exit__(self, *_: object) -> None:
        self.close()
