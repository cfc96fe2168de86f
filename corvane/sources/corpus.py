"""Note files as a data source, and incremental scans by manifest.

``spark.read.format("corpus").load(folder)`` lists a folder as the built-in
text sources can't: names that begin with an underscore are read, those that
begin with a dot and the excluded folders are not.

The options ``prefixes`` and ``only`` (JSON lists of prefixes and of paths) leave paths out before
anything is read: only folders that can hold wanted paths are entered, only
wanted files opened. They are options and no pushed conditions, as Spark keeps
pushed conditions of a Python source with the loaded table: two branches of a
plan that use it under different conditions would both get the later ones.

The driver lists a bounded number of folders; the rest are listed by the tasks
that read them.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import text as X
from ..functions.constants import ADAPTER_FOLDERS, EXCLUDED_DIRS

SCHEMA = "path string, content string, mtime timestamp, size bigint"


def walk(root: str) -> list[str]:
    """Relative paths of all files in folded order."""
    out = []
    for folder, folders, files in os.walk(root):
        folders[:] = [f for f in folders if not f.startswith(".") and f not in EXCLUDED_DIRS]
        out += [os.path.relpath(os.path.join(folder, f), root).replace(os.sep, "/") for f in files if not f.startswith(".")]
    return sorted(out, key=lambda p: (p.casefold(), p))


def adapters(root: str) -> list[str]:
    """Relative paths of the adapter stubs, which lie in hidden folders."""
    found = []
    for folder in ADAPTER_FOLDERS:
        at = os.path.join(root, folder)
        names = sorted(os.listdir(at)) if os.path.isdir(at) else []
        found += [f"{folder}/{n}/SKILL.md" for n in names if os.path.isfile(os.path.join(at, n, "SKILL.md"))]
    return found


def entries(root: str, folder: str) -> tuple[list[str], list[str]]:
    """Relative paths of the files and of the folders in one folder, without hidden and excluded ones."""
    files, folders = [], []
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            for e in found:
                own = f"{folder}/{e.name}" if folder else e.name
                if e.name.startswith("."):
                    continue
                try:
                    is_folder = e.is_dir()
                except OSError:  # a link that leads nowhere: reading it will say so
                    is_folder = False
                if not is_folder:
                    files.append(own)
                elif e.name not in EXCLUDED_DIRS and not e.is_symlink():
                    folders.append(own)
    except FileNotFoundError:  # gone since its parent was listed
        pass
    return files, folders


class Wanted:
    """Paths that have one of the prefixes and are one of the paths; no list leaves all."""

    def __init__(self, prefixes: list[str] | None, paths: list[str] | None):
        self.prefixes = None if prefixes is None else tuple(prefixes)
        self.paths = None if paths is None else frozenset(paths)
        self.above = None if paths is None else {p[: i + 1] for p in paths for i, c in enumerate(p) if c == "/"}

    def file(self, path: str) -> bool:
        return (self.prefixes is None or path.startswith(self.prefixes)) and (self.paths is None or path in self.paths)

    def folder(self, path: str) -> bool:
        """Whether a wanted path can lie below the folder."""
        below = path + "/"
        under = self.prefixes is None or below.startswith(self.prefixes) or any(p.startswith(below) for p in self.prefixes)
        return under and (self.above is None or below in self.above)


def listed(value: str | None) -> list[str] | None:
    return None if value is None else json.loads(value)


class FileGroup(InputPartition):
    """Files to read, and folders to list and read with all below them."""

    def __init__(self, paths: list[str], folders: list[str] = ()):
        self.paths = paths
        self.folders = list(folders)


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.kind = options.get("kind", "notes")
        self.group = int(options.get("filesPerPartition", "256"))
        self.on_driver = int(options.get("foldersOnDriver", "4096"))
        self.wanted = Wanted(listed(options.get("prefixes")), listed(options.get("only")))

    def takes(self, path: str) -> bool:
        of_kind = self.kind in ("all", "adapters") or path.lower().endswith(".md") == (self.kind == "notes")
        return of_kind and self.wanted.file(path)

    def partitions(self) -> list[FileGroup]:
        if self.kind == "adapters":
            paths, left = adapters(self.root), []
        else:
            paths, left, seen = [], [""], 0
            while left and seen < self.on_driver:  # breadth first, so that what is left are folders of like depth
                nxt = []
                for i, folder in enumerate(left):
                    if seen == self.on_driver:
                        nxt += left[i:]
                        break
                    files, folders = entries(self.root, folder)
                    paths += files
                    nxt += [f for f in folders if self.wanted.folder(f)]
                    seen += 1
                left = nxt
        paths = sorted((p for p in paths if self.takes(p)), key=lambda p: (p.casefold(), p))
        groups = [FileGroup(paths[i : i + self.group]) for i in range(0, len(paths), self.group)]
        return groups + [FileGroup([], [f]) for f in sorted(left)] or [FileGroup([])]

    def below(self, folders: list[str]) -> Iterator[str]:
        left = list(folders)
        while left:
            files, inner = entries(self.root, left.pop())
            yield from (p for p in sorted(files, key=lambda p: (p.casefold(), p)) if self.takes(p))
            left += [f for f in sorted(inner, reverse=True) if self.wanted.folder(f)]

    def read(self, partition: FileGroup) -> Iterator[tuple]:
        for p in itertools.chain(partition.paths, self.below(partition.folders)):
            full = os.path.join(self.root, p)
            try:
                stat = os.stat(full)
                content = None
                if self.kind in ("notes", "adapters"):
                    with open(full, encoding="utf-8-sig", errors="replace", newline="") as f:
                        content = f.read()
            except FileNotFoundError:  # gone since the listing
                continue
            yield p, content, datetime.fromtimestamp(stat.st_mtime, UTC), stat.st_size


class CorpusSource(DataSource):
    """Options: path; kind = notes (default), assets, all or adapters; filesPerPartition; prefixes, only; foldersOnDriver."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CorpusReader:
        return CorpusReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CorpusSource)


def scan(spark: SparkSession, root: str, kind: str = "notes", prefixes: Iterable[str] | None = None, paths: Iterable[str] | None = None) -> DataFrame:
    """The files of a folder; with ``prefixes`` or ``paths``, those whose path has one of them or is one of them."""
    register(spark)
    reader = spark.read.format("corpus").option("kind", kind)
    for name, some in (("prefixes", prefixes), ("only", paths)):
        if some is not None:
            reader = reader.option(name, json.dumps(list(some)))
    return reader.load(root)


def remote_scan(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """The same columns from a store that only Spark reads; names with a leading underscore are not listed there."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    path = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/+", "")
    return rows.select(path.alias("path"), F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "").alias("content"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def manifest_diff(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """path, change: added, removed, changed or unchanged by (mtime, size)."""
    old = stored.select("path", F.struct("mtime", "size").alias("old"))
    new = listed.select("path", F.struct("mtime", "size").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return old.join(new, "path", "full_outer").select("path", change.alias("change"))


def incremental(stored_notes: DataFrame, listed: DataFrame, load: callable) -> DataFrame:
    """Stored notes brought up to date; only files that are new or changed are read and parsed.

    ``load(paths)`` gives notes for a DataFrame of paths.
    """
    diff = manifest_diff(stored_notes, listed)
    fresh = load(diff.where("change in ('added', 'changed')").select("path"))
    kept = stored_notes.join(diff.where("change = 'unchanged'").select("path"), "path", "left_semi")
    return kept.unionByName(fresh)


def names_unique(files: DataFrame) -> DataFrame:
    """Folded file names that one file only has."""
    return files.groupBy(X.fold(X.basename(F.col("path"))).alias("name")).agg(F.count("*").alias("n"), F.max("path").alias("path")).where("n = 1").drop("n")
