"""Changes of a folder of notes as a stream, by manifest versions.

``spark.readStream.format("corpus_changes").option("log", folder).load(root)``
compares the folder with the last manifest that the log holds whenever a batch
begins, and writes a new version if files came, changed (by time and size) or
went. The version is the stream's offset, so a batch that is asked for again
after a restart is cut from the same two versions and gives each change once.

A manifest is split into shards by folder; a version only writes the shards
that differ, and a small file that tells where each shard lies. Tasks compare
a shard's two versions and read the files that differ; the driver lists names.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.constants import EXCLUDED_DIRS

SCHEMA = "path string, removed boolean, change string, content string, mtime timestamp, size bigint, seq bigint"
#: Shards of a manifest.
SHARDS = 64
State = dict[str, list[int]]


def folders(root: str, under: str = "") -> Iterator[tuple[str, State]]:
    """Each folder's relative path with its notes: name to time of change and size."""
    pending = [under]
    while pending:
        at = pending.pop()
        files: State = {}
        try:
            entries = sorted(os.scandir(os.path.join(root, at)), key=lambda e: e.name)
        except FileNotFoundError:  # gone since its parent was listed
            continue
        for e in entries:
            if e.name.startswith("."):
                continue
            path = f"{at}/{e.name}" if at else e.name
            if e.is_dir(follow_symlinks=False):
                if e.name not in EXCLUDED_DIRS:
                    pending.append(path)
            elif e.name.lower().endswith(".md"):
                try:
                    stat = e.stat()
                except FileNotFoundError:
                    continue
                files[path] = [stat.st_mtime_ns, stat.st_size]
        yield at, files


def shard_of(folder: str) -> int:
    return zlib.crc32(folder.encode()) % SHARDS


class Log:
    """Manifest versions in a folder: v<n>.json tells for each shard the version that wrote it."""

    def __init__(self, at: str):
        self.at = at

    def newest(self) -> int:
        names = os.listdir(self.at) if os.path.isdir(self.at) else []
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def shards(self, version: int) -> dict[str, int]:
        if not version:
            return {}
        with open(f"{self.at}/v{version}.json", encoding="utf-8") as f:
            return json.load(f)

    def shard(self, where: dict[str, int], k: int) -> State:
        if str(k) not in where:
            return {}
        with open(f"{self.at}/shards/{where[str(k)]}-{k}.json", encoding="utf-8") as f:
            return json.load(f)

    def _put(self, name: str, value: dict) -> None:
        """The file appears at once."""
        draft = f"{self.at}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as f:
            json.dump(value, f)
        os.replace(draft, f"{self.at}/{name}")

    def follow(self, root: str) -> int:
        """The version that holds the folder as it is now."""
        os.makedirs(f"{self.at}/shards", exist_ok=True)
        last = self.newest()
        where = self.shards(last)
        found: dict[int, State] = {}
        for folder, files in folders(root):
            if files:
                found.setdefault(shard_of(folder), {}).update(files)
        changed = [k for k in sorted({*found, *map(int, where)}) if found.get(k, {}) != self.shard(where, k)]
        if not changed:
            return last
        for k in changed:
            self._put(f"shards/{last + 1}-{k}.json", found.get(k, {}))
        self._put(f"v{last + 1}.json", where | {str(k): last + 1 for k in changed})
        return last + 1


class ShardDiff(InputPartition):
    def __init__(self, shard: int, start: int, end: int):
        self.shard, self.start, self.end = shard, start, end


class ChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.log = options["path"], Log(options["log"])

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"version": self.log.follow(self.root)}

    def partitions(self, start: dict, end: dict) -> Sequence[ShardDiff]:
        old, new = self.log.shards(start["version"]), self.log.shards(end["version"])
        return [ShardDiff(int(k), start["version"], end["version"]) for k in new if old.get(k) != new[k]]

    def read(self, partition: ShardDiff) -> Iterator[tuple]:
        old = self.log.shard(self.log.shards(partition.start), partition.shard)
        new = self.log.shard(self.log.shards(partition.end), partition.shard)
        for path in sorted(old.keys() - new.keys()):
            yield path, True, "removed", None, None, None, partition.end
        for path, (mtime, size) in sorted(new.items()):
            if old.get(path) == [mtime, size]:
                continue
            try:
                with open(os.path.join(self.root, path), encoding="utf-8-sig", errors="replace", newline="") as f:
                    content = f.read()
            except FileNotFoundError:  # a later version tells that it is gone
                continue
            yield path, False, "changed" if path in old else "added", content, datetime.fromtimestamp(mtime / 1e9, UTC), size, partition.end

    def commit(self, end: dict) -> None:
        """Older versions than the one that is done with are deleted, and the shards that only they list."""
        done = end["version"]
        kept = {(v, k) for n in range(done, self.log.newest() + 1) for k, v in self.log.shards(n).items()}
        for name in os.listdir(self.log.at):
            if name.startswith("v") and name.endswith(".json") and int(name[1:-5]) < done:
                os.remove(f"{self.log.at}/{name}")
        for name in os.listdir(f"{self.log.at}/shards"):
            version, k = name[:-5].split("-")
            if int(version) < done and (int(version), k) not in kept:
                os.remove(f"{self.log.at}/shards/{name}")


class ChangesSource(DataSource):
    """Options: path, and log, a folder that the driver and the executors share; one stream for each log."""

    @classmethod
    def name(cls) -> str:
        return "corpus_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> ChangesReader:  # noqa: N802
        return ChangesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangesSource)


def changes(spark: SparkSession, root: str, log: str):
    """The streaming DataFrame of a folder's changes."""
    register(spark)
    return spark.readStream.format("corpus_changes").option("log", log).load(root)
