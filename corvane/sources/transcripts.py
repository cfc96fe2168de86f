"""Session transcripts as a stream of lines, by file and byte.

``spark.readStream.format("transcripts").load(folder)`` gives the lines that
were added to the folder's ``*.jsonl`` files. The offset holds for each file
its identity and the end of its last whole line, so it is committed when the
batch has been delivered, and a batch that comes again has the same lines. A
file that became shorter, or another of the same name, is read from its
beginning; of a file, at most the last ``scanBytes`` of a batch are read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.constants import SCAN_BYTES

SCHEMA = "session string, seq bigint, line string"
BLOCK = 1 << 16


def last_line_end(path: str, size: int) -> int:
    """Where the last whole line of the first ``size`` bytes ends."""
    with open(path, "rb") as f:
        end = size
        while end:
            begin = max(0, end - BLOCK)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


def listed(root: str) -> dict[str, os.stat_result]:
    return {e.name: e.stat() for e in os.scandir(root) if e.name.endswith(".jsonl") and not e.name.startswith(".") and e.is_file()}


class Span(InputPartition):
    def __init__(self, name: str, begin: int, end: int):
        self.name, self.begin, self.end = name, begin, end


def lines_of(root: str, span: Span) -> Iterator[tuple]:
    """session, where the line ends, and the line; bytes that aren't UTF-8 are replaced."""
    at = span.begin
    try:
        f = open(os.path.join(root, span.name), "rb")  # noqa: SIM115
    except FileNotFoundError:
        return
    with f:
        f.seek(at)
        while at < span.end:
            raw = f.readline(span.end - at)
            if not raw:
                return
            at += len(raw)
            if raw.strip():
                yield span.name.removesuffix(".jsonl"), at, raw.decode("utf-8", "replace").rstrip("\r\n")


class TranscriptReader(DataSourceReader):
    """Whole files, also a last line without its end."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def partitions(self) -> Sequence[Span]:
        return [Span(n, 0, s.st_size) for n, s in sorted(listed(self.root).items())]

    def read(self, partition: Span) -> Iterator[tuple]:
        return lines_of(self.root, partition)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.most = options["path"], int(options.get("scanBytes", SCAN_BYTES))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        out = {}
        for name, stat in sorted(listed(self.root).items()):
            out[name] = [stat.st_ino, last_line_end(os.path.join(self.root, name), stat.st_size)]
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[Span]:
        spans = []
        for name, (file, stop) in end.items():
            before, begin = start.get(name, [file, 0])
            begin = begin if before == file and begin <= stop else 0
            if begin < stop:
                spans.append(Span(name, max(begin, stop - self.most), stop))
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        return lines_of(self.root, partition)

    def commit(self, end: dict) -> None:
        pass


class TranscriptSource(DataSource):
    """Options: path; scanBytes."""

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TranscriptReader:
        return TranscriptReader(dict(self.options))

    def streamReader(self, schema: StructType) -> TailReader:  # noqa: N802
        return TailReader(dict(self.options))


def lines(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    spark.dataSource.register(TranscriptSource)
    return (spark.readStream if stream else spark.read).format("transcripts").load(root)
