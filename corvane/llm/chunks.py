"""Substring dedup by content-defined chunks.

A gear hash rolls over each text's bytes; where its value meets a mask, a
chunk ends, so an insertion moves only the cuts near it. Chunks are known by a
128-bit digest. Of each chunk that occurs more than once the first occurrence
stays (least doc_id, then offset) and the others can go; runs of neighbouring
repeated chunks count only from LEAST_RUN bytes on, so that short phrases stay,
or where they are a whole text, however short.

Nulls and edge cases: a null or empty text has no chunks; rows with a null
doc_id are left alone; a document repeated under one id counts as two; an
empty table gives an empty result; other columns are ignored. Cuts fall on
bytes; where a text is rewritten they are moved out of characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import constants, text_bytes
from .common import materialise, slices

#: A cut where these bits of the hash are zero: every 32 bytes on average.
MASK = np.uint32(0x1F << 27)
#: Least and most bytes of a chunk (a text's last one may be shorter).
LEAST, MOST = 16, 1024
#: Bytes of neighbouring repeated chunks within a text from which they count.
LEAST_RUN = 128

GEAR = (constants(256, 91) >> np.uint64(32)).astype(np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """Gear hash at each byte, of it and the 31 before: the sum of GEAR[byte] << distance."""
    h = GEAR[raw]
    for width in (1, 2, 4, 8, 16):
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h = more
    return h


def cuts(raw: np.ndarray) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(raw)
    out: list[int] = []
    last = 0
    for end in (np.flatnonzero(gear(raw) & MASK == 0) + 1).tolist():
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST:
            out.append(end)
            last = end
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def chunk_table(docs: DataFrame) -> DataFrame:
    """A row for each chunk: doc_id, copy (rows of equal id), start, size, whether the text's last, and the digest's halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        for batch in slices(batches):
            raw, offsets = text_bytes(batch.column("text"))
            data = raw.tobytes()
            ids, copies = batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist()
            doc, copy, start, size, ends, high = [], [], [], [], [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                last = 0
                for end in cuts(raw[a:b]):
                    high.append(digest(data[a + last : a + end]).to_bytes(16, "little"))
                    start.append(last)
                    size.append(end - last)
                    ends.append(end == b - a)
                    last = end
                done = len(start) - len(doc)
                doc += [ids[i]] * done
                copy += [copies[i]] * done
            halves = np.frombuffer(b"".join(high), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(copy, pa.int64()), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(ends, pa.bool_()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                names=["doc_id", "copy", "start", "size", "is_last", "d1", "d2"],
            )

    rows = docs.where("doc_id is not null").select("doc_id", F.monotonically_increasing_id().alias("copy"), "text")
    return rows.mapInArrow(run, "doc_id long, copy long, start int, size int, is_last boolean, d1 long, d2 long")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """The chunks that occur more than once, with whether each is the first occurrence."""
    # row numbers must not change between the two uses: the chunks are written
    chunks = materialise(chunk_table(docs), "chunks")
    first = F.min(F.struct("doc_id", "copy", "start")).alias("first")
    # written, so that the join deals both sides anew and a hot digest's rows can be split
    shared = materialise(chunks.groupBy("d1", "d2").agg(F.count("*").alias("n"), first).where("n > 1").drop("n"), "shared-chunks")
    at = F.struct("doc_id", "copy", "start")
    return chunks.join(shared, ["d1", "d2"]).select("doc_id", "copy", "start", "size", "is_last", (F.col("first") == at).alias("is_first"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_repeated, bytes_repeated, bytes_removed, repeated, removed.

    One row for each document with a repeated run. ``repeated`` lists the runs
    of chunks that occur more than once, ``removed`` those parts of them of
    which the first occurrence stands elsewhere, as start:end in bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, chunks in zip(batch.column("doc_id").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
                runs: list[list] = []
                for c in chunks:
                    if runs and runs[-1][1] == c["start"]:
                        runs[-1][1] += c["size"]
                        runs[-1][2].append(c)
                    else:
                        runs.append([c["start"], c["start"] + c["size"], [c]])
                runs = [r for r in runs if r[1] - r[0] >= LEAST_RUN or (r[0] == 0 and r[2][-1]["is_last"])]
                gone: list[list[int]] = []
                for _, _, own in runs:
                    for c in own:
                        if not c["is_first"]:
                            if gone and gone[-1][1] == c["start"]:
                                gone[-1][1] += c["size"]
                            else:
                                gone.append([c["start"], c["start"] + c["size"]])
                if runs:
                    total, away = sum(b - a for a, b, _ in runs), sum(b - a for a, b in gone)
                    rows.append((doc, sum(len(r[2]) for r in runs), total, away, ",".join(f"{a}:{b}" for a, b, _ in runs), ",".join(f"{a}:{b}" for a, b in gone)))
            if rows:
                cols = list(zip(*rows, strict=True))
                names = ["doc_id", "n_repeated", "bytes_repeated", "bytes_removed", "repeated", "removed"]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=names)

    own = repeated_chunks(docs).groupBy("doc_id", "copy").agg(F.sort_array(F.collect_list(F.struct("start", "size", "is_last", "is_first"))).alias("chunks"))
    return own.mapInArrow(run, "doc_id long, n_repeated long, bytes_repeated long, bytes_removed long, repeated string, removed string")


def without_spans(text: str, removed: str) -> str:
    """The text without the byte spans listed, which are widened inward to whole characters."""
    data = text.encode()
    out, at = [], 0
    for span in filter(None, removed.split(",")):
        a, b = map(int, span.split(":"))
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]).decode()
