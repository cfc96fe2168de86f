"""Vectorised kernels over the UTF-8 bytes of an Arrow string column.

All hashes are 64-bit polynomial hashes modulo 2**64 over randomised byte
values, finished by an avalanche mix; they are the same in every worker.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=U) * U(2) + U(1)


VALUES = constants(256, 11)
#: The same with A-Z read as a-z.
VALUES_LOWER = VALUES.copy()
VALUES_LOWER[65:91] = VALUES[97:123]
#: Space and the controls 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 21)
        have = np.full(size, U(base))
        have[0] = U(1)
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets of the rows in them); null counts as empty."""
    arr = pc.fill_null(column, "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    n = len(arr)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def prefix(raw: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """Prefix sums from which span_hash() takes the hash of any span."""
    out = np.zeros(len(raw) + 1, U)
    np.cumsum(values[raw] * _power(_BASE, len(raw)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _power(_UNBASE, len(sums))[start] + (end - start).astype(U) * U(_BASE))


def words(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of bytes not ``apart`` (white space): (starts, ends, first word of each row plus the total)."""
    n = len(raw)
    inside = ~apart[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside
    after = np.empty(n + 1, bool)
    after[:n] = inside
    after[n] = False
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles, in order, and the first of each row plus the total.

    Letters A-Z count as a-z. A row of fewer words has its whole sequence as
    one shingle; a row without words has none.
    """
    starts, ends, first = words(raw, offsets)
    hashes = span_hash(prefix(raw, VALUES_LOWER), starts, ends)
    factors = constants(size, 23)
    count = np.diff(first)
    n = len(hashes)
    if n >= size:
        whole = hashes[: n - size + 1] * factors[0]
        for j in range(1, size):
            whole += hashes[j : n - size + 1 + j] * factors[j]
        whole = mix(whole)
    else:
        whole = np.zeros(0, U)
    made = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    at = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=at[1:])
    # the shingles of row d are whole[first[d] : first[d] + made[d]], but for short rows
    row = np.repeat(np.arange(len(made)), made)
    index = np.arange(at[-1]) - at[row] + first[row]
    out = np.zeros(at[-1], U)
    ok = count[row] >= size
    out[ok] = whole[index[ok]]
    for d in np.flatnonzero((count > 0) & (count < size)):
        own = hashes[first[d] : first[d + 1]]
        out[at[d]] = mix((own * factors[: len(own)]).sum(keepdims=True) + U(len(own)))[0]
    return out, at
