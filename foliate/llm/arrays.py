"""Numpy helpers that work on whole Arrow columns inside a task.

A column of texts is one byte buffer with offsets; hashes, windows and runs are computed over the
buffer and cut at the documents, so no helper loops over bytes or words in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Places of a buffer that are worked on at once.
CHUNK = 1 << 20
STEP = U(0x9E3779B97F4A7C15)
BASE = U(0xD6E8FEB86659FD93)
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


#: One random-looking number per byte value.
BYTE = mix((np.arange(256, dtype=U) + U(1)) * STEP)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Words of a benchmark: digits, letters and everything beyond ASCII.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def longs(column, null: int = -(2**63)) -> np.ndarray:
    """A column of integers; a null takes the smallest value."""
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy(zero_copy_only=False) if isinstance(
        column, pa.Array
    ) else pc.fill_null(column.cast(pa.int64()), null).to_numpy()


def words_of(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
    """Starts and ends of all words and, per document, the range of its words."""
    inside = ~gap[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    limits = offsets[:-1]
    before[limits[limits < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p = np.full(n, BASE, U)
    q = np.full(n, U(pow(int(BASE), -1, 2**64)), U)
    if n:
        p[0] = q[0] = 1
    return np.cumprod(p), np.cumprod(q)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for each pair; ``values`` are bytes or 64-bit hashes.

    Long inputs with ascending starts go by slices, so that the working arrays stay small.
    """
    if len(values) > 2 * CHUNK and len(starts) and (starts[1:] >= starts[:-1]).all():
        cuts = np.unique(np.searchsorted(starts, np.arange(0, len(values) + CHUNK, CHUNK)))
        out = np.empty(len(starts), U)
        for a, b in zip(cuts[:-1], cuts[1:]):
            low, high = starts[a], ends[a:b].max()
            out[a:b] = _range_hashes(values[low:high], starts[a:b] - low, ends[a:b] - low)
        return out
    return _range_hashes(values, starts, ends)


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p, q = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum((BYTE[values] if values.dtype == np.uint8 else values) * p[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * q[starts]
    return mix(h ^ mix((ends - starts).astype(U) * STEP))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each ``k`` consecutive values, by doubling."""
    if len(values) < k:
        return np.zeros(0, U)
    part = BYTE[values] if values.dtype == np.uint8 else values.astype(U)
    size, out, done = 1, None, 0
    rest = k
    while True:
        if rest & 1:
            if out is None:
                out, done = part, size
            else:
                m = len(part) - done
                out = part[:m] * U(pow(int(BASE), done, 2**64)) + out[size : size + m]
                done += size
        rest >>= 1
        if not rest:
            break
        part = part[:-size] * U(pow(int(BASE), size, 2**64)) + part[size:]
        size *= 2
    return mix(out[: len(values) - k + 1])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each ``w`` consecutive values, by doubling."""
    if len(h) < w:
        return h[:0]
    part, size = h, 1
    while size * 2 <= w:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    rest = w - size
    return np.minimum(part[: len(part) - rest], part[rest:]) if rest else part


def segments(values: np.ndarray, offsets: np.ndarray, window: int, k: int):
    """Runs of consecutive windows that share their smallest ``k``-gram hash.

    Returns (first window, number of windows, hash, document) of each run. Equal windows have equal hashes wherever they
    stand, so windows meet their copies under this key although only about 2 in ``window - k + 2``
    positions start a run. Work goes over slices of bounded size; a slice end merely cuts a run.
    """
    n = len(values) - window + 1
    found = []
    for at in range(0, max(n, 0), CHUNK):
        part = values[at : min(at + CHUNK, n) + window - 1]
        m = sliding_min(gram_hashes(part, k), window - k + 1)
        cut = np.ones(len(m), bool)
        np.not_equal(m[1:], m[:-1], out=cut[1:])
        for limit in (offsets[:-1], offsets[1:] - window + 1):
            inside = limit[(limit >= at) & (limit < at + len(m))] - at
            cut[inside] = True
        s = np.flatnonzero(cut)
        c = np.diff(np.append(s, len(m)))
        doc = np.searchsorted(offsets, s + at, side="right") - 1
        keep = s + at + window <= offsets[doc + 1]
        s, c, doc = s[keep], c[keep], doc[keep]
        found.append((s + at, c, mix(m[s] ^ STEP), doc))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All integers of the ranges ``start .. start + count - 1``, one range after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of ``n`` positions lie in at least one of the ranges."""
    d = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(d)[:n] > 0


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of fixed types behind one another, after their lengths in bytes."""
    head = np.array([a.nbytes for a in arrays], np.int64)
    return head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(types))
    at, out = 8 * len(types), []
    for size, kind in zip(sizes, types):
        out.append(np.frombuffer(blob, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


#: What a worker process remembers between tasks, by owner.
MEMORIES: dict[str, object] = {}


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20, owner: str | None = None):
    """Row ranges of a batch with at most ``limit`` bytes of text each (or one row).

    A worker serves tasks of several operators; what others than ``owner`` have remembered is dropped first.
    """
    for name in [*MEMORIES]:
        if name != owner:
            del MEMORIES[name]
    column = batch.column(batch.schema.get_field_index(text))
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size.astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, stop - at)
        # Arrow keeps freed memory otherwise, in each worker beside the others of its executor.
        pa.default_memory_pool().release_unused()
        at = stop


def with_columns(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """The batch with more columns behind its own."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])
