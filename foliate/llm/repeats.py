"""Repeated windows across documents: the plan behind substring removal over bytes and over words.

A window is hit when its content also starts in a document with a smaller id. Three passes over the
texts, dealt once by document id (one exchange, reused by all passes):

1. *Keys.* Runs of windows that share their smallest inner hash carry that hash as a key. Each group of
   documents sends its distinct keys, five bytes each, to the bucket of the key; a key seen in only
   one document is of no further interest.
2. *Contents.* Runs whose key is shared send their content to the bucket of the key, once per distinct
   content and group with its smallest and largest id. So a passage in a third of all documents costs
   one row per group of documents, not one per document. The bucket finds, for each window,
   the smallest id (``judge``: suffix arrays or suffix automata) and answers the groups.
   A key of more than ``SPLIT`` distinct contents is split: its windows are contents of their own, dealt by the
   hash of the whole window. Equal windows still meet, and a common phrase between different neighbours fills no bucket.
3. *Removal.* Each group marks the hit windows in its own documents.

Hashes choose candidates and name contents (64 bits); the judges compare windows exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm import arrays as A
from foliate.llm.common import group_count, group_of

GROUP_BYTES = 8 << 20
#: Distinct contents (counted by group of documents) above which the windows of a key are dealt one by one.
SPLIT = 4096


class Bytes:
    """Texts as bytes."""

    def __init__(self, data, offsets):
        self.data, self.values, self.offsets = data, data, offsets
        self.first = self.last = None

    def byte_range(self, start, end):
        return start, end

    def kept(self, doc: int, hit: np.ndarray) -> bytes:
        a, b = self.offsets[doc], self.offsets[doc + 1]
        return self.data[a:b][~hit[a:b]].tobytes()


class Words:
    """Texts as words between ASCII white space."""

    def __init__(self, data, offsets):
        self.data = data
        self.first, self.last, self.offsets = A.words_of(data, offsets)
        self.values = A.range_hashes(data, self.first, self.last)

    def byte_range(self, start, end):
        return self.first[start], self.last[end - 1]

    def kept(self, doc: int, hit: np.ndarray) -> bytes:
        a, b = self.offsets[doc], self.offsets[doc + 1]
        stay = np.flatnonzero(~hit[a:b]) + a
        data = self.data
        return b" ".join(data[s:e].tobytes() for s, e in zip(self.first[stay], self.last[stay]))


def _id5(keys: np.ndarray) -> np.ndarray:
    """Five of the eight bytes of a key; the bucket holds the rest of what tells keys apart."""
    return np.ascontiguousarray((keys >> A.U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _wide(id5: np.ndarray) -> np.ndarray:
    out = np.zeros((len(id5) // 5, 8), np.uint8)
    out[:, :5] = id5.reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _cut(order_key: np.ndarray) -> np.ndarray:
    """Begins of the runs of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], order_key[1:] != order_key[:-1]))) if len(order_key) else order_key[:0].astype(int)


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of seven bits, rounded up by at most a fifth."""
    return np.ceil(4 * np.log2(counts)).astype(np.uint8)


def _distinct(u, window: int, start: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distinct contents of each key, whose runs begin at ``at``; runs of keys with few are counted as they are."""
    n = np.diff(np.append(at, len(start)))
    many = np.flatnonzero(n > 4)
    if len(many):
        index = A.ranges(at[many], n[many])
        order = np.argsort(start[index], kind="stable")
        index, owner = index[order], np.repeat(many, n[many])[order]
        content = A.range_hashes(u.values, start[index], start[index] + count[index] + window - 1)
        order = np.lexsort((content, owner))
        content, owner = content[order], owner[order]
        new = np.concatenate(([True], (content[1:] != content[:-1]) | (owner[1:] != owner[:-1])))
        n[many] = np.bincount(owner[new], minlength=len(n))[many]
    return n


def _single(start: np.ndarray, count: np.ndarray, split: np.ndarray):
    """Runs, those to be split as one run per window, and the run that each comes from."""
    n = np.where(split, count, 1)
    index = np.repeat(np.arange(len(start)), n)
    return start[index] + A.ranges(np.zeros(len(n), np.int64), n), np.where(split, 1, count)[index], index


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def smallest_seen(
    docs: DataFrame,
    units: type,
    window: int,
    inner: int,
    judge: Callable,
    measures: Callable,
    schema: str,
    group_bytes: int = GROUP_BYTES,
    split: int = SPLIT,
) -> DataFrame:
    """Rows of ``measures`` (named by ``schema``) per document of ``docs(doc_id, text)``."""
    parts = group_count(docs, group_bytes)
    rows = docs.select(F.col("doc_id"), F.col("text"), group_of("doc_id", parts).alias("part"))
    # The cuts of the doc ids into batches: seven numbers.
    cuts = rows.select(F.percentile_approx("doc_id", [i / 8 for i in range(1, 8)], 10_000)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    def read(t: pa.Table):
        data, offsets = A.buffer_of(t.column("text"))
        u = units(data, offsets)
        return u, A.longs(t.column("doc_id")), A.segments(u.values, u.offsets, window, inner)

    def send_keys(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        u, ids, (start, count, key, doc) = read(t)
        who = ids[doc]
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        at = _cut(key)
        ends = np.append(at, len(key))[1:] - 1
        # One byte: whether several documents hold the key, and how many contents it has.
        several = (who[at] != who[ends]).astype(np.uint8) | _levels(_distinct(u, window, start[order], count[order], at)) << np.uint8(1)
        key = key[at]
        bucket = (key % A.U(parts)).astype(np.int64)
        order = np.lexsort((key, bucket))
        key, several, bucket = key[order], several[order], bucket[order]
        out = []
        for a, b in _pieces(bucket):
            out.append((int(bucket[a]), part, A.pack(_id5(key[a:b]), several[a:b])))
        return _table(out, ("bucket", pa.int32()), ("part", pa.int32()), ("blob", pa.binary()))

    def share_keys(t: pa.Table) -> pa.Table:
        seen, owner, several, names = [], [], [], t.column("part").to_pylist()
        for i, blob in enumerate(t.column("blob")):
            id5, flag = A.unpack(blob.as_py(), np.uint8, np.uint8)
            seen.append(_wide(id5))
            several.append(flag)
            owner.append(np.full(len(flag), i))
        key, owner, several = np.concatenate(seen), np.concatenate(owner), np.concatenate(several)
        order = np.argsort(key, kind="stable")
        key, owner, several = key[order], owner[order], several[order]
        at = _cut(key)
        count = np.diff(np.append(at, len(key)))
        hot = (count > 1) | np.bitwise_or.reduceat(several & np.uint8(1), at).astype(bool) if len(at) else count > 1
        contents_of = np.add.reduceat(np.exp2((several >> np.uint8(1)) / 4), at) if len(at) else count
        keep = np.repeat(hot, count)
        key, owner, large = key[keep], owner[keep], np.repeat(contents_of > split, count)[keep]
        bucket = t.column("bucket")[0].as_py()
        order = np.argsort(owner, kind="stable")
        key, owner, large = key[order], owner[order], large[order]
        id5 = lambda k: np.ascontiguousarray(k.view(np.uint8).reshape(-1, 8)[:, :5])
        out = []
        for a, b in _pieces(owner):
            own, apart = key[a:b], large[a:b]
            out.append((names[owner[a]], bucket, A.pack(id5(own[~apart]), id5(own[apart]))))
        return _table(out, ("part", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary()))

    def named(key: np.ndarray) -> np.ndarray:
        """What tells keys apart, in one number: five bytes and the bucket."""
        return A.mix(_wide(_id5(key).reshape(-1)) ^ A.mix(key % A.U(parts)))

    def contents(t: pa.Table):
        """Runs of this group and the hash of each run's content."""
        u, ids, (start, count, key, doc) = read(t)
        return u, ids, start, count, key, doc

    def send_contents(t: pa.Table, shared: pa.Table) -> pa.Table:
        kinds = (("bucket", pa.int32()), ("part", pa.int32()), ("blob", pa.binary()))
        if not t.num_rows or not shared.num_rows:
            return _table([], *kinds)
        part = t.column("part")[0].as_py()
        u, ids, start, count, key, doc = contents(t)
        bucket = (key % A.U(parts)).astype(np.int64)
        found = [
            [A.mix(_wide(x) ^ A.mix(np.array([g.as_py()], A.U))) for x in A.unpack(b.as_py(), np.uint8, np.uint8)]
            for g, b in zip(shared.column("bucket"), shared.column("blob"))
        ]
        whole, apart = (np.sort(np.concatenate(x)) for x in zip(*found))
        mine = named(key)
        large = _among(mine, apart)
        keep = large | _among(mine, whole)
        start, count, doc, bucket, large = start[keep], count[keep], doc[keep], bucket[keep], large[keep]
        start, count, index = _single(start, count, large)
        doc, bucket, large = doc[index], bucket[index], large[index]
        content = A.range_hashes(u.values, start, start + count + window - 1)
        bucket = np.where(large, (content % A.U(parts)).astype(np.int64), bucket)
        who = ids[doc]
        order = np.lexsort((who, content, bucket))
        bucket, content, who, start, count = (x[order] for x in (bucket, content, who, start, count))
        at = np.flatnonzero(np.concatenate(([True], (content[1:] != content[:-1]) | (bucket[1:] != bucket[:-1])))) if len(content) else np.zeros(0, int)
        ends = np.append(at, len(content))[1:] - 1
        low, high = who[at], who[ends]
        bucket, content, start, count = bucket[at], content[at], start[at], count[at]
        first, last = u.byte_range(start, start + count + window - 1) if len(start) else (start, start)
        # The split keys of this group come back to it beside the answers: a negative number marks them.
        out = [(part % parts, -1 - part, apart.tobytes())] if len(apart) else []
        press = zstandard.ZstdCompressor(level=1)
        for a, b in _pieces(bucket):
            size = last[a:b] - first[a:b]
            text = u.data[A.ranges(first[a:b], size)]
            blob = A.pack(content[a:b], low[a:b], high[a:b], count[a:b].astype(np.int32), size.astype(np.int32), text)
            out.append((int(bucket[a]), part, press.compress(blob)))
        return _table(out, *kinds)

    def answer(t: pa.Table) -> pa.Table:
        split_keys = [(-1 - p, b"k" + b.as_py()) for p, b in zip(t.column("part").to_pylist(), t.column("blob")) if p < 0]
        t = t.filter(pc.greater_equal(t.column("part"), 0))
        kinds = (("part", pa.int32()), ("blob", pa.binary()))
        if not t.num_rows:
            return _table(split_keys, *kinds)
        names, parts_of, columns = t.column("part").to_pylist(), [], []
        for i, blob in enumerate(t.column("blob")):
            columns.append(A.unpack(zstandard.ZstdDecompressor().decompress(blob.as_py()), A.U, np.int64, np.int64, np.int32, np.int32, np.uint8))
            parts_of.append(np.full(len(columns[-1][0]), i))
        content, low, high, count, size, text = (np.concatenate(c) for c in zip(*columns))
        owner = np.concatenate(parts_of)
        first = np.cumsum(size) - size
        # One copy of each content, under its smallest id.
        order = np.lexsort((low, content))
        at = order[_cut(content[order])]
        lows = low[at]
        unique = np.searchsorted(content[at], content)
        by_age = np.argsort(lows, kind="stable")
        at, lows = at[by_age], lows[by_age]
        place = np.empty(len(at), np.int64)
        place[by_age] = np.arange(len(at))
        unique = place[unique]
        batch = np.searchsorted(cuts, lows, side="right")
        run_of, run_at, run_len, run_low = judge(text, first[at], size[at], count[at].astype(np.int64), lows, batch)
        # Runs of each content, sorted by content: handed to every group that holds it.
        begin = np.searchsorted(run_of, np.arange(len(at) + 1))
        n = (begin[1:] - begin[:-1])[unique]
        index = A.ranges(begin[:-1][unique], n)
        entry = np.repeat(np.arange(len(content)), n)
        keep = run_low[index] < high[entry]
        index, entry = index[keep], entry[keep]
        order = np.argsort(owner[entry], kind="stable")
        index, entry = index[order], entry[order]
        out = split_keys
        for a, b in _pieces(owner[entry]):
            i, e = index[a:b], entry[a:b]
            blob = A.pack(content[e], run_at[i].astype(np.int32), run_len[i].astype(np.int32), run_low[i])
            out.append((names[owner[e[0]]], b"h" + blob))
        return _table(out, *kinds)

    def remove(t: pa.Table, hits: pa.Table) -> pa.Table:
        if not t.num_rows:
            return measures(None, t, None)
        u, ids, start, count, key, doc = contents(t)
        hit = np.zeros(len(u.values), bool)
        blobs = [b.as_py() for b in hits.column("blob")] if hits.num_rows else []
        columns = [A.unpack(b[1:], A.U, np.int32, np.int32, np.int64) for b in blobs if b[:1] == b"h"]
        if columns and len(start):
            apart = [np.frombuffer(b[1:], A.U) for b in blobs if b[:1] == b"k"]
            if apart:
                start, count, index = _single(start, count, _among(named(key), np.sort(np.concatenate(apart))))
                doc = doc[index]
            content, run_at, run_len, low = (np.concatenate(c) for c in zip(*columns))
            order = np.argsort(content, kind="stable")
            content, run_at, run_len, low = content[order], run_at[order], run_len[order], low[order]
            mine = A.range_hashes(u.values, start, start + count + window - 1)
            a, b = np.searchsorted(content, mine), np.searchsorted(content, mine, side="right")
            index = A.ranges(a, b - a)
            entry = np.repeat(np.arange(len(mine)), b - a)
            keep = low[index] < ids[doc[entry]]
            index, entry = index[keep], entry[keep]
            hit = A.covered(len(u.values), start[entry] + run_at[index], run_len[index].astype(np.int64) + window - 1)
        return measures(u, t, hit)

    keys = rows.groupBy("part").applyInArrow(send_keys, "bucket int, part int, blob binary")
    shared = keys.groupBy("bucket").applyInArrow(share_keys, "part int, bucket int, blob binary")
    sent = rows.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(send_contents, "bucket int, part int, blob binary")
    hits = sent.groupBy("bucket").applyInArrow(answer, "part int, blob binary")
    return rows.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(remove, schema)


def _pieces(sorted_key: np.ndarray) -> Iterator[tuple[int, int]]:
    at = _cut(sorted_key)
    return zip(at.tolist(), [*at[1:].tolist(), len(sorted_key)])


def _table(rows: list[tuple], *kinds: tuple[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(columns, kinds)})


def runs_of(unique: np.ndarray, window: np.ndarray, low: np.ndarray):
    """Hit windows, sorted by content and place, as runs of neighbours with the same smallest id."""
    if not len(unique):
        e = np.zeros(0, np.int64)
        return e, e, e, e
    new = (unique[1:] != unique[:-1]) | (window[1:] != window[:-1] + 1) | (low[1:] != low[:-1])
    at = np.flatnonzero(np.concatenate(([True], new)))
    return unique[at], window[at], np.diff(np.append(at, len(unique))), low[at]


def spans(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of maximal hit runs per document."""
    first = hit.copy()
    first[1:] &= ~hit[:-1]
    limits = offsets[:-1]
    limits = limits[limits < len(hit)]
    first[limits] = hit[limits]
    sums = np.concatenate(([0], np.cumsum(first)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def removed(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(hit)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()

