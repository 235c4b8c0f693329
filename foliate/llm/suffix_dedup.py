"""Substring removal over bytes with a logarithmic family of suffix arrays.

Documents come in batches of ascending ids. A batch gets a suffix array: its windows of ``length`` bytes in the order of all their bytes,
found eight bytes at a time, where only ties go on. The array is merge-scanned against the levels built from earlier
batches, which finds every window that an earlier document holds; then what is new in it becomes a level itself, and levels of about equal size
merge by their places in each other, so nothing is sorted twice and an entry is moved a logarithmic number of times. The family is split by the key of the windows (see ``repeats``),
so that each bucket holds its own small levels, and one bucket is one task.

Defined results: null text: empty; a text shorter than ``length``: nothing removed; rows that share
a doc_id do not count as earlier than each other; a null doc_id counts as the smallest; columns other than doc_id and text
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliate.llm import arrays as A
from foliate.llm import repeats as R

SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
KEPT = "doc_id bigint, kept binary"
LENGTH = 50
INNER = 24


class Level:
    """Distinct windows in suffix order: their first eight bytes, the place of a copy, the smallest document."""

    def __init__(self, head, at, low):
        self.head, self.at, self.low = head, at, low

    def __len__(self):
        return len(self.at)

    def part(self, keep) -> "Level":
        return Level(self.head[keep], self.at[keep], self.low[keep])


class Family:
    """The levels of one bucket over one text buffer."""

    def __init__(self, text: np.ndarray, length: int):
        words = max(len(text) - 7, 0)
        # Eight bytes from every place, as one big-endian number: the order of suffixes.
        self.eight = np.ndarray((words,), ">u8", np.ascontiguousarray(text).data, 0, (1,)) if words else np.zeros(0, ">u8")
        #: Where the words begin that, in this order, compare two windows; the last may overlap the one before.
        self.steps = sorted({*range(0, length - 7, 8), length - 8})
        self.levels: list[Level] = []

    def word(self, at: np.ndarray, k: int) -> np.ndarray:
        return self.eight[at + self.steps[k]].astype(np.uint64)

    def sorted(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffix order of windows, where a new one begins in it, and their first words; ties go on to the next word."""
        head = self.word(at, 0)
        order = np.argsort(head)
        head = head[order]
        fresh = np.ones(len(at), bool)
        np.not_equal(head[1:], head[:-1], out=fresh[1:])
        for k in range(1, len(self.steps)):
            alone = fresh.copy()
            alone[:-1] &= fresh[1:]
            tied = np.flatnonzero(~alone)
            if not len(tied):
                break
            word = self.word(at[order[tied]], k)
            by_word = np.argsort(word)
            rank = np.empty(len(word), np.int64)
            rank[by_word] = np.cumsum(np.concatenate(([0], word[by_word[1:]] != word[by_word[:-1]])))
            key = np.cumsum(fresh)[tied] * (int(rank.max()) + 1) + rank
            by_key = np.argsort(key)
            key = key[by_key]
            order[tied] = order[tied[by_key]]
            fresh[tied[1:]] |= key[1:] != key[:-1]
        return order, fresh, head

    def _compare(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of windows with equal first words."""
        out = np.zeros(len(one), np.int8)
        left = np.arange(len(one))
        for k in range(1, len(self.steps)):
            a, b = self.word(one[left], k), self.word(other[left], k)
            out[left] = (a > b).astype(np.int8) - (a < b)
            left = left[a == b]
            if not len(left):
                break
        return out

    def places(self, level: Level, batch: Level) -> tuple[np.ndarray, np.ndarray]:
        """Where each entry of the batch stands in the order of the level, and whether the level holds it."""
        low = np.searchsorted(level.head, batch.head)
        high = np.searchsorted(level.head, batch.head, side="right")
        held = np.zeros(len(batch), bool)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            order = self._compare(level.at[middle], batch.at[open_])
            held[open_[order == 0]] = True
            low[open_] = np.where(order < 0, middle + 1, np.where(order == 0, middle, low[open_]))
            high[open_] = np.where(order < 0, high[open_], middle)
            open_ = open_[(order != 0) & (low[open_] < high[open_])]
        return low, held

    def add(self, at: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Take a batch of windows (oldest first); the smallest document that holds each of them."""
        if not len(at):
            return low
        order, fresh, head = self.sorted(at)
        group = np.cumsum(fresh) - 1
        begin = np.flatnonzero(fresh)
        batch = Level(head[begin], at[order[begin]], np.minimum.reduceat(low[order], begin))
        known = np.zeros(len(batch), bool)
        for level in self.levels:
            place, held = self.places(level, batch)
            batch.low[held] = np.minimum(batch.low[held], level.low[place[held]])
            known |= held
        out = np.empty(len(at), np.int64)
        out[order] = batch.low[group]
        self._insert(batch.part(~known))
        return out

    def _insert(self, level: Level) -> None:
        """Levels of about equal size become one: a merge by places, no sort."""
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            to = self.places(a, b)[0] + np.arange(len(b))
            rest = np.ones(len(a) + len(b), bool)
            rest[to] = False

            def merged(x, y):
                out = np.empty(len(rest), x.dtype)
                out[rest], out[to] = x, y
                return out

            self.levels.append(Level(merged(a.head, b.head), merged(a.at, b.at), merged(a.low, b.low)))


def judge_with(length: int):
    def judge(text, first, size, count, lows, batch):
        content = np.repeat(np.arange(len(first)), count)
        window = A.ranges(np.zeros(len(first), np.int64), count)
        at = first[content] + window
        cuts = np.searchsorted(batch[content], np.arange(batch.max() + 2 if len(batch) else 1))
        family = Family(text, length)
        found = [family.add(at[a:b], lows[content[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]
        low = np.concatenate(found) if found else np.zeros(0, np.int64)
        return R.runs_of(content, window, low)

    return judge


def _digest(u, t: pa.Table, hit) -> pa.Table:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    if u is None:
        return pa.table([pa.array([], pa.string() if n == "kept_sha256" else pa.int64()) for n in names], names)
    ids = t.column("doc_id")
    return pa.table(
        [
            ids,
            pa.array(np.diff(u.offsets)),
            pa.array(R.removed(hit, u.offsets)),
            pa.array(R.spans(hit, u.offsets)),
            pa.array([R.sha(u.kept(d, hit)) for d in range(t.num_rows)], pa.string()),
        ],
        names,
    )


def _kept(u, t: pa.Table, hit) -> pa.Table:
    rows = [] if u is None else [u.kept(d, hit) for d in range(t.num_rows)]
    return pa.table({"doc_id": t.column("doc_id"), "kept": pa.array(rows, pa.binary())})


def digests(docs: DataFrame, length: int = LENGTH, inner: int = INNER) -> DataFrame:
    """Sizes and a hash of what stays of each document."""
    return R.smallest_seen(docs, R.Bytes, length, inner, judge_with(length), _digest, SCHEMA)


def dedup(docs: DataFrame, length: int = LENGTH, inner: int = INNER) -> DataFrame:
    """What stays of each document, as bytes (a cut may fall inside a character)."""
    return R.smallest_seen(docs, R.Bytes, length, inner, judge_with(length), _kept, KEPT)
