"""Removal of repeated word windows with suffix automata of reference shards.

The reference of a document is every document with a smaller id, that is, the corpus itself. It is too large to
broadcast whole, so it is cut into shards by the key of the windows (see ``repeats``) and each shard's automaton is built in the
task that receives the matching pieces of all documents: a piece never needs another shard. Pieces
stream through the automaton in ascending order of their ids for matching statistics, the longest match that ends at
each word; where it reaches ``length`` words, the state of the last ``length`` words names the
first document that holds them. Then the piece itself joins the automaton.

Defined results: null text: no words; fewer words than ``length``: nothing removed; rows that share a
doc_id do not count as earlier than each other; a null doc_id counts as the smallest; columns other than doc_id and text
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliate.llm import repeats as R

SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
KEPT = "doc_id bigint, kept string"
LENGTH = 13
INNER = 5


class Automaton:
    """Suffix automaton of several word sequences; each state knows the first document that reached it."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.first = [-1], [0], [0]

    def _state(self, length: int, link: int, first: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.len.append(length)
        self.first.append(first)
        return len(self.len) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The part of state ``q`` that ends one word after ``p``, as a state of its own."""
        clone = self._state(self.len[p] + 1, self.link[q], self.first[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words, doc: int) -> None:
        """Append a sequence; sequences come in ascending order of ``doc``."""
        nxt, length, link = self.next, self.len, self.link
        last = 0
        for word in words:
            q = nxt[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
                continue
            here = self._state(length[last] + 1, 0, doc, {})
            p = last
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = here
                p = link[p]
            if p >= 0:
                q = nxt[p][word]
                link[here] = q if length[q] == length[p] + 1 else self._split(p, word, q)
            last = here

    def matches(self, words, least: int):
        """For each word, the first document that holds the ``least`` words ending there, or None."""
        nxt, length, link, first = self.next, self.len, self.link, self.first
        state = size = 0
        for word in words:
            following = nxt[state].get(word)
            while following is None and state:
                state = link[state]
                size = length[state]
                following = nxt[state].get(word)
            if following is None:
                yield None
                continue
            state, size = following, size + 1
            if size < least:
                yield None
                continue
            u = state
            while length[link[u]] >= least:
                u = link[u]
            yield first[u]


def judge_with(length: int):
    def judge(text, first, size, count, lows, batch):
        data = text.tobytes()
        automaton = Automaton()
        content, window, low = [], [], []
        for i, (a, n, c, doc) in enumerate(zip(first.tolist(), size.tolist(), count.tolist(), lows.tolist())):
            words = data[a : a + n].split()
            found = [*automaton.matches(words, length)][length - 1 :]
            low += [doc if x is None else min(x, doc) for x in found]
            content += [i] * c
            window += range(c)
            automaton.add(words, doc)
        return R.runs_of(np.array(content, np.int64), np.array(window, np.int64), np.array(low, np.int64))

    return judge


def _digest(u, t: pa.Table, hit) -> pa.Table:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    if u is None:
        return pa.table([pa.array([], pa.string() if n == "kept_sha256" else pa.int64()) for n in names], names)
    return pa.table(
        [
            t.column("doc_id"),
            pa.array(np.diff(u.offsets)),
            pa.array(R.removed(hit, u.offsets)),
            pa.array([R.sha(u.kept(d, hit)) for d in range(t.num_rows)], pa.string()),
        ],
        names,
    )


def _kept(u, t: pa.Table, hit) -> pa.Table:
    rows = [] if u is None else [u.kept(d, hit).decode("utf-8", "replace") for d in range(t.num_rows)]
    return pa.table({"doc_id": t.column("doc_id"), "kept": pa.array(rows, pa.string())})


def digests(docs: DataFrame, length: int = LENGTH, inner: int = INNER) -> DataFrame:
    """Sizes and a hash of the words that stay of each document."""
    return R.smallest_seen(docs, R.Words, length, inner, judge_with(length), _digest, SCHEMA)


def dedup(docs: DataFrame, length: int = LENGTH, inner: int = INNER) -> DataFrame:
    """The words that stay of each document, joined by one space."""
    return R.smallest_seen(docs, R.Words, length, inner, judge_with(length), _kept, KEPT)
