"""Packing of documents into sequences of a fixed length by a configuration linear program.

Texts are encoded by a given tokenizer and closed by an end id; only documents beyond the length are cut, so that their first
piece takes the remainder. All that a packing depends on is the histogram of the pieces' lengths, at most ``LENGTH`` numbers:

* the program, over patterns (multisets of lengths that fit), covers every length as often as it occurs with as few patterns as
  can be. It is solved by multiplicative weights: lengths that are covered least weigh most, a knapsack
  by dynamic programming prices the patterns, and all near-best ones grow side by side. The weights also bound the optimum from below;
* the fractions are rounded by carrying them from pattern to pattern, no length beyond its count; what is left over is filled,
  longest piece first, by the subset of the remaining lengths that fits best (exact subset sums);
* each pattern and place then stands for a range of the pieces of its length. Pieces are numbered per length by the task that
  encodes them and the counts of the tasks before it, and look up their sequence and offset in the table of patterns, whose size
  depends on the number of lengths only.

No piece or document passes through the driver, and no text is shuffled.

Defined results: a null or empty text is the end id alone; rows that share a doc_id, or have none, are documents of their own;
columns other than doc_id and text are ignored; an empty table gives an empty result. Sequence ids count from 0 without gaps;
which of equally long pieces goes where depends on the order of the rows.

``packed`` stores the pieces and counts their lengths while the plan is built.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.llm import arrays as A
from foliate.llm.common import stored

LENGTH, END = 1024, 2
#: Rounds of the weights, patterns that grow in one, how near to the best price, how far a length grows in a round, and how fast its weight falls.
ROUNDS, GROWING, NEAR, STEP, RATE = 300, 256, 0.02, 0.1, 4.0
#: Shares of the fractions that are rounded; the rest is filled. The share with the fewest sequences counts.
SHARES = (1.0, 0.75, 0.5, 0.25)
#: Bytes of text that are encoded at once, and pieces that a worker remembers between them.
SLICE, PIECES = 8 << 20, 250_000
OWNER = "packing"

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids binary, part bigint, rank bigint"
PLACED = "doc_id bigint, piece int, start bigint, length bigint, {0}, sequence_id bigint, offset bigint"

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"([{_LETTERS}]+)([.,]?)")


def _alphabet() -> dict[int, str]:
    """The letter that stands for each byte: printable ones themselves, the others in order from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)}


class Encoder:
    """The library's ids of whole texts, with the ids of frequent pieces remembered.

    A byte-level tokenizer always begins a new word before a single blank between other characters, so a text is encoded in
    pieces that end there. Texts with other white space around a blank, or with the name of a special id, go to the library whole.
    """

    def __init__(self, model: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.codes = [np.array([i], self.kind).tobytes() for i in range(self.library.get_vocab_size())]
        self.tokenize, self.alphabet = self.library.model.tokenize, _alphabet()
        self.known: dict[bytes, bytes] = {}
        special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special)) if special else b"(?!)")
        self.plain = self._separable()

    @classmethod
    def of(cls, model: str) -> "Encoder":
        held = A.MEMORIES.get(OWNER)
        if held is None or held[0] != model:
            held = A.MEMORIES[OWNER] = model, cls(model)
        return held[1]

    def _separable(self) -> bool:
        """Whether this tokenizer treats pieces as the class assumes."""
        whole = " Word, other\nÉté. x's  y"
        parts = [" Word", ",", " other", "\n", "Été", ".", " x's", " ", " y"]
        return self._encode([whole])[0] == b"".join(self._encode(parts)) and all(self._word(p) == self._encode([p])[0] for p in parts[:6])

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of what the tokenizer takes as one word."""
        return b"".join([self.codes[t.id] for t in self.tokenize(word.encode().decode("latin-1").translate(self.alphabet))])

    def _learn(self, pieces: list[bytes]) -> None:
        odd = []
        known, plain, code, of = self.known, _PLAIN.fullmatch, self.codes, self.tokenize
        mark = {m: self._word(m) for m in (".", ",", "")}
        line, blank = self._word("\n"), self.alphabet[32]
        for piece in pieces:
            begins = piece[:1] == b" "
            body = piece[1:] if begins else piece
            if body.isalpha():
                # ASCII letters stand for themselves
                word = body.decode()
                if piece not in known:
                    known[piece] = b"".join([code[t.id] for t in of(blank + word if begins else word)])
                continue
            found = [plain(x) for x in body.decode().split("\n")]
            if None in found:
                odd.append(piece)
                continue
            ids = []
            for m in found:
                word = m[1]
                key = (" " + word if begins else word).encode()
                own = known.get(key)
                if own is None:
                    own = known[key] = self._word(key.decode())
                ids.append(own + mark[m[2]])
                begins = False
            known[piece] = line.join(ids)
        known.update(zip(odd, self._encode([p.decode() for p in odd])))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text (UTF-8), as bytes of ``kind``."""
        out: list = [None] * len(texts)
        fine = []
        for i, t in enumerate(texts):
            if t and self.plain and not self.special.search(t):
                fine.append(i)
        if fine:
            for i, ids in zip(fine, self._in_pieces([texts[i] for i in fine])):
                out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._encode([texts[i].decode() for i in rest])):
            out[i] = ids
        return out

    def _in_pieces(self, texts: list[bytes]) -> list:
        lists = pc.split_pattern(pa.array(texts, pa.large_binary()).cast(pa.large_string()), " ")
        count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(count) - count
        coded = lists.flatten().dictionary_encode()
        at, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.large_binary()).to_pylist()
        clean = np.array([_closed(p) for p in names], bool)
        whole = np.logical_and.reduceat(clean[at], first)
        # a piece at the begin of a text has no blank
        heads, at_head = np.unique(at[first], return_inverse=True)
        at[first] = len(names) + at_head
        pieces = [b" " + p for p in names] + [names[i] for i in heads.tolist()]
        needed = np.zeros(len(pieces), bool)
        needed[at[np.repeat(whole, count)]] = True
        if len(self.known) > PIECES:
            # only what this slice needs stays
            self.known = {p: self.known[p] for p in pieces if p in self.known}
        wanted = [p for p, n in zip(pieces, needed.tolist()) if n]
        self._learn([p for p in wanted if p not in self.known])
        own = [self.known[p] if n else b"" for p, n in zip(pieces, needed.tolist())]
        width = len(self.codes[0])
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // width
        starts = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(own), self.kind)[A.ranges(starts[at], sizes[at])].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes[at]))) * width
        limits = ends[np.append(first, len(at))].tolist()
        return [ids[i:j] if w else None for i, j, w in zip(limits, limits[1:], whole.tolist())]


def _closed(piece: bytes) -> bool:
    """Whether a piece neither begins nor ends with white space and is not empty."""
    if not piece:
        return False
    if piece[0] > 32 and piece[0] < 127 and piece[-1] > 32 and piece[-1] < 127:
        return True
    text = piece.decode()
    return not (text[0].isspace() or text[-1].isspace())


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """The pieces of all documents: their ids (little-endian, four bytes), and a number per task and length."""
    with open(tokenizer, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encoder, task = Encoder.of(model.value), TaskContext.get().partitionId()
        last = np.array([end], encoder.kind).tobytes()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            for part in A.slices(batch, "text", SLICE, OWNER):
                own = [x + last for x in encoder.encode([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])]
                n = np.fromiter(map(len, own), np.int64, len(own)) // len(last)
                cuts = -(-n // length)
                row = np.repeat(np.arange(len(n)), cuts)
                piece = A.ranges(np.zeros(len(n), np.int64), cuts)
                stop = n[row] - (cuts[row] - 1 - piece) * length
                start = np.where(piece > 0, stop - length, 0)
                size = stop - start
                ids = np.frombuffer(b"".join(own), encoder.kind).astype("<u4").tobytes()
                base = (np.cumsum(n) - n)[row]
                order = np.argsort(size, kind="stable")
                kinds, counts = np.unique(size, return_counts=True)
                rank = np.empty(len(size), np.int64)
                rank[order] = A.ranges(seen[kinds], counts)
                seen[kinds] += counts
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size),
                        pa.array([ids[4 * a : 4 * b] for a, b in zip((base + start).tolist(), (base + stop).tolist())], pa.binary()),
                        pa.array(np.full(len(row), task)), pa.array(rank),
                    ],
                    [c.split()[0] for c in PIECE.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


class Program:
    """The configuration program over a histogram: ``counts[l]`` pieces of each length l."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.length = len(counts) - 1
        self.lengths = np.flatnonzero(counts)
        #: No fractional solution needs fewer sequences than this.
        self.bound = float((counts * np.arange(len(counts))).sum() / self.length)

    def _priced(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best total value for each capacity (a knapsack with repetition), and the length that comes first in it (0: none)."""
        c = self.length
        best, choice = np.zeros(c + 1), np.zeros(c + 1, np.int64)
        lengths, value = self.lengths, value[self.lengths]
        for room in range(int(lengths[0]), c + 1):
            k = np.searchsorted(lengths, room, side="right")
            gain = value[:k] + best[room - lengths[:k]]
            i = int(gain.argmax())
            if gain[i] > best[room - 1]:
                best[room], choice[room] = gain[i], lengths[i]
            else:
                best[room], choice[room] = best[room - 1], choice[room - 1]
        return best, choice

    def _patterns(self, heads: np.ndarray, choice: np.ndarray) -> list[tuple[int, ...]]:
        """For each length, the best pattern that holds it."""
        out = []
        for head in heads.tolist():
            found, room = [head], self.length - head
            while room > 0 and choice[room]:
                found.append(int(choice[room]))
                room -= found[-1]
            out.append(tuple(sorted(found, reverse=True)))
        return out

    def solve(self, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
        """Fractions of patterns that cover every length at least as often as it occurs; raises the lower bound."""
        counts = self.counts[self.lengths].astype(float)
        size = np.maximum(self.counts, 1).astype(float)
        reach = np.zeros(self.length + 1)
        grown: dict[tuple[int, ...], float] = {}
        value = np.zeros(self.length + 1)
        # prices begin in proportion to the lengths, which is right wherever sequences can be filled
        prior, rate = np.log(counts * self.lengths), RATE
        for _ in range(rounds):
            weight = prior - rate * reach[self.lengths]
            value[self.lengths] = np.exp(weight - weight.max()) / counts
            best, choice = self._priced(value)
            top = best[self.length]
            self.bound = max(self.bound, float((value * self.counts).sum() / top))
            through = value[self.lengths] + best[self.length - self.lengths]
            near = self.lengths[through >= (1 - NEAR) * top]
            # of the near-best ones, those through the least covered lengths
            heads = near[np.argsort(reach[near], kind="stable")[:GROWING]]
            chosen = [*dict.fromkeys(self._patterns(heads, choice))]
            load, steps = np.zeros(self.length + 1), []
            for pattern in chosen:
                held = Counter(pattern)
                step = min(size[l] / m for l, m in held.items())
                steps.append(step)
                for l, m in held.items():
                    load[l] += m * step / size[l]
            grow = STEP / load.max()
            for pattern, step in zip(chosen, steps):
                grown[pattern] = grown.get(pattern, 0.0) + grow * step
            reach += grow * load
        low = reach[self.lengths].min()
        return {p: x / low for p, x in grown.items()} if low > 0 else {}

    def rounded(self, fractions: dict[tuple[int, ...], float]) -> list[tuple[tuple[int, ...], int]]:
        """Whole patterns that hold every piece once."""
        order = sorted(fractions.items(), key=lambda p: (-sum(p[0]), -p[1], p[0]))
        return min((self._whole(order, share) for share in SHARES), key=lambda found: sum(m for _, m in found))

    def _whole(self, order: list[tuple[tuple[int, ...], float]], share: float) -> list[tuple[tuple[int, ...], int]]:
        left = self.counts.astype(np.int64).copy()
        out, carried = [], 0.0
        for pattern, x in order:
            carried += share * x
            if carried < 1:
                continue
            kinds, held = np.unique(pattern, return_counts=True)
            m = min(int(carried), int((left[kinds] // held).min()))
            carried -= int(carried)
            if m:
                left[kinds] -= held * m
                out.append((pattern, m))
        while left.any():
            pattern = self._fullest(left)
            kinds, held = np.unique(pattern, return_counts=True)
            m = int((left[kinds] // held).min())
            left[kinds] -= held * m
            out.append((pattern, m))
        return out

    def _fullest(self, left: np.ndarray) -> tuple[int, ...]:
        """The longest length that is left, and the lengths that fill its sequence best; longer ones first."""
        lengths = np.flatnonzero(left)[::-1].tolist()
        head = lengths[0]
        room = self.length - head
        mask, sums, steps = (1 << room + 1) - 1, 1, []
        for l in lengths:
            if l > room:
                continue
            n = min(int(left[l]) - (l == head), room // l)
            unit = 1
            while n > 0:
                unit = min(unit, n)
                steps.append((l, unit, sums))
                sums = (sums | sums << l * unit) & mask
                n -= unit
                unit *= 2
            if sums >> room & 1:
                break
        at, found = sums.bit_length() - 1, [head]
        for l, unit, before in reversed(steps):
            if not before >> at & 1:
                found += [l] * unit
                at -= l * unit
        return tuple(found)


def layout(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pieces go: (length, number) as keys in ascending order, the first sequence behind each, and the offset."""
    keys, first, offset, sequence, given = [], [], [], 0, {}
    for pattern, m in patterns:
        at = 0
        for l in pattern:
            number = given.get(l, 0)
            keys.append((l << 50) + number)
            first.append(sequence - number)
            offset.append(at)
            given[l] = number + m
            at += l
        sequence += m
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (keys, first, offset))


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, ids: str = "ids binary") -> DataFrame:
    """Every piece with its sequence and its offset there; ``ids`` names what is kept of the ids (``ids_crc32 bigint``: their checksum)."""
    made = pieces(docs, tokenizer, length, end)
    kept = F.crc32("ids").alias("ids_crc32") if ids.startswith("ids_crc32") else F.col("ids")
    name = ids.split()[0]
    own = stored(made.select("doc_id", "piece", "start", "length", kept, "part", "rank"), "pieces")
    counts = own.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "lengths")
    histogram = np.zeros(length + 1, np.int64)
    for l, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[l] = n
    if not histogram.any():
        return own.select("doc_id", "piece", "start", "length", name, F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    program = Program(histogram)
    table = docs.sparkSession.sparkContext.broadcast(layout(program.rounded(program.solve())))
    before = counts.select(
        "part", "length",
        F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    names = ["doc_id", "piece", "start", "length", name]

    def run(batches):
        keys, first, offset = table.value
        for batch in batches:
            size, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(keys, (size << 50) + number, side="right") - 1
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first[at] + number), pa.array(offset[at])], [*names, "sequence_id", "offset"])

    numbered = own.join(before, ["part", "length"]).select(*names, (F.col("before") + F.col("rank")).alias("number"))
    return numbered.mapInArrow(run, PLACED.format(ids))


def sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """The packed sequences: ids (little-endian, four bytes), and the documents and lengths in order."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return (
        packed(docs, tokenizer, length, end).groupBy("sequence_id").agg(inside.alias("p"))
        .select("sequence_id", F.expr("aggregate(p.ids, X'', (a, x) -> concat(a, x))").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
    )
