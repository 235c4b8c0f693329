"""Token ids in files of range-coded blocks (static range asymmetric numeral system).

Every text is encoded by a given tokenizer and closed by an end id. The ids are counted over all documents; the
counts, scaled to 2^20, are the one frequency table of all blocks. In ascending order of doc_id the ids go into
blocks of about ``BLOCK`` ids that end with a document. A block interleaves ``LANES`` independent coders:
id i belongs to lane i mod LANES, and all lanes of a step are coded together. A block keeps the lanes' final
states (its checkpoint), its words, and checksums of both the words and the ids, so that any block
decodes alone and in parallel, and damage is found.

A file set is a folder of two Parquet tables: ``table`` (id, frequency) and ``blocks`` (one row per block).

Defined results: a null or empty text is the end id alone; null doc_ids come first; rows that share a doc_id follow
one another in the order of their ids; further columns are ignored; an empty table gives an empty file set.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.llm import arrays as A
from foliate.llm.common import shared_dir, stored

END = 2
SCALE = 20
LOW = 1 << 31
LANES = 4096
BLOCK = 1 << 19
#: Ids that one task encodes, about.
TASK_IDS = 4 << 20
#: Pieces between blanks that a worker remembers.
PIECES = 250_000
OWNER = "tokens"

BLOCKS = (
    "part int, block int, start bigint, n_ids bigint, doc_ids array<bigint>, counts array<bigint>, "
    "states binary, words binary, words_crc bigint, ids_crc bigint"
)

#: A word whose ids do not depend on its neighbours, and a mark behind it.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"([{_LETTERS}]+)([.,]?)")


class Encoder:
    """The library's ids of whole texts, with the ids of frequent pieces remembered.

    The tokenizer drops white space and never joins what it separates, so a text is encoded piece by piece. It takes
    all text in lower case, so ASCII letters are lowered first, except where a text may name a special id. A piece
    of Latin letters, or one with a full stop or comma behind it, is its word and its mark; any other piece
    goes to the library as it is.
    """

    def __init__(self, model: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self._tokenize = self.library.model.tokenize
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.pieces: dict[bytes, bytes] = {}
        size = self.library.get_vocab_size()
        self.codes = [np.array([i], self.kind).tobytes() for i in range(size)]
        self.letters = self._alphabet()
        self.marks = dict(zip(".,", self._encode([".", ","])))
        special = [t.content.encode().lower() for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special)) if special else b"(?!)")
        self.plain = self._separable()

    def _alphabet(self) -> dict[int, str]:
        """What the tokenizer's own preparation makes of each lower-case letter."""
        letters = [c for c in map(chr, range(0x61, 0x100)) if re.fullmatch(f"[{_LETTERS}]", c)]
        split = self.library.pre_tokenizer
        return {ord(c): split.pre_tokenize_str(c)[0][0] if split else c for c in letters}

    @classmethod
    def of(cls, model: str) -> "Encoder":
        """This worker's encoder, with what it remembers."""
        held = A.MEMORIES.get(OWNER)
        if held is None or held[0] != model:
            held = A.MEMORIES[OWNER] = model, cls(model)
        return held[1]

    def _separable(self) -> bool:
        """Whether this tokenizer treats pieces and marks as the class assumes."""
        whole, parts = "WORD, other\nÉté. x", ["word", ",", "other", "été", ".", "x"]
        known = self._encode(parts)
        words = [i for i in (0, 2, 3, 5) if self._word(parts[i]) != known[i]]
        return not words and self._encode([whole])[0] == b"".join(known)

    def _word(self, word: str) -> bytes:
        """Ids of one lower-case word, by the library's model alone."""
        return b"".join([self.codes[t.id] for t in self._tokenize(word if word.isascii() else word.translate(self.letters))])

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _learn(self, pieces: list[bytes]) -> None:
        """Fill ``pieces`` with the ids of new ones."""
        odd = []
        known, plain, of = self.pieces, _PLAIN.fullmatch, self._word
        for piece in pieces:
            if piece.isalpha():
                if piece not in known:
                    known[piece] = of(piece.decode().lower())
                continue
            m = plain(piece.decode())
            if not m:
                odd.append(piece)
                continue
            word, mark = m.groups()
            key = piece[: len(piece) - len(mark)]
            ids = known.get(key)
            if ids is None:
                ids = known[key] = of(word.lower())
            if mark:
                known[piece] = ids + self.marks[mark]
        known.update(zip(odd, self._encode([p.decode() for p in odd])))

    def _lowered(self, text: bytes) -> bytes:
        """ASCII letters in lower case, unless that might turn other words into a special one."""
        low = text.lower()
        return text if self.special.search(low) else low

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text (UTF-8), as bytes of ``kind``."""
        if not self.plain:
            return self._encode([t.decode() for t in texts])
        lists = pc.ascii_split_whitespace(pa.array([self._lowered(t) for t in texts], pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.cast(pa.large_binary()).to_pylist()
        if len(self.pieces) > PIECES:
            # Only what this slice needs stays.
            self.pieces = {p: self.pieces[p] for p in pieces if p in self.pieces}
        self._learn([p for p in pieces if p not in self.pieces])
        own = [*map(self.pieces.__getitem__, pieces)]
        width = len(self.codes[0])
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // width
        starts = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        ids = np.frombuffer(b"".join(own), self.kind)[A.ranges(starts[at], sizes[at])].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes[at]))) * width
        limits = ends[np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))].tolist()
        return [ids[i:j] for i, j in zip(limits, limits[1:])]


def tokens(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """(doc_id, n, ids): ids as little-endian integers of two bytes (four for a large vocabulary)."""
    with open(tokenizer, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encoder = Encoder.of(model.value)
        last = np.array([end], encoder.kind).tobytes()
        width = len(last)
        for batch in batches:
            for part in A.slices(batch, "text", owner=OWNER):
                ids = [x + last for x in encoder.encode([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])]
                n = pa.array([len(x) // width for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(ids, pa.binary())], ["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n bigint, ids binary")


def counted(ids: DataFrame, width: int) -> DataFrame:
    """(id, n): how often each id occurs; bounded by the vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, _ = A.buffer_of(batch.column(0))
            own = np.bincount(data.view(f"<u{width}"))
            if len(own) > len(total):
                own, total = total, own.astype(np.int64)
            total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return ids.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2^scale, at least one for each id that occurs."""
    total = 1 << scale
    if not counts.sum():
        return np.zeros(len(counts), np.uint64)
    f = np.where(counts > 0, np.maximum(1, np.floor(counts / counts.sum() * total)), 0).astype(np.int64)
    rest = total - int(f.sum())
    order = np.argsort(-f, kind="stable")
    if rest > 0:
        f[order[0]] += rest
    for i in order:
        if rest >= 0:
            break
        less = min(-rest, int(f[i]) - 1)
        f[i] -= less
        rest += less
    return f.astype(np.uint64)


class Coder:
    """One frequency table; blocks of ids to and from words of 32 bits."""

    def __init__(self, frequencies: np.ndarray, scale: int = SCALE):
        self.f = frequencies.astype(np.uint64)
        self.c = np.concatenate(([0], np.cumsum(self.f)[:-1])).astype(np.uint64)
        self.scale = np.uint64(scale)
        self.mask = np.uint64((1 << scale) - 1)
        self.symbol = np.repeat(np.arange(len(self.f), dtype=np.uint32), self.f.astype(np.int64))

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final states of the lanes, and the words in the order in which decoding reads them."""
        lanes = min(LANES, max(1, len(ids)))
        x = np.full(lanes, LOW, np.uint64)
        f_all, c_all = self.f[ids], self.c[ids]
        limit_shift, half = np.uint64(63 - int(self.scale)), np.uint64(32)
        low = np.uint64(0xFFFFFFFF)
        out = []
        for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
            f, c = f_all[at : at + lanes], c_all[at : at + lanes]
            y = x[: len(f)]
            full = y >= (f << limit_shift)
            spill = y[full]
            out.append((spill & low).astype("<u4"))
            y[full] = spill >> half
            q = y // f
            y[:] = (q << self.scale) + (y - q * f) + c
        return x, np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")

    def decode(self, n: int, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        x = states.astype(np.uint64).copy()
        lanes = len(x)
        ids = np.empty(n, np.uint32)
        words = words.astype(np.uint64)
        half, low = np.uint64(32), np.uint64(LOW)
        used = 0
        for at in range(0, n, lanes):
            y = x[: min(lanes, n - at)]
            slot = y & self.mask
            symbol = self.symbol[slot]
            ids[at : at + len(y)] = symbol
            y[:] = self.f[symbol] * (y >> self.scale) + slot - self.c[symbol]
            empty = np.flatnonzero(y < low)
            if len(empty):
                y[empty] = (y[empty] << half) | words[used : used + len(empty)]
                used += len(empty)
        return ids


def crc(data: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(data))


def write(docs: DataFrame, tokenizer: str, path: str, end: int = END) -> None:
    """Encode all documents into a new file set at ``path``."""
    spark = docs.sparkSession
    ids = stored(tokens(docs, tokenizer, end), "ids")
    with open(tokenizer, encoding="utf-8") as f:
        width = int(Encoder.of(f.read()).kind[2])
    counts = counted(ids, width)
    # At most one row for each id of the vocabulary.
    rows = counts.collect()
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    frequencies = scaled(counts)
    table = [(i, int(f)) for i, f in enumerate(frequencies) if f]
    spark.createDataFrame(table, "id bigint, frequency bigint").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(frequencies)

    def run(batches):
        coder = Coder(shared.value)
        part = TaskContext.get().partitionId()
        block = start = 0
        names, sizes, held, n = [], [], [], 0

        def close():
            nonlocal block, start, names, sizes, held, n
            own = np.concatenate(held).astype(np.uint32)
            states, words = coder.encode(own)
            row = (part, block, start, n, names, sizes, states.astype("<u8").tobytes(), words.tobytes(), crc(words), crc(own.astype("<u4")))
            block, start = block + 1, start + n
            names, sizes, held, n = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS)], _NAMES)

        for batch in batches:
            for doc, size, own in zip(*(c.to_pylist() for c in batch.columns)):
                names.append(doc)
                sizes.append(size)
                held.append(np.frombuffer(own, f"<u{width}"))
                n += size
                if n >= BLOCK:
                    yield close()
        if n:
            yield close()

    # At least 2: a single range would not be sorted across its rows by the exchange.
    parts = max(2, -(-int(counts.sum()) // TASK_IDS))
    ordered = ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")


_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
_KINDS = [
    {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}[c.split()[1]]
    for c in BLOCKS.split(", ")
]


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode a file set: (doc_id, start, n_tokens, ids_crc32) and, if asked for, the ids."""
    table = spark.read.parquet(f"{path}/table").collect()  # at most one row for each id of the vocabulary
    frequencies = np.zeros(max((r.id for r in table), default=-1) + 1, np.uint64)
    for r in table:
        frequencies[r.id] = r.frequency
    shared = spark.sparkContext.broadcast(frequencies)
    kinds = "part int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def run(batches):
        coder = Coder(shared.value)
        for batch in batches:
            for r in batch.to_pylist():
                if zlib.crc32(r["words"]) != r["words_crc"]:
                    raise ValueError(f"block {r['part']}/{r['block']}: damaged words")
                words = np.frombuffer(r["words"], "<u4")
                ids = coder.decode(r["n_ids"], np.frombuffer(r["states"], "<u8"), words)
                if crc(ids.astype("<u4")) != r["ids_crc"]:
                    raise ValueError(f"block {r['part']}/{r['block']}: wrong ids")
                ends = np.cumsum(r["counts"])
                starts = ends - r["counts"]
                columns = [
                    pa.array([r["part"]] * len(ends), pa.int32()),
                    pa.array(r["doc_ids"], pa.int64()),
                    pa.array(starts + r["start"], pa.int64()),
                    pa.array(r["counts"], pa.int64()),
                    pa.array([crc(ids[a:b].astype("<u4")) for a, b in zip(starts, ends)], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts, ends)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in kinds.split(", ")])

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    decoded = blocks.mapInArrow(run, kinds)
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return decoded.join(offsets, "part").select(
        "doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write a file set below the shared folder and read it back."""
    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    write(docs, tokenizer or default_tokenizer(), path)
    return read(spark, path)
