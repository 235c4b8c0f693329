"""Benchmark decontamination: n-grams of a benchmark in a broadcast hash set, documents scanned past it.

Words are ASCII letters in lower case, digits and everything beyond ASCII. A window is ``n`` consecutive
words of a benchmark item; an item with fewer words is one window. Documents stream through their tasks once;
a window hash that is in the set is verified word by word.

The set is broadcast, so its size is checked: the benchmark is split into blocks of at most
``block_bytes`` of text, each block is one broadcast, and the passes over the blocks follow one another in the same task. No row is shuffled.

Defined results: a null or empty text has no words and is never contaminated; benchmark items without words have no
windows; a null item_id reads as the empty string; repeated item_ids count once; an empty benchmark
hits nothing; further columns of the documents are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliate.llm import arrays as A
from foliate.llm.common import free_name, stored, text_bytes

N = 13
BLOCK_BYTES = 16 << 20


def _words(data: np.ndarray, offsets: np.ndarray):
    data = A.LOWER[data]
    first, last, limits = A.words_of(data, offsets, A.NOT_ALNUM)
    return data, first, last, limits, A.range_hashes(data, first, last)


class Grams:
    """The windows of some items: hashes in order, their words, and the items that hold them."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        held: dict[int, dict[bytes, set[str]]] = {}
        for name, text in items:
            data, offsets = A.buffer_of(pa.array([text], pa.string()))
            data, first, last, _, _ = _words(data, offsets)
            words = [data[a:b].tobytes() for a, b in zip(first, last)]
            size = min(n, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                held.setdefault(size, {}).setdefault(b" ".join(words[i : i + size]), set()).add(name)
        self.by_size = {}
        for size, grams in held.items():
            texts = [*grams]
            data, offsets = A.buffer_of(pa.array(texts, pa.binary()))
            data, first, last, limits, hashes = _words(data, offsets)
            keys = A.gram_hashes(hashes, size)[limits[:-1]]
            order = np.argsort(keys, kind="stable")
            self.by_size[size] = (keys[order], [texts[i] for i in order], [sorted(grams[texts[i]]) for i in order])

    def scan(self, batch: pa.RecordBatch, text: str):
        """Hit words of all rows together, the rows' limits and the items found in each row."""
        data, offsets = A.buffer_of(batch.column(batch.schema.get_field_index(text)))
        data, first, last, limits, hashes = _words(data, offsets)
        hit = np.zeros(len(hashes), bool)
        items = [set() for _ in range(batch.num_rows)]
        for size, (keys, texts, names) in self.by_size.items():
            grams = A.gram_hashes(hashes, size)
            if not len(grams):
                continue
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            found = np.flatnonzero(keys[at] == grams)
            row = np.searchsorted(limits, found, side="right") - 1
            whole = found + size <= limits[row + 1]
            for i, r in zip(found[whole].tolist(), row[whole].tolist()):
                words = b" ".join([data[a:b].tobytes() for a, b in zip(first[i : i + size], last[i : i + size])])
                k = int(at[i])
                # Equal hashes of different windows stand next to each other.
                while k < len(keys) and keys[k] == grams[i]:
                    if texts[k] == words:
                        hit[i : i + size] = True
                        items[r].update(names[k])
                    k += 1
        return hit, limits, items


def blocks_of(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts whose texts are about ``block_bytes`` long, by a hash of the item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter("text is not null")
    parts = max(1, -(-text_bytes(items) // block_bytes))
    if parts == 1:
        return [items]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * parts))
    return [items.filter(part == i) for i in range(2 * parts)]


def judged(docs: DataFrame, benchmark: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES, text: str = "text", prefix: str = "") -> DataFrame:
    """The rows with ``n_words``, ``n_hit``, ``hit`` (packed bits, one per word) and ``items``, behind ``prefix``."""
    names = {k: free_name(docs, prefix + k) for k in ("n_words", "n_hit", "hit", "items")}
    spark = docs.sparkSession
    out = docs.withColumns(
        {
            names["n_words"]: F.lit(0).cast("bigint"),
            names["n_hit"]: F.lit(0).cast("bigint"),
            names["hit"]: F.lit(b""),
            names["items"]: F.array().cast("array<string>"),
        }
    )
    kinds = dict(zip(names.values(), ("bigint", "bigint", "binary", "array<string>")))
    schema = T.StructType([f if f.name not in kinds else T.StructField(f.name, T._parse_datatype_string(kinds[f.name])) for f in out.schema])
    blocks = blocks_of(benchmark, block_bytes)
    for block in blocks:
        grams = spark.sparkContext.broadcast(Grams([(r.item_id, r.text) for r in block.collect()], n))

        def scan(batches, grams=grams):
            for batch in batches:
                for part in A.slices(batch, text):
                    hit, limits, items = grams.value.scan(part, text)
                    where = {k: part.schema.get_field_index(v) for k, v in names.items()}
                    before = part.column(where["hit"]).to_pylist()
                    held = part.column(where["items"]).to_pylist()
                    bits, counts = [], []
                    for r in range(part.num_rows):
                        own = hit[limits[r] : limits[r + 1]]
                        if before[r]:
                            own = own | np.unpackbits(np.frombuffer(before[r], np.uint8), count=len(own)).astype(bool)
                        counts.append(int(own.sum()))
                        bits.append(np.packbits(own).tobytes() if counts[-1] else b"")
                    new = {
                        "n_words": pa.array(np.diff(limits)),
                        "n_hit": pa.array(counts, pa.int64()),
                        "hit": pa.array(bits, pa.binary()),
                        "items": pa.array([sorted({*a, *b}) for a, b in zip(held, items)], pa.list_(pa.string())),
                    }
                    columns = list(part.columns)
                    for k, v in new.items():
                        columns[where[k]] = v
                    yield pa.RecordBatch.from_arrays(columns, part.schema.names)

        out = out.mapInArrow(scan, schema)
        if len(blocks) > 1:
            # one set at a time lies on the executors
            out = stored(out, "judged")
            grams.unpersist()
    return out


def contaminated(n_words, n_hit):
    """Some word is hit, and at least one word in twenty."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def reports(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, items found, verdict."""
    out = judged(docs.select("doc_id", "text"), benchmark)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    out = judged(docs, benchmark, prefix="_bench_")
    added = out.columns[len(docs.columns) :]
    return out.filter(~contaminated(F.col(added[0]), F.col(added[1]))).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents; hit words are cut out of their texts, from the first to the last byte of each run of hit words."""
    out = judged(docs, benchmark, prefix="_bench_")
    hit_name = out.columns[len(docs.columns) + 2]

    def cut(batches):
        for batch in batches:
            for part in A.slices(batch, "text"):
                at = part.schema.get_field_index("text")
                data, offsets = A.buffer_of(part.column(at))
                _, first, last, limits, _ = _words(data, offsets)
                texts = []
                for r, bits in enumerate(part.column(part.schema.get_field_index(hit_name)).to_pylist()):
                    a, b = offsets[r], offsets[r + 1]
                    if not bits:
                        texts.append(part.column(at)[r].as_py())
                        continue
                    n = limits[r + 1] - limits[r]
                    hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
                    step = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
                    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
                    out_of = first[limits[r] + starts] - a, last[limits[r] + ends] - a
                    gone = A.covered(b - a, out_of[0], out_of[1] - out_of[0])
                    texts.append(data[a:b][~gone].tobytes().decode("utf-8"))
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return out.mapInArrow(cut, out.schema).select(*[F.col(f"`{c}`") for c in docs.columns])
