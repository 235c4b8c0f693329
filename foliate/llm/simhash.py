"""SimHash near duplicates by segment popcounts.

A fingerprint of 64 bits is embedded as its bit counts in 32 segments of two bits. The Manhattan distance of two
embeddings is at most the Hamming distance of the fingerprints, so fingerprints within ``DISTANCE`` bits have
embeddings within ``DISTANCE``. The segments form ``BLOCKS`` blocks; at most ``DISTANCE`` of them can
differ, so the two embeddings agree on all segments of at least ``BLOCKS - DISTANCE`` blocks. Each choice of
so many blocks is a grid whose cells are the counts in them: a pair in reach shares a cell in some
grid, a random pair hardly ever does. Cells are range-joined inside: first the Manhattan distance, then the bits.

Fingerprints are distinct before they enter the grid, so groups of copies of any size are one point. Inside a
cell a search visits each fingerprint once and emits the edges of a spanning forest, never all pairs. Cells
above ``CELL`` points are dealt again by their exact bits in each quarter, one of which must be equal.

Defined results: null or empty text: fingerprint zero, linked like any other; null doc_ids are rows like others and
never lower a component_id (null if all are); repeated rows fall into one component; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliate.llm import arrays as A
from foliate.llm.common import free_name, stored
from foliate.llm.components import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
BLOCKS = 6
CELL = 20_000
#: Grid rows that one task searches together.
TASK_ROWS = 200_000


def fingerprints_of(texts: list[bytes], words: int = SHINGLE) -> np.ndarray:
    """A bit is one where more than half of the shingle hashes have it."""
    hashes, counts = [], []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        parts = text.lower().split()
        if len(parts) <= words:
            own = [digest(b" ".join(parts), SEED)] if parts else []
        else:
            joined = b" ".join(parts)
            ends = np.cumsum([len(p) + 1 for p in parts])
            starts = np.concatenate(([0], ends[:-1]))[: len(parts) - words + 1].tolist()
            own = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
        hashes.append(np.array(own, np.uint64))
        counts.append(len(own))
    counts = np.array(counts)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    flat = np.concatenate(hashes)
    ones = np.zeros((len(some), 64), np.int64)
    owner = np.repeat(np.arange(len(some)), counts[some])
    for at in range(0, len(flat), 1 << 17):
        part, own = flat[at : at + (1 << 17)], owner[at : at + (1 << 17)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ones[own[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
    major = (2 * ones > counts[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(major, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def with_fingerprint(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """The rows with their fingerprint as a signed integer of 64 bits."""

    def add(batches):
        for batch in batches:
            for part in A.slices(batch, text):
                texts = [(x or "").encode() for x in part.column(part.schema.get_field_index(text)).to_pylist()]
                yield A.with_columns(part, **{name: pa.array(fingerprints_of(texts).view(np.int64))})

    return docs.mapInArrow(add, T.StructType([*docs.schema, T.StructField(name, T.LongType())]))


def embedding(f: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments as tallies in place: none 00, one 01, two 11.

    Tallies make the Manhattan distance of two embeddings the number of bits in which they differ.
    """
    low = np.uint64(0x5555555555555555)
    other = f >> np.uint64(1)
    return ((f | other) & low) | (((f & other) & low) << np.uint64(1))


def _blocks() -> list[int]:
    """Masks over the segments of each block."""
    cuts = np.linspace(0, 32, BLOCKS + 1).round().astype(int)
    return [((1 << 2 * int(b)) - 1) ^ ((1 << 2 * int(a)) - 1) for a, b in zip(cuts[:-1], cuts[1:])]


def manhattan(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Sum of the differences of two embeddings, segment by segment."""
    return np.bitwise_count(c ^ d)


def forest(f: np.ndarray, distance: int = DISTANCE):
    """Edges of a spanning forest of the links among distinct fingerprints.

    Each point is compared once with the points not reached yet: points of one dense cluster leave after the
    first comparison.
    """
    rest = np.sort(f)
    a, b = [], []
    while len(rest):
        todo = [rest[-1]]
        rest = rest[:-1]
        while todo and len(rest):
            x = todo.pop()
            near = np.flatnonzero(manhattan(embedding(rest), embedding(x)) <= distance)
            near = near[np.bitwise_count(rest[near] ^ x) <= distance]
            if len(near):
                reached = rest[near]
                a.append(np.full(len(reached), x))
                b.append(reached)
                todo.extend(reached)
                rest = np.delete(rest, near)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _grid(batches):
    """One row per fingerprint and grid: the cell and the fingerprint."""
    masks = _blocks()
    choices = list(combinations(range(BLOCKS), BLOCKS - DISTANCE))
    for batch in batches:
        f = A.longs(batch.column(0)).view(np.uint64)
        c = embedding(f)
        for i, choice in enumerate(choices):
            mask = np.uint64(sum(masks[k] for k in choice))
            cell = A.mix((c & mask) ^ A.mix(np.array([i + 1], np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(f.view(np.int64))], ["cell", "f"])


def _quarters(batches):
    """The same for large cells: a cell for each exact quarter of the bits."""
    for batch in batches:
        cell = A.longs(batch.column(0)).view(np.uint64)
        f = A.longs(batch.column(1)).view(np.uint64)
        for q in range(4):
            bits = (f >> np.uint64(16 * q)) & np.uint64(0xFFFF)
            own = A.mix(cell ^ A.mix(bits * np.uint64(4) + np.uint64(q) + np.uint64(1)))
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(f.view(np.int64))], ["cell", "f"])


def _search(t: pa.Table) -> pa.Table:
    """Links inside the cells of one bucket."""
    cell, f = A.longs(t.column("cell")), A.longs(t.column("f")).view(np.uint64)
    order = np.argsort(cell, kind="stable")
    cell, f = cell[order], f[order]
    at = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    ends = np.append(at[1:], len(cell))
    a, b = [], []
    pairs = ends - at == 2
    x, y = f[at[pairs]], f[at[pairs] + 1]
    near = (manhattan(embedding(x), embedding(y)) <= DISTANCE) & (np.bitwise_count(x ^ y) <= DISTANCE)
    a.append(x[near])
    b.append(y[near])
    for i in np.flatnonzero(ends - at > 2):
        u, v = forest(f[at[i] : ends[i]])
        a.append(u)
        b.append(v)
    return pa.table({"a": pa.array(np.concatenate(a).view(np.int64)), "b": pa.array(np.concatenate(b).view(np.int64))})


def links(points: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``f`` within reach of one another."""
    cells = points.select("f").mapInArrow(_grid, "cell bigint, f bigint")
    large = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL).select("cell")
    again = cells.join(large, "cell", "left_semi").mapInArrow(_quarters, "cell bigint, f bigint")
    rows = cells.join(large, "cell", "left_anti").select("cell", "f").unionByName(again)
    choices = len(list(combinations(range(BLOCKS), DISTANCE)))
    buckets = max(8, points.count() * choices // TASK_ROWS)
    bucket = F.pmod(F.xxhash64("cell"), F.lit(buckets)).cast("int")
    return rows.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_search, "a bigint, b bigint")


def grouped(prints: DataFrame) -> DataFrame:
    """(f, component, first_id): for each distinct fingerprint, its component and the smallest doc_id in it.

    ``prints`` has doc_id and f. The component is named by a fingerprint; ``holder`` is the one whose document stays.
    """
    points = stored(prints.groupBy("f").agg(F.min("doc_id").alias("least")), "points")
    roots = components(links(points))
    labelled = points.join(roots.withColumnRenamed("node", "f"), "f", "left").select(
        "f", "least", F.coalesce("root", "f").alias("component")
    )
    first = labelled.groupBy("component").agg(
        F.min(F.struct(F.col("least").isNull().alias("n"), F.col("least").alias("id"), F.col("f").alias("holder"))).alias("s")
    )
    return labelled.join(first, "component").select(
        "f", "component", F.col("s.id").alias("first_id"), F.col("s.holder").alias("holder")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint and the smallest doc_id that it is linked to, directly or through others."""
    prints = stored(with_fingerprint(docs.select("doc_id", "text"), "f").select("doc_id", "f"), "prints")
    return prints.join(grouped(prints), "f").select(
        "doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.col("first_id").alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest doc_id, with all its columns."""
    name, least, own = (free_name(docs, x) for x in ("_f", "_least", "_print"))
    marked = with_fingerprint(docs, name)
    prints = stored(with_fingerprint(docs.select("doc_id", "text"), "f").select("doc_id", "f"), "prints")
    keep = grouped(prints).filter("f = holder").select(F.col("first_id").alias(least), F.col("f").alias(own))
    match = F.col(name) == F.col(own)
    kept = marked.join(keep, match & F.col("doc_id").eqNullSafe(F.col(least)), "left_semi")
    return kept.dropDuplicates(["doc_id", name]).select(*[F.col(f"`{c}`") for c in docs.columns])
