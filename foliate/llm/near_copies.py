"""Near copies: documents whose sets of five-word shingles have a Jaccard coefficient of ``LEAST`` or more.

A text is the set of its shingles (lower-case words between ASCII white space, 32-bit hashes; a shorter text is one shingle). The
search is operator 4's, in two steps. First fingerprints alone: a set has ``WORDS`` fingerprints of 64 bits, embedded as the bit counts of
segments of two bits. A grid is a choice of segments, its cells are the counts in them; sets meet in the cells that they
share, where first the Manhattan distance of one embedding and then the bits of all are compared. Two sets of likeness 0.8 differ in a bit with
probability 0.1515, in the count of a segment with 0.27; ``grid_of`` takes as many grids as leave a pair out of all cells with
probability ``MISS``, by calculation. Only fingerprints travel to the cells. Cells above ``CELL`` points (one template) are dealt again by more segments.

Then the sets: the candidates' connected components hold all links, so the sets of one component meet once and are
compared as a whole; no pair is linked on fingerprints alone. A component above ``TASK_BYTES`` is dealt to cells of its own by
min-hashes: sets meet that share one of ``BANDS`` marks of ``ROWS`` min-hashes each, a pair of likeness J with probability
1 - (1 - J**ROWS)**BANDS, 0.9998 at 0.8; cells still above it by pairs of marks, and once more by triples; a pair that a
cell so split has lost must share no second mark, which at 0.8 has probability 0.0004. Cells with the same members are searched once.
Copies of any number are one set.

Both searches visit each point of their cell once and emit a spanning forest of the links; points already reached are not compared
again. Sets are compared in full only if enough of their ``BANDS * ROWS`` min-hashes, a byte each, are equal: at 0.8
fewer than ``ALIKE`` of 64 are with probability below 0.00001.

Defined results: null, empty and blank texts are copies of each other; null doc_ids are rows like others and stay only if
their whole component has none else; repeated rows fall into one component; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliate.llm import arrays as A
from foliate.llm import simhash as S
from foliate.llm.common import forget, free_name, stored
from foliate.llm.components import components

SHINGLE = 5
LEAST = 0.8
#: Fingerprints of 64 bits per set; Manhattan distance of the first two embeddings, bits of the first and bits of all that two near copies may differ in.
WORDS = 4
NEAR, FIRST, BITS = 19, 22, 66
#: Sets of so few shingles differ in more bits (0.19 of them for four of five shingles) and are searched once more, in grids of their own.
FEW, FEW_BITS = 5, 76
#: Probability of the same count in a segment: of near copies at ``LEAST`` and of unrelated sets.
SAME, CHANCE = 0.7314, 0.375
#: Unrelated sets that a set may meet in a cell, the least number of segments of a grid, and the share of pairs that all grids may miss.
COMPANY, SEGMENTS, MISS = 20_000, 3, 1e-4
#: Points of a cell, of a task, and how cells above that are dealt again: so many grids of so many more segments, so many times.
CELL, TASK_ROWS = 100_000, 100_000
AGAIN, MORE, TIMES = 12, 2, 2
BANDS, ROWS = 16, 4
ALIKE = 34
#: Bytes of sets that one task searches together, and how many fingerprints may name a cell.
TASK_BYTES = 8 << 20
DEPTH = 3
_FACTORS = A.mix(np.arange(1, BANDS * ROWS + 1, dtype=A.U) * A.STEP) | A.U(1)
_TERMS = A.mix(np.arange(1001, BANDS * ROWS + 1001, dtype=A.U) * A.STEP)
_SEEDS = A.mix(np.arange(2001, WORDS + 2001, dtype=A.U) * A.STEP)
_LANES = A.U(0x0101010101010101)
PRINTS = [f"p{i}" for i in range(WORDS)]


def shingles(column, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 32-bit shingle hashes of all texts behind one another, and the texts' limits."""
    data, offsets = A.buffer_of(column)
    low = A.LOWER[data]
    first, last, limits = A.words_of(low, offsets)
    values = A.range_hashes(low, first, last)
    n = len(offsets) - 1
    grams = A.gram_hashes(values, words)
    doc = np.searchsorted(limits, np.arange(len(grams)), side="right") - 1
    whole = np.arange(len(grams)) + words <= limits[doc + 1]
    size = np.diff(limits)
    short = np.flatnonzero((size > 0) & (size < words))
    alone = A.range_hashes(values, limits[short], limits[short + 1]) if len(short) else np.zeros(0, A.U)
    owner = np.concatenate((doc[whole], short)).astype(A.U)
    keys = np.unique((owner << A.U(32)) | (np.concatenate((grams[whole], alone)) >> A.U(32)))
    return (keys & A.U(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(keys >> A.U(32), np.arange(n + 1))


def fingerprints(marks: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """``WORDS`` fingerprints of each set as rows: a bit is one where more than half of the shingles' hashes have it; an empty set has zeros."""
    out = np.zeros((len(limits) - 1, WORDS), A.U)
    size = np.diff(limits)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    # runs of at most 255 shingles of one set: the counts of eight bits fit the bytes of one word
    runs = -(-size[some] // 255)
    at = np.cumsum(runs) - runs
    begin = np.repeat(limits[:-1][some] - 255 * at, runs) + 255 * np.arange(runs.sum())
    wide = marks.astype(A.U) * A.STEP
    ones = np.empty((len(some), 64), np.int64)
    for w in range(WORDS):
        h = A.mix(wide + _SEEDS[w])
        for k in range(8):
            counts = np.add.reduceat((h >> A.U(k)) & _LANES, begin).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones[:, k::8] = np.add.reduceat(counts, at, axis=0, dtype=np.int64)
        out[some, w] = np.packbits(2 * ones > size[some][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def min_hashes(marks: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """``BANDS * ROWS`` min-hashes of each set as rows; an empty set has zeros."""
    out = np.zeros((len(limits) - 1, len(_FACTORS)), np.uint32)
    some = np.flatnonzero(np.diff(limits))
    if len(some):
        wide = marks.astype(A.U)
        for k, (a, b) in enumerate(zip(_FACTORS, _TERMS)):
            out[some, k] = np.minimum.reduceat(((wide * a + b) >> A.U(32)).astype(np.uint32), limits[:-1][some])
    return out


def bands_of(least: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint per set and band."""
    out = np.empty((len(least), BANDS), A.U)
    for i in range(BANDS):
        mark = np.full(len(least), i + 1, A.U)
        for k in range(i * ROWS, (i + 1) * ROWS):
            mark = A.mix(mark * A.STEP + least[:, k])
        out[:, i] = mark
    return out


def names_of(marks: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """A 64-bit name per set."""
    data = marks.astype("<u4").tobytes()
    return np.array([xxhash.xxh3_64_intdigest(data[4 * a : 4 * b]) for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())], A.U).view(np.int64)


def with_name(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """The rows with the name of their set."""

    def add(batches):
        for batch in batches:
            for part in A.slices(batch, text):
                yield A.with_columns(part, **{name: pa.array(names_of(*shingles(part.column(part.schema.get_field_index(text)))))})

    return docs.mapInArrow(add, T.StructType([*docs.schema, T.StructField(name, T.LongType())]))


def _printed(batches):
    """Sets with their fingerprints."""
    for batch in batches:
        for part in A.slices(batch, "text"):
            marks, limits = shingles(part.column(1))
            prints = fingerprints(marks, limits).view(np.int64)
            columns = [part.column(0), pa.array(names_of(marks, limits)), pa.array(np.diff(limits)), *(pa.array(prints[:, w].copy()) for w in range(WORDS))]
            data = marks.astype("<u4").tobytes()
            columns.append(pa.array([data[4 * a : 4 * b] for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "s", "n", *PRINTS, "marks"])


def _banded(batches):
    """(s, n, bands) of sets (s, marks)."""
    for batch in batches:
        data, offsets = A.buffer_of(batch.column(1))
        bands = bands_of(min_hashes(data.view("<u4"), offsets // 4)).view(np.int64)
        at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets) // 4), pa.ListArray.from_arrays(at, pa.array(bands.reshape(-1)))], ["s", "n", "bands"]
        )


def grid_of(points: int) -> tuple[int, int]:
    """Segments of a grid and number of grids for so many points."""
    segments = max(SEGMENTS, int(np.ceil(np.log(max(points, 1) / COMPANY) / -np.log(CHANCE))))
    return segments, int(np.ceil(np.log(MISS) / np.log1p(-(SAME**segments))))


def masks_of(grids: int, segments: int, seed: int) -> list[list[int]]:
    """The segments of each grid as masks over the words; grids share segments only when all are used up."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < grids:
        order = rng.permutation(32 * WORDS).tolist()
        for i in range(0, len(order) - segments + 1, segments):
            own = [0] * WORDS
            for place in order[i : i + segments]:
                own[place // 32] |= 3 << 2 * (place % 32)
            out.append(own)
    return out[:grids]


def cells_of(cell: np.ndarray, tallies: list[np.ndarray], grid: int, masks: list[int]) -> np.ndarray:
    """Cells of points inside the cell that they come from."""
    out = A.mix(cell ^ A.mix(np.array([grid + 1], A.U)))
    for tally, mask in zip(tallies, masks):
        if mask:
            out = A.mix(out ^ (tally & A.U(mask)))
    return out


def _grid(masks: list[list[int]], alone: bool = False):
    """One row per point (cell, s, fingerprints) and grid, with the cell in that grid; or its cell alone."""

    def run(batches):
        for batch in batches:
            cell = A.longs(batch.column(0)).view(A.U)
            tallies = [S.embedding(A.longs(batch.column(2 + w)).view(A.U)) for w in range(WORDS)]
            for i, own in enumerate(masks):
                cells = pa.array(cells_of(cell, tallies, i, own).view(np.int64))
                yield pa.RecordBatch.from_arrays([cells, *([] if alone else batch.columns[1:])], ["cell", *([] if alone else ["s", *PRINTS])])

    return run


def print_forest(names: np.ndarray, prints: np.ndarray, bits: int = BITS):
    """Edges of a spanning forest of the candidates among the points of a cell: Manhattan distance of the first embeddings, then the bits."""
    own = np.ascontiguousarray(prints[:, 0])
    tallies = S.embedding(own)
    rest, first = np.arange(len(names)), tallies
    a, b = [], []
    while len(rest):
        todo, rest, first = [rest[-1]], rest[:-1], first[:-1]
        while todo and len(rest):
            x = todo.pop()
            near = np.flatnonzero(S.manhattan(first, tallies[x]) <= NEAR)
            near = near[np.bitwise_count(own[rest[near]] ^ own[x]) <= FIRST]
            if not len(near):
                continue
            near = near[np.bitwise_count(prints[rest[near]] ^ prints[x]).sum(axis=1) <= bits]
            if len(near):
                reached = rest[near]
                a.append(np.full(len(near), names[x]))
                b.append(names[reached])
                todo.extend(reached.tolist())
                rest, first = np.delete(rest, near), np.delete(first, near)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _search_prints(t: pa.Table, bits: int) -> pa.Table:
    """Candidates inside the cells of one bucket."""
    cell, names = A.longs(t.column("cell")), A.longs(t.column("s"))
    prints = np.stack([A.longs(t.column(p)).view(A.U) for p in PRINTS], axis=1)
    order = np.argsort(cell, kind="stable")
    cell, names, prints = cell[order], names[order], prints[order]
    at = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    ends = np.append(at[1:], len(cell))
    found = [print_forest(names[i:j], prints[i:j], bits) for i, j in zip(at.tolist(), ends.tolist()) if j - i > 1]
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip((none, none), *found))
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def candidates(points: DataFrame, cell: int = CELL, bits: int = BITS, seed: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) that connect all points (s, fingerprints) that are near one another in a cell of some grid; and what was stored."""
    count = points.count()
    segments, grids = grid_of(count)
    schema = ", ".join(f"{c} bigint" for c in ("cell", "s", *PRINTS))
    rows, masks, out, kept = points.select(F.lit(0).cast("bigint").alias("cell"), "s", *PRINTS), masks_of(grids, segments, seed), None, []
    for depth in range(TIMES + 1):
        dealt = rows.mapInArrow(_grid(masks), schema)
        last = depth == TIMES
        if not last:
            own = rows.mapInArrow(_grid(masks, alone=True), "cell bigint").groupBy("cell").agg(F.count(F.lit(1)).alias("k"))
            large = stored(own.filter(F.col("k") > cell).select("cell"), "large")
            kept.append(large)
            last = large.isEmpty()
        fitting = dealt if last else dealt.join(large, "cell", "left_anti").select("cell", "s", *PRINTS)
        out = fitting if out is None else out.unionByName(fitting)
        if last:
            break
        rows = stored(dealt.join(large, "cell", "left_semi").select("cell", "s", *PRINTS), "cells")
        kept.append(rows)
        masks = masks_of(AGAIN, MORE, seed + depth + 1)
    buckets = max(8, count * grids // TASK_ROWS)
    bucket = F.pmod(F.xxhash64("cell"), F.lit(buckets)).cast("int")
    out = out.withColumn("bucket", bucket).repartition(buckets, "bucket")
    return out.groupBy("bucket").applyInArrow(lambda t: _search_prints(t, bits), "a bigint, b bigint"), kept


def _sets(batches):
    """Sets with their min-hashes, for cells that are dealt without fingerprints."""
    for batch in batches:
        for part in A.slices(batch, "text"):
            marks, limits = shingles(part.column(1))
            least = min_hashes(marks, limits)
            size = np.diff(limits)
            at = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS)
            bands = pa.ListArray.from_arrays(at, pa.array(bands_of(least).view(np.int64).reshape(-1)), mask=pa.array(size == 0))
            data, sketch = marks.astype("<u4").tobytes(), (least & np.uint32(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(names_of(marks, limits)),
                    pa.array(size),
                    bands,
                    pa.array([x.tobytes() for x in sketch], pa.binary()),
                    pa.array([data[4 * a : 4 * b] for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())], pa.binary()),
                ],
                ["doc_id", "s", "n", "bands", "sketch", "marks"],
            )


def forest(names: np.ndarray, sketch: np.ndarray, marks: np.ndarray, limits: np.ndarray, least: float = LEAST):
    """Edges of a spanning forest of the links among the distinct sets of a cell."""
    size = np.diff(limits)
    rest = np.arange(len(names))
    a, b = [], []
    while len(rest):
        todo, rest = [rest[-1]], rest[:-1]
        while todo and len(rest):
            x = todo.pop()
            small, large = np.minimum(size[rest], size[x]), np.maximum(size[rest], size[x])
            near = rest[small >= least * large]
            near = near[np.count_nonzero(sketch[near] == sketch[x], axis=1) >= ALIKE]
            if not len(near):
                continue
            own = marks[limits[x] : limits[x + 1]]
            others = marks[A.ranges(limits[near], size[near])]
            hit = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
            both = np.add.reduceat(hit, np.cumsum(size[near]) - size[near], dtype=np.int64)
            near = near[both >= least * (size[near] + size[x] - both)]
            if len(near):
                a.append(np.full(len(near), names[x]))
                b.append(names[near])
                todo.extend(near.tolist())
                rest = np.setdiff1d(rest, near, assume_unique=True)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _search(t: pa.Table, least: float = LEAST) -> pa.Table:
    """Links inside the cells of one bucket."""
    cell, names = A.longs(t.column("cell")), A.longs(t.column("s"))
    order = np.lexsort((names, cell))
    # Repeated rows of one doc_id arrive more than once.
    new = np.concatenate(([True], (np.diff(cell[order]) != 0) | (np.diff(names[order]) != 0)))
    order = order[new]
    cell, names = cell[order], names[order]
    data, offsets = A.buffer_of(t.column("marks"))
    if t.column("sketch").null_count:
        sketch = (min_hashes(data.view("<u4"), offsets // 4) & np.uint32(0xFF)).astype(np.uint8)
    else:
        sketch = A.buffer_of(t.column("sketch"))[0].reshape(-1, BANDS * ROWS)
    at = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    found = []
    for i, j in zip(at.tolist(), [*at[1:].tolist(), len(cell)]):
        own = order[i:j]
        size = offsets[own + 1] - offsets[own]
        marks = data[A.ranges(offsets[own], size)].view("<u4")
        found.append(forest(names[i:j], sketch[own], marks, np.concatenate(([0], np.cumsum(size // 4))), least))
    a, b = (np.concatenate(x) for x in zip(*found))
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def _dealt(points: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """(s, cell): sets by fingerprint; those of cells above ``limit`` bytes by two of them, then by three. And what was stored for it."""
    rows, out, kept = points.select("s", "n", F.posexplode("bands").alias("i", "cell")), None, []
    for depth in range(1, DEPTH + 1):
        rows = stored(rows, "cells")
        kept.append(rows)
        fitting = rows
        if depth < DEPTH:
            own = rows.groupBy("cell").agg(F.sum(_bytes()).alias("bytes"), F.count(F.lit(1)).alias("k"))
            large = stored(own.filter((F.col("bytes") > limit) & (F.col("k") > 2)).select("cell"), "large")
            kept.append(large)
        last = depth == DEPTH or large.isEmpty()
        if not last:
            fitting = rows.join(large, "cell", "left_anti")
        out = fitting.select("s", "cell") if out is None else out.unionByName(fitting.select("s", "cell"))
        if last:
            return out, kept
        # a pair that shares an earlier fingerprint as well meets in the cell of that one
        more = F.expr("filter(transform(bands, (b, j) -> struct(j, xxhash64(cell, b) AS cell)), x -> x.j > i)")
        again = rows.join(large, "cell", "left_semi").join(points.select("s", "bands"), "s")
        rows = again.select("s", "n", F.inline(more).alias("i", "cell"))


def _bytes():
    return 4 * F.col("n") + BANDS * ROWS + 16


def links(
    sets: DataFrame, points: DataFrame, limit: int = TASK_BYTES, placed: DataFrame | None = None, least: float = LEAST
) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) that connect all sets within reach of one another, searched under the ``bands`` of ``placed`` (else of the points); and what was stored.

    A null ``sketch`` is made from the marks where the sets meet.
    """
    cells, kept = _dealt(points if placed is None else placed, limit)
    members = cells.groupBy("cell").agg(
        F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("s")).alias("x"), F.bit_xor(F.xxhash64("s", F.lit(1))).alias("y")
    )
    once = members.filter("k > 1").groupBy("k", "x", "y").agg(F.min("cell").alias("cell")).select("cell")
    chosen = stored(cells.join(once, "cell").join(points.select("s", "least", "n"), "s"), "wanted")
    size = chosen.agg(F.sum(_bytes())).first()[0] or 0
    buckets = max(8, -(-int(size) // limit))
    wanted = chosen.select(F.col("s").alias("_s"), "least", "cell")
    rows = sets.join(wanted, (F.col("s") == F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("least")))
    bucket = F.pmod(F.xxhash64("cell"), F.lit(buckets)).cast("int")
    rows = rows.select("cell", "s", "sketch", "marks", bucket.alias("bucket"))
    return rows.groupBy("bucket").applyInArrow(lambda t: _search(t, least), "a bigint, b bigint"), [*kept, chosen]


def exact(sets: DataFrame, points: DataFrame, edges: DataFrame, limit: int = TASK_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) that connect all sets within reach of one another, searched in the components of the candidates; and what was stored."""
    roots = components(edges)
    groups = roots.select(F.col("node").alias("s"), "root").unionByName(roots.select(F.col("root").alias("s"), "root").distinct())
    members = stored(points.select("s", "least", "n").join(groups, "s"), "members")
    large = stored(members.groupBy("root").agg(F.sum(_bytes()).alias("bytes")).filter(F.col("bytes") > limit).select("root"), "large")
    placed, kept = members.join(large, "root", "left_anti").select("s", "n", F.array("root").alias("bands")), [members, large]
    if not large.isEmpty():
        own = members.join(large, "root", "left_semi").select(F.col("s").alias("_s"), "least")
        own = sets.join(own, (F.col("s") == F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("s", "marks")
        own = stored(own.mapInArrow(_banded, "s bigint, n bigint, bands array<bigint>").dropDuplicates(["s"]), "banded")
        placed = placed.unionByName(own)
        kept.append(own)
    plain = sets.select("doc_id", "s", F.lit(None).cast("binary").alias("sketch"), "marks")
    out, more = links(plain, members, limit, placed)
    return out, [*kept, *more]


def holders(docs: DataFrame) -> DataFrame:
    """(s, least): the set and the doc_id of the document that stays, one row per component."""
    columns = f"doc_id bigint, s bigint, n bigint, {', '.join(f'{p} bigint' for p in PRINTS)}, marks binary"
    sets = stored(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_printed, columns), "sets")
    firsts = [F.first(c).alias(c) for c in ("n", *PRINTS)]
    points = stored(sets.groupBy("s").agg(F.min("doc_id").alias("least"), *firsts), "points")
    near, kept = candidates(points.filter("n > 0"))
    few, also = candidates(points.filter(F.col("n").between(1, FEW)), bits=FEW_BITS, seed=100)
    edges, more = exact(sets, points, near.unionByName(few))
    roots = components(edges)
    forget(sets, *kept, *also, *more)
    labelled = points.join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("component", F.coalesce("root", "s"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("least"), F.col("s").alias("s")))
    return labelled.groupBy("component").agg(first.alias("h")).select("h.s", "h.least")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies, that with the smallest doc_id, with all its columns."""
    name, holder, least = (free_name(docs, x) for x in ("_s", "_holder", "_least"))
    keep = holders(docs).select(F.col("s").alias(holder), F.col("least").alias(least))
    kept = with_name(docs, name).join(keep, (F.col(name) == F.col(holder)) & F.col("doc_id").eqNullSafe(F.col(least)), "left_semi")
    return kept.dropDuplicates(["doc_id", name]).select(*[F.col(f"`{c}`") for c in docs.columns])
