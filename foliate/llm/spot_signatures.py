"""Document fingerprints from spot signatures.

A spot is a very common word (an anchor) with the chain of the next ``CHAIN`` content words behind it, common words
skipped. Anchors occur in running prose and hardly in navigation or lists, so the set of a text's spots describes its prose.
The fingerprint is the sorted set of all spots, 32 bits each, in hexadecimal: nothing is sampled from it.

Two fingerprints are compared by the Jaccard coefficient of their sets. ``near_duplicates`` joins all of a corpus: distinct sets are dealt to
partitions by their length, whose bounds grow by the wanted likeness, so that a pair in reach lies in one or two neighbouring ones; inside a partition they
meet under their rarest spots, of which a pair in reach must share some; sets whose lengths rule the likeness out are not compared, the others
exactly, along a spanning forest. A text without a spot has one signature, of its words (or, without words, of its
bytes); an empty text has none. Two empty fingerprints are alike (1), an empty and another are not (0).

Defined results for edits: a null text is empty; the text after the last is the first; rows that share a doc_id follow one
another in the order of their texts; null doc_ids come first; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm import arrays as A
from foliate.llm import near_copies as N
from foliate.llm.common import forget, group_count, stored
from foliate.llm.components import components

CHAIN = 2
GROUP_BYTES = 8 << 20
SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
#: Common words of English, German, French and Spanish prose.
ANCHORS = (
    "the a an of to in is was that and for on with as be it by this are not "
    "der die das und ist in zu den von mit ein eine nicht auf sich des dem "
    "le la les de et un une des du est que en par pour dans sur pas au "
    "el los las del y se con por una su para lo al"
)


def _hashes(words: list[str]) -> np.ndarray:
    data, offsets = A.buffer_of(pa.array(words, pa.string()))
    return np.sort(A.range_hashes(data, offsets[:-1], offsets[1:]))


def signatures(texts: list[str] | pa.Array, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 32-bit signatures of all texts behind one another, and the texts' limits."""
    data, offsets = A.buffer_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    low = A.LOWER[data]
    first, last, limits = A.words_of(low, offsets, A.NOT_ALNUM)
    words = A.range_hashes(low, first, last)
    common = _hashes(sorted({*ANCHORS.split()}))
    at = np.minimum(np.searchsorted(common, words), len(common) - 1)
    anchor = common[at] == words
    content = np.flatnonzero(~anchor)
    spots = np.flatnonzero(anchor)
    doc = np.searchsorted(limits, spots, side="right") - 1
    begin = np.searchsorted(content, spots)
    # The whole chain has to lie in the text of its anchor.
    fits = begin + chain <= len(content)
    spots, doc, begin = spots[fits], doc[fits], begin[fits]
    fits = content[begin + chain - 1] < limits[doc + 1]
    spots, doc, begin = spots[fits], doc[fits], begin[fits]
    mark = np.zeros(len(spots), A.U)
    for i in reversed(range(chain)):
        mark = A.mix(words[content[begin + i]] + A.mix(mark + A.U(1)))
    mark = A.mix(words[spots] + mark) >> A.U(32)
    n = len(offsets) - 1
    plain = np.setdiff1d(np.arange(n), doc)
    plain = plain[offsets[plain + 1] > offsets[plain]]
    some = limits[plain + 1] > limits[plain]
    alone = np.concatenate(
        (
            A.range_hashes(words, limits[plain[some]], limits[plain[some] + 1]) if some.any() else np.zeros(0, A.U),
            A.range_hashes(data, offsets[plain[~some]], offsets[plain[~some] + 1]) if (~some).any() else np.zeros(0, A.U),
        )
    ) >> A.U(32)
    owners = np.concatenate((doc, plain[some], plain[~some]))
    keys = np.unique((owners.astype(A.U) << A.U(32)) | np.concatenate((mark, alone)))
    return (keys & A.U(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(keys >> A.U(32), np.arange(n + 1))


def text_of(marks: np.ndarray) -> str:
    return marks.astype(">u4").tobytes().hex()


def marks_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard coefficient of two sorted sets; 0 without comparison where the lengths rule out ``least``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def likenesses(a: np.ndarray, a_limits: np.ndarray, b: np.ndarray, b_limits: np.ndarray) -> np.ndarray:
    """``likeness`` of the sets of two columns, row by row."""
    n = len(a_limits) - 1
    na, nb = np.diff(a_limits), np.diff(b_limits)

    def keys(marks, sizes):
        return (np.repeat(np.arange(n), sizes).astype(A.U) << A.U(32)) | marks.astype(A.U)

    both = np.intersect1d(keys(a, na), keys(b, nb), assume_unique=True) >> A.U(32)
    both = np.bincount(both.astype(np.int64), minlength=n)
    union = na + nb - both
    return np.where(union == 0, 1.0, both / np.maximum(union, 1))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every text."""

    def run(batches):
        for batch in batches:
            for part in A.slices(batch, "text"):
                marks, limits = signatures(part.column(1))
                out = [text_of(marks[a:b]) for a, b in zip(limits[:-1], limits[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the next one's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness to each other and to the next text's.

    Texts are dealt by ranges of doc_id. The first text of each range also goes to the range before, as the
    next of its last text; the first of all goes to the last range.
    """
    least = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(least)).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = group_count(docs, GROUP_BYTES)
    cuts = rows.select(F.percentile_approx("key", [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right").astype(np.int32))

    # One row per range.
    firsts = sorted((r.part, r.first) for r in rows.groupBy(range_of("key").alias("part")).agg(F.min("key").alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    starts = np.array([f for _, f in firsts], np.int64)
    befores = np.array([before[f] for f in starts], np.int32)

    @F.pandas_udf("int")
    def also(key: pd.Series) -> pd.Series:
        at = np.minimum(np.searchsorted(starts, key.to_numpy()), len(starts) - 1)
        return pd.Series(np.where(starts[at] == key.to_numpy(), befores[at], -1).astype(np.int32))

    dealt = rows.withColumns({"part": range_of("key"), "also": also("key")})
    places = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("tail")), F.struct(F.col("also").alias("part"), F.lit(True).alias("tail")))
    dealt = dealt.select("key", "doc_id", "text", F.explode(F.filter(places, lambda p: p["part"] >= 0)).alias("p")).select("key", "doc_id", "text", "p.part", "p.tail")

    def run(t: pa.Table) -> pa.Table:
        whole = [*zip(t.column("key").to_pylist(), t.column("text").to_pylist(), t.column("doc_id").to_pylist(), t.column("tail").to_pylist())]
        own = sorted((r for r in whole if not r[3]), key=lambda r: r[:2])
        last = min((r for r in whole if r[3]), key=lambda r: r[:2])
        texts = [r[1] for r in own] + [last[1]]
        new = [edited(a, b) for a, b in zip(texts, texts[1:])]
        marks, limits = signatures(texts)
        other, other_limits = signatures(new)
        n = len(own)
        following = marks[limits[1] :], limits[1:] - limits[1]
        mine = marks[: limits[n]], limits[: n + 1]
        return pa.table(
            {
                "doc_id": pa.array([r[2] for r in own], pa.int64()),
                "n_chars": pa.array([len(x) for x in texts[:n]], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new], pa.string()),
                "fingerprint": pa.array([text_of(marks[a:b]) for a, b in zip(limits[:n], limits[1 : n + 1])], pa.string()),
                "edited_fingerprint": pa.array([text_of(other[a:b]) for a, b in zip(other_limits[:-1], other_limits[1:])], pa.string()),
                "near_edited": pa.array(likenesses(*mine, other, other_limits)),
                "near_next": pa.array(likenesses(*mine, *following)),
            }
        )

    return dealt.groupBy("part").applyInArrow(run, SCHEMA)


def _sets(batches):
    for batch in batches:
        for part in A.slices(batch, "text"):
            marks, limits = signatures(part.column(1))
            data, at = marks.astype("<u4").tobytes(), limits.tolist()
            lists = pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(marks.astype(np.int64)))
            columns = [part.column(0), pa.array(N.names_of(marks, limits)), pa.array(np.diff(limits)), lists, pa.array([data[4 * a : 4 * b] for a, b in zip(at, at[1:])], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "s", "n", "spots", "marks"])


def _bounds(longest: int, least: float) -> list[int]:
    """Where partitions by length begin: lengths of one are within ``least`` of each other, of every second one never."""
    out = [0, 1]
    while out[-1] <= longest:
        out.append(int(out[-1] / least) + 1)
    return out


def cells(points: DataFrame, least: float) -> DataFrame:
    """Each set's cells, rarest spots first: enough that sets alike to ``least`` share ``DEPTH`` of them, or all they have in common."""
    spots = points.filter("n > 0").select("s", "n", F.explode("spots").alias("spot"))
    counts = spots.groupBy("spot").agg(F.count(F.lit(1)).alias("k"))
    ranked = spots.join(counts, "spot").groupBy("s", "n").agg(F.array_sort(F.collect_list(F.struct("k", "spot"))).alias("r"))
    longest = points.agg(F.max("n")).first()[0] or 0
    # the last bound that is not above the length; a set is also shown to the partition above its own
    bounds = F.array(*[F.lit(b) for b in _bounds(longest, least)])
    level = F.size(F.filter(bounds, lambda b: b <= F.col("n")))
    prefix = F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * least - 1e-9) + N.DEPTH).cast("int")
    named = ranked.withColumn("level", level).withColumn("rare", F.transform(F.slice("r", F.lit(1), prefix), lambda x: x["spot"]))
    both = F.explode(F.array(F.col("level"), F.col("level") + 1)).alias("at")
    return named.select("s", "n", both, "rare").select("s", "n", F.expr("transform(rare, x -> xxhash64(at, x))").alias("bands"))


def near_duplicates(docs: DataFrame, least: float = 0.8, limit: int = N.TASK_BYTES) -> DataFrame:
    """Per document the size of its set and its class: the smallest doc_id among those that it is linked to, directly or through others.

    Links are between sets alike to ``least`` (0.75 or more), all of them: no candidate is lost. Texts with equal sets are one set. Null
    doc_ids never name a class (null if there is no other). Runs jobs while the plan is built.
    """
    columns = "doc_id bigint, s bigint, n bigint, spots array<bigint>, marks binary"
    sets = stored(docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_sets, columns), "spots")
    points = stored(sets.groupBy("s").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("spots").alias("spots")), "points")
    # every pair in a cell is compared on the whole sets
    same = F.lit(bytearray(N.BANDS * N.ROWS))
    placed = stored(cells(points, least), "placed")
    edges, kept = N.links(sets.select("doc_id", "s", same.alias("sketch"), "marks"), points, limit, placed, least)
    roots = components(edges)
    forget(placed, *kept)
    labelled = points.join(roots.withColumnRenamed("node", "s"), "s", "left").select("s", "least", F.coalesce("root", "s").alias("component"))
    first = labelled.groupBy("component").agg(F.min("least").alias("class_id"))
    return sets.select("doc_id", "s", "n").join(labelled.join(first, "component").select("s", "class_id"), "s").select("doc_id", "n", "class_id")
