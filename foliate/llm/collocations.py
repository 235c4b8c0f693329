"""Phrase collocations: bidirectional FM-indexes per shard over word ids, counts summed across shards.

*Shards.* Each task cuts its texts into shards of about ``SHARD`` bytes of one language; no text is shuffled. A shard is
a sequence of word ids, with 0 between pieces, and its words with their counts.

*Index.* The Burrows-Wheeler transforms of the sequence and of its reverse, each with the sorted places of every symbol as
rank structure. A phrase is a pair of intervals; extending it by a word on either side narrows one interval by two rank queries and
the other by the count of smaller symbols. Suffixes are sorted by their first ``k`` words only, which is all that phrases of
up to ``k`` words can tell apart.

*Levels.* For k = 2, 3, ... every shard enumerates its phrases of k words and sends (hash, count); a phrase goes by two independent
hashes, 96 bits. Those whose counts sum to ``least`` over all shards go back to the shards that hold them; one of these
names the phrase, and all keep only the stretches in which every k words are frequent. The next level works on what is left. So rows
fall from level to level, a phrase sends one row per shard and not per occurrence, and nothing is broadcast or collected.

Defined results: null or empty texts have no words; a null language is ``und``; repeated rows count each time; ties in a
ranking are settled by count and phrase, so ranks are unique; columns other than text and lang are ignored; an empty table gives an
empty result. A stretch without any separator is not cut, so a task's memory grows with the longest one.

``phrases`` runs one job per level while the plan is built, and keeps its tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.llm import arrays as A
from foliate.llm.common import shared_dir

#: Bytes of text in a shard, about.
SHARD = 4 << 20
DEPTH, LEAST, SHARE, TOP = 5, 100, 100, 2000
#: Candidates that one task ranks before the last ranking.
RANKED = 1 << 18
OWNER = "collocations"

#: Separators of pieces to a line feed, tabs to spaces, A-Z to a-z.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)

SHARDS = "shard bigint, lang string, ids binary, words array<string>, counts array<bigint>"
MARKED = "kind int, shard bigint, lang string, ids binary, words array<string>, phrase string, n bigint"


class Index:
    """A bidirectional index over word ids (0 separates) for phrases of up to ``depth`` words."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.n = len(ids)
        self.symbols = int(ids.max(initial=0)) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=self.symbols))))
        self.ids, self.depth = ids, depth
        self.sides: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _side(self, ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The transform, and (symbol, place) of each of its entries in ascending order."""
        n = self.n
        rank, size, order = ids.astype(np.int64), 1, None
        while size < depth or order is None:
            step = min(size, depth - size)
            key = rank
            if step:
                key = rank * (int(rank.max(initial=0)) + 1)
                key[: max(n - step, 0)] += rank[step:]
            # the order among equal ones does not matter: they stay in one interval
            order = np.argsort(key)
            size += step
            if size < depth:
                rank = np.empty(n, np.int64)
                rank[order] = np.cumsum(np.concatenate(([0], key[order[1:]] != key[order[:-1]])))
            elif not step:
                break
        before = ids[order - 1].astype(np.int64)
        return before, np.sort(before * n + np.arange(n))

    def side(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        """The index for extensions to the left (0) or right (1), made when it is first asked for."""
        if side not in self.sides:
            self.sides[side] = self._side(self.ids[::-1] if side else self.ids, self.depth)
        return self.sides[side]

    def _extend(self, side: int, at: list[np.ndarray], size: np.ndarray, last: bool):
        """All extensions on one side: their parents, words, intervals (if there is a next step) and sizes."""
        transform, places = self.side(side)
        parent = np.repeat(np.arange(len(size)), size)
        key = parent * self.symbols + transform[A.ranges(at[side], size)]
        key, count = np.unique(key, return_counts=True)
        parent, word = key // self.symbols, key % self.symbols
        smaller = np.cumsum(count) - count
        # counted from the begin of the parent's own interval
        smaller -= (np.cumsum(size) - size)[parent]
        keep = word > 0
        parent, word, count, smaller = parent[keep], word[keep], count[keep], smaller[keep]
        new = [None, None]
        if last:
            return parent, word, new, count
        # the places behind the smaller symbols, in the order of the places, are where this symbol's block begins
        new[side] = np.searchsorted(places, word * self.n + at[side][parent])
        new[1 - side] = at[1 - side][parent] + smaller
        return parent, word, new, count

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """All phrases of ``k`` words, as rows of ids, and how often each occurs; extended right and left in turn."""
        word = np.flatnonzero(np.diff(self.first[1:])) + 1
        at, size = [self.first[word], self.first[word]], self.first[word + 1] - self.first[word]
        found = word[:, None]
        for length in range(2, k + 1):
            side = length % 2 ^ 1
            parent, word, at, size = self._extend(side, at, size, length == k)
            held = found[parent]
            found = np.column_stack([held, word] if side else [word, held])
        return found, size


def _words(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Ids from 1 (0: separator) and the words they stand for."""
    tokens = lists.filter(pc.not_equal(lists, "")).dictionary_encode()
    ids, names = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64), tokens.dictionary
    gap = pc.index(names, "\n").as_py()
    if gap < 0:
        return ids + 1, names
    keep = np.arange(len(names)) != gap
    code = np.zeros(len(names), np.int64)
    code[keep] = np.arange(1, len(names))
    return code[ids], names.filter(pa.array(keep))


def _shard(shard: int, lang: str, text: bytes) -> pa.RecordBatch:
    column = pa.array([text.replace(b"\n", b" \n ")], pa.large_binary()).cast(pa.large_string())
    ids, names = _words(pc.split_pattern(column, " ").flatten())
    # the last separator also keeps the end of the sequence from its begin
    ids = np.append(ids, 0)
    counts = np.bincount(ids, minlength=len(names) + 1)[1:]
    values = [[shard], [lang], [ids.astype("<u4").tobytes()], [names.cast(pa.string()).to_pylist()], [counts.tolist()]]
    types = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], [c.split()[0] for c in SHARDS.split(", ")])


def shards(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SHARD) -> DataFrame:
    """One row per shard: ids of its words in order, the words, and how often each occurs."""

    def run(batches):
        task, made, held, total = TaskContext.get().partitionId(), 0, {}, 0

        def cut(name, last):
            """Shards of what is held of a language; pieces stay whole."""
            nonlocal made
            data, at = b"\n".join(held.pop(name)), 0
            while at < len(data):
                stop = data.find(b"\n", at + size) if at + size < len(data) else -1
                stop = len(data) if stop < 0 else stop
                part = data[at:stop]
                if not last and stop == len(data) and len(part) < size // 2:
                    held[name] = [part]
                    break
                at = stop + 1
                if part.strip(b" \n"):
                    yield _shard(task << 32 | made, name, part)
                    made += 1

        for batch in batches:
            for part in A.slices(batch, "text", owner=OWNER):
                for name, value in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    value = (value or b"").translate(TABLE)
                    total += len(value)
                    held.setdefault(name, []).append(value)
                # so many bytes are held at most, whatever the number of languages
                if total >= 2 * size:
                    for name in sorted(held):
                        yield from cut(name, False)
                    total = sum(len(x) for v in held.values() for x in v)
                    if total >= size:
                        for name in sorted(held):
                            yield from cut(name, True)
                        total = 0
        for name in sorted(held):
            yield from cut(name, True)

    named = F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang")
    return docs.select(named, F.col(text).cast("string").alias("text")).mapInArrow(run, SHARDS)


def _hashes(lang: str, names: pa.Array, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes, of 64 and of 32 bits, of each phrase and its language, the same in every shard."""
    data, offsets = A.buffer_of(names)
    own = np.frombuffer(lang.encode(), np.uint8)
    out = []
    for mask in (0x00, 0xA5):
        word = A.range_hashes(data ^ np.uint8(mask), offsets[:-1], offsets[1:])
        h = np.full(len(found), A.range_hashes(own ^ np.uint8(mask), np.array([0]), np.array([len(own)]))[0], A.U)
        for k in range(found.shape[1]):
            h = A.mix(h * A.STEP + word[found[:, k] - 1])
        out.append(h)
    return out[0].view(np.int64), (out[1] >> A.U(32)).astype(np.uint32).view(np.int32)


class Shard:
    """A stored shard, one at a time and as Arrow holds it."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        at = lambda name: batch.column(batch.schema.get_field_index(name))[i]
        self.shard, self.lang = at("shard").as_py(), at("lang").as_py()
        self.ids = np.frombuffer(at("ids").as_buffer(), "<u4")
        self.words = at("words").values.cast(pa.large_string())

    def phrases(self, k: int):
        """Phrases of ``k`` words: ids, counts, hashes."""
        found, count = Index(self.ids, k).phrases(k)
        return found, count, *_hashes(self.lang, self.words, found)


def _shards(batches) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Shard(batch, i)
            # what one shard took is free for the next, and for the worker beside this one
            pa.default_memory_pool().release_unused()


def enumerated(table: DataFrame, k: int) -> DataFrame:
    """(shard, h, g, n): phrases of ``k`` words in each shard by their hashes, with their counts."""

    def run(batches):
        A.MEMORIES.clear()
        for one in _shards(batches):
            _, count, h, g = one.phrases(k)
            columns = [pa.array(np.full(len(h), one.shard)), pa.array(h), pa.array(g), pa.array(count)]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "h", "g", "n"])

    return table.select("shard", "lang", "ids", "words").mapInArrow(run, "shard bigint, h bigint, g int, n bigint")


def _places(h: np.ndarray, g: np.ndarray, marks: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """Where each phrase stands among the marks (-1: nowhere), and the marks in order."""
    marks = marks.sort_by([("h", "ascending"), ("g", "ascending")])
    mh, mg = marks.column("h").to_numpy(), marks.column("g").to_numpy()
    at = np.full(len(h), -1)
    first, last = np.searchsorted(mh, h), np.searchsorted(mh, h, side="right")
    for step in range(int((last - first).max(initial=0))):
        here = np.flatnonzero(first + step < last)
        here = here[mg[first[here] + step] == g[here]]
        at[here] = first[here] + step
    return at, marks


def _stretches(ids: np.ndarray, alive: np.ndarray, k: int) -> np.ndarray:
    """The sequence cut down to runs of consecutive begins of phrases that are alive; a run stays whole, apart from others."""
    edge = np.diff(np.concatenate(([0], alive.astype(np.int8), [0])))
    start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    # a run of one holds no longer phrase
    start, end = start[end - start > 1], end[end - start > 1]
    size = end - start + k
    out = ids[np.minimum(A.ranges(start, size), len(ids) - 1)]
    out[np.cumsum(size) - 1] = 0
    return out


_KINDS = pa.schema(
    [
        ("kind", pa.int32()), ("shard", pa.int64()), ("lang", pa.string()), ("ids", pa.binary()),
        ("words", pa.list_(pa.string())), ("phrase", pa.string()), ("n", pa.int64()),
    ]
)


def _resolved(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        A.MEMORIES.clear()
        out = []
        for one in _shards(left.to_batches()):
            found, _, h, g = one.phrases(k)
            at, marks = _places(h, g, right)
            found, at = found[at >= 0], at[at >= 0]
            total, own = marks.column("total").to_numpy()[at], marks.column("own").to_numpy()[at]
            rest = _left(one.ids, found, k)
            if len(rest):
                used = np.unique(rest[rest > 0])
                code = np.zeros(len(one.words) + 1, np.uint32)
                code[used] = np.arange(1, len(used) + 1)
                words = pa.ListArray.from_arrays([0, len(used)], one.words.take(pa.array(used.astype(np.int64) - 1)).cast(pa.string()))
                ids = pa.array([code[rest].astype("<u4").tobytes()], pa.binary())
                out.append(_rows(one, kind=0, ids=ids, words=words, n=pa.array([0], pa.int64())))
            named = found[own]
            if len(named):
                text = [one.words.take(pa.array(named[:, j] - 1)) for j in range(k)]
                phrase = pc.binary_join_element_wise(*text, pa.scalar(" ", pa.large_string())).cast(pa.string())
                out.append(_rows(one, kind=1, phrase=phrase, n=pa.array(total[own])))
        return pa.concat_tables(out) if out else _KINDS.empty_table()

    return run


def _rows(one: Shard, kind: int, **columns) -> pa.Table:
    n = len(columns["n"])
    given = {"kind": pa.array(np.full(n, kind, np.int32)), "shard": pa.array(np.full(n, one.shard)), "lang": pa.array([one.lang] * n, pa.string())} | columns
    return pa.table([given.get(f.name, pa.nulls(n, f.type)) for f in _KINDS], schema=_KINDS)


def _left(ids: np.ndarray, found: np.ndarray, k: int) -> np.ndarray:
    """What a next level needs of the sequence, given the phrases that are alive."""
    n = len(ids) - k + 1
    if n < 1 or not len(found):
        return ids[:0]
    # one integer for each phrase: first words are ranked among those of alive phrases, and so on
    mark = np.zeros(len(found), np.int64)
    here, alive = np.zeros(n, np.int64), np.ones(n, bool)
    base = int(ids.max()) + 1
    for j in range(k):
        known, mark = np.unique(mark * base + found[:, j], return_inverse=True)
        key = here * base + ids[j : j + n]
        here = np.minimum(np.searchsorted(known, key), len(known) - 1)
        alive &= known[here] == key
    return _stretches(ids, alive, k)


def phrases(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, text: str = "text", lang: str = "lang", size: int = SHARD):
    """(lang, n) of all words, and (lang, phrase, size, f) of all phrases of up to ``depth`` words that occur at least ``least`` times."""
    spark = docs.sparkSession

    def kept(df: DataFrame, *kinds: str) -> str:
        path = shared_dir(spark, "collocations")
        df.write.option("compression", "zstd").partitionBy(*kinds).parquet(path)
        return path

    table = spark.read.schema(SHARDS).parquet(kept(shards(docs, text, lang, size)))
    single = table.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("phrase"), F.col("w.counts").alias("n"))
    totals = table.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    exact = []
    for k in range(2, depth + 1):
        same = W.partitionBy("h", "g")
        # the first shard that holds a phrase names it
        summed = enumerated(table, k).select("shard", "h", "g", F.sum("n").over(same).alias("total"), (F.min("shard").over(same) == F.col("shard")).alias("own"))
        marks = summed.filter(F.col("total") >= least)
        levels = table.select("shard", "lang", "ids", "words").groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(_resolved(k), MARKED)
        found = spark.read.schema(MARKED).parquet(kept(levels, "kind"))
        table = found.filter("kind = 0").select("shard", "lang", "ids", "words")
        exact.append(found.filter("kind = 1").select("lang", "phrase", F.col("n").alias("f")))
    out = single.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least).withColumn("size", F.lit(1))
    for k, df in enumerate(exact, 2):
        out = out.unionByName(df.withColumn("size", F.lit(k)))
    path = shared_dir(spark, "collocations")
    out.write.parquet(path)
    return totals, spark.read.schema(out.schema).parquet(path)


def _part(words: str, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame, least: int = LEAST, depth: int = DEPTH, share: int = SHARE, top: int = TOP, text: str = "text", lang: str = "lang", size: int = SHARD
) -> DataFrame:
    """The best ``top`` phrases of each language by how much oftener they occur than their least telling cut makes expect.

    A phrase goes where a longer one holds it and occurs ``share`` percent as often. ``left_words`` and ``right_words``
    count the words by which a phrase can be extended and still occur ``least`` times.
    """
    totals, table = phrases(docs, least, depth, text, lang, size)
    whole = table.filter("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("words"))
    inside = whole.filter("size > 2").select(
        "lang", "a", F.explode(F.expr("""flatten(transform(sequence(2, size - 1), m ->
            transform(sequence(1, size - m + 1), i -> array_join(slice(words, i, m), ' '))))""")).alias("phrase"),
    )
    longest = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    around = [
        whole.filter("size > 2").select("lang", _part("words", begin, F.col("size") - 1).alias("phrase")).groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias(name))
        for begin, name in ((2, "left_words"), (1, "right_words"))
    ]
    parts = table.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    cuts = (
        whole.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
        .select("lang", "phrase", "a", "size", "k", _part("words", F.lit(1), F.col("k")).alias("head"), _part("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
        .join(parts.select("lang", F.col("part").alias("head"), F.col("part_f").alias("l")), ["lang", "head"])
        .join(parts.select("lang", F.col("part").alias("rest"), F.col("part_f").alias("r")), ["lang", "rest"])
        .join(totals, "lang")
        .withColumn("score", F.expr("cast(a as decimal(19)) * cast(n as decimal(19)) * 1000 div (cast(l as decimal(19)) * cast(r as decimal(19)))"))
    )
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("s")).select("lang", "phrase", "s.*")
    left = scored.join(longest, ["lang", "phrase"], "left").filter(F.expr(f"_longer is null or 100 * _longer < {int(share)} * a"))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # best of each part of a language first, so that no task ranks a whole language
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = left.withColumn("_salt", salt).withColumn("_at", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_at") <= top)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    for side in around:
        ranked = ranked.join(side, ["lang", "phrase"], "left")
    extra = [F.coalesce(name, F.lit(0)).alias(name) for name in ("left_words", "right_words")]
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", *extra)
