"""Language identification by fusing evidence.

Each text has a likelihood under every language: byte trigrams of its letters, counted in a bounded sample of labelled
rows (of each label the ``SAMPLE`` rows with the smallest hash of doc_id and text, so that a rare language has a model too), and under *und*, a model in which all trigrams are alike.
To it come, as further likelihoods or priors,

* the declared language of the markup (or of the row): how often a text of a language bears a declaration,
* the suffix of the address, and the host: how often a host holds each language, smoothed towards its suffix, which is
  smoothed towards all addresses.

These tables are grouped aggregations over all rows, of each row's most likely language by text alone. A row's
language is the one with the largest posterior; rows whose language is *und* are rejected.

Defined results: a null or empty text, or one without letters, is *und* and rejected; null declarations and addresses
give no evidence of their own (a null host is a host like others); rows without any label in the whole table leave *und* as
the only class, and then nothing is rejected but texts without letters; further columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliate.llm import arrays as A
from foliate.llm.common import free_name, stored

#: Labelled rows that the text model of a language is counted from, at most.
SAMPLE = 4_000
#: Trigram classes, and the count that each starts from.
CLASSES, START = 1 << 16, 0.5
#: Overlapping trigrams share bytes: each counts by a third.
WEIGHT = 1 / 3
#: Rows that a smoothed distribution gives to the one above it.
STRENGTH = 20.0
NONE = "und"

_LETTER = A.LOWER.copy()
_LETTER[:0x80] = np.where(((A.LOWER >= 0x61) & (A.LOWER <= 0x7A))[:0x80], A.LOWER[:0x80], 0x20)


def trigrams(column) -> tuple[np.ndarray, np.ndarray]:
    """Trigram classes of all texts behind one another, blanks around each text included, and the texts' limits."""
    data, offsets = A.buffer_of(column)
    n = len(offsets) - 1
    # One blank before each text and one at the end of all.
    padded = np.full(len(data) + n + 1, 0x20, np.uint32)
    padded[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = _LETTER[data]
    blank = padded == 0x20
    code = ((padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    # The middle byte is a letter: runs of blanks and marks count for nothing.
    at = np.flatnonzero(~blank[1:-1]) if len(padded) > 2 else np.zeros(0, np.int64)
    return code[at], np.searchsorted(at + 1, offsets + np.arange(n + 1))


def sample(docs: DataFrame, label: str = "lang", rows: int = SAMPLE) -> DataFrame:
    """Of each label the different rows with the smallest hashes of doc_id and text, ``rows`` at most and one at least."""
    name, mark, n, least, rank = (free_name(docs, x) for x in ("_label", "_mark", "_n", "_least", "_rank"))
    labelled = docs.filter(F.col(label).isNotNull()).withColumn(mark, F.xxhash64("doc_id", "text"))
    sizes = labelled.groupBy(F.col(label).alias(name)).agg(F.count(F.lit(1)).alias(n), F.min(mark).alias(least))
    # Rows by a share of the hashes that is a little large, then the smallest of them.
    place = F.col(mark).cast("double") / 2.0**64 + 0.5
    near = (place * F.col(n) <= rows + 6 * rows**0.5) | (F.col(mark) == F.col(least))
    some = labelled.join(F.broadcast(sizes), F.col(label) == F.col(name)).filter(near)  # one row per language
    # equal rows share a hash and count once, so that no group of copies fills a window
    some = some.dropDuplicates([name, mark])
    order = Window.partitionBy(name).orderBy(mark)
    return some.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= rows).select(*[F.col(f"`{c}`") for c in docs.columns])


def trained(docs: DataFrame, label: str = "lang", rows: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages (with *und* last) and their log likelihoods of each trigram class."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in A.slices(batch, "text"):
                codes, limits = trigrams(part.column(0))
                names = part.column(1).to_pylist()
                for name in {*names}:
                    mine = np.array([x == name for x in names])
                    own = codes[np.repeat(mine, np.diff(limits))]
                    totals[name] = totals.get(name, 0) + np.bincount(own, minlength=CLASSES)
        for name, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "code", "n"])

    counted = sample(docs, label, rows).select("text", F.col(label).cast("string")).mapInArrow(count, "lang string, code bigint, n bigint")
    # Summed before they leave the executors: at most CLASSES rows for each language.
    found = counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(found.column("lang").to_pylist(), object)
    codes, n = found.column("code").to_numpy(), found.column("n").to_numpy()
    totals = {x: np.bincount(codes[langs == x], n[langs == x], CLASSES) for x in {*langs}}
    names = sorted(totals)
    model = [np.log((totals[x] + START) / (totals[x].sum() + START * CLASSES)) for x in names]
    return [*names, NONE], np.array([*model, np.full(CLASSES, -np.log(CLASSES))], np.float32)


def scored(rows: DataFrame, model: tuple[list[str], np.ndarray], name: str, text: str = "text") -> DataFrame:
    """The rows with their log likelihood under each language as an array; null if there is no letter."""
    shared = rows.sparkSession.sparkContext.broadcast(model[1])

    def run(batches):
        table = shared.value
        for batch in batches:
            for part in A.slices(batch, text):
                codes, limits = trigrams(part.column(part.schema.get_field_index(text)))
                size = np.diff(limits)
                sums = np.zeros((len(size), len(table)))
                some = size > 0
                if some.any():
                    begin = limits[:-1][some]
                    for k, own in enumerate(table):
                        sums[some, k] = np.add.reduceat(own[codes], begin, dtype=np.float64) * WEIGHT
                values = pa.array(sums.reshape(-1))
                column = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * len(table)), values, mask=pa.array(~some))
                yield A.with_columns(part, **{name: column})

    schema = T.StructType([*rows.schema, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


def _place(scores: Column) -> Column:
    """Index of the largest score, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


class Evidence:
    """Smoothed tables over all rows: log priors by host, log likelihoods by declaration."""

    def __init__(self, seen: DataFrame, n: int):
        """``seen``: host, suffix, declared, k (most likely class by text), one row per text with letters."""
        counts = stored(seen.groupBy("host", "suffix", "declared", "k").agg(F.count(F.lit(1)).alias("n")), "evidence")
        everything = np.zeros(n)
        for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect():  # one row per class
            everything[r.k] = r.n
        overall = [float(x) for x in (everything + 1) / (everything.sum() + n)]

        def table(keys, above):
            """Distribution over classes of each key, smoothed by the column ``above``."""
            own = [F.sum(F.when(F.col("k") == i, F.col("n")).otherwise(0)) for i in range(n)]
            sums = counts.groupBy(*keys).agg(F.array(*own).alias("own"), F.sum("n").alias("all"))
            return sums, lambda c: F.zip_with("own", c, lambda x, p: (x + STRENGTH * p) / (F.col("all") + STRENGTH))

        base = F.array(*[F.lit(x) for x in overall])
        suffixes, smooth = table(["suffix"], base)
        suffixes = suffixes.select(F.col("suffix").alias("_lid_suffix"), smooth(base).alias("above"))
        hosts, smooth = table(["host", "suffix"], None)
        hosts = hosts.join(suffixes, F.col("suffix").eqNullSafe(F.col("_lid_suffix")))
        logs = F.transform(smooth(F.col("above")), lambda x: F.log(x))
        self.hosts = stored(hosts.select(F.col("host").alias("_lid_host"), F.col("suffix").alias("_lid_suffix"), logs.alias("_lid_prior")), "hosts")
        # P(declaration | language), smoothed by the share of the declaration among all.
        sums, _ = table(["declared"], None)
        sums = sums.filter("declared is not null")
        given = float(counts.filter("declared is not null").agg(F.sum("n")).first()[0] or 0)
        totals = F.array(*[F.lit(float(x)) for x in everything])
        share = F.col("all") / F.lit(max(given, 1.0))
        like = F.zip_with("own", totals, lambda x, t: F.log((x + STRENGTH * share) / (t + STRENGTH)))
        self.declared = stored(sums.select(F.col("declared").alias("_lid_declared"), like.alias("_lid_like")), "declared")

    def fused(self, rows: DataFrame, scores: str, host: Column, suffix: Column, declared: Column, out: str) -> DataFrame:
        """The rows with the log posterior (up to a constant) of each class; null without letters."""
        name = {c: free_name(rows, f"_lid_{c}") for c in ("h", "s", "d", "host", "suffix", "prior", "declared", "like")}
        col = {c: F.col(n) for c, n in name.items()}
        hosts, given = ([F.col(f"_lid_{c}").alias(name[c]) for c in own] for own in (("host", "suffix", "prior"), ("declared", "like")))
        mine = rows.withColumns({name["h"]: host, name["s"]: suffix, name["d"]: declared})
        mine = mine.join(self.hosts.select(*hosts), col["h"].eqNullSafe(col["host"]) & col["s"].eqNullSafe(col["suffix"]), "left")
        mine = mine.join(self.declared.select(*given), col["d"] == col["declared"], "left")
        total = F.col(scores)
        for other in (col["prior"], col["like"]):
            total = F.when(other.isNull(), total).otherwise(F.zip_with(total, other, lambda a, b: a + b))
        return mine.withColumn(out, total).drop(*name.values())


def identified(
    rows: DataFrame, model: tuple[list[str], np.ndarray], host: Column, suffix: Column, declared: Column, text: str = "text"
) -> tuple[DataFrame, dict[str, str]]:
    """The rows with language, posterior, language by text alone, and kept; and the names of these columns."""
    names = {k: free_name(rows, k) for k in ("language", "posterior", "text_language", "kept", "_scores", "_fused")}
    languages = F.array(*[F.lit(x) for x in model[0]])
    with_scores = scored(rows, model, names["_scores"], text)
    scores = F.col(names["_scores"])
    seen = with_scores.filter(scores.isNotNull()).select(host.alias("host"), suffix.alias("suffix"), declared.alias("declared"), _place(scores).alias("k"))
    out = Evidence(seen, len(model[0])).fused(with_scores, names["_scores"], host, suffix, declared, names["_fused"])
    fused = F.col(names["_fused"])
    best = F.array_max(fused)
    weight = F.aggregate(fused, F.lit(0.0), lambda a, x: a + F.exp(x - best))
    language = F.when(fused.isNull(), F.lit(NONE)).otherwise(F.get(languages, _place(fused)))
    only = len(model[0]) == 1
    out = out.withColumns(
        {
            names["language"]: language,
            names["posterior"]: F.when(fused.isNull(), F.lit(1.0)).otherwise(1 / weight),
            names["text_language"]: F.when(scores.isNull(), F.lit(NONE)).otherwise(F.get(languages, _place(scores))),
        }
    )
    kept = F.col(names["language"]) != NONE if not only else fused.isNotNull()
    return out.withColumn(names["kept"], kept).drop(names["_scores"], names["_fused"]), names


def document_languages(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Documents: the column lang is the declaration and the label, the source is the host."""
    model = trained(docs)
    return identified(docs, model, F.col("source").cast("string"), F.lit(None).cast("string"), F.col("lang").cast("string"))


def page_languages(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Pages: declaration from the markup's lang attribute, suffix and host from the address, text without tags."""
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]{2,3})", 1))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    bare = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)[^>]*>.*?</\1>|<[^>]*>", " ")
    rows = pages.select(
        "page_id",
        bare.alias("text"),
        F.when(declared != "", declared).alias("declared"),
        F.when(host != "", host).alias("host"),
        F.when(host != "", F.substring_index(host, ".", -1)).alias("suffix"),
    )
    out, names = identified(rows, model, F.col("host"), F.col("suffix"), F.col("declared"))
    return out.select("page_id", *[names[k] for k in ("language", "posterior", "text_language", "kept")])


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is known, with their own columns."""
    out, names = document_languages(docs)
    return out.filter(F.col(names["kept"])).select(*[F.col(f"`{c}`") for c in docs.columns])
