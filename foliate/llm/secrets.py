"""Secret scan with fixed patterns and character Markov models, in DataFrame operations only.

*Base spans.* Leftmost matches of three patterns that do not overlap within a kind; matches that are too short are dropped.
Their places follow from the lengths of the matches and of the pieces between them.

*Model spans.* Runs of at least ``LEAST`` characters of keys and identifiers are scored by the log-likelihood ratio of two
first-order Markov models, random strings against ordinary identifiers. The models are trained from labelled samples: of
``SAMPLE`` different rows (those with the smallest hash of doc_id and text), the measured part of a base match is a random string, other runs are
ordinary. The model of random strings is smoothed towards even chances, so kinds of keys that the patterns do not know score as well.
A run above ``LIMIT`` that does not overlap a base span is added as kind *markov*.

Places count code points, the end is exclusive. Defined results: a null or empty text has no spans; without labelled
secrets the random model is even; rows that share a doc_id are rows like others; further columns are carried by ``scanned``; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import free_name

#: Kind, pattern, group that is measured, its least length; in the order in which kinds are listed.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: The same matches by patterns that fail early, where length alone decides.
_SCAN = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CHARACTER = "[A-Za-z0-9+/_=-]"
LEAST = 16
SAMPLE = 2_000
#: Pseudo counts of a row of each model: the random one spreads them evenly.
EVEN, RARE = 200.0, 0.5
#: A run is 1000 times as likely random as ordinary.
LIMIT = 6.907755278982137
_FOUND = "struct<start:int,kind:int,end:int,run:string>"
#: Items of an array that are gathered at once.
BLOCK = 256


def _let(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), f), 0)


def running(items: Column, zero: Column, step, out, kind: str) -> Column:
    """``out(state before, item)`` for each item of an array, where ``step`` makes the next state.

    An accumulator is copied at each step, so results are gathered in blocks and blocks once: linear up to millions of items.
    """

    def block(before, part):
        start = F.struct(before.alias("s"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(part, start, lambda a, x: F.struct(step(a["s"], x).alias("s"), F.concat(a["out"], F.array(out(a["s"], x))).alias("out")))

    def whole(all_items):
        cuts = F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / BLOCK).cast("int"))
        parts = F.transform(cuts, lambda b: F.slice(all_items, b * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(zero.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("done"))
        join = lambda acc, part: _let(
            block(acc["s"], part), lambda one: F.struct(one["s"].alias("s"), F.concat(acc["done"], F.array(one["out"])).alias("done"))
        )
        return F.when(F.size(all_items) > 0, F.flatten(F.aggregate(parts, start, join, lambda acc: acc["done"]))).otherwise(F.array().cast(f"array<{kind}>"))

    return _let(items, whole)


def _placed(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans of the matches of a pattern whose group is long enough, with what they match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    measured = F.regexp_extract_all(text, F.lit(pattern), group) if group else whole
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(
        F.zip_with(gaps, whole, lambda g, w: F.struct(F.char_length(g).alias("g"), F.char_length(w).alias("w"), w.alias("run"))),
        measured,
        lambda s, m: F.struct(s["g"].alias("g"), s["w"].alias("w"), s["run"].alias("run"), F.char_length(m).alias("m")),
    )
    # behind the last match is one more gap
    steps = F.filter(steps, lambda s: s["run"].isNotNull())

    def out(at, s):
        start = at + s["g"]
        fits = s["m"] >= least
        return F.struct(F.when(fits, start).alias("start"), F.lit(kind).alias("kind"), (start + s["w"]).alias("end"), s["run"].alias("run"))

    found = running(steps, F.lit(0), lambda at, s: at + s["g"] + s["w"], out, _FOUND)
    none = F.array().cast(f"array<{_FOUND}>")
    return F.when(text.rlike(pattern), F.filter(found, lambda s: s["start"].isNotNull())).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    found = [_placed(text, _SCAN.get(name, pattern), group, least, i) for i, (name, pattern, group, least) in enumerate(BASE)]
    return F.array_sort(F.transform(F.concat(*found), lambda s: F.struct(*[s[c].alias(c) for c in ("start", "kind", "end")])))


def _code(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


def long_enough(found: Column, least: int) -> Column:
    return F.filter(found, lambda x: F.char_length(x) >= least)


def transitions(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(secret, a, b, n): counts of neighbouring characters in the labelled runs of the sample."""
    # equal rows have one hash, and count once
    rest = docs.select(F.xxhash64("doc_id", "text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    last = rest.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]  # one number
    sample = rest.filter(F.col("h") <= (0 if last is None else last)).groupBy("h").agg(F.first("text").alias("text"))
    # Measured groups are random strings; what is left of a text without its matches is ordinary.
    secrets, rest = [], F.col("text")
    for name, pattern, group, least in BASE:
        found = F.regexp_extract_all("text", F.lit(_SCAN.get(name, pattern)), group)
        secrets.append(long_enough(found, least))
        rest = F.regexp_replace(rest, _SCAN.get(name, pattern), " ")
    ordinary = F.regexp_extract_all(rest, F.lit(CHARACTER + "{4,}"), 0)
    labelled = sample.select(F.explode(F.array(F.struct(F.lit(True).alias("secret"), F.concat(*secrets).alias("runs")), F.struct(F.lit(False).alias("secret"), ordinary.alias("runs")))).alias("l"))
    runs = labelled.select("l.secret", F.explode("l.runs").alias("run"))
    pairs = runs.select("secret", F.explode(_let(F.split("run", ""), lambda c: F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.concat(a, b)))).alias("ab"))
    pairs = pairs.filter(F.col("ab").rlike(f"^{CHARACTER}{{2}}$"))
    counts = pairs.groupBy("secret", "ab").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("secret", _code(F.substring("ab", 1, 1)).alias("a"), _code(F.substring("ab", 2, 1)).alias("b"), "n")


def ratios(docs: DataFrame, rows: int = SAMPLE) -> list[float]:
    """Log-likelihood ratios of each pair of characters of ``ALPHABET``, the first one's row after row."""
    size = len(ALPHABET)
    counts = {True: {}, False: {}}
    for r in transitions(docs, rows).collect():  # at most two rows for each pair of ALPHABET
        counts[r.secret][r.a - 1, r.b - 1] = r.n
    sums = {k: [sum(c.get((a, b), 0) for b in range(size)) for a in range(size)] for k, c in counts.items()}
    out = []
    for a in range(size):
        for b in range(size):
            random = (counts[True].get((a, b), 0) + EVEN / size) / (sums[True][a] + EVEN)
            ordinary = (counts[False].get((a, b), 0) + RARE) / (sums[False][a] + RARE * size)
            out.append(log(random / ordinary))
    return out


def score(run: Column, table: Column) -> Column:
    """Log-likelihood ratio of a run of characters of ``ALPHABET``."""
    size = len(ALPHABET)

    def add(acc, c):
        more = lambda code: F.struct(
            code.alias("before"),
            (acc["sum"] + F.when(acc["before"] > 0, F.get(table, (acc["before"] - 1) * size + code - 1)).otherwise(F.lit(0.0))).alias("sum"),
        )
        return _let(_code(c), more)

    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.split(run, ""), start, add, lambda acc: acc["sum"])


def _apart(base: Column, runs: Column) -> Column:
    """The runs that overlap no base span, by one sweep over both from either end."""
    added = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit(None).cast("string").alias("run")))
    is_base = lambda x: x["kind"] < len(BASE)
    far = F.lit(2**31 - 1)

    def sweep(all_spans):
        until = running(all_spans, F.lit(0), lambda m, x: F.when(is_base(x), F.greatest(m, x["end"])).otherwise(m), lambda m, x: m, "int")
        since = running(F.reverse(all_spans), far, lambda m, x: F.when(is_base(x), F.least(m, x["start"])).otherwise(m), lambda m, x: m, "int")
        limits = F.zip_with(until, F.reverse(since), lambda u, v: F.struct(u.alias("u"), v.alias("v")))
        both = F.zip_with(all_spans, limits, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        free = F.filter(both, lambda z: ~is_base(z["x"]) & (z["y"]["u"] <= z["x"]["start"]) & (z["y"]["v"] >= z["x"]["end"]))
        return F.transform(free, lambda z: z["x"])

    return F.when(F.size(base) == 0, runs).otherwise(_let(F.array_sort(F.concat(added, runs)), sweep))


def scanned(docs: DataFrame, model: list[float], text: str = "text", name: str = "spans") -> DataFrame:
    """The rows with all spans as an array of (start, kind, end), by start, then kind; kind 3 is the model's."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    base, runs = free_name(docs, "_base"), free_name(docs, "_runs")
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn(base, base_spans(whole)).withColumn(runs, _placed(whole, f"{CHARACTER}{{{LEAST},}}", 0, LEAST, 3))
    likely = F.filter(_apart(F.col(base), F.col(runs)), lambda r: score(r["run"], table) > LIMIT)
    likely = F.transform(likely, lambda r: F.struct(*[r[c].alias(c) for c in ("start", "kind", "end")]))
    found = F.when(F.size(runs) > 0, F.array_sort(F.concat(F.col(base), likely))).otherwise(F.col(base))
    return out.withColumn(name, found).drop(base, runs)


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in (*[b[0] for b in BASE], "markov")])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def reports(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Per document: number of base spans of each kind, a hash of them, and all spans."""
    found = scanned(docs.select("doc_id", "text"), ratios(docs, rows))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [F.size(of_kind(F.col("spans"), i)).cast("bigint").alias(f"n_{b[0]}") for i, b in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, model: list[float], mask: str = "***") -> DataFrame:
    """The documents with every span replaced by ``mask``, their columns unchanged otherwise."""
    name = free_name(docs, "_spans")
    out = scanned(docs, model, name=name)
    spans, text = F.col(name), F.coalesce(F.col("text"), F.lit(""))

    def cut(chars):
        piece = lambda start, end: F.array_join(F.slice(chars, start + 1, F.greatest(end - start, F.lit(0))), "")
        before = running(
            spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]),
            lambda at, s: F.when(s["start"] < at, F.lit("")).otherwise(F.concat(piece(at, s["start"]), F.lit(mask))), "string",
        )
        return F.concat(F.array_join(before, ""), piece(F.array_max(F.transform(spans, lambda s: s["end"])), F.size(chars)))

    cut = _let(F.split(text, ""), cut)
    return out.withColumn("text", F.when(F.size(name) > 0, cut).otherwise(F.col("text"))).drop(name)
