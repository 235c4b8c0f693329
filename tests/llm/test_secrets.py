"""Operator 9: model spans against brute force, sweeps over long arrays, and work in proportion to the text."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from foliate.llm import secrets as S


def brute(text, model):
    """All spans of a text: base matches, and runs that score above the limit and touch none of them."""
    base = []
    for kind, (_, pattern, group, least) in enumerate(S.BASE):
        base += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    out, size = list(base), len(S.ALPHABET)
    for m in re.finditer(f"{S.CHARACTER}{{{S.LEAST},}}", text):
        code = [S.ALPHABET.index(c) for c in m[0]]
        score = sum(model[a * size + b] for a, b in zip(code, code[1:]))
        if score > S.LIMIT and not any(a < m.end() and m.start() < b for a, _, b in base):
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    key = lambda n: "".join(rng.choice(S.ALPHABET[:62]) for _ in range(n))
    rows = [(i, f"the token = {key(30)} of another_name and somewhere else api_key: {key(20)}") for i in range(300)]
    return S.ratios(spark.createDataFrame(rows, "doc_id bigint, text string"))


def texts():
    rng = random.Random(2)
    key = lambda n: "".join(rng.choice(S.ALPHABET) for _ in range(n))
    parts = [
        lambda: key(rng.randrange(10, 60)), lambda: "identifier_of_something_else", lambda: "secret=" + key(9) + ".x", lambda: "éß 日本", lambda: "token:" + key(3),
        lambda: "AKIA" + "Z9" * 9, lambda: "0123456789abcdef" * 2, lambda: "thisisaverylongwordofletters", lambda: "api_key='" + key(20) + "'",
    ]
    out = [" ".join(rng.choice(parts)() for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    # more matches than one block of a sweep holds
    return out + [" ".join(rng.choice(parts)() for _ in range(900)), "", "x", key(4000), "a" * 40, "token=abcdefgh" * 300]


def test_brute(spark, model):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(7, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _base string, _runs int")
    for r in S.scanned(docs, model).collect():
        assert [tuple(s) for s in r.spans] == brute(r.text or "", model)
        assert (r._base, r._runs) == ("x", 1)


def test_some_are_found(spark, model):
    kinds = {k for t in texts() for _, k, _ in brute(t, model)}
    assert kinds == {0, 1, 2, 3}


def test_redacted(spark, model):
    rows = [(i, t) for i, t in enumerate(texts())] + [(99, None)]
    for r in S.redacted(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect():
        text, want, at = rows[r.doc_id][1] if r.doc_id != 99 else None, "", 0
        if text is None:
            assert r.text is None
            continue
        for start, _, end in brute(text, model):
            want += "" if start < at else text[at:start] + "***"
            at = max(at, end)
        assert r.text == want + text[at:]


def test_running(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        items = F.when(F.col("id") >= n, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.lit(n or 1)))
        got = spark.range(1).select(S.running(items, F.lit(0), lambda s, x: s + x, lambda s, x: s, "int").alias("r")).first().r if n else []
        assert got == [i * (i + 1) // 2 for i in range(n)]


def test_long_texts(spark, model):
    """Twice the text must not take four times as long."""
    rng = random.Random(4)
    run = "".join(rng.choice(S.ALPHABET[:62]) for _ in range(1_000_000))
    for make in (lambda n: run[:n], lambda n: "token=abcdefgh1 " * (n // 16), lambda n: (run[:40] + " ") * (n // 41)):
        took = []
        for n in (250_000, 1_000_000):
            docs = spark.createDataFrame([(1, make(n))], "doc_id bigint, text string")
            started = time.perf_counter()
            found = S.scanned(docs, model).select(F.size("spans").alias("n")).first().n
            took.append(time.perf_counter() - started)
            assert found > 0
        assert took[1] < 8 * took[0] + 2 and took[1] < 20, took
