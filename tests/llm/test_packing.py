"""Operator 13 against the library's ids and a check of every sequence; the program against its bound."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from foliate.llm import packing as P

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


ODD = [
    "  a b", "a  b", "a \n b", "a\n\nb c\n", " ", "\n", "x <|endoftext|> y", "it's we'll 12 3.4, é b c  d", "\tq w\te", "日本 語 x", "x\x1c y",
    "a b", "a\x85 b \x85c", "Word. Next\nline, two\nthree.", "..., , .", "ﬀ ñ Ñandú", " x y",
]


def test_encoder(library):
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = P.Encoder(f.read())
    assert encoder.plain
    got = encoder.encode([t.encode() for t in [*ODD, ""]])
    assert [np.frombuffer(x, encoder.kind).tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in [*ODD, ""]]


def expected(library, rows, length=1024):
    out = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % length + 1
        for i, a in enumerate([0, *range(first, len(ids), length)]):
            part = ids[a : first if i == 0 else a + length]
            out.append((doc, i, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def test_query(spark, library, docs, rows):
    got = P.packed(docs, public.path("byte_bpe_50k.json"), ids="ids_crc32 bigint").collect()
    order = lambda r: (r[0], r[1], r[4])
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(expected(library, [(r[0], r[1]) for r in rows]), key=order)
    inside = defaultdict(list)
    for r in got:
        inside[r.sequence_id].append((r.offset, r.length))
    for held in inside.values():
        held.sort()
        assert [a for a, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 1024
    assert sorted(inside) == list(range(len(inside)))
    assert len(inside) == -(-sum(r.length for r in got) // 1024)


def test_sequences(spark, library):
    rows = [(1, "one two three"), (2, None), (None, "four"), (2, "five six " * 9)]
    out = P.sequences(spark.createDataFrame(rows, "doc_id bigint, text string"), public.path("byte_bpe_50k.json"), length=16).collect()
    for r in out:
        assert len(r.ids) == 4 * sum(r.lengths) <= 64
    whole = sorted(i for r in out for i in np.frombuffer(r.ids, "<u4").tolist())
    assert whole == sorted(i for _, t in rows for i in library.encode(t or "", add_special_tokens=False).ids + [2])


def test_empty(spark, nothing):
    assert P.packed(nothing, public.path("byte_bpe_50k.json")).count() == 0


def lengths(name):
    rng = np.random.default_rng(1)
    return {
        "even": rng.integers(1, 1024, 20000), "middle": rng.integers(300, 700, 20000), "large": rng.integers(400, 1024, 20000),
        "tiny": rng.integers(2, 20, 3000), "thirds": np.array([342] * 1000 + [341] * 100), "one": np.array([7]), "full": np.array([1024] * 9),
    }[name]


@pytest.mark.parametrize("name,above", [("even", 1.01), ("middle", 1.02), ("large", 1.04), ("tiny", 1.01), ("thirds", 1.005), ("one", 1), ("full", 1)])
def test_program(name, above):
    counts = np.bincount(lengths(name), minlength=1025)
    program = P.Program(counts)
    fractions = program.solve()
    cover = np.zeros(1025)
    for pattern, x in fractions.items():
        assert sum(pattern) <= 1024
        for l in pattern:
            cover[l] += x
    assert (cover >= counts * (1 - 1e-9)).all()
    patterns = program.rounded(fractions)
    held = np.zeros(1025, np.int64)
    for pattern, m in patterns:
        assert sum(pattern) <= 1024
        for l in pattern:
            held[l] += m
    assert (held == counts).all()
    used = sum(m for _, m in patterns)
    assert program.bound <= sum(fractions.values()) * (1 + 1e-9)
    assert np.ceil(program.bound - 1e-6) <= used <= np.ceil(program.bound * above)
    keys, first, offset = P.layout(patterns)
    assert (np.diff(keys) > 0).all() and (offset < 1024).all()
