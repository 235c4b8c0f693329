"""Operator 11 against brute force: counts, scores, dropped phrases, ranks; the index by itself."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from foliate.llm import collocations as C


def brute(rows, least, depth=5, share=100, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, depth + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    frequent = {k: v for k, v in f.items() if v >= least}
    longer = Counter()
    for (lang, p), v in frequent.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    longer[lang, p[i:j]] = max(longer[lang, p[i:j]], v)
    out = {}
    for (lang, p), a in frequent.items():
        if len(p) > 1 and not ((lang, p) in longer and 100 * longer[lang, p] >= share * a):
            cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-cut[0], -a, " ".join(p).encode(), f[lang, p[: cut[1]]], f[lang, p[cut[1] :]]))
    return sorted(
        (lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words = ["a", "b", "É", "é", "of", "The", "the", "x y", "z" * 30]
    rows = []
    for i in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ! "]) for _ in range(rng.randrange(60)))
        rows.append((text + (" fixed phrase of five words" * (i % 3 == 0)), rng.choice(["en", "en", "en", "de", None])))
    return rows + [(None, "en"), ("", "en"), (" \n.", None), ("the of " * 3000, "en"), ("the the the the the", "de")] + rows[:20]


@pytest.mark.parametrize("size", [1 << 10, 1 << 23])
@pytest.mark.parametrize("least,share,top", [(5, 100, 2000), (20, 60, 7)])
def test_brute(spark, prose, size, least, share, top):
    docs = spark.createDataFrame([(t, g, "x", 1, "y") for t, g in prose], "text string, lang string, shard string, n int, phrase string").repartition(3)
    got = C.collocations(docs, least=least, share=share, top=top, size=size)
    assert sorted(tuple(r)[:8] for r in got.collect()) == brute(prose, least, share=share, top=top)


def test_extensions(spark):
    docs = spark.createDataFrame([("a b c. a b d. x a b",)] * 10, "text string").selectExpr("text", "'en' as lang")
    row = C.collocations(docs, least=10).filter("phrase = 'a b'").first()
    assert (row.a, row.left_words, row.right_words) == (30, 1, 2)


def test_empty(spark):
    for text in (None, "", "..."):
        docs = spark.createDataFrame([(text, None)] * 2, "text string, lang string")
        assert C.collocations(docs, least=1).count() == 0
    assert C.collocations(docs.limit(0)).count() == 0


def test_index():
    rng = np.random.default_rng(2)
    for n, symbols in ((1, 1), (2, 3), (40, 3), (500, 4), (500, 60)):
        ids = np.append(rng.integers(0, symbols, n), 0)
        for k in range(1, 6):
            found, count = C.Index(ids, k).phrases(k)
            expected = Counter(tuple(ids[i : i + k].tolist()) for i in range(len(ids) - k + 1) if (ids[i : i + k] > 0).all())
            assert dict(zip(map(tuple, found.tolist()), count.tolist())) == expected
