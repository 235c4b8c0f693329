"""Operator 6's join against brute force over all pairs."""

import random

import numpy as np
import pytest

from foliate.llm import spot_signatures as S


def corpus(seed):
    rng = random.Random(seed)
    content = ["".join(rng.choice("bcdfgklmnprst") for _ in range(5)) for _ in range(400)]
    anchors = ["the", "of", "and", "der", "la"]
    prose = lambda n: " ".join(f"{rng.choice(anchors)} {rng.choice(content)} {rng.choice(content)}" for _ in range(n)).split()
    template = prose(60)
    texts = []
    for _ in range(40):
        base = prose(rng.randrange(1, 80))
        texts.append(base)
        for changed in range(rng.randrange(4)):
            own = base[:]
            for at in rng.sample(range(len(own)), min(len(own), changed * 2)):
                own[at] = rng.choice(content)
            texts.append(own + prose(changed % 2))
    texts += [template + prose(30) for _ in range(30)]
    texts = [" ".join(t) for t in texts]
    return texts + [texts[3], texts[3], "", None, "plain words only", "plain words only", "...", "x"]


def brute(texts, ids, least):
    marks, limits = S.signatures([t or "" for t in texts])
    sets = [marks[a:b] for a, b in zip(limits[:-1], limits[1:])]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(sets)):
        for j in range(i):
            if S.likeness(sets[i], sets[j]) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), []).append(i)
    first = {g: min((ids[i] for i in m if ids[i] is not None), default=None) for g, m in groups.items()}
    return sorted(((ids[i] is None, ids[i] or 0, len(sets[i]), first[find(i)]) for i in range(len(sets))), key=repr)


@pytest.mark.parametrize("seed,least,limit", [(1, 0.8, 8 << 20), (2, 0.8, 3000), (3, 0.9, 1500)])
def test_join(spark, seed, least, limit):
    texts = corpus(seed)
    ids = [i * 2 for i in range(len(texts) - 1)] + [None]
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in zip(ids, texts)], "doc_id bigint, text string, s string, n int").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n, r.class_id) for r in S.near_duplicates(docs, least, limit).collect()), key=repr)
    assert got == brute(texts, ids, least)
    assert len({g[3] for g in got}) < len(got) - 8


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_lengths_meet():
    for least in (0.75, 0.8, 0.95):
        bounds = np.array(S._bounds(3000, least))
        level = np.searchsorted(bounds, np.arange(3001), side="right")
        for n in range(1, 3000):
            assert level[min(3000, int(n / least + 1e-9))] - level[n] <= 1
