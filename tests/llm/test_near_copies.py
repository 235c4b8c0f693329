"""The pipeline's near-duplicate stage against exact five-word Jaccard."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from foliate.llm import near_copies as N
from tests.llm.conftest import COLUMNS


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def least_of_each(pairs):
    """Smallest id of each component of links at 0.8."""
    sets = [(i, shingle_set(t)) for i, t in sorted(pairs, key=lambda p: p[0])]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i][1], sets[j][1]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted({sets[find(i)][0] for i in range(len(sets))})


def test_near_copies_at_eight_tenths_go(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for _ in range(30):
        base = [word() for _ in range(300)]
        texts.append(" ".join(base))
        for changed in (3, 5, 6, 12):
            own = base[:]
            for at in rng.sample(range(10, 290), changed):
                own[at] = word()
            texts.append(" ".join(own))
    # One passage repeated over and over does not make two texts alike.
    loud = " ".join(word() for _ in range(6)) + " "
    texts += [loud * 200 + " ".join(word() for _ in range(150)) for _ in range(3)]
    rows = [(i, t, "en", "s", len(t), 0, "", "", 0, "") for i, t in enumerate(texts)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, COLUMNS).repartition(3), "")
    want = least_of_each(list(enumerate(texts)))
    assert 33 < len(want) < 100
    assert sorted(r.doc_id for r in out.collect()) == want


def test_odd_rows(spark, docs, rows, nothing):
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == least_of_each([(r[0], r[1]) for r in rows])
    assert corpus_pipeline.near_duplicates(spark, nothing, "").count() == 0


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in out.collect()) == least_of_each([(r.doc_id, r.text) for r in docs.collect()])


def template_texts(n, shared=120, own=110):
    """Texts of one template: half of the shingles of any two are the same, far below 0.8; every tenth has a near copy."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = " ".join(word() for _ in range(shared))
    texts = [f"{base} {' '.join(word() for _ in range(own))}" for _ in range(n)]
    return texts + [t + " " + word() for t in texts[::10]]


def test_large_cells_are_split(spark, monkeypatch):
    texts = template_texts(400)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    sets = docs.mapInArrow(N._sets, "doc_id bigint, s bigint, n bigint, bands array<bigint>, sketch binary, marks binary").cache()
    points = sets.groupBy("s").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    largest = lambda limit: N._dealt(points, limit)[0].groupBy("cell").count().agg(F.max("count")).first()[0]
    whole, split = largest(1 << 30), largest(20_000)
    assert whole > 100 and split < 25, (whole, split)
    edges = {frozenset((r.a, r.b)) for r in N.links(sets, points, 20_000)[0].collect()}
    name = {r.doc_id: r.s for r in sets.collect()}
    assert edges == {frozenset((name[10 * i], name[400 + i])) for i in range(40)}


def test_recall_at_eight_tenths():
    """Pairs of a likeness from 0.8 to 0.82 share a fingerprint, and a second one, as often as computed."""
    rng = np.random.default_rng(3)
    pairs, both, twice = 0, 0, 0
    for _ in range(1000):
        n = int(rng.integers(100, 400))
        size = int(np.ceil(0.8 * n))
        union = np.unique(rng.integers(0, 2**32, n + 20, dtype=np.uint64).astype(np.uint32))[:n]
        half = size + (n - size) // 2
        order = rng.permutation(n)
        a, b = np.sort(union[order[:half]]), np.sort(union[np.concatenate((order[:size], order[half:]))])
        marks, limits = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
        bands = N.bands_of(N.min_hashes(marks, limits))
        shared = int((bands[0] == bands[1]).sum())
        pairs, both, twice = pairs + 1, both + (shared > 0), twice + (shared > 1)
    assert both / pairs >= 0.998 and twice / pairs >= 0.99, (both / pairs, twice / pairs)


def alike(rng, pairs, low, high):
    """Marks and limits of sets, two by two of a likeness from 0.8 to 0.82."""
    parts = []
    for _ in range(pairs):
        n = int(rng.integers(low, high))
        size = int(np.ceil(0.8 * n))
        union = rng.permutation(np.unique(rng.integers(0, 2**32, n + 20, dtype=np.uint64).astype(np.uint32)))[:n]
        half = size + int(rng.integers(0, n - size + 1))
        parts += [np.sort(union[:half]), np.sort(np.concatenate((union[:size], union[half:])))]
    return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def test_fingerprints_are_majorities():
    """Bits by brute force, for sets of no, few and more than 255 shingles."""
    rng = np.random.default_rng(4)
    size = [1, 0, 4, 255, 256, 1000, 0]
    marks = rng.integers(0, 2**32, sum(size), dtype=np.uint64).astype(np.uint32)
    limits = np.concatenate(([0], np.cumsum(size)))
    out = N.fingerprints(marks, limits)
    for i, n in enumerate(size):
        for w in range(N.WORDS):
            own = N.A.mix(marks[limits[i] : limits[i + 1]].astype(np.uint64) * N.A.STEP + N._SEEDS[w]).tolist()
            assert int(out[i, w]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > n)


def test_grids_hold_near_copies():
    """Pairs of a likeness from 0.8 to 0.82 meet in a cell and are within the bounds; unrelated sets are not."""
    rng = np.random.default_rng(3)
    for points, low, high, least in ((250_000, 100, 400, 0.999), (15_000_000, 100, 400, 0.995), (250_000, 10, 40, 0.999)):
        prints = N.fingerprints(*alike(rng, 2000, low, high))
        segments, grids = N.grid_of(points)
        tallies = [N.S.embedding(prints[:, w]) for w in range(N.WORDS)]
        met = np.zeros(2000, bool)
        for i, masks in enumerate(N.masks_of(grids, segments, 0)):
            cells = N.cells_of(np.zeros(4000, np.uint64), tallies, i, masks)
            met |= cells[::2] == cells[1::2]
        found = [len(N.print_forest(np.arange(2), prints[i : i + 2])[0]) == 1 for i in range(0, 4000, 2)]
        assert (met & found).mean() >= least, (points, low, (met & found).mean())
        assert not len(N.print_forest(np.arange(2000), prints[::2])[0])


def test_stage_goes_through_fingerprints(spark, monkeypatch):
    """What the grid of fingerprints does not hand on is linked by nothing else."""
    docs = spark.createDataFrame([*enumerate(template_texts(20))], "doc_id bigint, text string")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 20
    monkeypatch.setattr(N, "candidates", lambda points, **_: (spark.createDataFrame([], "a bigint, b bigint"), []))
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 22


def test_hot_cells_and_large_components(spark):
    """Cells above the bound are dealt again, components above theirs by min-hashes; both keep the links."""
    texts = template_texts(200)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    columns = f"doc_id bigint, s bigint, n bigint, {', '.join(f'{p} bigint' for p in N.PRINTS)}, marks binary"
    sets = docs.mapInArrow(N._printed, columns).cache()
    points = sets.groupBy("s").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", *N.PRINTS)])
    name = {r.doc_id: r.s for r in sets.collect()}
    want = {frozenset((name[10 * i], name[200 + i])) for i in range(20)}
    near = N.candidates(points, cell=30)[0].cache()
    assert want <= {frozenset((r.a, r.b)) for r in near.collect()}
    for limit in (1, N.TASK_BYTES):
        assert {frozenset((r.a, r.b)) for r in N.exact(sets, points, near, limit)[0].collect()} == want
