"""Common phrases between different neighbours do not fill one bucket."""

import random

import numpy as np
import pyarrow as pa
import pytest

from foliate.llm import arrays as A
from foliate.llm import repeats as R
from foliate.llm import substring_dedup, suffix_dedup
from tests.llm.test_operators import expected_removal

MOST = 300


def corpus():
    """600 texts with one phrase whose inner hash is small, so that it is the key of all windows around it."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    phrases = [" ".join(word() for _ in range(5)) for _ in range(5000)]
    units = R.Words(*A.buffer_of(pa.array(phrases)))
    phrase = phrases[int(np.argmin(A.gram_hashes(units.values, 5)[::5]))]
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [f"{prose(12)} {phrase} {prose(12)}" for _ in range(600)]
    around = texts[3].split()
    return texts + [" ".join(around[4:22]), " ".join(around[:20]), f"{prose(2)} {' '.join(around[8:26])}"]


@pytest.mark.parametrize(
    "units, window, inner, module",
    [(R.Words, 13, 5, substring_dedup), (R.Bytes, 50, 24, suffix_dedup)],
)
def test_a_hot_key_is_split(spark, units, window, inner, module):
    texts = corpus()
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    inside = module.judge_with(window)

    def judge(text, first, *rest):
        if len(first) > MOST:
            raise ValueError(f"{len(first)} contents in a bucket")
        return inside(text, first, *rest)

    most = {} if not hasattr(R, "SPLIT") else {"split": 50}
    got = R.smallest_seen(docs, units, window, inner, judge, module._digest, module.SCHEMA, group_bytes=1000, **most)
    of = (lambda t: t.encode()) if units is R.Bytes else (lambda t: t.encode().split())
    want = expected_removal(of, [*enumerate(texts)], window, bytes if units is R.Bytes else b" ".join)
    assert sum(w[2] for w in want) > 30
    assert sorted((r[0], r[1], r[2], r[-1]) for r in got.collect()) == [(d, n, k, h) for d, n, k, _, h in want]
