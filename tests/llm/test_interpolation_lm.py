"""Deleted interpolation against plain counting."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stringloom.llm import interpolation_lm as lm

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens_of(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def fold(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 10


def plain(docs, weights):
    words, pairs = Counter(), Counter()
    for i, t in docs:
        if fold(i) not in (None, 0):
            w = tokens_of(t)
            words.update(w)
            pairs.update(zip(["<begin>", *w], w, strict=False))
    total, distinct = sum(words.values()), len(words)
    for i, t in docs:
        w = tokens_of(t)
        base = sum(math.log10((words[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        score = 0.0
        for u, v in zip(["<begin>", *w], w, strict=False):
            c = words[None] if u == "<begin>" else words[u]
            a = weights[min(c.bit_length(), lm.BUCKETS - 1)]
            score += math.log10(a[0] * (pairs[u, v] / c if c else 0) + a[1] * words[v] / max(total, 1) + a[2] / (distinct + 1))
        yield i, fold(i) == 0, len(w), sum(words[x] > 0 for x in w), total, base, score


def compare(spark, docs):
    df = spark.createDataFrame([(*d, 0.0, "x") for d in docs], "doc_id long, text string, score double, block string").repartition(3)
    model = lm.Model(df)
    assert model.weights.sum(axis=1) == pytest.approx(np.ones(lm.BUCKETS)) and model.weights[0, 0] == 0 and (model.weights[:, 1:] > 0).all()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got, want = sorted(map(tuple, model.scored().collect()), key=key), sorted(plain(docs, model.weights), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.array([r[5:] for r in got]).ravel() == pytest.approx(np.array([r[5:] for r in want]).ravel(), rel=1e-9)


def test_sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    compare(spark, [tuple(r) for r in rows])


def test_edges(spark):
    compare(spark, [(1, None), (2, ""), (3, "A a\tB\n"), (3, "A a\tB\n"), (None, "a new word"), (4, "x " * 3000), (20, "é É a b"), *[(i, "a b c a b") for i in range(30, 70)]])
    compare(spark, [(None, "a")])
    assert lm.op4(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_better_than_base_on_held_out_texts(spark):
    got = lm.op4(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_weights_raise_the_likelihood():
    histogram = [(3, 50.0, 0.0, 2.0), (3, 20.0, 900.0, 30.0), (3, 5.0, 0.0, 0.0)]
    value = lambda w: sum(n * math.log(w[0] * b + w[1] * u + w[2]) for _, n, b, u in histogram)
    weights = lm.learned(histogram)[3]
    rng = np.random.default_rng(1)
    assert all(value(weights) >= value(w) - 0.5 for w in rng.dirichlet(np.ones(3), 200))
