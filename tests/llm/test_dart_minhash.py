"""DartMinHash and near-duplicate groups against exact Jaccard similarities."""

import random
import re

import numpy as np
import pytest

from stringloom.llm import dart_minhash as dm
from stringloom.llm.textkit import U64

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(docs):
    """Component of each row: least (id, text) reachable."""
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[top(i)] = min(least.get(top(i), d), d)
    return [least[top(i)] for i in range(len(docs))]


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    docs = []
    for _ in range(12):
        base = say(rng.choice((3, 30, 120, 300)))
        docs.append(list(base))
        for _ in range(rng.randrange(9)):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = "new"
            docs.append(copy)
    docs += [say(100) for _ in range(10)]
    rng.shuffle(docs)
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


@pytest.mark.parametrize("seed", range(2))
def test_groups(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, node int").repartition(3)
    got = {r.doc_id: r for r in dm.op3(df).collect()}
    assert len(got) == len(docs)
    for (d, _), component in zip(docs, groups(docs), strict=True):
        assert (got[d].component_id, got[d].kept) == (component, component == d)


def test_edges(spark):
    line = "a b c d e f g h"
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one two"), (6, "two one"), (7, line), (7, line), (8, line + "  "), (None, "x y z"), (9, "w " * 40000), (10, None), (7, "other text")]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, bucket string")
    rows = dm.op3(df).collect()
    assert len(rows) == len(docs)
    found = sorted(((-1 if r.doc_id is None else r.doc_id), -1 if r.component_id is None else r.component_id) for r in rows)
    assert found == [(-1, -1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (7, 7), (7, 7), (8, 7), (9, 9), (10, 10)]
    kept = dm.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 7, 7, 7, 9, 10]
    assert dm.op3(df.limit(0)).count() == 0


def test_weighted_signatures_estimate_jaccard():
    rng = np.random.default_rng(5)
    elements = rng.integers(0, 1 << 62, 300).astype(U64)
    one, two = rng.integers(1, 9, 300) / 2, rng.integers(1, 9, 300) / 2
    two[:150] = one[:150]
    true = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    s = dm.signatures(np.concatenate([elements, elements]), np.array([0, 300, 600]), np.concatenate([one, two]), 4096)
    assert (s[0] == s[1]).mean() == pytest.approx(true, abs=0.03)


def test_signatures_do_not_depend_on_company():
    rng = np.random.default_rng(6)
    elements = rng.integers(0, 1 << 62, 500).astype(U64)
    whole = dm.signatures(elements, np.array([0, 1, 1, 50, 500]))
    assert (dm.signatures(elements[1:50], np.array([0, 49]))[0] == whole[2]).all()
    assert (whole[0] != 0).all() and (whole[1] == 0).all()


@pytest.mark.parametrize("leaders", (1, 5_000))
def test_large_families_are_compared_by_leaders(spark, monkeypatch, leaders):
    monkeypatch.setattr(dm, "FAMILY", 3)
    monkeypatch.setattr(dm, "SHARD_SHINGLES", 400)
    monkeypatch.setattr(dm, "LEAD_SHINGLES", leaders)
    rng = random.Random(11)
    docs = corpus(4)
    base = [f"v{rng.randrange(300)}" for _ in range(150)]
    for i in range(12):
        # a chain: neighbours are near, the ends are not
        docs.append((1000 + i, " ".join([*(f"n{x}" for x in range(4 * i)), *base[4 * i :]])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in dm.op3(df).collect()}
    assert [got[d] for d, _ in docs] == groups(docs)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 300), (401, 400)]
    got = {r.node: r.component for r in dm.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == len({got[100 + i] for i in range(40)}) == 1
    assert set(got) == {*range(61), *range(100, 140), 400, 401} and len({got[0], got[100], got[400]}) == 3
