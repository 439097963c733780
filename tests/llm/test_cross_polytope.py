"""Cross-polytope links and components against all cosines."""

import math

import numpy as np
import pytest

from stringloom.llm import cross_polytope as cp

SCHEMA = "vec_id long, embedding array<float>, label int, node long"


def truth(rows):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, parent = {}, {}
    ids = [i for i, _ in good]
    for a, (i, x) in enumerate(good):
        links[i], parent[i] = 0, i
    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95:
                links[i] += 1
                links[j] += 1
                p, q = i, j
                while parent[p] != p:
                    p = parent[p]
                while parent[q] != q:
                    q = parent[q]
                parent[max(p, q)] = min(p, q)
    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    return {i: (links.get(i, 0), top(i) if i in parent else i) for i, _ in rows}


def test_links_and_components(spark):
    rng = np.random.default_rng(3)
    rows = []
    for base in rng.normal(size=(30, 64)):
        rows += [base + rng.normal(size=64) * s for s in rng.choice([0.0, 0.1, 0.2, 0.25], rng.integers(1, 12))]
    data = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    data += [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [1.0, None]), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] * 64), (908, [-0.0, 1.0]), (909, [0.0, 1.0])]
    want = truth(data)
    df = spark.createDataFrame([(*d, 0, 1) for d in data], SCHEMA).repartition(3)
    got = {r.vec_id: r for r in cp.op5(df).collect()}
    assert len(got) == len(data)
    total = sum(n for n, _ in want.values())
    assert sum(r.n_links for r in got.values()) >= 0.97 * total
    for i, (n, component) in want.items():
        assert got[i].n_links <= n
        assert got[i].kept == (got[i].component_id == i)
        if all(got[j].n_links == want[j][0] for j in want):
            assert got[i].component_id == component


def test_nothing_and_copies(spark):
    assert cp.op5(spark.createDataFrame([], SCHEMA)).count() == 0
    v = [1.0] + [0.5] * 63
    df = spark.createDataFrame([(i, v, 0, 0) for i in range(50)] + [(50, v, 0, 0), (50, v, 0, 0)], SCHEMA)
    got = cp.op5(df).collect()
    assert len(got) == 52 and {r.n_links for r in got} == {51} and {r.component_id for r in got} == {0}


def test_parts_of_large_buckets(spark):
    """Splitting buckets into parts changes nothing."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=64)
    data = [(i, [float(np.float32(x)) for x in base + rng.normal(size=64) * 0.2], 0, 0) for i in range(300)]
    df = spark.createDataFrame(data, SCHEMA)
    whole = {r.vec_id: (r.n_links, r.component_id) for r in cp.op5(df).collect()}
    before = cp.PART
    try:
        cp.PART = 40
        assert {r.vec_id: (r.n_links, r.component_id) for r in cp.op5(df).collect()} == whole
    finally:
        cp.PART = before
    want = truth([d[:2] for d in data])
    assert sum(n for n, _ in whole.values()) >= 0.9 * sum(n for n, _ in want.values())


def test_small_and_large_units_agree(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=64) + rng.normal(size=(90, 64)) * 0.2
    keys = cp.hasher(64).keys(x) ^ cp.mixed(np.full(1, 64, cp.U64))
    rows = {}
    for node in range(len(x)):
        for key, own in zip(keys[node].ravel().view(np.int64).tolist(), np.tile(np.arange(1 + cp.CORNERS) == 0, cp.TABLES).tolist(), strict=True):
            rows[key, node] = rows.get((key, node), False) or own
    table = cp.pa.table({
        "bucket": cp.pa.array([k for k, _ in rows], cp.pa.int64()),
        "node": cp.pa.array([n for _, n in rows], cp.pa.int64()),
        "own": list(rows.values()),
        **{c: cp.pa.array([0] * len(rows), cp.pa.int32()) for c in ("low_part", "high_part", "part")},
        "vector": [x[n].tolist() for _, n in rows],
        "copies": cp.pa.array([1 + n % 3 for _, n in rows], cp.pa.int64()),
    })
    results = []
    for small in (10**9, 1):
        monkeypatch.setattr(cp, "SMALL", small)
        results.append(cp._linked(table).sort_by("node").to_pydict())
    assert results[0] == results[1] and sum(results[0]["links"]) > 0


def test_hadamard_rotation_keeps_angles():
    hasher = cp.Hasher(50)
    x = np.random.default_rng(0).normal(size=(6, 50))
    y = hasher.rotated(x, 0)
    assert y @ y.T / 64**3 == pytest.approx(x @ x.T)


@pytest.mark.parametrize("length", [64, 256])
def test_pairs_at_the_threshold_meet(length):
    rng = np.random.default_rng(1)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    x, z = unit(rng.normal(size=(1500, length))), rng.normal(size=(1500, length))
    z = unit(z - (z * x).sum(axis=1)[:, None] * x)
    one, two = (cp.hasher(length).keys(v) for v in (x, cp.COSINE * x + math.sqrt(1 - cp.COSINE**2) * z))
    meet = (one[:, :, :1] == two).any(axis=2) | (two[:, :, :1] == one).any(axis=2)
    assert meet.any(axis=1).mean() >= 0.998


def test_very_small_and_large_magnitudes_and_long_vectors(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4, 1536))
    data = [(10 * i + j, (x[i] * scale).tolist()) for i in range(4) for j, scale in enumerate((1.0, 1e-170, 3e200, 5e-300))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in cp.op5(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert got == {10 * i + j: (3, 10 * i) for i in range(4) for j in range(4)}
