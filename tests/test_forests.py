"""Forests over other stretches, and what all channels share, against plain loops and planted signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import artefacts, forests

ROWS = "class long, t double, x array<double>"


def test_edges():
    assert forests.uniform(9.0, 3) == [3.0, 6.0] and forests.uniform(9.0, 1) == forests.uniform(0.0, 3) == []
    assert forests.split([3.0], 9.0, 1, 5.0) == [3.0, 5.0] and forests.split([3.0], 9.0, 1, 2.0) == [3.0] == forests.split([3.0], 9.0, 7, 5.0)
    assert forests.merge([3.0, 6.0], 0) == [6.0] and forests.merge([3.0], 1) == [3.0]
    assert forests.valid([3.0, 6.0], 9.0) and not forests.valid([6.0, 3.0], 9.0) and not forests.valid([], 0.0) and not forests.valid([9.0], 9.0)
    # ends written with six digits are those of the record
    assert forests.edges_of([(0.0, 1218.72), (1218.7242, 3656.17)], 3656.1728) == ([1218.72], 3656.1728)
    assert forests.edges_of([(0.0, 10000.0), (5000.0, 10000.0)], 9999.996) == ([5000.0], 9999.996)
    assert forests.edges_of([(0.0, 5.0), (5.0, 12.0)]) == ([5.0], 12.0) and forests.edges_of([]) == ([], 0.0)


def summary(rows):
    x = np.array([r[2] for r in rows])
    return (len(rows), x.mean(0), x.std(0)) if len(rows) else (0, None, None)


def same(node, want):
    n, mean, std = want
    assert node["n"] == n and ((node["mean"] is None) if mean is None else np.allclose(node["mean"], mean) and np.allclose(node["std"], std))


def test_forest_and_regrain(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(3)), float(t), [float(v) for v in rng.normal(0, 1, 2)]) for t in rng.uniform(0, 100, 300)] + [(7, 95.0, [1.0, 2.0]), (1, 100.0, [5.0, 5.0])]
    odd = [(None, 1.0, [0.0, 0.0]), (1, None, [0.0, 0.0]), (1, 1.0, None)]
    edges = forests.uniform(100.0, 4)
    forest = forests.grown(spark.createDataFrame(rows + odd, ROWS), edges, 100.0, 10.0)
    nodes = sorted(forest.collect(), key=lambda r: r["node"])
    assert [r["node"] for r in nodes] == list(range(len(nodes)))
    roots = [r for r in nodes if r["parent"] is None]
    assert len(roots) == 4 * 4
    for r in roots:
        same(r, summary([x for x in rows if x[0] == r["class"] and (r["a"] <= x[1] < r["b"] or (x[1] == r["b"] == 100.0))]))
    by = {r["node"]: r for r in nodes}
    for r in nodes:
        if r["parent"] is not None:
            root = by[r["parent"]]
            assert r["kind"] == "leaf" and root["class"] == r["class"]
            same(r, summary([x for x in rows if x[0] == r["class"] and r["a"] <= x[1] < r["b"] and root["a"] <= x[1] < root["b"] or (x[0] == r["class"] and x[1] == 100.0 and r["a"] == 100.0)]))
    # one stretch cut, two joined: what overlaps is added up exactly
    new = sorted(forests.regrained(forest, [10.0, 25.0, 75.0], 100.0).collect(), key=lambda r: r["node"])
    assert [r["node"] for r in new] == list(range(len(new))) and len(new) == len(nodes)
    old_of = {(0.0, 10.0): [0], (10.0, 25.0): [0], (25.0, 75.0): [1, 2], (75.0, 100.0): [3]}
    for r in new:
        if r["parent"] is None:
            olds = old_of[r["a"], r["b"]]
            same(r, summary([x for x in rows if x[0] == r["class"] and min(3, int(x[1] // 25)) in olds]))
    leaves, was = [r for r in new if r["parent"] is not None], [r for r in nodes if r["parent"] is not None]
    assert sorted((r["class"], r["a"], r["n"]) for r in leaves) == sorted((r["class"], r["a"], r["n"]) for r in was)
    place = {r["node"]: r for r in new}
    assert {place[r["parent"]]["a"] for r in leaves if r["a"] < 25 and r["b"] <= 25} == {10.0}  # of its halves the longer
    # back again, the joined stretches stay joined in both, and twice is as once
    twice = forests.regrained(forests.regrained(forest, [10.0, 25.0, 75.0], 100.0), [10.0, 25.0, 75.0], 100.0)
    keys = ("node", "class", "kind", "parent", "a", "b", "n")
    assert sorted(tuple(r[k] for k in keys) for r in twice.collect()) == sorted(tuple(r[k] for k in keys) for r in new)
    equal = sorted(forests.regrained(forest, edges, 100.0).collect(), key=lambda r: r["node"])
    assert all(tuple(a[k] for k in keys) == tuple(b[k] for k in keys) for a, b in zip(equal, nodes, strict=True))
    assert forests.regrained(forest.limit(0), edges, 100.0).count() == 0


def test_roots_of_which_only_a_number_is_known(spark):
    rows = [(0, 1, "drift-root", None, 0.0, 5.0, 7, None, None), (1, 1, "drift-root", None, 5.0, 10.0, 4, [2.0], [1.0]), (2, 1, "leaf", 0, 1.0, 2.0, 3, None, None), (3, 1, "leaf", 99, 1.0, 2.0, 3, None, None)]
    forest = spark.createDataFrame(rows, forests.NODES)
    both = {r["node"]: r for r in forests.regrained(forest, [], 10.0).collect()}
    assert both[0]["n"] == 4 and both[0]["mean"] == [2.0] and [both[i]["parent"] for i in (1, 2)] == [0, 0]
    apart = {r["node"]: r for r in forests.regrained(forest, [5.0], 10.0).collect()}
    assert apart[0]["n"] == 7 and apart[0]["mean"] is None and apart[1]["n"] == 4


def planted(rng, n=6000):
    """Four channels with sources of their own and a heavy-tailed one that all have about alike."""
    own = np.sign(rng.normal(size=(n, 4))) * rng.exponential(1, (n, 4)) * 6
    bursts = (np.sin(np.arange(n) / 150) > 0.97).astype(float)
    shared = rng.laplace(0, 1, n) * (1 + 40 * bursts)
    loading = np.array([5.0, 5.5, 4.5, 5.0])
    return own, shared, loading, own + shared[:, None] * loading + np.array([100, -50, 0, 20])


def test_shared_component(spark):
    rng = np.random.default_rng(2)
    own, shared, loading, x = planted(rng)
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "session long, sample long, xs array<double>").repartition(4)
    found = artefacts.common(df, 4)
    assert found.all == 4 and found.uniform > 0.95
    angle = found.loading @ loading / np.linalg.norm(found.loading) / np.linalg.norm(loading)
    assert abs(angle) > 0.995
    out = sorted(artefacts.removed(df, found).collect(), key=lambda r: r["sample"])
    got, level = np.array([r["xs"] for r in out]), np.array([r["artefact"] for r in out])
    assert abs(np.corrcoef(level, shared)[0, 1]) > 0.99
    loud = np.abs(shared) > 20
    assert np.abs(np.corrcoef(got[loud, 0], shared[loud])[0, 1]) < 0.3 < np.abs(np.corrcoef(x[loud, 0], shared[loud])[0, 1])
    # what is left and what was taken out are the record, and nothing else changes
    assert np.allclose(got + level[:, None] * found.loading, x)
    assert np.abs(got[~loud] - x[~loud]).mean() < 0.2 * np.abs(x - x.mean(0)).mean() * 4
    assert artefacts.common(df.limit(0), 4) is None
    flat = df.withColumn("xs", F.array(F.get("xs", 0), F.get("xs", 0), F.get("xs", 0), F.get("xs", 0)))
    assert artefacts.common(flat, 4) is None


def test_fixed_points_are_those_of_the_rows():
    # the iteration from fourth moments and the iteration over rows are the same
    rng = np.random.default_rng(3)
    z = rng.laplace(size=(4000, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.3], [0.2, 0, 1]])
    z -= z.mean(0)
    value, vector = np.linalg.eigh(z.T @ z / len(z))
    z = z @ (vector / np.sqrt(value))
    moments = np.einsum("ni,nj,nk,nl->ijkl", z, z, z, z) / len(z)
    for w in artefacts.fixed_points(moments, artefacts.Finding()):
        new = z.T @ (z @ w) ** 3 / len(z) - 3 * w
        new /= np.linalg.norm(new)
        assert abs(abs(new @ w) - 1) < 0.05 and abs(np.linalg.norm(w) - 1) < 1e-9
    first = artefacts.fixed_points(moments, artefacts.Finding())[0]
    new = z.T @ (z @ first) ** 3 / len(z) - 3 * first
    assert abs(abs(new @ first) / np.linalg.norm(new) - 1) < 1e-6


@pytest.mark.parametrize("block", [64, 65_536])
def test_bursts_equal_one_pass(spark, block):
    rng = np.random.default_rng(4)
    how = artefacts.Finding(threshold=2.0, envelope=6, reach=12, refractory=9)
    x = rng.laplace(0, 1, 900) * (1 + 10 * (np.sin(np.arange(900) / 20) > 0.9))
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "session long, sample long, artefact double")
    got = sorted((r["sample"], r["height"]) for r in artefacts.bursts(df, how, block).collect())
    half = how.envelope // 2
    height = [np.abs(x[max(0, i - half) : i + how.envelope - half]).mean() for i in range(len(x))]
    limit = how.threshold * 1.4826 * sorted(np.abs(x))[(len(x) - 1) // 2]
    want, i = [], 0
    while i < len(x):
        if height[i] >= limit - 1e-9:
            best = max(range(i, min(len(x), i + how.reach)), key=lambda j: (round(height[j], 9), -j))
            want.append(best)
            i = best + how.refractory
        else:
            i += 1
    assert [s for s, _ in got] == want and all(abs(h - height[s]) < 1e-9 for s, h in got)
