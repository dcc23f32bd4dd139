"""The variational mixture: its bound never falls, planted numbers of classes are found, special functions are right."""

import math

import numpy as np

from wavemill.operators import variational as V

FET = "spike_id long, cluster long, fet array<double>"


def test_digamma():
    for x in (0.01, 0.5, 1.0, 3.7, 40.0, 1e6):
        h = 1e-5 * max(1, x) if x > 0.1 else 1e-7
        assert abs(V.digamma(np.array([x]))[0] - (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)) < 1e-5 * max(1, 1 / x)
    assert abs(V.digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-12


def planted(rng, sizes, size=3):
    centres = rng.normal(0, 12, (len(sizes), size))
    return [rng.normal(c, rng.uniform(0.5, 1.5, size), (n, size)) for c, n in zip(centres, sizes, strict=True)]


def test_planted_number_is_found(spark):
    rng = np.random.default_rng(1)
    parts = planted(rng, [400, 250, 150, 60])
    rows = [(i, c, v.tolist()) for i, (c, v) in enumerate((c, v) for c, part in enumerate(parts) for v in part)]
    df = spark.createDataFrame([*rows, (9000, 0, None)], FET).repartition(3)
    p = V.fit(df, "fet", 3, V.Prior(classes=6))
    rises = np.diff(p.bound)
    assert len(p.bound) > 3 and (rises > -1e-6 * abs(p.bound[-1])).all()
    got = {r["spike_id"]: r for r in V.classified(df, "fet", 3, p).collect()}
    assert got[9000]["class"] is None
    live = {r["class"] for r in got.values()} - {None}
    assert live == {1, 2, 3, 4}
    for c, part in enumerate(parts):
        own = [got[i]["class"] for i, k, _ in rows if k == c]
        assert own.count(c + 1) == len(part)  # by falling weight, as they were planted
    assert all(0.4 < r["share"] <= 1 for r in got.values() if r["class"])


def test_one_class_and_none(spark):
    rng = np.random.default_rng(2)
    one = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (300, 2)))], FET)
    p = V.fit(one, "fet", 2, V.Prior(classes=5))
    assert len({r["class"] for r in V.classified(one, "fet", 2, p).collect()}) == 1
    assert V.fit(one.limit(0), "fet", 2) is None and V.classified(one.limit(3), "fet", 2, None).first()["class"] is None
    same = spark.createDataFrame([(i, 0, [1.0, 2.0]) for i in range(20)], FET)
    assert {r["class"] for r in V.classified(same, "fet", 2, V.fit(same, "fet", 2, V.Prior(classes=3))).collect()} == {1}


def test_bound_equals_its_definition():
    # ln p(x) of one class has a closed form, which the bound reaches when there is nothing to share out
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (40, 2))
    prior = V.Prior(classes=1)
    centre, scale = x.mean(0), np.diag(x.var(0))
    n, size = x.shape
    off = x - centre
    sums = np.concatenate([[n], off.sum(0), (off.T @ off).ravel()])[None]
    p = V.updated(sums, prior, centre, scale, [])
    bound = V.sums_of(x, p, centre)[1] - V._divergence(p, prior, centre, scale)
    v0, vn = size - 1 + prior.spread, size - 1 + prior.spread + n
    gammas = sum(math.lgamma((vn - i) / 2) - math.lgamma((v0 - i) / 2) for i in range(size))
    evidence = -n * size / 2 * math.log(math.pi) + gammas + v0 / 2 * np.linalg.slogdet(scale)[1] - vn / 2 * np.linalg.slogdet(p.scale[0])[1] + size / 2 * math.log(prior.mean / (prior.mean + n))
    assert abs(bound - evidence) < 1e-8 * abs(evidence)
