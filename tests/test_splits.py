"""Splits and fits of single spikes on planted cases and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from wavemill.operators import models as M
from wavemill.operators import splits as S


def test_basins_of_two_hills():
    y, x = np.mgrid[0:20, 0:30]
    hill = lambda v, u: np.exp(-((y - v) ** 2 + (x - u) ** 2) / 20)
    label = S.basins(hill(10, 7) + hill(10, 22) + 1e-9)
    assert label.max() == 2 and label[10, 7] == 1 and label[10, 22] == 2
    assert (label[:, :13] != 2).all() and (label[:, 17:] != 1).all()
    assert (S.basins(np.ones((8, 8))) == 0).all()


def test_watershed_separates_planted_groups(spark):
    rng = np.random.default_rng(4)
    at = np.vstack([rng.normal((0, 0), 1, (400, 2)), rng.normal((12, 9), 1, (300, 2)), [[60.0, 60.0]]])
    rows = [(i, 1, float(a), float(b)) for i, (a, b) in enumerate(at)]
    rows += [(1000, 1, None, 1.0), (1001, 1, float("nan"), 1.0), (1002, 1, float("inf"), 0.0), *[(2000 + i, 2, 3.0, 3.0) for i in range(30)]]
    got = {r["spike_id"]: r["part"] for r in S.watershed(spark.createDataFrame(rows, "spike_id long, cluster long, x double, y double"), size=128).collect()}
    assert len(got) == len(rows)
    first, second = [got[i] for i in range(400)], [got[i] for i in range(400, 700)]
    assert np.mean([p == 1 for p in first]) > 0.97 and np.mean([p == 2 for p in second]) > 0.97
    assert all(got[i] == 0 for i in (700, 1000, 1001, 1002, 2000, 2029))
    assert S.watershed(spark.createDataFrame([], "spike_id long, cluster long, x double, y double")).count() == 0


def test_two_gaussians(spark):
    rng = np.random.default_rng(5)
    two = np.concatenate([rng.normal(-5, 1, 600), rng.normal(4, 0.5, 300)])
    rows = [(1, float(v)) for v in two] + [(2, float(v)) for v in rng.normal(0, 1, 500)] + [(3, 1.0)] * 9 + [(4, None)]
    got = {r["cluster"]: r for r in S.two_gaussians(spark.createDataFrame(rows, "cluster long, x double")).collect()}
    assert set(got) == {1, 2, 3} and got[3]["n"] == 9 and got[3]["ashman"] is None
    one = got[1]
    assert abs(one["mean0"] + 5) < 0.2 and abs(one["mean1"] - 4) < 0.2 and abs(one["weight1"] - 1 / 3) < 0.02 and abs(one["std1"] - 0.5) < 0.1
    assert one["bic2"] < one["bic1"] and one["ashman"] > 5
    assert got[2]["bic2"] > got[2]["bic1"]


def test_places_of_point_sources(spark):
    sites = np.array([[20.0 * (c % 2), 20.0 * c] for c in range(8)])
    sources = [(10.0, 70.0, 30.0, 9000.0), (-5.0, 40.0, 20.0, 8000.0), (25.0, 100.0, 50.0, 20000.0)]
    swings = [[float(v) for v in a / np.sqrt(((sites - (x, y)) ** 2).sum(1) + z * z)] for x, y, z, a in sources]
    rows = list(enumerate(swings)) + [(3, [0.0] * 8), (4, None), (5, [1.0] * 7)]
    got = {r["i"]: r for r in S.localised(spark.createDataFrame(rows, "i int, v array<double>"), "v", sites).collect()}
    for i, (x, y, z, a) in enumerate(sources):
        p = got[i]["place"]
        assert abs(p["y"] - y) < 1 and abs(p["x"] - x) < 2 and abs(p["z"] - z) < 2 and abs(got[i]["amplitude"] / a - 1) < 0.05 and got[i]["rms"] < 1e-2
    assert all(got[i]["place"] is None and got[i]["rms"] is None for i in (3, 4, 5))


def test_two_units_in_one_waveform(spark):
    rng = np.random.default_rng(6)
    templates = {u: rng.normal(size=(12, 4)) * 100 for u in (2, 3, 5)}

    def moved(u, lag):
        out = np.zeros((12, 4))
        out[max(0, lag) : 12 + min(0, lag)] = templates[u][max(0, -lag) : 12 - max(0, lag)]
        return out

    waves = [1.2 * moved(3, -1), 0.9 * moved(2, 2) + 1.1 * moved(5, -2), np.zeros((12, 4))]
    rows = spark.createDataFrame([(i, [float(v) for v in w.ravel()]) for i, w in enumerate(waves)], "i int, v array<double>")
    got = {r["i"]: r for r in S.two_units(rows, "v", templates).collect()}
    a = got[0]["alone"]
    assert (a["unit"], a["lag"]) == (3, -1) and abs(a["gain"] - 1.2) < 1e-9 and a["left"] < 1e-9
    t = got[1]["together"]
    assert (t["unit_a"], t["lag_a"], t["unit_b"], t["lag_b"]) == (2, 2, 5, -2) and abs(t["gain_a"] - 0.9) < 1e-6 and abs(t["gain_b"] - 1.1) < 1e-6 and t["left"] < 1e-9
    assert got[1]["alone"]["left"] > 0.1 and got[2]["alone"] is None and got[2]["together"] is None
    single = S.two_units(rows, "v", {3: templates[3]}).filter("i = 0").first()
    assert single["alone"]["unit"] == 3 and single["together"] is None


def test_full_covariances_tell_crossed_groups_apart(spark):
    rng = np.random.default_rng(7)
    flat = rng.normal(size=(600, 2)) * (6, 0.3)
    steep = rng.normal(size=(600, 2)) * (0.3, 6) + (9, 9)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(np.vstack([flat, steep]))], "spike_id long, v array<double>")
    model = M.fit(rows, "v", 2, 2, full=True)
    own = np.array([r["class"] for r in M.assign(rows, "v", model).orderBy("spike_id").select("class").collect()])
    truth = np.repeat([0, 1], 600)
    assert max(np.mean(own == truth), np.mean(own != truth)) > 0.99
    slanted = rng.normal(size=(500, 2)) @ np.array([[3.0, 2.0], [0.0, 0.5]])
    one = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(slanted)], "spike_id long, v array<double>")
    assert np.allclose(M.fit(one, "v", 2, 1, full=True).var[0], np.cov(slanted.T), rtol=0.02)
