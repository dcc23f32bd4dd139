"""Orders, cliques, criteria and shifts against brute force and planted cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import arrays as A
from wavemill.operators import drift as D
from wavemill.operators import orders as O


def on_line(*at):
    x = np.array(at, float)
    return np.abs(x[:, None] - x)


def test_orders_follow_a_line():
    at = [5.0, 0.0, 9.0, 2.0, 7.5]
    gap = on_line(*at)
    want = list(np.argsort(at))
    for f in (O.linkage, O.fiedler, O.first_axis):
        assert f(gap) in (want, want[::-1])
    assert O.nearest(gap) == [0, 4, 2, 3, 1]
    for f in (O.nearest, O.linkage, O.fiedler, O.first_axis):
        assert f(np.zeros((1, 1))) == [0] and sorted(f(np.zeros((4, 4)))) == [0, 1, 2, 3]


def test_orders_of_frames(spark):
    assert O.ordered(spark.createDataFrame([], "a long, b long, gap double"), O.nearest).count() == 0
    many = spark.createDataFrame([(i, i + 1, 1.0) for i in range(4)], "a long, b long, gap double")
    with pytest.raises(ValueError):
        O.ordered(many, O.nearest, most=3)


def test_cliques(spark):
    rng = np.random.default_rng(3)
    pairs = [(a, b) for a, b in itertools.combinations(range(9), 2) if rng.random() < 0.6] + [(20, 21)]
    got = {r["cluster"]: r for r in O.cliques(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = set(pairs)
    kept = sorted(c for c, r in got.items() if r["kept"] and r["root"] == 0)
    assert all(p in near for p in itertools.combinations(kept, 2))
    best = max(n for n in range(2, 10) for s in itertools.combinations(range(9), n) if all(p in near for p in itertools.combinations(s, 2)))
    assert len(kept) == best
    assert got[20]["kept"] and got[21]["root"] == 20


def test_periodic_shift_is_numpys(spark):
    x = np.random.default_rng(1).normal(size=(3, 64))
    want = np.fft.irfft(np.fft.rfft(x) * np.exp(-2j * np.pi * np.arange(33) * 0.3 / 64), 64)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")
    got = np.array([r[0] for r in rows.orderBy("i").select(A.fourier_shifted(F.col("v"), 64, 0.3)).collect()])
    assert np.allclose(got, want, atol=1e-9)
    odd = spark.createDataFrame([([1.0, 2.0, 4.0, 0.0, 3.0],)], "v array<double>").select(A.fourier_shifted(F.col("v"), 5, 0.4)).first()[0]
    assert np.allclose(odd, np.fft.irfft(np.fft.rfft([1, 2, 4, 0, 3]) * np.exp(-2j * np.pi * np.arange(3) * 0.4 / 5), 5))


def test_tiers(spark):
    same = {"cosw": 0.99, "cosfp": 0.99, "xcorr": 0.995, "sdr": 1.1, "drift": 1.0, "rough": 0.2, "low": 0.95, "high": 1.0, "same": True, "iou": 0.9}
    cases = [(same, "AUTO_OVERSPLIT"), (same | {"iou": 0.05}, "AUTO_DRIFT"), (same | {"iou": 0.5}, "REVIEW_PARTIAL_OVERLAP"), (same | {"drift": 8.0}, "REVIEW_PARTIAL_OVERLAP")]
    cases += [(same | bad, "REVIEW") for bad in ({"cosw": 0.9}, {"cosfp": 0.9}, {"xcorr": 0.96}, {"sdr": 3.0}, {"drift": 41.0}, {"rough": 2.6}, {"low": -0.1}, {"high": 6.0}, {"same": False})]
    rows = spark.createDataFrame([tuple(c.values()) for c, _ in cases], ", ".join(f"{n} {'boolean' if n == 'same' else 'double'}" for n in same))
    assert [r[0] for r in rows.coalesce(1).select(D.merge_tier(D.Limits())).collect()] == [t for _, t in cases]


def test_planted_shift_of_profiles(spark):
    at = np.arange(8)
    profile = lambda y: [float(v) for v in np.exp(-((at - y) ** 2) / 4)]
    rows = [(1, w, profile(3.5 + s), 10) for w, s in enumerate((0.0, 0.5, -1.25))] + [(2, 1, profile(2), 5)]
    got = {(r["cluster"], r["win"]): r["shift"] for r in D.profile_drift(spark.createDataFrame(rows, "cluster long, win long, w array<double>, n long"), 20).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2)} and got[1, 0] == 0
    assert abs(abs(got[1, 1]) - 10) < 3 and abs(abs(got[1, 2]) - 25) < 3 and got[1, 1] * got[1, 2] < 0


def test_plane_is_least_squares(spark):
    rng = np.random.default_rng(2)
    u, v = rng.random(50), rng.random(50)
    y = 3 + 2 * u - 5 * v + rng.normal(size=50) / 10
    rows = spark.createDataFrame([(1, float(a), float(b), float(c)) for a, b, c in zip(u, v, y)] + [(2, 1.0, 1.0, 1.0)], "g int, u double, v double, y double")
    got = {r["g"]: r for r in D.plane(rows, ["g"], "y", "u", "v").collect()}
    want = np.linalg.lstsq(np.stack([np.ones(50), u, v], 1), y, rcond=None)[0]
    assert np.allclose([got[1][c] for c in ("c0", "c1", "c2")], want) and got[2]["c1"] is None


def test_ward_finds_planted_groups():
    gap = on_line(0, 0.5, 1, 20, 20.4, 50, 50.2, 51)
    name, score = O.ward(gap)
    assert name == [0, 0, 0, 3, 3, 5, 5, 5] and score > 0.9
    inner = [np.mean([gap[i, j] for j in range(8) if name[j] == name[i] and j != i]) for i in range(8)]
    outer = [min(np.mean([gap[i, j] for j in range(8) if name[j] == k]) for k in {0, 3, 5} - {name[i]}) for i in range(8)]
    assert abs(score - np.mean([(o - i) / max(i, o) for i, o in zip(inner, outer)])) < 1e-12
    assert O.ward(on_line(1, 2))[0] == [0, 1] and O.grouped(on_line(0, 9, 1, 10)) == [0, 2, 1, 3]


def test_varimax_undoes_a_turn():
    from wavemill.operators.models import varimax

    plain = np.zeros((2, 6))
    plain[0, :3], plain[1, 3:] = 3**-0.5, 3**-0.5
    c, s = np.cos(0.6), np.sin(0.6)
    got = varimax(np.array([[c, -s], [s, c]]) @ plain)
    assert np.allclose(np.abs(got @ got.T), np.eye(2)) and np.allclose(np.sort(np.abs(got @ plain.T).ravel()), [0, 0, 1, 1], atol=1e-6)


def test_smoothed_windows_solve_the_system(spark):
    rng = np.random.default_rng(8)
    x, n = rng.normal(size=(6, 3)), rng.integers(1, 9, (6, 3))
    rows = [(1, w, d, float(x[w, d]), int(n[w, d])) for w in range(6) for d in range(3)] + [(2, 4, 0, 7.0, 3)]
    got = {(r["cluster"], r["win"], r["d"]): r["x"] for r in D.smoothed_windows(spark.createDataFrame(rows, "cluster long, win long, d long, x double, n long"), 2.5).collect()}
    step = np.diff(np.eye(6), axis=0)
    for d in range(3):
        want = np.linalg.solve(np.diag(n[:, d]) + 2.5 * step.T @ step, n[:, d] * x[:, d])
        assert np.allclose([got[1, w, d] for w in range(6)], want)
    assert abs(got[2, 4, 0] - 7) < 1e-12 and len(got) == 19
