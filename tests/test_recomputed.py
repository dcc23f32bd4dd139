"""Queries without SQL, computed again from the table itself with NumPy."""

from collections import defaultdict

import numpy as np
import pytest

from wavemill.operators import cem, cores, dips, filters, models, splits
from wavemill.plans import catalogue, sorting
from wavemill.sources import adapters


def got(spark, small, name):
    return catalogue.QUERIES[name](spark, small).toPandas()


@pytest.fixture(scope="module")
def records(spark, small):
    """(session, channel) -> values in order."""
    out = defaultdict(dict)
    for r in adapters.traces(spark, small).collect():
        for c, x in enumerate(r["xs"]):
            out[r["session"], c][r["sample"]] = float(x)
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


@pytest.fixture(scope="module")
def vectors(spark, small):
    """ids, clusters and features, by id."""
    rows = sorted(adapters.features(spark, small).collect(), key=lambda r: r["spike_id"])
    return np.array([r["spike_id"] for r in rows]), np.array([r["cluster"] for r in rows]), np.array([r["fet"] for r in rows], float)


def recursion(sections, x):
    """Sample by sample, each section begun in the steady state of the first value."""
    for b0, b1, b2, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        y, x1, x2, y1, y2 = [], x[0], x[0], gain * x[0], gain * x[0]
        for v in x:
            y.append(b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2)
            x1, x2, y1, y2 = v, x1, y[-1], y1
        x = y
    return x


@pytest.mark.parametrize(("name", "parts"), [("butterworth_highpass", [(3, 0.05, "high")]), ("butterworth_bandpass", [(3, 0.02, "high"), (3, 0.3, "low")])])
def test_butterworth(spark, small, records, name, parts):
    sections = [s for p in parts for s in filters.butterworth(*p)]
    rows = got(spark, small, name)
    assert len(rows) == sum(map(len, records.values()))
    for key in list(records)[::7]:
        x = records[key]
        n = min(len(x) - 1, 6 * (2 * len(sections) + 1))
        wide = [*(2 * x[0] - x[n:0:-1]), *x, *(2 * x[-1] - x[-2 : -n - 2 : -1])]
        y = recursion(sections, recursion(sections, wide)[::-1])[::-1][n : n + len(x)]
        own = rows[(rows["session"] == key[0]) & (rows["ch"] == key[1])].sort_values("sample")
        assert np.allclose(own["y"], y, atol=2e-4)


def test_sections_of_long_records():
    x = np.random.default_rng(1).normal(0, 1, 1500).cumsum() + 300
    for sections in (filters.butterworth(5, 0.03, "high"), filters.butterworth(4, 0.4, "low")):
        for n in (1, 255, 256, 257, 1500):
            assert np.allclose(filters._run(sections, x[:n]), recursion(sections, x[:n]), atol=1e-8)


def test_resampled(spark, small, records):
    rows = got(spark, small, "resampled")
    key = next(iter(records))
    x, lobes = records[key], 16
    own = rows[(rows["session"] == key[0]) & (rows["ch"] == key[1])].sort_values("sample")
    assert own["sample"].tolist() == list(range((len(x) - 1) * 3 // 2 + 1))
    for to, y in zip(own["sample"].to_numpy()[::11], own["y"].to_numpy()[::11], strict=True):
        place = to * 2 / 3
        k = np.arange(int(place) - lobes + 1, int(place) + lobes + 1)
        h = np.sinc(place - k) * np.where(np.abs(place - k) < lobes, 0.5 + 0.5 * np.cos(np.pi * (place - k) / lobes), 0)
        assert abs(y - (h * x[np.clip(k, 0, len(x) - 1)]).sum() / h.sum()) < 2e-4


def test_supersampled(spark, small, records):
    rows = got(spark, small, "supersampled")
    assert len(rows)
    for _, r in rows.iloc[::97].iterrows():
        x = records[r["session"], r["ch"]]
        w = x[max(0, r["sample"] - 4) : r["sample"] + 8]
        n = len(w)
        assert list(r["waveform"]) == w.tolist()
        # the natural spline as one linear system in values and second derivatives
        m = np.eye(n)
        right = np.zeros(n)
        for i in range(1, n - 1):
            m[i, i - 1 : i + 2] = 1, 4, 1
            right[i] = 6 * (w[i + 1] - 2 * w[i] + w[i - 1])
        second = np.linalg.solve(m, right)
        for j, y in enumerate(r["fine"]):
            k = min(j // 4, n - 2)
            u = j / 4 - k
            want = (1 - u) * w[k] + u * w[k + 1] + (((1 - u) ** 3 - (1 - u)) * second[k] + (u**3 - u) * second[k + 1]) / 6
            assert abs(y - want) < 2e-4


def test_between_samples(spark, small, records):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 5, (3, 24)).cumsum(1)
    for kind in ("spline", "lanczos"):
        assert np.allclose(filters.BETWEEN[kind](x, 4)[:, ::4], x)  # exact at the samples
    t = np.arange(64)
    tone = np.sin(t * 0.4)[None]
    for kind, near in (("spline", 2e-3), ("lanczos", 2e-2), ("smooth", 2e-2)):
        assert np.abs(filters.BETWEEN[kind](tone, 4)[0][40:-40] - np.sin(np.arange(253) / 4 * 0.4)[40:-40]).max() < near
    # the smoother's response to a tone is 1 / (1 + s (2 - 2 cos w)^2)
    for w in (0.3, 1.0, 2.0):
        y = filters.smoothed(np.cos(np.arange(400) * w)[None])[0][50:-50]
        assert np.allclose(y, np.cos(np.arange(400) * w)[50:-50] / (1 + 0.15 * (2 - 2 * np.cos(w)) ** 2), atol=1e-6)
    assert filters.windowed_sinc(np.array([[4.0]]), 4).tolist() == filters.spline(np.array([[4.0]]), 4).tolist() == [[4.0]]
    rows = got(spark, small, "smoothed_waveforms")
    for _, r in rows.iloc[::97].iterrows():
        assert np.allclose(r["fine"], filters.spline(filters.smoothed(np.array(r["waveform"], float)[None]), 4)[0], atol=1e-4)
    none = spark.createDataFrame([(1, None), (2, []), (3, [1.0, 2.0])], "i long, w array<double>")
    assert {r["i"]: r["fine"] for r in filters.splined(none, "w", 2).collect()} == {1: None, 2: None, 3: [1.0, 1.5, 2.0]}


def test_multitaper_and_bands(spark, small, records):
    vectors, weight = filters.tapers(64, 3.0, 5)
    assert np.allclose(vectors @ vectors.T, np.eye(5), atol=1e-9) and (np.diff(weight) < 0).all() and weight[-1] > 0.9
    want = {}
    for (session, c), x in records.items():
        for start in range(0, len(x) - 63, 32):
            w = x[start : start + 64]
            w = w - w.mean()
            want[session, c, start] = sum(k * np.abs(np.fft.rfft(w * v)) ** 2 for k, v in zip(weight, vectors, strict=True)) / weight.sum()
    rows = got(spark, small, "multitaper_power")
    assert {tuple(r) for r in rows[["session", "ch", "start"]].to_numpy()} == set(want)
    for _, r in rows.iloc[::13].iterrows():
        assert np.allclose(r["power"], want[r["session"], r["ch"], r["start"]], rtol=1e-6, atol=1e-5)
    bands = defaultdict(list)
    for (session, c, _), p in want.items():
        for f, v in enumerate(p):
            bands[session, c, "low" if f < 4 else "mid" if f < 16 else "high"].append(v)
    for _, r in got(spark, small, "band_power").iterrows():
        own = bands.pop((r["session"], r["ch"], r["band"]))
        assert r["n"] == len(own) and abs(r["power"] - np.mean(own)) < 1e-3 + 1e-6 * np.mean(own)
    assert not bands


def test_windows_of_many_blocks(spark):
    x = np.random.default_rng(2).normal(0, 1, 500)
    df = spark.createDataFrame([(0, 0, i, float(v)) for i, v in enumerate(x)], "session long, ch long, sample long, x double")
    whole, parts = (sorted(map(tuple, filters.multitaper(df, 64, 24, 2.0, 2, b).select("start", "power").collect())) for b in (100_000, 50))
    assert len(whole) == (500 - 64) // 24 + 1 and [w[0] for w in whole] == [p[0] for p in parts]
    assert all(np.allclose(a[1], b[1]) for a, b in zip(whole, parts, strict=True))


def test_whitened(spark, small, records):
    rows = got(spark, small, "whitened_channels").sort_values(["session", "sample"])
    order = sorted({s for s, _ in records})
    x = np.vstack([np.stack([records[s, c] for c in range(4)], 1) for s in order])
    y = rows[[f"w{i}" for i in range(4)]].to_numpy()
    assert np.allclose(np.cov(y.T), np.eye(4), atol=1e-4)
    value, vector = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(y, (x - x.mean(0)) @ (vector / np.sqrt(value)) @ vector.T, atol=1e-4)


def pcs(x, keep=3):
    value, vector = np.linalg.eigh(np.cov(x.T))
    v = vector[:, ::-1][:, :keep].T
    return v * np.sign(v[np.arange(keep), np.abs(v).argmax(1)])[:, None]


def test_rotated(spark, small, vectors):
    ids, cluster, x = vectors
    rows = got(spark, small, "rotated_components").sort_values("spike_id")
    own = x[cluster > 1]
    turned = models.varimax(pcs(own))
    assert np.allclose(turned @ turned.T, np.eye(3), atol=1e-8)
    assert np.allclose(rows[["rc1", "rc2", "rc3"]], (x - own.mean(0)) @ turned.T, atol=1e-2)
    # no pair can be turned further to make squared loadings differ more
    spread = lambda v: (v**2).var(1).sum()
    for i, j in ((0, 1), (0, 2), (1, 2)):
        for a in (-0.02, 0.02):
            t = turned.copy()
            t[[i, j]] = np.cos(a) * t[i] + np.sin(a) * t[j], np.cos(a) * t[j] - np.sin(a) * t[i]
            assert spread(t) <= spread(turned) + 1e-9


def test_two_components(spark, small, vectors):
    ids, cluster, x = vectors
    score = (x - x.mean(0)) @ pcs(x)[0]
    rows = got(spark, small, "two_component_units").set_index("cluster")
    for c in np.unique(cluster):
        v = np.sort(score[cluster == c])
        r = rows.loc[c]
        assert r["n"] == len(v)
        if len(v) >= 4:
            m, s = v.mean(), v.std()
            assert abs(r["bic1"] - (len(v) * (np.log(2 * np.pi * s * s) + 1) + 2 * np.log(len(v)))) < 1e-2
            cut = splits.apart(v, np.ones(len(v)))
            best = min(range(1, len(v)), key=lambda k: ((v[:k] - v[:k].mean()) ** 2).sum() + ((v[k:] - v[k:].mean()) ** 2).sum())
            assert cut == best and r["mean0"] <= r["mean1"] and r["split"] == (r["bic2"] < r["bic1"] and r["ashman"] >= 2)


def test_dips_and_cores(spark, small, vectors):
    ids, cluster, x = vectors
    rows = got(spark, small, "dip_decisions").set_index("cluster")
    assert set(rows.index) == set(cluster // 2)
    for c in rows.index:
        own = x[cluster // 2 == c]
        assert rows.loc[c, "n"] == len(own) and (rows.loc[c, "reason"] == "too_small") == (len(own) < 40)
    halves = got(spark, small, "dip_splits")
    assert sorted(halves["spike_id"]) == ids.tolist()
    spikes = got(spark, small, "core_spikes").set_index("spike_id")
    units = got(spark, small, "core_units").set_index("cluster")
    for c in units.index:
        own = np.flatnonzero(cluster == c)
        if len(own) < sorting._CORE.least:
            assert units.loc[c, "reason"] == "too few"
            continue
        w = x[own].reshape(len(own), -1, adapters.CHANNELS)
        reason, keep, rank, _, _ = cores.analysed(w, w, sorting._CORE)
        assert units.loc[c, "reason"] == reason and units.loc[c, "cut"] == keep.sum()
        assert spikes.loc[ids[own], "keep"].tolist() == keep.tolist()
    assert dips.Dip().axes().shape == (39, 3)


def test_classes(spark, small, vectors):
    ids, _, x = vectors
    timed = adapters.spikes(spark, small).select("spike_id", "t", "grp").toPandas().set_index("spike_id")
    known = np.isin(ids, timed.index)
    score = ((x - x.mean(0)) @ pcs(x).T)[known]
    rows = got(spark, small, "noise_classes").sort_values("spike_id")
    assert rows["spike_id"].tolist() == ids[known].tolist() and (rows["margin"] >= 0).all()
    alone = cem.labelled(score, cem.Rules(classes=8, rounds=20))
    assert np.mean(alone == rows["class"].to_numpy()) > 0.95
    rows = got(spark, small, "chunked_units").sort_values("spike_id")
    assert rows["spike_id"].tolist() == ids[known].tolist()
    t = timed.loc[rows["spike_id"], "t"].to_numpy()
    for grp, part in rows.groupby("grp"):
        # chunks are numbered through the stretches of two weeks that have spikes
        stretch = np.unique(t[rows["grp"].to_numpy() == grp] // (14 * 86400), return_inverse=True)[1]
        assert part["chunk"].tolist() == stretch.tolist()
    rows = got(spark, small, "variational_classes")
    assert sorted(rows["spike_id"]) == ids[known].tolist() and rows["class"].between(1, 6).all()


def test_artefacts(spark, small, records):
    rows = got(spark, small, "artefact_free").sort_values(["session", "sample"])
    order = sorted({s for s, _ in records})
    x = np.vstack([np.stack([records[s, c] for c in range(4)], 1) for s in order])
    y, level = rows[[f"c{i}" for i in range(4)]].to_numpy(), rows["artefact"].to_numpy()
    # what was taken out is one signal, with one weight on each channel
    gone = x - y
    load = gone.T @ level / (level @ level)
    assert np.allclose(gone, level[:, None] * load, atol=2e-3 * max(1, np.abs(load).max()))
    bursts = got(spark, small, "artefact_bursts")
    assert (bursts.sort_values(["session", "sample"]).groupby("session")["sample"].diff().dropna() >= 15).all()


def test_coherence_and_places(spark, small, records, vectors):
    s, n = np.zeros((4, 4, 33), complex), 0
    for session in {k[0] for k in records}:
        x = np.stack([records[session, c] for c in range(4)], 1)
        for at in range(0, len(x) - 63, 32):
            w = x[at : at + 64] * np.hanning(64)[:, None]
            f = np.fft.rfft(w - w.mean(0), axis=0)
            s, n = s + np.einsum("fi,fj->ijf", f, f.conj()), n + 1
    f = np.arange(33) / 64
    for _, r in got(spark, small, "channel_coherence").iterrows():
        own = (f >= 0.02) & (f < 0.15) if r["band"] == "low" else (f >= 0.15) & (f < 0.5)
        want = np.abs(s[r["a"], r["b"], own]) ** 2 / (s[r["a"], r["a"], own] * s[r["b"], r["b"], own]).real
        assert r["windows"] == n and abs(r["coherence"] - want.mean()) < 2e-6
    places = got(spark, small, "site_places").sort_values("ch")
    xy = places[["x", "y"]].to_numpy()
    assert np.allclose(xy.mean(0), 0, atol=1e-2) and (places["stress"] < 0.5).all() and xy[0, 0] >= 0
    far = np.linalg.norm(xy[:, None] - xy, axis=2) + np.diag(np.full(8, np.inf))
    assert abs(np.median(far.min(1)) - 20) < 0.1


def test_moves(spark, small, vectors):
    ids, cluster, _ = vectors
    rows = got(spark, small, "reassigned_spikes")
    own = dict(zip(ids, cluster, strict=True))
    assert all(own[r["spike_id"]] == r["cluster"] != r["to"] and r["gain"] > 0 for _, r in rows.iterrows())


@pytest.mark.parametrize("name", ["similarity_orders", "recovered_cliques", "smoothed_templates", "channel_groups", "covariance_classes", "density_basins", "spike_places", "collision_parts", "mixture_classes", "principal_components"])
def test_every_row_once(spark, small, vectors, name):
    ids, cluster, _ = vectors
    rows = got(spark, small, name)
    assert len(rows)
    if "spike_id" in rows:
        assert sorted(rows["spike_id"]) == ids.tolist()
    elif "cluster" in rows:
        assert set(rows["cluster"]) <= set(cluster)
