"""Splits, cores, classes, chunks and reassignment on planted units and against plain loops."""

import numpy as np
import pytest

from wavemill.operators import adaptation, cem, cores, dips, distances, reassign, shapes


def rows_of(parts):
    """(spike_id, cluster, fet) of arrays by cluster."""
    out = []
    for c, x in parts:
        out += [(len(out) + i, c, [float(v) for v in row]) for i, row in enumerate(x)]
    return out


FET = "spike_id long, cluster long, fet array<double>"


def test_dip_split(spark):
    rng = np.random.default_rng(1)
    two = np.vstack([rng.normal(0, 1, (400, 4)), rng.normal([7, 5, 0, 0], 1, (250, 4))])
    one = np.random.default_rng(99).uniform(-1, 1, (500, 4)) * [3, 2, 1, 1]
    slant = np.vstack([rng.normal(0, 1, (300, 4)), rng.normal([0, 0, 6, 0], 1, (15, 4))])
    few, flat = rng.normal(0, 1, (30, 4)), np.ones((60, 4))
    rows = rows_of([(2, two), (3, one), (4, slant), (5, few), (6, flat)])
    odd = [(9001, None, [0.0] * 4), (9002, 2, None), (9003, 2, [0.0, float("nan"), 0.0, 0.0]), (9004, 3, [1.0])]
    df = spark.createDataFrame(rows + odd, FET)
    halves, decided = dips.dip_split(df, "fet", 4)
    told = {r["cluster"]: r for r in decided.collect()}
    assert told[2]["reason"] == "split" and told[2]["n"] == 650 and told[2]["depth"] > 0.8 and told[2]["bic2"] < told[2]["bic1"]
    assert [told[c]["reason"] for c in (3, 4, 5, 6)] == ["no_valley", "small_half", "too_small", "bad_features"]
    half = {r["spike_id"]: r["half"] for r in halves.collect()}
    assert len(half) == len(rows) and not set(half) & {9001, 9002, 9003, 9004}
    a, b = [half[i] for i in range(400)], [half[i] for i in range(400, 650)]
    assert {max(set(a), key=a.count), max(set(b), key=b.count)} == {1, 2} and np.mean(np.array(a) == max(set(a), key=a.count)) > 0.99
    assert {half[i] for i in range(650, len(rows))} == {0}
    # gates: a tight unit is not bloated; models sent one unit at a time change nothing
    gated = {r["cluster"]: r["reason"] for r in dips.dip_split(df, "fet", 4, dips.Dip(bloat=1.6))[1].collect()}
    assert gated[3] == "not_bloated" and gated[5] == "too_small"
    assert {r["cluster"]: r["reason"] for r in dips.dip_split(df, "fet", 4, dips.Dip(bloat=9.0, elongation=2.0))[1].collect()}[2] == "split"
    again = dips.dip_split(df, "fet", 4, dips.Dip(held=1))
    assert sorted(map(tuple, again[0].collect())) == sorted(half_row for half_row in map(tuple, halves.collect()))
    assert dips.dip_split(df.limit(0), "fet", 4)[1].count() == 0


def test_valley_equals_the_density_itself():
    rng = np.random.default_rng(2)
    how = dips.Dip()
    for x in (np.concatenate([rng.normal(0, 1, 500), rng.normal(5, 1, 300), rng.normal(9, 0.7, 200)]), rng.normal(0, 1, 400)):
        h = 1.06 * x.std(ddof=1) * len(x) ** -0.2
        low, high = x.min() - 3 * h, x.max() + 3 * h
        grid = np.linspace(low, high, how.grid)
        density = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1)
        peaks = [g for g in range(1, how.grid - 1) if density[g - 1] < density[g] > density[g + 1]]
        depths = [(1 - density[a:b].min() / min(density[a], density[b]), a + int(density[a:b].argmin())) for a, b in zip(peaks, peaks[1:], strict=False)]
        step = (high - low) / ((how.grid - 1) * how.fine)
        counts = np.bincount(np.rint((x - low) / step).astype(int), minlength=(how.grid - 1) * how.fine + 1)
        depth, at = dips.valley(counts, h / step, how)
        if depths:
            assert abs(depth - max(depths)[0]) < 2e-3 and abs(at - max(depths)[1]) <= 1
        else:
            assert depth < 2e-3


def waves(rng, n, shape, noise):
    return shape[None] + rng.normal(0, noise, (n, *shape.shape))


def test_core_cut(spark):
    rng = np.random.default_rng(3)
    t = np.arange(32)
    trough = -np.exp(-0.5 * ((t - 12) / 2.0) ** 2)
    main = np.outer(trough, [400, 200, 50])
    other = np.outer(-np.exp(-0.5 * ((t - 12) / 4.0) ** 2), [150, 500, 300])
    dirty = np.concatenate([waves(rng, 300, main, 12), waves(rng, 60, other, 12)])
    order = rng.permutation(len(dirty))
    rows, truth = [], {}
    for i, k in enumerate(order):
        rows.append((i, 2, dirty[k].ravel().tolist()))
        truth[i] = k < 300
    rows += [(1000 + i, 3, w.ravel().tolist()) for i, w in enumerate(waves(rng, 50, main, 12))]
    rows += [(2000 + i, 4, w.ravel().tolist()) for i, w in enumerate(waves(rng, 250, np.zeros((32, 3)) + 5.0, 0.0))]
    df = spark.createDataFrame(rows + [(5000, None, [0.0] * 96), (5001, 2, None)], FET)
    spikes, units = cores.core_cut(df, "fet", 3)
    told = {r["cluster"]: r for r in units.collect()}
    assert told[2]["reason"] == "cut" and told[3]["reason"] == "too few" and told[4]["reason"] == "no trough"
    got = {r["spike_id"]: r for r in spikes.collect()}
    assert len(got) == len(rows)
    kept = {i for i in truth if got[i]["keep"]}
    assert len(kept) == told[2]["cut"] and np.mean([truth[i] for i in kept]) > 0.97 and len(kept) > 0.8 * 300
    assert all(got[i]["keep"] and got[i]["rank"] is None for i in range(1000, 1050))
    assert sorted(got[i]["rank"] for i in truth) == list(range(360))
    # a subset is ordered, and the others are placed by it
    how = cores.Core(ordered=200, least=100)
    spikes, units = cores.core_cut(df.filter("cluster = 2"), "fet", 3, how)
    assert units.first()["ordered"] == 200
    got = {r["spike_id"]: r for r in spikes.collect()}
    assert {i for i in got if got[i]["rank"] is not None} == {k * 360 // 200 for k in range(200)}
    kept = {i for i in truth if got[i]["keep"]}
    assert np.mean([truth[i] for i in kept]) > 0.97 and len(kept) > 0.5 * 300


def test_least_change_equals_the_plain_loop():
    rng = np.random.default_rng(4)
    for n in (1, 2, 60):
        x = rng.normal(0, 1, (n, 5))
        order, step = cores.least_change(x, n // 2)
        taken, left = [n // 2], [i for i in range(n) if i != n // 2]
        while left:
            mean = x[taken].mean(0)
            far = [np.linalg.norm(x[i] - mean) for i in left]
            k = int(np.argmin(far))
            assert abs(far[k] - step[len(taken)]) < 1e-9
            taken.append(left.pop(k))
        assert order.tolist() == taken


def test_half_crossings():
    t = np.arange(24.0)
    w = np.stack([-100 * np.exp(-0.5 * ((t - c) / 3) ** 2) for c in (10, 11.5, 12.25)] + [np.zeros(24), np.full(24, 7.0)])
    at = cores.half_crossings(w, 6, 18, 4)
    assert np.allclose(at[:3] - at[0], [0, 1.5, 2.25], atol=0.1) and np.isnan(at[3:]).all()
    x = np.sin(t / 4)[None, :, None]
    assert np.allclose(cores.moved(x, t[None] + 0.5)[0, 2:-3, 0], np.sin((t[2:-3] + 0.5) / 4), atol=1e-3)


def test_classes_with_noise(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal((0, 0), 0.5, (300, 2)), rng.normal((8, 1), 0.6, (200, 2)), rng.normal((2, 9), 0.4, (150, 2)), rng.uniform(-6, 16, (40, 2))])
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)] + [(9000, 0, None)], FET)
    how = cem.Rules(classes=9)
    found = cem.fit(df, "fet", 2, how)
    assert len(found.model.mean) == 3  # more seeds than units: the others lost little and went
    rows = {r["spike_id"]: r for r in cem.classified(df, "fet", 2, found).collect()}
    assert rows[9000]["class"] is None and all(r["margin"] >= 0 and r["class"] != r["second"] for i, r in rows.items() if i < 9000)
    for a, b in ((0, 300), (300, 500), (500, 650)):
        own = [rows[i]["class"] for i in range(a, b)]
        assert max(set(own), key=own.count) > 0 and own.count(max(set(own), key=own.count)) > 0.95 * (b - a)
    assert np.mean([rows[i]["class"] == 0 for i in range(650, 690)]) > 0.6
    # the same in one task
    alone = cem.labelled(x, how)
    assert np.mean([alone[i] == rows[i]["class"] for i in range(690)]) > 0.99
    assert set(cem.labelled(x, cem.Rules(classes=5, noise=None, full=False))) <= {1, 2, 3, 4, 5}
    assert cem.fit(df.limit(0), "fet", 2) is None
    assert (cem.labelled(np.zeros((5, 2)), how) == 0).all()


def test_deleting_a_class_never_costs_more_than_its_penalty():
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(0, 1, (80, 2)), rng.normal(9, 1, (80, 2))])
    centre, spread = x.mean(0), x.var(0)
    how = cem.Rules(classes=6)
    classes = cem.begun(cem._seeds(x, 6), centre, spread, np.ptp(x, 0), how)
    for _ in range(30):
        sums = cem.sums_of(x, classes, centre)
        costs = classes.costs(x)
        assert np.isclose(sums[:, 1].sum(), costs.min(1).sum())
        new, score, deleted = cem.step(classes, sums, centre, spread * how.floor, how)
        if deleted and len(new.model.mean) == len(classes.model.mean) - 1:
            lost = [np.delete(costs, 1 + c, 1).min(1).sum() - costs.min(1).sum() for c in range(len(classes.model.mean))]
            k = len(classes.model.mean)
            assert min(lost) < cem.penalty(2, k + 1, len(x)) - cem.penalty(2, k, len(x)) or (sums[1:, 0] <= 2).any()
        classes = new
    assert len(classes.model.mean) < 6
    # with merging, parts of a unit come together
    whole = cem.rounds(cem.begun(cem._seeds(x, 6), centre, spread, np.ptp(x, 0), cem.Rules(classes=6, merge=True)), lambda c: cem.sums_of(x, c, centre), centre, spread * how.floor, cem.Rules(classes=6, merge=True))
    assert len(whole.model.mean) == 2


TIMED = "grp string, spike_id long, t double, fet array<double>"


def drifting(rng, n=4000, length=1000.0):
    """Two units that drift by far more than they are apart, one that does not, and one that is only there in the middle of some chunks."""
    rows = []
    for i in range(n):
        t = float(rng.uniform(0, length))
        u = int(rng.integers(3))
        centre = [(0 + t / 50, 0), (6 + t / 50, 0), (0, 30)][u]
        rows.append(("a", i, t, [float(v) for v in rng.normal(centre, 0.6)], u))
    return rows


def test_chunked_classes_follow_drift(spark):
    rng = np.random.default_rng(7)
    rows = drifting(rng)
    other = [("b", 100_000 + i, t, x, u) for _, i, t, x, u in drifting(rng, 1200)]
    few = [(None, 200_000 + i, 5.0, [0.0, 0.0], 0) for i in range(3)] + [("c", 300_000, None, [0.0, 0.0], 0), ("c", 300_001, 1.0, None, 0)]
    df = spark.createDataFrame([r[:4] for r in rows + other + few], TIMED)
    how = cem.Chunking(length=100.0, overlap=20.0)
    got = {r["spike_id"]: r for r in cem.chunked_cem(df, "grp", "fet", 2, how, cem.Rules(classes=6, merge=True)).collect()}
    assert len(got) == len(rows) + len(other) + 3
    for part, chunks in ((rows, 10), (other, 10)):
        assert {got[r[1]]["chunk"] for r in part} == set(range(chunks))
        named = []
        for u in range(3):
            labels = [got[r[1]]["label"] for r in part if r[4] == u]
            named.append(max(set(labels), key=labels.count))
            assert labels.count(named[-1]) > 0.9 * len(labels)
        assert len(set(named)) == 3 and 0 not in named
    assert all(got[200_000 + i]["label"] == 0 for i in range(3))
    # chunks with too many rows are cut in time, and nothing is lost
    cut = cem.chunked_cem(df.filter("grp = 'a'"), "grp", "fet", 2, cem.Chunking(length=1000.0, overlap=20.0, most=500), cem.Rules(classes=6, merge=True)).collect()
    assert len(cut) == len(rows) and 8 <= len({r["chunk"] for r in cut}) <= 11
    assert cem.chunked_cem(df.limit(0), "grp", "fet", 2, how).count() == 0


def test_votes_and_leftovers():
    how = cem.Chunking(1.0, 0.1)
    assert cem.partners({(1, 1): 9, (1, 2): 8, (2, 2): 3, (3, 3): 2, (4, 1): 9}, how) == [(1, 1), (2, 2)] or cem.partners({(1, 1): 9, (1, 2): 8, (2, 2): 3, (3, 3): 2, (4, 1): 9}, how) == [(1, 1)]
    assert cem.partners({(1, 1): 9, (1, 2): 8}, cem.Chunking(1.0, 0.1, margin=0.5)) == []
    assert cem.partners({(1, 1): 9, (1, 2): 8}, cem.Chunking(1.0, 0.1, purity=0.6)) == []

    def unit(*x):
        return {n: np.array(x, float) for n in ("mean", "left", "right")}

    models = {(0, 0): unit(1, 1), (0, 1): unit(5, 0), (0, 2): unit(0, 5), (1, 0): unit(1, 1), (1, 1): unit(5, 0.1), (2, 1): unit(0.1, 5), (2, 2): unit(-4, -4)}
    label = cem.joined(models, {0: {(1, 1): 50, (0, 0): 50}}, how)
    assert label[0, 0] == label[1, 0] == 0 and label[0, 1] == label[1, 1] == 1
    assert label[0, 2] == label[2, 1] == 2 and label[2, 2] == 3


def test_matrix_distances(spark):
    rng = np.random.default_rng(8)
    x = np.rint(rng.normal(0, 300, (240, 6)) + 1e6)
    own = np.arange(240) % 4
    rows = [(i, int(c), [int(a) for a in v]) for i, (c, v) in enumerate(zip(own, x, strict=True))] + [(500 + i, 1, [int(a) for a in x[0]]) for i in range(20)]
    df = spark.createDataFrame(rows, "spike_id long, cluster long, fet array<long>").repartition(3)
    mean = np.stack([x[own == c].mean(0) for c in range(4)])
    var = np.stack([x[own == c].var(0, ddof=1) for c in range(4)])
    held = distances.Models(np.arange(4), np.array([60, 60, 60, 60]), mean, var)
    every, by = np.array([r[2] for r in rows], float), np.array([r[1] for r in rows])
    far = (((every[:, None] - mean) ** 2) / var).sum(2)
    got = {r["spike_id"]: r for r in distances.nearest(df, "fet", held).collect()}
    assert all(got[r[0]]["nearest"] == f.argmin() and abs(got[r[0]]["cost"] - f.min()) < 1e-6 for r, f in zip(rows, far, strict=True))
    z = -0.5 * (far + np.log(var).sum(1))
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    error = {(r["a"], r["b"]): r["error"] for r in distances.posteriors(df, "fet", held).collect()}
    assert all(abs(error[a, b] - p[by == a, b].mean()) < 1e-9 for a in range(4) for b in range(4))
    for k in ([1, 5, 60, 100], [180, 199, 200, 201], [0, 260, 37, 2]):
        for least in (0, 10, 100_000):
            found = distances.kth_distances(df, "fet", held, np.array(k), least)
            for m in range(4):
                others = np.sort(far[by != m, m])
                assert (m in found) == (0 < k[m] <= len(others))
                if m in found:
                    assert abs(found[m] - others[k[m] - 1]) < 1e-6


def test_votes_over_the_whole_pool(spark):
    rng = np.random.default_rng(9)
    pool = [(i, int(rng.integers(3)), [int(v) for v in rng.integers(0, 6, 3)]) for i in range(300)]
    ask = [(1000 + i, 9, [int(v) for v in rng.integers(0, 6, 3)]) for i in range(50)]
    fields = "spike_id long, cluster long, fet array<long>"
    for block in (16, 4096):
        got = {r["spike_id"]: (r["winner"], r["votes"]) for r in shapes.vote(spark.createDataFrame(ask, fields), spark.createDataFrame(pool, fields), 10, block).collect()}
        for i, _, q in ask:
            near = sorted((sum((a - b) ** 2 for a, b in zip(q, x, strict=True)), j, c) for j, c, x in pool)[:10]
            votes = {c: sum(n[2] == c for n in near) for c in range(3)}
            best = min(votes, key=lambda c: (-votes[c], c))
            assert got[i] == (best, votes[best])
    assert shapes.vote(spark.createDataFrame(ask, fields), spark.createDataFrame([], fields), 10).count() == 0


def plain_moves(rows, units, how, channels):
    """Reassignment spike by spike, with each unit's whole history."""
    units = sorted(units, key=lambda u: u.cluster)
    by = {u.cluster: u for u in units}
    trains = {u.cluster: sorted(t for _, c, t, _ in rows if c == u.cluster) for u in units}

    def lacks(u, t):
        out = []
        for use, tau in (u.fast, u.slow):
            post, last = None, None
            for s in trains[u.cluster]:
                if s >= t:
                    break
                at = 0.0 if post is None else post * np.exp(-(s - last) / tau)
                post, last = at * (1 - use) + use, s
            out.append(0.0 if post is None else post * np.exp(-(t - last) / tau))
        return out

    def left(u, t, w):
        a, b = lacks(u, t)
        return float(((np.array(w) - u.shape[0] - a * u.shape[1] - b * u.shape[2]) ** 2).sum())

    values = units[0].shape.shape[1]
    own = {c: [left(by[c], t, w) for _, k, t, w in rows if k == c] for c in by}
    noise = {c: max(1.0, sum(v) / (len(v) * values)) if v else 1.0 for c, v in own.items()}
    main = {c: int(np.ptp(by[c].shape[0].reshape(-1, channels), 0).argmax()) for c in by}
    size = lambda c, w: float(np.ptp(np.array(w).reshape(-1, channels)[:, main[c]]))
    limit = {c: sorted(size(c, w) for _, k, _, w in rows if k == c)[int(how.tail / 100 * (len(own[c]) - 1))] for c in by if own[c]}
    moves = []
    for i, c, t, w in rows:
        if c not in by or size(c, w) > limit[c]:
            continue
        score = {}
        for u in units:
            k = u.cluster
            if k != c and how.veto and any(abs(s - t) < how.veto for s in trains[k]):
                continue
            score[k] = -0.5 * left(u, t, w) / noise[k] - 0.5 * values * np.log(noise[k]) - how.stay * (k != c)
        best = max(score, key=lambda k: (score[k], -k))
        if best != c and score[best] - score[c] > how.margin:
            moves.append((i, c, t, best, score[best] - score[c]))
    if how.veto:
        kept = {}
        out = []
        for m in sorted(moves, key=lambda m: (m[2], m[0])):
            if m[3] not in kept or m[2] - kept[m[3]] >= how.veto:
                out.append(m)
                kept[m[3]] = m[2]
        return out
    return moves


@pytest.mark.parametrize("width", [40, 100_000])
@pytest.mark.parametrize("veto", [0, 5])
def test_reassignment(spark, width, veto):
    rng = np.random.default_rng(10)
    base = {2: np.array([[-90, -20], [40, 10], [10, 5]]), 3: np.array([[-60, -70], [30, 30], [10, 10]]), 7: np.array([[-20, -95], [5, 45], [5, 10]])}
    units = [reassign.Worn(c, np.stack([b.ravel(), -0.5 * b.ravel(), -0.2 * b.ravel()]).astype(float), (0.5, 15.0), (0.1, 60.0)) for c, b in base.items()]
    rows, t = [], 0
    for i in range(400):
        t += int(rng.integers(1, 9))
        true = int(rng.choice([2, 3, 7]))
        said = true if rng.random() < 0.85 else int(rng.choice([2, 3, 7, 1]))
        w = base[true].ravel() * rng.uniform(0.5, 1.1) + rng.normal(0, 6, 6)
        rows.append((i, said, t, [float(v) for v in w]))
    how = reassign.Moves(tail=60.0, veto=veto)
    df = spark.createDataFrame([("g", *r) for r in rows] + [("g", 900, None, 4, rows[0][3]), ("g", 901, 2, None, rows[0][3]), ("g", 902, 2, 5, None), ("g", 903, 1, 900_000, rows[0][3])], "g string, spike_id long, cluster long, t long, fet array<double>")
    got = reassign.reassigned(df, ["g"], "fet", 2, units, how, width).collect()
    want = plain_moves(rows, units, how, 2)
    assert want and sorted((r["spike_id"], r["cluster"], r["t"], r["to"]) for r in got) == sorted(m[:4] for m in want)
    gain = {m[0]: m[4] for m in want}
    assert all(abs(r["gain"] - gain[r["spike_id"]]) < 1e-6 for r in got)
    assert reassign.reassigned(df.limit(0), ["g"], "fet", 2, units, how, width).count() == 0


def test_adaptation_constants(spark):
    rng = np.random.default_rng(11)
    fast, slow = [(0.5, 5.0), (0.5, 20.0), (0.2, 20.0)], [(0.1, 60.0), (0.1, 200.0)]

    def lacks(times, use, tau):
        out, missing = [], 0.0
        for a, b in zip([None, *times], times, strict=False):
            missing = 0.0 if a is None else (missing * (1 - use) + use) * np.exp(-(b - a) / tau)
            out.append(missing)
        return np.array(out)

    rows, truth = [], {2: (1, 0), 3: (0, 1)}
    base = rng.normal(0, 50, (3, 6))
    for c, (i, j) in truth.items():
        times = np.cumsum(rng.integers(1, 25, 400))
        x = base[0] + np.outer(lacks(times, *fast[i]), base[1]) + np.outer(lacks(times, *slow[j]), base[2]) + rng.normal(0, 1, (400, 6))
        rows += [(len(rows) + k, c, int(t), [float(v) for v in w]) for k, (t, w) in enumerate(zip(times, x, strict=True))]
    rows += [(9000, 7, 5, [1.0] * 6), (9001, None, 5, [1.0] * 6), (9002, 2, None, [1.0] * 6), (9003, 2, 5, None)]
    df = spark.createDataFrame(rows, "spike_id long, cluster long, t long, fet array<double>")
    for width in (50, 86_400):
        got = {r["cluster"]: r for r in adaptation.fitted(df, "fet", 6, fast, slow, width).collect()}
        for c, (i, j) in truth.items():
            assert (got[c]["fast_use"], got[c]["fast_time"]) == fast[i] and (got[c]["slow_use"], got[c]["slow_time"]) == slow[j]
            times = np.array([r[2] for r in rows if r[1] == c and r[2] and r[3]])
            x = np.array([r[3] for r in rows if r[1] == c and r[2] and r[3]])
            z = np.column_stack([np.ones(400), lacks(times, *fast[i]), lacks(times, *slow[j])])
            rest = ((x - z @ np.linalg.lstsq(z, x, rcond=None)[0]) ** 2).sum()
            assert got[c]["n"] == 400 and abs(got[c]["left"] - rest / ((x - x.mean(0)) ** 2).sum()) < 1e-6
        assert got[7]["n"] == 1 and got[7]["left"] is None
    assert adaptation.fitted(df.limit(0), "fet", 6, fast, slow).count() == 0
