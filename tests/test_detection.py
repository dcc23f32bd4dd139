"""Walks and states over blocks, and the detection built on them, against one pass over all samples."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import detection, scans, signal, timing
from wavemill.plans import catalogue
from wavemill.sources import adapters


def walked(rows):
    """One key's rows (at, to) in order: those stood on."""
    out, p = [], -math.inf
    for at, to in rows:
        if at >= p:
            out.append(at)
            p = to
    return out


@pytest.mark.parametrize("width", [1, 7, 50, 10_000])
def test_jumps(spark, width):
    r = random.Random(width)
    rows = [(k if k else None, at, at + r.randint(1, 30), f"x{at}") for k in range(4) for at in sorted(r.sample(range(-500, 500), 200))]
    df = spark.createDataFrame(rows, "k long, at long, to long, block string").repartition(5)
    got = scans.jumps(df, ["k"], "at", "to", 30, width).collect()
    for k in {x[0] for x in rows}:
        assert sorted(x["at"] for x in got if x["k"] == k) == walked([x[1:3] for x in rows if x[0] == k])
    assert all(x["block"] == f"x{x['at']}" for x in got)
    assert scans.jumps(df.limit(0), ["k"], "at", "to", 30, width).count() == 0


@pytest.mark.parametrize("equal", [True, False])
def test_refractory_over_blocks(spark, equal):
    r = random.Random(3)
    rows = [(s, c, t, t % 3) for s in range(2) for c in range(2) for t in sorted(r.choices(range(3000), k=900))]
    df = spark.createDataFrame(rows, "session long, ch long, sample long, x long")
    got = signal.refractory(df, 9, equal, width=100).collect()
    for key in {x[:2] for x in rows}:
        kept = []
        for *_, t, _ in (x for x in rows if x[:2] == key):
            if not kept or (t - kept[-1] > 9 if equal else t - kept[-1] >= 9):
                kept.append(t)
        assert sorted(x["sample"] for x in got if (x["session"], x["ch"]) == key) == kept


def test_availability_over_blocks(spark):
    r = random.Random(5)
    rows = [(i, i % 3 if i % 7 else None, r.randint(0, 400)) for i in range(300)]
    constants = {"fast": (0.4, 20.0), "slow": (0.1, 90.0)}
    got = {x["spike_id"]: x for width in (3, 10_000) for x in timing.depression(spark.createDataFrame(rows, "spike_id long, cluster long, t long"), constants, width).collect()}
    for c in {x[1] for x in rows}:
        own = sorted((t, i) for i, k, t in rows if k == c)
        for name, (use, tau) in constants.items():
            left, last = 1.0, None
            for t, i in own:
                left = 1.0 if last is None else 1 - (1 - left * (1 - use)) * math.exp(-(t - last) / tau)
                last = t
                assert abs(got[i][name] - left) < 1e-12


def one_pass(x, limits, how):
    """Events of samples by channels in one pass."""
    n, channels = x.shape
    limits = [abs(v) for v in limits]

    def real(i, c):
        v, b, a = x[i, c], x[max(i - 1, 0), c], x[min(i + 1, n - 1), c]
        if v == 0:
            return not (b > 0 > a or b < 0 < a)
        return (b <= v and a <= v) if v > 0 else (b >= v and a >= v)

    out, last, i = [], None, how.before
    while i + how.length - 1 < n:
        if not any(abs(x[i, c]) >= limits[c] for c in range(channels)):
            i += 1
            continue
        peaks = [(s, c) for s in range(i, i + how.length) for c in range(channels) if abs(x[s, c]) >= limits[c] and real(s, c)]
        if how.negative_first and any(x[p] < 0 for p in peaks):
            peaks = [p for p in peaks if x[p] < 0]
        if not peaks:
            i += how.length
            continue
        s, c = min(peaks, key=lambda p: (-abs(x[p]), p))
        if s + how.after < n and (last is None or s - last > how.refractory):
            out.append((s, c, float(x[s, c])))
            last = s
        i = max(i + 1, s + how.length - how.before)
    return out


@pytest.mark.parametrize("negative_first", [True, False])
@pytest.mark.parametrize("block", [8, 61, 100_000])
def test_detection_equals_one_pass(spark, negative_first, block):
    rng = np.random.default_rng(block)
    how = detection.Peaks(length=9, before=3, after=5, refractory=7, negative_first=negative_first)
    records = {s: np.rint(rng.normal(0, 4, (n, 3)).cumsum(0) % 21 - 10).astype(int) for s, n in ((1, 700), (2, 40), (3, 8), (4, 1))}
    records[5] = np.zeros((50, 3), int)
    records[6] = np.tile([[9, 0, -9]], (60, 1))  # a plateau: every sample is a peak
    rows = [(s, i, x.tolist(), "b") for s, record in records.items() for i, x in enumerate(record)]
    df = spark.createDataFrame(rows, "session long, sample long, xs array<long>, own string").repartition(4)
    got = detection.detect(df, [7, 8, -6], how, block).collect()
    assert got
    for s, record in records.items():
        assert sorted((x["sample"], x["ch"], float(x["value"])) for x in got if x["session"] == s) == one_pass(record, [7, 8, -6], how)
    assert detection.detect(df.limit(0), [7, 8, -6], how, block).count() == 0


def test_peaks_at_block_edges(spark):
    # one spike at every distance from a block's edge
    how = detection.Peaks(length=8, before=2, after=3, refractory=4)
    for at in range(10, 30):
        x = np.zeros((60, 2), int)
        x[at - 2 : at + 3, 1] = [-3, -6, -9, -6, -3]
        df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "session long, sample long, xs array<long>")
        assert [(r["sample"], r["ch"], r["value"]) for r in detection.detect(df, [5, 5], how, 20).collect()] == [(at, 1, -9)]


def test_groups_have_their_own_rules(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-10, 11, (400, 4))
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "session long, sample long, xs array<long>")
    rules = {"a": detection.Peaks(length=6, before=2, after=2), "b": detection.Peaks(length=5, before=1, after=1, refractory=0, negative_first=False)}
    got = detection.by_group(df, {"a": [3, 0], "b": [1]}, {"a": [9, 9], "b": [10]}, rules).collect()
    want = [("a", s, [3, 0][c], v) for s, c, v in one_pass(x[:, [3, 0]], [9, 9], rules["a"])] + [("b", s, 1, v) for s, _, v in one_pass(x[:, [1]], [10], rules["b"])]
    assert sorted((r["grp"], r["sample"], r["ch"], float(r["value"])) for r in got) == sorted(want)
    with pytest.raises(ValueError, match="longer"):
        detection.detect(df, [1, 1, 1, 1], detection.Peaks(length=4, before=4))


def test_rising_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(signal, "BLOCK", 16)
    x = np.random.default_rng(2).integers(0, 5, 300)
    df = spark.createDataFrame([(0, 0, i, int(v)) for i, v in enumerate(x)], "session long, ch long, sample long, x long")
    want = [i for i, v in enumerate(x) if v > 3 and (i == 0 or x[i - 1] <= 3)]
    assert sorted(r["sample"] for r in signal.rising(df, 3).collect()) == want
    steps = signal.stepped(df.select("session", "sample", F.array("x", (-F.col("x"))).alias("xs")))
    d = np.diff(x, prepend=0)
    assert {r["sample"]: r["xs"] for r in steps.collect()} == {i: [int(v), -int(v)] for i, v in enumerate(d)}


@pytest.mark.parametrize("width", [13, 86_400])
def test_pair_rates_and_correlograms_count_pairs(spark, width):
    r = random.Random(width)
    rows = [(i, r.randint(0, 4) if i % 9 else None, r.randint(-200, 400)) for i in range(250)] + [(900, 1, None)]
    df = spark.createDataFrame(rows, "spike_id long, cluster long, t long").repartition(3)
    known = [(i, c, t) for i, c, t in rows if c is not None and t is not None]
    want = {}
    for _, a, t in known:
        for _, b, u in known:
            if a < b and abs(t - u) <= 25:
                n = want.setdefault((a, b), [0, 0])
                n[abs(t - u) > 6] += 1
    assert {(x["a"], x["b"]): [x["centre"], x["flank"]] for x in timing.pair_rates(df, "cluster", 6, 25, width).collect()} == want
    got = timing.correlogram(df.filter("t IS NOT NULL"), df.filter("t IS NOT NULL"), ["cluster"], 50, 5, True, width).collect()
    bins = {}
    for i, a, t in rows:
        for j, b, u in rows:
            if a == b and i != j and t is not None and u is not None and abs(k := math.floor((u - t) / 5 + 0.5)) <= 4:
                bins[a, k] = bins.get((a, k), 0) + 1
    assert {(x["cluster"], x["bin"]): x["n"] for x in got if x["n"]} == bins and len(got) == 9 * len({c for _, c, t in rows if t is not None})


def test_rows_of_a_scan_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(i % 5, i // 5, i // 5 + 4) for i in range(1000)], "k long, at long, to long").mapInArrow(counted, "k long, at long, to long")
    assert scans.jumps(rows, ["k"], "at", "to", 4, 20).count() == 5 * 50
    assert seen.value == 1000


def test_traces_are_dealt_once(spark, small):
    found = detection.crossings(adapters.traces(spark, small), [40, 500, 5, 4], detection.Peaks())
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_flat_runs(spark, small):
    r = random.Random(4)
    rows = [(s, i, [r.choice([1, 1, 1, 2, None]) for _ in range(2)]) for s in range(3) for i in range(200)]
    got = sorted(map(tuple, signal.flat_runs(spark.createDataFrame(rows, "session long, sample long, xs array<long>").repartition(5), 2).collect()))
    want = []
    for s in range(3):
        for c in range(2):
            lengths, last = [], None
            for x in (xs[c] for k, _, xs in rows if k == s):
                if x is not None and x == last:
                    lengths[-1] += 1
                else:
                    lengths.append(1)
                last = x
            want.append((s, c, max(lengths), sum(n > 3 for n in lengths)))
    assert got == want
    # no row of one channel is dealt or sorted
    assert catalogue.QUERIES["flat_runs"](spark, small)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_templates_without_joins(spark, small):
    # the record is dealt once, by session: neither events nor their waveforms nor the means are joined by a shuffle
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.QUERIES["subtract_templates"](spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert set(re.findall(r"hashpartitioning\((\w+)#\d+\w*(.*?), \d+\)", plan)) == {("session", "")}


def test_templates_of_odd_records(spark):
    # nulls in a channel, a null session, events at both ends and overlaps, against plain loops
    r = random.Random(8)
    value = lambda: r.choice([None, 3, 20, 44, 46, 50, 60])
    rows = [(s, i, [value(), value()]) for s, n in ((1, 60), (2, 3), (None, 25), (3, 1)) for i in range(n)]
    x = {(s, i, c): xs[c] for s, i, xs in rows for c in (0, 1)}
    over = lambda v: v is not None and v > 45
    events = [(s, i, c) for (s, i, c), v in x.items() if s is not None and over(v) and not over(x.get((s, i - 1, c)))]
    held, less = {}, {}
    for s, i, c in events:
        for k in range(-2, 4):
            if x.get((s, i + k, c)) is not None:
                held.setdefault((c, k), []).append(x[s, i + k, c])
    for s, i, c in events:
        for k in range(-2, 4):
            less[s, i + k, c] = less.get((s, i + k, c), 0) + (sum(held[c, k]) / len(held[c, k]) if (c, k) in held else 0)
    want = {(s, i, c): None if v is None else round(v - less.get((s, i, c), 0), 6) for (s, i, c), v in x.items()}
    got = signal.without_templates(spark.createDataFrame(rows, "session long, sample long, xs array<long>"), 2, 45, 2, 3).collect()
    assert len(got) == len(want)
    assert {(x.session, x.sample, x.ch): None if x.y is None else round(x.y, 6) for x in got} == want
