"""Operators that SQL can't express, file readers, streams and small vectors with known results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import arrays as A
from wavemill.operators import models, signal, timing
from wavemill.plans import catalogue
from wavemill.sources import adapters, files
from wavemill.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_rounding(spark):
    x = F.explode(F.array(*[F.lit(v) for v in (2.5, -2.5, 40000.0, -40000.0, float("nan"))]))
    got = [r[0] for r in spark.range(1).select(x.alias("x")).select(A.saturate(F.col("x"))).collect()]
    assert got == [3, -3, 32767, -32768, 0]


@pytest.mark.parametrize(("order", "want"), [(0, [10, 7, 1]), (1, [3, 6, -6]), (2, [3, 1.5, -6]), (3, [12, 3, -15])])
def test_spatial(spark, order, want):
    assert one(spark, A.spatial(F.array(*map(F.lit, [10, 7, 1])), order)) == want
    assert one(spark, A.spatial(F.array(F.lit(4)), order)) == ([4.0] if order < 3 else [0.0])


@pytest.mark.parametrize(("text", "want"), [("c1-(c0+c2)/2", 1.0), ("2^3^2", 512.0), ("c0^2+1", 10.0), ("-c1*(c2-1)", -8.0), ("c1/(c0-3)", 0.0), ("9^99", 1e9)])
def test_channel_expression(spark, text, want):
    row = spark.sql("SELECT array(3L, 4L, 3L) AS xs").withColumn("xs", F.expr("array(3L, 4L, 3L)"))
    assert row.select(A.channel_expression(text).alias("x")).first()[0] == want
    with pytest.raises(A.ExpressionError):
        A.channel_expression("c0; drop")


def test_refractory(spark):
    e = spark.createDataFrame([(1, t, 0, 9) for t in (0, 5, 10, 16)], "session long, sample long, ch long, x long")
    assert sorted(r.sample for r in signal.refractory(e, 5).collect()) == [0, 10, 16]
    assert sorted(r.sample for r in signal.refractory(e, 5, reject_equal=False).collect()) == [0, 5, 10, 16]


def test_clean_mask(spark):
    for times, want in (((0, 3, 10), [False, False, True]), ((0, 5), [False, True])):
        s = spark.createDataFrame([(1, t) for t in times], "grp long, t long")
        assert [r.clean for r in timing.clean(s, "grp", 5, width=4).orderBy("t").collect()] == want


def test_components(spark, small):
    f = adapters.features(spark, small)
    x = np.array([r.fet[:16] for r in f.orderBy("spike_id").collect()], float)
    mean, value, vectors = models.components(f, "fet", 16, 3)
    want = np.linalg.eigvalsh(np.cov(x.T))[::-1][:3]
    assert np.allclose(value, want) and np.allclose(mean, x.mean(0)) and (np.take_along_axis(vectors, np.abs(vectors).argmax(1)[:, None], 1) > 0).all()


def test_components_of_whole_vectors(spark, small):
    rows = adapters.features(spark, small).orderBy("spike_id").collect()
    x = np.array([r.fet for r in rows], float)
    assert x.shape[1] == 64
    vectors = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :3]
    want = (x - x.mean(0)) @ (vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(3)]))
    got = catalogue.QUERIES["principal_components"](spark, small).orderBy("spike_id").collect()
    assert np.allclose([[r.pc1, r.pc2, r.pc3] for r in got], want, atol=0.01)


def test_mixture_of_whole_vectors(spark, tmp_path, monkeypatch):
    # the rows differ in the last features alone
    rng = np.random.default_rng(2)
    rows = [(i, 2, [int(v) for v in rng.normal(0, 3, 48)] + [int(v) for v in rng.normal(5000 * (i % 2), 3, 16)]) for i in range(400)]
    df = spark.createDataFrame(rows, "spike_id long, cluster long, fet array<long>")
    from wavemill.plans import models as plans

    monkeypatch.setattr(plans, "features", lambda s, d: df)
    got = catalogue.QUERIES["mixture_classes"](spark, "").orderBy("spike_id").collect()
    model = models.fit(df, "fet", 64, 10)
    x = np.array([r[2] for r in rows], float)
    cost = ((x[:, None] - model.mean) ** 2 / model.var).sum(2) / 2 + np.log(model.var).sum(1) / 2 - np.log(model.weight) + 32 * np.log(2 * np.pi)
    assert np.allclose([r.cost for r in got], cost.min(1), atol=1e-3)
    assert [r["class"] for r in got] == list(cost.argmin(1))


def test_mixture(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(10 * (i % 3), 1, 2)]) for i in range(300)]
    df = spark.createDataFrame(rows, "spike_id long, fet array<double>")
    got = models.assign(df, "fet", models.fit(df, "fet", 2, 3)).collect()
    assert len({(r.spike_id % 3, r["class"]) for r in got}) == 3
    assert abs(models.penalty(2, 3, 100) - 12 * np.log(100) / 2) < 1e-9


def test_files(spark, tmp_path):
    t, c = np.arange(0, 900, 300, dtype="<i8"), np.array([2, 5, 6, 5], "<i4")
    t.tofile(tmp_path / "a.res")
    c.tofile(tmp_path / "a.clu")
    (tmp_path / "b.res").write_text("0\n300\n600\n")
    np.arange(24, dtype="<i2").tofile(tmp_path / "a.spk")
    (tmp_path / "a.fet").write_bytes(np.array([2], "<i4").tobytes() + np.arange(6, dtype="<i8").tobytes())
    for name in "ab":
        assert [r.t for r in files.times(spark, str(tmp_path / f"{name}.res")).orderBy("spike_id").collect()] == [0, 300, 600]
    pair = files.paired(files.times(spark, str(tmp_path / "a.res")), files.labels(spark, str(tmp_path / "a.clu")))
    assert sorted((r.t, r.cluster) for r in pair.collect()) == [(0, 5), (300, 6), (600, 5)]
    assert [r.waveform for r in files.waveforms(spark, str(tmp_path / "a.spk"), 4, 2).orderBy("spike_id").collect()][1] == list(range(8, 16))
    assert [r.fet for r in files.features(spark, str(tmp_path / "a.fet")).orderBy("spike_id").collect()] == [[0, 1], [2, 3], [4, 5]]
    assert [r.xs for r in files.signal(spark, str(tmp_path / "a.spk"), 8).orderBy("sample").collect()][2] == list(range(16, 24))
    with pytest.raises(Exception, match="whole"):
        files.waveforms(spark, str(tmp_path / "a.spk"), 5, 2).collect()
    # parallel files of two groups in one folder meet by their names, and one too short is refused
    for k, times_ in ((1, [5, 6]), (2, [7, 8])):
        np.array(times_, "<i8").tofile(tmp_path / f"s.res.{k}")
        np.array([2, 10 * k, 10 * k + 1], "<i4").tofile(tmp_path / f"s.clu.{k}")
    both = files.paired(files.times(spark, str(tmp_path / "s.res.*")), files.labels(spark, str(tmp_path / "s.clu.*")))
    assert sorted((r.t, r.cluster) for r in both.collect()) == [(5, 10), (6, 11), (7, 20), (8, 21)]
    with pytest.raises(ValueError, match="2 times but 0 labels"):
        files.paired(files.times(spark, str(tmp_path / "s.res.*")), files.labels(spark, str(tmp_path / "s.clu.1")))
    files.write_events(spark.createDataFrame([(1.5, "x")], "t_ms double, label string"), str(tmp_path / "e"))
    assert [tuple(r) for r in files.events(spark, str(tmp_path / "e")).collect()] == [(1.5, "x")]


def test_template_files(spark, tmp_path):
    (tmp_path / "x.tcl").write_text("tcl 1\nnClasses 3\n# col\tstatus\tlabel\n0\tactive\tA b\t23\tgt\t2026-10-02\n1\tfree\t-\t-\t-\t-\n2\tmerged:0\tx\t-\t-\t-\n")
    got = [tuple(r) for r in files.class_registry(spark, str(tmp_path / "x.tcl")).orderBy("col").collect()]
    assert [g[:5] for g in got] == [(0, "active", None, "A b", 23), (1, "free", None, None, None), (2, "merged", 0, "x", None)] and str(got[0][6]) == "2026-10-02"
    (tmp_path / "x.wti").write_text("wti 2\nnSamples 4\nsr 20000\nnRows 3\n# row unit\nrow 0 7 drift 1 0 120.5 540 -1\nrow 1 7 drift 0 120.5 241.25 0 0 a\nrow 2 9 adapt 0 1.5 2.75 33\n")
    index = files.template_index(spark, str(tmp_path / "x.wti"))
    assert [tuple(r) for r in index.orderBy("row").collect()] == [(0, 7, "drift", 1, 0.0, 120.5, 540, None), (1, 7, "drift", 0, 120.5, 241.25, 0, 0), (2, 9, "adapt", 0, 1.5, 2.75, 33, None)]
    assert {(r.unit, r.link): r.rows for r in files.series(index).collect()} == {(7, "drift"): [1, 0], (9, "adapt"): [2]}
    (tmp_path / "x.wtl").write_text("wtl 1\nnNodes 3\n# node\nnode 0 7 root -1 0.0 120.5 3 3 5 8\nnode 1 7 leaf 0 1.5 2.75 0\nnode 2 9 leaf -1 241.25 360.0 2 0 1\nmean 0\n")
    lineage = files.template_lineage(spark, str(tmp_path / "x.wtl"))
    assert [(r.node, r["class"], r.parent, r.n_spikes, r.spikes) for r in lineage.orderBy("node").collect()] == [(0, 7, None, 3, [3, 5, 8]), (1, 7, 0, 0, []), (2, 9, None, 2, [0, 1])]
    assert {r.node: r.children for r in files.children(lineage).collect()} == {0: [1], 1: [], 2: []}


def test_tails(spark):
    from math import comb, exp, factorial

    at = spark.range(1).select(F.lit(37).alias("k"), F.lit(60).alias("n"))
    got = at.select(A.even_split_tail(F.col("k"), F.col("n")).alias("e"), A.poisson_tail(F.col("k"), 30.0).alias("p"), A.chi_square_tail(F.lit(70.0), 64).alias("c"), A.poisson_tail(F.lit(0), 3.0).alias("z")).first()
    assert abs(got.e - sum(comb(60, i) for i in range(37, 61)) / 2**60) < 1e-12 and got.z == 1
    assert abs(got.p - (1 - sum(exp(-30) * 30**i / factorial(i) for i in range(37)))) < 1e-12
    assert abs(got.c - sum(exp(-35) * 35**i / factorial(i) for i in range(32))) < 1e-12


def test_covariance_of_large_means(spark):
    x = np.random.default_rng(5).normal(1e8, 1.0, (500, 3))
    _, mean, cov = models.gram(spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>"), "v", 3)
    assert np.allclose(mean, x.mean(0), rtol=1e-14) and np.allclose(cov, np.cov(x.T), atol=1e-6)


def test_changed_with_equal_sums(spark):
    from wavemill.operators import curation

    before = spark.createDataFrame([(1, 5), (4, 5), (2, 6), (3, 6)], "spike_id long, cluster long")
    after = spark.createDataFrame([(2, 5), (3, 5), (1, 6), (4, 6)], "spike_id long, cluster long")
    assert {tuple(r) for r in curation.changed(before, after).collect()} == {(5, "changed"), (6, "changed")}


def test_streams(spark, small, tmp_path):
    src = str(tmp_path / "in")
    spark.read.parquet(f"{small}/events.parquet").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("grp"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t")).write.parquet(src)
    batch = spark.read.parquet(src)

    def out(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name)

    stream = events.read(spark, src, "at timestamp, grp string, t long")
    got = out(events.rates(stream, "1 day", "1 hour"), "rates", "complete")
    want = batch.groupBy("grp", F.window("at", "1 day").start.alias("start")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    kept = out(events.refractory(stream, 20000), "kept", "append")
    last, n = {}, 0
    for r in batch.orderBy("grp", "t").collect():
        if r.grp not in last or r.t - last[r.grp] > 20000:
            last[r.grp], n = r.t, n + 1
    assert kept.count() == n
    assert out(events.bursts(stream, "2 hours", "1 hour"), "bursts", "complete").agg(F.sum("n")).first()[0] == batch.count()


def test_overlapping_pairs(spark):
    r = random.Random(2)
    rows = [(i if i % 40 else None, r.choice([0, 1, None]), a := r.randint(-300, 300), a + r.choice([0, 1, 7, 64, 500])) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, grp long, a long, b long")
    found = timing.overlaps(df, "grp", 64)
    want = sorted(
        (i, j, min(b, d) - max(a, c), max(b, d) - min(a, c))
        for i, g, a, b in rows for j, h, c, d in rows if None not in (i, j, g) and g == h and i < j and a < b and c < d and min(b, d) > max(a, c)
    )
    assert sorted(map(tuple, found.collect())) == want
    # only one side of the join lies in all of its buckets: a pair is formed once
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_overlapping_pairs_in_chunks(spark):
    r = random.Random(5)
    rows = [(i, i % 3, a := r.randint(-4000, 4000), a + r.choice([1, 3, 40, 900, 70000])) for i in r.sample(range(1000), 400)]
    found = timing.overlaps(spark.createDataFrame(rows, "id long, grp long, a long, b long"), "grp", 500, size=16, run=5)
    want = sorted((i, j, min(b, d) - max(a, c), max(b, d) - min(a, c)) for i, g, a, b in rows for j, h, c, d in rows if g == h and i < j and min(b, d) > max(a, c))
    assert sorted(map(tuple, found.collect())) == want


def test_overlapping_pairs_take_few_bytes(spark, small, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    copies = adapters.table(spark, small, "orders").crossJoin(spark.range(30).withColumnRenamed("id", "k")).withColumn("o_custkey", F.col("o_custkey") + 160 * F.col("k")).drop("k")
    copies.write.parquet(f"{tmp_path}/orders.parquet")
    catalogue.QUERIES["interval_iou"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet/*.parquet'")
    db.execute(f"CREATE TABLE found AS FROM '{tmp_path}/out/*.parquet'")
    db.execute(f"CREATE TABLE want AS {catalogue.ORACLE_SQL['interval_iou']}")
    count = lambda of: db.execute(f"SELECT count(*) FROM {of}").fetchone()[0]
    n = count("found")
    assert n == count("want") == count("found f JOIN want w ON f.a = w.a AND f.b = w.b AND f.overlap = w.overlap AND abs(f.iou - w.iou) < 1e-9")
    assert size < 1.2 * n


def test_share(spark):
    pairs = spark.range(1, 700).select(F.col("id").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    assert pairs.filter(A.share(F.col("k"), F.col("n"), 6) != F.round(F.col("k") / F.col("n"), 6)).count() == 0
