"""Queries that split, join and correct units. SQL can't express most of them; tests hold them against plain loops and planted units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adaptation as N
from ..operators import artefacts as A
from ..operators import cem as E
from ..operators import cores as C
from ..operators import dips as D
from ..operators import drift as Q
from ..operators import forests as L
from ..operators import geometry as G
from ..operators import models as M
from ..operators import reassign as R
from ..operators import timing as T
from ..operators import variational as V
from ..sources.adapters import CHANNELS, features, spikes, sql, traces
from .registry import query

SIZE = 64


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Features whose units are taken two by two, so that there is something to split."""
    return features(spark, d).withColumn("cluster", F.expr("cluster div 2"))


@query()
def dip_splits(spark: SparkSession, d: str) -> DataFrame:
    """Units taken two by two, split again where their density has a valley: each spike's half."""
    halves, _ = D.dip_split(_pairs(spark, d), "fet", SIZE, D.Dip(depth=0.05))
    return halves


@query()
def dip_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What the chain of gates decides of each pair of units."""
    _, decided = D.dip_split(_pairs(spark, d), "fet", SIZE, D.Dip(depth=0.05, bloat=0.9, elongation=3.0))
    return decided.select("cluster", "n", "reason", F.round("depth", 6).alias("depth"), "left", "right", F.round(F.col("bic1") - F.col("bic2"), 3).alias("gain"))


#: Samples of the stand-in waveforms lie 50 microseconds apart.
_CORE = C.Core(least=40)


@query()
def core_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Each spike's place in its unit's order of least change, and whether it is of the unit's core."""
    rows, _ = C.core_cut(features(spark, d), "fet", CHANNELS, _CORE)
    return rows.select("spike_id", "cluster", "keep", "rank", F.round("step", 3).alias("step"))


@query()
def core_units(spark: SparkSession, d: str) -> DataFrame:
    """How many spikes of each unit were ordered and kept."""
    return C.core_cut(features(spark, d), "fet", CHANNELS, _CORE)[1]


def _timed_scores(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d)
    mean, _, vectors = M.components(f, "fet", SIZE, 3)
    times = spikes(spark, d).select("spike_id", "t", "grp")
    return M.project(f, "fet", mean, vectors).select("spike_id", "cluster", "scores").join(times, "spike_id")


@query()
def noise_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classification EM with a class for noise and deletion by loss on the first three components: class, second best class and margin."""
    f = _timed_scores(spark, d).select("spike_id", "scores")
    found = E.classified(f, "scores", 3, E.fit(f, "scores", 3, E.Rules(classes=8, rounds=20)))
    return found.select("spike_id", "class", "second", F.round("margin", 4).alias("margin"))


@query()
def chunked_units(spark: SparkSession, d: str) -> DataFrame:
    """Classification EM on overlapping chunks of two weeks, joined through time."""
    f = _timed_scores(spark, d)
    found = E.chunked_cem(f, "grp", "scores", 3, E.Chunking(length=14 * 86400.0, overlap=4 * 86400.0), E.Rules(classes=4, merge=True))
    return found.select("spike_id", "grp", "t", "chunk", "class", "label")


def _worn(spark: SparkSession, d: str) -> tuple[DataFrame, list[R.Worn]]:
    fast, slow = (0.4, 43200.0), (0.1, 432000.0)
    h = features(spark, d).join(spikes(spark, d).select("spike_id", "t"), "spike_id")
    left = T.depression(h, {"fast": fast, "slow": slow}).select("spike_id", (1 - F.col("fast")).alias("u"), (1 - F.col("slow")).alias("v"))
    e = h.join(left, "spike_id").select("cluster", "u", "v", F.posexplode("fet").alias("d", "x"))
    planes = Q.plane(e, ["cluster", "d"], "x", "u", "v").select("cluster", "d", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("c0", "c1", "c2")]).toPandas()  # a row for each unit and place
    units = [R.Worn(int(c), own.sort_values("d")[["c0", "c1", "c2"]].to_numpy(float).T, fast, slow) for c, own in planes[planes["cluster"] > 1].groupby("cluster")]
    return h, units


@query()
def reassigned_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Weak spikes that another unit's worn waveform fits better, none within a minute of a spike of that unit."""
    h, units = _worn(spark, d)
    moves = R.reassigned(h.withColumn("all", F.lit(0)), ["all"], "fet", CHANNELS, units, R.Moves(veto=60))
    return moves.select("spike_id", "cluster", "to", F.round("gain", 4).alias("gain"))


#: Features with times from 0, three stretches of time and leaves of a week.
_FOREST = """, o AS (SELECT f.cluster AS class, CAST(s.t AS DOUBLE) AS t, f.fet[1] AS x0, f.fet[2] AS x1 FROM features f JOIN spikes s ON f.spike_id = s.spike_id), e AS (SELECT min(t) AS t0, max(t) - min(t) AS z FROM o),
    p AS (SELECT class, t - t0 AS t, x0, x1, z, len(list_filter([1, 2], lambda i: z * i / 3 <= t - t0)) AS region, CAST(floor((t - t0) / 604800) AS BIGINT) AS k FROM o, e),
    c AS (SELECT DISTINCT class FROM o), r AS (SELECT c.class, i AS region, z * i / 3 AS a, z * (i + 1) / 3 AS b FROM c, e, range(3) g(i)),
    u AS (SELECT r.class, r.region, 0 AS leaf, NULL AS k, a, b, count(p.t) AS n, avg(x0) AS m0, avg(x1) AS m1, stddev_pop(x0) AS s0, stddev_pop(x1) AS s1 FROM r LEFT JOIN p ON p.class = r.class AND p.region = r.region GROUP BY ALL
        UNION ALL SELECT class, region, 1, k, k * 604800.0, (k + 1) * 604800.0, count(*), avg(x0), avg(x1), stddev_pop(x0), stddev_pop(x1) FROM p GROUP BY class, region, k),
    v AS (SELECT *, row_number() OVER (ORDER BY class, leaf, region, k) - 1 AS node FROM u),
    forest AS (SELECT v.node, v.class, CASE WHEN v.leaf = 1 THEN 'leaf' ELSE 'drift-root' END AS kind, CASE WHEN v.leaf = 1 THEN w.node END AS parent, v.a, v.b, v.n, v.m0, v.m1, v.s0, v.s1 FROM v JOIN v w ON w.leaf = 0 AND w.class = v.class AND w.region = v.region)"""
_NODES = "node, class, kind, parent, round(a, 3) AS a, round(b, 3) AS b, n, round(m0, 4) AS m0, round(m1, 4) AS m1, round(s0, 4) AS s0, round(s1, 4) AS s1"


def _forest(spark: SparkSession, d: str) -> tuple[DataFrame, float]:
    rows = features(spark, d).join(spikes(spark, d).select("spike_id", "t"), "spike_id")
    first, last = rows.agg(F.min("t"), F.max("t")).first()
    rows = rows.select(F.col("cluster").alias("class"), (F.col("t") - first).alias("t"), F.transform(F.slice("fet", 1, 2), lambda x: x.cast("double")).alias("x"))
    return L.grown(rows, L.uniform(float(last - first), 3), float(last - first), 604_800.0), float(last - first)


def _told(forest: DataFrame) -> DataFrame:
    numbers = [F.round(F.get(c, i), 4).alias(f"{c[0]}{i}") for c in ("mean", "std") for i in (0, 1)]
    return forest.select("node", "class", "kind", "parent", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), "n", *numbers)


@query(sql(_FOREST + f" SELECT {_NODES} FROM forest", "features", "spikes"))
def template_forest(spark: SparkSession, d: str) -> DataFrame:
    """Every unit's template in three stretches of time, and below them week by week."""
    return _told(_forest(spark, d)[0])


@query(sql(_FOREST + f""", j AS (SELECT class, min(node) AS first FROM forest GROUP BY class), q AS (SELECT j.class, j.first, g.region, z * g.lo AS a, z * g.hi AS b FROM j, e, (VALUES (0, 0.0, 0.2), (1, 0.2, 2.0 / 3), (2, 2.0 / 3, 1.0)) g(region, lo, hi)),
    old AS (SELECT * FROM forest WHERE kind = 'drift-root'), y AS (SELECT q.class, q.region, sum(old.n) AS n, sum(old.n * m0) / sum(old.n) AS m0, sum(old.n * m1) / sum(old.n) AS m1,
        sqrt(greatest(0, sum(old.n * (s0 * s0 + m0 * m0)) / sum(old.n) - (sum(old.n * m0) / sum(old.n)) ** 2)) AS s0, sqrt(greatest(0, sum(old.n * (s1 * s1 + m1 * m1)) / sum(old.n) - (sum(old.n * m1) / sum(old.n)) ** 2)) AS s1
        FROM q JOIN old ON old.class = q.class AND old.a < q.b AND old.b > q.a WHERE old.n > 0 GROUP BY ALL),
    home AS (SELECT old.node, arg_max(q.region, (round(greatest(0, least(old.b, q.b) - greatest(old.a, q.a)), 3), -q.region)) AS region FROM old JOIN q ON old.class = q.class GROUP BY old.node),
    n1 AS (SELECT q.class, q.first, 'drift-root' AS kind, q.region, NULL AS was, q.a, q.b, coalesce(y.n, 0) AS n, m0, m1, s0, s1 FROM q LEFT JOIN y ON y.class = q.class AND y.region = q.region
        UNION ALL SELECT f.class, j.first, f.kind, home.region, f.node, f.a, f.b, f.n, m0, m1, s0, s1 FROM forest f JOIN j ON j.class = f.class JOIN home ON home.node = f.parent WHERE f.kind = 'leaf'),
    n2 AS (SELECT *, row_number() OVER (ORDER BY first, was IS NOT NULL, coalesce(was, region)) - 1 AS node FROM n1),
    n3 AS (SELECT x.*, CASE WHEN x.was IS NOT NULL THEN w.node END AS parent FROM n2 x JOIN n2 w ON w.was IS NULL AND w.class = x.class AND w.region = x.region) SELECT {_NODES.replace("n, round", "CAST(n AS BIGINT) AS n, round", 1)} FROM n3""", "features", "spikes"))
def regrained_forest(spark: SparkSession, d: str) -> DataFrame:
    """The same forest over other stretches: one cut in two, the rest of it joined to the next."""
    forest, end = _forest(spark, d)
    return _told(L.regrained(forest, [end * 0.2, end * (2.0 / 3)], end))


@query()
def artefact_free(spark: SparkSession, d: str) -> DataFrame:
    """The record without the component that all channels share most evenly, and that component."""
    t = traces(spark, d)
    out = A.removed(t, A.common(t, 4))
    return out.select("session", "sample", F.round("artefact", 4).alias("artefact"), *[F.round(F.get("xs", i), 4).alias(f"c{i}") for i in range(4)])


@query()
def artefact_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Where the shared component's envelope rises over its usual size."""
    t = traces(spark, d)
    how = A.Finding(threshold=1.0, envelope=5, reach=10, refractory=15)
    return A.bursts(A.removed(t, A.common(t, 4, how)), how).select("session", "sample", F.round("height", 4).alias("height"))


@query()
def variational_classes(spark: SparkSession, d: str) -> DataFrame:
    """A mixture on the first three components that finds how many classes it needs."""
    f = _timed_scores(spark, d).select("spike_id", "scores")
    prior = V.Prior(classes=6, rounds=25)
    return V.classified(f, "scores", 3, V.fit(f, "scores", 3, prior), prior).select("spike_id", "class", F.round("share", 4).alias("share"))


@query()
def channel_coherence(spark: SparkSession, d: str) -> DataFrame:
    """How coherent every two channels are in two bands, from windows of 64 samples."""
    spectra, windows = G.cross_spectra(traces(spark, d), 4, 64, 32)
    rows = []
    for band, low, high in (("low", 0.02, 0.15), ("high", 0.15, 0.5)):
        c = G.coherence(spectra, low, high)
        rows += [(a, b, band, windows, round(float(c[a, b]), 6)) for a in range(4) for b in range(a + 1, 4)]
    return spark.createDataFrame(rows, "a long, b long, band string, windows long, coherence double")


@query()
def site_places(spark: SparkSession, d: str) -> DataFrame:
    """Where the sites of the waveforms may lie: places whose distances follow how alike the sites' events are in size and shape."""
    sizes, shapes = G.event_likeness(features(spark, d), "fet", CHANNELS)
    places, stress = G.placed(G.unlike({"size": sizes, "shape": shapes}, {"size": 1.0, "shape": 1.0}), CHANNELS)
    return spark.createDataFrame([(c, round(float(x), 3), round(float(y), 3), round(stress, 6)) for c, (x, y) in enumerate(places)], "ch long, x double, y double, stress double")


#: Parts used and time constants that are tried.
_FAST, _SLOW = [(0.4, 21_600.0), (0.4, 43_200.0), (0.2, 43_200.0)], [(0.1, 216_000.0), (0.1, 432_000.0)]


@query()
def adaptation_constants(spark: SparkSession, d: str) -> DataFrame:
    """The time constants under which each unit's history explains its waveforms best."""
    h = features(spark, d).join(spikes(spark, d).select("spike_id", "t"), "spike_id")
    return N.fitted(h, "fet", SIZE, _FAST, _SLOW).withColumn("left", F.round("left", 6))
