"""Queries on templates that move: matrices of units, probe drift, merge criteria, adaptation and corrected waveforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import curation as C
from ..operators import orders as O
from ..operators import drift as D
from ..operators import timing as T
from ..sources.adapters import CHANNELS, feature_values, features, spikes, sql, traces, waveform_values
from .registry import QUERIES, query

#: Micrometres between sites.
PITCH = 20


def _list(by: str, name: str, *order: str) -> Column:
    """A group's values in order as an array; groups have a row per place."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, by))), lambda p: p[by]).alias(name)


@query(sql(""", m AS (SELECT cluster, d, avg(x) AS m, var_pop(x) AS v FROM fx GROUP BY ALL), n AS (SELECT cluster, avg(v) AS noise FROM m GROUP BY cluster), g AS (SELECT a.cluster AS a, b.cluster AS b, avg((a.m - b.m) ** 2) AS gap FROM m a JOIN m b ON a.d = b.d GROUP BY ALL)
    SELECT g.a, g.b, round(CASE WHEN g.a = g.b THEN noise WHEN noise + gap > 0 THEN gap / (noise + gap) ELSE 0 END, 4) AS score FROM g JOIN n ON n.cluster = g.a""", "fx"))
def separability_matrix(spark: SparkSession, d: str) -> DataFrame:
    """How much of a unit's residual to another's template is the templates' difference; on the diagonal its own variance."""
    m = feature_values(spark, d).groupBy("cluster", "d").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    a, b = m.select("d", F.col("cluster").alias("a"), F.col("m").alias("ma"), "v"), m.select("d", F.col("cluster").alias("b"), F.col("m").alias("mb"))
    g = a.join(b, "d").groupBy("a", "b").agg(F.avg((F.col("ma") - F.col("mb")) * (F.col("ma") - F.col("mb"))).alias("gap"), F.avg("v").alias("noise"))
    total = F.col("noise") + F.col("gap")
    score = F.when(F.col("a") == F.col("b"), F.col("noise")).when(total > 0, F.col("gap") / total).otherwise(0.0)
    return g.select("a", "b", F.round(score, 4).alias("score"))


@query(sql(""", m AS (SELECT cluster, s, ch, avg(x) AS m FROM wx GROUP BY ALL), v AS (SELECT cluster, list(m ORDER BY ch, s) AS v FROM m GROUP BY cluster),
    w AS (SELECT cluster, v, list_transform(range(0, 64), lambda p: CASE WHEN p >= 16 THEN 0.25 * v[p - 15] + 0.75 * v[p - 7] ELSE 0 END) AS up, list_transform(range(0, 64), lambda p: CASE WHEN p < 48 THEN 0.75 * v[p + 9] + 0.25 * v[p + 17] ELSE 0 END) AS down FROM v),
    p AS (SELECT a.cluster AS a, b.cluster AS b, CASE WHEN a.cluster < b.cluster THEN a.up ELSE a.down END AS x, b.v AS y FROM w a JOIN w b ON a.cluster <> b.cluster)
    SELECT a, b, round(list_max(list_transform(range(-2, 3), lambda l: abs(list_cosine_similarity(x[greatest(1, 1 - l):least(64, 64 - l)], y[greatest(1, 1 + l):least(64, 64 + l)])))), 6) AS match FROM p""", "wx"))
def drift_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Units compared after the first has moved 1.25 sites along the probe, up before later units and down before earlier ones: the largest cosine over two samples either way."""
    m = waveform_values(spark, d).groupBy("cluster", "s", "ch").agg(F.avg("x").alias("m")).groupBy("cluster").agg(_list("m", "v", "ch", "s"))
    a, b = m.select(F.col("cluster").alias("a"), F.col("v").alias("x")), m.select(F.col("cluster").alias("b"), F.col("v").alias("y"))
    moved = lambda by: A.along_depth(F.col("x"), F.lit(by), CHANNELS, lambda p: p % 8, lambda p, ch: ch * 8 + p % 8)
    p = a.join(b, F.col("a") != F.col("b")).withColumn("x", F.when(F.col("a") < F.col("b"), moved(1.25)).otherwise(moved(-1.25)))
    at = lambda lag: F.abs(A.cosine(F.slice("x", max(1, 1 - lag), 64 - abs(lag)), F.slice("y", max(1, 1 + lag), 64 - abs(lag))))
    return p.select("a", "b", F.round(F.greatest(*[at(lag) for lag in range(-2, 3)]), 6).alias("match"))


SENSITIVE = """, w AS (SELECT cluster, spike_id, ch, max(x) - min(x) AS p FROM wx GROUP BY ALL), p AS (SELECT cluster, ch, avg(p) AS p FROM w GROUP BY ALL), t AS (SELECT *, max(p) OVER (PARTITION BY cluster) AS top FROM p), a AS (SELECT cluster, ch, p / sqrt(sum(p * p) OVER (PARTITION BY cluster)) AS p FROM t WHERE p > 0.1 * top),
    g AS (SELECT cluster, (coalesce(lead(p) OVER w, p) - coalesce(lag(p) OVER w, p)) / (20.0 * greatest(1, coalesce(lead(ch) OVER w, ch) - coalesce(lag(ch) OVER w, ch))) AS g FROM a WINDOW w AS (PARTITION BY cluster ORDER BY ch)) SELECT cluster, round(CASE WHEN count(*) < 3 THEN 0 ELSE sqrt(sum(g * g)) END, 8) AS sensitivity FROM g GROUP BY cluster"""


@query(sql(SENSITIVE, "wx"))
def profile_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """How much a unit's profile of swings, at unit length, changes along the probe: central differences, one-sided at the ends, over sites above a tenth of the peak."""
    p = waveform_values(spark, d).groupBy("cluster", "spike_id", "ch").agg((F.max("x") - F.min("x")).alias("p")).groupBy("cluster", "ch").agg(F.avg("p").alias("p"))
    unit = Window.partitionBy("cluster")
    w = unit.orderBy("ch")
    a = p.withColumn("top", F.max("p").over(unit)).filter("p > 0.1 * top").withColumn("p", F.col("p") / F.sqrt(F.sum(F.col("p") * F.col("p")).over(unit)))
    edge = lambda f, c: F.coalesce(f(c).over(w), F.col(c))
    g = (edge(F.lead, "p") - edge(F.lag, "p")) / (float(PITCH) * F.greatest(F.lit(1), edge(F.lead, "ch") - edge(F.lag, "ch")))
    size = F.when(F.count("*") < 3, 0.0).otherwise(F.sqrt(F.sum(F.col("g") * F.col("g"))))
    return a.select("cluster", g.alias("g")).groupBy("cluster").agg(F.round(size, 8).alias("sensitivity"))


PROFILES = """, sw AS (SELECT cluster, spike_id, spike_id // 100 AS win, ch, max(x) - min(x) AS p FROM wx GROUP BY ALL), pc AS (SELECT cluster, win, ch, avg(p) AS p, count(*) AS n FROM sw GROUP BY ALL), pr AS (SELECT cluster, win, list(p ORDER BY ch) AS p, any_value(n) AS n FROM pc GROUP BY ALL),
    pj AS (SELECT w.cluster, w.win, least(r.n, w.n) AS n, list_transform(r.p, lambda x: x / sqrt(list_dot_product(r.p, r.p))) AS r, list_transform(w.p, lambda x: x / sqrt(list_dot_product(w.p, w.p))) AS w FROM pr w JOIN pr r ON r.cluster = w.cluster AND r.win = 0),
    cc AS (SELECT *, list_transform(range(-7, 8), lambda l: round(list_dot_product(r[greatest(1, 1 + l):least(8, 8 + l)], w[greatest(1, 1 - l):least(8, 8 - l)]), 9)) AS c FROM pj), pk AS (SELECT *, list_position(c, list_max(c)) AS k FROM cc),
    us AS (SELECT cluster, win, n, round(20 * (k - 8 + CASE WHEN k BETWEEN 2 AND 14 AND 2 * c[k] - c[k - 1] - c[k + 1] > 1e-9 THEN (c[k + 1] - c[k - 1]) / (2 * (2 * c[k] - c[k - 1] - c[k + 1])) ELSE 0 END), 2) AS shift FROM pk),
    cu AS (SELECT *, sum(n) OVER (PARTITION BY cluster % 3, win ORDER BY shift, cluster) AS up, sum(n) OVER (PARTITION BY cluster % 3, win) AS total FROM us), pd AS (SELECT cluster % 3 AS shank, win, min(shift) FILTER (2 * up >= total) AS drift, count(*) AS units FROM cu GROUP BY ALL) """


@query(sql(PROFILES + "SELECT shank, win, drift, units FROM pd", "wx"))
def probe_drift(spark: SparkSession, d: str) -> DataFrame:
    """How far the units of a shank (those of one remainder) lie from where they were in the first window of a hundred spikes: each unit's profile of swings against its first by correlation with a parabola at the peak, then the median weighted by the smaller number of spikes."""
    p = waveform_values(spark, d).withColumn("win", F.expr("spike_id div 100")).groupBy("cluster", "spike_id", "win", "ch").agg((F.max("x") - F.min("x")).alias("p"))
    p = p.groupBy("cluster", "win", "ch").agg(F.avg("p").alias("p"), F.count("*").alias("n")).groupBy("cluster", "win").agg(_list("p", "w", "ch"), F.first("n").alias("n"))
    return D.profile_drift(p, PITCH).withColumn("shank", F.col("cluster") % 3).transform(lambda u: D.lower_weighted_median(u, ["shank", "win"], "shift", "n")).select("shank", "win", F.col("shift").alias("drift"), "units")


@query(sql(PROFILES + """, rf AS (SELECT shank, greatest(1, max(units) FILTER (win = 0)) AS weight FROM pd GROUP BY shank), mw AS (SELECT win, sum(drift * weight) / sum(weight) AS mean FROM pd JOIN rf USING (shank) GROUP BY win)
    SELECT pd.win, round(any_value(mean), 3) AS drift, count(*) AS shanks, round(CASE WHEN count(*) < 2 THEN 0 ELSE sqrt(avg((drift - mean) ** 2)) END, 3) AS spread FROM pd JOIN mw ON mw.win = pd.win GROUP BY pd.win""", "wx"))
def shank_average(spark: SparkSession, d: str) -> DataFrame:
    """The drift of all shanks of a probe: a mean weighted by the units of the first window, with the plain deviation around it."""
    p = QUERIES["probe_drift"](spark, d)
    weight = p.groupBy("shank").agg(F.greatest(F.lit(1), F.coalesce(F.max(F.when(F.col("win") == 0, F.col("units"))), F.lit(1))).alias("weight"))
    at = Window.partitionBy("win")
    p = p.join(weight, "shank").withColumn("mean", F.sum(F.col("drift") * F.col("weight")).over(at) / F.sum("weight").over(at))
    off = F.col("drift") - F.col("mean")
    return p.groupBy("win").agg(F.round(F.first("mean"), 3).alias("drift"), F.count("*").alias("shanks"), F.round(F.when(F.count("*") < 2, 0.0).otherwise(F.sqrt(F.avg(off * off))), 3).alias("spread"))


@query(sql(PROFILES + """, cw AS (SELECT features.spike_id, fet, drift / 20 AS mv FROM features JOIN pd ON pd.shank = features.cluster % 3 AND pd.win = features.spike_id // 100),
    mo AS (SELECT spike_id, list_transform(range(0, 64), lambda p: CASE WHEN p % 8 - mv < 0 OR p % 8 - mv > 7 THEN 0 ELSE (1 - (p % 8 - mv - floor(p % 8 - mv))) * fet[CAST(p // 8 * 8 + floor(p % 8 - mv) AS BIGINT) + 1] + (p % 8 - mv - floor(p % 8 - mv)) * fet[CAST(p // 8 * 8 + least(7, floor(p % 8 - mv) + 1) AS BIGINT) + 1] END) AS v FROM cw)
    SELECT spike_id, round(list_sum(v), 6) AS total, round(list_max(v), 6) AS top, round(v[20], 6) AS twentieth FROM mo""", "wx"))
def drift_corrected(spark: SparkSession, d: str) -> DataFrame:
    """Every waveform moved along the probe by its window's drift, by linear interpolation between sites; zero from outside."""
    drift = QUERIES["probe_drift"](spark, d).select("shank", "win", (F.col("drift") / PITCH).alias("by"))
    f = features(spark, d).withColumn("shank", F.col("cluster") % 3).withColumn("win", F.expr("spike_id div 100")).join(drift, ["shank", "win"])
    v = f.select("spike_id", A.along_depth(F.col("fet"), F.col("by"), CHANNELS, lambda p: F.floor(p / 8), lambda p, ch: F.floor(p / 8) * 8 + ch, lambda p: p % 8).alias("v"))
    return v.select("spike_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.array_max("v"), 6).alias("top"), F.round(F.get("v", 19), 6).alias("twentieth"))


CRITERIA = """, m AS (SELECT cluster, s, ch, avg(x) AS m, stddev_pop(x) AS sd FROM wx GROUP BY ALL), c AS (SELECT cluster, ch, max(m) - min(m) AS ptp, max(sd) FILTER (s = 4) AS sd FROM m GROUP BY ALL),
    u AS (SELECT cluster, arg_max(ch, (round(ptp, 6), -ch)) AS top, sum(ptp * ptp * ch) / sum(ptp * ptp) * 20 AS y FROM c GROUP BY cluster), ti AS (SELECT cluster, min(spike_id) AS t0, max(spike_id) AS t1, sum(spike_id) // count(*) // 250 AS chunk FROM features GROUP BY cluster),
    k AS (SELECT unnest(range(-2, 3)) AS k), xc AS (SELECT a.cluster AS a, b.cluster AS b, k, sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)) AS c FROM m a, k, m b WHERE a.cluster < b.cluster AND a.ch = b.ch AND b.s = (a.s + k + 8) % 8 GROUP BY ALL), xm AS (SELECT a, b, max(c) AS xcorr, max(c) FILTER (k = 0) AS cosw FROM xc GROUP BY ALL),
    al AS (SELECT a.cluster AS a, b.cluster AS b, a.ch, sum(a.m * b.m) / sum(a.m * a.m) AS alpha FROM m a JOIN m b ON a.ch = b.ch AND a.s = b.s AND a.cluster < b.cluster WHERE a.s BETWEEN 2 AND 5 GROUP BY ALL),
    pc AS (SELECT al.*, x.ptp AS pa, y.ptp AS pb, x.sd AS sa, y.sd AS sb, max(greatest(x.ptp, y.ptp)) OVER (PARTITION BY a, b) AS most FROM al JOIN c x ON x.cluster = a AND x.ch = al.ch JOIN c y ON y.cluster = b AND y.ch = al.ch),
    fp AS (SELECT a, b, sum(pa * pb) / sqrt(sum(pa * pa) * sum(pb * pb)) AS cosfp FROM pc GROUP BY ALL), sg AS (SELECT *, abs(alpha - lag(alpha) OVER (PARTITION BY a, b ORDER BY ch)) AS step FROM pc WHERE least(pa, pb) >= 0.3 * most),
    st AS (SELECT a, b, count(*) AS n, min(alpha) AS low, max(alpha) AS high, CASE WHEN count(*) >= 3 THEN sum(step) / (avg(abs(alpha)) + 1e-9) ELSE 0 END AS rough, max(greatest(sa, sb) / greatest(least(sa, sb), 1e-6)) AS sdr FROM sg GROUP BY ALL),
    pa AS (SELECT st.*, cosw, xcorr, cosfp, x.top = y.top AS same, abs(x.y - y.y) AS drift, greatest(0, least(i.t1, j.t1) - greatest(i.t0, j.t0)) / greatest(1, greatest(i.t1, j.t1) - least(i.t0, j.t0)) AS iou, least(i.chunk, j.chunk) AS c0, greatest(i.chunk, j.chunk) AS c1
        FROM st JOIN xm USING (a, b) JOIN fp USING (a, b) JOIN u x ON x.cluster = st.a JOIN u y ON y.cluster = st.b JOIN ti i ON i.cluster = st.a JOIN ti j ON j.cluster = st.b),
    tr AS (SELECT *, CASE WHEN NOT (cosw >= 0 AND cosfp >= 0.8 AND xcorr >= 0.1 AND sdr < 2 AND drift < 40 AND rough < 40) THEN 'REVIEW' WHEN iou < 0.9 THEN 'AUTO_DRIFT' WHEN iou >= 0.97 AND cosw >= 0.05 AND xcorr >= 0.05 AND drift < 20 THEN 'AUTO_OVERSPLIT' ELSE 'REVIEW_PARTIAL_OVERLAP' END AS tier FROM pa)
    SELECT a, b, n AS channels, round(cosw, 6) AS cosw, round(cosfp, 6) AS cosfp, round(xcorr, 6) AS xcorr, same, low > 0 AS all_positive, round(CASE WHEN low > 0 THEN high / low END, 4) AS spread, round(sdr, 6) AS deviation_ratio, round(rough, 4) AS roughness, round(drift, 4) AS drift, round(iou, 6) AS overlap, tier FROM tr"""


#: Limits for data without structure, where gains are of any sign.
LOOSE = D.Limits(cosine=0.0, footprint=0.8, shifted=0.1, deviations=2.0, roughness=40.0, same_channel=False, positive=False, apart=0.9, together=0.97, close_cosine=0.05, close_drift=20.0, close_spread=float("inf"))


@query(sql(CRITERIA, "wx"))
def merge_criteria(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of units by all criteria of a merge: cosines of means and of footprints, shifted similarity, gains per channel with signal (sign, spread, roughness), ratio of deviations, drift and overlap in time, and the tier they give."""
    return D.merge_criteria(waveform_values(spark, d), features(spark, d), "spike_id", PITCH).withColumn("tier", D.merge_tier(LOOSE)).select(
        "a", "b", F.col("n").alias("channels"), *[F.round(c, 6).alias(c) for c in ("cosw", "cosfp", "xcorr")], "same", (F.col("low") > 0).alias("all_positive"), F.round(F.when(F.col("low") > 0, F.col("high") / F.col("low")), 4).alias("spread"),
        F.round("sdr", 6).alias("deviation_ratio"), F.round("rough", 4).alias("roughness"), F.round("drift", 4).alias("drift"), F.round("iou", 6).alias("overlap"), "tier",
    )


@query(sql(CRITERIA.replace("SELECT a, b, n AS channels", ", ad AS (SELECT a, b, round(drift, 4) AS drift, least(a % 3, b % 3) AS c0, greatest(a % 3, b % 3) AS c1 FROM tr WHERE a % 3 <> b % 3), md AS (SELECT c0, c1, count(*) AS n, median(drift) AS med FROM ad GROUP BY ALL), mm AS (SELECT c0, c1, any_value(n) AS n, any_value(med) AS med, greatest(1, median(abs(drift - med))) AS mad FROM ad JOIN md USING (c0, c1) GROUP BY ALL) SELECT a, b, round(drift, 4) AS drift, n >= 3 AND abs(drift - med) > 2 * mad AS demoted FROM ad JOIN mm USING (c0, c1) --"), "wx"))
def drift_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose drift is far from that of the other pairs between the same chunks (here: remainders of the units) are demoted; fewer than three pairs can't tell."""
    p = QUERIES["merge_criteria"](spark, d).select("a", "b", "drift", (F.col("a") % 3).alias("x"), (F.col("b") % 3).alias("y")).filter("x <> y")
    p = p.select("a", "b", "drift", F.least("x", "y").alias("c0"), F.greatest("x", "y").alias("c1"))
    return D.incoherent(p, ["c0", "c1"], "drift", 2.0).select("a", "b", F.round("drift", 4).alias("drift"), "demoted")


ADAPTED = """, h AS (SELECT f.spike_id, f.cluster, f.fet, s.t FROM features f JOIN spikes s USING (spike_id)), i AS (SELECT cluster, spike_id, fet, t - lag(t) OVER w AS isi, row_number() OVER w AS i FROM h WINDOW w AS (PARTITION BY cluster ORDER BY t, spike_id)),
    r AS (SELECT cluster, i, 1.0::DOUBLE AS fast, 1.0::DOUBLE AS slow FROM i WHERE i = 1 UNION ALL SELECT i.cluster, i.i, 1 - (1 - r.fast * 0.6) * exp(-i.isi / 43200.0), 1 - (1 - r.slow * 0.9) * exp(-i.isi / 432000.0) FROM r JOIN i ON i.cluster = r.cluster AND i.i = r.i + 1),
    e AS (SELECT i.cluster, 1 - r.fast AS u, 1 - r.slow AS v, unnest(fet) AS x, unnest(range(0, 64)) AS d FROM i JOIN r ON i.cluster = r.cluster AND i.i = r.i),
    q AS (SELECT cluster, d, avg(x) AS x, avg(u) AS u, avg(v) AS v, var_pop(u) AS uu, var_pop(v) AS vv, covar_pop(u, v) AS uv, covar_pop(u, x) AS ux, covar_pop(v, x) AS vx FROM e GROUP BY ALL), b AS (SELECT *, (ux * vv - vx * uv) / nullif(uu * vv - uv * uv, 0) AS b1, (vx * uu - ux * uv) / nullif(uu * vv - uv * uv, 0) AS b2 FROM q)
    SELECT cluster, d, round(x - b1 * u - b2 * v, 2) AS rested, round(b1, 2) AS fast, round(b2, 2) AS slow FROM b"""


@query(sql(ADAPTED, "features", "spikes", recursive=True))
def adapted_templates(spark: SparkSession, d: str) -> DataFrame:
    """How a unit's waveform depends on what it has left over two time constants: a regression at each place, with the waveform of a rested unit and its change with either depression."""
    h = features(spark, d).join(spikes(spark, d).select("spike_id", "t"), "spike_id")
    left = T.depression(h, {"fast": (0.4, 43200.0), "slow": (0.1, 432000.0)}).select("spike_id", (1 - F.col("fast")).alias("u"), (1 - F.col("slow")).alias("v"))
    e = h.join(left, "spike_id").select("cluster", "u", "v", F.posexplode("fet").alias("d", "x"))
    return D.plane(e, ["cluster", "d"], "x", "u", "v").select("cluster", F.col("d").cast("long").alias("d"), F.round("c0", 2).alias("rested"), F.round("c1", 2).alias("fast"), F.round("c2", 2).alias("slow"))


@query(sql(""", a AS (SELECT d, avg(x) FILTER (cluster = 2) AS a, avg(x) FILTER (cluster = 3) AS b FROM fx GROUP BY d), s AS (SELECT spike_id, any_value(cluster) AS cluster, sum(x * a) AS xa, sum(x * b) AS xb, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM fx JOIN a USING (d) GROUP BY spike_id)
    SELECT spike_id, cluster, round((xa * bb - xb * ab) / (aa * bb - ab * ab), 6) AS u, round((xb * aa - xa * ab) / (aa * bb - ab * ab), 6) AS v FROM s""", "fx"))
def oblique_axes(spark: SparkSession, d: str) -> DataFrame:
    """Every spike as a combination of two units' means, which need not be at right angles: the inverse of their Gram matrix."""
    f = feature_values(spark, d)
    a, b, x = F.col("a"), F.col("b"), F.col("x")
    axes = f.groupBy("d").agg(*[F.avg(F.when(F.col("cluster") == k, x)).alias(n) for k, n in ((2, "a"), (3, "b"))])
    s = f.join(F.broadcast(axes), "d").groupBy("spike_id").agg(F.first("cluster").alias("cluster"), *[F.sum(p * q).alias(n) for p, q, n in ((x, a, "xa"), (x, b, "xb"), (a, a, "aa"), (b, b, "bb"), (a, b, "ab"))])
    return s.select("spike_id", "cluster", F.round(F.expr("(xa * bb - xb * ab) / (aa * bb - ab * ab)"), 6).alias("u"), F.round(F.expr("(xb * aa - xa * ab) / (aa * bb - ab * ab)"), 6).alias("v"))


KERNEL = A.fourier_kernel(64, 0.3)


@query(sql(f""", k AS (SELECT {KERNEL}::DOUBLE[] AS g), m AS (SELECT spike_id, list_transform(range(0, 64), lambda n: list_dot_product(CAST(fet AS DOUBLE[]), g[65 - n:128 - n])) AS v FROM features, k)
    SELECT spike_id, round(v[10], 4) AS tenth, round(list_sum(v), 4) AS total, round(list_max(v), 4) AS top FROM m""", "features"))
def fourier_shift(spark: SparkSession, d: str) -> DataFrame:
    """Vectors moved by 0.3 of a place as periodic signals without loss: each output is a sum over all places with the shift's periodic kernel."""
    v = features(spark, d).select("spike_id", A.fourier_shifted(F.col("fet").cast("array<double>"), 64, 0.3).alias("v"))
    return v.select("spike_id", F.round(F.get("v", 9), 4).alias("tenth"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.round(F.array_max("v"), 4).alias("top"))


@query(sql(", p AS (SELECT spike_id, t, cluster FROM spikes WHERE value >= 50) SELECT spike_id, t, cluster, 0::BIGINT AS part FROM spikes WHERE spike_id NOT IN (SELECT spike_id FROM p) UNION ALL SELECT spike_id, t - 1, cluster, 1::BIGINT FROM p UNION ALL SELECT spike_id, t + 2, cluster + 1000, 2::BIGINT FROM p", "spikes"))
def grown_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Collisions (here: the largest values) replaced by their two events, each at its own time and unit; all others stay."""
    s = spikes(spark, d)
    plan = s.filter("value >= 50").select("spike_id", F.array(F.struct(F.lit(-1).alias("lag"), F.col("cluster").alias("unit")), F.struct(F.lit(2).alias("lag"), (F.col("cluster") + 1000).alias("unit"))).alias("parts"))
    return C.grown(s.select("spike_id", "t", "cluster"), plan)


@query(sql(""", m AS (SELECT cluster, d, avg(x) AS m FROM fx GROUP BY ALL), p AS (SELECT a.cluster AS a, b.cluster AS b, round(sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)), 6) AS score FROM m a JOIN m b ON a.d = b.d AND a.cluster < b.cluster GROUP BY ALL), y AS (SELECT score, count(*) AS n, count(*) FILTER ((a + b) % 3 = 0) AS hits FROM p GROUP BY score),
    c AS (SELECT score, sum(n) OVER w AS taken, sum(hits) OVER w AS hits, sum(hits) OVER () AS most FROM y WINDOW w AS (ORDER BY score DESC)) SELECT score AS least, CAST(taken AS BIGINT) AS taken, round(hits / taken, 6) AS precision, round(hits / most, 6) AS recall FROM c""", "fx"))
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of merging all pairs at a similarity or more, at each similarity; the truth is a stand-in for logged decisions. A row per pair of units is ranked."""
    p = QUERIES["similarity_matrix"](spark, d).filter("a < b").select(F.round("cosine", 6).alias("score"), ((F.col("a") + F.col("b")) % 3 == 0).alias("hit"))
    return C.precision_recall(p)


@query(sql(""", m AS (SELECT cluster, d, quantile_disc(x, 0.5) AS m FROM fx GROUP BY ALL), x AS (SELECT a.cluster AS a, b.cluster AS b, round(sqrt(sum((a.m - b.m) ** 2)), 6) AS gap FROM m a JOIN m b ON a.d = b.d AND a.cluster <> b.cluster GROUP BY ALL),
    r AS (SELECT min(a) AS u, [min(a)] AS seen, 1::BIGINT AS place FROM x UNION ALL SELECT nx.b, list_append(r.seen, nx.b), r.place + 1 FROM r, LATERAL (SELECT arg_min(b, (gap, b)) AS b FROM x WHERE x.a = r.u AND NOT list_contains(r.seen, x.b)) nx WHERE nx.b IS NOT NULL) SELECT u AS cluster, place FROM r""", "fx", recursive=True))
def nearest_chain(spark: SparkSession, d: str) -> DataFrame:
    """Units in a chain from the lowest id, each followed by the nearest not yet taken by the distance of median waveforms; ties to the lower id."""
    m = feature_values(spark, d).groupBy("cluster", "d").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)").alias("m"))
    a, b = m.select("d", F.col("cluster").alias("a"), F.col("m").alias("ma")), m.select("d", F.col("cluster").alias("b"), F.col("m").alias("mb"))
    gap = F.col("ma") - F.col("mb")
    return O.ordered(a.join(b, "d").filter("a <> b").groupBy("a", "b").agg(F.round(F.sqrt(F.sum(gap * gap)), 6).alias("gap")), O.nearest)


@query()
def similarity_orders(spark: SparkSession, d: str) -> DataFrame:
    """Units in the orders of single linkage, of the second eigenvector of the graph of similarities and of its first axis. SQL can't express them."""
    gap = QUERIES["similarity_matrix"](spark, d).filter("a <> b").select("a", "b", F.round(1 - F.col("cosine"), 9).alias("gap"))
    C.checkpoint_dir(spark)
    gap = gap.checkpoint()  # three orders of it
    by = [O.ordered(gap, f).withColumnRenamed("place", n) for f, n in ((O.linkage, "linkage"), (O.fiedler, "fiedler"), (O.first_axis, "axis"))]
    return by[0].join(by[1], "cluster").join(by[2], "cluster")


@query()
def recovered_cliques(spark: SparkSession, d: str) -> DataFrame:
    """Within each group of units joined by similarity, the largest set found in which all pairs are alike. SQL can't express it."""
    return O.cliques(QUERIES["similarity_matrix"](spark, d).filter("a < b AND cosine >= 0.05").select("a", "b"))


@query()
def smoothed_templates(spark: SparkSession, d: str) -> DataFrame:
    """Each unit's mean waveform by windows of a hundred spikes, made smooth over time. SQL can't express it."""
    w = feature_values(spark, d).groupBy("cluster", F.expr("spike_id div 100").alias("win"), "d").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return D.smoothed_windows(w, 5.0).select("cluster", "win", "d", F.round("x", 4).alias("x"))


@query()
def channel_groups(spark: SparkSession, d: str) -> DataFrame:
    """Channels by Ward's method on one less their correlation over all samples, groups beside each other. SQL can't express it."""
    xs = traces(spark, d)
    pairs = [(a, b) for a in range(4) for b in range(4) if a != b]
    c = xs.agg(*[F.corr(F.get("xs", a), F.get("xs", b)).alias(f"c{a}{b}") for a, b in pairs])
    gap = c.select(F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.round(1 - F.col(f"c{a}{b}"), 9).alias("gap")) for a, b in pairs])).alias("p")).select("p.*")
    return O.ordered(gap, O.grouped).withColumnRenamed("cluster", "ch")
