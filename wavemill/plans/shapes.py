"""Queries on features and waveforms of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import distances as N
from ..operators import shapes as P
from ..sources.adapters import feature_values, features, spikes, sql, waveform_values
from .registry import query


@query(sql("SELECT cluster, count(*) AS n, count(DISTINCT grp) AS groups FROM spikes GROUP BY cluster", "spikes"))
def cluster_counts(spark: SparkSession, d: str) -> DataFrame:
    return spikes(spark, d).groupBy("cluster").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("groups"))


@query(sql("SELECT cluster, s, ch, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(CASE WHEN stddev_pop(x) > 0 THEN kurtosis_pop(x) ELSE 0 END, 4) AS kurt FROM wx GROUP BY cluster, s, ch", "wx"))
def waveform_stats(spark: SparkSession, d: str) -> DataFrame:
    return waveform_values(spark, d).groupBy("cluster", "s", "ch").agg(*[F.round(c, 4).alias(k) for k, c in P.central_moments().items()])


@query(sql("SELECT cluster, s, ch, CAST(round_even(median(x), 0) AS BIGINT) AS template, count(*) AS n FROM wx GROUP BY cluster, s, ch", "wx"))
def median_waveform(spark: SparkSession, d: str) -> DataFrame:
    return waveform_values(spark, d).groupBy("cluster", "s", "ch").agg(F.rint(F.percentile("x", F.lit(0.5))).cast("long").alias("template"), F.count("*").alias("n"))


@query(sql("SELECT d, round(quantile_cont(x, 0.05), 4) AS p05, round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.95), 4) AS p95 FROM fx GROUP BY d", "fx"))
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    at = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p95": 0.95}
    return feature_values(spark, d).groupBy("d").agg(*[F.round(F.percentile("x", F.lit(p)), 4).alias(k) for k, p in at.items()])


@query(sql(""", p AS (SELECT cluster, d, spike_id % 3 AS part, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM fx GROUP BY cluster, d, part)
    SELECT cluster, d, CAST(sum(n) AS BIGINT) AS n, round(sum(n * m) / sum(n), 4) AS mean, round(sum(n * (v + m * m)) / sum(n) - power(sum(n * m) / sum(n), 2), 1) AS var FROM p GROUP BY cluster, d""", "fx"))
def running_summary(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of parts combined without the rows."""
    p = feature_values(spark, d).groupBy("cluster", "d", (F.col("spike_id") % 3).alias("part")).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    n, m = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    return p.groupBy("cluster", "d").agg(n.alias("n"), F.round(m, 4).alias("mean"), F.round(F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))) / n - m * m, 1).alias("var"))


@query(sql(""", w AS (SELECT cluster, t // 3600 AS h, count(*) AS k FROM spikes GROUP BY cluster, h), c AS (SELECT *, sum(k) OVER (PARTITION BY cluster ORDER BY h) AS run, sum(k) OVER (PARTITION BY cluster) AS total FROM w)
    SELECT cluster, min(h) AS h FROM c WHERE 2 * run >= total GROUP BY cluster""", "spikes"))
def weighted_median(spark: SparkSession, d: str) -> DataFrame:
    rows = spikes(spark, d).select("cluster", F.expr("t div 3600").alias("h"), F.lit(1).alias("k"))
    return P.weighted_median(rows, "cluster", "h", "k")


MAD = ", m AS (SELECT cluster, d, median(x) AS med FROM fx GROUP BY cluster, d), r AS (SELECT fx.cluster, fx.d, any_value(med) AS med, median(abs(x - med)) * 1.4826 AS mad FROM fx JOIN m ON fx.cluster = m.cluster AND fx.d = m.d GROUP BY fx.cluster, fx.d) "


@query(sql(MAD + "SELECT cluster, d, round(med, 4) AS med, round(mad, 4) AS mad FROM r", "fx"))
def mad_scale(spark: SparkSession, d: str) -> DataFrame:
    return P.median_and_mad(feature_values(spark, d), ["cluster", "d"]).select("cluster", "d", F.round("med", 4).alias("med"), F.round("mad", 4).alias("mad"))


@query(sql(", m AS (SELECT cluster, d, avg(x) AS m FROM fx GROUP BY cluster, d), c AS (SELECT fx.spike_id, fx.cluster, fx.d, x - m AS x FROM fx JOIN m ON fx.cluster = m.cluster AND fx.d = m.d) SELECT a.cluster, a.d AS i, b.d AS j, count(*) AS n, round(sum(a.x * b.x) / (count(*) - 1), 4) AS cov FROM c a JOIN c b ON a.spike_id = b.spike_id AND a.d <= b.d GROUP BY a.cluster, a.d, b.d", "fx"))
def cluster_covariance(spark: SparkSession, d: str) -> DataFrame:
    """All cells (i <= j) of every cluster's covariance (n - 1)."""
    return P.covariances(features(spark, d), "fet").select("cluster", "i", "j", "n", F.round("cov", 4).alias("cov"))


@query(sql("SELECT cluster, round((count(*) + CASE WHEN cluster = 0 THEN 1 ELSE 0 END) / (sum(count(*)) OVER () + 1), 9) AS weight FROM features GROUP BY cluster", "features"))
def cluster_weight(spark: SparkSession, d: str) -> DataFrame:
    counts = features(spark, d).groupBy("cluster").agg(F.count("*").alias("n"))
    total = features(spark, d).agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("cluster", F.round((F.col("n") + F.when(F.col("cluster") == 0, 1).otherwise(0)) / (F.col("total") + 1), 9).alias("weight"))


@query(sql(""", m AS (SELECT cluster, s, ch, avg(x) AS m, stddev_pop(x) AS sd FROM wx GROUP BY cluster, s, ch), c AS (SELECT cluster, ch, max(m) - min(m) AS ptp FROM m GROUP BY cluster, ch),
    z AS (SELECT cluster, median(sd) AS noise FROM m GROUP BY cluster) SELECT c.cluster, arg_max(ch, (round(ptp, 6), -ch)) AS channel, round(max(ptp), 4) AS ptp, round(max(ptp) / any_value(noise), 4) AS snr FROM c JOIN z ON c.cluster = z.cluster GROUP BY c.cluster""", "wx"))
def amplitude_snr(spark: SparkSession, d: str) -> DataFrame:
    """Peak-to-peak of the mean waveform on its largest channel, over the median deviation."""
    m = waveform_values(spark, d).groupBy("cluster", "s", "ch").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    ptp = m.groupBy("cluster", "ch").agg((F.max("m") - F.min("m")).alias("ptp"))
    top = ptp.groupBy("cluster").agg(F.max_by("ch", F.struct(F.round("ptp", 6), -F.col("ch"))).alias("channel"), F.max("ptp").alias("ptp"))
    noise = m.groupBy("cluster").agg(F.percentile("sd", F.lit(0.5)).alias("noise"))
    return top.join(noise, "cluster").select("cluster", "channel", F.round("ptp", 4).alias("ptp"), F.round(F.col("ptp") / F.col("noise"), 4).alias("snr"))


@query(sql(""", c AS (SELECT grp, cluster, count(*) AS k FROM spikes GROUP BY grp, cluster), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY k) AS i, count(*) OVER (PARTITION BY grp) AS n FROM c)
    SELECT grp, count(*) AS n, round(sum((2 * i - n - 1) * k) / (count(*) * sum(k)), 6) AS gini, max(k) AS largest FROM r GROUP BY grp""", "spikes"))
def gini(spark: SparkSession, d: str) -> DataFrame:
    return P.gini(spikes(spark, d).groupBy("grp", "cluster").agg(F.count("*").alias("k")), "grp", "k")


@query(sql(""", c AS (SELECT grp, t // 86400 AS chunk, count(*) AS n, count(DISTINCT cluster) AS k, count(*) FILTER (cluster % 10 < 2) AS noise FROM spikes GROUP BY grp, chunk)
    SELECT grp, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS total, min(k) AS min_k, round(median(k), 4) AS median_k, max(k) AS max_k, round(100 * sum(noise) / sum(n), 4) AS noise_percent FROM c GROUP BY grp""", "spikes"))
def chunk_state(spark: SparkSession, d: str) -> DataFrame:
    c = spikes(spark, d).groupBy("grp", F.expr("t div 86400").alias("chunk")).agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("k"), F.count_if(F.col("cluster") % 10 < 2).alias("noise"))
    return c.groupBy("grp").agg(F.count("*").alias("chunks"), F.sum("n").alias("total"), F.min("k").alias("min_k"), F.round(F.percentile("k", F.lit(0.5)), 4).alias("median_k"), F.max("k").alias("max_k"), F.round(100 * F.sum("noise") / F.sum("n"), 4).alias("noise_percent"))


DIAG = ", m AS (SELECT cluster AS m, d, avg(x) AS mu, var_samp(x) AS v, count(*) AS k FROM fx GROUP BY cluster, d), q AS (SELECT fx.spike_id, fx.cluster, m.m, any_value(k) AS k, sum((x - mu) * (x - mu) / v) AS dist FROM fx JOIN m ON fx.d = m.d GROUP BY fx.spike_id, fx.cluster, m.m) "


def _diagonal(spark: SparkSession, d: str) -> N.Models:
    """Each cluster's means and variances, without covariances."""
    return N.models(feature_values(spark, d), F.avg("x"), F.var_samp("x"))


@query(sql(DIAG + "SELECT spike_id, cluster, arg_min(m, (dist, m)) AS nearest, round(min(dist), 4) AS cost FROM q GROUP BY spike_id, cluster", "fx"))
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    """The cluster of the smallest diagonal Mahalanobis distance."""
    return N.nearest(features(spark, d), "fet", _diagonal(spark, d)).withColumn("cost", F.round("cost", 4))


@query(sql(DIAG + ", r AS (SELECT m, k, dist, row_number() OVER (PARTITION BY m ORDER BY dist) AS i FROM q WHERE cluster <> m AND cluster > 1) SELECT m AS cluster, round(dist, 4) AS isolation FROM r WHERE i = k", "fx"))
def isolation_distance(spark: SparkSession, d: str) -> DataFrame:
    """Per cluster of n spikes the n-th smallest distance of others' spikes, noise apart."""
    held = _diagonal(spark, d)
    found = N.kth_distances(features(spark, d).filter("cluster > 1"), "fet", held, held.count)
    return spark.createDataFrame(sorted(found.items()), "cluster long, isolation double").withColumn("isolation", F.round("isolation", 4))


@query(sql(", v AS (SELECT cluster, d, var_samp(x) AS v FROM fx GROUP BY cluster, d) SELECT cluster, round(power(sum(v), 2) / sum(v * v), 6) AS dimensions FROM v GROUP BY cluster", "fx"))
def participation_ratio(spark: SparkSession, d: str) -> DataFrame:
    v = feature_values(spark, d).groupBy("cluster", "d").agg(F.var_samp("x").alias("v"))
    return v.groupBy("cluster").agg(F.round(F.pow(F.sum("v"), 2) / F.sum(F.col("v") * F.col("v")), 6).alias("dimensions"))


@query(sql(""", g AS (SELECT d, avg(x) AS mu FROM fx GROUP BY d), c AS (SELECT fx.cluster, fx.d, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM fx GROUP BY fx.cluster, fx.d)
    SELECT c.d, round(sum(n * (m - mu) * (m - mu)) / sum(n * v), 6) AS fisher FROM c JOIN g ON c.d = g.d GROUP BY c.d""", "fx"))
def fisher_ratio(spark: SparkSession, d: str) -> DataFrame:
    f = feature_values(spark, d)
    c = f.groupBy("cluster", "d").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    c = c.join(f.groupBy("d").agg(F.avg("x").alias("mu")), "d")
    return c.groupBy("d").agg(F.round(F.sum(F.col("n") * (F.col("m") - F.col("mu")) * (F.col("m") - F.col("mu"))) / F.sum(F.col("n") * F.col("v")), 6).alias("fisher"))


@query(sql(", c AS (SELECT grp, cluster, count(*) AS k FROM spikes GROUP BY grp, cluster) SELECT grp, round(quantile_cont(k, 0.05), 4) AS p05, round(quantile_cont(k, 0.5), 4) AS p50, round(quantile_cont(k, 0.95), 4) AS p95 FROM c GROUP BY grp", "spikes"))
def count_percentiles(spark: SparkSession, d: str) -> DataFrame:
    c = spikes(spark, d).groupBy("grp", "cluster").agg(F.count("*").alias("k"))
    return c.groupBy("grp").agg(*[F.round(F.percentile("k", F.lit(p)), 4).alias(n) for n, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))])


@query(sql(""", m AS (SELECT cluster, d, avg(x) AS m, count(*) AS n FROM fx GROUP BY cluster, d), c AS (SELECT fx.cluster, fx.d, any_value(n) AS n, avg((x - m) ** 2) AS m2, avg((x - m) ** 3) AS m3, avg((x - m) ** 4) AS m4 FROM fx JOIN m ON fx.cluster = m.cluster AND fx.d = m.d GROUP BY fx.cluster, fx.d)
    SELECT cluster, d, round((m3 * m3 / (m2 * m2 * m2) + 1) / (m4 / (m2 * m2) - 3 + 3.0 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))), 6) AS bimodality FROM c""", "fx"))
def bimodality(spark: SparkSession, d: str) -> DataFrame:
    c = feature_values(spark, d).groupBy("cluster", "d").agg(F.skewness("x").alias("g"), F.kurtosis("x").alias("k"), F.count("*").alias("n"))
    n = F.col("n")
    return c.select("cluster", "d", F.round((F.col("g") * F.col("g") + 1) / (F.col("k") + 3.0 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))), 6).alias("bimodality"))


@query(sql(""", e AS (SELECT min(fet[1]) AS x0, max(fet[1]) AS x1, min(fet[2]) AS y0, max(fet[2]) AS y1 FROM features)
    SELECT (fet[1] - x0) * 255 // (x1 - x0) AS x, (fet[2] - y0) * 255 // (y1 - y0) AS y, count(*) AS n FROM features, e GROUP BY ALL""", "features"))
def histogram2d(spark: SparkSession, d: str) -> DataFrame:
    """A grid of 256 x 256 over two features."""
    f = features(spark, d).select(F.get("fet", 0).alias("a"), F.get("fet", 1).alias("b"))
    e = f.agg(F.min("a").alias("x0"), F.max("a").alias("x1"), F.min("b").alias("y0"), F.max("b").alias("y1"))
    return f.join(F.broadcast(e)).groupBy(F.expr("(a - x0) * 255 div (x1 - x0)").alias("x"), F.expr("(b - y0) * 255 div (y1 - y0)").alias("y")).agg(F.count("*").alias("n"))


@query(sql(", m AS (SELECT cluster, ch, max(x) - min(x) AS a FROM wx GROUP BY cluster, ch) SELECT cluster, round(sum(a * ch) / sum(a), 6) AS centre, round(sum(a * a * ch) / sum(a * a), 6) AS centre_squared FROM m GROUP BY cluster", "wx"))
def centre_of_mass(spark: SparkSession, d: str) -> DataFrame:
    m = waveform_values(spark, d).groupBy("cluster", "ch").agg((F.max("x") - F.min("x")).alias("a"))
    a = F.col("a")
    return m.groupBy("cluster").agg(F.round(F.sum(a * F.col("ch")) / F.sum(a), 6).alias("centre"), F.round(F.sum(a * a * F.col("ch")) / F.sum(a * a), 6).alias("centre_squared"))


@query(sql("SELECT spike_id, cluster, bool_or(zero) AS cutout, bool_or(same) AS flat FROM (SELECT spike_id, cluster, ch, max(abs(x)) <= 50 AS zero, max(x) - min(x) <= 1500 AS same FROM wx GROUP BY spike_id, cluster, ch) GROUP BY spike_id, cluster", "wx"))
def flat_filter(spark: SparkSession, d: str) -> DataFrame:
    """Spikes with a channel that is (nearly) silent or (nearly) constant: within 50 of 0, within 1500 of itself."""
    c = waveform_values(spark, d).groupBy("spike_id", "cluster", "ch").agg((F.max(F.abs("x")) <= 50).alias("zero"), (F.max("x") - F.min("x") <= 1500).alias("same"))
    return c.groupBy("spike_id", "cluster").agg(F.bool_or("zero").alias("cutout"), F.bool_or("same").alias("flat"))


@query(sql(""", a AS (SELECT spike_id, s, avg(x) AS m, stddev_pop(x) AS sd FROM wx GROUP BY spike_id, s), r AS (SELECT spike_id, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms FROM wx GROUP BY spike_id)
    SELECT r.spike_id, any_value(peak) AS peak, round(avg(sd) / any_value(rms), 6) AS score FROM a JOIN r ON a.spike_id = r.spike_id GROUP BY r.spike_id""", "wx"))
def uniformity(spark: SparkSession, d: str) -> DataFrame:
    """Mean over samples of the deviation across channels, over the spike's root mean square."""
    w = waveform_values(spark, d)
    per = w.groupBy("spike_id", "s").agg(F.stddev_pop("x").alias("sd"), F.max(F.abs("x")).alias("p"), F.sum(F.col("x") * F.col("x")).alias("e"), F.count("*").alias("n"))
    return per.groupBy("spike_id").agg(F.max("p").alias("peak"), F.round(F.avg("sd") / F.sqrt(F.sum("e") / F.sum("n")), 6).alias("score"))


@query(sql(", m AS (SELECT cluster, d, avg(x) AS m, stddev_pop(x) AS sd FROM fx GROUP BY cluster, d) SELECT spike_id, fx.cluster, round(max(abs(x - m) / sd), 6) AS worst, CASE WHEN max(abs(x - m) / sd) > 5 THEN 0 ELSE fx.cluster END AS label FROM fx JOIN m ON fx.cluster = m.cluster AND fx.d = m.d GROUP BY spike_id, fx.cluster", "fx"))
def feature_outliers(spark: SparkSession, d: str) -> DataFrame:
    f = feature_values(spark, d)
    m = f.groupBy("cluster", "d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    worst = F.max(F.abs(F.col("x") - F.col("m")) / F.col("sd"))
    out = f.join(m, ["cluster", "d"]).groupBy("spike_id", "cluster").agg(worst.alias("w"))
    return out.select("spike_id", "cluster", F.round("w", 6).alias("worst"), F.when(F.col("w") > 5, 0).otherwise(F.col("cluster")).alias("label"))


@query(sql("SELECT spike_id, cluster FROM features WHERE cluster > 0", "features"))
def drop_artefacts(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).filter("cluster > 0").select("spike_id", "cluster")


@query(sql(""", m AS (SELECT cluster, d, avg(x) AS m FROM fx GROUP BY cluster, d), e AS (SELECT spike_id, fx.cluster, sum((x - m) ** 2) AS dist FROM fx JOIN m ON fx.cluster = m.cluster AND fx.d = m.d GROUP BY spike_id, fx.cluster),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY dist, spike_id) AS i, count(*) OVER (PARTITION BY cluster) AS n FROM e), k AS (SELECT spike_id FROM r WHERE i <= n - greatest(1, n // 10))
    SELECT cluster, d, round(avg(x), 4) AS mean FROM fx WHERE spike_id IN (SELECT spike_id FROM k) GROUP BY cluster, d""", "fx"))
def trimmed_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean without the tenth of the spikes farthest from the mean, one at least."""
    f = feature_values(spark, d)
    dist = P.centred(f, ["cluster", "d"]).groupBy("spike_id", "cluster").agg(F.sum(F.col("dx") * F.col("dx")).alias("dist"))
    w = Window.partitionBy("cluster")
    n = F.count("*").over(w)
    kept = dist.withColumns({"i": F.row_number().over(w.orderBy("dist", "spike_id")), "n": n}).filter("i <= n - greatest(1, n div 10)").select("spike_id")
    return f.join(kept, "spike_id", "left_semi").groupBy("cluster", "d").agg(F.round(F.avg("x"), 4).alias("mean"))


@query(sql(""", m AS (SELECT cluster, d, avg(x) AS m, var_pop(x) AS v FROM fx GROUP BY cluster, d), p AS (SELECT a.cluster AS a, b.cluster AS b, sum((a.m - b.m) ** 2) AS gap, sum(a.v) AS na, sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)) AS cosine FROM m a JOIN m b ON a.d = b.d AND a.cluster <> b.cluster GROUP BY a.cluster, b.cluster)
    SELECT a, b, round(cosine, 6) AS cosine, round(gap / (na + gap), 6) AS separability FROM p""", "fx"))
def similarity_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of the mean features and gap / (noise + gap) with the row's noise, between clusters."""
    m = feature_values(spark, d).groupBy("cluster", "d").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    a, b = m.select("d", F.col("cluster").alias("a"), F.col("m").alias("ma"), F.col("v").alias("va")), m.select("d", F.col("cluster").alias("b"), F.col("m").alias("mb"))
    ma, mb = F.col("ma"), F.col("mb")
    gap = F.sum((ma - mb) * (ma - mb))
    return a.join(b, "d").filter("a <> b").groupBy("a", "b").agg(F.round(F.sum(ma * mb) / F.sqrt(F.sum(ma * ma) * F.sum(mb * mb)), 6).alias("cosine"), F.round(gap / (F.sum("va") + gap), 6).alias("separability"))


ERROR = """, e AS (SELECT q.spike_id, q.cluster, q.m, -0.5 * (dist + l) AS z FROM q JOIN (SELECT m, sum(ln(v)) AS l FROM m GROUP BY m) t ON q.m = t.m), s AS (SELECT *, exp(z - max(z) OVER (PARTITION BY spike_id)) AS p FROM e),
    n AS (SELECT cluster, m, p / sum(p) OVER (PARTITION BY spike_id) AS p FROM s) SELECT cluster AS a, m AS b, round(CASE WHEN cluster = m THEN 0 ELSE avg(p) END, 6) AS error FROM n GROUP BY cluster, m"""


@query(sql(DIAG + ERROR, "fx"))
def error_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Mean posterior of each cluster's spikes under each diagonal model; the diagonal is 0."""
    e = N.posteriors(features(spark, d), "fet", _diagonal(spark, d))
    return e.select("a", "b", F.round(F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("error")), 6).alias("error"))


@query(sql(MAD + """, z AS (SELECT spike_id, fx.cluster, r.cluster AS m, sum(((x - med) / mad) ** 2) AS dist FROM fx JOIN r ON fx.d = r.d WHERE fx.cluster < 2 AND r.cluster >= 2 GROUP BY spike_id, fx.cluster, r.cluster)
    SELECT spike_id, cluster, arg_min(m, (dist, m)) AS nearest, round(min(dist), 3) AS dist, min(dist) <= 64 * power(1 - 2 / (9.0 * 64) + 2.326348 * sqrt(2 / (9.0 * 64)), 3) AS accepted FROM z GROUP BY spike_id, cluster""", "fx"))
def shadow_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Spikes of the noise clusters go to the robustly nearest unit if the distance passes the chi-square gate (Wilson-Hilferty, 99 %)."""
    models = P.median_and_mad(feature_values(spark, d).filter("cluster >= 2"), ["cluster", "d"])
    held = N.models(models.withColumn("x", F.lit(0)), F.first("med"), F.first(F.col("mad") * F.col("mad")))
    out = N.nearest(features(spark, d).filter("cluster < 2"), "fet", held)
    gate = 64 * (1 - 2 / (9.0 * 64) + 2.326348 * (2 / (9.0 * 64)) ** 0.5) ** 3
    return out.select("spike_id", "cluster", "nearest", F.round("cost", 3).alias("dist"), (F.col("cost") <= gate).alias("accepted"))


@query(sql("SELECT cluster, count(*) AS n, CAST(CASE WHEN cluster < 2 THEN cluster ELSE row_number() OVER (PARTITION BY cluster < 2 ORDER BY count(*) DESC, cluster) + 1 END AS BIGINT) AS renumbered FROM features GROUP BY cluster", "features"))
def renumber_by_count(spark: SparkSession, d: str) -> DataFrame:
    """Units by falling number of spikes, from 2; ties keep their order. One row per cluster is ranked."""
    c = features(spark, d).groupBy("cluster").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(F.col("cluster") < 2).orderBy(F.desc("n"), "cluster")) + 1
    return c.select("cluster", "n", F.when(F.col("cluster") < 2, F.col("cluster")).otherwise(rank).cast("long").alias("renumbered"))


@query(sql(", f AS (SELECT cluster, min(t) AS first_t FROM spikes GROUP BY cluster) SELECT cluster, first_t, row_number() OVER (ORDER BY first_t, cluster) + 1 AS by_time, row_number() OVER (ORDER BY cluster) + 1 AS contiguous FROM f", "spikes"))
def renumber_by_time(spark: SparkSession, d: str) -> DataFrame:
    """All clusters by first spike and without gaps, from 2."""
    f = spikes(spark, d).groupBy("cluster").agg(F.min("t").alias("first_t"))
    return P.numbered(P.numbered(f, "by_time", "first_t", "cluster"), "contiguous", "cluster").select("cluster", "first_t", (F.col("by_time") + 2).alias("by_time"), (F.col("contiguous") + 2).alias("contiguous"))


@query(sql("SELECT count(*) AS n, count(*) FILTER (cluster < 2) AS noise, count(*) FILTER (cluster >= 2) AS good, count(DISTINCT CASE WHEN cluster >= 2 THEN cluster END) AS units FROM features", "features"))
def noise_summary(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("cluster")
    return features(spark, d).agg(F.count("*").alias("n"), F.count_if(c < 2).alias("noise"), F.count_if(c >= 2).alias("good"), F.count_distinct(F.when(c >= 2, c)).alias("units"))


@query(sql("SELECT spike_id, len(fet) + 2 AS width, spike_id - spike_id // 7 * 7 AS phase, spike_id AS t FROM features", "features"))
def phase_column(spark: SparkSession, d: str) -> DataFrame:
    """The phase goes before the time, which stays last."""
    f = features(spark, d).withColumn("fet", F.array_append("fet", F.col("spike_id")))
    f = f.withColumn("fet", F.array_insert("fet", F.lit(-2), F.col("spike_id") - F.expr("spike_id div 7") * 7))
    return f.select("spike_id", F.size("fet").cast("long").alias("width"), F.element_at("fet", -2).alias("phase"), F.element_at("fet", -1).alias("t"))
