"""Queries that match and judge clusters: votes of neighbours, chunk matching, residuals, correlations, drift and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import shapes as P
from ..operators import timing as T
from ..sources.adapters import feature_values, features, spikes, sql, table, waveform_values
from .registry import query


@query(sql(""", p AS (SELECT q.spike_id, q.cluster, r.cluster AS ref, r.spike_id AS rid, sum((q.x - r.x) ** 2) AS dist FROM fx q JOIN fx r ON q.d = r.d AND q.cluster < 2 AND r.cluster >= 2 GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY spike_id ORDER BY dist, rid) AS i FROM p), v AS (SELECT spike_id, cluster, ref, count(*) AS votes FROM k WHERE i <= 10 GROUP BY ALL)
    SELECT spike_id, cluster, arg_min(ref, (-votes, ref)) AS winner, max(votes) AS votes, max(votes) >= 6 AS accepted FROM v GROUP BY spike_id, cluster""", "fx"))
def neighbour_vote(spark: SparkSession, d: str) -> DataFrame:
    """Noise spikes by the vote of their ten nearest spikes of a reference pool, on whole vectors; six votes accept."""
    f = features(spark, d)
    v = P.vote(f.filter("cluster < 2"), f.filter("cluster >= 2"), 10)
    return v.select("spike_id", "cluster", "winner", "votes", (F.col("votes") >= 6).alias("accepted"))


CHUNKS = ", c AS (SELECT cluster % 12 AS a, (cluster * 7 + t // 86400) % 9 AS b FROM spikes), v AS (SELECT a, b, count(*) AS n FROM c GROUP BY a, b), "


@query(sql(CHUNKS + "x AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS i, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS j FROM v) SELECT a, b, n FROM x WHERE i = 1 AND j = 1 AND n >= greatest(3, (SELECT count(*) FROM c) // 500)", "spikes"))
def mutual_plurality(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of two neighbouring chunks that are each other's most frequent partner, often enough."""
    c = spikes(spark, d).select((F.col("cluster") % 12).alias("a"), F.expr("(cluster * 7 + t div 86400) % 9").alias("b"))
    v = c.groupBy("a", "b").agg(F.count("*").alias("n"))
    least = F.broadcast(c.agg(F.greatest(F.lit(3), F.expr("count(*) div 500")).alias("least")))
    v = v.withColumns({"i": F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b")), "j": F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))})
    return v.join(least).filter("i = 1 AND j = 1 AND n >= least").select("a", "b", "n")


@query(sql(""", m AS (SELECT cluster, s, ch, median(x) AS m FROM wx GROUP BY ALL), r AS (SELECT spike_id, wx.cluster, sum((x - m) ** 2) FILTER (wx.s NOT BETWEEN 2 AND 5) AS e FROM wx JOIN m ON wx.cluster = m.cluster AND wx.s = m.s AND wx.ch = m.ch GROUP BY ALL),
    c AS (SELECT cluster, median(e) AS med FROM r GROUP BY cluster), a AS (SELECT r.cluster, any_value(med) AS med, median(abs(e - med)) AS mad FROM r JOIN c ON r.cluster = c.cluster GROUP BY r.cluster)
    SELECT spike_id, r.cluster, round(e, 2) AS residual, e > greatest(med + 3 * 1.4826 * mad, 1.5 * med) AS collided FROM r JOIN a ON r.cluster = a.cluster""", "wx"))
def collision_score(spark: SparkSession, d: str) -> DataFrame:
    """Energy left outside of the peak after the cluster's median, judged by the cluster's own spread."""
    w = waveform_values(spark, d)
    m = w.groupBy("cluster", "s", "ch").agg(F.percentile("x", F.lit(0.5)).alias("m"))
    left = F.sum(F.when(~F.col("s").between(2, 5), (F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))))
    r = w.join(m, ["cluster", "s", "ch"]).groupBy("spike_id", "cluster").agg(left.alias("e"))
    med = r.groupBy("cluster").agg(F.percentile("e", F.lit(0.5)).alias("med"))
    a = r.join(med, "cluster").groupBy("cluster").agg(F.first("med").alias("med"), F.percentile(F.abs(F.col("e") - F.col("med")), F.lit(0.5)).alias("mad"))
    limit = F.greatest(F.col("med") + 3 * 1.4826 * F.col("mad"), 1.5 * F.col("med"))
    return r.join(a, "cluster").select("spike_id", "cluster", F.round("e", 2).alias("residual"), (F.col("e") > limit).alias("collided"))


LAGS = ", m AS (SELECT cluster, s * 8 + ch AS i, avg(x) AS m FROM wx GROUP BY ALL), l AS (SELECT unnest(range(-2, 3)) AS lag), p AS (SELECT a.cluster AS a, b.cluster AS b, lag, sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)) AS c FROM m a, l, m b WHERE a.cluster < b.cluster AND b.i = a.i + lag * 8 GROUP BY ALL) "


@query(sql(LAGS + "SELECT a, b, round(max(abs(c)), 6) AS similarity, arg_min(lag, (-round(abs(c), 9), abs(lag), lag)) AS lag FROM p GROUP BY a, b", "wx"))
def lagged_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Largest absolute correlation of two mean waveforms over shifts of up to two samples, norms over the overlap."""
    m = waveform_values(spark, d).groupBy("cluster", (F.col("s") * 8 + F.col("ch")).alias("i")).agg(F.avg("x").alias("m"))
    a = m.select(F.col("cluster").alias("a"), "i", F.col("m").alias("ma")).withColumn("lag", F.explode(F.sequence(F.lit(-2), F.lit(2)).cast("array<bigint>"))).withColumn("i", F.col("i") + F.col("lag") * 8)
    b = m.select(F.col("cluster").alias("b"), "i", F.col("m").alias("mb"))
    ma, mb = F.col("ma"), F.col("mb")
    p = a.join(b, "i").filter("a < b").groupBy("a", "b", "lag").agg((F.sum(ma * mb) / F.sqrt(F.sum(ma * ma) * F.sum(mb * mb))).alias("c"))
    return p.groupBy("a", "b").agg(F.round(F.max(F.abs("c")), 6).alias("similarity"), F.min_by("lag", F.struct(-F.round(F.abs("c"), 9), F.abs("lag"), "lag")).alias("lag"))


@query(sql(""", e AS (SELECT cluster, s, ch, avg(x) - 2 * stddev_pop(x) AS lo, avg(x) + 2 * stddev_pop(x) AS hi FROM wx GROUP BY ALL)
    SELECT a.cluster AS a, b.cluster AS b, round(sum(greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo))) / sum(greatest(a.hi, b.hi) - least(a.lo, b.lo)), 6) AS iou FROM e a JOIN e b ON a.s = b.s AND a.ch = b.ch AND a.cluster < b.cluster WHERE a.s BETWEEN 2 AND 5 GROUP BY ALL""", "wx"))
def envelope_iou(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of two clusters' envelopes (mean and two deviations) over the inner samples."""
    sd = F.stddev_pop("x")
    e = waveform_values(spark, d).filter("s BETWEEN 2 AND 5").groupBy("cluster", "s", "ch").agg((F.avg("x") - 2 * sd).alias("lo"), (F.avg("x") + 2 * sd).alias("hi"))
    a, b = (e.select("s", "ch", F.col("cluster").alias(n), F.col("lo").alias(f"lo_{n}"), F.col("hi").alias(f"hi_{n}")) for n in "ab")
    both = F.greatest(F.lit(0.0), F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b"))
    return a.join(b, ["s", "ch"]).filter("a < b").groupBy("a", "b").agg(F.round(F.sum(both) / F.sum(F.greatest("hi_a", "hi_b") - F.least("lo_a", "lo_b")), 6).alias("iou"))


@query(sql(""", m AS (SELECT cluster, ch, s, avg(x) AS t, var_pop(x) AS v FROM wx GROUP BY ALL), e AS (SELECT cluster, ch, sum(t * t) AS energy, sum(v) AS v FROM m GROUP BY ALL), k AS (SELECT *, max(energy) OVER (PARTITION BY cluster) AS top FROM e)
    SELECT cluster, round(sum(v) / sum(energy), 6) AS tightness, count(*) AS channels FROM k WHERE energy >= 0.2 * top GROUP BY cluster""", "wx"))
def tightness(spark: SparkSession, d: str) -> DataFrame:
    """Variance over template power on the channels with a fifth of the largest energy or more."""
    m = waveform_values(spark, d).groupBy("cluster", "ch", "s").agg(F.avg("x").alias("t"), F.var_pop("x").alias("v"))
    e = m.groupBy("cluster", "ch").agg(F.sum(F.col("t") * F.col("t")).alias("energy"), F.sum("v").alias("v"))
    e = e.withColumn("top", F.max("energy").over(Window.partitionBy("cluster"))).filter("energy >= 0.2 * top")
    return e.groupBy("cluster").agg(F.round(F.sum("v") / F.sum("energy"), 6).alias("tightness"), F.count("*").alias("channels"))


@query(sql(", m AS (SELECT cluster, d, avg(x) AS m, var_pop(x) AS v FROM fx GROUP BY cluster, d) SELECT a.cluster AS a, b.cluster AS b, round(sum((a.m - b.m) ** 2 / (a.v + b.v)) / 4 + sum(ln((a.v + b.v) / (2 * sqrt(a.v * b.v)))) / 2, 6) AS bhattacharyya FROM m a JOIN m b ON a.d = b.d AND a.cluster < b.cluster GROUP BY ALL", "fx"))
def bhattacharyya(spark: SparkSession, d: str) -> DataFrame:
    """Between diagonal models."""
    m = feature_values(spark, d).groupBy("cluster", "d").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    a, b = (m.select("d", F.col("cluster").alias(n), F.col("m").alias(f"m_{n}"), F.col("v").alias(f"v_{n}")) for n in "ab")
    gap, v = F.col("m_a") - F.col("m_b"), F.col("v_a") + F.col("v_b")
    return a.join(b, "d").filter("a < b").groupBy("a", "b").agg(F.round(F.sum(gap * gap / v) / 4 + F.sum(F.log(v / (2 * F.sqrt(F.col("v_a") * F.col("v_b"))))) / 2, 6).alias("bhattacharyya"))


@query(sql(""", p AS (SELECT a.cluster, count(*) AS pairs FROM spikes a JOIN spikes b ON a.cluster = b.cluster AND b.t - a.t BETWEEN 601 AND 3600 GROUP BY a.cluster), n AS (SELECT cluster, count(*) AS n, max(t) - min(t) AS span FROM spikes GROUP BY cluster)
    SELECT n.cluster, coalesce(pairs, 0) AS pairs, round(CASE WHEN n * n * 3000.0 / span >= 3 THEN coalesce(pairs, 0) / (n * n * 3000.0 / span) END, 6) AS ratio FROM n LEFT JOIN p ON n.cluster = p.cluster""", "spikes"))
def refractory_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Pairs at short lags over what a Poisson train of the same rate would have; null where that is less than 3."""
    s = spikes(spark, d)
    p = T.pairs_at(s, "cluster", {"pairs": (601, 3600)})
    n = s.groupBy("cluster").agg(F.count("*").alias("n"), F.nullif(F.max("t") - F.min("t"), F.lit(0)).alias("span"))
    expected = F.col("n") * F.col("n") * 3000.0 / F.col("span")
    return n.join(p, "cluster").select("cluster", "pairs", F.round(F.when(expected >= 3, F.col("pairs") / expected), 6).alias("ratio"))


@query(sql(""", g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY grp ORDER BY t, spike_id) <= 120 THEN 0 ELSE 1 END AS new FROM spikes), b AS (SELECT *, sum(new) OVER (PARTITION BY grp ORDER BY t, spike_id) AS burst, row_number() OVER (PARTITION BY grp ORDER BY t, spike_id) AS i FROM g),
    l AS (SELECT *, first_value(cluster) OVER (PARTITION BY grp, burst ORDER BY t, spike_id) AS leader, row_number() OVER (PARTITION BY grp, burst ORDER BY t, spike_id) AS k FROM b)
    SELECT leader, cluster AS follower, count(*) AS n FROM l WHERE k > 1 AND cluster <> leader GROUP BY leader, cluster""", "spikes"))
def burst_followers(spark: SparkSession, d: str) -> DataFrame:
    """Which clusters fire after which in the bursts of their group."""
    g = T.bursts_by_block(spikes(spark, d), "grp", 120).withColumn("leader", F.col("first.cluster"))
    return g.filter("NOT opens AND cluster <> leader").groupBy("leader", F.col("cluster").alias("follower")).agg(F.count("*").alias("n"))


@query(sql(""", b AS (SELECT cluster, (t - min(t) OVER (PARTITION BY cluster)) * 10 // (max(t) OVER (PARTITION BY cluster) - min(t) OVER (PARTITION BY cluster) + 1) AS bin, value FROM spikes), k AS (SELECT cluster, bin, count(*) AS n FROM b GROUP BY ALL), h AS (SELECT cluster, avg(value) FILTER (bin < 5) AS first_half, avg(value) FILTER (bin >= 5) AS second_half FROM b GROUP BY cluster)
    SELECT k.cluster, count(*) AS bins, round(stddev_pop(n) / avg(n), 6) AS rate_cv, round(any_value(second_half - first_half), 4) AS drift FROM k JOIN h ON k.cluster = h.cluster GROUP BY k.cluster""", "spikes"))
def temporal_features(spark: SparkSession, d: str) -> DataFrame:
    """Variation of the rate over ten bins, and how the second half's mean value differs from the first's."""
    w = Window.partitionBy("cluster")
    b = spikes(spark, d).withColumns({"t0": F.min("t").over(w), "t1": F.max("t").over(w)}).withColumn("bin", F.expr("(t - t0) * 10 div (t1 - t0 + 1)"))
    k = b.groupBy("cluster", "bin").agg(F.count("*").alias("n"))
    h = b.groupBy("cluster").agg((F.avg(F.when(F.col("bin") >= 5, F.col("value"))) - F.avg(F.when(F.col("bin") < 5, F.col("value")))).alias("drift"))
    k = k.groupBy("cluster").agg(F.count("*").alias("bins"), F.round(F.stddev_pop("n") / F.avg("n"), 6).alias("rate_cv"))
    return k.join(h.select("cluster", F.round("drift", 4).alias("drift")), "cluster")


@query("""SELECT p_partkey, regexp_extract(p_name, '^([A-Za-z]+)', 1) AS family, coalesce(TRY_CAST(nullif(regexp_extract(p_brand, '([0-9]+)$', 1), '') AS BIGINT), 0) AS number, len(string_split(p_type, ' ')) AS parts, regexp_full_match(CAST(p_size AS VARCHAR), '[0-9]+') AS digits FROM part""")
def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    """File and method names parsed once into columns."""
    number = F.coalesce(F.nullif(F.regexp_extract("p_brand", "([0-9]+)$", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return table(spark, d, "part").select("p_partkey", F.regexp_extract("p_name", "^([A-Za-z]+)", 1).alias("family"), number.alias("number"), F.size(F.split("p_type", " ")).cast("long").alias("parts"), F.col("p_size").cast("string").rlike("^[0-9]+$").alias("digits"))


@query(sql("SELECT cluster, t // 86400 // 7 AS week, count(*) AS n, min(spike_id) AS first_id FROM spikes GROUP BY ALL HAVING count(*) >= 10", "spikes"))
def chunk_mode(spark: SparkSession, d: str) -> DataFrame:
    """Clusters shown in a time window: those with spikes enough in it."""
    return spikes(spark, d).groupBy("cluster", F.expr("t div 86400 div 7").alias("week")).agg(F.count("*").alias("n"), F.min("spike_id").alias("first_id")).filter("n >= 10")


@query(sql(", w AS (SELECT spike_id, cluster, fet[1:32] AS a, fet[33:64] AS b FROM features), g AS (SELECT spike_id, cluster, list_sum(list_transform(range(1, 33), lambda i: a[i] * b[i])) AS ab, list_sum(list_transform(a, lambda x: x * x)) AS aa, list_sum(list_transform(range(2, 33), lambda i: abs(a[i] - a[i - 1]))) AS tv FROM w) SELECT spike_id, cluster, round(ab / aa, 6) AS gain, CAST(tv AS BIGINT) AS variation FROM g", "features"))
def gain_and_variation(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares gain of one half of the features on the other, and total variation, within the row's arrays."""
    f = features(spark, d).select("spike_id", "cluster", F.slice("fet", 1, 32).alias("a"), F.slice("fet", 33, 32).alias("b"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    ab = total(F.zip_with("a", "b", lambda x, y: x * y))
    aa = total(F.transform("a", lambda x: x * x))
    tv = total(F.zip_with(F.slice("a", 2, 31), F.slice("a", 1, 31), lambda x, y: F.abs(x - y)))
    return f.select("spike_id", "cluster", F.round(ab / aa, 6).alias("gain"), tv.alias("variation"))
