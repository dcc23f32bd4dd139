"""Queries on event trains: intervals, bursts, correlograms, joins on time, ranks and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import timing as T
from ..sources.adapters import intervals, spikes, sql
from .registry import query

ISI = ", i AS (SELECT *, t - lag(t) OVER (PARTITION BY cluster ORDER BY t, spike_id) AS isi FROM spikes) "


@query(sql(ISI + """SELECT cluster, count(*) AS n, round(avg(isi), 6) AS mean_isi, round(median(isi), 6) AS median_isi,
    round(CASE WHEN avg(isi) > 0 THEN stddev_pop(isi) / avg(isi) END, 6) AS cv_isi, round(avg(CAST(isi < 600 AS INT)), 6) AS below_600,
    round(avg(CAST(isi < 7200 AS INT)), 6) AS below_7200, round(avg(CAST(isi < 86400 AS INT)), 6) AS below_86400 FROM i GROUP BY cluster""", "spikes"))
def isi_stats(spark: SparkSession, d: str) -> DataFrame:
    return T.interval_statistics(spikes(spark, d), (600, 7200, 86400))


@query(sql(ISI + "SELECT cluster, count(*) AS n, round(coalesce(sum(CAST(isi < 3600 AS INT)) / nullif(count(*) - 1, 0), 0), 6) AS fraction FROM i GROUP BY cluster", "spikes"))
def refractory_fraction(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    fraction = F.coalesce(F.count_if(F.col("isi") < 3600) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))
    return T.intervals_between(spikes(spark, d)).groupBy("cluster").agg(n.alias("n"), F.round(fraction, 6).alias("fraction"))


@query(sql(ISI + """, b AS (SELECT *, sum(CAST(coalesce(isi, 36001) > 36000 AS BIGINT)) OVER (PARTITION BY cluster ORDER BY t, spike_id) AS burst FROM i)
    SELECT cluster, CAST(burst AS BIGINT) AS burst, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM b GROUP BY cluster, burst""", "spikes"))
def burst_segments(spark: SparkSession, d: str) -> DataFrame:
    return T.bursts(spikes(spark, d), 36000)


@query(sql(", m AS (SELECT min(t) AS t0, grp FROM spikes GROUP BY grp) SELECT s.grp, (t - t0) // 86400 AS block, count(*) AS n, count(DISTINCT cluster) AS clusters FROM spikes s JOIN m ON s.grp = m.grp GROUP BY s.grp, block", "spikes"))
def time_blocks(spark: SparkSession, d: str) -> DataFrame:
    s = T.with_span(spikes(spark, d), "grp")
    return s.withColumn("block", F.floor((F.col("t") - F.col("t0")) / 86400)).groupBy("grp", "block").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"))


@query(sql(""", m AS (SELECT grp, min(t) AS t0, max(t) + 1 AS t1 FROM spikes GROUP BY grp)
    SELECT s.grp, CAST(least(5, floor((t - t0) * 6 / (t1 - t0))) AS BIGINT) AS chunk, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM spikes s JOIN m ON s.grp = m.grp GROUP BY s.grp, chunk""", "spikes"))
def chunk_edges(spark: SparkSession, d: str) -> DataFrame:
    chunk = F.least(F.lit(5).cast("long"), F.floor((F.col("t") - F.col("t0")) * 6 / (F.col("t1") + 1 - F.col("t0"))))
    return T.with_span(spikes(spark, d), "grp").withColumn("chunk", chunk).groupBy("grp", "chunk").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(sql(""", c AS (SELECT cluster AS id, grp, sum(t) // count(*) AS m FROM spikes GROUP BY cluster, grp),
    g AS (SELECT *, coalesce(m - lag(m) OVER (PARTITION BY grp ORDER BY m, id), 0) > 7200 AS jump FROM c)
    SELECT id, grp, CAST(m AS BIGINT) AS m, CAST(sum(CAST(jump AS BIGINT)) OVER (PARTITION BY grp ORDER BY m, id) AS BIGINT) AS island FROM g""", "spikes"))
def gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    means = spikes(spark, d).groupBy(F.col("cluster").alias("id"), "grp").agg(F.expr("sum(t) div count(*)").alias("m"))
    return T.islands(means, "grp", "m", 7200)


@query(sql(""", c AS (SELECT cluster, grp, count(*) AS n FROM spikes GROUP BY cluster, grp),
    p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC) - 1 AS place, count(*) OVER (PARTITION BY grp) AS k, min(n) OVER (PARTITION BY grp) = max(n) OVER (PARTITION BY grp) AS same FROM c)
    SELECT cluster, grp, n, round(CASE WHEN same THEN 1.0 ELSE 1 - avg(place) OVER (PARTITION BY grp, n) / (k - 1) END, 6) AS rank FROM p""", "spikes"))
def percentile_rank_mean_ties(spark: SparkSession, d: str) -> DataFrame:
    counts = spikes(spark, d).groupBy("cluster", "grp").agg(F.count("*").alias("n"))
    return T.mean_rank(counts, ["grp"], "n").withColumn("rank", F.round("rank", 6))


@query(sql(""", m AS (SELECT cluster, min(t) AS t0, max(t) AS t1, count(*) AS n FROM spikes GROUP BY cluster),
    b AS (SELECT s.cluster, CASE WHEN t1 > t0 THEN least(9, (t - t0) * 10 // (t1 - t0)) ELSE 0 END AS bin, count(*) AS k, any_value(n) AS n, any_value(t1 - t0) AS span FROM spikes s JOIN m ON s.cluster = m.cluster GROUP BY s.cluster, bin)
    SELECT cluster, any_value(n) AS n, CAST(sum(CASE WHEN 50 * k >= n THEN 1 ELSE 0 END) AS BIGINT) AS bins,
        round(CASE WHEN any_value(span) > 0 THEN 10.0 * sum(CASE WHEN 50 * k >= n THEN k ELSE 0 END) / (any_value(span) * sum(CASE WHEN 50 * k >= n THEN 1 ELSE 0 END)) END, 9) AS rate FROM b GROUP BY cluster""", "spikes"))
def firing_rate(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("cluster")
    t0, span = F.min("t").over(w), F.max("t").over(w) - F.min("t").over(w)
    s = spikes(spark, d).withColumns({"span": span, "n": F.count("*").over(w), "from": F.col("t") - t0})
    bins = s.withColumn("bin", F.when(F.col("span") > 0, F.least(F.lit(9).cast("long"), F.expr("`from` * 10 div nullif(span, 0)"))).otherwise(0)).groupBy("cluster", "bin", "n", "span").agg(F.count("*").alias("k"))
    held = 50 * F.col("k") >= F.col("n")
    used, kept = F.count_if(held), F.sum(F.when(held, F.col("k")).otherwise(0))
    rate = F.when(F.col("span") > 0, 10.0 * kept / (F.col("span") * used))
    return bins.groupBy("cluster", "n", "span").agg(used.alias("bins"), F.round(rate, 9).alias("rate")).select("cluster", "n", "bins", "rate")


CCG = """, p AS (SELECT a.{k} AS k, CAST(floor((b.t - a.t) / 600.0 + 0.5) AS BIGINT) AS bin FROM spikes a JOIN spikes b ON a.{k} = b.{k} AND a.spike_id <> b.spike_id AND b.t BETWEEN a.t - 6000 AND a.t + 6000 {on}),
    c AS (SELECT k, bin, count(*) AS n FROM p WHERE abs(bin) <= 9 GROUP BY k, bin), f AS (SELECT DISTINCT {k} AS k, unnest(range(-9, 10)) AS bin FROM spikes {where})
    SELECT f.k AS {k}, f.bin, coalesce(c.n, 0) AS n FROM f LEFT JOIN c ON f.k = c.k AND f.bin = c.bin"""


@query(sql(CCG.format(k="cluster", on="", where=""), "spikes"))
def correlogram_auto(spark: SparkSession, d: str) -> DataFrame:
    s = spikes(spark, d)
    return T.correlogram(s, s, ["cluster"], 11400, 600, skip_self=True)


@query(sql(CCG.format(k="cluster", on="AND a.grp = 'view' AND b.grp = 'purchase'", where="WHERE grp = 'view'"), "spikes"))
def correlogram_cross(spark: SparkSession, d: str) -> DataFrame:
    s = spikes(spark, d)
    return T.correlogram(s.filter("grp = 'view'"), s.filter("grp = 'purchase'"), ["cluster"], 11400, 600, skip_self=True)


@query(sql(""", n AS (SELECT grp, count(*) AS n FROM spikes GROUP BY grp),
    h AS (SELECT a.grp AS a, g.grp AS b, count(*) AS hits FROM spikes a JOIN n g ON a.grp <> g.grp WHERE EXISTS (SELECT 1 FROM spikes b WHERE b.grp = g.grp AND b.t BETWEEN a.t - 60 AND a.t + 60) GROUP BY a.grp, g.grp),
    m AS (SELECT x.grp AS a, y.grp AS b, coalesce(h.hits, 0) / (x.n + 1) AS c FROM n x JOIN n y ON x.grp <> y.grp LEFT JOIN h ON h.a = x.grp AND h.b = y.grp)
    SELECT p.a, p.b, round((p.c + q.c) / 2, 6) AS coincidence FROM m p JOIN m q ON p.a = q.b AND p.b = q.a""", "spikes"))
def coincidence_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Share of a group's events with one of the other group within a minute, symmetrised. The groups are few; each event looks around itself in its hour."""
    s = spikes(spark, d)
    around = T.with_halo(s, "t", 60, 60, 3600).withColumn("near", F.collect_set("grp").over(Window.partitionBy("block").orderBy("t").rangeBetween(-60, 60)))
    near = around.filter("own").select(F.col("grp").alias("a"), F.explode("near").alias("b")).filter("a <> b")
    hits = near.groupBy("a", "b").agg(F.count("*").alias("hits"))
    n = s.groupBy("grp").agg(F.count("*").alias("n"))
    pairs = n.select(F.col("grp").alias("a"), "n").join(n.select(F.col("grp").alias("b")), F.col("a") != F.col("b"))
    m = pairs.join(hits, ["a", "b"], "left").select("a", "b", (F.coalesce("hits", F.lit(0)) / (F.col("n") + 1)).alias("c"))
    back = m.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("c").alias("c2"))
    return m.join(back, ["a", "b"]).select("a", "b", F.round((F.col("c") + F.col("c2")) / 2, 6).alias("coincidence"))


@query(sql(""", e AS (SELECT * FROM spikes WHERE grp = 'view') SELECT s.cluster, s.t, s.spike_id, max(e.t) AS prev_t, arg_max(e.spike_id, (e.t, e.spike_id)) AS prev_id
    FROM spikes s LEFT JOIN e ON s.cluster = e.cluster AND e.t < s.t WHERE s.grp = 'purchase' GROUP BY s.cluster, s.t, s.spike_id""", "spikes"))
def asof_previous(spark: SparkSession, d: str) -> DataFrame:
    s = spikes(spark, d)
    return T.previous(s.filter("grp = 'purchase'"), s.filter("grp = 'view'"), "cluster")


@query(sql(""", g AS (SELECT s.spike_id, s.cluster, min(abs(e.t - s.t)) AS nearest FROM spikes s LEFT JOIN (SELECT * FROM spikes WHERE grp = 'error') e ON s.cluster = e.cluster WHERE s.grp = 'click' GROUP BY s.spike_id, s.cluster)
    SELECT spike_id, cluster, nearest FROM g""", "spikes"))
def nearest_in_time(spark: SparkSession, d: str) -> DataFrame:
    s = spikes(spark, d).filter("grp IN ('error', 'click')")
    hit = F.when(F.col("grp") == "error", F.col("t"))
    w = Window.partitionBy("cluster").orderBy("t")
    before = F.max(hit).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(hit).over(w.rangeBetween(0, Window.unboundedFollowing))
    return s.withColumn("nearest", F.least(F.col("t") - before, after - F.col("t"))).filter("grp = 'click'").select("spike_id", "cluster", "nearest")


@query(sql("SELECT spike_id, cluster, t FROM spikes s WHERE grp <> 'error' AND NOT EXISTS (SELECT 1 FROM spikes e WHERE e.grp = 'error' AND e.cluster = s.cluster AND e.t BETWEEN s.t - 1800 AND s.t + 1800)", "spikes"))
def band_anti_join(spark: SparkSession, d: str) -> DataFrame:
    s = spikes(spark, d)
    mask = s.filter("grp = 'error'").select(F.col("t").alias("rt"), F.col("cluster").alias("r_cluster"))
    return T.band_join(s.filter("grp <> 'error'"), mask, ["cluster"], -1800, 1800, "left_anti").select("spike_id", "cluster", "t")


@query(sql(", o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS day FROM orders) SELECT i.id, i.grp, count(o.o_orderkey) AS n FROM intervals i LEFT JOIN o ON i.id + 1 = o.o_custkey AND o.day >= i.a AND o.day < i.b GROUP BY i.id, i.grp", "intervals"))
def interval_points(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.adapters import table

    o = table(spark, d, "orders").select("o_custkey", F.expr("CAST(date_diff(CAST(o_orderdate AS DATE), DATE'1970-01-01') AS BIGINT)").alias("day"))
    i = intervals(spark, d)
    on = (F.col("id") + 1 == F.col("o_custkey")) & (F.col("day") >= F.col("a")) & (F.col("day") < F.col("b"))
    return i.join(o, on, "left").groupBy("id", "grp").agg(F.count("day").alias("n"))


PAIRS = ", p AS (SELECT x.id AS a, y.id AS b, greatest(0, least(x.b, y.b) - greatest(x.a, y.a)) AS shared, x.b - x.a AS na, y.b - y.a AS nb FROM intervals x JOIN intervals y ON x.grp = y.grp AND x.id < y.id) "


@query(sql(PAIRS + "SELECT a, b, shared AS overlap, round(shared / (na + nb - shared), 6) AS iou FROM p WHERE shared > 0", "intervals"))
def interval_iou(spark: SparkSession, d: str) -> DataFrame:
    """Overlap and intersection over union of the intervals of a group that overlap. The pairs grow with the square of a group, so they come in an order that Parquet holds in few bytes."""
    return T.overlaps(intervals(spark, d), "grp", 64).select("a", "b", "overlap", A.share(F.col("overlap"), F.col("together"), 6).alias("iou"))


@query(sql(""", v AS (SELECT id, grp, a, a + 20 AS b FROM intervals), r AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY grp ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM v),
    k AS (SELECT *, sum(CAST(new AS BIGINT)) OVER (PARTITION BY grp ORDER BY a, b, id) AS island FROM r) SELECT grp, CAST(island AS BIGINT) AS island, min(a) AS a, max(b) AS b, count(*) AS n FROM k GROUP BY grp, island""", "intervals"))
def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    return T.merged(intervals(spark, d).withColumn("b", F.col("a") + 20), "grp")


@query(sql("SELECT cluster, spike_id, t, (SELECT min(n.t) FROM spikes n WHERE n.cluster = s.cluster AND n.grp = 'purchase' AND n.t > s.t) AS next_t, (SELECT max(n.t) FROM spikes n WHERE n.cluster = s.cluster AND n.grp = 'purchase' AND n.t < s.t) AS prev_t FROM spikes s WHERE grp = 'click'", "spikes"))
def next_previous_event(spark: SparkSession, d: str) -> DataFrame:
    s = spikes(spark, d)
    hit = F.when(F.col("grp") == "purchase", F.col("t"))
    w = Window.partitionBy("cluster").orderBy("t")
    s = s.withColumns({"next_t": F.min(hit).over(w.rangeBetween(1, Window.unboundedFollowing)), "prev_t": F.max(hit).over(w.rangeBetween(Window.unboundedPreceding, -1))})
    return s.filter("grp = 'click'").select("cluster", "spike_id", "t", "next_t", "prev_t")


@query(sql("SELECT cluster, arg_min(spike_id, (abs(t - 1705000000), spike_id)) AS spike_id, min(abs(t - 1705000000)) AS off FROM spikes GROUP BY cluster", "spikes"))
def nearest_spike(spark: SparkSession, d: str) -> DataFrame:
    off = F.abs(F.col("t") - 1705000000)
    return spikes(spark, d).groupBy("cluster").agg(F.min_by("spike_id", F.struct(off, "spike_id")).alias("spike_id"), F.min(off).alias("off"))


@query(sql("SELECT spike_id, grp, t * 1000 AS t_ms FROM spikes WHERE t BETWEEN 1704500000 AND 1705500000", "spikes"))
def range_read(spark: SparkSession, d: str) -> DataFrame:
    return spikes(spark, d).filter(F.col("t").between(1704500000, 1705500000)).select("spike_id", "grp", (F.col("t") * 1000).alias("t_ms"))


@query(sql("SELECT spike_id, grp, count(*) OVER (PARTITION BY grp ORDER BY t RANGE BETWEEN 119 PRECEDING AND 120 FOLLOWING) = 1 AS clean FROM spikes", "spikes"))
def clean_mask(spark: SparkSession, d: str) -> DataFrame:
    return T.clean(spikes(spark, d), "grp", 120).select("spike_id", "grp", "clean")


@query(sql(""", u AS (SELECT *, CASE WHEN grp = 'click' THEN 0 ELSE 1 END AS src FROM spikes), r AS (SELECT *, row_number() OVER (PARTITION BY cluster, t // 3600 ORDER BY src, t, spike_id) AS k FROM u)
    SELECT spike_id, cluster, t, CASE WHEN src = 0 THEN cluster ELSE 0 END AS label FROM r WHERE k = 1""", "spikes"))
def dedup_priority(spark: SparkSession, d: str) -> DataFrame:
    """Union of original and re-detected events: one per cluster and hour, originals first; others get label 0."""
    u = spikes(spark, d).withColumn("src", F.when(F.col("grp") == "click", 0).otherwise(1))
    w = Window.partitionBy("cluster", F.floor(F.col("t") / 3600)).orderBy("src", "t", "spike_id")
    return u.withColumn("k", F.row_number().over(w)).filter("k = 1").select("spike_id", "cluster", "t", F.when(F.col("src") == 0, F.col("cluster")).otherwise(0).alias("label"))


@query(sql(""", p AS (SELECT a.cluster, b.t - a.t AS lag FROM spikes a JOIN spikes b ON a.cluster = b.cluster AND b.t - a.t BETWEEN 1 AND 50000)
    , c AS (SELECT cluster, count(*) FILTER (lag BETWEEN 3000 AND 10000) AS near, count(*) FILTER (lag BETWEEN 40000 AND 50000) AS far FROM p GROUP BY cluster)
    SELECT cluster, near, far, round(CASE WHEN far > 0 THEN (near / 7000.0) / (far / 10000.0) END, 6) AS burst_index FROM c""", "spikes"))
def burst_index(spark: SparkSession, d: str) -> DataFrame:
    lags = {"near": (3000, 10000), "far": (40000, 50000), "all": (1, 50000)}
    c = T.pairs_at(spikes(spark, d), "cluster", lags).filter("`all` > 0")
    return c.select("cluster", "near", "far", F.round(F.when(F.col("far") > 0, (F.col("near") / 7000.0) / (F.nullif("far", F.lit(0)) / 10000.0)), 6).alias("burst_index"))


@query(sql(", n AS (SELECT cluster, t, spike_id, ntile(4) OVER (PARTITION BY cluster ORDER BY t, spike_id) AS bin FROM spikes) SELECT cluster, CAST(bin AS BIGINT) AS bin, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM n GROUP BY cluster, bin", "spikes"))
def time_percentile_bins(spark: SparkSession, d: str) -> DataFrame:
    bin_ = F.ntile(4).over(Window.partitionBy("cluster").orderBy("t", "spike_id")).cast("long")
    return spikes(spark, d).withColumn("bin", bin_).groupBy("cluster", "bin").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(sql("SELECT cluster, count(*) AS n, round(avg(t), 3) AS mean_t, round(stddev_pop(t), 3) AS std_t, min(t) AS min_t, max(t) AS max_t, round(CASE WHEN max(t) > min(t) THEN count(*) / (max(t) - min(t)) END, 9) AS density FROM spikes GROUP BY cluster", "spikes"))
def time_stats(spark: SparkSession, d: str) -> DataFrame:
    span = F.max("t") - F.min("t")
    return spikes(spark, d).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("t"), 3).alias("mean_t"), F.round(F.stddev_pop("t"), 3).alias("std_t"), F.min("t").alias("min_t"), F.max("t").alias("max_t"), F.round(F.when(span > 0, F.count("*") / F.nullif(span, F.lit(0))), 9).alias("density"))


@query(sql("SELECT session_id, n FROM (SELECT cluster AS session_id, count(*) AS n FROM spikes WHERE grp IN ('click', 'view') GROUP BY cluster)", "spikes"))
def selected_counts(spark: SparkSession, d: str) -> DataFrame:
    return spikes(spark, d).filter(F.col("grp").isin("click", "view")).groupBy(F.col("cluster").alias("session_id")).agg(F.count("*").alias("n"))
