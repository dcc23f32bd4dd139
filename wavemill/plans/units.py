"""Queries that judge, order, align and merge units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import curation as C
from ..operators import distances as N
from ..operators import shapes as P
from ..operators import timing as T
from ..sources.adapters import feature_values, features, intervals, spikes, sql, table, waveform_values
from .registry import QUERIES, query
from .shapes import DIAG, ERROR, _diagonal


@query(sql(DIAG + """, e AS (SELECT m, k, dist / 2 AS h FROM q WHERE cluster <> m AND cluster > 1)
    SELECT m AS cluster, round(sum(list_sum(list_transform(range(0, 32), lambda i: exp(i * ln(h) - h - lgamma(i + 1))))) / any_value(k), 6) AS l_ratio FROM e GROUP BY m""", "fx"))
def l_ratio(spark: SparkSession, d: str) -> DataFrame:
    """How likely other units' spikes are at their distances from a unit, summed, over its spikes. For an even number of dimensions the chi-square tail is a finite sum."""
    held = _diagonal(spark, d)
    sizes = spark.createDataFrame(list(zip(held.names.tolist(), held.count.tolist(), strict=True)), "m long, k long")
    tails = N.tails(features(spark, d).filter("cluster > 1"), "fet", held).join(F.broadcast(sizes), "m")
    return tails.select(F.col("m").alias("cluster"), F.round(F.col("total") / F.col("k"), 6).alias("l_ratio"))


@query(sql(""", m AS (SELECT cluster, s, ch, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN kurtosis_pop(x) ELSE 0 END AS k FROM wx GROUP BY ALL), p AS (SELECT cluster, ch, max(m) - min(m) AS ptp, arg_max(s, (round(abs(m), 6), -s)) AS peak FROM m GROUP BY ALL),
    t AS (SELECT cluster, arg_max(ch, (round(ptp, 6), -ch)) AS ch, arg_max(peak, (round(ptp, 6), -ch)) AS peak FROM p GROUP BY cluster) SELECT t.cluster, t.ch AS channel, t.peak, round(min(k), 4) AS kurtosis FROM t JOIN m ON m.cluster = t.cluster AND m.ch = t.ch AND abs(m.s - t.peak) <= 3 GROUP BY ALL""", "wx"))
def peak_kurtosis(spark: SparkSession, d: str) -> DataFrame:
    """The smallest kurtosis within three samples of the peak on the channel with the largest swing; ties to the first."""
    m = waveform_values(spark, d).groupBy("cluster", "s", "ch").agg(F.avg("x").alias("m"), P.central_moments()["kurt"].alias("k"))
    p = m.groupBy("cluster", "ch").agg((F.max("m") - F.min("m")).alias("ptp"), F.max_by("s", F.struct(F.round(F.abs("m"), 6), -F.col("s"))).alias("peak"))
    t = p.groupBy("cluster").agg(F.max_by(F.struct("ch", "peak"), F.struct(F.round("ptp", 6), -F.col("ch"))).alias("t")).select("cluster", F.col("t.ch").alias("channel"), "t.peak")
    near = m.join(t, (m.cluster == t.cluster) & (m.ch == t.channel) & (F.abs(m.s - t.peak) <= 3)).drop(m.cluster)
    return near.groupBy("cluster", "channel", "peak").agg(F.round(F.min("k"), 4).alias("kurtosis"))


@query(sql(", m AS (SELECT cluster, d, median(x) AS m, count(*) AS n FROM fx GROUP BY ALL) SELECT fx.cluster, fx.d, any_value(n) AS n, round(CASE WHEN any_value(n) < 2 THEN 0 ELSE avg((x - m) * (x - m)) END, 3) AS var FROM fx JOIN m ON fx.cluster = m.cluster AND fx.d = m.d GROUP BY fx.cluster, fx.d", "fx"))
def median_template_variance(spark: SparkSession, d: str) -> DataFrame:
    """Variance about the median waveform; 0 for fewer than two spikes."""
    f = feature_values(spark, d)
    m = f.groupBy("cluster", "d").agg(F.percentile("x", F.lit(0.5)).alias("m"))
    off = F.col("x") - F.col("m")
    return f.join(m, ["cluster", "d"]).groupBy("cluster", "d").agg(F.count("*").alias("n"), F.round(F.when(F.count("*") < 2, 0.0).otherwise(F.avg(off * off)), 3).alias("var"))


@query(sql("SELECT grp, t // 86400 AS day, count(*) AS n, count(DISTINCT cluster) AS units FROM spikes GROUP BY CUBE (grp, day)", "spikes"))
def counts_by_sets(spark: SparkSession, d: str) -> DataFrame:
    """Counts by group and day, by each alone and over all."""
    return spikes(spark, d).withColumn("day", F.expr("t div 86400")).cube("grp", "day").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("units"))


@query(sql(""", p AS (SELECT cluster, spike_id, ch, max(x) - min(x) AS p FROM wx GROUP BY ALL), c AS (SELECT cluster, spike_id, sum(p * p * ch) / sum(p * p) AS c FROM p GROUP BY ALL), h AS (SELECT *, ntile(2) OVER (PARTITION BY cluster ORDER BY spike_id) AS half FROM c)
    SELECT cluster, round(avg(c) FILTER (half = 2) - avg(c) FILTER (half = 1), 6) AS drift, round(stddev_pop(c), 6) AS spread FROM h GROUP BY cluster""", "wx"))
def centroid_drift(spark: SparkSession, d: str) -> DataFrame:
    """How the centre of the squared swings moves from the first to the second half of a unit's spikes."""
    p = waveform_values(spark, d).groupBy("cluster", "spike_id", "ch").agg((F.max("x") - F.min("x")).alias("p"))
    c = p.groupBy("cluster", "spike_id").agg((F.sum(F.col("p") * F.col("p") * F.col("ch")) / F.sum(F.col("p") * F.col("p"))).alias("c"))
    h = c.withColumn("half", F.ntile(2).over(Window.partitionBy("cluster").orderBy("spike_id")))
    of = lambda k: F.avg(F.when(F.col("half") == k, F.col("c")))
    return h.groupBy("cluster").agg(F.round(of(2) - of(1), 6).alias("drift"), F.round(F.stddev_pop("c"), 6).alias("spread"))


@query(sql(""", m AS (SELECT cluster, s, ch, median(x) AS m FROM wx GROUP BY ALL), r AS (SELECT spike_id, wx.cluster, sum((0.5 - 0.5 * cos(2 * pi() * (wx.s + 1) / 9)) * (x - m) * (x - m)) AS e FROM wx JOIN m ON wx.cluster = m.cluster AND wx.s = m.s AND wx.ch = m.ch GROUP BY ALL),
    c AS (SELECT cluster, median(e) AS med FROM r GROUP BY cluster), a AS (SELECT r.cluster, any_value(med) AS med, median(abs(e - med)) AS mad FROM r JOIN c ON r.cluster = c.cluster GROUP BY r.cluster)
    SELECT spike_id, r.cluster, round(e, 2) AS residual, e > med + 4 * 1.4826 * mad AS outlier FROM r JOIN a ON r.cluster = a.cluster""", "wx"))
def waveform_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Spikes whose residual to their unit's median, weighted towards the middle, is far above the unit's usual."""
    w = waveform_values(spark, d)
    m = w.groupBy("cluster", "s", "ch").agg(F.percentile("x", F.lit(0.5)).alias("m"))
    weight = 0.5 - 0.5 * F.cos(2 * F.pi() * (F.col("s") + 1) / 9)
    r = w.join(m, ["cluster", "s", "ch"]).groupBy("spike_id", "cluster").agg(F.sum(weight * (F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))).alias("x"))
    a = P.median_and_mad(r, ["cluster"])  # the 1.4826 is in it
    return r.join(a, "cluster").select("spike_id", "cluster", F.round("x", 2).alias("residual"), (F.col("x") > F.col("med") + 4 * F.col("mad")).alias("outlier"))


@query(sql(", m AS (SELECT d, avg(x) AS m FROM fx WHERE cluster = 3 GROUP BY d), c AS (SELECT spike_id, cluster, sum(x * m) / sqrt(sum(x * x) * sum(m * m)) AS c FROM fx JOIN m USING (d) WHERE cluster <> 3 GROUP BY ALL) SELECT spike_id, cluster, round(c, 6) AS cosine, CASE WHEN c >= 0.1 THEN 3 ELSE cluster END AS label FROM c", "fx"))
def strip_by_template(spark: SparkSession, d: str) -> DataFrame:
    """Spikes of all other units that match a unit's template are pulled to it."""
    f = feature_values(spark, d)
    m = f.filter("cluster = 3").groupBy("d").agg(F.avg("x").alias("m"))
    x, t = F.col("x"), F.col("m")
    c = f.filter("cluster <> 3").join(F.broadcast(m), "d").groupBy("spike_id", "cluster").agg((F.sum(x * t) / F.sqrt(F.sum(x * x) * F.sum(t * t))).alias("c"))
    return c.select("spike_id", "cluster", F.round("c", 6).alias("cosine"), F.when(F.col("c") >= 0.1, 3).otherwise(F.col("cluster")).alias("label"))


@query(sql(", s AS (SELECT * FROM spikes) SELECT f.spike_id, len(fet) + 1 AS width, s.t, list_sum(fet) + s.t AS total FROM features f JOIN s USING (spike_id)", "features", "spikes"))
def features_with_times(spark: SparkSession, d: str) -> DataFrame:
    """Features with their spike's time as the last column."""
    f = features(spark, d).select("spike_id", "fet").join(spikes(spark, d).select("spike_id", "t"), "spike_id").withColumn("fet", F.array_append("fet", F.col("t")))
    return f.select("spike_id", F.size("fet").cast("long").alias("width"), F.element_at("fet", -1).alias("t"), F.aggregate("fet", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(sql(""", n AS (SELECT spike_id, cluster, fet, row_number() OVER (PARTITION BY cluster ORDER BY spike_id) AS i FROM features), p AS (SELECT a.spike_id, b.spike_id AS other, list_sum(list_transform(range(1, 65), lambda k: (a.fet[k] - b.fet[k]) ** 2)) AS dist FROM n a JOIN n b ON a.cluster = b.cluster AND b.i BETWEEN a.i - 20 AND a.i - 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY spike_id ORDER BY dist, other) AS k FROM p) SELECT n.spike_id, n.cluster, max(r.other) AS predecessor FROM n LEFT JOIN r ON r.spike_id = n.spike_id AND r.k <= 5 GROUP BY ALL""", "features"))
def causal_neighbour(spark: SparkSession, d: str) -> DataFrame:
    """The latest of the five nearest among a spike's last twenty of its unit; null for the first."""
    w = Window.partitionBy("cluster").orderBy("spike_id")
    before = F.collect_list(F.struct("spike_id", "fet")).over(w.rowsBetween(-20, -1))
    dist = lambda o: F.aggregate(F.zip_with("fet", o["fet"], lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda a, x: a + x)
    near = F.slice(F.array_sort(F.transform("before", lambda o: F.struct(dist(o).alias("dist"), o["spike_id"].alias("id")))), 1, 5)
    return features(spark, d).withColumn("before", before).select("spike_id", "cluster", F.array_max(F.transform(near, lambda o: o["id"])).alias("predecessor"))


AVAILABLE = """, i AS (SELECT cluster, spike_id, t, t - lag(t) OVER w AS isi, row_number() OVER w AS i FROM spikes WINDOW w AS (PARTITION BY cluster ORDER BY t, spike_id)),
    r AS (SELECT cluster, i, 1.0::DOUBLE AS fast, 1.0::DOUBLE AS slow FROM i WHERE i = 1 UNION ALL SELECT i.cluster, i.i, 1 - (1 - r.fast * 0.6) * exp(-i.isi / 7200.0), 1 - (1 - r.slow * 0.9) * exp(-i.isi / 86400.0) FROM r JOIN i ON i.cluster = r.cluster AND i.i = r.i + 1)
    SELECT i.spike_id, i.cluster, round(r.fast, 6) AS fast, round(r.slow, 6) AS slow FROM i JOIN r ON i.cluster = r.cluster AND i.i = r.i"""


@query(sql(AVAILABLE, "spikes", recursive=True))
def availability(spark: SparkSession, d: str) -> DataFrame:
    """Short-term depression over two time constants: each spike uses a part of what is there, which recovers until the next."""
    return T.depression(spikes(spark, d), {"fast": (0.4, 7200.0), "slow": (0.1, 86400.0)}).select("spike_id", "cluster", F.round("fast", 6).alias("fast"), F.round("slow", 6).alias("slow"))


CHUNKS = """, h AS (SELECT grp, t // 86400 AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) // count(*) AS level FROM spikes GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY day) AS i FROM h),
    r AS (SELECT grp, i, day, level AS low, level AS high, day AS start, 0 AS chunk FROM n WHERE i = 1 UNION ALL
        SELECT n.grp, n.i, n.day, CASE WHEN cut THEN n.level ELSE least(r.low, n.level) END, CASE WHEN cut THEN n.level ELSE greatest(r.high, n.level) END, CASE WHEN cut THEN n.day ELSE r.start END, r.chunk + CAST(cut AS INT)
        FROM (SELECT r.*, greatest(r.high, n.level) - least(r.low, n.level) >= 400 AND n.day - r.start >= 2 AS cut FROM r JOIN n ON n.grp = r.grp AND n.i = r.i + 1) r JOIN n ON n.grp = r.grp AND n.i = r.i + 1)
    SELECT grp, day, CAST(chunk AS BIGINT) AS chunk FROM r"""


@query(sql(CHUNKS, "spikes", recursive=True))
def drift_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Days in chunks: a new one begins where the running range of the daily level would be too wide and the chunk is long enough. A row per group and day is scanned in order."""
    level = F.expr("sum(CAST(round(value * 100) AS BIGINT)) div count(*)")
    h = spikes(spark, d).groupBy("grp", F.expr("t div 86400").alias("day")).agg(level.alias("level"))
    return T.drift_chunks(h, "grp", "day", "level", 400, 2).select("grp", "day", "chunk")


@query(sql(DIAG + ERROR.replace("SELECT cluster AS a, m AS b,", ", x AS (SELECT cluster AS a, m AS b,", 1) + """), y AS (SELECT x.a, max(x.error + y.error) / 2 AS worst FROM x JOIN x y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)
    SELECT a AS cluster, round(worst, 5) AS worst, row_number() OVER (ORDER BY round(worst, 5) DESC, a) AS place FROM y""", "fx"))
def order_by_error(spark: SparkSession, d: str) -> DataFrame:
    """Units by their largest symmetrised error with another, falling; a row per unit is ranked."""
    e = QUERIES["error_matrix"](spark, d).filter("a <> b")
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("error").alias("back"))
    worst = e.join(back, ["a", "b"]).groupBy(F.col("a").alias("cluster")).agg(F.round(F.max((F.col("error") + F.col("back")) / 2), 5).alias("worst"))
    return worst.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("worst"), "cluster")).cast("long"))


@query(sql(""", m AS (SELECT cluster, spike_id, max(abs(x)) AS peak, arg_max(d, (abs(x), -d)) AS place FROM fx GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY peak DESC, spike_id) AS k FROM m) SELECT cluster, spike_id, peak, place, k FROM r WHERE k <= 5""", "fx"))
def largest_spikes(spark: SparkSession, d: str) -> DataFrame:
    """The five largest spikes of each unit, each with the first place of its peak: a report."""
    m = feature_values(spark, d).groupBy("cluster", "spike_id").agg(F.max(F.abs("x")).alias("peak"), F.max_by("d", F.struct(F.abs("x"), -F.col("d"))).alias("place"))
    k = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("peak"), "spike_id")).cast("long")
    return m.withColumn("k", k).filter("k <= 5").select("cluster", "spike_id", "peak", "place", "k")


@query(sql("SELECT cluster, list_position([7, 2, 9, 4], cluster) AS place, CASE WHEN cluster < 2 THEN cluster WHEN list_contains([7, 2, 9, 4], cluster) THEN list_position([7, 2, 9, 4], cluster) + 1 ELSE cluster + 100 END AS label, count(*) AS n FROM features GROUP BY cluster", "features"))
def explicit_order(spark: SparkSession, d: str) -> DataFrame:
    """Units renumbered from a list, from 2; others go behind and noise stays."""
    place = F.nullif(F.array_position(F.array(*[F.lit(x).cast("long") for x in (7, 2, 9, 4)]), F.col("cluster")), F.lit(0).cast("long")).cast("int")
    label = F.when(F.col("cluster") < 2, F.col("cluster")).when(place.isNotNull(), place + 1).otherwise(F.col("cluster") + 100)
    return features(spark, d).groupBy("cluster").agg(F.count("*").alias("n")).select("cluster", place.alias("place"), label.cast("long").alias("label"), "n")


@query(sql(""", m AS (SELECT cluster, d, avg(x) AS m FROM fx GROUP BY ALL), z AS (SELECT unnest(range(0, 64)) AS shift), c AS (SELECT a.cluster AS a, b.cluster AS b, shift, sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)) AS c FROM m a, z, m b WHERE a.cluster < b.cluster AND b.d = (a.d + shift) % 64 GROUP BY ALL)
    SELECT a, b, round(max(c), 6) AS best, arg_max(shift, (round(c, 9), -shift)) AS shift FROM c GROUP BY a, b""", "fx"))
def circular_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The largest cosine of two mean vectors over all shifts around."""
    m = feature_values(spark, d).groupBy("cluster", "d").agg(F.avg("x").alias("m")).groupBy("cluster")
    m = m.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda p: p["m"]).alias("v"))
    a, b = m.select(F.col("cluster").alias("a"), F.col("v").alias("x")), m.select(F.col("cluster").alias("b"), F.col("v").alias("y"))
    turned = lambda k: F.concat(F.slice("y", k + 1, 64 - k), F.slice("y", F.lit(1), k))
    c = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.struct(F.round(A.cosine(F.col("x"), turned(k)), 9).alias("c"), (-k).alias("k")))
    top = a.join(b, F.col("a") < F.col("b")).withColumn("top", F.array_max(c))
    return top.select("a", "b", F.round("top.c", 6).alias("best"), (-F.col("top.k")).cast("long").alias("shift"))


@query(sql(""", m AS (SELECT cluster, s, ch, avg(x) AS m FROM wx GROUP BY ALL), p AS (SELECT cluster, ch, max(m) - min(m) AS amp, arg_max(m, (round(abs(m), 6), -s)) AS peak, sum(m) AS area FROM m GROUP BY ALL)
    SELECT a.cluster AS a, b.cluster AS b, round(sum(a.amp * b.amp) / sqrt(sum(a.amp * a.amp) * sum(b.amp * b.amp)), 6) AS amplitude, round(corr(a.peak, b.peak), 6) AS polarity, round(corr(a.area, b.area), 6) AS shape FROM p a JOIN p b ON a.ch = b.ch AND a.cluster < b.cluster GROUP BY ALL""", "wx"))
def profile_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Units compared channel by channel: cosine of the swings, correlation of the signed peaks and of the areas."""
    m = waveform_values(spark, d).groupBy("cluster", "s", "ch").agg(F.avg("x").alias("m"))
    p = m.groupBy("cluster", "ch").agg((F.max("m") - F.min("m")).alias("amp"), F.max_by("m", F.struct(F.round(F.abs("m"), 6), -F.col("s"))).alias("peak"), F.sum("m").alias("area"))
    a, b = (p.select("ch", F.col("cluster").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("amp", "peak", "area")]) for n in "ab")
    x, y = F.col("amp_a"), F.col("amp_b")
    return a.join(b, "ch").filter("a < b").groupBy("a", "b").agg(
        F.round(F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y)), 6).alias("amplitude"), F.round(F.corr("peak_a", "peak_b"), 6).alias("polarity"), F.round(F.corr("area_a", "area_b"), 6).alias("shape")
    )


@query(sql("SELECT spike_id, round(list_sum(list_transform(range(1, 65), lambda i: fet[i] * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 63)))), 4) AS tapered, CAST(list_min(fet) AS BIGINT) AS low, round(list_sum(list_transform(fet, lambda x: least(500, greatest(-500, x)))), 4) AS clipped, round(sqrt(list_sum(list_transform(fet, lambda x: x * x))), 4) AS norm FROM features", "features"))
def tapered_vectors(spark: SparkSession, d: str) -> DataFrame:
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    clipped = F.transform("fet", lambda x: F.least(F.lit(500), F.greatest(F.lit(-500), x)).cast("double"))
    return features(spark, d).select("spike_id", F.round(total(A.hann(F.col("fet"))), 4).alias("tapered"), F.array_min("fet").alias("low"), F.round(total(clipped), 4).alias("clipped"), F.round(A.norm(F.col("fet").cast("array<double>")), 4).alias("norm"))


@query(sql(""", c AS (SELECT cluster, count(*) AS n, count(*) FILTER (t % 86400 < 43200) AS k FROM spikes GROUP BY cluster)
    SELECT cluster, n, k, round(list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 9) AS even_tail, round(1 - list_sum(list_transform(range(0, k + 1), lambda i: CASE WHEN i < k THEN exp(i * ln(30.0) - 30 - lgamma(i + 1)) ELSE 0 END)), 9) AS poisson_tail FROM c""", "spikes"))
def count_tails(spark: SparkSession, d: str) -> DataFrame:
    """How likely so many spikes in half of the day or more are by an even split, and by a Poisson rate of 30."""
    c = spikes(spark, d).groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(F.col("t") % 86400 < 43200).alias("k"))
    return c.select("cluster", "n", "k", F.round(A.even_split_tail(F.col("k"), F.col("n")), 9).alias("even_tail"), F.round(A.poisson_tail(F.col("k"), 30.0), 9).alias("poisson_tail"))


@query(sql("SELECT spike_id, list_transform(range(1, 65), lambda i: round(0.75 * coalesce(fet[i - 2], 0) * CAST(i > 2 AS INT) + 0.25 * coalesce(fet[i - 3], 0) * CAST(i > 3 AS INT), 4))[10] AS tenth, round(list_sum(list_transform(range(1, 65), lambda i: 0.75 * CASE WHEN i > 2 THEN fet[i - 2] ELSE 0 END + 0.25 * CASE WHEN i > 3 THEN fet[i - 3] ELSE 0 END)), 4) AS total FROM features", "features"))
def depth_shift(spark: SparkSession, d: str) -> DataFrame:
    """A profile moved by 2.25 places, by linear interpolation with zeros from outside."""
    f = features(spark, d).withColumn("moved", A.shifted(F.col("fet"), 2.25))
    return f.select("spike_id", F.round(F.get("moved", 9), 4).alias("tenth"), F.round(F.aggregate("moved", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(sql(""", m AS (SELECT cluster, ch, max(x) - min(x) AS a FROM wx GROUP BY ALL), c AS (SELECT cluster, sum(a * ch) / sum(a) AS y, max(a) AS top FROM m GROUP BY cluster)
    SELECT m.cluster, m.ch, round(top / sqrt((m.ch - y) ** 2 + 1.5 * 1.5), 4) AS predicted, round(a - top / sqrt((m.ch - y) ** 2 + 1.5 * 1.5), 4) AS off FROM m JOIN c ON m.cluster = c.cluster""", "wx"))
def monopole_profile(spark: SparkSession, d: str) -> DataFrame:
    """What a point source at the unit's centre would give on each channel: amplitude over distance."""
    m = waveform_values(spark, d).groupBy("cluster", "ch").agg((F.max("x") - F.min("x")).alias("a"))
    c = m.groupBy("cluster").agg((F.sum(F.col("a") * F.col("ch")) / F.sum("a")).alias("y"), F.max("a").alias("top"))
    p = F.col("top") / F.sqrt(F.pow(F.col("ch") - F.col("y"), 2) + 1.5 * 1.5)
    return m.join(c, "cluster").select("cluster", "ch", F.round(p, 4).alias("predicted"), F.round(F.col("a") - p, 4).alias("off"))


@query(sql("""SELECT cluster, spike_id // 100 AS part, '{"cluster":' || cluster || ',"part":' || spike_id // 100 || ',"n":' || count(*) || ',"ids":[' || string_agg(spike_id, ',' ORDER BY spike_id) || ']}' AS record
    FROM features WHERE cluster >= 2 GROUP BY cluster, spike_id // 100""", "features"))
def curation_records(spark: SparkSession, d: str) -> DataFrame:
    """A unit's state as lines of JSON, one for each range of a hundred ids, so that no line grows with the unit."""
    ids = F.sort_array(F.collect_list("spike_id")).alias("ids")
    u = features(spark, d).filter("cluster >= 2").groupBy("cluster", F.expr("spike_id div 100").alias("part")).agg(F.count("*").alias("n"), ids)
    return u.select("cluster", "part", F.to_json(F.struct("cluster", "part", "n", "ids")).alias("record"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS name, strftime(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d'), '%d.%m.%Y') AS told, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders")
def session_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates in session names, written and read back."""
    name = F.date_format("o_orderdate", "yyyyMMdd")
    back = F.to_date(name, "yyyyMMdd")
    return table(spark, d, "orders").select("o_orderkey", name.alias("name"), F.date_format(back, "dd.MM.yyyy").alias("told"), F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"))


_DIP = """, h AS (SELECT f.cluster, s.t FROM features f JOIN spikes s ON f.spike_id = s.spike_id), n AS (SELECT cluster, count(*) AS n FROM h GROUP BY cluster), m AS (SELECT cluster, d, avg(x) AS m FROM fx GROUP BY cluster, d),
    g AS (SELECT a.cluster AS a, b.cluster AS b, corr(a.m, b.m) AS r FROM m a JOIN m b ON a.d = b.d AND a.cluster < b.cluster GROUP BY a.cluster, b.cluster),
    c AS (SELECT x.cluster AS a, y.cluster AS b, count(*) FILTER (abs(x.t - y.t) <= 3600) AS centre, count(*) FILTER (abs(x.t - y.t) > 3600) AS flank FROM h x JOIN h y ON x.cluster < y.cluster AND abs(x.t - y.t) <= 36000 GROUP BY ALL),
    p AS (SELECT c.a, c.b, centre, flank, r, (centre / 7201.0) / (nullif(flank, 0) / 64800.0) AS dip, x.n AS na, y.n AS nb FROM c JOIN g ON c.a = g.a AND c.b = g.b JOIN n x ON x.cluster = c.a JOIN n y ON y.cluster = c.b),
    q AS (SELECT a, b, centre, flank, round(r, 6) AS alike, round(dip, 6) AS dip, coalesce(round(r, 9) >= -0.05 AND na >= 30 AND nb >= 30 AND flank >= 20 AND dip <= 0.9, false) AS merged FROM p)"""


def _dips(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of units with the rate of spikes near each other over that farther off, how alike their means are, and whether all gates hold."""
    f = features(spark, d)
    h = f.select("spike_id", "cluster").join(spikes(spark, d).select("spike_id", "t"), "spike_id")
    n = h.groupBy("cluster").agg(F.count("*").alias("n"))
    m = feature_values(spark, d).groupBy("cluster", "d").agg(F.avg("x").alias("m"))
    a, b = m.select("d", F.col("cluster").alias("ga"), F.col("m").alias("ma")), m.select("d", F.col("cluster").alias("gb"), F.col("m").alias("mb"))
    alike = a.join(b, "d").filter("ga < gb").groupBy("ga", "gb").agg(F.corr("ma", "mb").alias("r"))
    c = T.pair_rates(h, "cluster", 3600, 36_000)
    p = c.join(alike, (F.col("a") == F.col("ga")) & (F.col("b") == F.col("gb")))
    for side in ("a", "b"):
        p = p.join(n.select(F.col("cluster").alias(f"u{side}"), F.col("n").alias(f"n{side}")), F.col(side) == F.col(f"u{side}"))
    dip = (F.col("centre") / 7201.0) / (F.nullif("flank", F.lit(0)) / 64800.0)
    gates = (F.round("r", 9) >= -0.05) & (F.col("na") >= 30) & (F.col("nb") >= 30) & (F.col("flank") >= 20) & (dip <= 0.9)
    return p.select("a", "b", "centre", "flank", F.round("r", 6).alias("alike"), F.round(dip, 6).alias("dip"), F.coalesce(gates, F.lit(False)).alias("merged"))


@query(sql(_DIP + " SELECT * FROM q", "fx", "spikes"))
def correlogram_dip(spark: SparkSession, d: str) -> DataFrame:
    """Whether two units leave a gap around each other's spikes, as one unit's do: the rate at small lags over that at larger ones, for units alike and large enough."""
    return _dips(spark, d)


@query(sql(_DIP + """, u AS (SELECT a, b FROM q WHERE merged UNION SELECT b, a FROM q WHERE merged UNION SELECT cluster, cluster FROM n), w AS (SELECT a AS node, a AS root FROM u UNION SELECT u.a, w.root FROM w JOIN u ON u.b = w.node)
    SELECT node AS cluster, min(root) AS merged FROM w GROUP BY node""", "fx", "spikes", recursive=True))
def dip_groups(spark: SparkSession, d: str) -> DataFrame:
    """Units joined by gaps around each other's spikes, each group under its lowest id."""
    f = features(spark, d).select("spike_id", "cluster").join(spikes(spark, d).select("spike_id"), "spike_id")
    alone = f.select(F.col("cluster").alias("a"), F.col("cluster").alias("b")).distinct()
    return C.groups(_dips(spark, d).filter("merged").select("a", "b").unionByName(alone)).select(F.col("node").alias("cluster"), F.col("root").alias("merged"))


@query(sql(""", m AS (SELECT cluster, d, avg(x) AS m FROM fx GROUP BY ALL), p AS (SELECT a.cluster AS a, b.cluster AS b FROM m a JOIN m b ON a.d = b.d AND a.cluster < b.cluster GROUP BY ALL HAVING sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)) >= 0.15),
    u AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT cluster, cluster FROM m), r AS (SELECT a AS node, a AS root FROM u UNION SELECT u.a, r.root FROM r JOIN u ON u.b = r.node) SELECT node AS cluster, min(root) AS merged FROM r GROUP BY node""", "fx", recursive=True))
def auto_merge(spark: SparkSession, d: str) -> DataFrame:
    """Units joined to groups by the similarity of their means, each group under its lowest id."""
    pairs = QUERIES["similarity_matrix"](spark, d).filter("a < b AND cosine >= 0.15").select("a", "b")
    alone = features(spark, d).select(F.col("cluster").alias("a"), F.col("cluster").alias("b")).distinct()
    return C.groups(pairs.unionByName(alone)).select(F.col("node").alias("cluster"), F.col("root").alias("merged"))


@query(sql(""", v AS (SELECT id, grp, a, a + 15 AS b FROM intervals), r AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY grp ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM v), k AS (SELECT *, sum(CAST(new AS BIGINT)) OVER (PARTITION BY grp ORDER BY a, b, id) AS island FROM r),
    g AS (SELECT grp, min(a) AS a, max(b) AS b FROM k GROUP BY grp, island), o AS (SELECT o_orderkey, o_custkey % 20 AS grp, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS day FROM orders)
    SELECT o_orderkey, grp, EXISTS (SELECT 1 FROM g WHERE g.grp = o.grp AND o.day >= g.a AND o.day < g.b) AS inside FROM o""", "intervals"))
def scope_membership(spark: SparkSession, d: str) -> DataFrame:
    """Whether a time lies in the union of a group's intervals: merged, then the last one that begins before it."""
    g = T.merged(intervals(spark, d).withColumn("b", F.col("a") + 15), "grp").select("grp", F.col("a").alias("t"), F.col("b").alias("end"))
    day = F.expr("CAST(date_diff(CAST(o_orderdate AS DATE), DATE'1970-01-01') AS BIGINT)")
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("grp"), day.alias("t"))
    both = o.withColumn("end", F.lit(None).cast("long")).unionByName(g.withColumn("o_orderkey", F.lit(None).cast("long")))
    last = F.max("end").over(Window.partitionBy("grp").orderBy("t").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("last", last).filter("o_orderkey IS NOT NULL").select("o_orderkey", "grp", F.coalesce(F.col("t") < F.col("last"), F.lit(False)).alias("inside"))


@query(sql(""", m AS (SELECT cluster, d, sum(x) AS m FROM fx GROUP BY ALL), c AS (SELECT f.spike_id, f.cluster, k.shift, sum(f.x * m.m) AS c FROM fx f, (SELECT unnest(range(-3, 4)) AS shift) k JOIN m ON m.cluster = f.cluster AND m.d = f.d - k.shift GROUP BY ALL)
    SELECT spike_id, cluster, arg_max(shift, (c, -abs(shift), -shift)) AS shift, max(c) AS match FROM c GROUP BY ALL""", "fx"))
def realignment(spark: SparkSession, d: str) -> DataFrame:
    """The shift, up to three places, at which a spike agrees best with the sum of its unit's; ties to the smallest. Whole numbers throughout."""
    m = feature_values(spark, d).groupBy("cluster", "d").agg(F.sum("x").alias("m")).groupBy("cluster")
    m = m.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda p: p["m"]).alias("sums"))
    zero = F.lit(0).cast("long")
    moved = lambda k: F.transform("fet", lambda x, i: x * F.when(i >= k, F.coalesce(F.get("sums", i - k), zero)).otherwise(zero))
    at = lambda k: F.aggregate(moved(k), zero, lambda s, x: s + x)
    tried = F.array(*[F.struct(at(k).alias("c"), F.lit(-abs(k)).alias("n"), F.lit(-k).alias("k")) for k in range(-3, 4)])
    top = features(spark, d).join(m, "cluster").withColumn("top", F.array_max(tried))
    return top.select("spike_id", "cluster", (-F.col("top.k")).cast("long").alias("shift"), F.col("top.c").alias("match"))


@query(sql(", s AS (SELECT spike_id, cluster FROM features WHERE spike_id BETWEEN 100 AND 299), e AS (SELECT spike_id, CASE WHEN cluster = 2 THEN 12 ELSE cluster END AS cluster FROM s) SELECT f.spike_id, coalesce(e.cluster, f.cluster) AS cluster, e.cluster IS NOT NULL AS edited FROM features f LEFT JOIN e USING (spike_id)", "features"))
def integrate_session(spark: SparkSession, d: str) -> DataFrame:
    """A part of a session cut out, edited and put back in its place."""
    f = features(spark, d).select("spike_id", "cluster")
    part = f.filter(F.col("spike_id").between(100, 299)).select("spike_id", F.when(F.col("cluster") == 2, 12).otherwise(F.col("cluster")).alias("now"))
    return f.join(part, "spike_id", "left").select("spike_id", F.coalesce("now", "cluster").alias("cluster"), F.col("now").isNotNull().alias("edited"))


@query(sql(", w AS (SELECT spike_id, cluster, CASE WHEN cluster = 4 THEN 0 WHEN cluster = 6 THEN 7 ELSE cluster + spike_id % 2 END AS wanted FROM features) SELECT spike_id, cluster, CASE WHEN wanted < 2 OR wanted IN (7, 9) OR cluster IN (7, 9) THEN cluster ELSE wanted END AS label, wanted < 2 OR wanted IN (7, 9) OR cluster IN (7, 9) AS refused FROM w", "features"))
def protected_ids(spark: SparkSession, d: str) -> DataFrame:
    """Edits that would use or change reserved ids (0, 1) or ids laid to rest (7, 9) are refused."""
    c = F.col("cluster")
    wanted = F.when(c == 4, 0).when(c == 6, 7).otherwise(c + F.col("spike_id") % 2)
    f = features(spark, d).select("spike_id", "cluster", wanted.alias("wanted"))
    return C.protected(f, reserved=2, rested=[7, 9]).select("spike_id", "cluster", "label", "refused")
