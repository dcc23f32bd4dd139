"""Queries on traces: channel selection, filters, references and detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import signal as S
from ..operators import timing as T
from ..sources.adapters import features, sql, trace_values, traces
from .registry import query


@query(sql("SELECT session, ch, round(4 * median(abs(x)) / 0.6745, 6) AS threshold, round(median(abs(x)), 4) AS med FROM tx GROUP BY session, ch", "tx"))
def median_threshold(spark: SparkSession, d: str) -> DataFrame:
    med = F.percentile(F.abs("x"), F.lit(0.5))
    return trace_values(spark, d).groupBy("session", "ch").agg(F.round(4 * med / 0.6745, 6).alias("threshold"), F.round(med, 4).alias("med"))


@query(sql(", r AS (SELECT session, ch, abs(x) AS x, row_number() OVER (PARTITION BY session, ch ORDER BY abs(x)) - 1 AS i, count(*) OVER (PARTITION BY session, ch) AS n FROM tx) SELECT session, ch, max(x) AS upper_median FROM r WHERE i = n // 2 GROUP BY session, ch", "tx"))
def upper_median_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The n // 2-th value, without averaging, from a histogram of the whole numbers that occur: channels are counted before they are ranked."""
    return S.upper_median(trace_values(spark, d).select("session", "ch", F.abs("x").alias("x")), ["session", "ch"]).withColumnRenamed("x", "upper_median")


@query(sql(""", f AS (SELECT *, list(x) OVER w AS l FROM tx WINDOW w AS (PARTITION BY session, ch ORDER BY sample ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
    SELECT session, ch, sample, x - list_sort(list_concat(l, list_resize([]::BIGINT[], 7 - len(l), 0)))[4] AS y FROM f""", "tx"))
def median_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.median_highpass(trace_values(spark, d), 3).select("session", "ch", "sample", "y")


@query(sql("""SELECT session, ch, sample, coalesce(lag(x, 2) OVER w, 0) + 4 * coalesce(lag(x, 1) OVER w, 0) + 6 * x + 4 * coalesce(lead(x, 1) OVER w, 0) + coalesce(lead(x, 2) OVER w, 0) AS y FROM tx WINDOW w AS (PARTITION BY session, ch ORDER BY sample)""", "tx"))
def fir_lowpass(spark: SparkSession, d: str) -> DataFrame:
    return S.fir(trace_values(spark, d), [1, 4, 6, 4, 1]).select("session", "ch", "sample", "y")


@query(sql(", f AS (SELECT session, ch, sample, coalesce(lag(x, 1) OVER w, 0) + 2 * x + coalesce(lead(x, 1) OVER w, 0) AS y FROM tx WINDOW w AS (PARTITION BY session, ch ORDER BY sample)) SELECT session, ch, sample // 4 AS sample, y FROM f WHERE sample % 4 = 0", "tx"))
def decimate(spark: SparkSession, d: str) -> DataFrame:
    y = S.fir(trace_values(spark, d), [1, 2, 1]).filter("sample % 4 = 0")
    return y.select("session", "ch", F.expr("sample div 4").alias("sample"), "y")


@query(sql("SELECT session, sample, ch, round(x - avg(x) OVER (PARTITION BY session, sample), 6) AS y FROM tx", "tx"))
def common_average_reference(spark: SparkSession, d: str) -> DataFrame:
    """Within the row's own array; no shuffle."""
    t = traces(spark, d)
    mean = F.aggregate("xs", F.lit(0).cast("long"), lambda s, x: s + x) / F.size("xs")
    return t.withColumn("m", mean).select("session", "sample", "m", F.posexplode("xs").alias("ch", "x")).select("session", "sample", F.col("ch").cast("long").alias("ch"), F.round(F.col("x") - F.col("m"), 6).alias("y"))


@query(sql(""", r AS (SELECT session, sample, ch, xs[1] AS ref, xs[ch + 1] AS x FROM traces, range(1, 4) c(ch)), m AS (SELECT session, ch, avg(ref) AS mr, avg(x) AS mx, regr_slope(x, ref) AS beta FROM r GROUP BY session, ch)
    SELECT r.session, sample, r.ch, round(x - mx - beta * (ref - mr), 6) AS residual FROM r JOIN m ON r.session = m.session AND r.ch = m.ch""", "traces"))
def reference_regression(spark: SparkSession, d: str) -> DataFrame:
    """Every channel without what the first tells of it."""
    return S.regressed(traces(spark, d), 0).withColumn("residual", F.round("y", 6)).drop("y")


SPATIAL = {
    1: "[xs[1] - xs[2], xs[2] - xs[3], xs[3] - xs[4], xs[4] - xs[3]]",
    2: "[xs[1] - xs[2], xs[2] - (xs[1] + xs[3]) / 2, xs[3] - (xs[2] + xs[4]) / 2, xs[4] - xs[3]]",
    3: "list_transform(xs, lambda x: 4 * x - list_sum(xs))",
}


def _spatial(order: int) -> None:
    oracle = f", y AS (SELECT session, sample, {SPATIAL[order]} AS y FROM traces) SELECT session, sample, CAST(y[1] AS DOUBLE) AS y0, CAST(y[2] AS DOUBLE) AS y1, CAST(y[3] AS DOUBLE) AS y2, CAST(y[4] AS DOUBLE) AS y3 FROM y"

    @query(sql(oracle, "traces"), name=f"spatial_difference_{order}")
    def spatial(spark: SparkSession, d: str) -> DataFrame:
        y = A.spatial(F.col("xs"), order)
        return traces(spark, d).withColumn("y", y).select("session", "sample", *[F.get("y", i).alias(f"y{i}") for i in range(4)])


for _order in SPATIAL:
    _spatial(_order)


@query(sql(f", y AS (SELECT session, sample, list_transform({SPATIAL[2]}, lambda v: CAST(v AS DOUBLE)) AS y FROM traces), v AS (SELECT session, sample, unnest(y) AS a, unnest(range(0, 4)) AS ch FROM y) SELECT session, ch, sample, a - coalesce(lag(a) OVER (PARTITION BY session, ch ORDER BY sample), 0) AS y FROM v", "traces"))
def spatiotemporal_difference(spark: SparkSession, d: str) -> DataFrame:
    """Every channel's first difference in time after that across channels."""
    t = S.stepped(traces(spark, d).withColumn("xs", A.spatial(F.col("xs"), 2)))
    return t.select("session", "sample", F.posexplode("xs").alias("ch", "y")).withColumn("ch", F.col("ch").cast("long"))


@query(sql("SELECT session, sample, round(CAST(xs[2] - (xs[1] + xs[3]) / 2.0 AS DOUBLE), 6) AS e0, round(CAST(xs[1] AS DOUBLE) ^ 2 - 3 * xs[4], 6) AS e1, round(coalesce(xs[2] / nullif(xs[3] + 0.0, 0), 0), 6) AS e2 FROM traces", "traces"))
def channel_expressions(spark: SparkSession, d: str) -> DataFrame:
    told = {"e0": "c1-(c0+c2)/2", "e1": "c0^2-3*c3"}
    e2 = F.coalesce(F.try_divide(F.get("xs", 1), F.get("xs", 2)), F.lit(0.0))
    return traces(spark, d).select("session", "sample", *[F.round(A.channel_expression(e), 6).alias(n) for n, e in told.items()], F.round(e2, 6).alias("e2"))


@query(sql("SELECT session, sample, round(CAST(xs[1] * 1.5 AS DOUBLE), 6) AS a, xs[3] - xs[1] AS b, -xs[4] AS c FROM traces WHERE sample BETWEEN 100 AND 199", "traces"))
def extract_channels(spark: SparkSession, d: str) -> DataFrame:
    """A gain, a reference and a reversal on a slice of time."""
    at = lambda i: F.get("xs", i)
    return traces(spark, d).filter(F.col("sample").between(100, 199)).select("session", "sample", F.round(at(0) * 1.5, 6).alias("a"), (at(2) - at(0)).alias("b"), (-at(3)).alias("c"))


@query(sql(", b AS (SELECT session, sample, xs[1] AS c2 FROM traces WHERE sample < 500) SELECT a.session, a.sample, a.xs[4] AS c0, a.xs[3] AS c1, b.c2 FROM traces a JOIN b ON a.session = b.session AND a.sample = b.sample", "traces"))
def merge_channels(spark: SparkSession, d: str) -> DataFrame:
    """Reordered channels of one record beside another's, cut to the shorter."""
    t = traces(spark, d)
    a = t.select("session", "sample", F.array(F.get("xs", 3), F.get("xs", 2)).alias("u"))
    b = t.filter("sample < 500").select("session", "sample", F.array(F.get("xs", 0)).alias("v"))
    return a.join(b, ["session", "sample"]).withColumn("m", F.concat("u", "v")).select("session", "sample", *[F.get("m", i).alias(f"c{i}") for i in range(3)])


@query(sql(", n AS (SELECT session, count(*) AS n FROM traces GROUP BY session), o AS (SELECT session, CAST(sum(n) OVER (ORDER BY session) - n AS BIGINT) AS o FROM n) SELECT t.session, sample, o + sample AS at FROM traces t JOIN o ON t.session = o.session", "traces"))
def concatenate_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Samples numbered through all sessions: the sessions' counts are summed, the samples stay where they are."""
    t = traces(spark, d).select("session", "sample")
    n = t.groupBy("session").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("session").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    o = n.select("session", (F.sum("n").over(w) - F.col("n")).alias("o"))
    return t.join(o, "session").select("session", "sample", (F.col("o") + F.col("sample")).alias("at"))


_CROSSED = """, l AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY session, ch ORDER BY sample), 45) AS b FROM tx), e AS (SELECT session, ch, sample, x FROM l WHERE x > 45 AND b <= 45),
    j AS (SELECT *, min(sample) OVER (PARTITION BY session, ch ORDER BY sample RANGE BETWEEN {step} FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM e),
    k AS (SELECT session, ch, min(sample) AS sample FROM e GROUP BY session, ch UNION ALL SELECT j.session, j.ch, j.next FROM k JOIN j ON k.session = j.session AND k.ch = j.ch AND k.sample = j.sample WHERE j.next IS NOT NULL)
    SELECT e.session, e.ch, e.sample, e.x FROM e JOIN k ON e.session = k.session AND e.ch = k.ch AND e.sample = k.sample"""


@query(sql(_CROSSED.format(step=12), "tx", recursive=True))
def threshold_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Upward crossings at least 12 samples after the last one kept."""
    return S.refractory(S.rising(trace_values(spark, d), 45), 12, reject_equal=False).select("session", "ch", "sample", "x")


@query(sql(", l AS (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM tx WINDOW w AS (PARTITION BY session, ch ORDER BY sample)) SELECT session, ch, sample, x FROM l WHERE abs(x) > 40 AND x >= b AND x > a", "tx"))
def local_extrema(spark: SparkSession, d: str) -> DataFrame:
    w = S.over_time("ch", "block")
    v = T.with_halo(trace_values(spark, d), "sample", 1, 1, S.BLOCK).withColumns({"b": F.lag("x").over(w), "a": F.lead("x").over(w)})
    return v.filter("own AND abs(x) > 40 AND x >= b AND x > a").select("session", "ch", "sample", "x")


@query(sql(_CROSSED.format(step=21).replace(", e.x FROM", " FROM"), "tx", recursive=True))
def refractory_detection(spark: SparkSession, d: str) -> DataFrame:
    """Crossings of each channel without those within 20 samples of the last one kept."""
    return S.refractory(S.rising(trace_values(spark, d), 45), 20).select("session", "ch", "sample")


@query(sql(""", l AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY session, ch ORDER BY sample), 49) AS b FROM tx), e AS (SELECT session, ch, sample FROM l WHERE x > 49 AND b <= 49)
    SELECT e.session, e.ch, e.sample, count(*) AS n, CAST(sum(tx.x) AS BIGINT) AS total, min(tx.x) AS low FROM e JOIN tx ON tx.session = e.session AND tx.ch = e.ch AND tx.sample >= e.sample - 4 AND tx.sample < e.sample + 8 GROUP BY e.session, e.ch, e.sample""", "tx"))
def extract_waveforms(spark: SparkSession, d: str) -> DataFrame:
    v = trace_values(spark, d)
    w = S.windows_around(v, S.rising(v, 49), 4, 8)
    total = F.aggregate("waveform", F.lit(0).cast("long"), lambda s, x: s + x)
    return w.select("session", "ch", "sample", F.size("waveform").cast("long").alias("n"), total.alias("total"), F.array_min("waveform").alias("low"))


@query(sql(""", l AS (SELECT *, CASE WHEN x // 10 = lag(x // 10) OVER (PARTITION BY session, ch ORDER BY sample) THEN 0 ELSE 1 END AS new FROM tx), r AS (SELECT session, ch, sum(new) OVER (PARTITION BY session, ch ORDER BY sample) AS run FROM l), n AS (SELECT session, ch, run, count(*) AS n FROM r GROUP BY session, ch, run)
    SELECT session, ch, max(n) AS longest, count(*) FILTER (n > 3) AS flat_runs FROM n GROUP BY session, ch""", "tx"))
def flat_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of samples in the same tens, of each channel."""
    return S.flat_runs(traces(spark, d).withColumn("xs", F.transform("xs", lambda x: F.call_function("div", x, F.lit(10)))), 4)


@query(sql("""SELECT spike_id, CAST(greatest(-32768, least(32767, sign(fet[1] / 2.0) * floor(abs(fet[1] / 2.0) + 0.5))) AS BIGINT) AS away, CAST(round_even(fet[1] / 2.0, 0) AS BIGINT) AS even, CAST(floor(fet[1] / 2.0 + 0.5) AS BIGINT) AS up,
    round(list_cosine_similarity(list_transform(fet[1:32], lambda x: CAST(x AS DOUBLE)), list_transform(fet[33:64], lambda x: CAST(x AS DOUBLE))), 6) AS cosine FROM features""", "features"))
def rounding_and_cosine(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d)
    x = F.get("fet", 0) / 2
    return f.select("spike_id", A.saturate(x).alias("away"), A.rint16(x).alias("even"), A.floor_half(x).alias("up"), F.round(A.cosine(F.slice("fet", 1, 32), F.slice("fet", 33, 32)), 6).alias("cosine"))


@query(sql("SELECT spike_id, fet[1:61] = r[4:64] AND r[1] = 0 AS shifted, o[1] AS wrapped FROM (SELECT spike_id, fet, list_concat([0, 0, 0], fet[1:61]) AS r, list_concat(fet[60:64], fet[1:59]) AS o FROM features)", "features"))
def roll_and_rotate(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d).withColumns({"r": A.roll(F.col("fet"), 3), "o": A.rotate(F.col("fet"), 5)})
    return f.select("spike_id", ((F.slice("r", 4, 61) == F.slice("fet", 1, 61)) & (F.get("r", 0) == 0)).alias("shifted"), F.get("o", 0).alias("wrapped"))
