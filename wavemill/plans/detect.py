"""Queries that detect and mask events, derive signals across channels and time, and cut records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import detection as D
from ..operators import filters as L
from ..operators import signal as S
from ..operators import timing as T
from ..sources.adapters import sql, trace_values, traces
from .registry import query
from .signal import SPATIAL


def _peaks_sql(of: str, thresholds: list[float], how: D.Peaks, tag: str = "") -> str:
    """Tables that end in f{tag}(session, sample, ch, value): the detection's events in the lists xs of `of`(session, sample, xs)."""
    limit = "[" + ", ".join(map(str, map(float, thresholds))) + "][ch + 1]"
    best = ("coalesce(low, high)" if how.negative_first else "either")
    ahead = f"(PARTITION BY session ORDER BY sample ROWS BETWEEN CURRENT ROW AND {how.length - 1} FOLLOWING)"
    return f""", v{tag} AS (SELECT session, sample, unnest(xs) AS x, unnest(range(0, len(xs))) AS ch FROM {of}),
        p{tag} AS (SELECT *, {limit} AS far, coalesce(lag(x) OVER w, x) AS b, coalesce(lead(x) OVER w, x) AS a, max(sample) OVER (PARTITION BY session) AS last FROM v{tag} WINDOW w AS (PARTITION BY session, ch ORDER BY sample)),
        r{tag} AS (SELECT *, CASE WHEN x > 0 THEN b <= x AND a <= x WHEN x < 0 THEN b >= x AND a >= x ELSE NOT ((b > 0 AND a < 0) OR (b < 0 AND a > 0)) END AND abs(x) >= far AS real FROM p{tag}),
        s{tag} AS (SELECT session, sample, last, bool_or(abs(x) >= far) AS over, min(row(x, sample, ch, x)) FILTER (real AND x < 0) AS low, min(row(-x, sample, ch, x)) FILTER (real AND x > 0) AS high,
            min(row(-abs(x), sample, ch, x)) FILTER (real) AS either FROM r{tag} GROUP BY ALL),
        w{tag} AS (SELECT session, sample, last, over, min(low) OVER w AS low, min(high) OVER w AS high, min(either) OVER w AS either FROM s{tag} WINDOW w AS {ahead}),
        e{tag} AS (SELECT session, sample, last, {best} AS best, CASE WHEN {best} IS NULL THEN sample + {how.length} ELSE greatest({best}[2] + {how.length - how.before}, sample + 1) END AS after
            FROM w{tag} WHERE over AND sample >= {how.before} AND sample + {how.length - 1} <= last),
        j{tag} AS (SELECT *, min(sample) OVER (PARTITION BY session ORDER BY sample RANGE BETWEEN after - sample FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM e{tag}),
        k{tag} AS (SELECT session, min(sample) AS sample FROM j{tag} GROUP BY session UNION ALL SELECT j.session, j.next FROM k{tag} k JOIN j{tag} j ON k.session = j.session AND k.sample = j.sample WHERE j.next IS NOT NULL),
        c{tag} AS (SELECT j.session, best[2] AS sample, best[3] AS ch, best[4] AS value FROM k{tag} k JOIN j{tag} j ON k.session = j.session AND k.sample = j.sample WHERE best IS NOT NULL AND best[2] + {how.after} <= last),
        d{tag} AS (SELECT *, min(sample) OVER (PARTITION BY session ORDER BY sample RANGE BETWEEN {how.refractory + 1} FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM c{tag}),
        h{tag} AS (SELECT session, min(sample) AS sample FROM c{tag} GROUP BY session UNION ALL SELECT d.session, d.next FROM h{tag} h JOIN d{tag} d ON h.session = d.session AND h.sample = d.sample WHERE d.next IS NOT NULL),
        f{tag} AS (SELECT c.session, c.sample, c.ch, c.value FROM c{tag} c JOIN h{tag} h ON c.session = h.session AND c.sample = h.sample)"""


_EVENTS = " SELECT session, sample, ch, CAST(value AS DOUBLE) AS value FROM f"
#: The channels about their middles, and how far from those is beyond the threshold.
_MIDDLES, _LIMITS = [25, 380, 5, 4], [22, 500, 5, 4]
_CENTRED = "o AS (SELECT session, sample, list_transform([1, 2, 3, 4], lambda i: xs[i] - [25, 380, 5, 4][i]) AS xs FROM traces)"


def _centred(spark: SparkSession, d: str) -> DataFrame:
    middles = F.array(*map(F.lit, _MIDDLES))
    return traces(spark, d).withColumn("xs", F.transform("xs", lambda x, i: x - F.get(middles, i)))


def _events(found: DataFrame, *more: str) -> DataFrame:
    return found.select(*more, "session", "sample", "ch", F.col("value").cast("double").alias("value"))


@query(sql(", " + _CENTRED + _peaks_sql("o", _LIMITS, D.Peaks(negative_first=False)) + _EVENTS, "traces", recursive=True))
def absolute_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Events over all channels by the largest peak of each window, either way."""
    return _events(D.detect(_centred(spark, d), _LIMITS, D.Peaks(negative_first=False)))


@query(sql(", " + _CENTRED + _peaks_sql("o", _LIMITS, D.Peaks()) + _EVENTS, "traces", recursive=True))
def negative_first_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Events over all channels by the lowest peak of each window, or its highest where none is low enough."""
    return _events(D.detect(_centred(spark, d), _LIMITS))


#: Limits of the differences across channels, by order.
_SPATIAL_LIMITS = {1: [700, 700, 6, 6], 2: [700, 600, 320, 6], 3: [1500, 2800, 1400, 1400]}


def _spatial_detection(order: int) -> None:
    how = D.Peaks(length=12, before=4, after=8, refractory=6)
    o = f", o AS (SELECT session, sample, list_transform({SPATIAL[order]}, lambda v: CAST(v AS DOUBLE)) AS xs FROM traces)"

    @query(sql(o + _peaks_sql("o", _SPATIAL_LIMITS[order], how) + _EVENTS, "traces", recursive=True), name=f"spatial_detection_{order}")
    def spatial_detection(spark: SparkSession, d: str) -> DataFrame:
        """Events in differences across channels."""
        return _events(D.detect(traces(spark, d).withColumn("xs", A.spatial(F.col("xs"), order)), _SPATIAL_LIMITS[order], how))


for _order in SPATIAL:
    _spatial_detection(_order)


#: Groups of channels, each with limits and rules of its own.
_GROUPS = {"a": [1, 0], "b": [3, 2], "c": [2]}
_GROUP_LIMITS = {"a": [400, 20], "b": [4, 5], "c": [4]}
_GROUP_RULES = {"a": D.Peaks(), "b": D.Peaks(length=10, before=3, after=6, refractory=4), "c": D.Peaks(length=8, before=2, after=2, refractory=3, negative_first=False)}


def _groups_sql() -> str:
    parts, last = ", " + _CENTRED, []
    for name, channels in _GROUPS.items():
        parts += f", o{name} AS (SELECT session, sample, [{', '.join(f'xs[{c + 1}]' for c in channels)}] AS xs FROM o)" + _peaks_sql(f"o{name}", _GROUP_LIMITS[name], _GROUP_RULES[name], name)
        last.append(f"SELECT '{name}' AS grp, session, sample, {channels}[ch + 1] AS ch, CAST(value AS DOUBLE) AS value FROM f{name}")
    return parts + " " + " UNION ALL ".join(last)


@query(sql(_groups_sql(), "traces", recursive=True))
def grouped_detection(spark: SparkSession, d: str) -> DataFrame:
    """Detection over every group of channels, with its own limits and rules."""
    return _events(D.by_group(_centred(spark, d), _GROUPS, _GROUP_LIMITS, _GROUP_RULES), "grp")


@query(sql("""SELECT session, sample, xs[1] - xs[3] AS y0, xs[2] - xs[1] AS y1, xs[3] - (xs[1] + xs[2]) / 2 AS y2, xs[4] - (xs[1] + xs[2] + xs[3]) / 3 AS y3 FROM traces""", "traces"))
def custom_references(spark: SparkSession, d: str) -> DataFrame:
    """Each channel less its own partner, or less the mean of a set of channels."""
    y = A.referenced(F.col("xs"), {0: [2], 1: [0], 2: [0, 1], 3: [0, 1, 2]})
    return traces(spark, d).withColumn("y", y).select("session", "sample", *[F.get("y", i).alias(f"y{i}") for i in range(4)])


_STEPS = """, less AS (SELECT session, sample, list_transform(xs, lambda x: x - list_sum(xs) / 4.0) AS c FROM traces), o AS (
    SELECT session, sample, list_transform([1, 2, 3, 4], lambda i: CAST(c[i] - coalesce(b[i], 0) AS DOUBLE)) AS xs FROM (SELECT *, lag(c) OVER (PARTITION BY session ORDER BY sample) AS b FROM less))"""
_STEP_LIMITS = [180, 560, 190, 190]


@query(sql(_STEPS + _peaks_sql("o", _STEP_LIMITS, D.Peaks(length=12, before=4)) + _EVENTS, "traces", recursive=True))
def referenced_step_detection(spark: SparkSession, d: str) -> DataFrame:
    """Events in the first difference in time of what is left of the channels' mean."""
    mean = F.aggregate("xs", F.lit(0).cast("long"), lambda s, x: s + x) / F.size("xs")
    t = traces(spark, d).withColumn("_m", mean).withColumn("xs", F.transform("xs", lambda x: x - F.col("_m"))).drop("_m")
    return _events(D.detect(S.stepped(t), _STEP_LIMITS, D.Peaks(length=12, before=4)))


CROSS = ", l AS (SELECT *, lag(x) OVER (PARTITION BY session, ch ORDER BY sample) AS b FROM tx), hi AS MATERIALIZED (SELECT session, ch, sample FROM l WHERE x > 45 AND coalesce(b, 45) <= 45), lo AS MATERIALIZED (SELECT session, ch, sample FROM l WHERE x > 30 AND coalesce(b, 30) <= 30)"


@query(sql(CROSS + " SELECT session, ch, sample FROM lo WHERE NOT EXISTS (SELECT 1 FROM hi WHERE hi.session = lo.session AND hi.ch = lo.ch AND hi.sample BETWEEN lo.sample - 5 AND lo.sample + 5)", "tx"))
def masked_redetection(spark: SparkSession, d: str) -> DataFrame:
    """Crossings of a lower threshold that no known event is near."""
    v = trace_values(spark, d)
    known = S.rising(v, 45).select(F.col("session").alias("r_session"), F.col("ch").alias("r_ch"), F.col("sample").alias("rt"))
    found = S.rising(v, 30).select("session", "ch", F.col("sample").alias("t"))
    return T.band_join(found, known, ["session", "ch"], -5, 5, "left_anti").select("session", "ch", F.col("t").alias("sample"))


@query(sql(CROSS + """, u AS (SELECT session, ch, sample, 1 AS label FROM hi UNION ALL SELECT session, ch, sample, 0 FROM lo)
    SELECT session, ch, sample, max(label) AS label FROM u GROUP BY session, ch, sample""", "tx"))
def redetection_merge(spark: SparkSession, d: str) -> DataFrame:
    """Known and newly found events in one list; of one sample the known one stays, new ones have label 0."""
    v = trace_values(spark, d)
    both = S.rising(v, 45).withColumn("label", F.lit(1)).unionByName(S.rising(v, 30).withColumn("label", F.lit(0)))
    return both.groupBy("session", "ch", "sample").agg(F.max("label").alias("label"))


@query(sql(CROSS + """, b AS (SELECT session, ch, sample // 8 AS block, count(*) AS n, avg(x) AS m, max(x) - min(x) AS span FROM tx GROUP BY ALL), e AS (SELECT DISTINCT session, ch, sample // 8 AS block FROM lo),
    q AS (SELECT session, ch, block FROM b WHERE n = 8 AND span > 2 AND NOT EXISTS (SELECT 1 FROM e WHERE e.session = b.session AND e.ch = b.ch AND e.block = b.block))
    SELECT tx.ch, sample % 8 AS s, count(*) AS n, round(avg(x), 4) AS mean, round(var_samp(x), 3) AS var FROM tx JOIN q ON tx.session = q.session AND tx.ch = q.ch AND sample // 8 = q.block GROUP BY tx.ch, s""", "tx"))
def noise_windows(spark: SparkSession, d: str) -> DataFrame:
    """Mean and variance of windows without events that are not flat, by channel and place."""
    v = trace_values(spark, d).withColumn("block", F.expr("sample div 8"))
    e = S.rising(trace_values(spark, d), 30).select("session", "ch", F.expr("sample div 8").alias("block")).distinct()
    b = v.groupBy("session", "ch", "block").agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("span")).filter("n = 8 AND span > 2")
    quiet = b.join(e, ["session", "ch", "block"], "left_anti").select("session", "ch", "block")
    return v.join(quiet, ["session", "ch", "block"]).groupBy("ch", (F.col("sample") % 8).alias("s")).agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.var_samp("x"), 3).alias("var"))


@query(sql(CROSS + """, r AS (SELECT session, ch, sample, sum(CASE WHEN x // 10 = b // 10 THEN 0 ELSE 1 END) OVER (PARTITION BY session, ch ORDER BY sample) AS run FROM l), f AS (SELECT session, ch, min(sample) AS a, max(sample) AS z FROM r GROUP BY session, ch, run HAVING count(*) > 3)
    SELECT session, ch, sample, EXISTS (SELECT 1 FROM f WHERE f.session = lo.session AND f.ch = lo.ch AND lo.sample BETWEEN f.a - 4 AND f.z + 4) AS flat FROM lo""", "tx"))
def flat_event_mask(spark: SparkSession, d: str) -> DataFrame:
    """Events whose window touches a run of more than three samples in the same tens."""
    # in a run of more than three samples are those of any four alike, so eight samples to either side tell
    w = S.over_time("ch", "block")
    v = T.with_halo(trace_values(spark, d), "sample", 8, 8, S.BLOCK).withColumn("l", F.expr("x div 10"))
    v = v.withColumn("four", (F.count("*").over(w.rowsBetween(0, 3)) == 4) & (F.min("l").over(w.rowsBetween(0, 3)) == F.max("l").over(w.rowsBetween(0, 3))))
    v = v.withColumn("long", F.bool_or("four").over(w.rowsBetween(-3, 0)))
    near = v.withColumn("flat", F.bool_or("long").over(w.rowsBetween(-4, 4))).filter("own")
    e = S.rising(trace_values(spark, d), 30).select("session", "ch", "sample")
    return e.join(near.select("session", "ch", "sample", "flat"), ["session", "ch", "sample"])


@query(sql(CROSS.replace(" MATERIALIZED", "") + """, k AS (SELECT session, ch, sample AS at, unnest(range(-2, 4)) AS k FROM hi), w AS (SELECT k.session, k.ch, k.at + k.k AS sample, k.k, tx.x FROM k JOIN tx ON tx.session = k.session AND tx.ch = k.ch AND tx.sample = k.at + k.k),
    m AS (SELECT ch, k, avg(x) AS m FROM w GROUP BY ch, k), s AS (SELECT w.session, w.ch, w.sample, sum(m.m) AS m FROM w JOIN m ON w.ch = m.ch AND w.k = m.k GROUP BY w.session, w.ch, w.sample)
    SELECT tx.session, tx.ch, tx.sample, round(tx.x - coalesce(s.m, 0), 6) AS residual FROM tx LEFT JOIN s ON tx.session = s.session AND tx.ch = s.ch AND tx.sample = s.sample""", "tx"))
def subtract_templates(spark: SparkSession, d: str) -> DataFrame:
    """The record without the mean waveform of each event, overlaps added up."""
    return S.without_templates(traces(spark, d), 4, 45, 2, 3).select("session", "ch", "sample", F.round("y", 6).alias("residual"))


@query(sql("SELECT session, sample, CAST(xs[1] >= 10 AS INT) + 2 * CAST(xs[3] >= 5 AS INT) AS mask, list_transform(list_filter([1, 2, 3, 4], lambda i: i <> 2), lambda i: xs[i])[2] AS second, list_sum([xs[1], xs[3], xs[4]]) AS total FROM traces", "traces"))
def channel_subset(spark: SparkSession, d: str) -> DataFrame:
    """Selected channels, compacted, and which of them are on."""
    xs = F.filter("xs", lambda x, i: i != 1)
    mask = (F.get("xs", 0) >= 10).cast("int") + 2 * (F.get("xs", 2) >= 5).cast("int")
    return traces(spark, d).select("session", "sample", mask.alias("mask"), F.get(xs, 1).alias("second"), F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(sql("SELECT session, count(*) AS samples, count(*) * 4 * 2 AS bytes, round(count(*) / 20.0, 3) AS ms, max(sample) + 1 = count(*) AS gapless FROM traces GROUP BY session", "traces"))
def record_durations(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    return traces(spark, d).groupBy("session").agg(n.alias("samples"), (n * 4 * 2).alias("bytes"), F.round(n / 20.0, 3).alias("ms"), (F.max("sample") + 1 == n).alias("gapless"))


@query(sql("SELECT session, sample // 4 AS sample, xs[1] AS c0, xs[4] AS c1 FROM traces WHERE session % 7 = 3 AND sample % 4 = 0", "traces"))
def extract_group_chunk(spark: SparkSession, d: str) -> DataFrame:
    """A group's channels of chosen records, every fourth sample."""
    return traces(spark, d).filter("session % 7 = 3 AND sample % 4 = 0").select("session", F.expr("sample div 4").alias("sample"), F.get("xs", 0).alias("c0"), F.get("xs", 3).alias("c1"))


@query(sql(""", g AS (SELECT unnest([20, 30, 40, 45, 48]) AS threshold), l AS (SELECT *, lag(x) OVER (PARTITION BY session, ch ORDER BY sample) AS b FROM tx)
    SELECT threshold, ch, count(*) AS events, count(DISTINCT session) AS sessions FROM l JOIN g ON x > threshold AND coalesce(b, threshold) <= threshold GROUP BY ALL""", "tx"))
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """What each of several thresholds would detect, in one pass."""
    v = T.with_halo(trace_values(spark, d), "sample", 1, 0, S.BLOCK).withColumn("b", F.lag("x").over(S.over_time("ch", "block"))).filter("own")
    g = F.filter(F.array(*map(F.lit, [20, 30, 40, 45, 48])), lambda t: (F.col("x") > t) & (F.coalesce("b", t) <= t))
    return v.select("session", "ch", F.explode(g).alias("threshold")).groupBy("threshold", "ch").agg(F.count("*").alias("events"), F.count_distinct("session").alias("sessions"))


def _taps(taps: list[float]) -> str:
    half = len(taps) // 2
    at = [f"coalesce({'lag' if k < half else 'lead'}(x, {abs(k - half)}) OVER w, 0)" if k != half else "x" for k in range(len(taps))]
    return " + ".join(f"{t!r} * {x}" for t, x in zip(taps, at, strict=True))


@query(sql(f"SELECT session, ch, sample, CAST(round(greatest(-32768, least(32767, {_taps(L.sinc_taps(0.2, 5))})), 5) AS DOUBLE) AS y FROM tx WINDOW w AS (PARTITION BY session, ch ORDER BY sample)", "tx"))
def sinc_lowpass(spark: SparkSession, d: str) -> DataFrame:
    """A windowed-sinc low-pass with a gain of one at 0."""
    y = S.fir(trace_values(spark, d), L.sinc_taps(0.2, 5))
    return y.select("session", "ch", "sample", F.round(F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.col("y"))), 5).alias("y"))


@query(sql(f", f AS (SELECT session, ch, sample, {_taps(L.half_band_taps(3))} AS y FROM tx WINDOW w AS (PARTITION BY session, ch ORDER BY sample)) SELECT session, ch, sample // 2 AS sample, CAST(round(y, 5) AS DOUBLE) AS y FROM f WHERE sample % 2 = 0", "tx"))
def half_band_decimate(spark: SparkSession, d: str) -> DataFrame:
    """Every second sample after a half-band filter; a power of two is as many rounds."""
    y = S.fir(trace_values(spark, d), L.half_band_taps(3)).filter("sample % 2 = 0")
    return y.select("session", "ch", F.expr("sample div 2").alias("sample"), F.round("y", 5).alias("y"))


@query()
def butterworth_highpass(spark: SparkSession, d: str) -> DataFrame:
    """Zero-phase Butterworth high-pass of every channel, block by block."""
    return L.blockwise(traces(spark, d), L.zero_phase(L.butterworth(3, 0.05, "high")), 512, 65_536).withColumn("y", F.round("y", 4))


@query()
def butterworth_bandpass(spark: SparkSession, d: str) -> DataFrame:
    """High-pass and low-pass after one another."""
    both = L.zero_phase([*L.butterworth(3, 0.02, "high"), *L.butterworth(3, 0.3, "low")])
    return L.blockwise(traces(spark, d), both, 1024, 65_536).withColumn("y", F.round("y", 4))


@query()
def resampled(spark: SparkSession, d: str) -> DataFrame:
    """Every channel at three halves of its rate, by band-limited interpolation."""
    return L.blockwise(traces(spark, d), L.at_rate(3, 2), 64, 65_536).withColumn("y", F.round("y", 4))


@query()
def supersampled(spark: SparkSession, d: str) -> DataFrame:
    """Natural cubic splines through the waveforms of events, four values a sample."""
    v = trace_values(spark, d)
    return L.splined(S.windows_around(v, S.rising(v, 49), 4, 8), "waveform", 4)


@query(sql(CROSS.replace("45", "49") + """, e AS (SELECT session, ch, sample FROM hi), w AS (SELECT e.session, e.ch, e.sample, list(tx.x ORDER BY tx.sample) AS waveform FROM e JOIN tx ON tx.session = e.session AND tx.ch = e.ch AND tx.sample >= e.sample - 4 AND tx.sample < e.sample + 8 GROUP BY e.session, e.ch, e.sample),
    p AS (SELECT *, unnest(range(0, (len(waveform) - 1) * 4 + 1)) AS j FROM w), k AS (SELECT *, unnest(range(-2, 4)) AS k FROM p), v AS (SELECT *, j % 4 / 4.0 - k AS u, waveform[greatest(0, least(len(waveform) - 1, j // 4 + k)) + 1] AS x FROM k),
    g AS (SELECT *, CASE WHEN u = 0 THEN 1 WHEN abs(u) >= 3 THEN 0 ELSE 3 * sin(pi() * u) * sin(pi() * u / 3) / (pi() * u) ** 2 END AS g FROM v)
    SELECT session, ch, sample, j, round(sum(g * x) / sum(g), 4) AS fine FROM g GROUP BY session, ch, sample, j""", "tx"))
def band_limited_waveforms(spark: SparkSession, d: str) -> DataFrame:
    """Waveforms of events at four values a sample, by a windowed sinc."""
    v = trace_values(spark, d)
    fine = L.splined(S.windows_around(v, S.rising(v, 49), 4, 8), "waveform", 4, "lanczos")
    return fine.select("session", "ch", "sample", F.posexplode("fine").alias("j", "fine")).withColumn("j", F.col("j").cast("long"))


@query()
def smoothed_waveforms(spark: SparkSession, d: str) -> DataFrame:
    """Waveforms of events at four values a sample, by splines through smoothed samples."""
    v = trace_values(spark, d)
    return L.splined(S.windows_around(v, S.rising(v, 49), 4, 8), "waveform", 4, "smooth")


@query()
def multitaper_power(spark: SparkSession, d: str) -> DataFrame:
    """Power by frequency of windows of 64 samples, averaged over the tapers."""
    return L.multitaper(traces(spark, d), 64, 32, 3.0, 5)


@query()
def band_power(spark: SparkSession, d: str) -> DataFrame:
    """Power of each record and channel in three bands, from its windows."""
    p = L.multitaper(traces(spark, d), 64, 32, 3.0, 5).select("session", "ch", F.posexplode("power").alias("f", "p"))
    band = F.when(F.col("f") < 4, "low").when(F.col("f") < 16, "mid").otherwise("high")
    return p.groupBy("session", "ch", band.alias("band")).agg(F.round(F.avg("p"), 4).alias("power"), F.count("*").alias("n"))
