"""Drift along the probe, criteria of merges and waveforms that depend on a unit's past: sums and windows over rows of units, windows and channels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A


def profile_drift(profiles: DataFrame, pitch: float, channels: int = 8) -> DataFrame:
    """cluster, win, n, shift from profiles(cluster, win, w, n): each profile against the unit's in window 0.

    The shift is the lag of the largest correlation of the profiles at unit length (the first of equal ones), made finer by a parabola through its
    neighbours, times the distance of sites. n is the smaller number of spikes. Units without a window 0 have no row.
    """
    first = profiles.filter("win = 0").select("cluster", F.col("w").alias("r"), F.col("n").alias("n0"))
    unit = lambda v: F.transform(v, lambda x: x / A.norm(F.col(v)))
    both = profiles.join(first, "cluster").select("cluster", "win", F.least("n", "n0").alias("n"), unit("r").alias("r"), unit("w").alias("w"))
    lags = range(1 - channels, channels)
    at = lambda lag: F.round(A.dot(F.slice("r", max(1, 1 + lag), channels - abs(lag)), F.slice("w", max(1, 1 - lag), channels - abs(lag))), 9)
    c = both.withColumn("c", F.array(*[at(lag) for lag in lags])).withColumn("k", F.array_position("c", F.array_max("c")).cast("int"))
    y = lambda i: F.get("c", F.col("k") - 1 + i)
    bend = 2 * y(0) - y(-1) - y(1)
    part = F.when(F.col("k").between(2, 2 * channels - 2) & (bend > 1e-9), (y(1) - y(-1)) / (2 * bend)).otherwise(0.0)
    return c.select("cluster", "win", "n", F.round(pitch * (F.col("k") - channels + part), 2).alias("shift"))


def lower_weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """by, value, units: the first value at which half of the group's weight is reached, and the number of rows."""
    per = rows.groupBy(*by, value).agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    per = per.withColumn("_up", F.sum("_w").over(w.orderBy(value))).withColumn("_all", F.sum("_w").over(w))
    return per.groupBy(*by).agg(F.min(F.when(2 * F.col("_up") >= F.col("_all"), F.col(value))).alias(value), F.sum("_n").alias("units"))


@dataclass(frozen=True)
class Limits:
    """Limits of a merge: of similarity, of what moves between units, and of their overlap in time."""

    cosine: float = 0.95
    footprint: float = 0.95
    shifted: float = 0.97
    deviations: float = 3.0
    drift: float = 40.0
    roughness: float = 2.5
    spread: float = 5.0
    same_channel: bool = True
    positive: bool = True
    apart: float = 0.1
    together: float = 0.7
    close_cosine: float = 0.98
    close_drift: float = 5.0
    close_spread: float = 1.3


def merge_criteria(waves: DataFrame, times: DataFrame, time: str, pitch: float, signal: float = 0.3, peak: tuple[int, int] = (2, 5), samples: int = 8) -> DataFrame:
    """Pairs a < b of units from waves(cluster, s, ch, x) and times(cluster, time), with every criterion.

    cosw and xcorr compare means as they are and over two samples' turn either way, cosfp the swings by channel. The rest is over channels on which
    both swings reach `signal` of the pair's largest: the gain b over a by least squares at the peak's samples (n, low, high, rough: its
    steps along the probe over its mean size, 0 for fewer than 3), sdr the largest ratio of deviations at the middle sample. drift is between
    the centres of squared swings, iou the overlap of the times. Pairs without such a channel are left out.
    """
    m = waves.groupBy("cluster", "s", "ch").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    c = m.groupBy("cluster", "ch").agg((F.max("m") - F.min("m")).alias("p"), F.max(F.when(F.col("s") == samples // 2, F.col("sd"))).alias("sd"))
    square = F.col("p") * F.col("p")
    u = c.groupBy("cluster").agg(F.max_by("ch", F.struct(F.round("p", 6), -F.col("ch"))).alias("top"), (F.sum(square * F.col("ch")) / F.sum(square) * pitch).alias("y"))
    u = u.join(times.groupBy("cluster").agg(F.min(time).alias("t0"), F.max(time).alias("t1")), "cluster")

    def named(rows: DataFrame, n: str, *keys: str) -> DataFrame:
        return rows.select(*[F.col(f).alias(f if f in keys else n if f == "cluster" else f + n) for f in rows.columns])

    pairs = named(m, "a", "ch").join(named(m, "b", "ch"), "ch").filter("a < b")
    ma, mb = F.col("ma"), F.col("mb")
    turn = F.pmod(F.col("sb") - F.col("sa"), F.lit(samples))
    turned = pairs.withColumn("k", F.when(turn > samples // 2, turn - samples).otherwise(turn)).filter("abs(k) <= 2").groupBy("a", "b", "k").agg((F.sum(ma * mb) / F.sqrt(F.sum(ma * ma) * F.sum(mb * mb))).alias("c"))
    similar = turned.groupBy("a", "b").agg(F.max("c").alias("xcorr"), F.max(F.when(F.col("k") == 0, F.col("c"))).alias("cosw"))
    gain = pairs.filter((F.col("sa") == F.col("sb")) & F.col("sa").between(*peak)).groupBy("a", "b", "ch").agg((F.sum(ma * mb) / F.sum(ma * ma)).alias("gain"))
    pc = gain.join(named(c, "a", "ch"), ["a", "ch"]).join(named(c, "b", "ch"), ["b", "ch"])
    pair = Window.partitionBy("a", "b")
    pa, pb = F.col("pa"), F.col("pb")
    pc = pc.withColumn("most", F.max(F.greatest(pa, pb)).over(pair)).withColumn("cosfp", F.sum(pa * pb).over(pair) / F.sqrt(F.sum(pa * pa).over(pair) * F.sum(pb * pb).over(pair)))
    loud = pc.filter(F.least(pa, pb) >= signal * F.col("most")).withColumn("step", F.abs(F.col("gain") - F.lag("gain").over(pair.orderBy("ch"))))
    st = loud.groupBy("a", "b").agg(
        F.first("cosfp").alias("cosfp"), F.count("*").alias("n"), F.min("gain").alias("low"), F.max("gain").alias("high"),
        F.when(F.count("*") >= 3, F.sum("step") / (F.avg(F.abs("gain")) + 1e-9)).otherwise(0.0).alias("rough"),
        F.max(F.greatest("sda", "sdb") / F.greatest(F.least("sda", "sdb"), F.lit(1e-6))).alias("sdr"),
    )
    both = st.join(similar, ["a", "b"]).join(named(u, "a"), "a").join(named(u, "b"), "b")
    shared = F.greatest(F.lit(0), F.least("t1a", "t1b") - F.greatest("t0a", "t0b")) / F.greatest(F.lit(1), F.greatest("t1a", "t1b") - F.least("t0a", "t0b"))
    return both.withColumn("same", F.col("topa") == F.col("topb")).withColumn("drift", F.abs(F.col("ya") - F.col("yb"))).withColumn("iou", shared)


def merge_tier(at: Limits) -> Column:
    """The tier of a pair: REVIEW if a criterion fails; AUTO_DRIFT if the units hardly overlap in time, AUTO_OVERSPLIT if they do and lie close; else REVIEW_PARTIAL_OVERLAP."""
    c = F.col
    alike = (c("cosw") >= at.cosine) & (c("cosfp") >= at.footprint) & (c("xcorr") >= at.shifted) & (c("sdr") < at.deviations) & (c("drift") < at.drift) & (c("rough") < at.roughness)
    spread = F.when(c("low") > 0, c("high") / c("low")).otherwise(float("inf"))
    if at.positive:
        alike = alike & (spread < at.spread)
    if at.same_channel:
        alike = alike & c("same")
    close = (spread <= at.close_spread) & (c("iou") >= at.together) & (c("cosw") >= at.close_cosine) & (c("xcorr") >= at.close_cosine) & (c("drift") < at.close_drift)
    return F.when(~alike, "REVIEW").when(c("iou") < at.apart, "AUTO_DRIFT").when(close, "AUTO_OVERSPLIT").otherwise("REVIEW_PARTIAL_OVERLAP")


def plane(rows: DataFrame, by: list[str], y: str, u: str, v: str) -> DataFrame:
    """by, c0, c1, c2 of the least-squares fit y = c0 + c1 u + c2 v; null where u and v don't tell them apart."""
    q = rows.groupBy(*by).agg(*[F.avg(n).alias(f"_{n}") for n in (y, u, v)], F.var_pop(u).alias("uu"), F.var_pop(v).alias("vv"), F.covar_pop(u, v).alias("uv"), F.covar_pop(u, y).alias("uy"), F.covar_pop(v, y).alias("vy"))
    det = F.nullif(F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv"), F.lit(0.0))
    q = q.withColumn("c1", (F.col("uy") * F.col("vv") - F.col("vy") * F.col("uv")) / det).withColumn("c2", (F.col("vy") * F.col("uu") - F.col("uy") * F.col("uv")) / det)
    return q.select(*by, (F.col(f"_{y}") - F.col("c1") * F.col(f"_{u}") - F.col("c2") * F.col(f"_{v}")).alias("c0"), "c1", "c2")


def incoherent(pairs: DataFrame, by: list[str], drift: str, k: float, least: int = 3) -> DataFrame:
    """pairs with demoted: a drift more than k median deviations (1 at least) from the median of its group; groups of fewer than `least` keep all."""
    med = pairs.groupBy(*by).agg(F.percentile(drift, F.lit(0.5)).alias("_med"), F.count("*").alias("_n"))
    near = pairs.join(med, by).withColumn("_off", F.abs(F.col(drift) - F.col("_med")))
    mad = near.groupBy(*by).agg(F.greatest(F.lit(1.0), F.percentile("_off", F.lit(0.5))).alias("_mad"))
    return near.join(mad, by).withColumn("demoted", (F.col("_n") >= least) & (F.col("_off") > k * F.col("_mad"))).drop("_med", "_n", "_off", "_mad")


def smoothed_windows(means: DataFrame, strength: float) -> DataFrame:
    """cluster, win, d, x from means(cluster, win, d, x, n): templates of windows made smooth over time.

    For each cluster and place the sum of n times the squared change and of `strength` times the squared steps between windows next to each other is
    least: a tridiagonal system, solved in order for all places of a cluster at once. A cluster's windows (not its spikes) are in one task; a missing
    place counts as a window without weight. Without strength means stay as they are.
    """
    if strength <= 0:
        return means.filter("x IS NOT NULL AND n > 0").select("cluster", "win", "d", F.col("x").cast("double").alias("x"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.pivot(index="win", columns="d", values="x").sort_index()
        n = rows.pivot(index="win", columns="d", values="n").reindex_like(x).fillna(0.0).to_numpy(float)
        value = n * x.fillna(0.0).to_numpy(float)
        size = len(x)
        links = np.full(size, 2.0 * strength)
        links[0] -= strength
        links[-1] -= strength
        diag = n + links[:, None]
        for i in range(1, size):
            f = -strength / diag[i - 1]
            diag[i] = diag[i] + f * strength
            value[i] = value[i] - f * value[i - 1]
        for i in range(size - 1, -1, -1):
            value[i] = (value[i] + (strength * value[i + 1] if i + 1 < size else 0)) / diag[i]
        out = pd.DataFrame(value, index=x.index, columns=x.columns).stack().rename("x").reset_index()
        return out.assign(cluster=rows["cluster"].iloc[0])[["cluster", "win", "d", "x"]]

    return means.select("cluster", "win", "d", "x", "n").groupBy("cluster").applyInPandas(run, "cluster long, win long, d long, x double")
