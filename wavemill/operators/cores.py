"""The core of a unit: its spikes in the order in which each next one moves the running mean least, cut where others begin to come in.

The order is quadratic, so of a large unit an evenly spaced subset of a documented size is ordered, in one task for each unit; the other spikes are
placed by their distance from the subset's core, in Arrow batches where they lie.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shapes import numbered


@dataclass(frozen=True)
class Core:
    """rate: samples a second. rise, flat_from, flat_to, fall: the window's corners in ms from where the falling flank crosses half the trough's depth. shift: how far a spike may
    be moved, search: how far from the median's trough its own is looked for, base: the first samples that are level 0, all in ms. onset: how often its usual change that of the kurtosis must reach.
    least: spikes of a unit that is looked at. ordered: spikes of a unit that are ordered at most. median: spikes whose medians stand for the unit's, about; seed: the same for the first spike."""

    rate: float = 20_000.0
    rise: float = -0.154
    flat_from: float = -0.031
    flat_to: float = 0.184
    fall: float = 0.430
    shift: float = 0.184
    search: float = 0.280
    base: float = 0.246
    onset: float = 5.0
    least: int = 200
    ordered: int = 40_000
    median: int = 2000
    seed: int = 4000

    def samples(self, ms: float, least: int) -> int:
        return max(least, int(np.floor(ms * self.rate / 1000 + 0.5)))

    def taper(self, t: np.ndarray) -> np.ndarray:
        """The window's weights at times (samples) from the crossing: raised cosines beside a flat top."""
        at = np.array([self.rise, self.flat_from, self.flat_to, self.fall]) * self.rate / 1000
        up = np.clip((t - at[0]) / (at[1] - at[0]), 0, 1)
        down = np.clip((at[3] - t) / (at[3] - at[2]), 0, 1)
        return 0.25 * (1 - np.cos(np.pi * up)) * (1 - np.cos(np.pi * down))


def upper_median(x: np.ndarray) -> np.ndarray:
    """Of every column its n // 2-th value."""
    return np.partition(x, len(x) // 2, axis=0)[len(x) // 2]


def half_crossings(w: np.ndarray, low: int, high: int, base: int) -> np.ndarray:
    """Where each row's falling flank crosses half the depth of its trough in [low, high], between samples; nan without a trough below its first samples' mean or a flank."""
    depth = w - w[:, :base].mean(1, keepdims=True)
    rows, at = np.arange(len(w)), np.arange(w.shape[1])
    trough = low + depth[:, low : high + 1].argmin(1)
    half = depth[rows, trough] / 2
    above = (depth >= half[:, None]) & (at < trough[:, None])
    last = np.where(above, at, -1).max(1)
    a, b = depth[rows, np.maximum(last, 0)], depth[rows, np.minimum(last + 1, len(at) - 1)]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((half < 0) & (last >= 0) & (a != b), last + (a - half) / (a - b), np.nan)


def moved(w: np.ndarray, t: np.ndarray) -> np.ndarray:
    """w (rows x samples x channels) at fractional samples t (rows x times): cubic through four neighbours, the ends held."""
    n = w.shape[1]
    t = np.clip(t, 0, n - 1)
    i = np.minimum(t.astype(int), n - 2)
    u = (t - i)[:, :, None]
    p0, p1, p2, p3 = (np.take_along_axis(w, np.clip(i + k, 0, n - 1)[:, :, None], 1) for k in (-1, 0, 1, 2))
    return p1 + u / 2 * (p2 - p0 + u * (2 * p0 - 5 * p1 + 4 * p2 - p3 + u * (3 * (p1 - p2) + p3 - p0)))


@dataclass
class Centring:
    """channel: where the median is largest. target: its crossing. low, high, base: where and against what troughs are measured. times, weights: of the window."""

    channel: int
    target: float
    low: int
    high: int
    base: int
    times: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(w: np.ndarray, how: Core) -> Centring | str:
        """From waveforms that stand for a unit; a reason if there is none."""
        n = w.shape[1]
        median = upper_median(w.reshape(len(w), -1)).reshape(w.shape[1:])
        channel = int(np.ptp(median, 0).argmax())
        trough = int(median[:, channel].argmin())
        search = how.samples(how.search, 2)
        low, high, base = max(1, trough - search), min(n - 2, trough + search), min(how.samples(how.base, 2), n // 2)
        target = half_crossings(median[None, :, channel], low, high, base)[0] if low < high else np.nan
        if np.isnan(target):
            return "no trough"
        weights = how.taper(np.arange(n) - target)
        if (weights > 0).sum() < 4:
            return "no window"
        return Centring(channel, float(target), low, high, base, np.flatnonzero(weights > 0), weights[weights > 0])

    def centred(self, w: np.ndarray, how: Core) -> np.ndarray:
        """Windowed waveforms, each moved so that its crossing comes to the target: rows x times x channels."""
        far = how.shift * how.rate / 1000
        move = np.nan_to_num(np.clip(self.target - half_crossings(w[:, :, self.channel], self.low, self.high, self.base), -far, far))
        return moved(w, self.times[None, :] - move[:, None]) * self.weights[None, :, None]


def least_change(x: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows from the first on in which the next is always the nearest to the mean of those taken, and how far it was. Ties go to the first row.

    Distances to the running mean need only each row's product with it, which follows from its product with the row taken last.
    """
    order, step = np.empty(len(x), int), np.zeros(len(x))
    square, along = (x * x).sum(1), np.zeros(len(x))
    free = np.ones(len(x), bool)
    mean, now = np.zeros(x.shape[1]), first
    for k in range(len(x)):
        order[k], free[now] = now, False
        mean += (x[now] - mean) / (k + 1)
        if k + 1 == len(x):
            break
        along += (x @ x[now] - along) / (k + 1)
        far = np.where(free, square - 2 * along, np.inf)
        now = int(far.argmin())
        step[k + 1] = np.sqrt(max(0.0, far[now] + mean @ mean))
    return order, step


def onset(x: np.ndarray, how: Core) -> int:
    """How many rows in order (rows x times x channels) come before a channel's kurtosis of all rows so far starts to rise; all if none does.

    The change is over a fiftieth of the rows; its usual size is that between a fifth and half of them.
    """
    n = len(x)
    span, half, fifth = max(20, n // 50), n // 2, n // 5
    count = np.arange(1, n + 1)[:, None, None]
    m1, m2, m3, m4 = (np.cumsum(x**p, 0) / count for p in (1, 2, 3, 4))
    var = np.maximum(m2 - m1**2, 1e-9)
    kurtosis = ((m4 - 4 * m1 * m3 + 6 * m1**2 * m2 - 3 * m1**4) / var**2 - 3).mean(1)
    change = np.zeros_like(kurtosis)
    change[span:] = kurtosis[span:] - kurtosis[:-span]
    usual = np.abs(change[fifth:half]).sum(0) / max(1, half - fifth)
    rises = (change > how.onset * usual) & (np.arange(n)[:, None] >= max(half, span))
    return int(np.where(rises.any(0), np.maximum(1, rises.argmax(0) - span // 2), n).min())


def _waves(column: pd.Series, channels: int) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(float)
    return x.reshape(len(x), -1, channels)


def analysed(w: np.ndarray, stand: np.ndarray, how: Core) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, tuple | None]:
    """Of waveforms in order of their spikes: a reason, who is kept, everyone's rank and step, and for spikes that are not here the centring, the core's mean and how
    far from it they may be. stand: waveforms that stand for the unit."""
    keep, rank, step = np.ones(len(w), bool), np.full(len(w), -1), np.zeros(len(w))
    found = Centring.of(stand, how)
    if isinstance(found, str):
        return found, keep, rank, step, None
    x = found.centred(w, how)
    flat = x.reshape(len(x), -1)
    first = int(((flat - upper_median(flat[:: max(1, len(x) // how.seed)])) ** 2).sum(1).argmin())
    order, far = least_change(flat, first)
    rank[order], step[order] = np.arange(len(order)), far
    cut = onset(x[order], how)
    if cut >= len(order):
        return "one kind", keep, rank, step, None
    keep[order[cut:]] = False
    near = far[max(1, cut - max(20, len(order) // 50)) : cut]
    limit = float(upper_median(near)) if len(near) else 0.0
    return "cut", keep, rank, step, (found, flat[order[:cut]].mean(0), limit)


def core_cut(rows: DataFrame, column: str, channels: int, how: Core = Core()) -> tuple[DataFrame, DataFrame]:
    """Two tables. spike_id, cluster, keep, rank and step: whether a spike belongs to its unit's core, where it stands in the order (null if not ordered) and how far it then
    was from the mean. cluster, n, ordered, cut and reason: of every unit how many were ordered and kept of those, and why nothing was cut.

    Waveforms are sample-major arrays of whole records. Units of fewer than `least` spikes (too few) are kept whole, as are those without a trough to centre on. Of more
    than `ordered` spikes, evenly spaced ones by spike_id are ordered. Rows with a null cluster or waveform are left out.
    """
    rows = rows.select("spike_id", "cluster", F.col(column).alias("w")).filter("cluster IS NOT NULL AND w IS NOT NULL")
    placed = numbered(rows, "_at", "cluster", "spike_id")
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    placed = placed.join(sizes, "cluster").withColumn("i", F.col("_at") - F.col("_first")).drop("_at", "_first")
    most = max(how.ordered, how.least)
    # the k-th that is ordered is the k n / most-th, rounded down
    k = F.ceil(F.col("i") * F.least("n", F.lit(most)) / F.col("n"))
    ordered = F.when(F.col("n") <= most, F.lit(True)).otherwise(F.floor(k * F.col("n") / most) == F.col("i"))
    stands = F.col("i") % F.greatest(F.lit(1), F.expr(f"n div {how.median}")) == 0
    placed = placed.withColumns({"ordered": ordered & (F.col("n") >= how.least), "stands": stands & (F.col("n") >= how.least)}).checkpoint()

    fields = "spike_id long, cluster long, keep boolean, rank long, step double, reason string, model binary"

    def run(unit: pd.DataFrame) -> pd.DataFrame:
        unit = unit.sort_values("i")
        own = unit[unit["ordered"]]
        reason, keep, rank, step, model = analysed(_waves(own["w"], channels), _waves(unit["w"][unit["stands"]], channels), how)
        out = pd.DataFrame({"spike_id": own["spike_id"], "cluster": own["cluster"], "keep": keep, "rank": rank, "step": step}).astype(object)
        out.loc[out["rank"] < 0, ["rank", "step"]] = None
        # the unit's own row
        told = pd.DataFrame({"cluster": [unit["cluster"].iloc[0]], "rank": [int(keep.sum())], "reason": [reason], "model": [pickle.dumps(model) if model else None]}, dtype=object)
        return pd.concat([out, told]).reindex(columns=[f.split()[0] for f in fields.split(", ")])

    found = placed.filter("ordered OR stands").groupBy("cluster").applyInPandas(run, fields).checkpoint()
    models = {r["cluster"]: pickle.loads(r["model"]) for r in found.filter("model IS NOT NULL").select("cluster", "model").collect()}  # a window for each unit

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c, part in batch.groupby("cluster"):
                keep = np.ones(len(part), bool)
                if c in models:
                    centring, mean, limit = models[c]
                    x = centring.centred(_waves(part["w"], channels), how).reshape(len(part), -1)
                    keep = ((x - mean) ** 2).sum(1) <= limit**2
                yield part[["spike_id", "cluster"]].assign(keep=keep)

    rest = placed.filter("NOT ordered").select("spike_id", "cluster", "w").mapInPandas(place, "spike_id long, cluster long, keep boolean")
    rest = rest.withColumns({"rank": F.lit(None).cast("long"), "step": F.lit(None).cast("double")})
    spikes = found.filter("spike_id IS NOT NULL").select(*rest.columns).unionByName(rest)
    units = found.filter("reason IS NOT NULL").select("cluster", F.col("rank").alias("cut"), "reason")
    counts = placed.groupBy("cluster").agg(F.first("n").alias("n"), F.count_if("ordered").alias("ordered"))
    units = counts.join(units, "cluster", "left").select("cluster", "n", "ordered", F.coalesce("cut", F.lit(0).cast("long")).alias("cut"), F.coalesce("reason", F.lit("too few")).alias("reason"))
    return spikes, units
