"""Spikes moved to the unit whose waveform, as worn down by that unit's own spikes before, fits them better.

Units' states run through a group's blocks of time (`scans`): what a block does to a unit is linear in what the unit lacked before it. With the states before a block its spikes are
scored against all units by matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import Numbers, scan
from .shapes import kth_smallest
from .signal import refractory
from .timing import with_halo


@dataclass(frozen=True)
class Worn:
    """A unit's model: rested waveform and its changes with what is lacking over a fast and a slow time (rows of shape; samples x channels, sample-major), the part of what is available
    that a spike uses and the time it takes to come back, for either."""

    cluster: int
    shape: np.ndarray
    fast: tuple[float, float]
    slow: tuple[float, float]


@dataclass(frozen=True)
class Moves:
    """tail: percentile of a unit's amplitudes up to which its spikes may move. stay: what a move must be better by in log likelihood to count as good; margin: and more than that. veto: no
    move nearer than this to a spike of the other unit, and of two moves to one unit within it the earlier holds (0: no veto)."""

    tail: float = 50.0
    stay: float = 1.0
    margin: float = 0.0
    veto: int = 0


def _states(t: np.ndarray, own: np.ndarray, k: int, rates: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Times of the spikes of unit k and what it lacks just after each; with what is known from before the block as the first."""
    times = t[own == k]
    use, tau = rates[k].T
    last, lacks = (None, np.zeros(2)) if before is None or np.isnan(before[0]) else (before[0], before[1:])
    out = np.empty((len(times), 2))
    for i, x in enumerate(times):
        at = np.zeros(2) if last is None else lacks * np.exp(-(x - last) / tau)
        lacks, last = at * (1 - use) + use, x
        out[i] = lacks
    if before is not None and not np.isnan(before[0]):
        return np.concatenate([[before[0]], times]), np.vstack([before[1:], out])
    return times, out


def scored(spikes: DataFrame, by: list[str], column: str, channels: int, units: list[Worn], veto: int, width: int) -> DataFrame:
    """by, spike_id, cluster, t, size (swing on the unit's main channel), left (what each unit's model leaves of the energy) and near (whether one of its other spikes
    is nearer than the veto), in the order of units, of the units' spikes."""
    names = [u.cluster for u in units]
    place = {c: k for k, c in enumerate(names)}
    rates = np.array([[u.fast, u.slow] for u in units], float)
    shapes = np.stack([u.shape for u in units]).astype(float)  # units x 3 x values
    flat = shapes.reshape(-1, shapes.shape[2])
    cross = np.einsum("kip,kjp->kij", shapes, shapes)
    rested = shapes[:, 0].reshape(len(units), -1, channels)
    main = np.ptp(rested, axis=1).argmax(1)

    def summary(table: pa.Table) -> Numbers:
        inside = table.column("own").to_numpy()
        t = table.column("t").to_numpy().astype(float)[inside]
        own = np.array([place.get(c, -1) for c in table.column("cluster").to_pylist()])[inside]
        out: Numbers = []
        for k in np.unique(own[own >= 0]):
            times = t[own == k]
            use, tau = rates[k].T
            slope, rest = 1 - use, use.copy()  # of what it lacks just after the last spike, by what it lacked at the first
            for gap in np.diff(times):
                decay = np.exp(-gap / tau)
                slope, rest = slope * decay * (1 - use), rest * decay * (1 - use) + use
            out += [float(k), times[0], times[-1], *slope, *rest]
        return out

    def follow(state: Numbers | None, told: Numbers) -> Numbers:
        at = np.full((len(units), 3), np.nan) if state is None else np.array(state, float).reshape(-1, 3)
        for k, first, last, s0, s1, r0, r1 in np.array(told).reshape(-1, 7):
            k = int(k)
            lacks = np.zeros(2) if np.isnan(at[k, 0]) else at[k, 1:] * np.exp(-(first - at[k, 0]) / rates[k].T[1])
            at[k] = [last, *(np.array([s0, s1]) * lacks + [r0, r1])]
        return at.ravel().tolist()

    def emit(table: pa.Table, state: Numbers | None) -> pa.Table:
        t = table.column("t").to_numpy().astype(float)
        inside = table.column("own").to_numpy().astype(bool)
        own = np.array([place.get(c, -1) for c in table.column("cluster").to_pylist()], int)
        pick = np.flatnonzero(inside & (own >= 0))
        before = None if state is None else np.array(state, float).reshape(-1, 3)
        x = np.array(table.column(column).take(pa.array(pick, pa.int64())).to_pylist(), float).reshape(len(pick), shapes.shape[2])
        hit = (x @ flat.T).reshape(len(pick), len(units), 3) if len(pick) else np.zeros((0, len(units), 3))
        energy = (x * x).sum(1)
        left, near = np.empty((len(pick), len(units))), np.zeros((len(pick), len(units)), bool)
        for k in range(len(units)):
            times, lacks = _states(t, np.where(inside, own, -1), k, rates, None if before is None else before[k])
            at = np.searchsorted(times, t[pick]) - 1
            missing = np.zeros((len(pick), 2))
            some = at >= 0
            missing[some] = lacks[at[some]] * np.exp(-(t[pick][some] - times[at[some]])[:, None] / rates[k].T[1])
            by_part = np.hstack([np.ones((len(pick), 1)), missing])
            left[:, k] = energy - 2 * (by_part * hit[:, k]).sum(1) + np.einsum("ni,ij,nj->n", by_part, cross[k], by_part)
            if veto:
                every = np.sort(np.concatenate([times, t[(own == k) & ~inside]]))
                i = np.searchsorted(every, t[pick])
                gap = np.full(len(pick), np.inf)
                has = i > 0
                gap[has] = t[pick][has] - every[i[has] - 1]
                has = i < len(every)
                gap[has] = np.minimum(gap[has], every[i[has]] - t[pick][has])
                near[:, k] = gap < veto
        waves = x.reshape(len(pick), shapes.shape[2] // channels, channels)
        size = np.ptp(waves, axis=1)[np.arange(len(pick)), main[own[pick]]] if len(pick) else np.zeros(0)
        rows = table.take(pa.array(pick, pa.int64()))
        return pa.table({c: rows.column(c) for c in (*by, "spike_id", "cluster", "t")} | {"size": pa.array(size), "left": pa.array(list(left), pa.list_(pa.float64())), "near": pa.array(list(near), pa.list_(pa.bool_()))})

    held = with_halo(spikes.select(*by, "spike_id", "cluster", "t", column), "t", veto, veto, width)
    # a block sees what a veto may need of its neighbours; its own rows alone change states
    types = dict(held.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*by, "spike_id", "cluster", "t")) + ", size double, left array<double>, near array<boolean>"
    return scan(held, by, F.col("block"), ["t", "spike_id"], summary, follow, emit, schema)


def reassigned(spikes: DataFrame, by: list[str], column: str, channels: int, units: list[Worn], how: Moves = Moves(), width: int = 86_400) -> DataFrame:
    """by, spike_id, cluster, t, to and gain of the spikes(by, spike_id, cluster, t, column) that move.

    Only units with a model give or take spikes. A unit's noise is what its own model leaves of its spikes, on average for each value and at least 1. The spikes up to a percentile
    of a unit's swings are scored under every unit at what that unit has left at the time; equal scores go to the first unit. Spikes of one time do not wear each other down. Rows with a null t, cluster or
    waveform are left out.
    """
    units = sorted(units, key=lambda u: u.cluster)
    spikes = spikes.filter(F.col("t").isNotNull() & F.col("cluster").isNotNull() & F.col(column).isNotNull())
    rows = scored(spikes, by, column, channels, units, how.veto, width).checkpoint()
    names = F.array(*[F.lit(u.cluster) for u in units])
    index = F.array_position(names, F.col("cluster")).cast("int") - 1
    rows = rows.withColumn("k", index)
    values = units[0].shape.shape[1]
    noise = {r["k"]: max(1.0, r["s"] / (r["n"] * values)) for r in rows.groupBy("k").agg(F.sum(F.get("left", F.col("k"))).alias("s"), F.count("*").alias("n")).collect()}  # a row for each unit
    sigma = F.array(*[F.lit(noise.get(k, 1.0)) for k in range(len(units))])
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("_n"))
    rank = rows.join(sizes, "cluster").withColumn("_k", F.floor((F.col("_n") - 1) * how.tail / 100) + 1)
    limit = kth_smallest(rank.select("cluster", "size", "_k"), "cluster", "size", "_k").withColumnRenamed("size", "limit")
    own = F.col("k")
    score = F.transform("left", lambda x, k: F.when((k != own) & F.get("near", k), F.lit(float("-inf"))).otherwise(-0.5 * x / F.get(sigma, k) - 0.5 * values * F.log(F.get(sigma, k)) - F.when(k == own, 0.0).otherwise(how.stay)))
    found = rows.join(F.broadcast(limit), "cluster").filter("size <= limit").withColumn("score", score)
    best = F.array_position("score", F.array_max("score")).cast("int") - 1
    found = found.withColumn("best", best).withColumn("gain", F.get("score", F.col("best")) - F.get("score", F.col("k")))
    moves = found.filter((F.col("best") != F.col("k")) & (F.col("gain") > how.margin)).select(*by, "spike_id", "cluster", "t", F.get(names, F.col("best")).alias("to"), "gain")
    if not how.veto:
        return moves
    return refractory(moves.withColumnRenamed("t", "sample"), how.veto, reject_equal=False, by=(*by, "to"), width=width).withColumnRenamed("sample", "t")
