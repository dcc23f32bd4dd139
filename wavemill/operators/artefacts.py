"""What all channels pick up alike, as muscles do: found as an independent component of the fast signal, taken out of every sample, and its bursts detected.

The fixed-point iteration with a cubic needs of the data only their fourth moments. So there are three passes over the record's fast part, which add up means, products and fourth
products, and the iteration is done with those, however long the record is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import filters, scans
from .models import gram
from .timing import with_halo


@dataclass(frozen=True)
class Finding:
    """cut: of the high-pass, in parts of half the sampling rate. every: which samples of the fast signal are used. start, length: of the record's part that the component is sought in (samples; null:
    all). tries: starts of the iteration for each component; rounds: of each. threshold: how often 1.4826 times the component's median size an envelope must reach; envelope: samples of its window. reach: samples
    from a crossing in which its peak is sought, refractory: from a peak to where the next is."""

    cut: float = 0.2
    every: int = 1
    start: int = 0
    length: int | None = None
    rounds: int = 500
    tolerance: float = 1e-9
    threshold: float = 4.0
    envelope: int = 20
    reach: int = 40
    refractory: int = 40
    seed: int = 1


@dataclass
class Component:
    """mean of the channels, loading (the component on each channel), unmixing (what gives the component), uniform: how alike it is on all channels, 1 at most as a share of the possible, and all: how many were found."""

    mean: np.ndarray
    loading: np.ndarray
    unmixing: np.ndarray
    uniform: float
    all: int


def fourth_moments(rows: DataFrame, column: str, mean: np.ndarray, white: np.ndarray) -> np.ndarray:
    """Means of all products of four whitened channels, as a tensor. Tasks add up products of products."""
    size = len(white)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size * size, size * size)), 0
        for batch in batches:
            if len(batch):
                z = (batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).astype(float) - mean) @ white.T
                two = np.einsum("ni,nj->nij", z, z).reshape(len(z), -1)
                total, n = total + two.T @ two, n + len(z)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size + 1)), pa.array(np.append(total.ravel(), n))], names=["cell", "value"])

    sums = np.zeros(size**4 + 1)
    for r in rows.select(column).mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("v")).collect():  # channels to the fourth
        sums[r["cell"]] = r["v"]
    return (sums[:-1] / max(1.0, sums[-1])).reshape(size, size, size, size)


def fixed_points(moments: np.ndarray, how: Finding) -> np.ndarray:
    """Directions (rows) of independent components of whitened data, one after another at right angles, from their fourth moments: w goes to E[z (w z)^3] - 3 w until it stays."""
    size = len(moments)
    rng = np.random.default_rng(how.seed)
    found = np.zeros((0, size))
    while len(found) < size:
        clear = lambda w, found=found: w - found.T @ (found @ w)
        w = clear(rng.normal(size=size))
        w /= np.linalg.norm(w)
        for _ in range(how.rounds):
            new = clear(np.einsum("ijkl,j,k,l->i", moments, w, w, w) - 3 * w)
            norm = np.linalg.norm(new)
            if norm < 1e-12:
                break
            new /= norm
            still = min(np.linalg.norm(new - w), np.linalg.norm(new + w)) < how.tolerance
            w = new
            if still:
                break
        w = clear(w)
        found = np.vstack([found, w / np.linalg.norm(w)])
    return found


def common(traces: DataFrame, channels: int, how: Finding = Finding()) -> Component | None:
    """The component of traces(session, sample, xs) that is most alike on all channels; None where channels are fewer than two or do not vary apart from each other."""
    part = traces if how.length is None else traces.filter(F.col("sample").between(how.start, how.start + how.length - 1))
    fast = filters.filtered(part, filters.zero_phase(filters.butterworth(4, how.cut, "high")), 512, 65_536).filter(F.col("sample") % how.every == 0)
    rows = fast.filter(F.size("ys") == channels).select("ys").checkpoint()
    n, mean, cov = gram(rows, "ys", channels)
    value, vector = np.linalg.eigh(cov)
    if channels < 2 or n <= channels or value[0] <= 1e-12 * max(value[-1], 1e-300):
        return None
    white = (vector / np.sqrt(value)).T
    back = vector * np.sqrt(value)
    w = fixed_points(fourth_moments(rows, "ys", mean, white), how)
    loads, unmix = back @ w.T, w @ white
    score = np.abs((loads / np.linalg.norm(loads, axis=0)).sum(0)) / np.sqrt(channels)
    k = int(score.argmax())
    level = np.array(part.agg(F.array(*[F.avg(F.get("xs", i)) for i in range(channels)])).first()[0], float)
    return Component(level, loads[:, k], unmix[k], float(score[k]), len(w))


def removed(traces: DataFrame, found: Component) -> DataFrame:
    """traces with artefact, the component at each sample, and xs without it."""
    each = zip(found.unmixing, found.mean, strict=True)
    level = sum((F.get("xs", i) - float(m)) * float(u) for i, (u, m) in enumerate(each))
    loading = F.array(*[F.lit(float(v)) for v in found.loading])
    out = traces.withColumn("artefact", level)
    return out.withColumn("xs", F.transform("xs", lambda x, i: x - F.get(loading, i) * F.col("artefact")))


def bursts(rows: DataFrame, how: Finding = Finding(), block: int = 65_536) -> DataFrame:
    """session, sample, height: peaks of the component's envelope (the mean size around a sample) in rows(session, sample, artefact).

    From a sample on where the envelope reaches the threshold its highest place within reach is a burst, the first of equal ones, and the search goes on after the refractory time. The threshold is of
    each session's own median size.
    """
    limit = rows.groupBy(F.col("session").alias("_s")).agg((how.threshold * 1.4826 * F.percentile_approx(F.abs("artefact"), 0.5, 10_000)).alias("_limit"))
    half = how.envelope // 2
    held = with_halo(rows.select("session", "sample", "artefact"), "sample", half, how.reach + how.envelope, block)
    w = Window.partitionBy("session", "block").orderBy("sample")
    held = held.withColumn("height", F.avg(F.abs("artefact")).over(w.rowsBetween(-half, how.envelope - 1 - half)))
    ahead = w.rowsBetween(0, how.reach - 1)
    held = held.withColumn("_top", F.min(F.struct((-F.col("height")).alias("h"), "sample")).over(ahead)).filter("own").drop("block", "own", "artefact")
    over = held.join(F.broadcast(limit), F.col("session") == F.col("_s")).filter((F.col("_limit") > 0) & (F.col("height") >= F.col("_limit")))
    over = over.select("session", "sample", F.col("_top.sample").alias("peak"), (-F.col("_top.h")).alias("height"), (F.col("_top.sample") + how.refractory).alias("after"))
    walked = scans.jumps(over, ["session"], "sample", "after", how.reach + how.refractory, block)
    return walked.select("session", F.col("peak").alias("sample"), "height")
