"""Units that are two: the deepest valley of their density along many directions, tested by a chain of gates.

All units go through each step together. Per unit only sums, ranges and counts in cells are gathered, whose number does not grow with its spikes; spikes are
scored in Arrow batches where they lie. Models on the driver are a few numbers for each unit and dimension, or pair of dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import wilson_hilferty
from .curation import checkpoint_dir


@dataclass(frozen=True)
class Dip:
    """least: spikes of each half. bloat: how often the chi-square quantile the 90th percentile of the squared Mahalanobis distance must reach, and elongation: how often
    the median of the three largest variances the largest must be; either will do, and both at 0 ask for nothing. depth: of the valley, against the lower of its peaks. directions: how
    many in the plane of the first two components are tried beside the first three components. grid: points of the density; fine: counting cells
    between two of them. rounds: of two-means. held: numbers of the models that are sent to tasks at once."""

    least: int = 20
    bloat: float = 0.0
    elongation: float = 0.0
    depth: float = 0.2
    directions: int = 36
    grid: int = 301
    fine: int = 16
    rounds: int = 20
    held: int = 8_000_000

    def axes(self) -> np.ndarray:
        """Directions by components: the components themselves, then the plane's."""
        angle = np.arange(self.directions) * np.pi / max(1, self.directions)
        return np.vstack([np.eye(3), np.column_stack([np.cos(angle), np.sin(angle), 0 * angle])])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def moments(rows: DataFrame, column: str, size: int, how: Dip) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """cluster -> n, mean and covariance (n - 1) of array rows. Tasks add up products of what is left of the mean of all, and Spark adds the tasks'."""
    centre = np.array([m or 0.0 for m in rows.agg(*[F.avg(F.get(column, i)) for i in range(size)]).first()], float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, part in batch.groupby("cluster")[column]:
                x = np.hstack([np.ones((len(part), 1)), _matrix(part)[:, :size] - centre])
                sums[c] = sums.get(c, 0) + x.T @ x
        for c, m in sums.items():
            yield pd.DataFrame({"cluster": c, "cell": np.arange(m.size), "value": m.ravel()})

    added = rows.select("cluster", column).mapInPandas(run, "cluster long, cell long, value double").groupBy("cluster", "cell").agg(F.sum("value").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in added.collect():  # (size + 1) squared for each unit
        out.setdefault(r["cluster"], np.zeros((size + 1) ** 2))[r["cell"]] = r["v"]
    found = {}
    for c, flat in out.items():
        m = flat.reshape(size + 1, size + 1)
        n, off = int(m[0, 0]), m[0, 1:] / m[0, 0]
        found[c] = (n, centre + off, (m[1:, 1:] - n * np.outer(off, off)) / max(1, n - 1))
    return found


def valley(counts: np.ndarray, h: float, how: Dip) -> tuple[float, int]:
    """The depth of the deepest valley between neighbouring peaks and its grid point, of a density with Gaussian kernels of width h (in cells)."""
    reach = np.arange(-int(np.ceil(5 * h)), int(np.ceil(5 * h)) + 1)
    density = np.convolve(counts, np.exp(-0.5 * (reach / h) ** 2))[len(reach) // 2 :][: len(counts)][:: how.fine]
    up = np.diff(density) > 0
    down = np.diff(density) < 0
    peaks = np.flatnonzero(up[:-1] & down[1:]) + 1
    best = (0.0, -1)
    for a, b in zip(peaks[:-1], peaks[1:], strict=True):
        at = a + 1 + int(density[a + 1 : b].argmin())
        best = max(best, (1 - density[at] / min(density[a], density[b]), at), key=lambda v: v[0])
    return best


def _whitening(cov: np.ndarray) -> np.ndarray | None:
    """What makes rows that are left of the mean uncorrelated; None where a dimension does not vary at all."""
    ridge = 1e-6 * np.trace(cov) / len(cov)
    try:
        return np.linalg.inv(np.linalg.cholesky(cov + ridge * np.eye(len(cov))))
    except np.linalg.LinAlgError:
        return None


def _scored(rows: DataFrame, column: str, size: int, models: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """spike_id, cluster, column, far (squared Mahalanobis distance) and s (scores) of the units' spikes. models: mean, whitening, three components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c, part in batch.groupby("cluster"):
                if c in models:
                    mean, white, vectors = models[c]
                    x = _matrix(part[column])[:, :size] - mean
                    yield part.assign(far=((x @ white.T) ** 2).sum(1), s=list(x @ vectors.T))

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(run, f"spike_id {types['spike_id']}, cluster {types['cluster']}, `{column}` {types[column]}, far double, s array<double>")


def _two_means(rows: DataFrame, column: str, size: int, seeds: dict[int, np.ndarray], rounds: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Centres and sums (half x (number, sums, squares)) of each unit after two-means from its seeds: a pass for each round, until no unit moves."""

    def summed(centres: dict[int, np.ndarray]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for c, part in batch.groupby("cluster")[column]:
                    if c in centres:
                        x = _matrix(part)[:, :size]
                        x = np.hstack([np.ones((len(x), 1)), x, x * x])
                        right = halves(x[:, 1 : size + 1], centres[c])
                        sums[c] = sums.get(c, 0) + np.stack([x[~right].sum(0), x[right].sum(0)])
            for c, m in sums.items():
                yield pd.DataFrame({"cluster": c, "cell": np.arange(m.size), "value": m.ravel()})

        return run

    centres, sums = dict(seeds), {}
    moving = set(seeds)
    for _ in range(rounds):
        found: dict[int, np.ndarray] = {}
        asked = {c: centres[c] for c in moving}
        for r in rows.select("cluster", column).mapInPandas(summed(asked), "cluster long, cell long, value double").groupBy("cluster", "cell").agg(F.sum("value").alias("v")).collect():
            found.setdefault(r["cluster"], np.zeros(2 * (2 * size + 1)))[r["cell"]] = r["v"]
        for c in sorted(moving):
            sums[c] = found[c].reshape(2, -1)
            n = sums[c][:, :1]
            new = sums[c][:, 1 : size + 1] / np.maximum(n, 1)
            if n.min() == 0 or np.array_equal(new, centres[c]):
                moving.discard(c)
            else:
                centres[c] = new
        if not moving:
            break
    return centres, sums


def halves(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Whether the second centre is nearer than the first."""
    return ((x - centres[1]) ** 2).sum(1) < ((x - centres[0]) ** 2).sum(1)


def _criterion(sums: np.ndarray, size: int) -> tuple[float, float]:
    """Information criteria of one and of two Gaussians without covariances, from the halves' numbers, sums and squares."""
    total = sums.sum(0)

    def deviance(s: np.ndarray) -> float:
        n = s[0]
        if n < 2:
            return 0.0
        var = np.maximum(s[size + 1 :] / n - (s[1 : size + 1] / n) ** 2, 1e-10)
        return n * (np.log(2 * np.pi * var) + 1).sum()

    log = np.log(max(1.0, total[0]))
    return float(deviance(total) + 2 * size * log), float(sum(map(deviance, sums)) + (4 * size + 1) * log)


def dip_split(rows: DataFrame, column: str, size: int, how: Dip = Dip()) -> tuple[DataFrame, DataFrame]:
    """Two tables. spike_id, cluster, half: 0 in units that stay whole, else 1 or 2. cluster, n, reason, depth, left, right, bic1, bic2: what was decided of each unit and the
    numbers it came to (null where it did not get so far).

    Gates in order: enough spikes for two halves (too_small), varying features (bad_features), bloat or elongation (not_bloated), a valley deep enough along some direction
    (no_valley), both sides of it large enough, before and after two-means from there (small_half), and a better information criterion for two Gaussians (bic_worse). Rows
    with a null cluster, features or a feature that is no number are left out. Ties between directions go to the first.
    """
    checkpoint_dir(rows.sparkSession)
    spark = rows.sparkSession
    plain = F.coalesce(F.forall(F.slice(column, 1, size), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & (F.size(column) >= size), F.lit(False))
    rows = rows.select("spike_id", "cluster", column).filter(F.col("cluster").isNotNull() & plain).checkpoint()
    known = moments(rows, column, size, how)
    told: dict[int, dict] = {c: {"n": n, "reason": "too_small" if n < 2 * how.least else ""} for c, (n, _, _) in known.items()}
    models, spread, longer = {}, {}, set()
    for c, (_, mean, cov) in known.items():
        if told[c]["reason"]:
            continue
        white = _whitening(cov)
        if white is None or size < 2:
            told[c]["reason"] = "bad_features"
            continue
        value, vector = np.linalg.eigh(cov)
        top = vector[:, ::-1][:, :3].T
        top = np.vstack([top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(1)])[:, None], np.zeros((3 - len(top), size))])
        models[c] = (mean, white, top)
        axes = how.axes() @ top
        spread[c] = np.sqrt(np.maximum(np.einsum("ki,ij,kj->k", axes, cov, axes), 0))
        if how.elongation and value[-1] >= how.elongation * np.median(value[::-1][:3]):
            longer.add(c)
    # models go to tasks in parts of a bounded size
    each = max(1, how.held // (size * size + 4 * size))
    names = sorted(models)
    parts = [_scored(rows, column, size, {c: models[c] for c in names[at : at + each]}) for at in range(0, len(names), each)]
    scored = None
    for part in parts:
        part = part.checkpoint()
        scored = part if scored is None else scored.unionByName(part)
    valleys = _valleys(scored, spread, longer, told, size, how) if scored is not None else {}
    if valleys:
        seeds = _seeds(scored, column, size, valleys, told, how)
        centres, sums = _two_means(rows, column, size, seeds, how.rounds) if seeds else ({}, {})
    else:
        centres, sums = {}, {}
    for c in sums:
        left, right = (int(n) for n in sums[c][:, 0])
        bic1, bic2 = _criterion(sums[c], size)
        told[c] |= {"left": left, "right": right, "bic1": bic1, "bic2": bic2}
        told[c]["reason"] = "small_half" if min(left, right) < how.least else "split" if bic2 < bic1 else "bic_worse"
    apart = {c: centres[c] for c in centres if told[c]["reason"] == "split"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c, part in batch.groupby("cluster"):
                half = 1 + halves(_matrix(part[column])[:, :size], apart[c]) if c in apart else 0
                yield part[["spike_id", "cluster"]].assign(half=half)

    fields = "cluster long, n long, reason string, depth double, left long, right long, bic1 double, bic2 double"
    keys = [f.split()[0] for f in fields.split(", ")][1:]
    decided = spark.createDataFrame([(c, *map(t.get, keys)) for c, t in sorted(told.items())], fields)
    return rows.mapInPandas(run, "spike_id long, cluster long, half int"), decided


def _valleys(scored: DataFrame, spread: dict[int, np.ndarray], longer: set[int], told: dict[int, dict], size: int, how: Dip) -> dict[int, tuple[np.ndarray, float]]:
    """cluster -> direction (in components) and place of its deepest valley, of units that pass the gates up to there."""
    axes = how.axes()
    along = F.array(*[sum(F.get("s", i) * float(a) for i, a in enumerate(axis)) for axis in axes])
    placed = scored.select("cluster", "far", along.alias("p"))
    ends = placed.groupBy("cluster").agg(F.percentile_approx("far", 0.9, 10_000).alias("far"), *[f(F.get("p", k)).alias(f"{n}{k}") for n, f in (("a", F.min), ("b", F.max)) for k in range(len(axes))])
    limit = how.bloat * wilson_hilferty(size, 1.2816)
    boxes = []
    for r in ends.collect():  # a row for each unit
        c = r["cluster"]
        if (how.bloat or how.elongation) and not ((how.bloat and r["far"] >= limit) or c in longer):
            told[c]["reason"] = "not_bloated"
            continue
        h = 1.06 * spread[c] * told[c]["n"] ** -0.2
        low = np.array([r[f"a{k}"] for k in range(len(axes))]) - 3 * h
        step = (np.array([r[f"b{k}"] for k in range(len(axes))]) + 3 * h - low) / ((how.grid - 1) * how.fine)
        boxes.append((c, low.tolist(), step.tolist(), h.tolist()))
    if not boxes:
        return {}
    box = scored.sparkSession.createDataFrame(boxes, "cluster long, low array<double>, step array<double>, h array<double>")
    cell = F.transform("p", lambda p, k: F.when(F.get("h", k) > 0, F.struct(k.alias("k"), F.round((p - F.get("low", k)) / F.get("step", k)).cast("int").alias("cell"))))
    cells = placed.join(F.broadcast(box), "cluster")
    counts = cells.select("cluster", F.explode(cell).alias("c")).filter("c IS NOT NULL").groupBy("cluster", "c.k", "c.cell").agg(F.count("*").alias("n"))
    widths = {c: np.array(h) / np.array(step) for c, _, step, h in boxes if max(h) > 0}

    def deepest(cells: pd.DataFrame) -> pd.DataFrame:
        c = int(cells["cluster"].iloc[0])
        best = (0.0, 0, -1)
        for k, own in cells.groupby("k"):
            counted = np.bincount(own["cell"], weights=own["n"], minlength=(how.grid - 1) * how.fine + 1)
            depth, at = valley(counted, widths[c][k], how)
            best = max(best, (depth, -int(k), at), key=lambda v: v[:2])
        return pd.DataFrame({"cluster": [c], "k": [-best[1]], "at": [best[2]], "depth": [best[0]]})

    found = {r["cluster"]: r for r in counts.groupBy("cluster").applyInPandas(deepest, "cluster long, k int, at int, depth double").collect()}
    out = {}
    for c, low, step, _ in boxes:
        depth = found[c]["depth"] if c in found else 0.0
        told[c] |= {"depth": depth, "reason": "" if depth >= how.depth and found[c]["at"] >= 0 else "no_valley"}
        if not told[c]["reason"]:
            k = found[c]["k"]
            out[c] = (axes[k], low[k] + found[c]["at"] * how.fine * step[k])
    return out


def _seeds(scored: DataFrame, column: str, size: int, valleys: dict[int, tuple[np.ndarray, float]], told: dict[int, dict], how: Dip) -> dict[int, np.ndarray]:
    """cluster -> the means of what lies before and after its valley."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, part in batch.groupby("cluster"):
                if c in valleys:
                    axis, at = valleys[c]
                    x = np.hstack([np.ones((len(part), 1)), _matrix(part[column])[:, :size]])
                    right = _matrix(part["s"]) @ axis >= at
                    sums[c] = sums.get(c, 0) + np.stack([x[~right].sum(0), x[right].sum(0)])
        for c, m in sums.items():
            yield pd.DataFrame({"cluster": c, "cell": np.arange(m.size), "value": m.ravel()})

    added: dict[int, np.ndarray] = {}
    for r in scored.mapInPandas(run, "cluster long, cell long, value double").groupBy("cluster", "cell").agg(F.sum("value").alias("v")).collect():
        added.setdefault(r["cluster"], np.zeros(2 * (size + 1)))[r["cell"]] = r["v"]
    out = {}
    for c, flat in added.items():
        m = flat.reshape(2, -1)
        told[c] |= {"left": int(m[0, 0]), "right": int(m[1, 0])}
        if m[:, 0].min() < how.least:
            told[c]["reason"] = "small_half"
        else:
            out[c] = m[:, 1:] / m[:, :1]
    return out
