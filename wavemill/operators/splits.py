"""Splits of units and what one spike tells: density basins, two Gaussians, a source's place, two units in one waveform.

Per unit only counts over a grid or bins are gathered, whose number does not grow with the spikes; single spikes are fitted in Arrow batches.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import Mixture, _costs


def _neighbours(grid: np.ndarray) -> np.ndarray:
    """The eight neighbours of every cell; nan from outside."""
    wide = np.pad(grid.astype(float), 1, constant_values=np.nan)
    h, w = grid.shape
    return np.stack([wide[i : i + h, j : j + w] for i in range(3) for j in range(3) if (i, j) != (1, 1)])


def _smooth(grid: np.ndarray, sigma: float) -> np.ndarray:
    half = int(np.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    for _ in range(2):
        grid = np.stack([np.convolve(np.pad(row, half, mode="edge"), kernel, "valid") for row in grid]).T
    return grid


def basins(density: np.ndarray, least: float = 0.05) -> np.ndarray:
    """Basins of the peaks that reach `least` of the highest, numbered in reading order; 0 on the lines between them and where none arrives.

    Cells are taken by falling density (ties in reading order) next to what is labelled; a cell that touches two basins is a line.
    """
    around = _neighbours(density)
    peak = (density >= least * density.max()) & ~(around > density).any(0) & (around < density).any(0)
    label = np.zeros(density.shape, int)
    label[peak] = np.arange(1, peak.sum() + 1)
    h, w = density.shape
    queue = []

    def push(y: int, x: int, diagonal: bool) -> None:
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                v, u = y + dy, x + dx
                if (dy or dx) and (diagonal or not (dy and dx)) and 0 <= v < h and 0 <= u < w and not label[v, u]:
                    heapq.heappush(queue, (-density[v, u], v, u))

    for y, x in np.argwhere(peak):
        push(y, x, True)
    while queue:
        _, y, x = heapq.heappop(queue)
        if label[y, x]:
            continue
        near = set(label[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].ravel().tolist()) - {0}
        if len(near) == 1:
            label[y, x] = near.pop()
            push(y, x, False)
    return label


def watershed(points: DataFrame, size: int = 256, least: int = 20) -> DataFrame:
    """points(spike_id, cluster, x, y) with part: the density basin of each point of its cluster, from 1 by the smallest spike_id.

    A cluster's points are counted on a grid over their range and smoothed. Points on lines, in basins of fewer than `least` or a hundredth of the
    points, of clusters without extent and with a null or a value that is no number are in part 0.
    """
    real = points.select("*", (F.coalesce(F.abs("x") < float("inf"), F.lit(False)) & F.coalesce(F.abs("y") < float("inf"), F.lit(False))).alias("_real"))
    box = real.filter("_real").groupBy("cluster").agg(*[f(c).alias(f"_{n}{c}") for n, f in (("low", F.min), ("high", F.max)) for c in "xy"])
    at = lambda c: F.when(F.col("_real") & (F.col("_highx") > F.col("_lowx")) & (F.col("_highy") > F.col("_lowy")), F.floor((F.col(c) - F.col(f"_low{c}")) * (size - 1) / (F.col(f"_high{c}") - F.col(f"_low{c}")))).cast("int")
    placed = real.join(box, "cluster", "left").withColumn("_i", at("x")).withColumn("_j", at("y")).drop("_real", "_lowx", "_lowy", "_highx", "_highy")
    counts = placed.filter("_i IS NOT NULL").groupBy("cluster", "_i", "_j").agg(F.count("*").alias("n"), F.min("spike_id").alias("first"))

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((size, size))
        grid[cells["_j"], cells["_i"]] = cells["n"]
        cells["part"] = basins(_smooth(grid, max(1.5, size / 32)))[cells["_j"], cells["_i"]]
        held = cells[cells["part"] > 0].groupby("part").agg(n=("n", "sum"), first=("first", "min"))
        held = held[held["n"] >= max(least, int(cells["n"].sum()) // 100)].sort_values("first")
        names = {p: i + 1 for i, p in enumerate(held.index)}
        return cells[["cluster", "_i", "_j"]].assign(part=[names.get(p, 0) for p in cells["part"]])

    parts = counts.groupBy("cluster").applyInPandas(run, "cluster long, _i int, _j int, part long")
    return placed.join(parts, ["cluster", "_i", "_j"], "left").drop("_i", "_j").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))


def apart(x: np.ndarray, n: np.ndarray) -> int:
    """How many of the ordered values x (n of each) go to the left so that both sides vary least about their means."""
    count, total = np.cumsum(n)[:-1], np.cumsum(n * x)[:-1]
    # the squares of all are the same; what the two means take of them is largest
    taken = total**2 / count + ((n @ x) - total) ** 2 / (n.sum() - count)
    return int(taken.argmax()) + 1


def soft_classes(x: np.ndarray, n: np.ndarray, model: Mixture, floor: float, rounds: int) -> Mixture:
    """Expectation and maximisation on values x, n of each: every value belongs to each class in part. The score is the log likelihood; it ends when that hardly rises."""
    column, power = x[:, None], np.column_stack([np.ones_like(x), x, x * x])
    for _ in range(rounds):
        log = -_costs(column, model)
        whole = np.logaddexp.reduce(log, axis=1)
        score = float(n @ whole)
        if score <= model.score + 1e-9 * abs(score):
            break
        sums = (np.exp(log - whole[:, None]) * n[:, None]).T @ power
        mean = sums[:, 1:2] / np.maximum(sums[:, :1], 1e-300)
        var = np.maximum(sums[:, 2:] / np.maximum(sums[:, :1], 1e-300) - mean**2, floor)
        model = Mixture(mean, var, np.maximum(sums[:, 0] / n.sum(), 1e-300), score)
    return model


def two_gaussians(values: DataFrame, bins: int = 4096, rounds: int = 500) -> DataFrame:
    """cluster, n, the two means, deviations and weights (by rising mean), bic1, bic2 and ashman from values(cluster, x).

    A cluster's range is cut into at most `bins` equal parts, and their means are fitted by one and by two classes, these from the cut with the least variance on its sides; no class is
    narrower than a part. bic1 and bic2 are their information criteria, ashman the distance of the means in deviations (2 or more: apart). With fewer than 4 values or no
    extent all but n are null. Null values and values that are no numbers do not count.
    """
    real = values.filter("abs(x) < double('infinity')")
    box = real.groupBy("cluster").agg(F.min("x").alias("_low"), F.max("x").alias("_high"))
    part = F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide((F.col("x") - F.col("_low")) * bins, F.col("_high") - F.col("_low")))), F.lit(0))
    counts = real.join(box, "cluster").groupBy("cluster", part.alias("i")).agg(F.count("*").alias("n"), F.avg("x").alias("x"))
    names = ["mean0", "mean1", "std0", "std1", "weight0", "weight1", "bic1", "bic2", "ashman"]

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("x")
        x, n = cells["x"].to_numpy(float), cells["n"].to_numpy(float)
        total, found = n.sum(), [None] * len(names)
        if total >= 4 and len(x) > 1:
            floor = max((np.ptp(x) / bins) ** 2, 1e-12)
            cut = apart(x, n)
            fits = []
            for sides in ([slice(None)], [slice(cut), slice(cut, None)]):
                mean = np.array([[np.average(x[s], weights=n[s])] for s in sides])
                var = np.array([[max(np.average((x[s] - m) ** 2, weights=n[s]), floor)] for s, (m,) in zip(sides, mean, strict=True)])
                begun = Mixture(mean, var, np.array([n[s].sum() / total for s in sides]), -np.inf)
                fits.append(soft_classes(x, n, begun, floor, rounds))
            one, two = fits
            order = two.mean[:, 0].argsort()
            mean, sd = two.mean[order, 0], np.sqrt(two.var[order, 0])
            bic = [(3 * k - 1) * np.log(total) - 2 * fit.score for k, fit in ((1, one), (2, two))]
            found = [*mean, *sd, *two.weight[order], *bic, np.sqrt(2 / (sd @ sd)) * (mean[1] - mean[0])]
        return pd.DataFrame([[int(cells["cluster"].iloc[0]), int(total), *found]], columns=["cluster", "n", *names])

    return counts.groupBy("cluster").applyInPandas(run, "cluster long, n long, " + ", ".join(f"{c} double" for c in names))


def localised(rows: DataFrame, column: str, sites: np.ndarray, reach: float = 200.0, rounds: int = 80) -> DataFrame:
    """rows with place (x, y, z), amplitude and rms: the point source whose amplitude over distance fits a spike's swings by site best in logs.

    Damped least squares from the centre of the swings, all rows of a batch at once; x and y stay within `reach` of the sites, z within 1 and `reach`. Swings
    below 1 count as 1. Null where there is no swing, a site has none, or the source is farther than `reach` from every site.
    """
    low = np.array([*(sites.min(0) - reach), 0.0, np.log(0.1)])
    high = np.array([*(sites.max(0) + reach), np.log(reach), np.log(1e9)])

    def model(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dx, dy, zz = p[:, :1] - sites[:, 0], p[:, 1:2] - sites[:, 1], np.exp(2 * p[:, 2:3])
        square = dx**2 + dy**2 + zz
        return p[:, 3:] - np.log(square) / 2, np.stack([-dx / square, -dy / square, -zz / square, np.ones_like(dx)], 2)

    def solve(a: np.ndarray) -> np.ndarray:
        want, w = np.log(np.maximum(a, 1)), np.maximum(a, 0)
        p = np.column_stack([w @ sites / w.sum(1, keepdims=True), np.full(len(a), np.log(25.0)), np.log(np.maximum(a.max(1) * 25, 1))])
        damp = np.full(len(a), 1e-2)
        value, slope = model(p)
        cost = ((value - want) ** 2).sum(1)
        for _ in range(rounds):
            square = np.einsum("nsi,nsj->nij", slope, slope)
            square += damp[:, None, None] * (np.einsum("nii->ni", square)[:, :, None] * np.eye(4) + 1e-12 * np.eye(4))
            step = np.linalg.solve(square, np.einsum("nsi,ns->ni", slope, want - value)[:, :, None])[:, :, 0]
            trial = np.clip(p + step, low, high)
            new, bent = model(trial)
            less = ((new - want) ** 2).sum(1)
            good = less < cost
            p[good], value[good], slope[good], cost[good] = trial[good], new[good], bent[good], less[good]
            damp = np.clip(np.where(good, damp / 3, damp * 4), 1e-9, 1e9)
        far = np.sqrt(((p[:, None, :2] - sites) ** 2).sum(2)).min(1) > reach
        return np.where(far[:, None], np.nan, np.column_stack([p[:, :2], np.exp(p[:, 2:]), np.sqrt(cost / len(sites))]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.full((len(batch), 5), np.nan)
            whole = [v is not None and len(v) == len(sites) and np.isfinite(np.asarray(v, float)).all() and np.max(v) > 1e-9 for v in batch[column]]
            if any(whole):
                out[whole] = solve(np.stack(batch[column][whole].to_numpy()).astype(float))
            found = pd.DataFrame(out, columns=["_x", "_y", "_z", "_a", "_r"], index=batch.index)
            yield pd.concat([batch, found], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    found = rows.mapInPandas(run, fields + ", _x double, _y double, _z double, _a double, _r double")
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    return found.select(*rows.columns, F.when(F.col("_x").isNotNull() & ~F.isnan("_x"), F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_z").alias("z"))).alias("place"), real("_a").alias("amplitude"), real("_r").alias("rms"))


def two_units(rows: DataFrame, column: str, templates: dict[int, np.ndarray], lags: int = 2, gain: tuple[float, float] = (0.5, 1.5)) -> DataFrame:
    """rows with alone and together: the best template, and the best two of different units, each with its lag and gain, and what they leave of the energy.

    Templates (samples x channels; a model, sent to every task) are tried at all lags, zeros from outside, with gains in bounds. Ties go to the lower
    units and lags. Null without energy, or where fewer than two units are known for `together`.
    """
    library, names = [], []
    for unit, t in sorted(templates.items()):
        for lag in range(-lags, lags + 1):
            moved = np.zeros_like(t, float)
            moved[max(0, lag) : len(t) + min(0, lag)] = t[max(0, -lag) : len(t) - max(0, lag)]
            library.append(moved.ravel())
            names.append((unit, lag))
    shapes = np.stack(library)
    cross = shapes @ shapes.T
    power = np.maximum(np.diag(cross), 1e-12)
    low, high = gain

    def best_two(hit: np.ndarray) -> tuple[np.ndarray, ...]:
        """For every row the pair (p, q) and gains that take most energy; a box in two variables: the free optimum inside, else the best on an edge."""
        taken = np.full(len(hit), -np.inf)
        out = np.zeros((len(hit), 4))
        for p in range(len(names)):
            q = np.array([j for j in range(p + 1, len(names)) if names[j][0] != names[p][0]], int)
            if not len(q):
                continue
            a, b, c, hp, hq = power[p], power[q], cross[p, q], hit[:, p : p + 1], hit[:, q]
            gives = lambda g, k: 2 * (g * hp + k * hq) - g * g * a - k * k * b - 2 * g * k * c  # noqa: E731, B023
            det = np.where(np.abs(a * b - c * c) > 1e-9 * a * b, a * b - c * c, np.inf)
            g, k = (hp * b - hq * c) / det, (hq * a - hp * c) / det
            inside = (g >= low) & (g <= high) & (k >= low) & (k <= high)
            tried = [(np.where(inside, g, low), np.where(inside, k, low))]
            for edge in gain:
                tried.append((np.full_like(hq, edge), np.clip((hq - edge * c) / b, low, high)))
                tried.append((np.clip((hp - edge * c) / a, low, high) + 0 * hq, np.full_like(hq, edge)))
            score = np.stack([gives(g, k) for g, k in tried])
            flat = score.transpose(1, 2, 0).reshape(len(hit), -1)
            at = flat.argmax(1)
            more = flat[np.arange(len(hit)), at] > taken + 1e-9
            j, t, r = at // len(tried), at % len(tried), np.arange(len(hit))
            gs, ks = np.stack([g for g, _ in tried])[t, r, j], np.stack([k for _, k in tried])[t, r, j]
            out[more] = np.column_stack([np.full(len(hit), p), q[j], gs, ks])[more]
            taken = np.where(more, flat[r, at], taken)
        return taken, out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch[column].to_numpy()).astype(float) if len(batch) else np.zeros((0, shapes.shape[1]))
            hit, energy = x @ shapes.T, (x * x).sum(1)
            g = np.clip(hit / power, low, high)
            takes = 2 * g * hit - g * g * power
            one = takes.argmax(1) if len(x) else np.zeros(0, int)
            both, pair = best_two(hit)
            alone, together = [], []
            for i in range(len(x)):
                unit, lag = names[one[i]]
                alone.append((unit, lag, g[i, one[i]], max(0.0, 1 - takes[i, one[i]] / energy[i])) if energy[i] > 0 else None)
                (ua, la), (ub, lb) = names[int(pair[i, 0])], names[int(pair[i, 1])]
                together.append((ua, la, pair[i, 2], ub, lb, pair[i, 3], max(0.0, 1 - both[i] / energy[i])) if energy[i] > 0 and np.isfinite(both[i]) else None)
            named = lambda rows, keys: [None if r is None else dict(zip(keys, r, strict=True)) for r in rows]
            yield batch.assign(alone=named(alone, ("unit", "lag", "gain", "left")), together=named(together, ("unit_a", "lag_a", "gain_a", "unit_b", "lag_b", "gain_b", "left")))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, fields + ", alone struct<unit:long,lag:long,gain:double,left:double>, together struct<unit_a:long,lag_a:long,gain_a:double,unit_b:long,lag_b:long,gain_b:double,left:double>")
