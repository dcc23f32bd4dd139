"""Principal components, Gaussian mixtures and seeding: sums over rows in Spark, small matrices on the driver.

Only sums over dimensions (not rows) reach the driver: a Gram matrix of D x D numbers, or K models of D numbers. Rows are scored
where they lie against models that are sent to every task; K and D are configuration, not data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import wilson_hilferty


def gram(rows: DataFrame, column: str, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance (n - 1) of array rows: the mean first, then each task adds up products of what is left of it, so that large means
    cancel nothing, and Spark adds the tasks'."""
    at = {r["d"]: r["m"] for r in rows.select(F.posexplode(F.slice(column, 1, size)).alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m")).collect()}
    mean = np.array([at.get(i, 0.0) for i in range(size)], float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            if len(batch):
                x = np.stack(batch[column].to_numpy())[:, :size].astype(float) - mean
                x = np.hstack([np.ones((len(x), 1)), x])
                total += x.T @ x
        yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

    sums = np.zeros((size + 1) ** 2)
    for cell, value in rows.select(column).mapInPandas(run, "cell long, value double").groupBy("cell").agg(F.sum("value")).collect():
        sums[cell] = value
    sums = sums.reshape(size + 1, size + 1)
    n = int(sums[0, 0])
    off = sums[0, 1:] / max(1, n)  # what rounding left of the mean
    return n, mean + off, (sums[1:, 1:] - n * np.outer(off, off)) / max(1, n - 1)


def components(rows: DataFrame, column: str, size: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, variances and components (rows), the largest first; each one's largest entry is positive."""
    _, mean, cov = gram(rows, column, size)
    value, vector = np.linalg.eigh(cov)
    order = value.argsort()[::-1][:keep]
    vector = vector[:, order].T
    sign = np.sign(vector[np.arange(len(vector)), np.abs(vector).argmax(1)])
    return mean, value[order], vector * sign[:, None]


def varimax(vectors: np.ndarray, sweeps: int = 100) -> np.ndarray:
    """Components (rows) turned among themselves so that each loads on few dimensions: the variance of the squared loadings is largest.

    Pairs are turned in their plane by the best angle, which is known in closed form, until no pair moves.
    """
    out = vectors.astype(float).copy()
    n = out.shape[1]
    for _ in range(sweeps):
        moved = 0.0
        for i in range(len(out)):
            for j in range(i + 1, len(out)):
                u, v = out[i] ** 2 - out[j] ** 2, 2 * out[i] * out[j]
                a, b = u.sum(), v.sum()
                angle = np.arctan2(2 * (u @ v) - 2 * a * b / n, u @ u - v @ v - (a * a - b * b) / n) / 4
                c, s = np.cos(angle), np.sin(angle)
                out[[i, j]] = c * out[i] + s * out[j], c * out[j] - s * out[i]
                moved = max(moved, abs(angle))
        if moved < 1e-9:
            break
    return out


def project(rows: DataFrame, column: str, mean: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """rows with scores: what is left of the mean along each component."""
    scores = [sum((F.get(column, i) - float(m)) * float(v) for i, (m, v) in enumerate(zip(mean, vector, strict=True))) for vector in vectors]
    return rows.withColumn("scores", F.array(*scores))


@dataclass
class Mixture:
    """Gaussian classes with weights, and the score of the fit: negative log likelihood and penalty. var holds variances or, with a third axis, covariances."""

    mean: np.ndarray
    var: np.ndarray
    weight: np.ndarray
    score: float


def penalty(d: int, k: int, n: int, mix: float = 1.0) -> float:
    """Between AIC (0) and BIC (1), for full covariances."""
    p = (d * (d + 1) / 2 + d + 1) * (k - 1)
    return (1 - mix) * 2 * p + mix * p * float(np.log(n)) / 2


def _costs(x: np.ndarray, model: Mixture) -> np.ndarray:
    """Negative log density and weight of every row under every class."""
    d = model.mean.shape[1]
    if model.var.ndim == 3:
        root = np.linalg.cholesky(model.var)
        held = np.log(np.einsum("kii->ki", root)).sum(1) - np.log(model.weight) + d / 2 * np.log(2 * np.pi)
        return np.stack([(np.linalg.solve(r, (x - m).T) ** 2).sum(0) / 2 + c for m, r, c in zip(model.mean, root, held, strict=True)], 1)
    held = np.log(model.var).sum(1) / 2 - np.log(model.weight) + d / 2 * np.log(2 * np.pi)
    return np.stack([((x - m) ** 2 / v).sum(1) / 2 + c for m, v, c in zip(model.mean, model.var, held, strict=True)], 1)


def _matrix(values: pd.Series, size: int) -> np.ndarray:
    return np.stack(values.to_numpy())[:, :size].astype(float)


def assign(rows: DataFrame, column: str, model: Mixture) -> DataFrame:
    """rows with class and cost: the class of the least cost, the first of equal ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                costs = _costs(_matrix(batch[column], model.mean.shape[1]), model)
                yield batch.assign(**{"class": costs.argmin(1), "cost": costs.min(1)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, fields + ", class long, cost double")


def farthest_first(rows: DataFrame, column: str, size: int, k: int) -> np.ndarray:
    """k seeds: the row with the smallest id, then each time the row farthest from all seeds; ties to the smallest id. Each task sends its farthest row."""
    first = rows.orderBy("spike_id").select(column).first()[0]
    seeds = np.array([first[:size]], float)

    def farthest(seeds: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for batch in batches:
                if len(batch):
                    x = _matrix(batch[column], size)
                    far = np.min([((x - s) ** 2).sum(1) for s in seeds], 0)
                    i = np.lexsort((batch["spike_id"].to_numpy(), -far))[0]
                    found = (-far[i], int(batch["spike_id"].iloc[i]), x[i])
                    best = found if best is None or found[:2] < best[:2] else best
            yield pd.DataFrame([best] if best else [], columns=["near", "id", "x"])

        return run

    while len(seeds) < k:
        got = rows.select("spike_id", column).mapInPandas(farthest(seeds), "near double, id long, x array<double>").agg(F.min(F.struct("near", "id", "x")).alias("b")).first()["b"]
        seeds = np.vstack([seeds, got["x"]])
    return seeds


def fit(rows: DataFrame, column: str, size: int, k: int, rounds: int = 20, full: bool = False) -> Mixture:
    """Classification EM from farthest-first seeds: assign, then new means, variances and weights; classes with too few rows die.

    Each round is one pass over the rows, in which tasks add up numbers, costs, sums and squares (from the mean of all) per class; K x D of them reach the
    driver, or K x D x D products for full covariances. It ends when the score would not fall.
    """
    n, centre, cov = gram(rows, column, size)
    floor = np.maximum(np.diag(cov) * 1e-3, 1e-9)
    spread = np.tile(np.maximum(np.diag(cov), floor), (k, 1))
    model = Mixture(farthest_first(rows, column, size, k), spread[:, :, None] * np.eye(size) if full else spread, np.full(k, 1 / k), np.inf)
    width = 2 + size + (size * size if full else size)

    def summed(model: Mixture):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(model.mean), width))
            for batch in batches:
                if len(batch):
                    x = _matrix(batch[column], size)
                    costs = _costs(x, model)
                    own, x = costs.argmin(1), x - centre
                    for c in np.unique(own):
                        part = x[own == c]
                        squares = (part.T @ part).ravel() if full else (part * part).sum(0)
                        total[c] += np.concatenate([[len(part), costs[own == c].min(1).sum()], part.sum(0), squares])
            c, cell = np.indices(total.shape)
            yield pd.DataFrame({"class": c.ravel(), "cell": cell.ravel(), "value": total.ravel()})

        return run

    for _ in range(rounds):
        got = np.zeros((len(model.mean), width))
        for r in rows.select(column).mapInPandas(summed(model), "class int, cell int, value double").groupBy("class", "cell").agg(F.sum("value").alias("v")).collect():
            got[r["class"], r["cell"]] = r["v"]
        some = got[got[:, 0] > 0]
        score = some[:, 1].sum() + penalty(size, len(some), n)
        live = some[some[:, 0] > size]
        if not len(live) or score >= model.score - 1e-9 * abs(score):
            return model
        counts = live[:, 0]
        mean = live[:, 2 : size + 2] / counts[:, None]
        var = live[:, size + 2 :] / counts[:, None]
        if full:
            var = var.reshape(-1, size, size) - mean[:, :, None] * mean[:, None, :] + np.diag(floor)
        else:
            var = np.maximum(var - mean**2, floor)
        model = Mixture(mean + centre, var, counts / counts.sum(), score)
    return model


def chi_square_gate(size: int, z: float = 2.326348) -> float:
    return wilson_hilferty(size, z)
