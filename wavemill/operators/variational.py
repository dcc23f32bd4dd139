"""A Gaussian mixture whose number of classes is found: variational Bayes with Dirichlet weights and Normal-Wishart classes.

Every round is one pass over the rows: tasks add up responsibilities, their sums and products and the entropy of the rows' shares, and K x D x D of these reach the
driver, where the posterior follows in closed form. The evidence bound never falls; classes that explain nothing shrink to the prior and die out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .curation import checkpoint_dir
from .models import farthest_first


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of ln gamma, for x above 0: moved up to 8 or more, then its asymptotic series."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(8):
        low = x < 8
        out = out - np.where(low, 1 / x, 0)
        x = x + low
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


_lgamma = np.vectorize(lgamma, otypes=[float])


@dataclass(frozen=True)
class Prior:
    """classes: at most. weight: of the Dirichlet, the smaller the more readily classes die. mean: in how many rows the prior mean counts, spread: by how many degrees of freedom above the dimension less one the prior
    scale. rounds: at most, and gain: the least rise of the bound by row that asks for another. least: rows below which a class counts as dead in
    the result; twice a simplex's by default."""

    classes: int = 12
    weight: float = 1e-3
    mean: float = 1e-2
    spread: float = 1.0
    rounds: int = 300
    gain: float = 1e-7
    least: float | None = None


@dataclass
class Posterior:
    """Of each class: alpha (Dirichlet), beta and mean (Normal), scale (inverse of the Wishart's) and freedom. bound: of the evidence, after each round."""

    alpha: np.ndarray
    beta: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    freedom: np.ndarray
    bound: list[float]

    def __post_init__(self) -> None:
        size = self.mean.shape[1]
        self.root = np.linalg.cholesky(self.scale)
        # expected ln det of the precision, and ln of the weight
        self.precision = digamma((self.freedom[:, None] - np.arange(size)) / 2).sum(1) + size * np.log(2) - 2 * np.log(np.einsum("kii->ki", self.root)).sum(1)
        self.log_weight = digamma(self.alpha) - digamma(self.alpha.sum())

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every row its share in each class, and the log of what was shared out."""
        size = x.shape[1]
        far = np.stack([(np.linalg.solve(r, (x - m).T) ** 2).sum(0) for r, m in zip(self.root, self.mean, strict=True)], 1)
        log = self.log_weight + (self.precision - size / self.beta - size * np.log(2 * np.pi) - self.freedom * far) / 2
        whole = np.logaddexp.reduce(log, axis=1)
        return np.exp(log - whole[:, None]), whole


def _log_wishart(scale_det: np.ndarray, freedom: np.ndarray, size: int) -> np.ndarray:
    """ln of the Wishart's constant, from ln det of the inverse scale."""
    gammas = _lgamma((np.atleast_1d(freedom)[:, None] - np.arange(size)) / 2).sum(1)
    return freedom / 2 * scale_det - (freedom * size / 2 * np.log(2) + size * (size - 1) / 4 * np.log(np.pi) + gammas)


def _divergence(p: Posterior, prior: Prior, centre: np.ndarray, scale: np.ndarray) -> float:
    """How far the posterior of weights and classes is from the prior (Kullback-Leibler)."""
    k, size = p.mean.shape
    a0, b0, v0 = prior.weight, prior.mean, size - 1 + prior.spread
    weights = lgamma(p.alpha.sum()) - lgamma(k * a0) + (_lgamma(np.full(k, a0)) - _lgamma(p.alpha) + (p.alpha - a0) * p.log_weight).sum()
    off = p.mean - centre
    inverse = np.linalg.inv(p.scale)
    normal = 0.5 * (size * (b0 / p.beta - 1 - np.log(b0 / p.beta)) + b0 * p.freedom * np.einsum("ki,kij,kj->k", off, inverse, off))
    own = _log_wishart(2 * np.log(np.einsum("kii->ki", p.root)).sum(1), p.freedom, size)
    first = _log_wishart(np.full(k, np.linalg.slogdet(scale)[1]), np.full(k, v0), size)
    wishart = own - first + (p.freedom - v0) / 2 * p.precision + p.freedom / 2 * (np.einsum("ij,kji->k", scale, inverse) - size)
    return float(weights + normal.sum() + wishart.sum())


def updated(sums: np.ndarray, prior: Prior, centre: np.ndarray, scale: np.ndarray, bound: list[float]) -> Posterior:
    """The posterior from a round's sums for each class: shares, and sums and products of rows from the centre."""
    size = len(centre)
    n = sums[:, 0]
    total = sums[:, 1 : 1 + size]
    square = sums[:, 1 + size :].reshape(-1, size, size)
    beta = prior.mean + n
    mean = total / beta[:, None]  # from the centre, which is the prior mean
    new = scale + square - beta[:, None, None] * mean[:, :, None] * mean[:, None, :]
    return Posterior(prior.weight + n, beta, mean + centre, (new + new.transpose(0, 2, 1)) / 2, size - 1 + prior.spread + n, bound)


def sums_of(x: np.ndarray, p: Posterior, centre: np.ndarray) -> tuple[np.ndarray, float]:
    """A batch's part of a round's sums, and of the bound."""
    share, whole = p.shares(x)
    x = x - centre
    squares = np.einsum("nk,ni,nj->kij", share, x, x).reshape(share.shape[1], -1)
    return np.hstack([share.sum(0)[:, None], share.T @ x, squares]), float(whole.sum())


def fit(rows: DataFrame, column: str, size: int, prior: Prior = Prior()) -> Posterior | None:
    """The posterior of rows(spike_id, column) from farthest-first seeds; None without more rows than dimensions. Rows without a vector do not count."""
    checkpoint_dir(rows.sparkSession)
    real = rows.select("spike_id", column).filter(F.col(column).isNotNull()).checkpoint()
    ends = real.agg(F.count("*"), *[f(F.get(column, i).cast("double")) for i in range(size) for f in (F.avg, F.var_pop)]).first()
    n = ends[0]
    if n <= size:
        return None
    centre, var = np.array(ends[1:], float).reshape(size, 2).T
    scale = np.diag(np.maximum(var, 1e-9)) / prior.classes ** (2 / size)
    seeds = farthest_first(real, column, size, min(prior.classes, n))
    k = len(seeds)
    even = np.full(k, n / k)
    begun = Posterior(prior.weight + even, prior.mean + even, seeds, scale[None] * (size - 1 + prior.spread + even)[:, None, None], size - 1 + prior.spread + even, [])

    def summed(p: Posterior):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, bound = np.zeros((k, 1 + size + size * size)), 0.0
            for batch in batches:
                for at in range(0, len(batch), 4096):
                    part, whole = sums_of(np.stack(batch[column].iloc[at : at + 4096].to_numpy())[:, :size].astype(float), p, centre)
                    total, bound = total + part, bound + whole
            yield pd.DataFrame({"cell": np.arange(total.size + 1), "value": np.append(total.ravel(), bound)})

        flat = np.zeros(k * (1 + size + size * size) + 1)
        for r in real.select(column).mapInPandas(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("v")).collect():
            flat[r["cell"]] = r["v"]
        return flat[:-1].reshape(k, -1), float(flat[-1])

    p = begun
    for i in range(prior.rounds):
        sums, whole = summed(p)
        if i:  # the bound of a posterior that came from sums
            p.bound.append(whole - _divergence(p, prior, centre, scale))
            if len(p.bound) > 1 and p.bound[-1] - p.bound[-2] < prior.gain * n:
                break
        p = updated(sums, prior, centre, scale, p.bound)
    return p


def classified(rows: DataFrame, column: str, size: int, p: Posterior | None, prior: Prior = Prior()) -> DataFrame:
    """rows with class, from 1 among the classes that live (one at least), by falling weight, and share, that of the row in it. Null without a posterior or vector."""
    least = 2.0 * (size + 1) if prior.least is None else prior.least
    order = [] if p is None else np.argsort(-p.alpha, kind="stable").tolist()
    live = [c for i, c in enumerate(order) if not i or p.alpha[c] - prior.weight >= least]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame({"class": None, "share": None}, index=batch.index, dtype=object)
            known = batch[column].notna()
            if live and known.any():
                share, _ = p.shares(np.stack(batch[column][known].to_numpy())[:, :size].astype(float))
                own = share[:, live].argmax(1)
                out.loc[known] = np.column_stack([(own + 1).astype(object), share[np.arange(len(own)), np.array(live)[own]].astype(object)])
            yield pd.concat([batch, out], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, fields + ", class long, share double")
