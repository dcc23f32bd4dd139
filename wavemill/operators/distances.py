"""Spikes against unit models, as matrix products over Arrow batches: nothing is exploded by dimension, and no table of spikes by models is shuffled.

A model is a mean and a variance for each dimension. What leaves a batch is a row for each spike, or sums or counts for each unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Models:
    """Units with their numbers of spikes, means and variances (units x dimensions)."""

    names: np.ndarray
    count: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def __post_init__(self) -> None:
        # distances are products of x, x^2 and the model; taken from the middle of all means so that large values cancel little
        self.middle = self.mean.mean(0) if len(self.mean) else self.mean.sum(0)
        mean, rate = self.mean - self.middle, 1 / self.var
        self.held = (rate.T, (2 * mean * rate).T, (mean * mean * rate).sum(1))

    def squares(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of rows by models."""
        x = x - self.middle
        rate, line, rest = self.held
        return np.maximum((x * x) @ rate - x @ line + rest, 0)


def models(values: DataFrame, centre: Column, var: Column) -> Models:
    """From values(cluster, d, x), by two aggregates. A number for each unit and dimension reaches the driver."""
    rows = values.groupBy("cluster", "d").agg(centre.alias("m"), var.alias("v"), F.count("*").alias("n")).toPandas()
    names = np.sort(rows["cluster"].unique())
    i, j = np.searchsorted(names, rows["cluster"]), rows["d"].to_numpy(int)
    out = np.zeros((3, len(names), j.max() + 1 if len(j) else 0))
    out[:, i, j] = rows[["m", "v", "n"]].to_numpy(float).T
    return Models(names, out[2].max(1).astype(int) if len(names) else np.zeros(0, int), out[0], out[1])


def _parts(batches: Iterator[pd.DataFrame], column: str, wide: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches cut so that a table of their rows by models stays small."""
    for batch in batches:
        each = max(1, 4_000_000 // max(1, wide))
        for at in range(0, len(batch), each):
            part = batch.iloc[at : at + each]
            yield part, np.stack(part[column].to_numpy()).astype(float)


def nearest(rows: DataFrame, column: str, held: Models) -> DataFrame:
    """spike_id, cluster, nearest and cost of rows: the unit of the smallest squared distance, ties to the smaller id. Without units no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in _parts(batches, column, len(held.names)):
            if len(held.names):
                far = held.squares(x)
                yield part[["spike_id", "cluster"]].assign(nearest=held.names[far.argmin(1)], cost=far.min(1))

    return rows.select("spike_id", "cluster", column).mapInPandas(run, "spike_id long, cluster long, nearest long, cost double")


def posteriors(rows: DataFrame, column: str, held: Models) -> DataFrame:
    """a, b, error: the mean posterior of unit a's spikes under model b, all models weighing alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for part, x in _parts(batches, column, len(held.names)):
            z = -0.5 * (held.squares(x) + np.log(held.var).sum(1))
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            own = part["cluster"].to_numpy()
            for c in np.unique(own):
                sums[c] = sums.get(c, 0) + np.append(p[own == c].sum(0), (own == c).sum())
        for c, s in sums.items():
            yield pd.DataFrame({"a": c, "b": held.names, "s": s[:-1], "n": int(s[-1])})

    added = rows.select("cluster", column).mapInPandas(run, "a long, b long, s double, n long").groupBy("a", "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return added.select("a", "b", (F.col("s") / F.col("n")).alias("error"))


def tails(rows: DataFrame, column: str, held: Models) -> DataFrame:
    """m, total: over rows of other units, how likely they are at their squared distance from unit m or farther (chi-square, an even number of dimensions)."""
    half = held.mean.shape[1] // 2
    if held.mean.shape[1] % 2:
        raise ValueError("an even number of dimensions")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(held.names))
        for part, x in _parts(batches, column, len(held.names)):
            h = held.squares(x) / 2
            with np.errstate(divide="ignore", invalid="ignore"):
                log = np.log(h)
                p = sum(np.exp((i * log if i else 0) - h - lgamma(i + 1)) for i in range(half))
            total += np.where(part["cluster"].to_numpy()[:, None] == held.names, 0, p).sum(0)
        yield pd.DataFrame({"m": held.names, "p": total})

    return rows.select("cluster", column).mapInPandas(run, "m long, p double").groupBy("m").agg(F.sum("p").alias("total"))


def kth_distances(rows: DataFrame, column: str, held: Models, k: np.ndarray, least: int = 100_000) -> dict[int, float]:
    """Unit -> the k-th smallest squared distance (k by unit) of other units' rows; units with fewer such rows have none.

    Numbers not below 0 are in the order of their bits. A pass counts the first bits of all distances, which says which bits the k-th begins with, and the next pass looks at the
    following bits of those alone, until few are left; these are counted value by value.
    """

    def counted(prefix: dict[int, int], done: int, bits: int):
        """Counts of the next bits, of distances whose first bits are the unit's prefix."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, pd.Series] = {}
            for part, x in _parts(batches, column, len(held.names)):
                code = held.squares(x).view(np.int64)
                other = part["cluster"].to_numpy()[:, None] != held.names
                for j, name in enumerate(held.names):
                    if name in prefix:
                        own = code[other[:, j], j]
                        own = own[own >> (64 - done) == prefix[name]] if done else own
                        if len(own):
                            cell, n = np.unique(own >> (64 - done - bits), return_counts=True)
                            found = pd.Series(n, cell)
                            sums[name] = sums[name].add(found, fill_value=0) if name in sums else found
            for name, n in sums.items():
                yield pd.DataFrame({"m": name, "cell": n.index.to_numpy(np.int64), "n": n.to_numpy(np.int64)})

        return rows.select("cluster", column).mapInPandas(run, "m long, cell long, n long").groupBy("m", "cell").agg(F.sum("n").alias("n")).toPandas()

    want = {int(m): int(n) for m, n in zip(held.names, k, strict=True) if n > 0}
    prefix, done, out = dict.fromkeys(want, 0), 0, {}
    while prefix:
        bits = 20 if done == 0 else min(16, 64 - done)
        inside = 0
        cells = counted(prefix, done, bits)
        for m, own in cells.sort_values("cell").groupby("m"):
            upto = own["n"].cumsum()
            if upto.iloc[-1] < want[m]:
                prefix.pop(m)
                continue
            at = int((upto >= want[m]).to_numpy().argmax())
            prefix[m] = int(own["cell"].iloc[at])
            want[m] -= int(upto.iloc[at] - own["n"].iloc[at])
            inside += int(own["n"].iloc[at])
        for m in set(prefix) - set(cells["m"]):
            prefix.pop(m)
        done += bits
        if done < 64 and inside <= least:  # what is left is counted by all its bits
            cells = counted(prefix, done, 64 - done)
            for m, own in cells.sort_values("cell").groupby("m"):
                at = int((own["n"].cumsum() >= want[m]).to_numpy().argmax())
                prefix[m] = int(own["cell"].iloc[at])
            done = 64
        if done == 64:
            out = {m: float(np.array(c, np.int64).view(float)) for m, c in prefix.items()}
            break
    return out
