"""How fast a unit's waveform recovers: of several parts used and time constants those under which its spikes' depression explains their waveforms best.

One pass gives every spike what it lacks under each candidate; a second adds up products of these with each other and with the waveforms, by unit. All pairs of a fast and a slow candidate are
then small linear systems of each unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timing import depression

Candidates = list[tuple[float, float]]


def best_pair(gram: np.ndarray, cross: np.ndarray, square: float, fast: int, slow: int) -> tuple[int, int, float]:
    """The fast and slow candidate that leave least of the waveforms' squares, and what they leave. gram: products of 1 and all that is lacked; cross: with the values; the first of equal ones."""
    best = (np.inf, 0, 0)
    for i in range(fast):
        for j in range(slow):
            at = [0, 1 + i, 1 + fast + j]
            a, b = gram[np.ix_(at, at)], cross[at]
            # what does not vary or varies with another explains no more than that
            best = min(best, (float(square - (b * (np.linalg.pinv(a, rcond=1e-10) @ b)).sum()), i, j))
    return best[1], best[2], max(best[0], 0.0)


def fitted(spikes: DataFrame, column: str, size: int, fast: Candidates, slow: Candidates, width: int = 86_400) -> DataFrame:
    """cluster, n, fast_use, fast_time, slow_use, slow_time and left: the best candidates of each unit of spikes(spike_id, cluster, t, column), and the share of the values' variance that
    they leave (null where there is none).

    Rows with a null cluster, t or vector are left out. A unit of one spike takes the first candidates.
    """
    real = spikes.filter(F.col("cluster").isNotNull() & F.col("t").isNotNull() & F.col(column).isNotNull())
    names = [f"_f{i}" for i in range(len(fast))] + [f"_s{j}" for j in range(len(slow))]
    lacks = depression(real, dict(zip(names, [*fast, *slow], strict=True)), width).select(F.col("spike_id").alias("_id"), *names)
    rows = real.join(lacks, F.col("spike_id") == F.col("_id")).select("cluster", column, *names)
    k = 1 + len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, part in batch.groupby("cluster"):
                x = np.stack(part[column].to_numpy())[:, :size].astype(float)
                z = np.hstack([np.ones((len(part), 1)), 1 - part[names].to_numpy(float)])
                sums[c] = sums.get(c, 0) + np.concatenate([(z.T @ z).ravel(), (z.T @ x).ravel(), (x * x).sum(0)])
        for c, s in sums.items():
            yield pd.DataFrame({"cluster": c, "cell": np.arange(len(s)), "value": s})

    added: dict[int, np.ndarray] = {}
    for r in rows.mapInPandas(run, "cluster long, cell long, value double").groupBy("cluster", "cell").agg(F.sum("value").alias("v")).collect():  # candidates by candidates and values, for each unit
        added.setdefault(r["cluster"], np.zeros(k * k + k * size + size))[r["cell"]] = r["v"]
    out = []
    for c, s in sorted(added.items()):
        gram, cross, square = s[: k * k].reshape(k, k), s[k * k : k * k + k * size].reshape(k, size), s[k * k + k * size :]
        n = gram[0, 0]
        i, j, rest = best_pair(gram, cross, float(square.sum()), len(fast), len(slow))
        spread = float((square - cross[0] ** 2 / n).sum())
        out.append((c, int(n), *map(float, fast[i]), *map(float, slow[j]), rest / spread if spread > 1e-9 * max(1.0, float(square.sum())) else None))
    return spikes.sparkSession.createDataFrame(out, "cluster long, n long, fast_use double, fast_time double, slow_use double, slow_time double, left double")
