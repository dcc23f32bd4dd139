"""Approximate nearest neighbours by collision counting over single projections.

Rows are dealt into blocks. Each block keeps, for each random projection, its values in sorted order. A query's window in each of
them starts narrow around the query's own value and widens as the radius is raised (virtual rehashing: no table is
built again). Rows in enough of the windows are verified on the original vectors, and a query is done with a
block once its k-th distance there is within the radius. All rows are indexed, once; all queries visit all blocks and
the best of each block are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace


@dataclass(frozen=True)
class Collisions:
    """projections arrays; a row in a share `threshold` of the windows is verified. width: of a half window, in radii.
    step: from one radius to the next. block: rows of one block, about."""

    k: int = 10
    projections: int = 128
    threshold: float = 0.785
    width: float = 1.36
    step: float = 1.1
    block: int = 8192
    seed: int = 11


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part: no null, zero, null component or one that is not finite."""
    v = F.col("embedding").cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(fine).select(F.col("vec_id").cast("long"), v.alias("vector"))


def directions(size: int, how: Collisions) -> np.ndarray:
    """Random projections in orthogonal sets, whose values scatter less about a distance than those of independent ones."""
    rng = np.random.default_rng([how.seed, size])
    sets = []
    while sum(a.shape[1] for a in sets) < how.projections:
        sets.append(np.linalg.qr(rng.standard_normal((size, min(size, how.projections))))[0] * np.sqrt(size))
    return np.hstack(sets)[:, : how.projections]


class Block:
    """The sorted projections of some rows of one length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, how: Collisions):
        self.ids, self.x, self.how = ids, x, how
        self.a = directions(x.shape[1], how)
        p = (x @ self.a).T
        order = p.argsort(1, kind="stable")
        values = np.take_along_axis(p, order, 1)
        # one sorted array of all projections, each moved beyond the one before
        self.shift = np.concatenate([[0.0], np.cumsum(values[:-1, -1] - values[1:, 0] + 1.0)]) if len(values) > 1 else np.zeros(1)
        self.order, self.values = order.ravel(), (values + self.shift[:, None]).ravel()
        self.first = np.arange(how.projections) * len(x)
        self.some = x[np.linspace(0, len(x) - 1, min(len(x), 64)).astype(int)]
        self.need = int(np.ceil(how.threshold * how.projections))

    def nearest(self, q_id: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and distances of the k nearest found to q, by distance and id, and how many rows were verified. Rows of q's own id are left out."""
        n, how = len(self.x), self.how
        others = self.ids != q_id
        hits, seen = np.zeros(n, np.int64), ~others
        ids, far, verified = np.zeros(0, np.int64), np.zeros(0), 0
        pq = q @ self.a
        low = self.first + n // 2
        high = low.copy()
        sample = np.sqrt(((self.some - q) ** 2).sum(1))
        radius = 0.7 * sample[sample > 0].min(initial=np.inf)
        if not np.isfinite(radius):
            radius = 1.0
        begun = False
        while True:
            # in a block of few others all of them are wanted
            reach = np.inf if others.sum() <= how.k else how.width * radius * (1 + 1e-12)
            lo = np.clip(np.searchsorted(self.values, pq - reach + self.shift), self.first, self.first + n)
            hi = np.clip(np.searchsorted(self.values, pq + reach + self.shift, "right"), self.first, self.first + n)
            if begun:
                parts = [self.order[a:b] for a, b in zip(lo, low, strict=True)] + [self.order[a:b] for a, b in zip(high, hi, strict=True)]
            else:
                parts = [self.order[a:b] for a, b in zip(lo, hi, strict=True)]
            low, high, begun = lo, hi, True
            hits += np.bincount(np.concatenate(parts), minlength=n)
            found = np.flatnonzero((hits >= self.need) & ~seen)
            if len(found):
                seen[found] = True
                verified += len(found)
                ids, far = np.concatenate([ids, self.ids[found]]), np.concatenate([far, np.sqrt(((self.x[found] - q) ** 2).sum(1))])
                order = np.lexsort((ids, far))
                order = order[np.sort(np.unique(ids[order], return_index=True)[1])][: how.k]  # an id counts once, with its nearest row
                ids, far = ids[order], far[order]
            worst = far[-1] if len(far) == how.k else np.inf
            if worst <= radius or seen.all():
                return ids, far, verified
            radius = min(radius * how.step, worst)


def _search(how: Collisions):
    """The nearest of each query among the rows of its block: rows come before queries in each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, rows, index = None, [], {}
        for batch in batches:
            out = []
            for b, part in batch.groupby("block", sort=False):
                if b != block:
                    block, rows, index = b, [], {}
                asks = part["asks"].to_numpy()
                if not asks.all():
                    rows.append(part[~asks])
                if not asks.any():
                    continue
                if rows:
                    held, rows = pd.concat(rows), []
                    sizes = held["vector"].map(len).to_numpy()
                    index = {d: Block(held["vec_id"].to_numpy()[sizes == d], np.stack(held["vector"].to_numpy()[sizes == d]), how) for d in np.unique(sizes)}
                for q_id, q in zip(part["vec_id"][asks], part["vector"][asks], strict=True):
                    if len(q) in index:
                        ids, far, verified = index[len(q)].nearest(q_id, np.asarray(q))
                        out += [(q_id, i, s, verified) for i, s in zip(ids, far, strict=True)]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score", "verified"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "verified": "int64"})

    return run


def candidates(ws: Workspace, rows: DataFrame, is_query, how: Collisions = Collisions()) -> DataFrame:
    """query_id, vec_id, score and verified (rows that were compared in the block) of the k nearest of each query in each block."""
    vectors = ws.save(usable(rows).dropDuplicates(), "vectors")
    blocks = max(1, -(-vectors.count() // how.block))
    mark = lambda df, asks: df.select("block", F.lit(asks).alias("asks"), "vec_id", "vector")
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int"))
    queries = vectors.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = mark(dealt, False).unionByName(mark(asked, True)).repartitionById(blocks, "block").sortWithinPartitions("block", "asks")
    return both.mapInPandas(_search(how), "query_id long, vec_id long, score double, verified long")


def nearest(ws: Workspace, rows: DataFrame, is_query, how: Collisions = Collisions()) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest rows found for every query, by distance and then vec_id.

    rows(vec_id, embedding); is_query: a condition on vec_id. Rows with unusable vectors or no vec_id take no part; a vector
    is compared with those of its own length; other columns are ignored. Repeated rows count once; of rows that share a vec_id and
    differ, the nearest is that id's, and a query under such an id has the smallest of its vectors; rows of a query's own id
    are not its neighbours. Of copies those with the smallest vec_ids come first. No queries or no candidates: no rows.
    """
    found = candidates(ws, rows, is_query, how).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= how.k).select("query_id", "rank", "vec_id", "score")
