"""Features and waveforms of clusters: moments, templates, quality, similarity and models.

Everything is grouped aggregation over (cluster, dimension) rows; pairs are formed between clusters only, whose
summaries are small, never between spikes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .curation import checkpoint_dir


def central_moments(x: str = "x") -> dict[str, Column]:
    """Mean, population deviation and excess kurtosis (0 where the deviation is)."""
    sd = F.stddev_pop(x)
    return {"mean": F.avg(x), "std": sd, "kurt": F.when(sd > 0, F.kurtosis(x)).otherwise(0.0)}


def centred(values: DataFrame, by: list[str]) -> DataFrame:
    """values with dx: what lies between x and the mean of its group."""
    return values.join(values.groupBy(*by).agg(F.avg("x").alias("_m")), by).withColumn("dx", F.col("x") - F.col("_m")).drop("_m")


def median_and_mad(values: DataFrame, by: list[str]) -> DataFrame:
    """by, med, mad: the median and 1.4826 times the median distance from it."""
    med = values.groupBy(*by).agg(F.percentile("x", F.lit(0.5)).alias("med"))
    off = values.join(med, by).groupBy(*by).agg(F.first("med").alias("med"), (F.percentile(F.abs(F.col("x") - F.col("med")), F.lit(0.5)) * 1.4826).alias("mad"))
    return off


def weighted_median(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """by, value: the first value whose cumulative weight reaches half of the total."""
    per = rows.groupBy(by, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(by)
    run = F.sum("_w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = per.withColumn("_ok", 2 * run >= F.sum("_w").over(w)).filter("_ok")
    return reached.groupBy(by).agg(F.min(value).alias(value))


def gini(rows: DataFrame, by: str, size: str) -> DataFrame:
    """by, n, gini of the sizes: sum of (2i - n - 1) x_i over n times the sum."""
    w = Window.partitionBy(by)
    i = F.row_number().over(w.orderBy(size))
    rows = rows.withColumn("_c", (2 * i - F.count("*").over(w) - 1) * F.col(size))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum("_c") / (F.count("*") * F.sum(size)), 6).alias("gini"), F.max(size).alias("largest"))


def covariances(rows: DataFrame, column: str) -> DataFrame:
    """cluster, i, j, n, cov of every pair i <= j of entries of an array column. Rows are taken from their cluster's mean; each task adds up products
    per cluster and Spark adds the tasks'."""
    mean = rows.select("cluster", F.posexplode(column).alias("d", "x")).groupBy("cluster", "d").agg(F.avg("x").alias("m"))
    mean = mean.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda p: p["m"]).alias("_m"))
    off = rows.join(mean, "cluster").select("cluster", F.zip_with(column, "_m", lambda x, m: x - m).alias("_x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        counts: Counter = Counter()
        for batch in batches:
            for c, part in batch.groupby("cluster")["_x"]:
                x = np.stack(part.to_numpy())
                sums[c] = sums.get(c, 0) + x.T @ x
                counts[c] += len(x)
        for c, m in sums.items():
            i, j = np.triu_indices(len(m))
            yield pd.DataFrame({"cluster": c, "i": i, "j": j, "n": counts[c], "s": m[i, j]})

    got = off.mapInPandas(run, "cluster long, i long, j long, n long, s double").groupBy("cluster", "i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return got.select("cluster", "i", "j", "n", (F.col("s") / (F.col("n") - 1)).alias("cov"))


def kth_smallest(rows: DataFrame, by: str, value: str, k: str, parts: int = 256) -> DataFrame:
    """by, value: of each group its k-th smallest value (k: a column, the same within a group; fewer values give no row).

    Quantiles cut a group's values into parts of about as many, the part with the k-th is found by counting, and only that part's values are counted one by one.
    """
    cuts = rows.groupBy(F.col(by).alias("_by")).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000).alias("_cuts"))
    a = rows.select(F.col(by).alias("_g"), F.col(value).alias("_v"), F.col(k).alias("_want")).join(cuts, F.col("_g").eqNullSafe(F.col("_by")))
    a = a.select("_g", "_v", "_want", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_part"))
    upto = F.sum("_n").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = a.groupBy("_g", "_part").agg(F.count("*").alias("_n"), F.first("_want").alias("_want")).withColumn("_upto", upto).filter("_upto >= _want AND _upto - _n < _want")
    hit = hit.select(F.col("_g").alias("_hg"), F.col("_part").alias("_hp"), (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_left"))
    own = a.join(hit, F.col("_g").eqNullSafe(F.col("_hg")) & (F.col("_part") == F.col("_hp"))).groupBy("_g", "_left", "_v").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_g").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return own.withColumn("_upto", upto).filter("_upto >= _left AND _upto - _n < _left").select(F.col("_g").alias(by), F.col("_v").alias(value))


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with name: their place in the whole order, from 0. Range partitions are counted, then numbered one by one with what lies before them."""
    checkpoint_dir(rows.sparkSession)
    a = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).checkpoint()
    each = a.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")  # a row per partition
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return a.withColumn("_i", own).join(each.select("_p", before.alias("_b")), "_p").withColumn(name, F.col("_i") + F.col("_b") - 1).drop("_p", "_i", "_b")


def vote(queries: DataFrame, pool: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """spike_id, cluster, winner, votes: the cluster most frequent among each query's k nearest rows of the whole pool, ties to the smaller id.

    The pool is cut into blocks of about so many rows; every block gives its k nearest to each block of queries as one matrix product, and those are merged. Distances
    are squares of whole numbers, ties to the smaller spike_id. Without a pool no rows.
    """
    spread = lambda rows, n: F.pmod(F.xxhash64("spike_id"), F.lit(n)).cast("int")
    many = [max(1, -(-rows.count() // block)) for rows in (queries, pool)]
    fields = ["spike_id", "cluster", "fet"]
    left = queries.select(*fields).withColumn("q", spread(queries, many[0])).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(many[1] - 1))))
    right = pool.select(*fields).withColumn("p", spread(pool, many[1])).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(many[0] - 1))))

    def near(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["spike_id", "cluster", "far", "other", "ref"])
        b = b.sort_values("spike_id")
        x, y = (np.stack(t["fet"].to_numpy()).astype(float) for t in (a, b))
        far = np.rint((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)).astype(np.int64)
        at = np.argsort(far, axis=1, kind="stable")[:, :k]
        n = at.shape[1]
        found = {"spike_id": np.repeat(a["spike_id"].to_numpy(), n), "cluster": np.repeat(a["cluster"].to_numpy(), n), "far": np.take_along_axis(far, at, 1).ravel()}
        return pd.DataFrame(found | {"other": b["spike_id"].to_numpy()[at].ravel(), "ref": b["cluster"].to_numpy()[at].ravel()})

    found = left.groupBy("q", "p").cogroup(right.groupBy("q", "p")).applyInPandas(near, "spike_id long, cluster long, far long, other long, ref long")
    w = Window.partitionBy("spike_id").orderBy("far", "other")
    votes = found.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= k).groupBy("spike_id", "cluster", "ref").agg(F.count("*").alias("n"))
    best = votes.groupBy("spike_id", "cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "ref")).alias("b"))
    return best.select("spike_id", "cluster", F.col("b.ref").alias("winner"), (-F.col("b.n")).alias("votes"))
