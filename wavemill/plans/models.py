"""Queries that iterate: principal components and mixtures. SQL can't express them; tests hold them against numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import splits as S
from ..sources.adapters import CHANNELS, SAMPLES, features, traces, waveform_values
from .registry import query

SIZE = 64


@query()
def principal_components(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every spike on the first three components of all its features."""
    f = features(spark, d)
    mean, _, vectors = M.components(f, "fet", SIZE, 3)
    return M.project(f, "fet", mean, vectors).select("spike_id", "cluster", *[F.round(F.get("scores", i), 4).alias(f"pc{i + 1}") for i in range(3)])


@query()
def mixture_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classification EM with ten classes on all features."""
    f = features(spark, d)
    return M.assign(f, "fet", M.fit(f, "fet", SIZE, 10)).select("spike_id", "cluster", F.col("class").cast("long").alias("class"), F.round("cost", 4).alias("cost"))


@query()
def whitened_channels(spark: SparkSession, d: str) -> DataFrame:
    """Channels without correlation between them (ZCA): the covariance is a sum over samples, the 4 x 4 root is taken on the driver."""
    t = traces(spark, d)
    _, mean, cov = M.gram(t, "xs", 4)
    value, vector = np.linalg.eigh(cov)
    white = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-9))) @ vector.T
    return M.project(t, "xs", mean, white).select("session", "sample", *[F.round(F.get("scores", i), 6).alias(f"w{i}") for i in range(4)])


def _scores(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d)
    mean, _, vectors = M.components(f, "fet", SIZE, 3)
    return M.project(f, "fet", mean, vectors)


@query()
def covariance_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classification EM with six classes of full covariance on the first three components."""
    f = _scores(spark, d).select("spike_id", "cluster", "scores")
    return M.assign(f, "scores", M.fit(f, "scores", 3, 6, full=True)).select("spike_id", "cluster", F.col("class").cast("long").alias("class"), F.round("cost", 4).alias("cost"))


@query()
def density_basins(spark: SparkSession, d: str) -> DataFrame:
    """Each unit split along the valleys of its density over the first two components."""
    points = _scores(spark, d).select("spike_id", "cluster", F.get("scores", 0).alias("x"), F.get("scores", 1).alias("y"))
    return S.watershed(points).select("spike_id", "cluster", "part")


@query()
def two_component_units(spark: SparkSession, d: str) -> DataFrame:
    """Whether two Gaussians tell a unit's spikes apart along the first component: by information criterion and Ashman's distance."""
    g = S.two_gaussians(_scores(spark, d).select("cluster", F.get("scores", 0).alias("x")))
    apart = (F.col("bic2") < F.col("bic1")) & (F.col("ashman") >= 2)
    return g.select("cluster", "n", *[F.round(c, 4).alias(c) for c in ("mean0", "mean1", "std0", "std1", "bic1", "bic2", "ashman")], F.coalesce(apart, F.lit(False)).alias("split"))


@query()
def spike_places(spark: SparkSession, d: str) -> DataFrame:
    """Where a point source would lie for each spike, by its swings on two staggered columns of sites."""
    p = waveform_values(spark, d).groupBy("spike_id", "ch").agg((F.max("x") - F.min("x")).cast("double").alias("p"))
    p = p.groupBy("spike_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "p"))), lambda r: r["p"]).alias("swings"))
    sites = np.array([[20.0 * (c % 2), 20.0 * c] for c in range(CHANNELS)])
    return S.localised(p, "swings", sites).select("spike_id", *[F.round(f"place.{c}", 2).alias(c) for c in "xyz"], F.round("amplitude", 1).alias("amplitude"), F.round("rms", 4).alias("rms"))


@query()
def collision_parts(spark: SparkSession, d: str) -> DataFrame:
    """Each spike as one unit's mean waveform or as two of them, moved and scaled: the units, and the share of the energy that is left."""
    f = features(spark, d)
    means = f.select("cluster", F.posexplode("fet").alias("d", "x")).groupBy("cluster", "d").agg(F.avg("x").alias("m")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda r: r["m"]).alias("m"))
    templates = {r["cluster"]: np.array(r["m"]).reshape(SAMPLES, CHANNELS) for r in means.collect()}  # a row per unit
    two = S.two_units(f.select("spike_id", "cluster", "fet"), "fet", templates)
    return two.select("spike_id", "cluster", F.col("alone.unit").alias("unit"), F.round("alone.left", 4).alias("alone_left"), F.col("together.unit_a").alias("unit_a"), F.col("together.unit_b").alias("unit_b"), F.round("together.left", 4).alias("both_left"))


@query()
def rotated_components(spark: SparkSession, d: str) -> DataFrame:
    """Scores on the first three components after a varimax turn, fitted without the noise units 0 and 1."""
    f = features(spark, d)
    mean, _, vectors = M.components(f.filter("cluster > 1"), "fet", SIZE, 3)
    return M.project(f, "fet", mean, M.varimax(vectors)).select("spike_id", "cluster", *[F.round(F.get("scores", i), 4).alias(f"rc{i + 1}") for i in range(3)])
