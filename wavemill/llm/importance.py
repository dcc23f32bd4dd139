"""Quality classifier by importance resampling of hashed n-gram models.

Two bags of hashed one- and two-word grams are counted, one over the target texts and one over all texts. A document's log weight is
the sum of its grams' log ratios; documents are drawn without replacement in proportion to their weights by adding seeded
Gumbel noise to the log weights and taking the highest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U, WordHashes, Workspace, mixed


@dataclass(frozen=True)
class Resampling:
    """buckets: of the hashed grams. target_rows: labelled rows of the target that are counted, those with the smallest hashes of their
    doc_id. share: of all documents, what is drawn. temperature: the noise's scale. smoothing: added to each count. per_gram: draw by
    the mean over a document's grams in place of their sum, which long documents have larger either way; its noise wants a lower temperature."""

    buckets: int = 20_000
    target_rows: int = 20_000
    share: float = 0.85
    temperature: float = 1.0
    smoothing: float = 1.0
    per_gram: bool = False
    seed: int = 23


def grams(text: str | None, hashes: WordHashes, how: Resampling) -> np.ndarray:
    """The buckets of a whole text's words and pairs of words."""
    h = hashes.of(text)
    two = mixed(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:])
    return (np.concatenate([h, two]) % U(how.buckets)).astype(np.int64)


def log_ratios(docs: DataFrame, target: Column, how: Resampling) -> np.ndarray:
    """log p(gram | target) - log p(gram | all) of each bucket. Each task adds up its texts; only sums per bucket are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, counts = WordHashes(), np.zeros((2, how.buckets), np.int64)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                own = [grams(t, hashes, how) for t in part["text"]]
                for row, found in ((0, own), (1, [g for g, is_target in zip(own, part["target"], strict=True) if is_target])):
                    counts[row] += np.bincount(np.concatenate([np.zeros(0, np.int64), *found]), minlength=how.buckets)
        yield pd.DataFrame({"bucket": np.arange(how.buckets), "raw": counts[0], "target": counts[1]})

    sums = docs.select("text", target.alias("target")).mapInPandas(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    out = np.full((2, how.buckets), how.smoothing)
    out[0, sums["bucket"]] += sums["raw"]
    out[1, sums["bucket"]] += sums["target"]
    return np.log(out[1] / out[1].sum()) - np.log(out[0] / out[0].sum())


def _border(scored: DataFrame, k: int) -> tuple[float, int]:
    """(a key, how many rows with just that key or less are still to be drawn): all rows above the key are among the k highest.

    Quantiles close in on the k-th key; only they and counts reach the driver.
    """
    low, high, want = float("-inf"), float("inf"), k
    while True:
        inside = scored.filter((F.col("key") > low) & (F.col("key") <= high))
        cuts = sorted(set(inside.agg(F.percentile_approx("key", [i / 64 for i in range(1, 65)], 1000)).first()[0] or []))
        if len(cuts) <= 1:
            return (cuts[0] if cuts else low), want
        counts = inside.agg(*[F.count_if(F.col("key") > c) for c in cuts]).first()
        # the lowest cut above which no more than the wanted rows lie
        at = next(i for i, n in enumerate(counts) if n <= want)
        high, want = cuts[at], want - counts[at]
        low = cuts[at - 1] if at else low
        if want == 0:
            return high, 0


def resample(ws: Workspace, docs: DataFrame, labels: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_grams, log_weight, key and kept of every row of docs(doc_id, text); other columns are ignored.

    The target are documents labelled quality 1 and toxic 0. Null and empty texts weigh nothing (log weight 0). A share of
    the rows, rounded up, is kept: those with the highest keys, ties by the smallest doc_id; the same rows give the same draw. Without labels of
    the target all weights are alike. Repeated rows share a key; null doc_ids come after others in ties. Empty: no rows.
    """
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    good = good.orderBy(F.xxhash64("_id"), "_id").limit(how.target_rows)  # the bound on what is broadcast
    marked = docs.select("doc_id", "text").join(F.broadcast(good), F.col("doc_id") == F.col("_id"), "left")
    ratios = log_ratios(marked, F.col("_id").isNotNull(), how)
    if good.isEmpty():
        ratios = np.zeros_like(ratios)
    sent = ws.spark.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            own = [grams(t, hashes, how) for t in batch.pop("text")]
            yield batch.assign(n_grams=[len(g) for g in own], log_weight=[float(sent.value[g].sum()) for g in own])

    rows = docs.select(F.col("doc_id").cast("string").alias("d"), "text").mapInPandas(run, "d string, n_grams long, log_weight double")
    dice = (F.pmod(F.xxhash64(F.lit(how.seed), "d"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weight = F.col("log_weight") / F.greatest("n_grams", F.lit(1)) if how.per_gram else F.col("log_weight")
    key = weight - how.temperature * F.log(-F.log(dice))
    scored = ws.save(rows.select(F.col("d").cast("long").alias("doc_id"), "n_grams", "log_weight", key.alias("key")), "scored")
    n = scored.count()
    border, want = _border(scored, ceil(how.share * n)) if n else (0.0, 0)
    # rows just at the border, repeated ones as a number: as many as are wanted, by doc_id
    same = scored.filter(F.col("key") == border).groupBy("doc_id", "n_grams", "log_weight", "key").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("key").orderBy(F.col("doc_id").asc_nulls_last(), "n_grams", "log_weight").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = same.withColumn("_before", upto - F.col("_n")).withColumn("_at", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).withColumn("kept", F.col("_before") + F.col("_at") <= want)
    rest = scored.filter(F.col("key") != border).withColumn("kept", F.col("key") > border)
    return rest.unionByName(last.select(*rest.columns))
