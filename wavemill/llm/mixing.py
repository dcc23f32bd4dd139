"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

DataFrame and SQL functions only. Sources get targets by weight, targets become whole blocks by
highest quotients, a source's blocks are dealt to its shards in the same way, and in each shard
the documents, laid end to end in a seeded order, give a run of blocks from a seeded start. What
a document contributes is the overlap of its place with that run, in closed form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, n_words


@dataclass(frozen=True)
class Mix:
    """weights: by turns over the sources in code-point order, null last. total: of all sizes, what the mix takes.
    most: of its source's size, what a target may be. block: words. shard_docs: least number of documents dealt to
    one shard; the square root of the source's documents where that is more, so shards and their contents grow alike."""

    weights: tuple[int, ...] = (5, 2, 1)
    total: float = 1.5
    most: float = 2.0
    block: int = 16
    shard_docs: int = 500
    seed: int = 17


def apportion(df: DataFrame, over: list[str], votes: str, seats: str, key: str) -> DataFrame:
    """df with `won`: each group of `over` gives its `seats` to its rows by the highest quotients votes / (2k + 1).

    Each row first gets the seats that rounding its exact share gives, which is what the quotients above
    that divisor come to; the few seats over or missing go by the highest or lowest quotients
    at the border, ties to the smaller `key`. Votes that are all 0 win nothing.
    """
    group = Window.partitionBy(*over) if over else Window.partitionBy(F.lit(0))
    total = F.sum(votes).over(group)
    a = df.withColumn("_q", F.when(total > 0, F.col(seats) * F.col(votes) / total).otherwise(0.0))
    a = a.withColumn("won", F.floor(F.col("_q") + 0.5).cast("long"))
    a = a.withColumn("_gap", F.when(total > 0, F.col(seats) - F.sum("won").over(group)).otherwise(0).cast("long"))
    # the quotients at the border: the next |_gap| seats a row could win, or the last it could lose
    steps = F.when(F.col("_gap") > 0, F.sequence(F.lit(0).cast("long"), F.col("_gap") - 1))
    steps = steps.when(F.col("_gap") < 0, F.sequence(F.lit(-1).cast("long"), F.greatest(F.col("_gap"), -F.col("won")), F.lit(-1).cast("long")))
    border = a.filter("_gap <> 0 and (_gap > 0 or won > 0)").withColumn("_k", F.explode(steps))
    quotient = F.col(votes) / (2 * (F.col("won") + F.col("_k")) + 1)
    border = border.withColumn("_r", F.row_number().over(group.orderBy(F.when(F.col("_gap") > 0, -quotient).otherwise(quotient), key, F.abs("_k"))))
    change = border.filter(F.col("_r") <= F.abs("_gap")).groupBy(*over, key).agg(F.sum(F.signum("_gap")).cast("long").alias("_change"))
    return a.join(change, [*over, key], "left").withColumn("won", F.col("won") + F.coalesce("_change", F.lit(0))).drop("_q", "_gap", "_change")


def targets(sources: DataFrame, how: Mix = Mix()) -> DataFrame:
    """sources(source, source_size, ...) with _id (place in code-point order, null last), target and blocks.

    Filling by weight until no target is above its cap: sources in the order of cap / weight fill up one
    after another, so the level is that at which the rest, shared by weight, keeps below the next cap.
    A table of one row per source; it is the only one that is ordered as a whole.
    """
    everything = Window.partitionBy(F.lit(0))
    a = sources.withColumn("_id", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    a = a.withColumn("_weight", F.element_at(F.array(*map(F.lit, how.weights)), (F.pmod(F.col("_id") - 1, F.lit(len(how.weights))) + 1).cast("int")))
    a = a.withColumn("_cap", how.most * F.col("source_size")).withColumn("_all", how.total * F.sum("source_size").over(everything))
    rising = everything.orderBy(F.col("_cap") / F.col("_weight"), "_id")
    before, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(onward)
    a = a.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("_weight") <= F.col("_cap"))
    a = a.withColumn("_level", F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    a = a.withColumn("target", F.least("_cap", F.coalesce(F.col("_level") * F.col("_weight"), "_cap")))
    a = a.withColumn("_seats", F.round(F.sum("target").over(everything) / how.block).cast("long"))
    return apportion(a.withColumn("_one", F.lit(0)), ["_one"], "target", "_seats", "_id").withColumnRenamed("won", "blocks").select(*sources.columns, "_id", "target", "blocks")


def _covered(x: Column, start: Column, run: Column, size: Column) -> Column:
    """How many words of [0, x) a run of `run` words from `start` takes on a circle of `size` words, laps counted."""
    over = start + run - size
    inside = F.greatest(F.lit(0), F.least(x, start + run) - start)
    return F.when(over <= 0, inside).otherwise(F.greatest(F.lit(0), x - start) + F.least(x, over))


def row_key(how: Mix = Mix()) -> Column:
    """A hash of doc_id and text, which rows that repeat both share."""
    return F.xxhash64(F.lit(how.seed), "doc_id", "text")


def mix(ws: Workspace, docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) and row_key of every document.

    Null texts have size 0 and are taken 0 times; a null source is a source of its own; repeated doc_ids are
    documents of their own. Columns of docs other than doc_id, text and source are ignored. Empty: no rows.
    The same rows give the same mix, in whatever order or partitions they come.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_key(how).alias("_dice"))
    sized = ws.save(sized, "sized")
    sources = ws.save(targets(ws.save(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs")), "sources"), how), "targets")
    shards = F.ceil(F.col("_docs") / F.greatest(F.lit(how.shard_docs), F.sqrt("_docs"))).cast("long")
    dealt = sized.join(sources.withColumn("_shards", shards), sized.source.eqNullSafe(sources.source)).drop(sources.source)
    dealt = ws.save(dealt.withColumn("_shard", F.pmod("_dice", "_shards")), "dealt")
    per = dealt.groupBy("_id", "_shard").agg(F.sum("size").alias("_words"), F.first("blocks").alias("blocks"))
    per = apportion(per, ["_id"], "_words", "blocks", "_shard")
    # a shard gives each of its words twice at most; the start is at one of its blocks
    run = F.least(F.col("won") * how.block, (F.col("_words") * how.most).cast("long"))
    blocks = F.greatest(F.lit(1), F.floor(F.col("_words") / how.block))
    start = F.pmod(F.xxhash64(F.lit(how.seed), "_id", "_shard"), blocks) * how.block
    per = ws.save(per.select("_id", "_shard", "_words", run.alias("_run"), start.alias("_start")), "shards")
    lines = Window.partitionBy("_id", "_shard").orderBy(F.xxhash64("_dice"), "_dice", "doc_id", "size")
    end = F.sum("size").over(lines.rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("_end", end).join(per, ["_id", "_shard"])
    n = F.col("_words")
    laps, rest = F.floor(F.col("_run") / n), F.pmod("_run", n)
    share = laps * F.col("size") + _covered(F.col("_end"), F.col("_start"), rest, n) - _covered(F.col("_end") - F.col("size"), F.col("_start"), rest, n)
    taken = F.when(n > 0, share).otherwise(0).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.col("_dice").alias("row_key"))


def times(mixed: DataFrame) -> DataFrame:
    """row_key, source and times of the rows of mix() that are taken: how often a whole document comes, rounded half up, by the average over rows
    that repeat it."""
    n = F.when(F.sum("size") > 0, F.floor(F.sum("taken") / F.sum("size") + 0.5)).otherwise(0).cast("int")
    return mixed.groupBy("row_key", "source").agg(n.alias("times")).filter("times > 0")
