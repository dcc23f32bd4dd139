"""Label edits as an event log, set operations on ids, class tables and connected groups."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def replay(log: DataFrame) -> DataFrame:
    """spike_id, label from log(seq, spike_id, label, undone): the last edit that was not undone wins; null is the original label."""
    return log.groupBy("spike_id").agg(F.max(F.when(~F.col("undone"), F.struct("seq", "label"))).alias("last")).select("spike_id", F.col("last.label").alias("label"))


def checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; where it is unset, a session on one machine (tests) gets a folder, and a cluster an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp())


def groups(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root of edges(a, b): connected groups, each named by its smallest node.

    Labels spread to neighbours and then jump to their own label's label until none moves. Each round is written to
    the checkpoint directory, which cuts the lineage.
    """
    checkpoint_dir(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")).checkpoint()
    for _ in range(rounds):
        near = both.join(label, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        step = label.join(near, "node").select("node", F.least("root", "seen").alias("to"), F.col("root").alias("old"))
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        new = step.join(jump, "to").select("node", F.least("to", "further").alias("root"), "old").checkpoint()
        label = new.select("node", "root")
        if new.filter("root <> old").isEmpty():
            return label
    raise RuntimeError(f"labels still move after {rounds} rounds")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """cluster, change of two label tables (spike_id, cluster): clusters that came, went or hold other spikes, spike by spike."""
    both = before.join(after.select("spike_id", F.col("cluster").alias("now")), "spike_id", "full")
    sides = F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(True).alias("was")), F.struct(F.col("now").alias("c"), F.lit(False).alias("was"))))
    held = both.select(sides.alias("s"), (~F.col("cluster").eqNullSafe(F.col("now"))).alias("moved")).filter("s.c IS NOT NULL")
    held = held.groupBy(F.col("s.c").alias("cluster")).agg(F.bool_or("s.was").alias("was"), F.bool_or(~F.col("s.was")).alias("still"), F.bool_or("moved").alias("moved"))
    return held.filter("moved").select("cluster", F.when(~F.col("was"), "new").when(~F.col("still"), "gone").otherwise("changed").alias("change"))


def inside(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether the point lies in the polygon: a ray to the right crosses its edges an odd number of times."""
    odd = F.lit(False)
    for (x0, y0), (x1, y1) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y0 != y1:  # a level edge is never crossed
            crosses = ((F.lit(float(y0)) > y) != (F.lit(float(y1)) > y)) & (x < (x1 - x0) * (y - float(y0)) / (y1 - y0) + x0)
            odd = odd != crosses
    return odd


def tree_depths(nodes: DataFrame, rounds: int = 64) -> DataFrame:
    """node, depth, top of nodes(node, parent): each node's distance from its tree's top, by doubling the step up each round, each written as a checkpoint."""
    checkpoint_dir(nodes.sparkSession)
    state = nodes.select("node", F.coalesce("parent", "node").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")).checkpoint()
    for _ in range(rounds):
        above = state.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        new = state.join(above, "up").select("node", F.col("further").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved"))
        new = new.checkpoint()
        if new.filter("moved").isEmpty():
            return new.select("node", "depth", F.col("up").alias("top"))
        state = new.drop("moved")
    raise RuntimeError("the nodes are no forest")


def latest_per(rows: DataFrame, by: str, *order) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def protected(edits: DataFrame, reserved: int, rested: list[int]) -> DataFrame:
    """edits(cluster, wanted) with label and refused: ids below `reserved` are no targets, ids laid to rest neither targets nor to be changed."""
    refused = (F.col("wanted") < reserved) | F.col("wanted").isin(rested) | F.col("cluster").isin(rested)
    return edits.withColumns({"refused": refused, "label": F.when(refused, F.col("cluster")).otherwise(F.col("wanted"))})


def grown(events: DataFrame, plan: DataFrame) -> DataFrame:
    """events(spike_id, t, cluster) with each one of plan(spike_id, parts: array of lag and unit) replaced by its parts, numbered from 1; others are part 0."""
    both = events.join(plan, "spike_id", "left").withColumn("alone", F.col("parts").isNull())
    alone = both.filter("alone").select("spike_id", "t", "cluster", F.lit(0).cast("long").alias("part"))
    parts = both.filter("NOT alone").select("spike_id", "t", F.posexplode("parts").alias("i", "p"))
    return alone.unionByName(parts.select("spike_id", (F.col("t") + F.col("p.lag")).alias("t"), F.col("p.unit").alias("cluster"), (F.col("i") + 1).cast("long").alias("part")))


def precision_recall(pairs: DataFrame) -> DataFrame:
    """pairs(score, hit) as least, taken, precision, recall for each score: all pairs of it or more are taken. Pairs of units are few; one task ranks their scores."""
    y = pairs.groupBy("score").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    down, every = Window.partitionBy(F.lit(0)).orderBy(F.desc("score")), Window.partitionBy(F.lit(0))
    c = y.select("score", F.sum("n").over(down).alias("taken"), F.sum("hits").over(down).alias("hits"), F.sum("hits").over(every).alias("most"))
    return c.select(F.col("score").alias("least"), "taken", F.round(F.col("hits") / F.col("taken"), 6).alias("precision"), F.round(F.try_divide("hits", "most"), 6).alias("recall"))
