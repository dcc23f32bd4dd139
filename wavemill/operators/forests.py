"""Template forests: for every class a root for each stretch of time, with a running summary, and leaves below it; laid anew over other stretches.

A forest is a table of nodes: node, class, kind, parent (null for a root), a, b (its window), n, mean and std (arrays; null where only a number is known). Stretches tile
[0, end): an ordered list of the edges between them.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import floor, isfinite, log10

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = "node long, class long, kind string, parent long, a double, b double, n long, mean array<double>, std array<double>"
COLUMNS = [f.split()[0] for f in NODES.split(", ")]


def uniform(end: float, k: int) -> list[float]:
    """Edges of k equal stretches of [0, end]."""
    return [end * i / k for i in range(1, k)] if end > 0 else []


def valid(edges: list[float], end: float) -> bool:
    return end > 0 and all(a < b for a, b in zip([0.0, *edges], [*edges, end], strict=True))


def split(edges: list[float], end: float, region: int, at: float) -> list[float]:
    """Edges with one more, if it lies strictly inside of the region."""
    ends = [0.0, *edges, end]
    return sorted([*edges, at]) if 0 <= region <= len(edges) and ends[region] < at < ends[region + 1] else edges


def merge(edges: list[float], region: int) -> list[float]:
    """Edges without the one behind the region, if there is one."""
    return edges[:region] + edges[region + 1 :] if 0 <= region < len(edges) else edges


def _same(x: float, y: float) -> bool:
    """Whether two numbers may be one, written with six digits."""
    step = max((0.5 * 10.0 ** (floor(log10(abs(v))) - 5) if v and isfinite(v) else 0.0) for v in (x, y))
    return abs(x - y) <= step * (1 + 1e-9)


def edges_of(windows: Iterable[tuple[float, float]], end: float = 0.0) -> tuple[list[float], float]:
    """Edges and end of the stretches that windows tile: their distinct ends, but for 0 and the last. Ends that are the same with six digits are one."""
    ends = sorted(e for w in windows for e in w)
    last = max([end, *ends])
    if end > 0 and last > end and _same(last, end):
        last = end
    out: list[float] = []
    for e in ends:
        if 0 < e < last and not _same(e, last) and not (out and _same(out[-1], e)):
            out.append(e)
    return out, last


def region_of(t: Column, edges: list[float], end: float) -> Column:
    """The number of the stretch of a time, the first and the last for times outside."""
    return F.least(F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>"), lambda e: e <= t)), F.lit(len(edges))).cast("long")


def _regions(spark: SparkSession, edges: list[float], end: float) -> Column:
    ends = [0.0, *map(float, edges), float(end)]
    return F.array(*[F.struct(F.lit(i).cast("long").alias("region"), F.lit(a).alias("ra"), F.lit(b).alias("rb")) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))])


def _summary(values: DataFrame, by: list[str]) -> DataFrame:
    """by, n, mean and std of values(by, x array): by place, population deviation. A place at a time is summed, so rows combine before they are shuffled."""
    places = values.select(*by, F.posexplode("x").alias("_i", "_x")).groupBy(*by, "_i").agg(F.count("*").alias("_n"), F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
    held = places.groupBy(*by).agg(F.max("_n").alias("n"), F.array_sort(F.collect_list(F.struct("_i", "_m", "_s"))).alias("_w"))  # as many as a template has places
    return held.select(*by, "n", F.transform("_w", lambda w: w["_m"]).alias("mean"), F.transform("_w", lambda w: w["_s"]).alias("std"))


def _numbered(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """nodes with node from 0 in an order; a forest has a row for each class and window."""
    return nodes.withColumn("node", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long") - 1)


def grown(rows: DataFrame, edges: list[float], end: float, leaf: float) -> DataFrame:
    """A forest from rows(class, t, x): a root for every class and stretch (empty ones have n 0 and no mean), and leaves for what it has of the class in windows of `leaf` time within.

    Rows with a null class, t or x are left out.
    """
    spark = rows.sparkSession
    real = rows.filter("class IS NOT NULL AND t IS NOT NULL AND x IS NOT NULL").withColumn("t", F.col("t").cast("double")).withColumn("region", region_of(F.col("t"), edges, end))
    real = real.withColumn("_k", F.floor(F.col("t") / leaf).cast("long"))
    roots = real.select("class").distinct().select("class", F.explode(_regions(spark, edges, end)).alias("r")).select("class", "r.*")
    roots = roots.join(_summary(real, ["class", "region"]), ["class", "region"], "left").select("class", "region", F.lit(0).alias("_leaf"), F.lit(None).cast("long").alias("_k"), "ra", "rb", "n", "mean", "std")
    leaves = _summary(real, ["class", "region", "_k"]).select("class", "region", F.lit(1).alias("_leaf"), "_k", (F.col("_k") * leaf).alias("ra"), ((F.col("_k") + 1) * leaf).alias("rb"), "n", "mean", "std")
    nodes = _numbered(roots.unionByName(leaves), [F.col("class"), F.col("_leaf"), F.col("region"), F.col("_k")])
    own = nodes.filter("_leaf = 0").select(F.col("class").alias("_c"), F.col("region").alias("_r"), F.col("node").alias("_root"))
    out = nodes.join(own, (F.col("class") == F.col("_c")) & (F.col("region") == F.col("_r")))
    kind, parent = F.when(F.col("_leaf") == 1, "leaf").otherwise("drift-root"), F.when(F.col("_leaf") == 1, F.col("_root"))
    return out.select("node", "class", kind.alias("kind"), parent.alias("parent"), F.col("ra").cast("double").alias("a"), F.col("rb").cast("double").alias("b"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean", "std")


def regrained(forest: DataFrame, edges: list[float], end: float) -> DataFrame:
    """The forest over other stretches: each has for each class one root, the exact sum of the old roots whose windows overlap it. So equal stretches keep their roots, joined ones
    add them up, and both sides of a new edge have what was there. Leaves keep what they hold and go to the stretch that their old root overlaps most (the first of equal ones).

    Old roots of which only a number is known count where no other overlaps. Nodes are numbered anew: classes by their first node, roots by time, leaves as they were.
    """
    spark = forest.sparkSession
    is_root = F.col("kind").startswith("drift") & F.col("parent").isNull()
    first = forest.groupBy("class").agg(F.min("node").alias("_first"))
    old = forest.filter(is_root).select(F.col("node").alias("_old"), F.col("class").alias("_c"), F.col("a").alias("_a"), F.col("b").alias("_b"), "n", "mean", "std")
    slots = first.select("class", F.explode(_regions(spark, edges, end)).alias("r")).select("class", "r.*")
    # a class has few roots and stretches: the join is by class, the overlap a condition on its few pairs
    over = slots.join(old, (F.col("class") == F.col("_c")) & (F.col("_a") < F.col("rb")) & (F.col("_b") > F.col("ra"))).drop("_c")
    known = over.filter((F.col("n") > 0) & F.col("mean").isNotNull())
    place = F.posexplode(F.arrays_zip("mean", "std")).alias("_i", "_v")
    cells = known.select("class", "region", F.col("n").cast("double").alias("_n"), place).groupBy("class", "region", "_i").agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("_v.mean")).alias("_m"), F.sum(F.col("_n") * (F.col("_v.std") * F.col("_v.std") + F.col("_v.mean") * F.col("_v.mean"))).alias("_q"))
    mean = F.col("_m") / F.col("_n")
    cells = cells.select("class", "region", "_i", mean.alias("_m"), F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))).alias("_s"))
    held = cells.groupBy("class", "region").agg(F.array_sort(F.collect_list(F.struct("_i", "_m", "_s"))).alias("_w"))
    held = held.select("class", "region", F.transform("_w", lambda w: w["_m"]).alias("mean"), F.transform("_w", lambda w: w["_s"]).alias("std"))
    full = (F.col("n") > 0) & F.col("mean").isNotNull()
    counts = over.groupBy("class", "region").agg(F.coalesce(F.sum(F.when(full, F.col("n"))), F.sum("n")).alias("n"))
    roots = slots.join(counts, ["class", "region"], "left").join(held, ["class", "region"], "left").join(first, "class")
    roots = roots.select("class", "_first", F.lit("drift-root").alias("kind"), "region", F.lit(None).cast("long").alias("_was"), F.col("ra").alias("a"), F.col("rb").alias("b"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean", "std")
    overlap = F.greatest(F.least("_b", "rb") - F.greatest("_a", "ra"), F.lit(0.0))
    homes = slots.join(old.select("_old", "_c", "_a", "_b"), F.col("class") == F.col("_c")).groupBy("_old").agg(F.max(F.struct(overlap.alias("o"), (-F.col("region")).alias("r"))).alias("_best")).select("_old", (-F.col("_best.r")).alias("region"))
    leaves = forest.filter(~F.coalesce(is_root, F.lit(False))).join(first, "class").join(homes, F.col("parent") == F.col("_old"), "left")
    leaves = leaves.select("class", "_first", "kind", F.coalesce("region", F.lit(0).cast("long")).alias("region"), F.col("node").alias("_was"), "a", "b", "n", "mean", "std")
    order = [F.col("_first"), F.col("_was").isNotNull(), F.coalesce("_was", "region")]
    nodes = _numbered(roots.unionByName(leaves), order)
    own = nodes.filter("_was IS NULL").select(F.col("class").alias("_c"), F.col("region").alias("_r"), F.col("node").alias("_root"))
    out = nodes.join(own, (F.col("class") == F.col("_c")) & (F.col("region") == F.col("_r")))
    return out.select("node", "class", "kind", F.when(F.col("_was").isNotNull(), F.col("_root")).alias("parent"), "a", "b", "n", "mean", "std")
