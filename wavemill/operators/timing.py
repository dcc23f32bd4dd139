"""Event trains: intervals, bursts, blocks, ranks, correlograms and joins on time.

Windows are partitioned by cluster, group or session. Joins on time carry the bucket of the time as an equality key, so they
are hash or sort-merge joins with the range as a residual condition and never compare all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import recovering, runs


def intervals_between(spikes: DataFrame) -> DataFrame:
    """spikes with isi: the time since the cluster's spike before, null for its first."""
    w = Window.partitionBy("cluster").orderBy("t", "spike_id")
    return spikes.withColumn("isi", F.col("t") - F.lag("t").over(w))


def interval_statistics(spikes: DataFrame, limits: tuple[int, ...]) -> DataFrame:
    """Per cluster: spikes, mean, median and variation of the intervals, and the share of them below each limit."""
    isi = F.col("isi")
    below = [F.round(F.avg((isi < x).cast("int")), 6).alias(f"below_{x}") for x in limits]
    cv = F.when(F.avg(isi) > 0, F.stddev_pop(isi) / F.avg(isi))
    return intervals_between(spikes).groupBy("cluster").agg(
        F.count("*").alias("n"), F.round(F.avg(isi), 6).alias("mean_isi"), F.round(F.percentile(isi, F.lit(0.5)), 6).alias("median_isi"), F.round(cv, 6).alias("cv_isi"), *below
    )


def bursts(spikes: DataFrame, max_gap: int) -> DataFrame:
    """Per cluster its maximal runs of spikes with gaps of at most max_gap: burst number, first, last and count."""
    w = Window.partitionBy("cluster").orderBy("t", "spike_id")
    new = (F.coalesce(F.col("isi"), F.lit(max_gap + 1)) > max_gap).cast("long")
    return intervals_between(spikes).withColumn("burst", F.sum(new).over(w)).groupBy("cluster", "burst").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))


def islands(rows: DataFrame, by: str, value: str, gap: int) -> DataFrame:
    """rows with island: numbered where the sorted value jumps by more than gap."""
    w = Window.partitionBy(by).orderBy(value, "id")
    return rows.withColumn("island", F.sum((F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0)) > gap).cast("long")).over(w))


def mean_rank(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """rows with rank in [0, 1], best for the highest value; ties share their mean place, all-equal values are all best."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(F.desc(value))) - 1
    rows = rows.withColumn("_place", place).withColumn("_n", F.count("*").over(w)).withColumn("_k", F.min(value).over(w) == F.max(value).over(w))
    mean = F.avg("_place").over(Window.partitionBy(*by, value))
    return rows.withColumn("rank", F.when(F.col("_k"), 1.0).otherwise(1 - mean / (F.col("_n") - 1))).drop("_place", "_n", "_k")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], low: int, high: int, how: str = "inner") -> DataFrame:
    """Pairs with right.rt - left.t in [low, high] and equal keys; right's keys are named r_<key>.

    Each left row goes into every bucket that its band touches, each right row into its own.
    """
    width = max(1, high - low)
    edge = lambda x: F.floor(x / width)
    if how == "inner":
        l = left.withColumn("_b", F.explode(F.sequence(edge(F.col("t") + low), edge(F.col("t") + high))))
        r = right.withColumn("_rb", edge(F.col("rt")))
    else:  # a left row must stay one row: its partners come to it
        l = left.withColumn("_b", edge(F.col("t")))
        r = right.withColumn("_rb", F.explode(F.sequence(edge(F.col("rt") - high), edge(F.col("rt") - low))))
    on = (F.col("_b") == F.col("_rb")) & F.col("rt").between(F.col("t") + low, F.col("t") + high)
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    return l.join(r, on, how).drop("_b", "_rb")


def correlogram(a: DataFrame, b: DataFrame, keys: list[str], window: int, size: int, skip_self: bool, width: int = 86_400) -> DataFrame:
    """keys, bin, n: pairs by lag b - a, over 2 * half + 1 bins with half = (window / size - 1) / 2 in whole numbers, absent ones 0.

    A lag belongs to bin floor(lag / size + 1/2). With skip_self a spike's pair with itself, by spike_id, does not count. Pairs are not made: in each block of time the places
    of a's bin edges among b's times are looked up, and a bin holds the difference of two places, summed.
    """
    half = (window // size - 1) // 2
    reach = (half + 1) * size
    edges = (np.arange(-half, half + 2) - 0.5) * size
    left = a.select(*keys, "t", "spike_id", F.floor(F.col("t") / width).alias("block"), F.lit(True).alias("asks"))
    right = with_halo(b.select(*keys, "t", "spike_id"), "t", reach, reach, width).drop("own").withColumn("asks", F.lit(False))
    both = left.unionByName(right).withColumn("_key", F.to_json(F.struct(*keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _), table in runs(batches, "_key", "block"):
            asks = table.column("asks").to_numpy().astype(bool)
            t, ids = table.column("t").to_numpy().astype(float), table.column("spike_id").to_numpy()
            if asks.any():
                n = np.diff(np.searchsorted(t[~asks], t[asks][:, None] + edges, "left").sum(0))
                if skip_self:
                    n[half] -= np.isin(ids[asks], ids[~asks]).sum()
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(n)), pa.array(np.arange(-half, half + 1)), pa.array(n.astype(np.int64))], names=["_key", "bin", "n"])

    dealt = both.repartition("_key", "block").sortWithinPartitions("_key", "block", "t")
    found = dealt.mapInArrow(run, "_key string, bin long, n long").groupBy("_key", "bin").agg(F.sum("n").alias("n"))
    types = {f.name: f.dataType.simpleString() for f in a.schema}
    named = F.from_json("_key", ", ".join(f"{k} {types[k]}" for k in keys))
    return found.select(named.alias("k"), "bin", "n").select("k.*", "bin", "n")


def pair_rates(spikes: DataFrame, unit: str, centre: int, flank: int, width: int = 86_400) -> DataFrame:
    """a, b (units, a < b), centre and flank: how many pairs of their spikes(unit, t) are at most `centre` apart, and how many farther but at most `flank`. Pairs of units without any are left out.

    No pairs of spikes are made: in each block of time the ends of the ranges around a unit's spikes are looked up among every other unit's times. A block works on its spikes times its units.
    """
    rows = spikes.select(F.col(unit).cast("long").alias("u"), "t").filter("u IS NOT NULL AND t IS NOT NULL")
    held = with_halo(rows, "t", flank, flank, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches, "block"):
            t, units, own = table.column("t").to_numpy().astype(float), table.column("u").to_numpy(), table.column("own").to_numpy().astype(bool)
            mine, codes = np.unique(units[own], return_inverse=True)
            found = []
            for b in np.unique(units):
                times = t[units == b]
                near = np.searchsorted(times, t[own] + centre, "right") - np.searchsorted(times, t[own] - centre, "left")
                far = np.searchsorted(times, t[own] + flank, "right") - np.searchsorted(times, t[own] - flank, "left")
                for i, (n, m) in enumerate(zip(np.bincount(codes, near, len(mine)), np.bincount(codes, far, len(mine)), strict=True)):
                    if mine[i] < b and m:
                        found.append((int(mine[i]), int(b), int(n), int(m - n)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b", "centre", "flank"])

    dealt = held.repartition("block").sortWithinPartitions("block", "t")
    return dealt.mapInArrow(run, "a long, b long, centre long, flank long").groupBy("a", "b").agg(F.sum("centre").alias("centre"), F.sum("flank").alias("flank"))


def previous(queries: DataFrame, events: DataFrame, by: str) -> DataFrame:
    """queries(by, t, spike_id) with the time and id of the last event strictly before (union, then last over the time order)."""
    w = Window.partitionBy(by).orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    tagged = queries.select(by, "t", "spike_id", F.lit(None).cast("struct<t:long,id:long>").alias("e")).unionByName(
        events.select(by, "t", F.lit(None).cast("long").alias("spike_id"), F.struct("t", F.col("spike_id").alias("id")).cast("struct<t:long,id:long>").alias("e"))
    )
    return tagged.withColumn("last", F.max("e").over(w)).filter(F.col("spike_id").isNotNull()).select(by, "t", "spike_id", F.col("last.t").alias("prev_t"), F.col("last.id").alias("prev_id"))


def merged(intervals: DataFrame, by: str) -> DataFrame:
    """The unions of touching [a, b) intervals within each group."""
    w = Window.partitionBy(by).orderBy("a", "b", "id")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("a") > reach, F.lit(True)).cast("long")
    return intervals.withColumn("_new", new).withColumn("island", F.sum("_new").over(w)).groupBy(by, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n"))


def with_halo(rows: DataFrame, at: str, before: int, after: int, width: int) -> DataFrame:
    """rows with block (of `width`, on the column `at`) and own. A row is in its own block and, as halo, in every other whose windows may reach it: those
    of rows up to `before` later or `after` earlier. Windows over a block's rows then see what they would over all."""
    of = lambda x: F.floor(x / width)
    return rows.withColumn("block", F.explode(F.sequence(of(F.col(at) - after), of(F.col(at) + before)))).withColumn("own", F.col("block") == of(F.col(at)))


def with_span(rows: DataFrame, by: str) -> DataFrame:
    """rows with t0 and t1, the first and last time of their group: an aggregate that is joined, so no group is in one task."""
    ends = rows.groupBy(F.col(by).alias("_by")).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return rows.join(ends, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def clean(spikes: DataFrame, by: str, n: int, width: int = 86400) -> DataFrame:
    """spikes with clean: whether no other spike of the group is in [t - (n - 1), t + n]; a neighbour exactly n later spoils the earlier one alone."""
    w = Window.partitionBy(by, "block").orderBy("t").rangeBetween(-(n - 1), n)
    return with_halo(spikes, "t", n - 1, n, width).withColumn("clean", F.count("*").over(w) == 1).filter("own").drop("block", "own")


def pairs_at(spikes: DataFrame, by: str, lags: dict[str, tuple[int, int]]) -> DataFrame:
    """by and, for each name, how many pairs of the group's spikes have a lag within the bounds (both later than 0): counts over ranges, no pairs."""
    w = Window.partitionBy(by).orderBy("t")
    counted = spikes.select(by, *[F.count("*").over(w.rangeBetween(*b)).alias(n) for n, b in lags.items()])
    return counted.groupBy(by).agg(*[F.sum(n).alias(n) for n in lags])


def overlaps(intervals: DataFrame, by: str, width: int, size: int = 4096, run: int = 256) -> DataFrame:
    """a, b (ids, a < b), overlap and together (length of the union) of the intervals [a, b) of a group that share something.

    A group's intervals of like length (by powers of two) are cut, in order of their beginning, into chunks of `size`; two chunks whose spans touch are a tile, and tiles are dealt to 256 tasks.
    An interval's place is counted within its cell of `width`, so no group is ranked as a whole. There are far more pairs than intervals, so pairs leave a tile in an order that files hold in few
    bytes: those of one a stand together, and beside it the same runs of `run` intervals, alike ones together, come again for the next a.
    """
    held = intervals.select(F.col(by).alias("g"), "id", "a", "b").filter("g IS NOT NULL AND id IS NOT NULL AND a < b")
    held = held.withColumns({"kind": F.floor(F.log2(F.col("b") - F.col("a"))), "cell": F.floor(F.col("a") / width)})
    n = F.count("*")
    before = F.sum(n).over(Window.partitionBy("g", "kind").orderBy("cell")) - n
    cells = held.groupBy("g", "kind", "cell").agg(before.alias("before"))
    placed = held.join(cells, ["g", "kind", "cell"]).withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("g", "kind", "cell").orderBy("a", "b", "id")) - 1)
    rows = F.sort_array(F.collect_list(F.struct("a", "b", "id")))
    chunks = placed.groupBy("g", F.struct("kind", F.floor(F.col("place") / size).alias("n")).alias("chunk")).agg(F.min("a").alias("first"), F.max("b").alias("last"), rows.alias("rows"))
    p, q = (chunks.select(*[F.col(c).alias(f"{n}_{c}") for c in ("g", "chunk", "first", "last")]) for n in "pq")
    met = (F.col("p_g") == F.col("q_g")) & (F.col("p_chunk") <= F.col("q_chunk")) & (F.col("p_first") < F.col("q_last")) & (F.col("q_first") < F.col("p_last"))
    tiles = p.join(q, met).select(F.col("p_g").alias("g"), "p_chunk", "q_chunk")

    def side(n: str) -> DataFrame:
        its = chunks.select("g", F.col("chunk").alias(f"{n}_chunk"), *[F.col(f"rows.{c}").alias(f"{n}_{c}") for c in ("id", "a", "b")])
        return tiles.join(its, ["g", f"{n}_chunk"]).repartition(256, "g", "p_chunk", "q_chunk")

    def parts(x: str, y: str) -> Column:
        held = lambda n: F.arrays_zip(F.col(f"{n}_id").alias("id"), F.col(f"{n}_a").alias("a"), F.col(f"{n}_b").alias("b"))
        runs = F.transform(F.sequence(F.lit(1), F.size(f"{y}_id"), F.lit(run)), lambda i: F.slice(held(y), i, F.lit(run)))
        return F.transform(runs, lambda r: F.struct(F.sort_array(held(x)).alias("x"), r.alias("y"), r[0]["a"].alias("first"), F.array_max(r["b"]).alias("last")))

    both = side("p").join(side("q"), ["g", "p_chunk", "q_chunk"])
    dealt = both.select(F.inline(F.when(F.col("p_chunk") == F.col("q_chunk"), parts("p", "q")).otherwise(F.concat(parts("p", "q"), parts("q", "p")))))
    near = dealt.select(F.explode(F.filter("x", lambda x: (x["a"] < F.col("last")) & (x["b"] > F.col("first")))).alias("x"), "y")
    pairs = near.select(F.col("x.id").alias("p"), F.col("x.a").alias("pa"), F.col("x.b").alias("pb"), F.inline("y").alias("q", "qa", "qb"))
    pairs = pairs.filter((F.col("p") < F.col("q")) & (F.col("pa") < F.col("qb")) & (F.col("qa") < F.col("pb")))
    shared, together = F.least("pb", "qb") - F.greatest("pa", "qa"), F.greatest("pb", "qb") - F.least("pa", "qa")
    return pairs.select(F.col("p").alias("a"), F.col("q").alias("b"), shared.alias("overlap"), together.alias("together"))


def bursts_by_block(spikes: DataFrame, by: str, gap: int, width: int = 86400) -> DataFrame:
    """spikes with first (t, spike_id, cluster of the burst's first spike) and opens (whether it is that one), over runs with gaps of at most `gap`.

    A spike opens a burst if its group has none within the gap before it. The last opening comes from its block or, carried over, from the blocks before.
    """
    own = F.struct("t", "spike_id", "cluster")
    w = Window.partitionBy(by, "block").orderBy("t", "spike_id")
    a = with_halo(spikes, "t", gap, 0, width).withColumn("opens", F.coalesce(F.col("t") - F.lag("t").over(w) > gap, F.lit(True))).filter("own")
    a = a.withColumn("_here", F.max(F.when(F.col("opens"), own)).over(w))
    last = a.groupBy(by, "block").agg(F.max("_here").alias("_last"))
    last = last.withColumn("_before", F.max("_last").over(Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    return a.join(last.select(by, "block", "_before"), [by, "block"]).withColumn("first", F.coalesce("_here", "_before")).drop("block", "own", "_here", "_before")


def depression(spikes: DataFrame, constants: dict[str, tuple[float, float]], width: int = 86400) -> DataFrame:
    """spike_id, cluster and for each (part used, time constant) what is available at the spike: 1 at a cluster's first.

    Each value needs the one before it, and is linear in it: a cluster's blocks of time are put together from their slopes.
    """
    return recovering(spikes.select("spike_id", "cluster", "t"), ["cluster"], "t", constants, width, ["spike_id"]).drop("t")


def drift_chunks(rows: DataFrame, by: str, at: str, level: str, range_: int, least: int) -> DataFrame:
    """rows(by, at, level) with chunk: in order, a row opens a new one if with it the chunk's range of levels would reach `range_` and the chunk has
    lasted `least`. A null level is 0. Rows of a group are read in order as a stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, low, high, start, chunk = object(), 0, 0, 0, 0
        for batch in batches:
            out = []
            for g, t, v in zip(batch["by"], batch["at"], batch["level"], strict=True):
                if g != held:
                    held, low, high, start, chunk = g, v, v, t, 0
                elif max(high, v) - min(low, v) >= range_ and t - start >= least:
                    low, high, start, chunk = v, v, t, chunk + 1
                else:
                    low, high = min(low, v), max(high, v)
                out.append(chunk)
            yield batch[["by", "at"]].assign(chunk=out)

    read = rows.select(F.col(by).cast("string").alias("by"), F.col(at).alias("at"), F.coalesce(level, F.lit(0)).cast("long").alias("level"))
    out = read.repartition("by").sortWithinPartitions("by", "at").mapInPandas(run, "by string, at long, chunk long")
    return out.select(F.col("by").alias(by), F.col("at").alias(at), "chunk")
