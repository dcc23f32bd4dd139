"""Per-channel transforms over time, detection of events, and iterative refractory rules.

Windows are partitioned by session, channel and block. What needs a running state (a refractory time counts from the last
event that was kept) goes through blocks in two levels (`scans`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import jumps
from .timing import with_halo

#: Samples of a block: windows over time see a block and what its edges need of the next ones.
BLOCK = 65_536


def over_time(*more: str) -> Window:
    return Window.partitionBy("session", *more).orderBy("sample")


def median_highpass(values: DataFrame, half: int) -> DataFrame:
    """values with y = x - median of x within half samples; outside of the record x is 0.

    The zeros at the edges are as many as the frame lacks, so the median is taken over the frame and those.
    """
    values = with_halo(values, "sample", half, half, BLOCK)
    w = over_time("ch", "block").rowsBetween(-half, half)
    frame = F.sort_array(F.concat(F.collect_list("x").over(w), F.array_repeat(F.lit(0).cast("long"), F.lit(2 * half + 1) - F.count("*").over(w).cast("int"))))
    return values.withColumn("y", F.col("x") - F.get(frame, half)).filter("own").drop("block", "own")


def fir(values: DataFrame, taps: list[int]) -> DataFrame:
    """values with y: the sum of taps times neighbours, centred, over what there is."""
    half = len(taps) // 2
    values = with_halo(values, "sample", half, half, BLOCK)
    w = over_time("ch", "block")
    terms = [F.coalesce(F.lag("x", half - k).over(w), F.lit(0)) * t for k, t in enumerate(taps)]
    return values.withColumn("y", sum(terms[1:], terms[0])).filter("own").drop("block", "own")


def rising(values: DataFrame, threshold: float) -> DataFrame:
    """The samples at which x comes to be above the threshold, the first sample included."""
    held = with_halo(values, "sample", 1, 0, BLOCK).withColumn("_b", F.lag("x").over(over_time("ch", "block")))
    return held.filter((F.col("x") > threshold) & (F.coalesce("_b", F.lit(threshold)) <= threshold) & F.col("own")).drop("_b", "block", "own")


def flat_runs(traces: DataFrame, channels: int) -> DataFrame:
    """session, ch, longest and flat_runs (of more than three samples) of the runs of equal values in each channel of traces(session, sample, xs); a null is a run of its own.

    Samples are numbered without gaps, so where a sample's run began tells how long it is by then, and a run of more than three has one sample that is its fourth. All channels go
    in one pass: a channel of rows is never made.
    """
    w = over_time()
    held = traces.withColumn("_b", F.lag("xs").over(w))
    new = lambda c: F.when(F.get("xs", c) == F.get("_b", c), None).otherwise(F.col("sample"))
    held = held.withColumns({f"_n{c}": F.col("sample") - F.max(new(c)).over(w) + 1 for c in range(channels)})
    each = [f(f"_n{c}") for c in range(channels) for f in (lambda n: F.max(n).alias(f"{n}_longest"), lambda n: F.count_if(F.col(n) == 4).alias(f"{n}_flat"))]
    told = F.array(*[F.struct(F.lit(c).cast("long").alias("ch"), F.col(f"_n{c}_longest").alias("longest"), F.col(f"_n{c}_flat").alias("flat_runs")) for c in range(channels)])
    return held.groupBy("session").agg(*each).select("session", F.inline(told))


def refractory(events: DataFrame, r: int, reject_equal: bool = True, by: tuple[str, ...] = ("session", "ch"), width: int = BLOCK) -> DataFrame:
    """events without those too soon (by sample) after the last one of their key that was kept: within r, or less than r.

    One event's fate depends on all before it: from a kept event the next is the first that is late enough, so the kept ones are a walk.
    """
    step = max(1, r + 1 if reject_equal else r)
    return jumps(events.withColumn("_to", F.col("sample") + step), list(by), "sample", "_to", step, width).drop("_to")


def windows_around(traces: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """session, ch, sample, waveform: the channel's samples [sample - before, sample + after) of each event; cut at the record's ends."""
    e = events.select("session", "ch", F.col("sample").alias("at"), F.explode(F.sequence(F.col("sample") - before, F.col("sample") + after - 1)).alias("sample"))
    got = e.join(traces, ["session", "ch", "sample"]).groupBy("session", "ch", "at").agg(F.array_sort(F.collect_list(F.struct("sample", "x"))).alias("w"))
    return got.select("session", "ch", F.col("at").alias("sample"), F.transform("w", lambda p: p["x"]).alias("waveform"))


def without_templates(traces: DataFrame, channels: int, threshold: float, before: int, after: int) -> DataFrame:
    """session, sample, ch, y: traces(session, sample, xs) without the mean waveform of their channel's events, from `before` samples before an event to `after` after it; overlaps add up.

    An event is where a channel comes to be above the threshold. Which channels are above it is one number a sample, and those of the samples around tell which events a sample belongs to: no events
    are joined. The means are one row, so traces are read twice and dealt once. Rows without a session have no events.
    """
    w, lags = over_time(), range(-before, after + 2)
    bits = sum((F.when(F.get("xs", c) > threshold, 1 << c).otherwise(0) for c in range(channels)), F.lit(0))
    held = traces.withColumn("_up", F.when(F.col("session").isNotNull(), bits).otherwise(0))
    held = held.withColumns({f"_up{k}": F.lag("_up", k, 0).over(w) for k in lags})
    held = held.withColumns({f"_on{k}": F.col(f"_up{k}").bitwiseAND(F.bitwise_not(f"_up{k + 1}")) for k in lags[:-1]}).select("session", "sample", "xs", *[f"_on{k}" for k in lags[:-1]])
    on = lambda c, k: F.col(f"_on{k}").bitwiseAND(F.lit(1 << c)) != 0
    mean = {f"_m{c}_{i}": F.avg(F.when(on(c, k), F.get("xs", c))) for c in range(channels) for i, k in enumerate(lags[:-1])}
    means = held.filter(F.greatest(*[f"_on{k}" for k in lags[:-1]]) > 0).agg(*[x.alias(n) for n, x in mean.items()])
    less = lambda c: sum((F.when(on(c, k), F.coalesce(f"_m{c}_{i}", F.lit(0.0))).otherwise(0.0) for i, k in enumerate(lags[:-1])), F.lit(0.0))
    ys = F.array(*[F.get("xs", c) - less(c) for c in range(channels)])
    return held.crossJoin(F.broadcast(means)).select("session", "sample", F.posexplode(ys).alias("ch", "y")).withColumn("ch", F.col("ch").cast("long"))


def upper_median(values: DataFrame, by: list[str]) -> DataFrame:
    """by, x: the n // 2-th of each group's x in order. Equal values are counted first, so a group is no more rows than it has values."""
    w = Window.partitionBy(*by)
    counts = values.groupBy(*by, "x").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.withColumns({"_upto": upto, "_all": F.sum("_n").over(w)}).filter("_upto > _all div 2").groupBy(*by).agg(F.min("x").alias("x"))


def stepped(traces: DataFrame) -> DataFrame:
    """traces(session, sample, xs) with each channel's first difference in time; the first sample stays."""
    held = with_halo(traces, "sample", 1, 0, BLOCK).withColumn("_b", F.lag("xs").over(over_time("block")))
    step = F.when(F.col("_b").isNull(), F.col("xs")).otherwise(F.zip_with("xs", "_b", lambda x, b: x - b))
    return held.withColumn("xs", step).filter("own").drop("_b", "block", "own")


def regressed(traces: DataFrame, reference: int) -> DataFrame:
    """session, sample, ch and y of every channel but the reference: centred, without its regression on that."""
    rows = traces.select("session", "sample", F.get("xs", reference).alias("ref"), F.posexplode("xs").alias("ch", "x")).filter(F.col("ch") != reference).withColumn("ch", F.col("ch").cast("long"))
    fit = rows.groupBy("session", "ch").agg(F.avg("ref").alias("mr"), F.avg("x").alias("mx"), F.regr_slope("x", "ref").alias("beta"))
    return rows.join(fit, ["session", "ch"]).select("session", "sample", "ch", (F.col("x") - F.col("mx") - F.col("beta") * (F.col("ref") - F.col("mr"))).alias("y"))
