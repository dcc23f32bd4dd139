"""Detection of peaks over the channels of a group: windows from crossings, the peak of each, and the rules for where to look next.

Where a crossing leads does not depend on the events before it, so crossings and their peaks are found by blocks with a halo in
window functions; which crossings count, and which peaks a refractory time leaves, are walks along them (`scans.jumps`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .signal import refractory
from .timing import with_halo

BLOCK = 16_384


@dataclass(frozen=True)
class Peaks:
    """length: samples of a window from its crossing on. before, after: samples of an event's waveform around its peak; the record's first `before` samples are not searched, and a peak
    with fewer than `after` samples behind it is none. refractory: an event comes more than so many samples after the last one. negative_first: a window's lowest peak if one
    is beyond the threshold below, else its highest; otherwise its largest either way."""

    length: int = 16
    before: int = 5
    after: int = 8
    refractory: int = 8
    negative_first: bool = True


def is_peak(x: Column, before: Column, after: Column) -> Column:
    """Whether no neighbour is further from 0 on the value's side; a value of 0 is none where the signal crosses it. A missing neighbour is no objection."""
    a, b = F.coalesce(before, x), F.coalesce(after, x)
    return F.when(x > 0, (a <= x) & (b <= x)).when(x < 0, (a >= x) & (b >= x)).otherwise(~(((a > 0) & (b < 0)) | ((a < 0) & (b > 0))))


def crossings(traces: DataFrame, thresholds: list[float], how: Peaks, block: int = BLOCK) -> DataFrame:
    """session, sample, ch, peak, value, after and last of traces(session, sample, xs) where a channel is at its threshold or beyond: ch is the first such; peak, peak_ch and value
    are those of the window that begins there, null without one, and `after` is where the search would go on. last: of the samples that are there, up to the last
    that the window's events may need.

    Of peaks alike in value the earliest is taken, then the one of the first channel. Samples are numbered from 0 without gaps in each session.
    """
    held = with_halo(traces.select("session", "sample", "xs"), "sample", 1, how.length + max(1, how.after), block)
    w = Window.partitionBy("session", "block").orderBy("sample")
    held = held.withColumns({"_p": F.lag("xs").over(w), "_n": F.lead("xs").over(w)})
    limit = F.array(*[F.lit(float(abs(t))) for t in thresholds])
    over = F.filter(F.sequence(F.lit(0), F.lit(len(thresholds) - 1)), lambda c: F.abs(F.get("xs", c)) >= F.get(limit, c))

    def best(far: Column, value) -> Column:
        """The least (value, channel) of a sample's real peaks that are far enough."""
        found = F.filter(F.transform("xs", lambda x, c: F.when(far(x, c) & is_peak(x, F.get("_p", c), F.get("_n", c)), F.struct(value(x).alias("v"), c.alias("ch"), x.alias("x")))), lambda s: s.isNotNull())
        return F.array_min(found)

    ahead = w.rowsBetween(0, how.length - 1)
    least = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.v"), "sample", F.col(f"{c}.ch"), F.col(f"{c}.x")))).over(ahead)
    if how.negative_first:
        sides = {"_low": best(lambda x, c: x <= -F.get(limit, c), lambda x: x), "_high": best(lambda x, c: x >= F.get(limit, c), lambda x: -x)}
        peak = F.coalesce("_low", "_high")
    else:
        sides = {"_any": best(lambda x, c: F.abs(x) >= F.get(limit, c), lambda x: -F.abs(x))}
        peak = F.col("_any")
    held = held.withColumns(sides).withColumns({c: least(c) for c in sides} | {"last": F.max("sample").over(w.rowsBetween(0, how.length - 1 + max(0, how.after)))}).filter("own")
    found = held.filter(F.size(over) > 0).select("session", "sample", "last", F.get(over, 0).cast("long").alias("ch"), peak.alias("_best"))
    found = found.select("session", "sample", "ch", F.col("_best.sample").alias("peak"), F.col("_best.ch").cast("long").alias("peak_ch"), F.col("_best.x").alias("value"), "last")
    # a window that the record cuts is none; the search goes on a window later, or where the next event's waveform may begin
    after = F.when(F.col("peak").isNull(), F.col("sample") + how.length).otherwise(F.greatest(F.col("peak") + how.length - how.before, F.col("sample") + 1))
    return found.withColumn("after", after).filter((F.col("sample") >= how.before) & (F.col("sample") + how.length - 1 <= F.col("last")))


def detect(traces: DataFrame, thresholds: list[float], how: Peaks = Peaks(), block: int = BLOCK) -> DataFrame:
    """session, sample, ch and value of the events of traces(session, sample, xs), xs the group's channels in order, thresholds theirs.

    From the first crossing on: the peak of its window is an event unless it comes too soon after the last event or too near to the record's end. The search goes on behind the peak,
    event or not. Equal to one pass over all samples, for any length of blocks.
    """
    if how.length <= how.before:
        raise ValueError("a window must be longer than what comes before its peak")
    walked = scans.jumps(crossings(traces, thresholds, how, block), ["session"], "sample", "after", 2 * how.length, block)
    peaks = walked.filter(F.col("peak").isNotNull() & (F.col("peak") + how.after <= F.col("last")))
    peaks = peaks.select("session", F.col("peak").alias("sample"), F.col("peak_ch").alias("ch"), "value")
    return refractory(peaks, how.refractory, by=("session",), width=block)


def by_group(traces: DataFrame, groups: dict[str, list[int]], thresholds: dict[str, list[float]], how: dict[str, Peaks] | Peaks = Peaks()) -> DataFrame:
    """grp, session, sample, ch (of the record) and value of the events of each group of channels; every group may have rules of its own."""
    out = None
    for name, channels in groups.items():
        own = traces.withColumn("xs", F.array(*[F.get("xs", c) for c in channels]))
        found = detect(own, thresholds[name], how[name] if isinstance(how, dict) else how)
        found = found.select(F.lit(name).alias("grp"), "session", "sample", F.get(F.array(*map(F.lit, channels)), F.col("ch").cast("int")).cast("long").alias("ch"), "value")
        out = found if out is None else out.unionByName(found)
    return out
