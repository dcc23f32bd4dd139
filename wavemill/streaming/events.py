"""Event trains as streams: windows with watermarks, and the refractory rule as state per group.

The rules are those of the batch operators; a stream adds only when a result is final.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def rates(events: DataFrame, length: str, late: str, step: str | None = None) -> DataFrame:
    """grp, start, n over tumbling (or, with a step, sliding) windows of events(at, grp)."""
    window = F.window("at", length, step) if step else F.window("at", length)
    return events.withWatermark("at", late).groupBy("grp", window.alias("w")).agg(F.count("*").alias("n")).select("grp", F.col("w.start").alias("start"), "n")


def bursts(events: DataFrame, gap: str, late: str) -> DataFrame:
    """grp, start, end, n of runs of events without a longer gap."""
    w = F.session_window("at", gap)
    return events.withWatermark("at", late).groupBy("grp", w.alias("w")).agg(F.count("*").alias("n")).select("grp", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def refractory(events: DataFrame, r: int) -> DataFrame:
    """grp, t of events(grp, t) more than r after the last one kept; the state of a group is one time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t for b in batches for t in b["t"])
        kept = []
        for t in times:
            if last is None or t - last > r:
                kept.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"grp": [key[0]] * len(kept), "t": kept})

    return events.groupBy("grp").applyInPandasWithState(step, "grp string, t long", "last long", "append", GroupStateTimeout.NoTimeout)


def refractory_in_time(events: DataFrame, r: int, late: str) -> DataFrame:
    """grp, t of events(at, grp) more than r milliseconds after the last one kept, t in milliseconds, whatever order they arrive in.

    A group's events wait in its state until the watermark, `late` behind the latest event seen, has passed them; then they are judged in order of time, as a batch would. A timer of event time
    wakes a group that gets no more events, and a group that has none waiting and whose last kept one is r behind is forgotten. Events behind the watermark are left out by Spark
    and counted: see dropped(). Null times and repeated times are judged like others; null times never come out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, [])
        held = sorted([*held, *(int(t) for b in batches for t in b["t"].dropna())]) if not state.hasTimedOut else list(held)
        now, kept = state.getCurrentWatermarkMs(), []
        while held and held[0] <= now:
            t = held.pop(0)
            if last is None or t - last > r:
                kept.append(t)
                last = t
        if held or (last is not None and last + r > now):
            state.update((last, held))
            state.setTimeoutTimestamp(max(now + 1, held[0] if held else last + r))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"grp": [key[0]] * len(kept), "t": kept})

    timed = events.withWatermark("at", late).select("grp", "at", F.unix_millis("at").alias("t"))
    return timed.groupBy("grp").applyInPandasWithState(step, "grp string, t long", "last long, held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def dropped(query) -> int:
    """How many rows of a started query came behind the watermark so far."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
