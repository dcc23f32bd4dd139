"""States that run along the rows of a key, in two levels: no key is one task's.

A key's rows are cut into blocks. Each block becomes a map from the state before it to the state after it, small whatever the block holds; the maps of a
key's blocks are applied one after another, which gives the state before each block; with it every block's rows are done on their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Numbers = list[float]


def runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Each run of rows that are alike in these columns, with what they are."""
    held, own = [], None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(n) for n in names]
        new = np.zeros(len(batch) - 1, bool)
        for c in columns:
            a, b = c.slice(1), c.slice(0, len(c) - 1)
            new |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            if c.null_count:
                new |= pc.not_equal(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
        for at, end in zip(starts, starts[1:]):
            key = tuple(c[at].as_py() for c in columns)
            if own is not None and key != own:
                yield own, pa.Table.from_batches(held)
                held = []
            own = key
            held.append(batch.slice(at, end - at))
    if own is not None:
        yield own, pa.Table.from_batches(held)


def scan(
    rows: DataFrame,
    by: list[str],
    block: Column,
    order: list[str],
    summary: Callable[[pa.Table], Numbers],
    follow: Callable[[Numbers | None, Numbers], Numbers | None],
    emit: Callable[[pa.Table, Numbers | None], pa.Table],
    schema: str,
) -> DataFrame:
    """emit's rows of each block, given the state before it: None at a key's first, then what follow makes of the state and the block's summary.

    order sorts a key's rows and goes with the blocks. Keys and blocks may be null. Rows are computed and dealt once: both passes read one shuffle.
    """
    # neither is nullable, or the join below would filter one of the two readers and no longer share the shuffle
    key, first = F.coalesce(F.to_json(F.struct(*by)), F.lit("")), F.lit(-(2**63)).cast("long")
    # the hash lets rows be sorted by a number first: the keys' texts begin alike
    named = rows.withColumns({"_hash": F.xxhash64(*by), "_key": key, "_block": F.coalesce(block.cast("long"), first)})
    ends = ["_hash", "_key", "_block"]
    told = "_hash long, _key string, _block long, "

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(*key, summary(table)) for key, table in runs(batches, *ends)]
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*ends, "_map"])

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            states = []
            for key, told in zip(batch.column("_key").to_pylist(), batch.column("_map").to_pylist(), strict=True):
                own, state = key, state if key == own else None
                states.append(state)
                state = follow(state, told)
            yield pa.RecordBatch.from_arrays([*map(batch.column, ends), pa.array(states, pa.list_(pa.float64()))], names=[*ends, "_entry"])

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, table in runs(batches, *ends):
            held.append(emit(table, table.column("_entry")[0].as_py()))
            n += len(held[-1])
            if n >= 10_000:  # blocks may be small, batches should not be
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    dealt = named.repartition(*ends)
    maps = dealt.sortWithinPartitions(*ends, *order).mapInArrow(summarised, told + "_map array<double>")
    entries = maps.repartition("_key").sortWithinPartitions(*ends).mapInArrow(entered, told + "_entry array<double>")
    # the last repartition is left out of the plan where the join has kept the rows dealt
    return dealt.join(entries, ends).repartition(*ends).sortWithinPartitions(*ends, *order).mapInArrow(emitted, schema)


def _columns(table: pa.Table, names: list[str], **more: pa.Array) -> pa.Table:
    return pa.table({c: table.column(c) for c in names} | more)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(float)


def jumps(rows: DataFrame, by: list[str], at: str, to: str, reach: int, width: int = 65_536) -> DataFrame:
    """The rows that a walk along each key's rows stands on: it begins at the first and goes on from a row to the next whose `at` is its `to` or later.

    at < to <= at + reach, whole numbers, not null; of rows with the same `at` only one is stood on. What a block does to the walk is told by the
    rows that the walk may reach first in it.
    """
    width, names = max(width, reach), rows.columns

    def landing(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int]]:
        a, t = _numbers(table, at), _numbers(table, to)
        return a, t, np.searchsorted(a, t).tolist()

    def summary(table: pa.Table) -> Numbers:
        a, t, after = landing(table)
        out = t.tolist()
        for i in range(len(out) - 2, -1, -1):  # where the walk leaves the block from each row
            if after[i] < len(out):
                out[i] = out[after[i]]
        start = math.floor(a[0] / width) * width
        k = min(len(a), int(np.searchsorted(a, start + reach)) + 1)
        return [*a[:k].tolist(), *out[:k]]

    def follow(state: Numbers | None, told: Numbers) -> Numbers:
        half = len(told) // 2
        i = int(np.searchsorted(told[:half], state[0])) if state else 0
        return [told[half + i]] if i < half else state

    def emit(table: pa.Table, state: Numbers | None) -> pa.Table:
        a, _, after = landing(table)
        i, stood = int(np.searchsorted(a, state[0])) if state else 0, []
        while i < len(a):
            stood.append(i)
            i = after[i]
        return _columns(table.take(pa.array(stood, pa.int64())), names)

    return scan(rows, by, F.floor(F.col(at) / width), [at], summary, follow, emit, rows.schema)


def recovering(rows: DataFrame, by: list[str], at: str, constants: dict[str, tuple[float, float]], width: int, ties: list[str]) -> DataFrame:
    """rows with, for each (part used, time constant), what is available at the row: 1 at a key's first, and of what a row leaves the missing part goes down
    exponentially. Over a block that is a linear map of what was available before it."""
    use = np.array([u for u, _ in constants.values()])
    time, names = np.array([tau for _, tau in constants.values()]), rows.columns

    def steps(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        t = _numbers(table, at)
        return t, np.exp(-np.diff(t)[:, None] / time)

    def summary(table: pa.Table) -> Numbers:
        t, decay = steps(table)
        slope, missing = np.ones(len(use)), np.zeros(len(use))  # missing after the rows: slope * missing at the first + rest
        for d in decay:
            # 1 - missing is available; a row uses its part of that
            slope, missing = slope * (1 - use) * d, (missing * (1 - use) + use) * d
        return [t[0], t[-1], *slope, *missing]

    def left(state: Numbers | None, first: float) -> np.ndarray:
        """What is missing at a block's first row. A state is the last row's time and what was missing there."""
        if state is None:
            return np.zeros(len(use))
        return (np.array(state[1:]) * (1 - use) + use) * np.exp(-(first - state[0]) / time)

    def follow(state: Numbers | None, told: Numbers) -> Numbers:
        slope, rest = np.array(told[2:]).reshape(2, -1)
        return [told[1], *(slope * left(state, told[0]) + rest)]

    def emit(table: pa.Table, state: Numbers | None) -> pa.Table:
        t, decay = steps(table)
        out = np.empty((len(t), len(use)))
        if len(t):
            out[0] = left(state, t[0])
        for i, d in enumerate(decay):
            out[i + 1] = (out[i] * (1 - use) + use) * d
        return _columns(table, names, **{name: pa.array(1 - c) for name, c in zip(constants, out.T, strict=True)})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"`{n}` double" for n in constants)])
    return scan(rows, by, F.floor(F.col(at) / width), [at, *ties], summary, follow, emit, schema)
