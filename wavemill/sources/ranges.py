"""Binary spike files by byte ranges: one file is read by many tasks, and written by many.

A file is a header and records of one length, so a range of rows is a range of bytes. A directory of parts (part-...) written here is one file in the order of their
names: joined end to end they are it, byte for byte. Filters on the row number choose bytes; of a signal, `channels` chooses what of a record becomes a column.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Kind of file -> name of the row number, of the value and its type, and how a value is stored. All are little-endian.
KINDS = {
    "dat": ("sample", "xs", "array<short>", "<i2"),
    "dat32": ("sample", "xs", "array<int>", "<i4"),
    "res": ("spike_id", "t", "long", "<i8"),
    "clu": ("spike_id", "cluster", "long", "<i4"),
    "fet": ("spike_id", "fet", "array<long>", "<i8"),
    "spk": ("spike_id", "waveform", "array<short>", "<i2"),
}
#: Kinds that begin with a 32-bit number: the number of clusters, or of a row's values.
HEADED = ("clu", "fet")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, local or one that Arrow knows, and the path in it."""
    if re.match(r"[a-z0-9]+:/", path):
        if path.startswith("file:"):
            return fs.LocalFileSystem(), urlparse(path).path
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def _bytes(path: str, start: int, length: int) -> bytes:
    store, name = _open(path)
    with store.open_input_file(name) as f:
        f.seek(start)
        return f.read(length)


@dataclass(frozen=True)
class Layout:
    """kind of file, and how many values a record has."""

    kind: str
    values: int

    @property
    def record(self) -> int:
        return self.values * np.dtype(KINDS[self.kind][3]).itemsize

    def column(self, raw: bytes, pick: list[int] | None) -> pa.Array:
        """Records as a column."""
        x = np.frombuffer(raw, KINDS[self.kind][3])
        if not KINDS[self.kind][2].startswith("array"):
            return pa.array(x.astype(np.int64))
        x = x.reshape(-1, self.values)
        x = x[:, pick] if pick is not None else x
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))

    def raw(self, column: pa.Array) -> bytes:
        """A column as records. Values that the file cannot hold, nulls and records of another length are refused."""
        store = KINDS[self.kind][3]
        if column.null_count:
            raise ValueError("a null has no place in a file of numbers")
        if pa.types.is_list(column.type):
            lengths = np.diff(column.offsets.to_numpy())
            if (lengths != self.values).any():
                raise ValueError(f"a record of {self.values} values has {lengths[lengths != self.values][0]}")
            column = column.flatten()
            if column.null_count:
                raise ValueError("a null has no place in a file of numbers")
        x = column.to_numpy(zero_copy_only=False)
        y = x.astype(store)
        if (y != x).any():
            raise ValueError(f"{x[y != x][0]} does not fit")
        return y.tobytes()


@dataclass
class Part:
    """A file, or a part of one: how long its header is, and its rows' numbers from..to in the whole."""

    path: str
    skip: int
    first: int
    rows: int


def _parts(path: str) -> list[tuple[str, int]]:
    store, name = _open(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = [f for f in store.get_file_info(fs.FileSelector(name)) if os.path.basename(f.path).startswith("part-")]
    return [(f"{path.rstrip('/')}/{os.path.basename(f.path)}", f.size) for f in sorted(found, key=lambda f: f.path)]


def layout(path: str, options: dict) -> tuple[Layout, list[Part]]:
    """The layout and parts of a file. One that does not hold whole records is refused."""
    kind = options["kind"]
    found = _parts(path)
    head = 4 if kind in HEADED else 0
    if head and (not found or found[0][1] < head):
        raise ValueError(f"{path} has no header")
    if kind == "fet":
        values = int(np.frombuffer(_bytes(found[0][0], 0, 4), "<i4")[0])
    elif kind == "spk":
        values = int(options["samples"]) * int(options["channels"])
    else:
        values = int(options["channels"]) if kind in ("dat", "dat32") else 1
    if values < 1:
        raise ValueError(f"{path}: records of {values} values")
    own, out, first = Layout(kind, values), [], 0
    for i, (name, size) in enumerate(found):
        skip = head if i == 0 else 0
        rows, rest = divmod(size - skip, own.record)
        if rest:
            raise ValueError(f"{name} ends within a record of {own.record} bytes")
        out.append(Part(name, skip, first, rows))
        first += rows
    return own, out


class Range(InputPartition):
    def __init__(self, path: str, start: int, first: int, rows: int):
        self.path, self.start, self.first, self.rows = path, start, first, rows


class Reader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path, self.options = path, options
        self.low, self.high = int(options.get("start", 0)), float("inf")
        if "count" in options:
            self.high = self.low + int(options["count"])
        self.pick = [int(c) for c in options["pick"].split(",")] if options.get("pick") else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the row number choose the bytes that are read; Spark sees to the other filters."""
        for f in filters:
            if not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) or f.attribute != (KINDS[self.options["kind"]][0],):
                yield f
                continue
            v = int(f.value)
            if isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan):
                self.low = max(self.low, v + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThanOrEqual | LessThan):
                self.high = min(self.high, v + (not isinstance(f, LessThan)))

    def partitions(self) -> list[Range]:
        own, parts = layout(self.path, self.options)
        each = max(1, int(self.options.get("bytes", 64 << 20)) // own.record)
        out = []
        for p in parts:
            at, end = max(p.first, self.low), min(p.first + p.rows, self.high)
            while at < end:
                n = int(min(each, end - at))
                out.append(Range(p.path, p.skip + (at - p.first) * own.record, at, n))
                at += n
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        own, _ = layout(self.path, self.options)
        number, value, *_ = KINDS[own.kind]
        store, name = _open(part.path)
        step = max(1, (4 << 20) // own.record)
        with store.open_input_file(name) as f:
            f.seek(part.start)
            for at in range(0, part.rows, step):
                n = min(step, part.rows - at)
                raw = f.read(n * own.record)
                if len(raw) != n * own.record:
                    raise ValueError(f"{part.path} became shorter while it was read")
                ids = pa.array(np.arange(part.first + at, part.first + at + n))
                yield pa.RecordBatch.from_arrays([ids, own.column(raw, self.pick)], names=[number, value])


class Written(WriterCommitMessage):
    def __init__(self, name: str, first: int | None, rows: int):
        self.name, self.first, self.rows = name, first, rows


class Writer(DataSourceArrowWriter):
    """Each task writes the rows of its range to a part; the parts take their final names together, once all are there, and until then nobody sees them."""

    def __init__(self, path: str, options: dict):
        self.path, self.options = path, options
        self.own = Layout(options["kind"], int(options.get("values", 1)))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        import uuid

        from pyspark import TaskContext

        number, value, *_ = KINDS[self.own.kind]
        name = f".{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        store, base = _open(self.path)
        store.create_dir(base, recursive=True)
        first, rows = None, 0
        with store.open_output_stream(f"{base}/{name}") as f:
            for batch in batches:
                ids = batch.column(batch.schema.get_field_index(number)).to_numpy()
                if not len(ids):
                    continue
                first = int(ids[0]) if first is None else first
                if (ids != np.arange(first + rows, first + rows + len(ids))).any():
                    raise ValueError(f"{number} has gaps or repetitions")
                f.write(self.own.raw(batch.column(batch.schema.get_field_index(value))))
                rows += len(ids)
        return Written(name, first, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _open(self.path)
        done = [m for m in messages if m]
        held = sorted((m for m in done if m.rows), key=lambda m: m.first)
        at = 0
        for m in held:
            if m.first != at:
                self.abort(messages)
                raise ValueError(f"rows {at} to {m.first} are missing")
            at += m.rows
        if self.own.kind in HEADED:
            with store.open_output_stream(f"{base}/.head") as f:
                f.write(np.array([int(self.options["header"])], "<i4").tobytes())
            store.move(f"{base}/.head", f"{base}/part-000000-head")
        for k, m in enumerate(held):
            store.move(f"{base}/{m.name}", f"{base}/part-{k + 1:06d}")
        for m in done:
            if not m.rows:
                store.delete_file(f"{base}/{m.name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _open(self.path)
        for m in messages:
            if m and store.get_file_info(f"{base}/{m.name}").type == fs.FileType.File:
                store.delete_file(f"{base}/{m.name}")


class SpikeFiles(DataSource):
    """Format `spikefile`. Options: kind (dat, dat32, res, clu, fet, spk); channels and samples of a record; start and count, rows to read; pick, channels of a signal to read, as 0,2,...; bytes of a
    partition. To write: values of a record and header."""

    @classmethod
    def name(cls) -> str:
        return "spikefile"

    def schema(self) -> str:
        number, value, kind, _ = KINDS[self.options["kind"]]
        return f"{number} long, {value} {kind}"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], dict(self.options))


def read(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """The rows of a binary file or of a directory of its parts: the row's number and its value. A missing file and one with a broken record are errors; an empty one has no rows."""
    spark.dataSource.register(SpikeFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("spikefile").options(kind=kind, **options).load(path)


def write(rows: DataFrame, path: str, kind: str, parts: int | None = None) -> None:
    """rows(number, value) as a directory of parts, in ranges of the row's number, which goes from 0 without gaps. Refused: nulls, gaps, records of different lengths and values that do not fit.

    The header of labels is the number of clusters, that of features the number of a row's values, here an extra part.
    """
    number, value, shape, _ = KINDS[kind]
    store, name = _open(path)
    if store.get_file_info(name).type != fs.FileType.NotFound and _parts(path):
        raise FileExistsError(path)
    spark = rows.sparkSession
    spark.dataSource.register(SpikeFiles)
    options = {"kind": kind}
    if shape.startswith("array"):
        sizes = rows.agg(F.min(F.size(value)), F.max(F.size(value))).first()
        if sizes[0] != sizes[1]:
            raise ValueError(f"records of {sizes[0]} to {sizes[1]} values")
        options["values"] = sizes[0] or 1
        options["header"] = options["values"]
    if kind == "clu":
        options["header"] = rows.select(value).distinct().count()
    held = rows.select(F.col(number).cast("long").alias(number), F.col(value).cast(shape).alias(value))
    if held.filter(F.col(number).isNull() | F.col(value).isNull()).limit(1).count():
        raise ValueError("a null has no place in a file of numbers")
    ordered = held.repartitionByRange(parts or spark.sparkContext.defaultParallelism, number).sortWithinPartitions(number)
    ordered.write.format("spikefile").options(**{k: str(v) for k, v in options.items()}).mode("append").save(path)


def channel_list(text: str, channels: int) -> list[int]:
    """The channels of a list like 0,4,4,1, in its order. A slice is taken as it is, so anything but plain numbers of channels that there are is refused."""
    out = []
    for token in text.split(","):
        if not re.fullmatch("[0-9]+", token):
            raise ValueError(f"{token!r} is no plain number of a channel")
        if int(token) >= channels:
            raise ValueError(f"channel {token} of {channels}, numbered from 0")
        out.append(int(token))
    return out


def sliced(spark: SparkSession, path: str, out: str, channels: int, pick: str, start: int = 0, count: int | None = None, bits: int = 16) -> None:
    """A signal's chosen channels, repeated or in another order if so listed, and `count` of its samples from `start` on, byte for byte. Samples that are not there, and files
    with a broken record, are refused. Every task reads its range and writes its part."""
    kind = {16: "dat", 32: "dat32"}[bits]
    chosen = channel_list(pick, channels)
    _, parts = layout(path, {"kind": kind, "channels": channels})
    there = sum(p.rows for p in parts)
    count = there - start if count is None else count
    if start < 0 or count < 0 or start + count > there:
        raise ValueError(f"samples {start} to {start + count} of {there}")
    rows = read(spark, path, kind, channels=channels, start=start, count=count, pick=",".join(map(str, chosen)))
    write(rows.withColumn("sample", F.col("sample") - start), out, kind)


def joined(path: str, out: str) -> None:
    """The parts of a directory as one file, as a stream."""
    store, target = _open(out)
    with store.open_output_stream(target) as f:
        for name, _ in _parts(path):
            source, own = _open(name)
            with source.open_input_stream(own) as part:
                while raw := part.read(8 << 20):
                    f.write(raw)
