"""Spike files: times, labels, features, waveforms and events, read by Spark and parsed in Arrow batches.

A file's rows keep their number, by which the parallel files of a group are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges


def _parsed(spark: SparkSession, path: str, parse, fields: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield parse(content).assign(path=name)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, fields + ", path string")


def is_binary(content: bytes) -> bool:
    """Times are binary if the size is a multiple of 8 and something near the start can't be in a text of numbers."""
    return bool(content) and len(content) % 8 == 0 and not set(content[:4096]) <= set(b"0123456789+-.eE \t\r\n")


def times(spark: SparkSession, path: str) -> DataFrame:
    """spike_id, t of 64-bit binary or text files."""

    def parse(content: bytes) -> pd.DataFrame:
        t = np.frombuffer(content, "<i8") if is_binary(content) else np.array(content.split(), np.int64)
        return pd.DataFrame({"spike_id": np.arange(len(t)), "t": t})

    return _parsed(spark, path, parse, "spike_id long, t long")


def labels(spark: SparkSession, path: str, binary: bool = True) -> DataFrame:
    """spike_id, cluster of files that begin with the number of clusters."""

    def parse(content: bytes) -> pd.DataFrame:
        x = (np.frombuffer(content, "<i4") if binary else np.array(content.split(), np.int64))[1:]
        return pd.DataFrame({"spike_id": np.arange(len(x)), "cluster": x.astype(np.int64)})

    return _parsed(spark, path, parse, "spike_id long, cluster long")


def features(spark: SparkSession, path: str) -> DataFrame:
    """spike_id, fet of binary files: a 32-bit width, then rows of 64-bit numbers, the time last."""

    def parse(content: bytes) -> pd.DataFrame:
        width = int(np.frombuffer(content[:4], "<i4")[0])
        x = np.frombuffer(content[4:], "<i8").reshape(-1, width)
        return pd.DataFrame({"spike_id": np.arange(len(x)), "fet": list(x)})

    return _parsed(spark, path, parse, "spike_id long, fet array<long>")


def waveforms(spark: SparkSession, path: str, samples: int, channels: int) -> DataFrame:
    """spike_id, waveform (sample-major) of 16-bit files; a file that does not hold whole records is refused."""

    def parse(content: bytes) -> pd.DataFrame:
        if len(content) % (2 * samples * channels):
            raise ValueError("not whole waveforms")
        x = np.frombuffer(content, "<i2").reshape(-1, samples * channels)
        return pd.DataFrame({"spike_id": np.arange(len(x)), "waveform": list(x)})

    return _parsed(spark, path, parse, "spike_id long, waveform array<short>")


def signal(spark: SparkSession, path: str, channels: int) -> DataFrame:
    """sample, xs of an interleaved 16-bit file, by byte ranges; one that does not hold whole samples is refused."""
    return ranges.read(spark, path, "dat", channels=channels)


def events(spark: SparkSession, path: str) -> DataFrame:
    """t_ms, label of tab-separated text."""
    return spark.read.csv(path, sep="\t", schema="t_ms double, label string")


def write_events(rows: DataFrame, path: str) -> None:
    rows.select(F.format_string("%.6f", "t_ms"), "label").write.csv(path, sep="\t")


#: What of a path its parallel files share: the group's number stays, the kind goes.
STEM = r"\.(?:res|clu|fet|spk)(?=(?:\.\d+)?$)"


def paired(spike_times: DataFrame, spike_labels: DataFrame) -> DataFrame:
    """stem, spike_id, t, cluster: times and labels of parallel files by row number; files of different lengths are refused, not cut."""
    stem = F.regexp_replace("path", STEM, "").alias("stem")
    t, c = spike_times.select(stem, "spike_id", "t"), spike_labels.select(stem, "spike_id", "cluster")
    n = t.groupBy("stem").agg(F.count("*").alias("times")).join(c.groupBy("stem").agg(F.count("*").alias("labels")), "stem", "full")
    for r in n.filter("NOT times <=> labels").limit(1).collect():
        raise ValueError(f"{r['times'] or 0} times but {r['labels'] or 0} labels in {r['stem']}")
    return t.join(c, ["stem", "spike_id"])


def _lines(spark: SparkSession, path: str, kind: str, separator: str) -> DataFrame:
    """The fields of a text table's rows: those whose first field is `kind`, or a number where kind is empty. Headers and comments go."""
    fields = F.split(F.trim("value"), separator).alias("f")
    first = F.col("f")[0]
    return spark.read.text(path).select(fields).filter(first == kind if kind else first.rlike(r"^\d+$"))


def class_registry(spark: SparkSession, path: str) -> DataFrame:
    """col, status, into, label, provenance_clu, provenance_stage, created of a table of template classes, separated by tabs; `-` is null.

    The status merged:N gives merged and, in into, the class that took it up.
    """
    f = _lines(spark, path, "", "\t")
    at = lambda i: F.nullif(F.get("f", i), F.lit("-"))
    parts = F.split(at(1), ":")
    return f.select(
        at(0).cast("int").alias("col"), parts[0].alias("status"), F.get(parts, 1).cast("int").alias("into"), at(2).alias("label"),
        at(3).cast("int").alias("provenance_clu"), at(4).alias("provenance_stage"), at(5).cast("date").alias("created"),
    )


def template_index(spark: SparkSession, path: str) -> DataFrame:
    """row, unit, link, bin, a, b, n_spikes, parent of an index of templates, of either version; -1 and what version 1 lacks is null. Fields behind are ignored."""
    at = lambda i: F.get("f", i)
    parent = F.nullif(F.try_element_at("f", F.lit(9)).try_cast("int"), F.lit(-1))
    return _lines(spark, path, "row", r"\s+").select(
        at(1).cast("int").alias("row"), at(2).cast("int").alias("unit"), at(3).alias("link"), at(4).cast("int").alias("bin"),
        at(5).cast("double").alias("a"), at(6).cast("double").alias("b"), at(7).cast("long").alias("n_spikes"), parent.alias("parent"),
    )


def template_lineage(spark: SparkSession, path: str) -> DataFrame:
    """node, class, kind, parent, a, b, n_spikes and spikes (of version 1, else empty) of a forest of templates; a root's parent is null."""
    at = lambda i: F.get("f", i)
    return _lines(spark, path, "node", r"\s+").select(
        at(1).cast("int").alias("node"), at(2).cast("int").alias("class"), at(3).alias("kind"), F.nullif(at(4).cast("int"), F.lit(-1)).alias("parent"),
        at(5).cast("double").alias("a"), at(6).cast("double").alias("b"), at(7).cast("long").alias("n_spikes"), F.slice("f", 9, F.greatest(F.size("f") - 8, F.lit(0))).cast("array<long>").alias("spikes"),
    )


def series(index: DataFrame) -> DataFrame:
    """unit, link, rows, bins: the templates of each unit and kind of link in the order of their bins."""
    held = F.array_sort(F.collect_list(F.struct("bin", "row"))).alias("h")
    return index.groupBy("unit", "link").agg(held).select("unit", "link", F.transform("h", lambda x: x["row"]).alias("rows"), F.transform("h", lambda x: x["bin"]).alias("bins"))


def children(lineage: DataFrame) -> DataFrame:
    """node, class, children (in order; none for a leaf) of every node of a forest."""
    below = lineage.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.sort_array(F.collect_list("node")).alias("children"))
    return lineage.select("node", "class").join(below, "node", "left").withColumn("children", F.coalesce("children", F.array().cast("array<int>")))
