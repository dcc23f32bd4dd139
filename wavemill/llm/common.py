"""What the operators of this subpackage share: words, shared storage, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


U = np.uint64


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        """The hashes of a text's words in lower case (A-Z). Bytes split at the six ASCII white-space characters alone."""
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, found), U, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(29))


def words(text: Column) -> Column:
    """The words of a text in order; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session on one machine (tests)
    gets a folder of its own; on a cluster, whose machines could not see it, that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
        if not path and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = path or Path(tempfile.mkdtemp(prefix="wavemill-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Workspace:
    """Tables written for one run in the shared folder. They cut lineage, so a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it again."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._workspace_path)
            path.getFileSystem(conf).delete(path, True)


def components(ws: Workspace, links: DataFrame) -> DataFrame:
    """Connected components of links(a, b): rows (node, root) for every node with a link, root the smallest node reachable.

    Minimum labels travel along links and then jump to the label's own label, so the number of
    rounds follows the logarithm of the longest path. Every round is a join of two stored tables
    (a hot node's links can be split among tasks) and a minimum that combines before it shuffles.
    Self-links are allowed; nulls are not.
    """
    both = ws.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = ws.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(label, both.b == label.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        near = ws.save(label.join(near, "node").select("node", F.least("root", "seen").alias("to"), (F.col("seen") < F.col("root")).alias("moved")), "near")
        jump = near.select(F.col("node").alias("to"), F.col("to").alias("further"))
        new = ws.save(near.join(jump, "to").select("node", F.least("to", "further").alias("root"), (F.col("moved") | (F.col("further") < F.col("to"))).alias("moved")), "labels")
        moved = not new.filter("moved").isEmpty()
        ws.drop(label, near)
        label = new
        if not moved:
            ws.drop(both)
            return label.select("node", "root")
