"""Tables in the engine's data model: spikes, features, waveforms, traces, events and intervals.

The driver's tables stand in for recordings. Times are whole seconds, amplitudes whole numbers, so that sums do
not depend on their order. Sessions, shank groups and clusters partition every window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spike_id, t (seconds), cluster, grp, value. The clock fields are read as they stand, whatever the session's time zone."""
    seconds = F.expr("CAST(date_diff(CAST(ts AS DATE), DATE'1970-01-01') AS BIGINT) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT)")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("spike_id"), seconds.alias("t"), F.col("user_id").alias("cluster"), F.col("event_type").alias("grp"), "value")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spike_id, fet (whole numbers), cluster."""
    fet = F.transform("embedding", lambda x: F.round(x.cast("double") * 10000).cast("long"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spike_id"), fet.alias("fet"), F.col("label").cast("long").alias("cluster"))


def feature_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spike_id, cluster, d, x: one row per dimension."""
    return features(spark, sf_dir).select("spike_id", "cluster", F.posexplode("fet").alias("d", "x")).withColumn("d", F.col("d").cast("long"))


#: Samples and channels of a waveform; its values are sample-major.
SAMPLES = CHANNELS = 8


def waveform_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spike_id, cluster, s (sample), ch, x of every waveform."""
    return feature_values(spark, sf_dir).select("spike_id", "cluster", F.expr(f"d div {CHANNELS}").alias("s"), F.expr(f"d % {CHANNELS}").alias("ch"), "x")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, sample, xs (four channels): samples are numbered within their session.

    The session has its name before rows are dealt by it, so that windows over it and its blocks find them dealt; what is dealt are the table's own narrow columns.
    """
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "session")
    order = Window.partitionBy("session").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    xs = F.expr("array(CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice / 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT))")
    return rows.withColumn("sample", (F.row_number().over(order) - 1).cast("long")).select("session", "sample", xs.alias("xs"))


def trace_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, sample, ch, x."""
    return traces(spark, sf_dir).select("session", "sample", F.posexplode("xs").alias("ch", "x")).withColumn("ch", F.col("ch").cast("long"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, grp, a, b: the day interval [a, b) of each customer's orders, grouped by the remainder of the customer's number."""
    day = F.expr("CAST(date_diff(CAST(o_orderdate AS DATE), DATE'1970-01-01') AS BIGINT)")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min(day).alias("a"), (F.max(day) + 1).alias("b")).withColumn("grp", F.col("id") % 20)


#: The same tables for DuckDB, as common table expressions.
SQL = {
    "spikes": "spikes AS (SELECT event_id AS spike_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS t, user_id AS cluster, event_type AS grp, value FROM events)",
    "features": "features AS (SELECT vec_id AS spike_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT)) AS fet, CAST(label AS BIGINT) AS cluster FROM embeddings)",
    "fx": "fx AS (SELECT spike_id, cluster, unnest(fet) AS x, unnest(range(0, len(fet))) AS d FROM features)",
    "wx": "wx AS (SELECT spike_id, cluster, d // 8 AS s, d % 8 AS ch, x FROM fx)",
    "traces": "traces AS (SELECT l_suppkey AS session, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS sample, [CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice / 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT)] AS xs FROM lineitem)",
    "tx": "tx AS (SELECT session, sample, unnest(xs) AS x, unnest(range(0, 4)) AS ch FROM traces)",
    "intervals": "intervals AS (SELECT o_custkey AS id, min(CAST(o_orderdate AS DATE) - DATE '1970-01-01') AS a, max(CAST(o_orderdate AS DATE) - DATE '1970-01-01') + 1 AS b, o_custkey % 20 AS grp FROM orders GROUP BY o_custkey)",
}
_NEEDS = {"fx": ["features"], "wx": ["features", "fx"], "tx": ["traces"]}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """body with the named tables (and what they need) before it; body may begin with more of them, after a comma."""
    wanted = list(dict.fromkeys(x for n in names for x in [*_NEEDS.get(n, []), n]))
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(SQL[n] for n in wanted) + " " + body
