"""Queries on labels: edits, undo, sets of ids, classes, lineage and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import curation as C
from ..sources.adapters import feature_values, features, spikes, sql, table
from .registry import query


@query(sql("SELECT CASE WHEN cluster IN (3, 5, 7) THEN 3 WHEN cluster = 9 AND fet[1] > 0 THEN 10 WHEN cluster = 8 AND fet[2] < -1000 THEN 1 ELSE cluster END AS label, count(*) AS n, CAST(sum(spike_id) AS BIGINT) AS ids FROM features GROUP BY label", "features"))
def regroup_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Merge into the lowest id, make a cluster from a selection, send a selection to noise."""
    c, f = F.col("cluster"), F.col("fet")
    label = F.when(c.isin(3, 5, 7), 3).when((c == 9) & (f[0] > 0), 10).when((c == 8) & (f[1] < -1000), 1).otherwise(c)
    return features(spark, d).groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.sum("spike_id").alias("ids"))


@query("""WITH l AS (SELECT event_id AS seq, event_id % 500 AS spike_id, user_id AS label, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 = 0 AS undone FROM events)
    SELECT spike_id, arg_max(CASE WHEN NOT undone THEN label END, CASE WHEN NOT undone THEN seq END) AS label FROM l GROUP BY spike_id""")
def undo_log(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    log = table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 500).alias("spike_id"), F.col("user_id").alias("label"), (k % 4 == 0).alias("undone"))
    return C.replay(log)


EDGES = ", e AS (SELECT l_partkey % 400 AS a, 1000 + l_suppkey AS b FROM lineitem GROUP BY 1, 2 HAVING count(*) > 3)"


@query("WITH RECURSIVE " + EDGES[2:] + """, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM u UNION SELECT u.a, r.root FROM r JOIN u ON u.b = r.node)
    SELECT node, min(root) AS root FROM r GROUP BY node""")
def union_find(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 400).alias("a"), (1000 + F.col("l_suppkey")).alias("b")).agg(F.count("*").alias("n")).filter("n > 3")
    return C.groups(e)


@query("""WITH RECURSIVE n AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 50 <> 0 AND c_custkey <> 1 THEN c_custkey - 1 - c_custkey % 3 * CAST(c_custkey % 50 > 3 AS INT) END AS parent FROM customer),
    r AS (SELECT node, 0 AS depth, node AS top FROM n WHERE parent IS NULL UNION ALL SELECT n.node, r.depth + 1, r.top FROM n JOIN r ON n.parent = r.node) SELECT node, CAST(depth AS BIGINT) AS depth, top FROM r""")
def lineage_tree(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    parent = F.when(c % 50 != 0, c - 1 - F.when(c % 50 > 3, c % 3).otherwise(0))
    return C.tree_depths(table(spark, d, "customer").select(c.alias("node"), F.when(c != 1, parent).alias("parent")))


@query(sql(", u AS (SELECT cluster, t // 86400 % 3 AS part, grp FROM spikes) (SELECT DISTINCT cluster, part FROM u WHERE grp = 'click' INTERSECT SELECT cluster, part FROM u WHERE grp = 'view') EXCEPT SELECT cluster, part FROM u WHERE grp = 'error'", "spikes"))
def id_sets(spark: SparkSession, d: str) -> DataFrame:
    """Units with clicks and views but no errors, of every third day."""
    s = spikes(spark, d).withColumn("part", F.expr("t div 86400 % 3"))
    of = lambda g: s.filter(F.col("grp") == g).select("cluster", "part")
    return of("click").intersect(of("view")).subtract(of("error"))


@query(sql(""", b AS (SELECT spike_id, CASE WHEN cluster = 4 THEN 5 WHEN cluster = 6 AND spike_id % 2 = 0 THEN 11 ELSE cluster END AS cluster FROM features),
    m AS (SELECT unnest([f.cluster, b.cluster]) AS cluster FROM features f JOIN b USING (spike_id) WHERE f.cluster <> b.cluster)
    SELECT DISTINCT cluster, CASE WHEN cluster NOT IN (SELECT cluster FROM features) THEN 'new' WHEN cluster NOT IN (SELECT cluster FROM b) THEN 'gone' ELSE 'changed' END AS change FROM m""", "features"))
def changed_clusters(spark: SparkSession, d: str) -> DataFrame:
    before = features(spark, d).select("spike_id", "cluster")
    c = F.col("cluster")
    after = before.withColumn("cluster", F.when(c == 4, 5).when((c == 6) & (F.col("spike_id") % 2 == 0), 11).otherwise(c))
    return C.changed(before, after)


@query(sql(", h AS (SELECT spike_id, cluster AS child, CASE WHEN cluster = 5 AND spike_id % 9 = 0 THEN 1 ELSE cluster // 3 END AS parent FROM features) SELECT child, count(DISTINCT parent) AS parents, count(DISTINCT parent) = 1 AS valid, count(*) AS n FROM h GROUP BY child", "features"))
def hierarchy_check(spark: SparkSession, d: str) -> DataFrame:
    """Every child cluster has one parent."""
    h = features(spark, d).withColumn("parent", F.expr("CASE WHEN cluster = 5 AND spike_id % 9 = 0 THEN 1 ELSE cluster div 3 END"))
    k = F.count_distinct("parent")
    return h.groupBy(F.col("cluster").alias("child")).agg(k.alias("parents"), (k == 1).alias("valid"), F.count("*").alias("n"))


@query(sql(", c AS (SELECT cluster, count(*) AS n FROM spikes GROUP BY cluster) SELECT cluster, n, coalesce(c_mktsegment, 'unrated') AS note FROM c LEFT JOIN customer ON c_custkey = cluster AND c_acctbal > 0", "spikes"))
def annotated_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters with the user's note, or the default."""
    notes = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("cluster"), "c_mktsegment")
    c = spikes(spark, d).groupBy("cluster").agg(F.count("*").alias("n"))
    return c.join(notes, "cluster", "left").select("cluster", "n", F.coalesce("c_mktsegment", F.lit("unrated")).alias("note"))


@query("SELECT regexp_replace(event_type, '^(click|view)$', 'ui_\\1') AS label, count(*) AS n FROM events GROUP BY label")
def rename_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.regexp_replace("event_type", "^(click|view)$", "ui_$1").alias("label")).agg(F.count("*").alias("n"))


@query(sql(""", m AS (SELECT spike_id, d % 6 AS class, CASE WHEN abs(x) > 2000 THEN x // 1000 END AS off FROM fx), g AS (SELECT spike_id, CASE WHEN class = 5 THEN 4 ELSE class END AS class, min(off) AS off FROM m WHERE off IS NOT NULL AND class <> 3 GROUP BY ALL)
    SELECT class, count(*) AS members, CAST(sum(off) AS BIGINT) AS offsets FROM g GROUP BY class""", "fx"))
def class_membership(spark: SparkSession, d: str) -> DataFrame:
    """A multi-label bridge table with a class deleted and two merged."""
    m = feature_values(spark, d).select("spike_id", (F.col("d") % 6).alias("class"), F.when(F.abs("x") > 2000, F.expr("x div 1000")).alias("off"))
    g = m.filter("off IS NOT NULL AND class <> 3").withColumn("class", F.when(F.col("class") == 5, 4).otherwise(F.col("class"))).groupBy("spike_id", "class").agg(F.min("off").alias("off"))
    return g.groupBy("class").agg(F.count("*").alias("members"), F.sum("off").alias("offsets"))


@query(sql(""", v AS (SELECT * FROM (VALUES (0, -900.0, -1100.0), (1, 1000.0, -700.0), (2, 200.0, 100.0), (3, 900.0, 1300.0), (4, -700.0, 1200.0)) v(i, x, y)), e AS (SELECT a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM v a JOIN v b ON b.i = (a.i + 1) % 5)
    SELECT spike_id, cluster, fet[1] AS x, fet[2] AS y FROM features, e GROUP BY ALL HAVING count(*) FILTER ((y0 > fet[2]) <> (y1 > fet[2]) AND fet[1] < (x1 - x0) * (fet[2] - y0) / (y1 - y0) + x0) % 2 = 1""", "features"))
def polygon_selection(spark: SparkSession, d: str) -> DataFrame:
    """Spikes within a polygon, not convex, of two features."""
    x, y = F.get("fet", 0), F.get("fet", 1)
    return features(spark, d).filter(C.inside(x, y, [(-900, -1100), (1000, -700), (200, 100), (900, 1300), (-700, 1200)])).select("spike_id", "cluster", x.alias("x"), y.alias("y"))


@query(sql("SELECT cluster, count(*) FILTER (len(fet) <> 64) AS short, count(*) FILTER (cluster < 0 OR cluster > 16777115) AS reserved, count(*) FILTER (list_max(list_transform(fet, lambda x: abs(x))) > 32767) AS saturated, count(*) AS n FROM features GROUP BY cluster", "features"))
def corruption_report(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d)
    large = F.array_max(F.transform("fet", lambda x: F.abs(x))) > 32767
    return f.groupBy("cluster").agg(F.count_if(F.size("fet") != 64).alias("short"), F.count_if((F.col("cluster") < 0) | (F.col("cluster") > 16777115)).alias("reserved"), F.count_if(large).alias("saturated"), F.count("*").alias("n"))


MERGE = """, m AS (SELECT cluster, d, avg(x) AS m FROM fx GROUP BY cluster, d), n AS (SELECT cluster, count(*) AS n FROM features GROUP BY cluster), p AS (SELECT a.cluster AS a, b.cluster AS b, sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)) AS c, sqrt(sum((a.m - b.m) ** 2)) AS gap FROM m a JOIN m b ON a.d = b.d AND a.cluster < b.cluster GROUP BY ALL)"""


@query(sql(MERGE + "SELECT p.a, p.b, round(c, 6) AS cosine, round(gap, 3) AS gap, CASE WHEN c >= 0.2 AND x.n >= 40 AND y.n >= 40 THEN 'auto' WHEN c >= 0.05 THEN 'oversplit' WHEN c >= -0.05 THEN 'review' ELSE 'keep' END AS tier FROM p JOIN n x ON x.cluster = p.a JOIN n y ON y.cluster = p.b", "fx"))
def merge_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of clusters by how far they may be merged."""
    m = feature_values(spark, d).groupBy("cluster", "d").agg(F.avg("x").alias("m"))
    n = features(spark, d).groupBy("cluster").agg(F.count("*").alias("n"))
    a, b = m.select("d", F.col("cluster").alias("a"), F.col("m").alias("ma")), m.select("d", F.col("cluster").alias("b"), F.col("m").alias("mb"))
    ma, mb = F.col("ma"), F.col("mb")
    p = a.join(b, "d").filter("a < b").groupBy("a", "b").agg((F.sum(ma * mb) / F.sqrt(F.sum(ma * ma) * F.sum(mb * mb))).alias("c"), F.sqrt(F.sum((ma - mb) * (ma - mb))).alias("gap"))
    p = p.join(n.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b")
    c = F.col("c")
    tier = F.when((c >= 0.2) & (F.col("na") >= 40) & (F.col("nb") >= 40), "auto").when(c >= 0.05, "oversplit").when(c >= -0.05, "review").otherwise("keep")
    return p.select("a", "b", F.round("c", 6).alias("cosine"), F.round("gap", 3).alias("gap"), tier.alias("tier"))


@query(sql(MERGE + ", r AS (SELECT a, b, row_number() OVER (ORDER BY round(c, 9) DESC, a, b) AS k, c FROM p) SELECT a, b, CAST(k AS BIGINT) AS k, round(c, 6) AS cosine FROM r WHERE k <= 10", "fx"))
def top_merges(spark: SparkSession, d: str) -> DataFrame:
    """The ten most alike pairs of clusters: a report."""
    pairs = merge_tiers(spark, d)
    top = pairs.orderBy(F.desc("cosine"), "a", "b").limit(10)
    return top.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("cosine"), "a", "b")).cast("long")).select("a", "b", "k", "cosine")
