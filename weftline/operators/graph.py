"""Building, storing and walking the weighted graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.config import SIGNALS, EdgeWeights


def minmax(raw: DataFrame) -> DataFrame:
    """Scores of each signal scaled to 0..1 (all 1 if they are equal); copies of a pair keep the best."""
    best = raw.groupBy("signal", "i", "j").agg(F.max("score").alias("score"))
    span = best.groupBy("signal").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))  # six rows at most
    norm = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return best.join(F.broadcast(span), "signal").select("signal", "i", "j", norm.alias("norm"))


def combine(raw: DataFrame, weights: EdgeWeights | None = None, floor: float = 0.1) -> DataFrame:
    """One row a pair: weight and the six normalised scores, pairs below the floor dropped.

    All signals are one long table and one aggregation, instead of six outer joins. The floor looks at the
    unrounded weight; what is stored is rounded to four places.
    """
    w = (weights or EdgeWeights()).as_dict()
    pairs = minmax(raw).groupBy("i", "j").agg(*(F.coalesce(F.max(F.when(F.col("signal") == s, F.col("norm"))), F.lit(0.0)).alias(s) for s in SIGNALS))
    weight = reduce(lambda a, b: a + b, (F.col(s) * w[s] for s in SIGNALS))
    kept = pairs.withColumn("weight", weight).where(F.col("weight") >= floor)
    return kept.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.bround("weight", 4).alias("weight"), *(F.bround(s, 4).alias(s) for s in SIGNALS))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))
    return edges.unionByName(back)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (id, degree) for all nodes, those without edges too."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def top_by_degree(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Nodes with most edges, ties to the smaller id."""
    return degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(limit)


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among members (id)."""
    src, dst = members.select(F.col("id").alias("src")), members.select(F.col("id").alias("dst"))
    return edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: numbers of nodes and edges, and whether there is anything."""
    n = nodes.agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.agg(F.count(F.lit(1)).alias("edge_count"))
    return n.crossJoin(e).withColumn("has_data", F.col("node_count") > 0)  # one row each


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 2, cap: int = 200) -> DataFrame:
    """Breadth-first candidates of each query: seeds (query_id, id) give rows (query_id, id, hop), cap rows a query.

    All queries walk at once: a hop is one join of the frontiers with the edges. Seeds count towards the cap,
    then come nearer hops, then smaller ids, so the cut is the same on every run.
    """
    both = symmetric(edges.select("src", "dst"))
    order = Window.partitionBy("query_id").orderBy("hop", "id")
    limited = lambda df: df.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cap).drop("nth")
    visited = limited(seeds.select("query_id", "id").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, hops + 1):
        frontier = visited.where(F.col("hop") == hop - 1).select("query_id", F.col("id").alias("src"))
        found = frontier.join(both, "src").select("query_id", F.col("dst").alias("id"), F.lit(hop).alias("hop"))
        visited = limited(visited.unionByName(found).groupBy("query_id", "id").agg(F.min("hop").alias("hop")))
    return visited


def shared_neighbours(edges: DataFrame) -> DataFrame:
    """Each node's neighbours as a sorted array."""
    return symmetric(edges.select("src", "dst")).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


class GraphTables:
    """A stored graph: nodes and edges as Parquet below one path, edges clustered by their first end.

    The two are written one after the other; whoever replaces a graph under readers writes a new path and then points
    to it, as IndexStore does.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, nodes: DataFrame, edges: DataFrame) -> None:
        nodes.write.mode("overwrite").parquet(f"{self.path}/nodes")
        edges.repartitionByRange("src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{self.path}/edges")

    def exists(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/edges/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    @property
    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/nodes")

    @property
    def edges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/edges")
