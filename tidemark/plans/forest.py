"""The fitted forest as a table of nodes, and scoring by joins with it.

Spark ML stores a forest's nodes as Parquet beside its settings. Read as a table
(tree, node, feature, threshold, left, right, p), a score is relational: every
(session, tree) starts at node 0 and follows its feature's comparison, one join
with the nodes a level, until a leaf; the mean of the leaves' shares over the
trees is the probability. That is another way to the numbers of
``ml.score_sessions`` and a form of the model that any SQL engine can run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import ml
from tidemark.sources import versions

#: Nodes that may be broadcast; beyond that the joins shuffle.
MAX_BROADCAST_NODES = 500_000


def _stage(spark: SparkSession, model_path: str, kind: str) -> str:
    names = [n for n in versions.children(spark, f"{model_path}/stages") if kind in n]
    if len(names) != 1:
        raise ValueError(f"{model_path} has {len(names)} stages of {kind}")
    return f"{model_path}/stages/{names[0]}/data"


def forest_nodes(spark: SparkSession, model_path: str) -> DataFrame:
    """tree, node, feature (-1 at a leaf), threshold (left up to it), left,
    right, and p, the share of label 1 among the node's weighted rows."""
    n = F.col("nodeData")
    total = F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(_stage(spark, model_path, "RandomForest")).select(
        F.col("treeID").alias("tree"),
        n["id"].alias("node"),
        n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        n["leftChild"].alias("left"),
        n["rightChild"].alias("right"),
        F.coalesce(F.try_divide(F.get(n["impurityStats"], F.lit(1)), total), F.lit(0.0)).alias("p"),
    )


def scaling(spark: SparkSession, model_path: str) -> tuple[list[float], list[float]]:
    """Mean and deviation of each feature (one row)."""
    row = spark.read.parquet(_stage(spark, model_path, "StandardScaler")).first()
    return [float(x) for x in row["mean"]], [float(x) for x in row["std"]]


def score_by_nodes(features: DataFrame, nodes: DataFrame, mean: list[float], deviation: list[float], depth: int = ml.MAX_DEPTH) -> DataFrame:
    """session_id and p_abandoned, by ``depth`` joins with ``nodes``."""
    n_nodes, n_trees = nodes.agg(F.count(F.lit(1)), F.count_distinct("tree")).first()
    nodes = F.broadcast(nodes) if n_nodes <= MAX_BROADCAST_NODES else nodes
    scaled = [
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(m)) * F.lit(1.0 / d if d else 0.0)
        for c, m, d in zip(ml.FEATURES, mean, deviation, strict=True)
    ]
    at = features.select(
        "session_id", F.array(*scaled).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"), F.lit(0).alias("node")
    )
    for _ in range(depth):
        value = F.get("x", F.col("feature"))
        step = F.when(F.col("feature") < 0, F.col("node")).when(value <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = at.join(nodes, ["tree", "node"]).select("session_id", "x", "tree", step.alias("node"))
    leaf = at.join(nodes.select("tree", "node", "p"), ["tree", "node"])
    return leaf.groupBy("session_id").agg((F.sum("p") / n_trees).alias("p_abandoned"))
