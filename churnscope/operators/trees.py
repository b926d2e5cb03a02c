"""The fitted trees as a table, and what can be worked out from it alone.

A boosted model is saved as one row per tree node.  :func:`node_table` reads
those rows; :func:`evaluate_nodes` scores rows by walking all trees level by
level with joins, and :func:`node_importances` sums the gains per input.  Both
use nothing of the model but its table, so they check the model's own scores
and importances.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.operators.model import model_inputs
from churnscope.session import fresh_path, materialize, remove_path

# Nodes (about 100 bytes each) of a model that goes to every task; a larger one is joined by a shuffle at every level.
BROADCAST_NODES = 200_000


def node_table(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """One row per node of the pipeline's boosted trees.

    ``tree, weight, node, left, right`` (both -1 at a leaf), ``feature`` (input
    slot), ``threshold`` (values up to it go left; null at a split by
    categories), ``categories`` (values that go left), ``gain, n`` (training
    rows) and ``prediction``.  The root is node 0.
    """
    path = fresh_path(spark, "boosted-trees")
    model.stages[-1].write().save(path)
    saved = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight").drop("metadata")
    by_value, given = F.col("split.numCategories") == -1, F.col("split.leftCategoriesOrThreshold")
    rows = materialize(saved.join(weights, "tree").select(
        "tree", "weight", F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.when(by_value, F.try_element_at(given, F.lit(1))).alias("threshold"),
        F.when(~by_value, given).alias("categories"), "gain", F.col("rawCount").alias("n"), "prediction"))
    remove_path(spark, path)
    return rows


def tree_depth(nodes: DataFrame) -> int:
    """Levels below the roots, by following the children level by level."""
    depth, front = 0, nodes.where("node = 0")
    children = nodes.select("tree", "node", "left", "right")
    while True:
        below = (front.where("left >= 0").select("tree", F.explode(F.array("left", "right")).alias("node"))
                 .join(children, ["tree", "node"]))
        front = materialize(below)
        if front.isEmpty():
            return depth
        depth += 1


def evaluate_nodes(nodes: DataFrame, rows: DataFrame, keys: Sequence[str], features: str = "features") -> DataFrame:
    """``keys, margin, probability_churn, prediction`` of every row.

    ``rows`` holds its inputs as an array; ``keys`` must name a row.  Every row
    stands at one node of each tree; a level is one equi-join with the node
    table, which is as large as the model, and rows stay at their leaf.  With at
    most ``BROADCAST_NODES`` nodes all levels are one pass over the rows, and
    only sums by key are shuffled.  ``nodes`` is read at every level: pass a
    table or a checkpointed frame.
    """
    shared = F.broadcast if nodes.count() <= BROADCAST_NODES else lambda table: table
    tree_numbers = nodes.where("node = 0").agg(F.sort_array(F.collect_list("tree"))).first()[0]
    at = rows.select(*keys, F.col(features).alias("inputs"), F.explode(F.array(*map(F.lit, tree_numbers))).alias("tree"), F.lit(0).alias("node"))
    for _ in range(tree_depth(nodes)):
        value = F.get("inputs", F.col("feature"))
        goes_left = F.when(F.col("categories").isNull(), value <= F.col("threshold")).otherwise(F.array_contains("categories", value))
        child = F.when(F.col("left") < 0, F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right"))
        splits = nodes.select("tree", "node", "left", "right", "feature", "threshold", "categories")
        at = at.join(shared(splits), ["tree", "node"]).select(*keys, "inputs", "tree", child.alias("node"))
    leaves = at.join(shared(nodes.select("tree", "node", "weight", F.col("prediction").alias("leaf"))), ["tree", "node"])
    margin = leaves.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("leaf")).alias("margin"))
    # the boosted margin is half the log odds
    return margin.select(*keys, "margin", (1.0 / (1.0 + F.exp(-2.0 * F.col("margin")))).alias("probability_churn"),
                         F.when(F.col("margin") > 0, 1.0).otherwise(0.0).alias("prediction"))


def node_importances(nodes: DataFrame) -> DataFrame:
    """``slot, importance``: gain times training rows over all splits of a slot, as a share of all slots'."""
    gains = nodes.where("left >= 0").groupBy(F.col("feature").alias("slot")).agg(F.sum(F.col("gain") * F.col("n")).alias("gain"))
    total = gains.agg(F.sum("gain").alias("total"))
    return gains.join(F.broadcast(total)).select("slot", (F.col("gain") / F.col("total")).alias("importance"))  # one row


def compared(model: PipelineModel, frame: DataFrame, scored: DataFrame, keys: Sequence[str] = ("loop_day", "customer_level")) -> DataFrame:
    """``keys, prediction, probability_churn`` of ``scored`` beside ``prediction_by_nodes, probability_by_nodes``."""
    nodes = node_table(frame.sparkSession, model)
    own = evaluate_nodes(nodes, model_inputs(model, frame), keys).select(
        *keys, F.col("prediction").alias("prediction_by_nodes"), F.col("probability_churn").alias("probability_by_nodes"))
    return scored.select(*keys, "prediction", "probability_churn").join(own, list(keys), "full")
