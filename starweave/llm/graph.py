"""Connected components by hooking and shortcutting, over tables only.

Each round every node takes the smallest label among its own, its neighbours' and, by hooking, those its tree's root
hears of; then labels are shortcut (a label becomes its label's label). The number of rounds is logarithmic in
practice, and a round's tables are written to the shared folder, so lineage stays short. Joins are plain equi-joins of
two tables, which Spark can split where a label is held by many nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.llm.common import discard, keep


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, root) for each node of ``edges`` (src, dst longs); root is the component's smallest node.

    Self loops and repeated edges are allowed; nodes without an edge do not appear. An empty table gives none.
    """
    both = edges.where("src != dst").distinct()
    both = keep(both.union(both.select("dst", "src")).toDF("u", "v").distinct(), "edges")
    first = both.groupBy("u").agg(F.min("v").alias("m"))
    labels = keep(first.select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("heard"))
        heard = keep(labels.join(heard, labels["node"] == heard["u"]).select("node", "root", F.least("root", "heard").alias("heard")), "heard")
        hooked = heard.groupBy(F.col("root").alias("node")).agg(F.min("heard").alias("hook"))
        told = keep(heard.join(hooked, "node", "left").select("node", F.least("heard", "hook").alias("root"), F.col("root").alias("was")), "told")
        up = told.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = keep(told.join(up, "root").select("node", F.least("root", "up").alias("root"), "was"), "labels")
        changed = after.where("root != was").limit(1).count()
        for old in (labels, heard, told):
            discard(old)
        labels = after.select("node", "root")
        labels._starweave_path = after._starweave_path
        if not changed:
            discard(both)
            return labels
