"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.base import remove, written_at


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the least node that can be reached) of every node of ``edges`` (a, b).

    Every round points each node to the least label among its neighbours' labels and its own, then to the label
    of its label, until nothing changes. Each round is a table in the shared folder, removed once the next is written; so are the edges, in the end.
    """
    both = edges.where(F.col("a") != F.col("b"))
    both, edges_path = written_at(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, path = written_at(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        met = labels.join(near.hint("merge"), "node").select("node", F.col("component").alias("was"), F.least("component", "least").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("further")).hint("merge")
        new, after = written_at(met.join(jump, "c", "left").select("node", "was", F.least("c", F.coalesce("further", "c")).alias("component")), "labels")
        settled = new.where(F.col("was") != F.col("component")).isEmpty()
        remove(both.sparkSession, path)
        labels, path = new.select("node", "component"), after
        if settled:
            remove(both.sparkSession, edges_path)
            return labels
    raise RuntimeError("components did not settle")
