"""Strongly connected components of large graphs by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strong_components(graph: DataFrame) -> DataFrame:
    """repo_id, node, component (its least node), size, for every node of ``graph`` (repo_id, src, dst).

    Each node learns the least node that reaches it and the least that it reaches, first along edges and then over the
    labels of its labels, so that long paths take few rounds. Edges between nodes of different labels lie on no cycle and
    go; labels are learnt again from the rest, until no edge goes. Nodes of one component keep the same labels all along,
    and at the end only those have. Rounds are joins and aggregations of one row a node; nothing is collected.
    """
    both = graph.select("repo_id", F.col("src").alias("node")).unionByName(graph.select("repo_id", F.col("dst").alias("node")))
    nodes = both.distinct().checkpoint()
    edges = graph.select("repo_id", "src", "dst").where(F.col("src") != F.col("dst")).distinct().checkpoint()
    total = edges.count()
    while True:
        labels = _labels(edges)
        sides = [labels.select("repo_id", F.col("node").alias(side), F.struct("fore", "back").alias(f"of_{side}")) for side in ("src", "dst")]
        edges = edges.join(sides[0], ["repo_id", "src"]).join(sides[1], ["repo_id", "dst"]).where(F.col("of_src") == F.col("of_dst")).select("repo_id", "src", "dst").checkpoint()
        left = edges.count()
        if left == total:
            break
        total = left
    named = nodes.join(labels.select("repo_id", "node", "fore"), ["repo_id", "node"], "left").select("repo_id", "node", F.coalesce("fore", "node").alias("component"))
    sizes = named.groupBy("repo_id", "component").agg(F.count("*").alias("size"))
    return named.join(sizes, ["repo_id", "component"]).select("repo_id", "node", "component", "size")


def _labels(edges: DataFrame) -> DataFrame:
    """repo_id, node, fore, back: the least node that reaches each node of the edges, and the least that it reaches."""
    ends = edges.select("repo_id", F.col("src").alias("node")).unionByName(edges.select("repo_id", F.col("dst").alias("node"))).distinct()
    labels = ends.select("repo_id", "node", F.col("node").alias("fore"), F.col("node").alias("back")).checkpoint()
    none = F.lit(None).cast("string")
    while True:
        held = labels.select("repo_id", "node", "fore", "back", F.col("fore").alias("old_fore"), F.col("back").alias("old_back"))
        at = lambda column: labels.select("repo_id", F.col("node").alias(column), F.col("fore").alias("f"), F.col("back").alias("b"))
        news = [
            edges.join(at("src"), ["repo_id", "src"]).select("repo_id", F.col("dst").alias("node"), F.col("f").alias("fore"), none.alias("back")),
            edges.join(at("dst"), ["repo_id", "dst"]).select("repo_id", F.col("src").alias("node"), none.alias("fore"), F.col("b").alias("back")),
            labels.drop("back").join(at("fore"), ["repo_id", "fore"]).select("repo_id", "node", F.col("f").alias("fore"), none.alias("back")),
            labels.drop("fore").join(at("back"), ["repo_id", "back"]).select("repo_id", "node", none.alias("fore"), F.col("b").alias("back")),
        ]
        every = held
        for new in news:
            every = every.unionByName(new, allowMissingColumns=True)
        least = every.groupBy("repo_id", "node").agg(*[F.min(c).alias(c) for c in ("fore", "back", "old_fore", "old_back")]).checkpoint()
        labels = least.select("repo_id", "node", "fore", "back")
        if least.where((F.col("fore") < F.col("old_fore")) | (F.col("back") < F.col("old_back"))).isEmpty():
            return labels


def inner_edges(graph: DataFrame, components: DataFrame) -> DataFrame:
    """repo_id, component, src, dst of the edges within a component, loops among them."""
    sides = [components.select("repo_id", F.col("node").alias(side), F.col("component").alias(name)) for side, name in (("src", "component"), ("dst", "_other"))]
    return graph.join(sides[0], ["repo_id", "src"]).join(sides[1], ["repo_id", "dst"]).where(F.col("component") == F.col("_other")).select("repo_id", "component", "src", "dst")
