"""Graph operators: bounded reach, downgrade to a fixpoint, strongly connected components, coupling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut_lineage

#: Steps along the edges between two checkpoints of a loop; loops end at their fixpoint, however far that is.
HOPS = 3


def reach(seeds: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """(node, hops) of what reaches the seeds against the edges (src, dst) within so many hops, seeds left out.

    Null nodes take no part, loops and repeated edges change nothing; each step joins only the newest frontier.
    """
    known = seeds.select("node").where("node is not null").distinct().withColumn("hops", F.lit(0))
    links = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    frontier, found = known, [known]
    for hop in range(1, hops + 1):
        step = frontier.join(links, frontier.node == links.dst).select(F.col("src").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, found).select("node")
        frontier = step.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop))
        found.append(frontier)
    return reduce(DataFrame.unionByName, found).where("hops > 0")


def downgraded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (node) that were verified and rest, directly or not, on one that isn't verified or is missing.

    `nodes` has node and verified, `edges` has src (that depends) and dst. The frontier of newly fallen nodes is
    joined to the edges until nothing more falls; every round is checkpointed to the shared folder.
    """
    verified = nodes.where("verified").select("node").distinct()
    links = edges.where("src is not null and dst is not null").select("src", "dst").distinct().join(verified.withColumnRenamed("node", "src"), "src", "left_semi")
    # all that isn't verified, missing nodes included, makes its dependants fall
    unsafe = links.join(verified.withColumnRenamed("node", "dst"), "dst", "left_anti")
    fallen = cut_lineage(unsafe.select(F.col("src").alias("node")).distinct())
    frontier, links = fallen, cut_lineage(links)
    while not frontier.isEmpty():
        # a few steps a round: a deep chain costs fewer checkpoints
        step = frontier
        for _ in range(HOPS):
            step = step.unionByName(step.join(links, step.node == links.dst).select(F.col("src").alias("node"))).distinct()
        frontier = cut_lineage(step.join(fallen, "node", "left_anti"))
        fallen = cut_lineage(fallen.unionByName(frontier))
    return fallen


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in strongly connected components of more than one node.

    Each node learns the largest name that reaches it and the largest name that it reaches; where both are the same
    name, node and name reach each other, so they are one component. Nodes that are settled are taken out, edges between
    nodes that learnt different names can't lie in a component and are dropped, and the rest goes on until no edge is
    left. The component's name is its smallest member. Loops and nulls are left out.
    """
    links = cut_lineage(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct())
    done: list[DataFrame] = []
    while not links.isEmpty():
        # nodes without an edge in or out are in no component: a few layers of them go first
        for _ in range(HOPS):
            links = links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        links = cut_lineage(links)
        nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
        names = cut_lineage(nodes.select("node", F.col("node").alias("ahead"), F.col("node").alias("behind")))
        while True:
            # both directions in one exchange; a node's own names are a message to itself
            sent = links.join(names, links.src == names.node).select(F.col("dst").alias("to"), "ahead", F.lit(None).alias("behind"))
            back = links.join(names, links.dst == names.node).select(F.col("src").alias("to"), F.lit(None).alias("ahead"), "behind")
            own = names.select(F.col("node").alias("to"), "ahead", "behind", F.col("ahead").alias("a"), F.col("behind").alias("b"))
            came = sent.unionByName(back).withColumns({"a": F.lit(None), "b": F.lit(None)}).unionByName(own)
            told = cut_lineage(came.groupBy(F.col("to").alias("node")).agg(F.max("ahead").alias("ahead"), F.max("behind").alias("behind"), F.max("a").alias("a"), F.max("b").alias("b")))
            names = told.select("node", "ahead", "behind")
            if told.where("ahead > a or behind > b").isEmpty():
                break
        done.append(names.where("ahead = behind").select("node", F.col("ahead").alias("colour")))
        open_ = names.where("ahead <> behind")
        at = lambda end: open_.select(F.col("node").alias(end), F.col("ahead").alias(f"{end}_a"), F.col("behind").alias(f"{end}_b"))
        links = cut_lineage(links.join(at("src"), "src").join(at("dst"), "dst").where("src_a = dst_a and src_b = dst_b").select("src", "dst"))
    if not done:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false")
    grouped = reduce(DataFrame.unionByName, done)
    sizes = grouped.groupBy("colour").agg(F.count("*").alias("n"), F.min("node").alias("component")).where("n > 1")
    return grouped.join(sizes, "colour").select("node", "component")


def coupling(edges: DataFrame) -> DataFrame:
    """node, afferent, efferent, instability over distinct edges (src, dst) without loops."""
    links = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()
    # both directions in one pass: each edge speaks for either end
    ends = links.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("a"), F.lit(1).alias("e")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("a"), F.lit(0).alias("e")))).alias("x"))
    per = ends.groupBy("x.node").agg(F.sum("x.a").alias("afferent"), F.sum("x.e").alias("efferent"))
    return per.withColumn("instability", F.round(F.col("efferent") / (F.col("afferent") + F.col("efferent")), 6))
