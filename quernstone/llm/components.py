"""Groups of records that are linked directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans.lineage import stage


#: Jumps of one stage: paths get shorter by one more than this factor.
JUMPS = 3


def groups(links: DataFrame, left: str, right: str, node: str = "node", group: str = "group_id") -> DataFrame:
    """One row (``node``, ``group``) for each end of a link; the group is the smallest node reachable.

    ``links`` holds one link a row in the columns ``left`` and ``right`` (one type, ordered by value; strings by code
    point); other columns are ignored. Rows with a null end or with equal ends are no links, repeated and turned rows
    count once, an empty table gives an empty result.

    A round takes the smallest label along the edges: every label that has a smaller neighbour hooks onto the smallest
    (``min`` combines before the shuffle, so a hub of any degree costs each mapper one row). Hooks lead to smaller labels, so
    they form trees; pointer jumping brings every label to its root. Then the edges take the roots as
    labels, and those inside one group drop out. Only labels without a smaller neighbour are roots, at most half of those
    that have edges, so the rounds grow with the logarithm of the graph, and each is smaller than the one before. The labels
    of all nodes are put together once, at the end, from the trees of the rounds. Each round and each jump is kept as a table
    in the shared folder until the next one is complete; the end is reached when no edge joins two groups.
    """
    ends = F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))
    edges = stage(links.where(ends).select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct(), edges=F.count("*"))
    trees = []
    while edges.counts["edges"]:
        hooks = edges.df.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("p"))
        tree = stage(_jumped(hooks), moved=F.count_if("moved"))
        while tree.counts["moved"]:
            last, tree = tree, stage(_jumped(tree.df.select("n", "p")), moved=F.count_if("moved"))
            last.drop()
        trees.append(tree.df.select("n", "p"))
        up = trees[-1].select(F.col("n").alias("_n"), F.col("p").alias("_p"))
        named = edges.df
        for end in ("a", "b"):
            named = named.join(up, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_p", end)).select("a", "b")
        last, edges = edges, stage(named.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), edges=F.count("*"))
        if len(trees) > 1:
            last.drop()
        else:
            first = last
    if not trees:
        return edges.df.select(F.col("a").alias(node), F.col("b").alias(group))
    # A label is a root of the rounds before, or has been one of the nodes that never hooked.
    labels = first.df.select(F.explode(F.array("a", "b")).alias(node)).distinct().withColumn(group, F.col(node))
    for tree in trees:
        up = tree.select(F.col("n").alias("_n"), F.col("p").alias("_p"))
        labels = labels.join(up, F.col(group) == F.col("_n"), "left").select(node, F.coalesce("_p", group).alias(group))
    return labels


def _jumped(tree: DataFrame) -> DataFrame:
    """Every label with the parent that is ``JUMPS`` steps further up, or its root; ``moved`` if that may have a parent."""
    up = tree.select(F.col("n").alias("_n"), F.col("p").alias("_p"))
    for _ in range(JUMPS):
        tree = tree.join(up, F.col("p") == F.col("_n"), "left").select("n", F.coalesce("_p", "p").alias("p"), F.col("_p").isNotNull().alias("moved"))
    return tree
