"""Connected components of an edge list by randomised contraction.

Each round every node points to the neighbour (or itself) of least priority, a hash of the node and the round, and
edges are rewritten to where their ends point. A round removes a constant share of the nodes on average whatever the
shape of the graph, so chains take a logarithmic number of rounds. Nothing is collected; each round's tables are
written to the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b): node, label, a row for each node with an edge. Equal labels mean one component; a label is some node of it."""
    a, b = F.col("a"), F.col("b")
    once = lambda e: e.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    left, maps = written(once(edges)), []
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c).alias("p"), c.alias("n"))  # noqa: B023, E731
        both = left.union(left.select(b, a))
        least = both.groupBy("a").agg(F.min(rank(b)).alias("m"))
        points = written(least.select(a.alias("node"), F.least(F.col("m"), rank(a))["n"].alias("label")))
        maps.append(points)
        to_a, to_b = points.toDF("a", "la"), points.toDF("b", "lb")
        left = written(once(left.join(to_a, "a").join(to_b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))))
    if not maps:
        return left.select(a.alias("node"), b.alias("label"))
    labels = maps.pop()
    while maps:  # where a node points, then where that one points in the later rounds
        labels = written(maps.pop().toDF("node", "via").join(labels.toDF("via", "end"), "via", "left").select("node", F.coalesce("end", "via").alias("label")))
    return labels
