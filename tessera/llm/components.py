"""Connected components by repeated contraction, in narrow joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Pointer jumps before each contraction: a path shrinks by 2**JUMPS a round.
JUMPS = 2


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` links between long ids -> ``(id, component)``.

    ``component`` is the smallest id reachable; ids without links don't appear.
    Each round points every node at its smallest neighbour, follows the pointers
    ``JUMPS`` times, renames both ends of the links and keeps the links that
    still join two nodes. Every round's links and names are written to shared
    storage, so a lost executor repeats one round at most, and a node with very
    many links is only ever pre-aggregated or split, never gathered.
    """
    links = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .where("a < b").distinct(), "links")
    names = None
    while True:
        both = links.select(F.col("b").alias("id"), F.col("a").alias("to"))
        both = both.unionByName(links.select(F.col("a").alias("id"), F.col("a").alias("to")))
        # a node that has only larger neighbours is a root and points at itself
        step = both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to"))
        for _ in range(JUMPS):
            far = step.select(F.col("id").alias("to"), F.col("to").alias("far"))
            step = step.join(far, "to").select("id", F.col("far").alias("to"))
        step = written(step, "step")
        if names is None:
            names = step.select("id", F.col("to").alias("component"))
        else:
            moved = step.select(F.col("id").alias("component"), "to")
            names = written(names.join(moved, "component", "left")
                            .select("id", F.coalesce("to", "component").alias("component")), "names")
        at_a = step.select(F.col("id").alias("a"), F.col("to").alias("to_a"))
        at_b = step.select(F.col("id").alias("b"), F.col("to").alias("to_b"))
        links = written(links.join(at_a, "a").join(at_b, "b")
                        .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
                        .where("a < b").distinct(), "links")
        if links.isEmpty():
            return names
