"""Connected components by repeated contraction, all of it distributed.

In each round every node points to the neighbour (itself included) of least
random rank, edges are redrawn between the nodes pointed to, and loops and
repeats go.  Random ranks make the number of nodes shrink by a constant factor
a round on any graph, chains included.  Hubs are harmless: the least neighbour
is a partial aggregate, and the joins read written tables, so that adaptive
execution can split them.  Tables of past rounds are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; component is its smallest node.

    Loops and repeated edges are allowed, null ends are ignored, and an empty
    edge table gives an empty result.
    """
    spark = edges.sparkSession
    links = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    links, links_path = written(links.distinct())
    at, at_path, turn = None, None, 0
    while not links.isEmpty():
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("r"), F.col(c).alias("n"))
        step, step_path = written(both.groupBy("u").agg(F.min(rank("v")).alias("best")).select(F.col("u").alias("node"), F.least("best", rank("u").alias("own"))["n"].alias("to")))
        ends = [step.select(F.col("node").alias(k), F.col("to").alias(f"{k}_to")) for k in ("u", "v")]
        drawn = links.join(ends[0], "u").select("u_to", "v").join(ends[1], "v").where("u_to <> v_to")
        past = [links_path]
        links, links_path = written(drawn.select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v")).distinct())
        if at is None:
            at, at_path = step.select("node", F.col("to").alias("at")), step_path
        else:
            moved = step.select(F.col("node").alias("at"), "to")
            past += [step_path, at_path]
            at, at_path = written(at.join(moved, "at", "left").select("node", F.coalesce("to", "at").alias("at")))
        discard(spark, past)
        turn += 1
    if at is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    least, _ = written(at.groupBy("at").agg(F.min("node").alias("component")))
    return at.join(least, "at").select("node", "component")
