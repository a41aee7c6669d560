"""Connected components by contraction, for links between random 64-bit names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm import blocks as B


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every end of the links (a, b): root is the least name of its component.

    Each round every vertex moves to the least of its neighbours and itself, and links between
    vertices that met vanish. Names are random, so a round leaves a fixed share of the vertices at
    most: the number of rounds grows with the logarithm of the longest path. Nothing is collected;
    each round is a written table.
    """
    links = B.written(links.select("a", "b").filter("a <> b"), "links")
    moves = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("v"), F.least("a", "to").alias("to"))
        move = B.written(move, "moves")
        moves.append(move)
        ends = [move.select(F.col("v").alias(x), F.col("to").alias(f"{x}_to")) for x in "ab"]
        moved = links.join(ends[0], "a").join(ends[1], "b").select(
            F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")
        )
        links = B.written(moved.filter("a <> b").distinct(), "links")
    if not moves:
        return links.select(F.col("a").alias("v"), F.col("b").alias("root"))
    found = moves[0].select("v", F.col("to").alias("root"))
    for move in moves[1:]:
        step = move.select(F.col("v").alias("root"), "to")
        found = found.join(step, "root", "left").select("v", F.coalesce("to", "root").alias("root"))
    return B.written(found, "components")
