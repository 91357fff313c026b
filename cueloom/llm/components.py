"""Connected components of a link table, by repeated contraction in DataFrame functions.

In each round every vertex is replaced by that vertex of its neighbourhood (itself included) which comes first in an
order; links between replaced vertices go on to the next round until none is left. The first round's order is the ids': links that
name the first document of a group form stars around their smallest vertex, which vanish in that round. Later rounds draw their order
anew, so that the number of rounds grows with the logarithm of the component size, chains included. A hub's links are pre-aggregated before they are
shuffled. Each round's links are a written table, so that a lost executor costs no earlier round; the rounds' names are joined at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.sources.workspace import written


def components(links: DataFrame) -> DataFrame:
    """(doc, component) for every vertex of ``links`` (a, b); the component is its smallest vertex."""
    left = written(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "links")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        if len(rounds) == 200:
            raise RuntimeError("components did not converge")

        def order(vertex: str, turn: int = len(rounds)):
            return F.xxhash64(F.lit(turn), vertex) if turn else F.col(vertex)

        ends = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = ends.groupBy("a").agg(F.min_by("b", order("b")).alias("b"), F.min(order("b")).alias("least"))
        to = written(first.select(F.col("a").alias("v"), F.when(order("a") <= F.col("least"), F.col("a")).otherwise(F.col("b")).alias("to")), "contracted")
        one = left.join(to, left["a"] == to["v"]).select(F.col("to").alias("a"), "b")
        two = one.join(to, one["b"] == to["v"]).select("a", F.col("to").alias("b")).where("a <> b")
        left = written(two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        rounds.append(to)
    if not rounds:
        return left.select(F.col("a").alias("doc"), F.col("b").alias("component"))
    names = rounds[0].select(F.col("v").alias("doc"), F.col("to").alias("component"))
    for to in rounds[1:]:
        names = names.join(to, names["component"] == to["v"], "left").select("doc", F.coalesce("to", "component").alias("component"))
    names = written(names, "named")
    least = names.groupBy("component").agg(F.min("doc").alias("least"))
    return written(names.join(least, "component").select("doc", F.least("doc", "least").alias("component")), "components")


def joined_by(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (doc, component) after more ``links``: only the components that these join are contracted again."""

    def of(side: str) -> DataFrame:
        return labels.select(F.col("doc").alias(side), F.col("component").alias(f"of_{side}"))

    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = components(named.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    new = between.select(F.col("doc").alias("old"), F.col("component").alias("new"))
    moved = labels.join(new, labels["component"] == new["old"], "left").select("doc", F.coalesce("new", "component").alias("component"))
    alone = new.join(labels, new["old"] == labels["doc"], "left_anti").select(F.col("old").alias("doc"), F.col("new").alias("component"))
    return written(moved.unionByName(alone), "joined")
