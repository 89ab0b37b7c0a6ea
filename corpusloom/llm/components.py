"""Connected components of a graph given as an edge table, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component: the smallest node reachable) of edges (a, b) between longs.

    Each round every node points to the least of itself and its neighbours, pointers
    are followed to their ends, and the graph shrinks to those ends: edges between
    different ones are all that the next round reads.  Afterwards the rounds' pointers
    are put together, the last first.  So tables get smaller from round to round, and
    all that is shuffled stays in proportion to the edges.  Aggregation is partial
    before each shuffle; every table is written, so a hot end's rows can be split.
    """
    rounds: list[DataFrame] = []
    left = scratch.table(edges.select("a", "b"), f"{name}-edges-0")
    while not rounds or left.limit(1).count():
        turn = len(rounds)
        ends = _ends(left, scratch, f"{name}-{turn}")
        rounds.append(ends)
        of = lambda side: ends.select(F.col("node").alias(side), F.col("end").alias(f"{side}_end"))  # noqa: B023, E731
        between = left.join(of("a"), "a").join(of("b"), "b").where("a_end != b_end")
        between = between.select(F.least("a_end", "b_end").alias("a"), F.greatest("a_end", "b_end").alias("b")).distinct()
        left = scratch.table(between, f"{name}-edges-{turn + 1}")
        scratch.drop(f"{name}-edges-{turn}")
    labels = rounds.pop().withColumnRenamed("end", "component")
    while rounds:
        further = labels.withColumnRenamed("node", "end")
        whole = rounds.pop().join(further, "end", "left").select("node", F.coalesce("component", "end").alias("component"))
        labels = scratch.table(whole, f"{name}-labels-{len(rounds)}")
    return labels


def _ends(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, end): where each node comes to by going to its least neighbour while that is smaller."""
    least = F.least("a", "b").alias("end")
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), least), F.struct(F.col("b").alias("node"), least))).alias("x"))
    pointers, turn = scratch.table(both.groupBy("x.node").agg(F.min("x.end").alias("end")), f"{name}-least"), 0
    last = f"{name}-least"
    while True:
        beyond = pointers.select(F.col("node").alias("end"), F.col("end").alias("far"))
        step = pointers.join(beyond, "end").select("node", F.col("far").alias("end"), (F.col("far") != F.col("end")).alias("moved"))
        found = scratch.table(step, f"{name}-ends-{turn}")
        scratch.drop(last)
        pointers, last, turn = found.drop("moved"), f"{name}-ends-{turn}", turn + 1
        if not found.where("moved").limit(1).count():
            return pointers
