"""Connected components of a link table, by rounds of contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """`node, component` for every node of `edges(a, b)`; the component is one of its nodes.

    In a round every node goes over to the neighbour of least rank, if that is below its own, and the links are drawn again
    between the nodes that are left.  In the first two rounds the rank is the node's number, which settles links that lead to
    the least node of their group.  From then on ranks are hashed anew each round, so a fixed share of the nodes goes whatever
    the order of their numbers, and links that came to join a node with itself leave: the tables shrink from round to round.
    The least neighbour is aggregated before the exchange, so a hub costs a row for each task, not for each link.  What a round decided
    is written to the shared folder, and the rounds are put together from the last, smallest one on."""
    rounds: list[DataFrame] = []
    links = written(edges.select("a", "b").where("a != b").distinct(), "links")
    while links.limit(1).count():
        rank = lambda c, n=len(rounds): F.struct((F.col(c) if n < 2 else F.xxhash64(c, F.lit(n))).alias("rank"), F.col(c).alias("node"))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = both.groupBy("a").agg(F.min(rank("b")).alias("least"))
        moves = written(moves.select(F.col("a").alias("node"), F.least(rank("a"), "least")["node"].alias("to")), "contraction")
        rounds.append(moves)
        ends = [moves.select(F.col("node").alias(c), F.col("to").alias("to_" + c)) for c in "ab"]
        drawn = reduce(lambda df, end: df.join(end, end.columns[0]), ends, links)
        links = written(drawn.where("to_a != to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
    if not rounds:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    final = rounds.pop().withColumnRenamed("to", "component")
    for moves in reversed(rounds):
        later = final.select(F.col("node").alias("to"), "component")
        final = written(moves.join(later, "to", "left").select("node", F.coalesce("component", "to").alias("component")), "components")
    return final
