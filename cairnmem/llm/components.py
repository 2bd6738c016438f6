"""Connected components of links between rows, by alternating star contractions in DataFrames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnmem.llm.staging import Stage

#: Far beyond the logarithm of any number of rows: a fault, not a limit.
MAX_ROUNDS = 64


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """(id, root) of every end of the links (a, b) but the roots themselves: the smallest id of its
    component, once for each id.

    Each round points every node's larger neighbours at its smallest neighbour, and then, if any node
    still points at two or at one that points on, its smaller ones too; that takes a number of rounds in
    the logarithm of the size.  Minima are reduced before the shuffle and joined back as a table of
    their own, so a node with a great many neighbours is a hot key of a plain join, which adaptive
    execution splits.
    """
    edges = stage.write(links.select("a", "b").where("a != b"), "links")
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage.write(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage.write(large.where("a != b"), "large")
        down = stage.write(edges.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most")), "down")
        forked = down.where("m < most").limit(1).count()
        if not forked and not down.join(down.select(F.col("m").alias("a")), "a", "left_semi").limit(1).count():
            return down.select(F.col("a").alias("id"), F.col("m").alias("root"))
        ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        small = edges.join(down, "a").select(ends.alias("e")).select("e.a", "e.b").where("a != b").distinct()
        edges = stage.write(small, "small")
    raise RuntimeError(f"components are not settled after {MAX_ROUNDS} rounds")
