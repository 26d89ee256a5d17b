"""Connected components of a distributed edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import checkpointed


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge table: root is the smallest node reachable.

    Alternates two star contractions: every node's larger neighbours move to its smallest neighbour,
    then its smaller ones do. Each is one aggregation with map-side combine and one join, so no
    neighbourhood is ever gathered; the number of rounds grows with the logarithm of the diameter.
    Nodes without an edge, self loops and null ends do not appear in the result.
    """
    stars = checkpointed(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpointed(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .unionByName(least.select("u", F.col("m").alias("v")))
        )
        stars = checkpointed(small.distinct())
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
