"""Connected groups of linked records, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import settle

MOST_ROUNDS = 60


def connected(links: DataFrame) -> DataFrame:
    """``(id, group_id)`` of every id in ``links`` (columns a, b): ``group_id`` is the lowest id it is connected to.

    Alternating large-star and small-star rounds; each round is two shuffles of the links and halves the depth of
    the trees. A star's centre only ever meets a minimum, so a group of any size is spread over tasks.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        # large star: each node's larger neighbours hang on its smallest neighbour
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: each node's smaller neighbours hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("links did not settle")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(roots)
