"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def components(links: DataFrame, partitions: int | None = None) -> DataFrame:
    """node and root (the smallest node reachable) for each node of links(a, b).

    Each round ties every node to the least of its neighbours, first the larger ones, then the
    smaller; both are an aggregate with map-side combining and a join. The aggregate is dealt
    anew before the join, so both sides of the join are plain exchanges and Spark can split a hub
    with very many neighbours. Rounds grow with the logarithm of the longest chain; the lineage is cut
    with checkpoint() in each. Nothing but a count and a sum reaches the driver."""
    spark = links.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition(n)

    def stars(edges: DataFrame) -> DataFrame:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.join(least(large), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        return small.where("u <> v").distinct().checkpoint()

    def mark(edges: DataFrame):
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = mark(edges)
    while before[0]:
        edges = stars(edges)
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
