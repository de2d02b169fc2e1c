"""Connected components of a link table, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.session import written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): root is the least node reachable. Nodes without links are left out.

    Each round writes its links to the shared folder. A large star hangs all
    greater neighbours of a node to its least neighbour; a small star does so
    with the lesser ones. Rounds stop when the links no longer change; their
    number grows with the logarithm of the longest chain. A node with very many
    links meets in aggregates with map-side combine and in plain joins, whose
    large partitions Spark can split.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        sides = links.select(F.col("u").alias("x"), F.col("v").alias("y"))
        if large:
            sides = sides.unionByName(sides.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = sides.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        joined = sides.join(least, "x")
        moved = joined.where("y > x") if large else joined.where("y <> m")
        moved = moved.select(F.col("y").alias("u"), F.col("m").alias("v"))
        if not large:
            moved = moved.unionByName(least.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    def mark(links: DataFrame):
        return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = written(links, "links")
    before = mark(links)
    while True:
        links = written(star(star(links, True), False), "links")
        now = mark(links)
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
