"""Connected components of a link table, without a driver-side graph.

Each round hangs every node on its smallest neighbour, hands that node's other
neighbours on to it, and shortens paths by one jump, until every node has one parent and
no parent has one. A node is only ever keyed by its smaller neighbours, so the hub of a
large group (its smallest id) is a value, not a key, of the aggregations; joins whose
keys can be hubs read written tables on both sides, so adaptive execution can split
them. Every round is written to the shared folder; the driver sees two counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, release


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id that is not itself the smallest of its component.

    links: pairs of ids in any order; self links, repeats and nulls are ignored. The
    smallest id of a component has no row; ids without links have none either.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b))).distinct()
    edges = materialize(edges, "links")
    while True:
        low = materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "parents")
        up = low.select(F.col("u").alias("k"), F.col("m").alias("root"))
        jumped = low.join(up, F.col("m") == F.col("k"), "left").select("u", F.coalesce("root", "m").alias("v"), (F.col("root").isNotNull() | (F.col("n") > 1)).alias("open"))
        jumped = materialize(jumped, "jumped")
        if jumped.where("open").isEmpty():
            release(edges, low)
            return jumped.select(F.col("u").alias("id"), F.col("v").alias("component"))
        many = low.where("n > 1").select(F.col("u").alias("k"), "m")
        others = edges.join(many, F.col("u") == F.col("k")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = materialize(jumped.select("u", "v").union(others).distinct(), "links")
        release(edges, low, jumped)
        edges = following
