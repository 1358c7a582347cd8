"""Breadth-first closure with a fixed numbering of what is found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.graph import priority
from linkloom.session import cut

VISITS = 5000
DEPTH = 4


def trace(links: DataFrame, root: str, towards: str = "dependents", depth: int = 1, kinds: list[str] | None = None, visits: int = VISITS) -> DataFrame:
    """(n, from_n, depth, kind, id, count, sites, complete): what depends on root, or what it depends on.

    Level by level; a node found several times keeps the find with the smallest (number of the node it
    was found from, rank of the kind, greatest count). Numbers run on in that order, then by id. The
    visit cap is part of the answer's contract: ``complete`` is false in every row if it hid a node. What
    is carried from level to level has that bound, so it may be broadcast.
    """
    near, far = ("target", "source") if towards == "dependents" else ("source", "target")
    kinds = kinds or ["CALLS", "REFERENCES", "IMPLEMENTS", "USES"]
    # aggregated once, not again for every level
    steps = cut(links.filter(F.col("kind").isin(kinds)).select(F.col(near).alias("near"), F.col(far).alias("id"), "kind", F.col("n").alias("count"), priority(F.col("kind")).alias("prio"), F.slice("lines", 1, 5).alias("sites")))
    spark = links.sparkSession
    found = spark.createDataFrame([(0, -1, 0, None, root, None, None)], "n int, from_n int, depth int, kind string, id string, count bigint, sites array<bigint>")
    base, complete = 0, True
    for level in range(1, min(depth, DEPTH) + 1):
        frontier = found.filter(F.col("depth") == level - 1).select(F.col("id").alias("near"), F.col("n").alias("from_n"))
        seen = steps.join(F.broadcast(frontier), "near").join(F.broadcast(found.select("id")), "id", "left_anti")
        best = seen.groupBy("id").agg(F.min(F.struct("from_n", "prio", (-F.col("count")).alias("c"), "kind", "count", "sites")).alias("v"))
        ranks = ["from_n", "prio", F.desc("count"), "id"]
        # one more than may be shown tells whether something is hidden
        first = best.select("v.from_n", "v.prio", "v.count", "v.kind", "v.sites", "id").orderBy(*ranks).limit(visits - base + 1)
        new = first.select((F.row_number().over(Window.orderBy(*ranks)) + base).cast("int").alias("n"), "from_n", F.lit(level).alias("depth"), "kind", "id", "count", "sites")
        found = cut(found.unionByName(new))
        size = found.count() - 1
        complete = size <= visits
        if size == base or not complete:
            break
        base = size
    return found.filter(F.col("n").between(1, visits)).withColumn("complete", F.lit(complete))


def described(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of a trace with type, name, file and line of each node, null where it is none."""
    ends = nodes.select("id", "type", "name", "file_path", "start_line")
    return ends.join(F.broadcast(found), "id", "right").select("n", "from_n", "depth", "kind", "id", "type", "name", "file_path", "start_line", "count", F.array_join("sites", ",").alias("sites"), "complete")
