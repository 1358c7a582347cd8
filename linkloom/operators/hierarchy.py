"""Parent-child rows of unknown depth to roots, depths, paths and descendants.

Parent chains are contracted inside each partition: every node learns the top of its local chain and
the exit (the parent of that top, which lives elsewhere). Only the tops go on, as a smaller quotient
forest with weighted links, which is solved the same way until it fits one task; its answers are then
joined back, level by level. Chains that end in a root are solved where they are, and no root goes on,
so that the quotient has no more nodes than there are links between partitions. Leaves of a quotient
wait for their parents, whatever their number. A chain that runs into itself, in a partition or only in
the quotient, is a cycle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import cut

#: Nodes that one task contracts. A quotient up to this size is solved in one task.
NODES_PER_TASK = 100_000
#: Children from which a node is a hub: they are not sent to it, but stay spread over the partitions.
HUB = 1_000

_CHAIN = "node string, top string, steps bigint, exit string, weight bigint, state int, chain array<string>, below array<string>, goal string"


def _contract(with_path: bool):
    """Follows parents inside a partition by pointer jumping; the weights add up on the way."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        f = pd.concat(frames, ignore_index=True)
        n, here = len(f), np.arange(len(f))
        up = pd.Index(f["node"]).get_indexer(f["parent"])
        up[f["parent"].isna().to_numpy()] = -1
        jump, steps = np.where(up < 0, here, up), np.where(up < 0, 0, f["weight"].to_numpy(np.int64))
        for _ in range(n.bit_length()):
            steps, jump = steps + steps[jump], jump[jump]
        loops = up[jump] >= 0  # no top after at least n steps: on a cycle of this partition, or below one
        node = f["node"].to_numpy(object)
        # a node without parent is a root, or one whose root, depth and path are known from the level below
        ended = f["parent"].isna().to_numpy()[jump] & ~loops
        steps = steps + np.where(ended, f["weight"].to_numpy(np.int64)[jump], 0)
        below: list = [None] * n
        if with_path:  # the part of the path below the top; parents come first, as weights are positive
            for i in np.argsort(np.where(loops, -1, steps), kind="stable"):
                if up[i] < 0 or loops[i]:
                    below[i] = list(f["chain"].iat[i]) if ended[i] else []
                else:
                    below[i] = [*below[up[i]], *f["chain"].iat[i]]
        yield pd.DataFrame({
            "node": node, "top": np.where(loops, None, node[jump]), "steps": np.where(loops, 0, steps),
            "exit": np.where(up < 0, f["parent"].to_numpy(object), None), "weight": f["weight"],
            "state": loops.astype(np.int32), "chain": f["chain"], "below": below, "goal": np.where(ended, f["root"].to_numpy(object)[jump], None),
        })

    return run


def _placed(nodes: DataFrame, level: int, parts: int, hub: int) -> DataFrame:
    if level == 0:
        # ids of one package sort together, and most parents are in the package of the child
        return nodes.repartitionByRange(parts, "node")
    # no locality is left to hope for: a coin for each node sends tails to the heads above them, so that
    # about a quarter of the links goes at each level, whatever the ids are; the children of a hub stay apart
    heads = lambda c: F.pmod(F.xxhash64(F.lit(level), c), F.lit(2)) == 0
    hubs = nodes.groupBy("parent").agg(F.count("*").alias("n")).filter(F.col("n") > hub).select("parent", F.lit(True).alias("hub"))
    known = nodes.join(F.broadcast(hubs), "parent", "left")  # fewer than a row for each `hub` nodes
    at = F.when(heads(F.col("parent")) & ~heads(F.col("node")) & F.col("hub").isNull(), F.col("parent")).otherwise(F.col("node"))
    return known.withColumn("at", at).repartition(parts, "at").drop("at", "hub")


def _solve(nodes: DataFrame, level: int, with_path: bool, per_task: int, hub: int) -> DataFrame:
    """nodes (node, parent, weight, chain, root), cut, to (node, root, depth, state, path). Those without
    a parent have a root, with the weight and the chain from there; the others have none."""
    parts = -(-nodes.count() // per_task)
    last = level > 0 and parts <= 1
    if level == 0:
        parts = max(parts, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = nodes.coalesce(1) if last else _placed(nodes, level, parts, hub)
    local = cut(placed.mapInPandas(_contract(with_path), _CHAIN))
    if last:
        return local.select("node", F.col("goal").alias("root"), F.col("steps").alias("depth"), "state", F.col("below").alias("path"))
    out = local.select(F.col("node").alias("exit"), F.col("top").alias("exit_top"), F.col("steps").alias("exit_steps"), F.col("state").alias("exit_state"), F.col("below").alias("exit_below"), F.col("goal").alias("exit_goal"))
    joined = local.filter("node = top and goal is null").select("node", "exit", "weight", "chain").join(out, "exit", "left")
    # below a local cycle: its own parent, hence a cycle of the quotient too
    lost = F.coalesce(F.col("exit_state") == 1, F.lit(False))
    quotient = cut(joined.select(
        "node",
        F.when(lost, F.col("node")).when(F.col("exit_goal").isNull(), F.col("exit_top")).alias("parent"),
        (F.col("weight") + F.coalesce("exit_steps", F.lit(0))).alias("weight"),
        F.concat("exit_below", "chain").alias("chain"),
        F.col("exit_goal").alias("root"),
    ))
    # a leaf of the quotient needs nothing but the answer of its parent
    inner = quotient.join(quotient.select(F.col("parent").alias("node")).distinct(), "node", "left_semi")
    leaves = quotient.join(inner.select("node"), "node", "left_anti")
    solved = _solve(cut(inner), level + 1, with_path, per_task, hub)
    above = solved.withColumnsRenamed({"node": "parent", "root": "above_root", "state": "above_state", "path": "above_path"})
    hung = leaves.join(above, "parent", "left").select(
        "node", F.coalesce("root", "above_root").alias("root"), (F.coalesce("depth", F.lit(0)) + F.col("weight")).alias("depth"),
        F.coalesce("above_state", F.lit(0)).alias("state"), F.when(F.col("parent").isNull(), F.col("chain")).otherwise(F.concat("above_path", "chain")).alias("path"),
    )
    solved = solved.unionByName(hung).withColumnsRenamed({"node": "top", "state": "top_state"})
    own = F.col("goal").isNotNull() | (F.col("state") == 1)
    either = lambda here, above: F.when(own, here).otherwise(above)
    return local.join(solved, "top", "left").select(
        "node",
        either(F.col("goal"), F.col("root")).alias("root"),
        either(F.col("steps"), F.col("depth") + F.col("steps")).alias("depth"),
        either(F.col("state"), F.col("top_state")).alias("state"),
        either(F.col("below"), F.concat("path", "below")).alias("path"),
    )


def _parents(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, parent) of every id at an end of a link; null for those without a parent."""
    ends = links.select(F.col(child).cast("string").alias("node"), F.col(parent).cast("string").alias("parent")).filter("node is not null and parent is not null")
    both = ends.unionByName(ends.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")))
    return both.groupBy("node").agg(F.min("parent").alias("parent"))


def hierarchy(links: DataFrame, child: str = "target_id", parent: str = "source_id", with_path: bool = False, per_task: int = NODES_PER_TASK, hub: int = HUB) -> DataFrame:
    """One row (node_id, root_id, depth, path) for each id at either end of a link.

    ``path`` lists the ids from the root to the node itself, or is null without ``with_path``. A node
    on a cycle or below one has the root "", depth -1 and a null path. Links with a null end are
    ignored and repeated links count once; if a node has several parents, the smallest id counts. A
    link of a node to itself is a cycle. An empty table gives no rows; other columns are not read.
    """
    nodes = _parents(links, child, parent)
    chain = F.array("node") if with_path else F.lit(None).cast("array<string>")
    start = cut(nodes.select("node", "parent", F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("weight"), chain.alias("chain"), F.when(F.col("parent").isNull(), F.col("node")).alias("root")))
    bad = F.col("state") == 1
    return _solve(start, 0, with_path, per_task, hub).select(
        F.col("node").alias("node_id"),
        F.when(bad, F.lit("")).otherwise(F.col("root")).alias("root_id"),
        F.when(bad, F.lit(-1)).otherwise(F.col("depth")).cast("int").alias("depth"),
        F.when(~bad, F.col("path")).alias("path"),
    )


def containment(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("type").isin("CONTAINS", "DEFINES")).select("source_id", "target_id")


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) of every node and each of its ancestors, itself excluded."""
    above = F.slice("path", 1, F.size("path") - 1)
    return paths.filter("depth > 0").select("node_id", "depth", F.posexplode(above).alias("at", "ancestor_id")).select("ancestor_id", "node_id", (F.col("depth") - F.col("at")).cast("int").alias("distance"))


def subtree_sizes(links: DataFrame, child: str = "target_id", parent: str = "source_id") -> DataFrame:
    """(node_id, descendants, height) of each id that has descendants; none on or below a cycle.

    After round k a node knows its ancestor 2^k links above and what lies less than 2^k links below, and
    adds that to the ancestor's. So the rounds are as many as the depth has binary digits, no pair of
    ancestor and descendant is spelled out, and what goes to a hub is aggregated before it is shuffled.
    """
    solved = hierarchy(links, child, parent).filter("depth >= 0").select("node_id", "depth")
    known = solved.join(_parents(links, child, parent).withColumnRenamed("node", "node_id"), "node_id")
    # numbers are shuffled in place of ids
    named = cut(known.select("node_id", "parent", "depth", F.monotonically_increasing_id().alias("node")))
    deepest = named.agg(F.max("depth")).first()[0] or 0
    placed = named.filter("parent is not null").select("node", "parent").join(named.select(F.col("node_id").alias("parent"), F.col("node").alias("up")), "parent").select("node", "up")
    one, none = F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("h")
    state = cut(placed.select("node", "up", one, none).unionByName(named.filter("parent is null").select("node", F.lit(None).cast("bigint").alias("up"), one, none)))
    for k in range(int(deepest).bit_length()):
        active = state.filter("up is not null")
        below = active.groupBy(F.col("up").alias("node")).agg(F.sum("n").alias("more"), (F.max("h") + 2**k).alias("deep"))
        # tops have no number above; a number of their own spreads them, where null would put them together
        above = active.select(F.col("node").alias("at"), F.col("up").alias("next"))
        grown = state.join(below, "node", "left").withColumn("at", F.coalesce("up", -1 - F.col("node"))).join(above, "at", "left")
        state = cut(grown.select("node", F.col("next").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("h", F.coalesce("deep", F.lit(0))).alias("h")))
    return state.filter("n > 1").join(named.select("node", "node_id"), "node").select("node_id", (F.col("n") - 1).alias("descendants"), F.col("h").cast("int").alias("height"))
