import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import hierarchy as H
from linkloom.operators.hierarchy import descendants, hierarchy, subtree_sizes


def brute(links):
    parent = {}
    for p, c in links:
        if p is not None and c is not None:
            parent[c] = min(parent.get(c, p), p)
    ids = {x for p, c in links if p is not None and c is not None for x in (p, c)}
    out = {}
    for i in ids:
        path = [i]
        while path[-1] in parent and len(path) <= len(ids):
            path.append(parent[path[-1]])
        out[i] = ("", -1, None) if len(path) > len(ids) else (path[-1], len(path) - 1, path[::-1])
    return out


def solved(spark, links, per_task, hub=H.HUB):
    df = spark.createDataFrame(links, "source_id string, target_id string")
    return {r.node_id: (r.root_id, r.depth, r.path) for r in hierarchy(df, with_path=True, per_task=per_task, hub=hub).collect()}


@pytest.mark.parametrize("per_task", [1000, 40, 9])
def test_random_forests_with_cycles(spark, per_task):
    rng = random.Random(per_task)
    links = [(f"n{rng.randrange(max(1, i // rng.choice([1, 2, 9])))}" if i % 40 else f"n{rng.randrange(200)}", f"n{i}") for i in range(200)]
    links += [(None, "n3"), ("n4", None), links[7]]
    assert solved(spark, links, per_task) == brute(links)


def test_long_chain_over_many_partitions(spark):
    order = random.Random(5).sample(range(300), 300)
    links = [(f"n{a:03}", f"n{b:03}") for a, b in zip(order, order[1:])]
    assert solved(spark, links, 20) == brute(links)


def test_cycle_over_many_partitions_and_below_it(spark):
    order = random.Random(6).sample(range(120), 120)
    links = [(f"n{a:03}", f"n{b:03}") for a, b in zip(order, order[1:] + order[:1])] + [("n005", "leaf"), ("leaf", "leaf2"), ("self", "self")]
    assert set(solved(spark, links, 10).values()) == {("", -1, None)}


def test_empty_and_descendants(spark):
    assert solved(spark, [], 5) == {}
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "x")], "source_id string, target_id string")
    pairs = descendants(hierarchy(df, with_path=True)).collect()
    assert sorted(tuple(r) for r in pairs) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


@pytest.mark.parametrize("per_task", [7, 30])
def test_more_roots_than_one_task_holds(spark, monkeypatch, per_task):
    rng, solve = random.Random(8), H._solve

    def bounded(nodes, level, *rest):
        assert level < 9, "no end"
        return solve(nodes, level, *rest)

    monkeypatch.setattr(H, "_solve", bounded)
    names = [f"n{i:03}" for i in rng.sample(range(160), 160)]
    links = [(names[i], names[i + 50]) for i in range(50)] + [(names[50 + i], names[100 + i]) for i in range(40)] + [(names[140], names[141]), (names[141], names[140]), (names[141], names[142])]
    assert solved(spark, links, per_task) == brute(links)


@pytest.mark.parametrize("hub", [5, 1000])
def test_hubs_below_hubs(spark, hub):
    rng = random.Random(9)
    # three hubs in a chain, their children with children of their own
    links = [("root", "hub0"), ("hub0", "mid"), ("mid", "hub1"), ("hub1", "hub2")]
    links += [(f"hub{rng.randrange(3)}", f"c{i:03}") for i in rng.sample(range(150), 150)] + [(f"c{rng.randrange(150):03}", f"d{i:03}") for i in range(60)]
    assert solved(spark, links, 12, hub) == brute(links)


def test_children_of_a_hub_stay_spread(spark):
    parts, leaves = 8, 4000
    df = spark.createDataFrame([("root", "hub", 1), *[("hub", f"c{i}", 1) for i in range(leaves)]], "parent string, node string, weight long")
    for level in (1, 2, 3):
        sizes = H._placed(df, level, parts, 1000).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert max(r["count"] for r in sizes) < 3 * leaves / parts


def test_sizes_of_subtrees(spark):
    rng = random.Random(12)
    chain = [(f"a{i}", f"a{i + 1}") for i in range(37)]
    tree = [(f"t{rng.randrange(i)}", f"t{i}") for i in range(1, 120)] + [("t0", f"leaf{i}") for i in range(30)]
    links = chain + tree + tree[:5] + [("x", "y"), ("y", "x"), ("y", "z"), (None, "q"), ("s", "s")]
    got = {r.node_id: (r.descendants, r.height) for r in subtree_sizes(spark.createDataFrame(links, "source_id string, target_id string")).collect()}
    want = {}
    for node, (root, depth, path) in brute(links).items():
        for up, above in enumerate(reversed((path or [])[:-1]), 1):
            n, h = want.get(above, (0, 0))
            want[above] = (n + 1, max(h, up))
    assert got == want
    assert subtree_sizes(spark.createDataFrame([], "source_id string, target_id string")).count() == 0
