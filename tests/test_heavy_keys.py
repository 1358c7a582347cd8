import random

from pyspark.sql import functions as F

from linkloom.operators.heavy_keys import edge_key_states, heavy_pairs, key_states

SCHEMA = "id long, source_id string, target_id string, type string, metadata string, loaded_at timestamp"


def edges(spark, rows):
    return spark.createDataFrame([(i, *r, None) for i, r in enumerate(rows)], SCHEMA)


def brute(rows):
    out = {}
    for s, t, k, lines in rows:
        n, sources, seen = out.setdefault((t, k), [0, set(), set()])
        out[t, k][0] = n + 1
        sources |= {s} - {None}
        seen |= set(lines)
    return {key: (n, len(s), min(s, default=None), sorted(x)[:5]) for key, (n, s, x) in out.items()}


def test_one_key_with_most_rows_is_stitched_from_many_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *"abcdef"]), "hub" if rng.random() < 0.7 else rng.choice([None, "x", "y"]), rng.choice(["CALLS", "CALLS", None]), rng.sample(range(9), 3)) for _ in range(4000)]
    df = edges(spark, [(s, t, k, '{"count":1,"lines":%s}' % ls) for s, t, k, ls in rows])
    lines = F.from_json("metadata", "lines array<bigint>")["lines"]
    got = key_states(df, {"t": F.col("target_id"), "k": F.col("type")}, F.col("source_id"), F.col("id"), lines, partitions=9)
    assert {(r.t, r.k): (r.n_rows, r.n_orders, r.first_order, r.lines) for r in got.collect()} == brute(rows)


def test_batches_carry_a_key_on(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f"s{i % 11}", "hub" if i % 5 else f"t{i % 3}", "USES", [i % 4]) for i in range(300)]
        got = edge_key_states(edges(spark, [(s, t, k, '{"lines":%s}' % ls) for s, t, k, ls in rows]))
        assert {(r.target_id, r.type): (r.n_rows, r.n_sources, r.first_source, r.lines) for r in got.collect()} == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nulls_empty_metadata_and_extra_columns(spark):
    rows = [(None, None, None, None), ("s", "t", "CALLS", ""), ("s", "t", "CALLS", '{"lines":[3'), ("s", "t", "CALLS", "{}")]
    df = edges(spark, rows).withColumns({"n": F.lit(1), "part": F.lit("x"), "k0": F.lit(2), "lines": F.lit(3)})
    got = {(r.target_id, r.type): (r.n_rows, r.n_sources, r.lines) for r in edge_key_states(df).collect()}
    assert got == {(None, None): (1, 0, []), ("t", "CALLS"): (3, 1, [])}


def test_empty_table_and_share(spark):
    assert heavy_pairs(edges(spark, [])).count() == 0
    df = edges(spark, [("s", "hub", "CALLS", "{}")] * 3 + [("s", None, "CALLS", "{}")] * 96 + [("s", "rare", "CALLS", "{}")])
    assert [tuple(r) for r in heavy_pairs(df).collect()] == [("hub", "CALLS")]
