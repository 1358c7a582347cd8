"""Per-key results where a few keys hold most of the rows.

Rows are ranged by (key, secondary order) with Spark's sampled quantiles, so a heavy key is spread
over as many partitions as its share needs. Every partition then folds its sorted rows into one
partial state per key in a single pass; only the first and the last key of a partition can go on in
a neighbour, and only those boundary states are shuffled and stitched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.session import cut


def _changed(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before; nulls are equal to each other."""
    codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


def _states(keys: int, top: int):
    """Folds sorted batches (keys..., o, l) into rows (keys..., part, open, n, orders, lo, hi, l)."""

    def fold(batch: pa.RecordBatch):
        size = batch.num_rows
        new_key = np.zeros(size - 1, bool)
        for i in range(keys):
            new_key |= _changed(batch.column(i))
        order = batch.column(keys)
        new_order = new_key | _changed(order)
        starts = np.concatenate([[0], np.flatnonzero(new_key) + 1])
        ends = np.concatenate([starts[1:], [size]])
        run = np.zeros(size, np.int64)
        run[starts[1:]] = 1
        run = np.cumsum(run)
        fresh = np.concatenate([[True], new_order]) & order.is_valid().to_numpy(zero_copy_only=False)
        orders = np.bincount(run[fresh], minlength=len(starts))
        # nulls sort first, so the first non-null order value of a run is its smallest
        valid = np.flatnonzero(order.is_valid().to_numpy(zero_copy_only=False))
        lo_at = np.full(len(starts), -1)
        if len(valid):
            r, i = np.unique(run[valid], return_index=True)
            lo_at[r] = valid[i]
        lo = order.take(pa.array(np.where(lo_at < 0, None, lo_at), pa.int64()))
        hi = order.take(pa.array(ends - 1))
        lists = batch.column(keys + 1)
        of_row = np.repeat(np.arange(size), np.asarray(lists.value_lengths().fill_null(0)))
        values = lists.flatten()
        kept = values.is_valid().to_numpy(zero_copy_only=False)
        pairs = np.unique(np.stack([run[of_row][kept], np.asarray(values.drop_null(), np.int64)], 1), axis=0) if kept.any() else np.zeros((0, 2), np.int64)
        first = np.searchsorted(pairs[:, 0], np.arange(len(starts)))
        pairs = pairs[np.arange(len(pairs)) - first[pairs[:, 0]] < top]
        offsets = np.searchsorted(pairs[:, 0], np.arange(len(starts) + 1))
        lines = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pairs[:, 1], pa.int64()))
        return [batch.column(i).take(pa.array(starts)) for i in range(keys)], ends - starts, orders, lo, hi, lines

    def merged(a: dict, b: dict) -> dict:
        """Two states of one key, b right after a."""
        same = a["hi"] is not None and a["hi"] == b["lo"]
        return a | {
            "n": a["n"] + b["n"], "orders": a["orders"] + b["orders"] - same,
            "lo": a["lo"] if a["lo"] is not None else b["lo"], "hi": b["hi"],
            "lines": sorted(set(a["lines"]) | set(b["lines"]))[:top],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, first_key = TaskContext.get().partitionId(), None, True
        schema: pa.Schema | None = None

        def out(columns, n, orders, lo, hi, lines, is_open):
            size = len(n)
            arrays = [*columns, pa.array(np.full(size, part), pa.int32()), pa.array(np.full(size, is_open)), pa.array(n, pa.int64()), pa.array(orders, pa.int64()), lo, hi, lines]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        def one(state: dict, is_open: bool):
            cols = [pa.array([v], schema.field(i).type) for i, v in enumerate(state["key"])]
            kind = schema.field("lo").type
            return out(cols, [state["n"]], [state["orders"]], pa.array([state["lo"]], kind), pa.array([state["hi"]], kind), pa.array([state["lines"]], pa.list_(pa.int64())), is_open)

        for batch in batches:
            if not batch.num_rows:
                continue
            if schema is None:
                fields = [pa.field(f"k{i}", batch.schema.field(i).type) for i in range(keys)]
                kind = batch.schema.field(keys).type
                schema = pa.schema([*fields, ("part", pa.int32()), ("open", pa.bool_()), ("n", pa.int64()), ("orders", pa.int64()), ("lo", kind), ("hi", kind), ("lines", pa.list_(pa.int64()))])
            columns, n, orders, lo, hi, lines = fold(batch)
            count = len(n)
            at = lambda i: {"key": tuple(c[i].as_py() for c in columns), "n": int(n[i]), "orders": int(orders[i]), "lo": lo[i].as_py(), "hi": hi[i].as_py(), "lines": lines[i].as_py()}  # noqa: E731, B023
            head, start = at(0), 0
            if last is not None and last["key"] == head["key"]:
                last, start = merged(last, head), 1
            # between the carried state and the last run of this batch everything is complete
            if start < count:
                if last is not None:
                    yield one(last, first_key)
                    first_key = False
                if first_key and start < count - 1:
                    yield one(at(start), True)
                    first_key, start = False, start + 1
                if start < count - 1:
                    cutout = slice(start, count - 1)
                    size = count - 1 - start
                    yield out([c.slice(start, size) for c in columns], n[cutout], orders[cutout], lo.slice(start, size), hi.slice(start, size), lines.slice(start, size), False)
                last = at(count - 1)
        if last is not None:
            yield one(last, True)

    return run


def key_states(df: DataFrame, keys: dict[str, Column], order: Column, tie: Column, lines: Column, top: int = 5, partitions: int | None = None) -> DataFrame:
    """One row per key: columns of ``keys``, n_rows, n_orders, first_order, lines.

    ``n_orders`` counts distinct non-null values of ``order``, ``first_order`` is the smallest of
    them (null if there is none) and ``lines`` holds the ``top`` smallest distinct numbers of the
    array column ``lines``. Null keys are keys like any other and repeated rows count each time; an
    empty table gives no rows. ``tie`` splits rows that agree on key and order, so even one single
    (key, order) value with a third of all rows is spread out. Only the named expressions are read,
    so further columns of df, whatever their names, change nothing.
    """
    names = list(keys)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = df.select(*[c.alias(f"k{i}") for i, c in enumerate(keys.values())], order.alias("o"), lines.cast("array<bigint>").alias("l"), tie.alias("t"))
    by = [F.col(f"k{i}") for i in range(len(names))]
    ranged = slim.repartitionByRange(n, *by, "o", "t").sortWithinPartitions(*by, "o").drop("t")
    kinds = dict(ranged.dtypes)
    schema = ", ".join([f"k{i} {kinds[f'k{i}']}" for i in range(len(names))] + ["part int, open boolean, n bigint, orders bigint", f"lo {kinds['o']}, hi {kinds['o']}, lines array<bigint>"])
    # read twice below, a row per key: cut it, else the sort would run twice
    partial = cut(ranged.mapInArrow(_states(len(names), top), schema))

    before = Window.partitionBy(*by).orderBy("part")
    joined = F.coalesce((F.last("hi", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)) == F.col("lo")).cast("long"), F.lit(0))
    stitched = (
        partial.filter("open")
        .withColumn("orders", F.col("orders") - joined)
        .groupBy(*by)
        .agg(F.sum("n").alias("n"), F.sum("orders").alias("orders"), F.min("lo").alias("lo"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))), 1, top).alias("lines"))
    )
    cols = [*by, "n", "orders", "lo", "lines"]
    whole = partial.filter("not open").select(*cols).unionByName(stitched.select(*cols))
    return whole.select(*[c.alias(names[i]) for i, c in enumerate(by)], F.col("n").alias("n_rows"), F.col("orders").alias("n_orders"), F.col("lo").alias("first_order"), "lines")


def edge_key_states(edges: DataFrame) -> DataFrame:
    """The states of each (target_id, type) of an edge table, null keys included."""
    lines = F.from_json("metadata", "lines array<bigint>")["lines"]
    return key_states(
        edges, {"target_id": F.col("target_id"), "type": F.col("type")}, F.col("source_id"), F.xxhash64("id", "loaded_at"), lines
    ).withColumnsRenamed({"n_orders": "n_sources", "first_order": "first_source"})


def heavy_pairs(edges: DataFrame, share: float = 0.02) -> DataFrame:
    """(target_id, type), both non-null, that hold at least ``share`` of all rows as delivered."""
    states = edge_key_states(edges)
    least = (states.agg(F.sum("n_rows")).first()[0] or 0) * share  # all rows, without another scan
    return states.filter(F.col("target_id").isNotNull() & F.col("type").isNotNull() & (F.col("n_rows") >= least)).select("target_id", "type")
