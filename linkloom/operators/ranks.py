"""Row numbers within a key, where one key may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.session import cut


def numbered_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "at", total: str | None = "of") -> DataFrame:
    """Adds the number of each row within its key, from 1 on, and the number of rows of the key.

    Rows are ranged by key and order, so that a heavy key is spread over as many partitions as it needs;
    numbers count on over the partitions of a key. Only one row for each key and partition is windowed.
    Null keys are a key like any other; rows that tie in ``order`` are numbered in any order.
    """
    columns = df.columns
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).sortWithinPartitions(*keys, *order)
    placed = cut(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq")))
    heads = placed.groupBy(*keys, "_part").agg(F.min("_seq").alias("_head"), F.count("*").alias("_rows"))
    of_key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_rows").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_head", before.alias("_before"), F.sum("_rows").over(of_key).alias("_total"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = placed.join(heads, same)
    more = [F.col("_total").alias(total)] if total else []
    return joined.select(*columns, (F.col("_seq") - F.col("_head") + F.col("_before") + 1).alias(name), *more)
