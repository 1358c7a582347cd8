"""Edge counts kept up to date from a stream of delivered edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def link_counts(edges: DataFrame, late: str = "30 days") -> DataFrame:
    """Counts per (source_id, target_id, type) of a stream of edge rows, each delivered row once.

    Rows delivered again within ``late`` of the newest arrival are dropped by id, which bounds the state.
    Rows without an end or a type have no key and are left out.
    """
    timed = edges.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).withWatermark("loaded_at", late)
    once = timed.dropDuplicatesWithinWatermark(["id"])
    whole = once.filter("source_id is not null and target_id is not null and type is not null")
    n = F.coalesce(F.get_json_object("metadata", "$.count").cast("bigint"), F.lit(1))
    return whole.groupBy("source_id", "target_id", "type").agg(F.sum(n).alias("n"), F.count("*").alias("rows"))


def keep_counts(edges: DataFrame, path: str, checkpoint: str, late: str = "30 days") -> StreamingQuery:
    """Runs over what is there and writes changed counts, a folder per batch; the last batch of a key counts."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return link_counts(edges, late).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest_counts(counts: DataFrame) -> DataFrame:
    keys = ["source_id", "target_id", "type"]
    return counts.groupBy(*keys).agg(F.max_by(F.struct("n", "rows"), "batch").alias("v")).select(*keys, "v.n", "v.rows")
