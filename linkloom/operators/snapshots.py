"""What changed between consecutive full snapshots of a keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.text import clean_path


def snapshot_changes(df: DataFrame, key: Column, number: Column, digest: Column, arrived: Column) -> DataFrame:
    """Rows (snapshot_no, key, change, old_digest, new_digest) of all snapshots at once.

    The rows of a key lie side by side, ordered by snapshot number: a lagged digest that differs is a
    ``changed``; a gap in the numbers is a ``removed`` at the number after it began and an ``added``
    where it ended. Numbers run without gap from the smallest to the largest in the table; a missing
    snapshot is one in which nothing existed.

    Of several rows of a key and snapshot the latest arrival counts (null arrival first; of equal
    arrivals the greatest digest, null least). Rows with a null key or number are ignored. A null
    digest on either side is no change. An empty table gives no rows. Rows are reduced to one per key
    and snapshot before they meet, so a key with a third of all rows is no burden.
    """
    slim = df.select(key.alias("key"), number.cast("int").alias("snapshot_no"), F.struct(arrived.alias("a"), digest.alias("d")).alias("v")).filter("key is not null and snapshot_no is not null")
    ends = slim.agg(F.min("snapshot_no"), F.max("snapshot_no")).first()
    first, last = ends[0] or 0, ends[1] or 0
    one = slim.groupBy("key", "snapshot_no").agg(F.max("v").getField("d").alias("digest"))
    w = Window.partitionBy("key").orderBy("snapshot_no")
    n, prev_n, next_n = F.col("snapshot_no"), F.lag("snapshot_no").over(w), F.lead("snapshot_no").over(w)
    seen = one.select("key", n, "digest", prev_n.alias("prev_n"), F.lag("digest").over(w).alias("prev_digest"), next_n.alias("next_n"))
    event = lambda at, what, old, new: F.struct(at.cast("int").alias("snapshot_no"), F.lit(what).alias("change"), old.alias("old_digest"), new.alias("new_digest"))
    digest_, none = F.col("digest"), F.lit(None).cast("string")
    fresh = (n > first) & (F.col("prev_n").isNull() | (F.col("prev_n") < n - 1))
    gone = (n < last) & (F.col("next_n").isNull() | (F.col("next_n") > n + 1))
    differs = (F.col("prev_n") == n - 1) & (F.col("prev_digest") != digest_)
    events = F.array_compact(
        F.array(F.when(fresh, event(n, "added", none, digest_)), F.when(differs, event(n, "changed", F.col("prev_digest"), digest_)), F.when(gone, event(n + 1, "removed", digest_, none)))
    )
    return seen.select("key", F.explode(events).alias("e")).select("e.snapshot_no", "key", "e.change", "e.old_digest", "e.new_digest")


def manifest_changes(manifest: DataFrame) -> DataFrame:
    """Changes of file_manifest by cleaned path; digests without case and surrounding white space."""
    digest = F.lower(F.regexp_replace("content_hash", r"^\s+|\s+$", ""))
    return snapshot_changes(manifest, clean_path(F.col("file_path")), F.col("snapshot_no"), digest, F.col("loaded_at")).withColumnRenamed("key", "file_path")
