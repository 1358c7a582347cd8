"""Relations between symbols: aggregated edges, fan counts, roll-ups, resolution, structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.text import dir_of

#: Kinds that count for fan-in and fan-out, and their rank in answers.
FAN_KINDS = ["CALLS", "REFERENCES", "IMPLEMENTS", "USES", "DEPENDS_ON"]
CALLABLE = ["FUNCTION", "METHOD", "MACRO"]
#: Lines of a file in the smallest buckets of the interval join, by how much each next kind of bucket is
#: larger, and how many kinds there are; a span takes buckets of a kind of which it fills few.
BUCKET_LINES, BUCKET_STEP, BUCKET_KINDS = 64, 16, 5


def priority(kind: Column) -> Column:
    return F.when(kind == "CALLS", 0).when(kind == "IMPLEMENTS", 1).when(kind == "REFERENCES", 2).when(kind == "USES", 3).otherwise(4)


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node id with typed metadata; of rows that differ the greatest counts."""
    meta = F.from_json("metadata", "qualified string, signature string, doc string, package string, indexer string, duplicateOf string, fanIn bigint, fanOut bigint")
    cols = ["type", "name", "file_path", "start_line", "end_line", "language", "metadata"]
    one = nodes.filter("id is not null").groupBy("id").agg(F.max(F.struct(*cols)).alias("v"))
    return one.select("id", *[F.col("v")[c].alias(c) for c in cols]).select("*", *[meta[c].alias(c) for c in ("qualified", "signature", "doc", "package", "indexer", "duplicateOf")])


def links(edges: DataFrame) -> DataFrame:
    """Edges as delivered once, with both ends and a kind: source, target, kind, n, lines."""
    meta = F.from_json("metadata", "count bigint, lines array<bigint>")
    once = edges.select("id", "source_id", "target_id", "type", "metadata").distinct()
    whole = once.filter("source_id is not null and target_id is not null and type is not null")
    return whole.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("type").alias("kind"), F.coalesce(meta["count"], F.lit(1)).alias("n"), meta["lines"].alias("lines"))


def aggregate_links(refs: DataFrame, lines: int = 5) -> DataFrame:
    """One row per (source, target, kind): the sum of counts and the first distinct lines."""
    flat = F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines"))))
    return refs.groupBy("source", "target", "kind").agg(F.sum("n").alias("n"), F.slice(F.coalesce(flat, F.array().cast("array<bigint>")), 1, lines).alias("lines"))


def link_lines(refs: DataFrame) -> DataFrame:
    """Every distinct (source, target, kind, line) of the links as delivered."""
    return refs.select("source", "target", "kind", F.explode("lines").alias("line")).filter("line is not null").distinct()


def fan(refs: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out): distinct other ends over the kinds that count, a node's own links left out."""
    pairs = refs.filter(F.col("kind").isin(FAN_KINDS) & (F.col("source") != F.col("target"))).select("source", "target").distinct()
    ends = pairs.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(pairs.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def with_fan(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    return nodes.join(fan(refs), "id", "left").fillna(0, ["fan_in", "fan_out"])


def _by_place(refs: DataFrame, nodes: DataFrame, place: Column) -> DataFrame:
    """References between places. They are summed per place and target before the join on the target,
    which may hold a third of all rows."""
    at = nodes.select("id", place.alias("place")).filter("place is not null")
    used = refs.filter(F.col("kind").isin("CALLS", "REFERENCES")).join(at.withColumnsRenamed({"id": "source", "place": "from_place"}), "source")
    summed = used.groupBy("from_place", "target").agg(F.sum("n").alias("n"))
    both = summed.join(at.withColumnsRenamed({"id": "target", "place": "to_place"}), "target")
    return both.filter("from_place != to_place").groupBy("from_place", "to_place").agg(F.sum("n").alias("n"))


def file_dependencies(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    return _by_place(refs, nodes, F.col("file_path"))


def dir_dependencies(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    return _by_place(refs, nodes, dir_of(F.col("file_path")))


def span_buckets(start: Column, end: Column) -> Column:
    """Buckets (kind, bucket) of a span: at most BUCKET_STEP + 1, however long it is, as wrong ends of
    lines are; the last kind is one bucket for all that is longer."""
    out = F.array(F.struct(F.lit(BUCKET_KINDS).alias("level"), F.lit(0).cast("bigint").alias("bucket")))
    for k in reversed(range(BUCKET_KINDS)):
        size, level = BUCKET_LINES * BUCKET_STEP**k, F.lit(k)
        first, last = F.floor(start / size), F.floor(end / size)
        own = F.sequence(first, F.least(last, first + BUCKET_STEP))
        out = F.when(last - first <= BUCKET_STEP, F.arrays_zip(F.array_repeat(level, F.size(own)).alias("level"), own.alias("bucket"))).otherwise(out)
    return F.explode(out)


def point_buckets(at: Column) -> Column:
    """The bucket of a line of each kind."""
    own = [F.struct(F.lit(k).alias("level"), F.floor(at / (BUCKET_LINES * BUCKET_STEP**k)).cast("bigint").alias("bucket")) for k in range(BUCKET_KINDS)]
    return F.explode(F.array(*own, F.struct(F.lit(BUCKET_KINDS).alias("level"), F.lit(0).cast("bigint").alias("bucket"))))


def innermost_enclosing(points: DataFrame, spans: DataFrame, by: str, at: str, carried: list[str]) -> DataFrame:
    """Each point (by, at, carried...) with the id of the innermost span (by, start, end, id) around it.

    Of the spans of the same ``by`` with start <= at <= end the one that starts last counts, of these the
    one that ends first, then the greatest id; null without any. Spans are cut into buckets of lines, so
    that one long file meets in many small groups and not in one.
    """
    cut = spans.filter("start <= end").select(by, "start", "end", "id", span_buckets(F.col("start"), F.col("end")).alias("b")).select(by, "start", "end", "id", "b.*")
    placed = points.select(by, at, *carried, point_buckets(F.col(at)).alias("b")).select(by, at, *carried, "b.*")
    near = placed.join(cut, [by, "level", "bucket"], "left")
    inside = (F.col("start") <= F.col(at)) & (F.col(at) <= F.col("end"))
    best = F.max(F.when(inside, F.struct("start", (-F.col("end")).alias("e"), "id"))).getField("id")
    return near.groupBy(by, at, *carried).agg(best.alias("enclosing"))


def resolve(refs: DataFrame, nodes: DataFrame, packages: DataFrame) -> DataFrame:
    """refs (source, target, package) with outcome: resolved, unresolved (of a project package), external,
    or dropped (not a node and of no package). packages is one column ``package``, the project's own."""
    known = nodes.select(F.col("id").alias("target"), F.lit(True).alias("known"))
    own = packages.select("package", F.lit(True).alias("own")).distinct()
    tagged = refs.join(known, "target", "left").join(own, "package", "left")
    outcome = F.when(F.col("known"), "resolved").when(F.col("package").isNull(), "dropped").when(F.col("own"), "unresolved").otherwise("external")
    return tagged.withColumn("outcome", outcome).drop("known", "own")


def dangling(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of refs with an end that is no node: (source, target, kind, missing)."""
    ids = nodes.select("id")

    def lost(end: str) -> DataFrame:
        # each end once, however many rows have it
        gone = refs.select(end).distinct().join(ids.withColumnRenamed("id", end), end, "left_anti")
        return refs.join(gone, end, "left_semi").select("source", "target", "kind", F.lit(end).alias("missing"))

    return lost("source").unionByName(lost("target"))


def numbered_definitions(defs: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The nth definition of a key: number n, and the key with ``~n`` from the second on."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return defs.withColumn("n", n).withColumn("node_id", F.when(F.col("n") == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("~"), F.col("n").cast("string"))))


def first_of(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key, with the number of rows it stands for."""
    cols = [c for c in df.columns if c != key]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *cols)
    one = df.groupBy(key).agg(F.min(rank).alias("v"), F.count("*").alias("rows"))
    return one.select(key, *[F.col("v")[c].alias(c) for c in cols], "rows")


def topmost(dirs: DataFrame, column: str = "dir") -> DataFrame:
    """The dirs that have no proper ancestor among the dirs; "" is the ancestor of all.

    Ancestors are spelled out and joined on equality, so no pair of dirs is compared.
    """
    d = dirs.select(column).filter(F.col(column).isNotNull()).distinct()
    parts = F.split(column, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    spelled = d.filter(F.col(column) != "").select(F.col(column).alias("own"), F.explode(above).alias(column))
    nested = spelled.join(d, column, "left_semi").select(F.col("own").alias(column)).distinct()
    return d.join(nested, column, "left_anti")
