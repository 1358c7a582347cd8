"""Versioned snapshots of a build: written whole, checked, then made current by one rename of a pointer."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.graph import dangling

SCHEMA_VERSION = 2
RELATIONS = ("nodes", "edges", "manifest", "stats")


class BrokenSnapshot(ValueError):
    """The new relations don't belong together; the current snapshot stays as it is."""


def _hadoop(spark: SparkSession, path: str):
    """File context, constructor of paths and options of the file system that holds the path."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return fs.FileContext.getFileContext(fs.Path(path).getFileSystem(conf).getUri(), conf), fs


def _pointer(spark: SparkSession, root: str) -> dict | None:
    context, fs = _hadoop(spark, root)
    if not context.util().exists(fs.Path(f"{root}/CURRENT")):
        return None
    return json.loads("".join(r.value for r in spark.read.text(f"{root}/CURRENT").collect()))  # a single line


def _point(spark: SparkSession, root: str, version: dict) -> None:
    """Writes the pointer beside the current one, then puts it in its place by one rename, so a reader
    finds the old pointer or the new one, never none."""
    context, fs = _hadoop(spark, root)
    jvm, following = spark.sparkContext._jvm, fs.Path(f"{root}/CURRENT.next")
    flags = jvm.java.util.EnumSet.of(fs.CreateFlag.CREATE, fs.CreateFlag.OVERWRITE)
    none = spark.sparkContext._gateway.new_array(fs.Options.CreateOpts, 0)
    out = context.create(following, flags, none)
    out.write(bytearray(json.dumps(version).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    over[0] = getattr(fs, "Options$Rename").OVERWRITE
    context.rename(following, fs.Path(f"{root}/CURRENT"), over)


def write_snapshot(spark: SparkSession, root: str, relations: dict[str, DataFrame], name: str, meta: dict[str, str] | None = None) -> str:
    """Writes a snapshot and makes it current: RELATIONS and any others given, as index_runs, with ``meta``
    beside the pointer. A dangling edge leaves everything as it was."""
    version = f"{root}/v={name}"
    for key in (*RELATIONS, *(k for k in relations if k not in RELATIONS)):
        relations[key].write.mode("overwrite").parquet(f"{version}/{key}")
    stored = {k: spark.read.parquet(f"{version}/{k}") for k in RELATIONS}
    lost = dangling(stored["edges"], stored["nodes"]).limit(1).collect()
    if lost:
        raise BrokenSnapshot(f"an edge has no {lost[0]['missing']}: {lost[0]['source']} -> {lost[0]['target']}")
    _point(spark, root, {"version": name, "schema_version": SCHEMA_VERSION, "relations": sorted(relations), "meta": meta or {}})
    return version


def _current(spark: SparkSession, root: str) -> dict:
    at = _pointer(spark, root)
    if at is None:
        raise FileNotFoundError(f"no snapshot below {root}: run a build first")
    if at["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"the snapshot has layout {at['schema_version']}, not {SCHEMA_VERSION}: run a build again")
    return at


def open_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The current relations; looked up again at each call, so a newer snapshot is seen."""
    at = _current(spark, root)
    return {k: spark.read.parquet(f"{root}/v={at['version']}/{k}") for k in at["relations"]}


def meta_of(spark: SparkSession, root: str) -> dict[str, str]:
    """What was noted with the current snapshot."""
    return _current(spark, root)["meta"]


def counts(relations: dict[str, DataFrame]) -> DataFrame:
    """One row: nodes, edges, files, covered files."""
    n, e = relations["nodes"].agg(F.count("*").alias("nodes")), relations["edges"].agg(F.count("*").alias("edges"))
    m = relations["manifest"].agg(F.count("*").alias("files"), F.count("indexed_by").alias("covered"))
    rows = [df.select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c))])).alias("k", "v")) for df in (n, e, m)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy().pivot("k", ["nodes", "edges", "files", "covered"]).agg(F.first("v"))


def coverage(relations: dict[str, DataFrame]) -> DataFrame:
    """(language, files, covered) of a snapshot."""
    return relations["manifest"].groupBy("language").agg(F.count("*").alias("files"), F.count("indexed_by").alias("covered"))


def export_json(relations: dict[str, DataFrame], path: str, meta: dict[str, str] | None = None) -> None:
    """The relations as JSON lines, a folder each, and in ``summary`` one line with what was noted, the
    statistics and the coverage by language."""
    for key in relations:
        relations[key].write.mode("overwrite").json(f"{path}/{key}")
    listed = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))  # noqa: E731  # a row for each counter or language
    noted = [F.lit(v).alias(k) for k, v in {"version": str(SCHEMA_VERSION), **(meta or {})}.items()]
    both = listed(relations["stats"], "stats").withColumn("one", F.lit(1)).join(listed(coverage(relations), "coverage").withColumn("one", F.lit(1)), "one")
    both.select(*noted, "stats", "coverage").coalesce(1).write.mode("overwrite").json(f"{path}/summary")
