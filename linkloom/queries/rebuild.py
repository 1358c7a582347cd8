"""Queries that run the build over occurrences which Spark derives from the stored relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.symbols import with_symbol
from linkloom.functions.text import clean_path
from linkloom.operators import graph
from linkloom.plans.build import Built, build
from linkloom.queries.graph import _L, _N, _m, _manifest
from linkloom.session import cut, table


def _stored(spark: SparkSession, d: str) -> DataFrame:
    n = graph.distinct_nodes(table(spark, d, "nodes")).filter("type not in ('FILE', 'MODULE', 'EXTERNAL')")
    return n.withColumn("symbol", F.get_json_object("metadata", "$.symbol"))


def symbol_ids(spark: SparkSession, d: str) -> DataFrame:
    """Id and qualified name of every stored symbol but namespaces, parsed again from its symbol string."""
    n = _stored(spark, d).filter("symbol is not null and type != 'NAMESPACE'").select(F.col("id").alias("stored_id"), "symbol")
    parsed = with_symbol(n)
    return parsed.select("stored_id", "symbol_id", "qualified", "name")


def decoded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """documents, occurrences, symbols and files as an index of this code base would give them.

    Files are those of the last snapshot; definitions are the stored symbols with their lines,
    references the lines of the stored edges, in the file of their source.
    """
    files = _manifest(spark, d).select(F.col("file_path").alias("path"), "language", "size", F.col("content_hash").alias("hash"), "lines")
    n = cut(_stored(spark, d).filter("symbol is not null and file_path is not null").withColumn("path", clean_path(F.col("file_path"))).select("id", "type", "path", "symbol", "start_line", "end_line", "doc", "signature"))
    number = F.xxhash64("path")
    zero = F.lit(0).cast("int").alias("input_ord")
    line = lambda c: (F.col(c) - 1).cast("int")
    ok = (F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line"))
    defs = n.filter(ok).select("path", F.xxhash64("id").alias("occ_ord"), "symbol", F.lit(1).alias("symbol_roles"), F.array(line("start_line"), F.lit(4), F.lit(9)).alias("range"), F.array(line("start_line"), F.lit(0), line("end_line"), F.lit(999)).alias("enclosing_range"))
    symbol_of = n.select(F.col("id").alias("target"), "symbol")
    place = n.select(F.col("id").alias("source"), "path")
    links = graph.link_lines(graph.links(table(spark, d, "edges")).filter("kind in ('CALLS', 'REFERENCES')")).select("source", "target", F.col("line").alias("at")).distinct()
    refs = links.join(place, "source").join(symbol_of, "target").select("path", F.xxhash64("source", "target", "at").alias("occ_ord"), "symbol", F.lit(0).alias("symbol_roles"), F.array((F.col("at") - 1).cast("int"), F.lit(20), F.lit(25)).alias("range"), F.array().cast("array<int>").alias("enclosing_range"))
    occurrences = defs.unionByName(refs).select(zero, number.alias("doc_ord"), "occ_ord", "symbol", "symbol_roles", "range", "enclosing_range")
    documents = n.select("path").distinct().select(zero, number.alias("doc_ord"), "path", F.lit(None).cast("string").alias("language"), F.lit("derived").alias("tool"))
    kinds = {"CLASS": "Class", "INTERFACE": "Interface", "STRUCT": "Struct", "ENUM": "Enum", "TRAIT": "Trait", "FUNCTION": "Function", "METHOD": "Method", "FIELD": "Field", "VARIABLE": "Variable", "CONSTANT": "Constant", "NAMESPACE": "Namespace"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("type"))
    symbols = n.select(zero, number.alias("doc_ord"), F.xxhash64("id").alias("sym_ord"), "symbol", kind.alias("kind"), F.lit(None).cast("string").alias("display_name"), F.array("doc").alias("documentation"), F.col("signature").alias("signature_text"), F.array().cast("array<struct<symbol:string,is_implementation:boolean>>").alias("relationships"))
    return documents, occurrences, symbols, files


def _built(spark: SparkSession, d: str) -> Built:
    return build(*decoded(spark, d))


def rebuilt_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a build over the derived index, by kind, with the nodes they join."""
    e = _built(spark, d).edges
    return e.groupBy("kind").agg(F.count("*").alias("edges"), F.sum("n").alias("references"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"))


def rebuilt_stats(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).stats


QUERIES = {f.__name__: f for f in (symbol_ids, rebuilt_graph, rebuilt_stats)}
# The counts of the build by the stored ids alone: every stored symbol is defined where its lines say.
_COUNTED = rf"""s AS (SELECT id, type, regexp_replace(id, '~\d+$', '') sid, start_line, end_line, regexp_replace(regexp_replace(replace(file_path, '\', '/'), '/+', '/', 'g'), '^(\./)+', '') path
  FROM n WHERE type NOT IN ('FILE','MODULE','EXTERNAL') AND j->>'$.symbol' IS NOT NULL AND file_path IS NOT NULL),
docs AS (SELECT DISTINCT path, path IN (SELECT file_path FROM m) used FROM s),
defs AS (SELECT s.*, regexp_extract(sid, '^([^:]*:[^:]*):', 1) package FROM s JOIN docs USING (path) WHERE used AND start_line >= 1 AND start_line <= end_line),
lines AS (SELECT DISTINCT source, target, line FROM (SELECT source, target, unnest(CAST(json_extract(j, '$.lines') AS BIGINT[])) line FROM raw WHERE kind IN ('CALLS', 'REFERENCES')) WHERE line IS NOT NULL),
refs AS (SELECT CASE WHEN t.sid IN (SELECT sid FROM defs) THEN 'resolved' WHEN regexp_extract(t.sid, '^([^:]*:[^:]*):', 1) IN (SELECT package FROM defs) THEN 'unresolved' ELSE 'external' END outcome
  FROM lines l JOIN s f ON f.id = l.source JOIN docs ON docs.path = f.path JOIN s t ON t.id = l.target WHERE docs.used AND t.type <> 'NAMESPACE')"""

ORACLE = {
    "rebuilt_stats": f"""WITH {_N}, {_L}, {_m()}, {_COUNTED} SELECT 'documents' name, count(*) FILTER (used) "value" FROM docs UNION ALL SELECT 'ignored_documents', count(*) FILTER (NOT used) FROM docs
      UNION ALL SELECT 'duplicate_documents', 0 UNION ALL SELECT 'definitions', count(*) FROM defs UNION ALL SELECT 'duplicate_definitions', count(*) - count(DISTINCT sid) FROM defs
      UNION ALL SELECT o, (SELECT count(*) FROM refs WHERE outcome = o) FROM (VALUES ('resolved'), ('external'), ('unresolved')) v(o)""",
    "symbol_ids": f"""WITH {_N} SELECT id stored_id, regexp_replace(id, '~\\d+$', '') symbol_id, j->>'$.qualified' qualified, name FROM n
      WHERE type NOT IN ('FILE','MODULE','EXTERNAL','NAMESPACE') AND j->>'$.symbol' IS NOT NULL""",
}
