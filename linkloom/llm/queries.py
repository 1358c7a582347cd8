"""Registered queries of the problems on training text: 2, 5, 6, 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.documentation import coded, found_ids, pairs, source_texts
from linkloom.llm.encoding import decode, encode
from linkloom.llm.leaks import leaked_pairs, leaks, removal_spans
from linkloom.llm.mojibake import garbled, restored
from linkloom.llm.source_kind import classify, manifest_files
from linkloom.session import cut, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return classify(table(spark, d, "file_manifest")).select("file_path")


def p2_kinds(spark: SparkSession, d: str) -> DataFrame:
    return classify(table(spark, d, "file_manifest")).groupBy("kind").agg(F.count("*").alias("files"))


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """What the evidence starts from: one row per file over all snapshots."""
    return manifest_files(table(spark, d, "file_manifest"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return found_ids(table(spark, d, "nodes"), table(spark, d, "source_files"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs(table(spark, d, "nodes"), table(spark, d, "source_files"))


def p5_code(spark: SparkSession, d: str) -> DataFrame:
    """The functions with code in a delivered text: its lines, documented or not."""
    return coded(table(spark, d, "nodes"), source_texts(table(spark, d, "source_files"))).select("node_id", "file_path", "start_line", "end_line", "n_lines").distinct()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def p6_without_ids(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose list of ids is empty."""
    return p6_ids(spark, d).filter(F.size("ids") == 0).select("doc_id")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and text, through ids and back: the text as it was, empty for null."""
    return decode(cut(encode(table(spark, d, "documents"))))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_pairs(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return removal_spans(found).withColumn("items", F.array_join("items", ","))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled(table(spark, d, "documents"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return restored(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_kinds, p2_files, p5_found, p5_pairs, p5_code, p6_ids, p6_without_ids, p6_round_trip, p7_found, p7_spans, p8_found, p8_restored)}

ORACLE = {
    "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p6_without_ids": "SELECT doc_id FROM documents WHERE coalesce(text, '') = ''",
    "p2_files": r"""WITH f AS (SELECT regexp_replace(regexp_replace(replace(file_path, '\', '/'), '/+', '/', 'g'), '^(\./)+', '') file_path, CAST(size AS DOUBLE) size, CAST(lines AS DOUBLE) lines,
      lower(trim("language", ' ')) given FROM file_manifest WHERE file_path IS NOT NULL), g AS (SELECT file_path, avg(size) size, avg(lines) lines, max(given) given FROM f GROUP BY 1)
      SELECT file_path, size, lines, coalesce(CASE lower(regexp_extract(file_path, '\.([^./]+)$', 1)) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'pyi' THEN 'python'
      WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'mts' THEN 'typescript' WHEN 'cts' THEN 'typescript'
      WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' END,
      CASE WHEN given IN ('rust', 'typescript', 'javascript', 'python', 'other') THEN given END, 'other') "language" FROM g""",
    "p5_code": """WITH t AS (SELECT file_path, max(text) text FROM source_files WHERE file_path IS NOT NULL AND text IS NOT NULL GROUP BY 1),
      l AS (SELECT file_path, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END AS INT) n_lines FROM t)
      SELECT DISTINCT n.id node_id, n.file_path, n.start_line, n.end_line, l.n_lines FROM nodes n JOIN l USING (file_path)
      WHERE n.id IS NOT NULL AND n.type IN ('FUNCTION', 'METHOD') AND n.start_line >= 1 AND n.start_line <= n.end_line AND n.end_line <= l.n_lines""",
}
