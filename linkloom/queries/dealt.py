"""Registered queries of the general problems 1, 3 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.heavy_keys import edge_key_states, heavy_pairs
from linkloom.operators.hierarchy import containment, descendants, hierarchy, subtree_sizes
from linkloom.operators.snapshots import manifest_changes
from linkloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_pairs(table(spark, d, "edges"))


def p1_key_states(spark: SparkSession, d: str) -> DataFrame:
    states = edge_key_states(table(spark, d, "edges"))
    return states.select("target_id", "type", "n_rows", "n_sources", "first_source", F.concat_ws(",", "lines").alias("first_lines"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return manifest_changes(table(spark, d, "file_manifest")).select("snapshot_no", "file_path", "change")


def p3_change_counts(spark: SparkSession, d: str) -> DataFrame:
    return manifest_changes(table(spark, d, "file_manifest")).groupBy("snapshot_no", "change").agg(F.count("*").alias("files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(containment(table(spark, d, "edges"))).select("node_id", "root_id", "depth")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy(containment(table(spark, d, "edges")), with_path=True)
    return h.select("node_id", "root_id", "depth", F.array_join("path", " > ").alias("path"))


def p4_descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    return subtree_sizes(containment(table(spark, d, "edges")))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every node with each of its ancestors: as many rows as the depths of all nodes add up to."""
    return descendants(hierarchy(containment(table(spark, d, "edges")), with_path=True))


QUERIES = {f.__name__: f for f in (p1_found, p1_key_states, p3_found, p3_change_counts, p4_found, p4_paths, p4_descendant_counts, p4_descendants)}

_CHANGES = r"""
WITH c AS (SELECT snapshot_no, loaded_at, lower(trim(content_hash, E' \t\n\r\f\v')) h,
                  regexp_replace(regexp_replace(replace(file_path, '\', '/'), '/+', '/', 'g'), '^(\./)+', '') file_path
           FROM file_manifest WHERE file_path IS NOT NULL),
o AS (SELECT file_path, snapshot_no, h FROM (SELECT *, row_number() OVER (PARTITION BY file_path, snapshot_no
      ORDER BY loaded_at DESC NULLS LAST, h DESC NULLS LAST) rn FROM c) WHERE rn = 1),
s AS (SELECT DISTINCT snapshot_no FROM c WHERE snapshot_no > 1),
changes AS (
  SELECT n.snapshot_no, n.file_path, 'added' change FROM o n JOIN s USING (snapshot_no)
    WHERE NOT EXISTS (SELECT 1 FROM o p WHERE p.file_path = n.file_path AND p.snapshot_no = n.snapshot_no - 1)
  UNION ALL SELECT p.snapshot_no + 1, p.file_path, 'removed' FROM o p JOIN s ON s.snapshot_no = p.snapshot_no + 1
    WHERE NOT EXISTS (SELECT 1 FROM o n WHERE n.file_path = p.file_path AND n.snapshot_no = p.snapshot_no + 1)
  UNION ALL SELECT n.snapshot_no, n.file_path, 'changed' FROM o n JOIN o p
    ON p.file_path = n.file_path AND p.snapshot_no = n.snapshot_no - 1 WHERE n.h <> p.h)
"""

_TREE = """
WITH RECURSIVE l AS (SELECT target_id node, min(source_id) parent FROM edges
           WHERE type IN ('CONTAINS', 'DEFINES') AND source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1),
ids AS (SELECT node FROM l UNION SELECT parent FROM l),
t AS (SELECT node, node root, 0 depth, node path FROM ids WHERE node NOT IN (SELECT node FROM l)
      UNION ALL SELECT l.node, t.root, t.depth + 1, t.path || ' > ' || l.node FROM t JOIN l ON l.parent = t.node)
"""

ORACLE = {
    "p1_found": """SELECT target_id, type FROM edges WHERE target_id IS NOT NULL AND type IS NOT NULL
        GROUP BY 1, 2 HAVING count(*) >= 0.02 * (SELECT count(*) FROM edges)""",
    "p1_key_states": """SELECT target_id, type, count(*) n_rows, count(DISTINCT source_id) n_sources, min(source_id) first_source,
        coalesce(array_to_string(list_slice(list_sort(list_distinct(flatten(list(CAST(json_extract(CASE WHEN json_valid(metadata)
        THEN metadata END, '$.lines') AS BIGINT[]))))), 1, 5), ','), '') first_lines FROM edges GROUP BY 1, 2""",
    "p3_found": _CHANGES + "SELECT CAST(snapshot_no AS INT) snapshot_no, file_path, change FROM changes",
    "p3_change_counts": _CHANGES + "SELECT CAST(snapshot_no AS INT) snapshot_no, change, count(*) files FROM changes GROUP BY 1, 2",
    "p4_found": _TREE + """SELECT ids.node node_id, coalesce(t.root, '') root_id, CAST(coalesce(t.depth, -1) AS INT) depth
        FROM ids LEFT JOIN t ON t.node = ids.node""",
    "p4_paths": _TREE + """SELECT ids.node node_id, coalesce(t.root, '') root_id, CAST(coalesce(t.depth, -1) AS INT) depth, t.path
        FROM ids LEFT JOIN t ON t.node = ids.node""",
    "p4_descendants": _TREE + """, u AS (SELECT node top, node, 0 distance FROM t
      UNION ALL SELECT u.top, l.node, u.distance + 1 FROM u JOIN l ON l.parent = u.node)
      SELECT top ancestor_id, node node_id, CAST(distance AS INT) distance FROM u WHERE distance > 0""",
    "p4_descendant_counts": _TREE + """, u AS (SELECT node top, node, 0 distance FROM t
      UNION ALL SELECT u.top, l.node, u.distance + 1 FROM u JOIN l ON l.parent = u.node)
      SELECT top node_id, count(*) descendants, CAST(max(distance) AS INT) height FROM u WHERE distance > 0 GROUP BY 1""",
}
