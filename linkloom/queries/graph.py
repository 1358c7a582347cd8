"""Registered queries over the stored relations: nodes, edges, file_manifest, source_files, index_runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.operators import answers, graph
from linkloom.operators.trace import described as answers_of_trace
from linkloom.operators.trace import trace
from linkloom.plans.build import owned_documents
from linkloom.session import cut, table
from linkloom.sources.files import IGNORED, ignore_pattern

#: Bytes of one page of an outline, and of the tables of one answer.
OUTLINE_BYTES, DETAIL_BYTES = 4000, 1500
#: Characters of an id from which it is long, and visits of a capped trace.
LONG_ID, FEW_VISITS = 640, 40


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.distinct_nodes(table(spark, d, "nodes"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return graph.aggregate_links(graph.links(table(spark, d, "edges")))


def _manifest(spark: SparkSession, d: str, back: int = 0) -> DataFrame:
    """The latest snapshot, or one before it, a row per cleaned path: the latest arrival, and of these the greatest row."""
    m = table(spark, d, "file_manifest")
    latest = m.agg(F.max("snapshot_no")).first()[0]  # one number
    m = m.filter((F.col("snapshot_no") == F.lit(latest) - back) & F.col("file_path").isNotNull())
    digest = F.lower(F.regexp_replace("content_hash", r"^\s+|\s+$", ""))
    rows = m.select(T.clean_path(F.col("file_path")).alias("file_path"), F.struct("loaded_at", digest.alias("content_hash"), F.lower("language").alias("language"), "size", "lines", "indexed_by").alias("v"))
    one = rows.groupBy("file_path").agg(F.max("v").alias("v"))
    return one.select("file_path", *[F.col("v")[c].alias(c) for c in ("content_hash", "language", "size", "lines", "indexed_by")])


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "index_runs").drop("loaded_at").distinct()


def _hub(links: DataFrame, kind: str, end: str) -> str:
    """The id with most links of a kind, of equals the smallest."""
    row = links.filter(F.col("kind") == kind).groupBy(end).agg(F.count("*").alias("c")).orderBy(F.desc("c"), end).first()
    return row[0] if row else ""


def manifest_state(spark, d):
    m = _manifest(spark, d)
    return m.select("file_path", T.dir_of(F.col("file_path")).alias("dir"), T.file_name_of(F.col("file_path")).alias("file_name"), T.language_of(F.col("file_path")).alias("by_extension"), "language", "size", "lines", F.col("indexed_by").isNotNull().alias("covered"))


def coverage_by_language(spark, d):
    m = _manifest(spark, d).filter("language is not null")
    return m.groupBy("language").agg(F.count("*").alias("files"), F.count("indexed_by").alias("covered"), F.sum("size").cast("bigint").alias("bytes"))


def uncovered_files(spark, d):
    return _manifest(spark, d).filter("indexed_by is null").select("file_path", "language")


def overview_counts(spark, d):
    n = _nodes(spark, d).agg(F.count("*").alias("nodes"), F.count_if(F.char_length("id") > LONG_ID).alias("long_ids"))
    e = graph.links(table(spark, d, "edges")).agg(F.count("*").alias("edges"))
    m = _manifest(spark, d).agg(F.count("*").alias("files"), F.count("indexed_by").alias("covered"))
    r = _runs(spark, d).agg(F.count("*").alias("runs"))
    part = lambda df: df.select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c))])).alias("what", "count"))
    return part(n).unionByName(part(e)).unionByName(part(m)).unionByName(part(r))


def nodes_by_type(spark, d):
    return _nodes(spark, d).groupBy("type").agg(F.count("*").alias("count"))


def edges_by_type(spark, d):
    return graph.links(table(spark, d, "edges")).groupBy("kind").agg(F.count("*").alias("count"))


def edge_aggregate(spark, d):
    return _links(spark, d).select("source", "target", "kind", "n", F.array_join("lines", ",").alias("lines"))


def fan_in_out(spark, d):
    return graph.with_fan(_nodes(spark, d), _links(spark, d)).select("id", "fan_in", "fan_out", F.col("fan_in").alias("hub_score"))


def stale_fan_counts(spark, d):
    """Nodes whose stored counts, of an older run, differ from the counted ones."""
    n = graph.with_fan(_nodes(spark, d), _links(spark, d))
    stored = F.from_json("metadata", "fanIn bigint, fanOut bigint")
    return n.select("id", stored["fanIn"].alias("stored_in"), "fan_in", stored["fanOut"].alias("stored_out"), "fan_out").filter("stored_in != fan_in or stored_out != fan_out")


def file_dependencies(spark, d):
    return graph.file_dependencies(_links(spark, d), _nodes(spark, d))


def dir_dependencies(spark, d):
    return graph.dir_dependencies(_links(spark, d), _nodes(spark, d))


def _references(spark, d) -> DataFrame:
    """Every line of each CALLS or REFERENCES link, placed in the file of its source."""
    n = _nodes(spark, d).select(F.col("id").alias("source"), "file_path").filter("file_path is not null")
    refs = graph.link_lines(graph.links(table(spark, d, "edges")).filter("kind in ('CALLS', 'REFERENCES')")).select("source", "target", "line")
    return refs.join(n, "source")


def _spans(spark, d) -> DataFrame:
    n = _nodes(spark, d).filter("type not in ('FILE', 'MODULE', 'EXTERNAL') and file_path is not null")
    return n.select("file_path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), "id").filter("start is not null and end is not null and start >= 0")


def innermost_enclosing(spark, d):
    points = _references(spark, d).select("file_path", "line").distinct()
    return graph.innermost_enclosing(points, _spans(spark, d), "file_path", "line", [])


def enclosing_edges(spark, d):
    """Links rebuilt from positions: the innermost definition around each reference, else its file."""
    placed = graph.innermost_enclosing(_references(spark, d).select("file_path", "line", "target").distinct(), _spans(spark, d), "file_path", "line", ["target"])
    callable_ = _nodes(spark, d).select(F.col("id").alias("target"), F.col("type").isin(graph.CALLABLE).alias("callable"))
    kind = F.when(F.col("enclosing").isNotNull() & F.col("callable"), "CALLS").otherwise("REFERENCES")
    refs = placed.join(callable_, "target").select(F.coalesce("enclosing", F.concat(F.lit("file:"), "file_path")).alias("source"), "target", kind.alias("kind"), F.lit(1).cast("bigint").alias("n"), F.array("line").alias("lines"))
    return graph.aggregate_links(refs).select("source", "target", "kind", "n", F.array_join("lines", ",").alias("lines"))


def _package(c):
    return F.when(~c.rlike("^(file|module|external):"), F.regexp_extract(c, r"^([^:]*:[^:]*):", 1))


def resolve_references(spark, d):
    n = _nodes(spark, d)
    own = n.filter("type not in ('FILE', 'MODULE', 'EXTERNAL')").select(_package(F.col("id")).alias("package")).filter("package != ''")
    # one row for each target, however many links it has
    targets = _links(spark, d).groupBy("target").agg(F.count("*").alias("refs")).select("target", "refs", F.nullif(_package(F.col("target")), F.lit("")).alias("package"))
    return graph.resolve(targets, n, own).groupBy("outcome").agg(F.sum("refs").alias("refs"), F.count("*").alias("targets"))


def dangling_edges(spark, d):
    return graph.dangling(_links(spark, d), _nodes(spark, d)).select("source", "target", "kind", "missing")


def implements_edges(spark, d):
    ids = _nodes(spark, d).select(F.col("id").alias("target"))
    return _links(spark, d).filter("kind = 'IMPLEMENTS'").join(ids, "target", "left_semi").select("source", "target")


def owner_edges(spark, d):
    """Owner of each definition by its id: the node one descriptor up, else the file."""
    n = _nodes(spark, d).filter("type not in ('FILE', 'MODULE', 'EXTERNAL')")
    owner = F.regexp_extract(F.regexp_replace("id", r"~\d+$", ""), r"^(.*[#/.!:)])(?:`[^`]*`|[\w$+-]+)(?:\(\+?\d*\)\.|[#/.:!])$", 1)
    defs = n.select("id", owner.alias("owner"), "file_path")
    above = n.select(F.col("id").alias("owner"), F.lit(True).alias("known"))
    joined = defs.join(above, "owner", "left")
    known = F.coalesce("known", F.lit(False)) & (F.col("owner") != F.col("id"))
    return joined.select(F.when(known, F.col("owner")).otherwise(F.concat(F.lit("file:"), "file_path")).alias("source"), F.col("id").alias("target"), F.when(known, "CONTAINS").otherwise("DEFINES").alias("kind")).filter("source is not null")


def duplicate_numbering(spark, d):
    n = _nodes(spark, d).filter("type not in ('FILE', 'MODULE', 'EXTERNAL')").withColumn("base", F.regexp_replace("id", r"~\d+$", ""))
    return graph.numbered_definitions(n, "base", [F.asc_nulls_first("file_path"), F.asc_nulls_first("start_line"), F.col("id")]).select("id", "n", "node_id")


def first_document_wins(spark, d):
    s = table(spark, d, "source_files").filter("file_path is not null").select("file_path", "language", F.sha2("text", 256).alias("digest"))
    return graph.first_of(s, "file_path", [F.col("digest").isNull(), F.col("digest"), F.col("language")]).select("file_path", "language", "digest", "rows")


def _symbols(spark, d) -> DataFrame:
    return graph.with_fan(_nodes(spark, d), _links(spark, d))


def find_symbols_ranked(spark, d):
    return answers.find_symbols(_symbols(spark, d), "Merge")


def find_symbols_page(spark, d):
    return answers.find_symbols(_symbols(spark, d), "route", kind="METHOD", prefix="packages/", offset=10, window=20)


def file_outlines(spark, d):
    """The outline of every file, each in its order."""
    return answers.outlines(_nodes(spark, d)).withColumn("signature", T.clip(T.squash(F.col("signature")), 300))


def relations_in(spark, d):
    return answers.relations(_links(spark, d), _nodes(spark, d), "dependents")


def relations_out(spark, d):
    return answers.relations(_links(spark, d), _nodes(spark, d), "dependencies")


def members(spark, d):
    return answers.members(_links(spark, d), _nodes(spark, d))


def symbol_details(spark, d):
    n = _symbols(spark, d).filter("type not in ('FILE', 'MODULE', 'EXTERNAL')")
    container = _links(spark, d).filter("kind in ('CONTAINS', 'DEFINES')").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("container"))
    return n.join(container, "id", "left").select("id", F.col("type").alias("kind"), "name", "qualified", "file_path", "start_line", "end_line", "language", "signature", "doc", "container", F.col("duplicateOf").isNotNull().alias("duplicate"), F.col("duplicateOf").alias("duplicate_of"), "fan_in", "fan_out")


def _traced(spark, d, kind: str, end: str, towards: str, **how) -> DataFrame:
    """A trace from the node with most links of a kind, its rows described."""
    links = cut(_links(spark, d))
    return answers_of_trace(trace(links, _hub(links, kind, end), towards, **how), _nodes(spark, d))


def trace_dependents(spark, d):
    return _traced(spark, d, "IMPLEMENTS", "target", "dependents", depth=3)


def trace_calls(spark, d):
    return _traced(spark, d, "CALLS", "source", "dependencies", depth=4, kinds=["CALLS"])


def trace_capped(spark, d):
    """A trace whose visit cap hides nodes, which every row tells."""
    return _traced(spark, d, "CALLS", "target", "dependents", depth=4, visits=FEW_VISITS)


def trace_levels(spark, d):
    return trace_dependents(spark, d).groupBy("depth").agg(F.count("*").alias("nodes"), F.first("complete").alias("complete"))


def manifest_drift(spark, d):
    return answers.drift(_manifest(spark, d, back=1), _manifest(spark, d), "file_path", "content_hash")


def topmost_roots(spark, d):
    """The top-most folders that hold a package marker of Python."""
    marked = _manifest(spark, d).filter(T.file_name_of(F.col("file_path")) == "__init__.py")
    return graph.topmost(marked.select(T.dir_of(F.col("file_path")).alias("dir")))


def source_lines(spark, d):
    s = table(spark, d, "source_files").filter("text is not null and file_path is not null").select("file_path", "text").distinct()
    return answers.numbered_lines(s, "file_path", "text")


def outline_pages(spark, d):
    """All pages of each file's outline: as many rows on each as fit in its bytes."""
    rows = file_outlines(spark, d)
    paged = answers.pages(rows.select("file_path", F.col("at").alias("nth"), "id", "name"), "file_path", [F.col("nth")], _row_bytes(), OUTLINE_BYTES)
    return paged.select("file_path", "nth", "id", "page")


def _row_bytes():
    return F.octet_length("id") + F.octet_length("name") + 10


def detail_pages(spark, d):
    """How many members, dependents and dependencies of each node one answer has room for."""
    one = lambda df, name, group: df.select(F.col(group).alias("id"), F.lit(name).alias("table"), "at", "of", "size")
    held = members(spark, d).withColumn("size", _row_bytes())
    own, size = "own", F.octet_length("other_id") + F.octet_length("name") + 10
    into, out = (f(spark, d).withColumnRenamed("id", own).withColumn("size", size) for f in (relations_in, relations_out))
    rows = one(held, "members", "container").unionByName(one(into, "dependents", own)).unionByName(one(out, "dependencies", own))
    return answers.fitted_tables(rows.filter("id is not null"), "id", ["members", "dependents", "dependencies"], DETAIL_BYTES)


def unknown_node_hints(spark, d):
    """For each target that is no node the nodes that may be meant."""
    n = _nodes(spark, d)
    lost = graph.dangling(_links(spark, d), n).filter("missing = 'target'").select(F.col("target").alias("id")).distinct()
    return answers.node_hints(lost, n)


def unknown_path_hints(spark, d):
    return answers.path_hints(_manifest(spark, d), "somewhere/else/merge.ts")


def answer_freshness(spark, d):
    """Files named by a search that differ from what the snapshot before held."""
    named = answers.find_symbols(_symbols(spark, d), "merge")
    return answers.freshness(named, _manifest(spark, d, back=1), _manifest(spark, d))


def document_ownership(spark, d):
    """What becomes of each document of an index: its file was listed, skipped on purpose, is ignored, or
    of a language that no scan knows."""
    documents = _nodes(spark, d).filter("file_path is not null").select(T.clean_path(F.col("file_path")).alias("path")).distinct()
    return owned_documents(documents, _manifest(spark, d).select(F.col("file_path").alias("path")), IGNORED).select("path", "state")


def clipped_cells(spark, d):
    """Nodes with documentation as rows of an answer, each cell clipped by the bytes of its JSON form."""
    n = _nodes(spark, d).filter("doc is not null").select("id", F.col("type").alias("kind"), F.col("file_path").alias("file"), T.json_bytes(F.col("doc")).alias("bytes"), "doc")
    return T.clip_cells(n)


def failure_summaries(spark, d):
    """What went wrong in each run that left a log."""
    return _runs(spark, d).filter("output is not null").select("id", T.failure_summary(F.col("output")).alias("summary")).distinct()


def run_report(spark, d):
    r = _runs(spark, d)
    name = F.regexp_extract("tool", r"^(\S+)", 1)
    return r.groupBy("status", T.run_label(name, F.regexp_extract("tool", r"\s(\S+)$", 1)).alias("label")).agg(F.count("*").alias("runs"), F.sum("documents").alias("documents"), F.sum("occurrences").alias("occurrences"), F.max("duration_ms").alias("slowest_ms"))


def run_outputs(spark, d):
    """Outputs of an indexer named apart: the second root of a name gets -2, and so on."""
    w = graph.Window.partitionBy("indexer").orderBy("root")
    roots = _runs(spark, d).filter("root is not null and indexer is not null").select("indexer", "root").distinct().withColumn("n", F.row_number().over(w))
    return roots.select("indexer", "root", F.when(F.col("n") == 1, F.col("indexer")).otherwise(F.concat_ws("-", "indexer", F.col("n").cast("string"))).alias("output"))


def union_nodes(spark, d):
    """All nodes a build writes: stored symbols, files of the manifest without one, their folders."""
    n, m = _nodes(spark, d), _manifest(spark, d)
    symbols = n.select("id", "type")
    files = m.select(F.concat(F.lit("file:"), "file_path").alias("id"), F.lit("FILE").alias("type")).join(symbols, "id", "left_anti")
    dirs = m.select(F.concat(F.lit("module:"), T.dir_of(F.col("file_path"))).alias("id"), F.lit("MODULE").alias("type")).distinct().join(symbols, "id", "left_anti")
    return symbols.unionByName(files).unionByName(dirs)


def files_per_dir(spark, d):
    return _manifest(spark, d).groupBy(T.dir_of(F.col("file_path")).alias("dir")).agg(F.count("*").alias("files"))


def doc_texts(spark, d):
    """Clipped documentation and the signature on one line, of every symbol that has them."""
    n = _nodes(spark, d).filter("doc is not null or signature is not null")
    return n.select("id", T.clip(F.col("doc"), 500).alias("doc"), T.clip(T.squash(F.col("signature")), 300).alias("signature"))


NAMES = [
    manifest_state, coverage_by_language, uncovered_files, overview_counts, nodes_by_type, edges_by_type, edge_aggregate, fan_in_out, stale_fan_counts, file_dependencies, dir_dependencies,
    innermost_enclosing, enclosing_edges, resolve_references, dangling_edges, implements_edges, owner_edges, duplicate_numbering, first_document_wins, find_symbols_ranked, find_symbols_page,
    file_outlines, relations_in, relations_out, members, symbol_details, trace_dependents, trace_calls, trace_levels, manifest_drift, topmost_roots, source_lines, outline_pages, run_report,
    run_outputs, union_nodes, files_per_dir, doc_texts, trace_capped, detail_pages, unknown_node_hints, unknown_path_hints, answer_freshness, document_ownership, clipped_cells, failure_summaries,
]
QUERIES = {f.__name__: f for f in NAMES}

_N = """n AS (SELECT DISTINCT id, type, name, file_path, start_line, end_line, language, metadata,
  CASE WHEN json_valid(metadata) THEN metadata END j FROM nodes WHERE id IS NOT NULL)"""
_L = """once AS (SELECT DISTINCT id, source_id, target_id, type, metadata FROM edges),
raw AS (SELECT id, source_id source, target_id target, type kind, CASE WHEN json_valid(metadata) THEN metadata END j FROM once
  WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND type IS NOT NULL),
l AS (SELECT source, target, kind, CAST(sum(coalesce(CAST(j->>'$.count' AS BIGINT), 1)) AS BIGINT) n,
  coalesce(list_slice(list_sort(list_distinct(flatten(list(CAST(json_extract(j, '$.lines') AS BIGINT[]))))), 1, 5), []) lines
  FROM raw GROUP BY ALL)"""


def _m(name: str = "m", back: int = 0) -> str:
    return rf"""{name} AS (SELECT file_path, content_hash, language, size, lines, indexed_by FROM (SELECT *, row_number() OVER (PARTITION BY file_path
  ORDER BY loaded_at DESC NULLS LAST, content_hash DESC NULLS LAST, language DESC NULLS LAST, size DESC NULLS LAST, lines DESC NULLS LAST, indexed_by DESC NULLS LAST) rn
  FROM (SELECT regexp_replace(regexp_replace(replace(file_path, '\', '/'), '/+', '/', 'g'), '^(\./)+', '') file_path, lower(trim(content_hash, E' \t\n\r\f\v')) content_hash,
  lower(language) "language", size, lines, indexed_by, loaded_at FROM file_manifest WHERE file_path IS NOT NULL AND snapshot_no = (SELECT max(snapshot_no) FROM file_manifest) - {back})) WHERE rn = 1)"""


_DIR = "CASE WHEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) = '' THEN '.' ELSE regexp_extract(file_path, '^(.*)/[^/]*$', 1) END"
_PRIO = "CASE {} WHEN 'CALLS' THEN 0 WHEN 'IMPLEMENTS' THEN 1 WHEN 'REFERENCES' THEN 2 WHEN 'USES' THEN 3 ELSE 4 END"
_FAN = """pairs AS (SELECT DISTINCT source, target FROM l WHERE source <> target AND kind IN ('CALLS','REFERENCES','IMPLEMENTS','USES','DEPENDS_ON')),
fi AS (SELECT target id, count(*) c FROM pairs GROUP BY 1), fo AS (SELECT source id, count(*) c FROM pairs GROUP BY 1),
s AS (SELECT n.*, coalesce(fi.c, 0) fan_in, coalesce(fo.c, 0) fan_out FROM n LEFT JOIN fi USING (id) LEFT JOIN fo USING (id))"""
_DEPS = """SELECT a.p from_place, b.p to_place, CAST(sum(l.n) AS BIGINT) n FROM l JOIN pl a ON a.id = l.source JOIN pl b ON b.id = l.target
  WHERE l.kind IN ('CALLS', 'REFERENCES') AND a.p <> b.p GROUP BY 1, 2"""
_REFS = """r AS (SELECT n.file_path, l.target, l.line FROM (SELECT DISTINCT * FROM (SELECT source, target, unnest(CAST(json_extract(j, '$.lines') AS BIGINT[])) line
  FROM raw WHERE kind IN ('CALLS', 'REFERENCES')) WHERE line IS NOT NULL) l JOIN n ON n.id = l.source WHERE n.file_path IS NOT NULL),
sp AS (SELECT * FROM n WHERE type NOT IN ('FILE','MODULE','EXTERNAL') AND file_path IS NOT NULL AND start_line >= 0 AND start_line <= end_line),
p AS (SELECT DISTINCT file_path, line FROM r),
enc AS (SELECT p.file_path, p.line, arg_max(sp.id, (sp.start_line, -sp.end_line, sp.id)) enclosing FROM p LEFT JOIN sp
  ON sp.file_path = p.file_path AND sp.start_line <= p.line AND p.line <= sp.end_line GROUP BY 1, 2)"""
_SYM = "'CLASS','INTERFACE','STRUCT','ENUM','TRAIT','TYPE','TYPE_ALIAS','FUNCTION','METHOD','MACRO','FIELD','VARIABLE','CONSTANT','ENUM_MEMBER','NAMESPACE'"
_UP = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_OUTLINE = """SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY start_line NULLS FIRST, end_line DESC NULLS LAST, id) "at",
  type kind, name, start_line, end_line, id, {} FROM n WHERE type <> 'FILE' AND file_path IS NOT NULL"""


def _squash(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'), ' ')"


def _clip(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN left({c}, {n}) || '…' ELSE {c} END"


def _json(c: str) -> str:
    """Bytes of a text as a JSON string."""
    return rf"(strlen({c}) + length({c}) - length(regexp_replace({c}, '[\"\\\n\r\t\x08\f]', '', 'g')) + 5 * (length({c}) - length(regexp_replace({c}, '[\x00-\x07\x0b\x0e-\x1f]', '', 'g'))) + 2)"


def _clip_json(c: str, limit: int) -> str:
    longest = f"list_max(list_filter(range(0, {limit} + 1), lambda i: {_json(f'left({c}, i)')} + 3 <= {limit}))"
    return f"CASE WHEN {_json(c)} <= {limit} THEN {c} WHEN {c} IS NOT NULL THEN left({c}, {longest}) || '…' END"


def _find(q: str, more: str, page: str) -> str:
    name = f"translate(name, {_UP})"
    return f"""WITH {_N}, {_L}, {_FAN} SELECT id, type kind, name, file_path, start_line, end_line, fan_in FROM s
      WHERE type IN ({_SYM}) AND (contains({name}, '{q}') OR coalesce(contains(translate(j->>'$.qualified', {_UP}), '{q}'), false)) {more}
      ORDER BY ({name} = '{q}') DESC, starts_with({name}, '{q}') DESC, fan_in DESC, name, id {page}"""


def _relations(own: str, other: str) -> str:
    return f"""SELECT l.{own} id, row_number() OVER (PARTITION BY l.{own} ORDER BY {_PRIO.format("l.kind")}, l.n DESC, n.name, l.{other}) "at", count(*) OVER (PARTITION BY l.{own}) "of",
      l.kind, l.{other} other_id, n.name, n.type other_type, n.file_path, n.start_line, l.n "count", array_to_string(l.lines, ',') sites
      FROM l JOIN n ON n.id = l.{other} WHERE l.kind IN ('CALLS','IMPLEMENTS','REFERENCES','USES','DEPENDS_ON')"""


_MEMBERS = """SELECT container, row_number() OVER (PARTITION BY container ORDER BY start_line NULLS FIRST, end_line DESC NULLS LAST, id) "at", count(*) OVER (PARTITION BY container) "of",
  id, type kind, name, start_line, end_line FROM (SELECT DISTINCT source container, target id FROM l WHERE kind IN ('CONTAINS','DEFINES')) b JOIN n USING (id)"""


def _fitted(tables: list[str], budget: int) -> str:
    """From x (id, "table", "at", "of", size) to the rows of each table that fit."""
    many, used = "len(list_filter({}, lambda x: x <= {}))", "coalesce({}[nullif({}, 0)], 0)"
    lists = ", ".join(f"""list_sort(coalesce(list(e) FILTER ("table" = '{t}' AND e <= {budget}), [])) e{i}, coalesce(max("of") FILTER ("table" = '{t}'), 0) of{i}""" for i, t in enumerate(tables))
    sql, pool = f"""e AS (SELECT *, sum(size) OVER (PARTITION BY id, "table" ORDER BY "at") e FROM x), s0 AS (SELECT id, {lists}, {budget} pool FROM e GROUP BY id)""", len(tables)
    for i in range(pool):
        sql += f", a{i} AS (SELECT *, {many.format(f'e{i}', f'pool // {pool - i}')} n{i} FROM s{i}), s{i + 1} AS (SELECT * EXCLUDE (pool), pool - {used.format(f'e{i}', f'n{i}')} pool FROM a{i})"
    for i in range(pool):
        own = used.format(f"e{i}", f"n{i}")
        sql += f", b{i} AS (SELECT *, {many.format(f'e{i}', f'pool + {own}')} m{i} FROM s{pool + i}), s{pool + i + 1} AS (SELECT * EXCLUDE (pool), pool - {used.format(f'e{i}', f'm{i}')} + {own} pool FROM b{i})"
    return sql + " " + " UNION ALL ".join(f"""SELECT id, '{t}' "table", CAST(m{i} AS INT) shown, of{i} total FROM s{2 * pool}""" for i, t in enumerate(tables))


def _trace(near: str, far: str, kind: str, end: str, depth: int, kinds: str, cap: int = 5000) -> str:
    sql = f"""WITH {_N}, {_L}, root AS (SELECT {end} id FROM l WHERE kind = '{kind}' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    st AS (SELECT {near} near, {far} id, kind, n "count", {_PRIO.format("kind")} prio, lines FROM l WHERE kind IN ({kinds})),
    h0 AS (SELECT 0 n, -1 from_n, 0 depth, NULL kind, id, NULL "count", NULL lines FROM root)"""
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM h{i}" for i in range(k))
        base = " + ".join(f"(SELECT count(*) FROM h{i})" for i in range(k)) + " - 1"
        sql += f""", h{k} AS (SELECT row_number() OVER (ORDER BY from_n, prio, "count" DESC, id) + {base} n, from_n, {k} depth, kind, id, "count", lines FROM
          (SELECT *, row_number() OVER (PARTITION BY id ORDER BY from_n, prio, "count" DESC, kind) rn FROM (SELECT h.n from_n, st.* FROM h{k - 1} h JOIN st ON st.near = h.id WHERE h.n <= {cap} AND st.id NOT IN ({seen}))) WHERE rn = 1)"""
    every = " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(1, depth + 1))
    return sql + f""", every_h AS ({every}), h AS (SELECT e.*, n.type, n.name, n.file_path, n.start_line, (SELECT count(*) FROM every_h) <= {cap} complete
      FROM every_h e LEFT JOIN n USING (id) WHERE e.n <= {cap}) """


_T = """SELECT CAST(n AS INT) n, CAST(from_n AS INT) from_n, CAST(depth AS INT) depth, kind, id, type, name, file_path, start_line, "count", array_to_string(list_slice(lines, 1, 5), ',') sites, complete FROM h"""
_ALL = "'CALLS','REFERENCES','IMPLEMENTS','USES'"
_OWNER = r"regexp_extract(regexp_replace(id, '~\d+$', ''), '^(.*[#/.!:)])(?:`[^`]*`|[\w$+-]+)(?:\(\+?\d*\)\.|[#/.:!])$', 1)"
_PKG = "CASE WHEN NOT regexp_matches({0}, '^(file|module|external):') THEN nullif(regexp_extract({0}, '^([^:]*:[^:]*):', 1), '') END"

ORACLE = {
    "manifest_state": f"""WITH {_m()} SELECT file_path, {_DIR} dir, split_part(file_path, '/', -1) file_name,
      CASE lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'pyi' THEN 'python'
      WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'mts' THEN 'typescript' WHEN 'cts' THEN 'typescript'
      WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' END by_extension,
      "language", size, lines, indexed_by IS NOT NULL covered FROM m""",
    "coverage_by_language": f"WITH {_m()} SELECT \"language\", count(*) files, count(indexed_by) covered, CAST(sum(size) AS BIGINT) bytes FROM m WHERE \"language\" IS NOT NULL GROUP BY 1",
    "uncovered_files": f"WITH {_m()} SELECT file_path, \"language\" FROM m WHERE indexed_by IS NULL",
    "overview_counts": f"""WITH {_N}, {_L}, {_m()} SELECT 'nodes' what, count(*) "count" FROM n UNION ALL SELECT 'long_ids', count(*) FROM n WHERE length(id) > {LONG_ID}
      UNION ALL SELECT 'edges', count(*) FROM raw UNION ALL SELECT 'files', count(*) FROM m UNION ALL SELECT 'covered', count(indexed_by) FROM m
      UNION ALL SELECT 'runs', count(*) FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM index_runs)""",
    "nodes_by_type": f'WITH {_N} SELECT type, count(*) "count" FROM n GROUP BY 1',
    "edges_by_type": f'WITH {_L} SELECT kind, count(*) "count" FROM raw GROUP BY 1',
    "edge_aggregate": f"WITH {_L} SELECT source, target, kind, n, array_to_string(lines, ',') lines FROM l",
    "fan_in_out": f"WITH {_N}, {_L}, {_FAN} SELECT id, fan_in, fan_out, fan_in hub_score FROM s",
    "stale_fan_counts": f"""WITH {_N}, {_L}, {_FAN} SELECT * FROM (SELECT id, CAST(j->>'$.fanIn' AS BIGINT) stored_in, fan_in, CAST(j->>'$.fanOut' AS BIGINT) stored_out, fan_out FROM s)
      WHERE stored_in <> fan_in OR stored_out <> fan_out""",
    "file_dependencies": f"WITH {_N}, {_L}, pl AS (SELECT id, file_path p FROM n WHERE file_path IS NOT NULL) {_DEPS}",
    "dir_dependencies": f"WITH {_N}, {_L}, pl AS (SELECT id, {_DIR} p FROM n WHERE file_path IS NOT NULL) {_DEPS}",
    "innermost_enclosing": f"WITH {_N}, {_L}, {_REFS} SELECT file_path, line, enclosing FROM enc",
    "enclosing_edges": f"""WITH {_N}, {_L}, {_REFS}, x AS (SELECT DISTINCT coalesce(enc.enclosing, 'file:' || r.file_path) source, r.target,
      CASE WHEN enc.enclosing IS NOT NULL AND n.type IN ('FUNCTION','METHOD','MACRO') THEN 'CALLS' ELSE 'REFERENCES' END kind, r.line, r.file_path
      FROM r JOIN enc USING (file_path, line) JOIN n ON n.id = r.target)
      SELECT source, target, kind, count(*) n, array_to_string(list_slice(list_sort(list_distinct(list(line))), 1, 5), ',') lines FROM x GROUP BY 1, 2, 3""",
    "resolve_references": f"""WITH {_N}, {_L}, own AS (SELECT DISTINCT {_PKG.format("id")} package FROM n WHERE type NOT IN ('FILE','MODULE','EXTERNAL')),
      x AS (SELECT target, CASE WHEN target IN (SELECT id FROM n) THEN 'resolved' WHEN {_PKG.format("target")} IS NULL THEN 'dropped'
      WHEN {_PKG.format("target")} IN (SELECT package FROM own WHERE package IS NOT NULL) THEN 'unresolved' ELSE 'external' END outcome FROM l)
      SELECT outcome, count(*) refs, count(DISTINCT target) targets FROM x GROUP BY 1""",
    "dangling_edges": f"""WITH {_N}, {_L} SELECT source, target, kind, 'source' missing FROM l WHERE source NOT IN (SELECT id FROM n)
      UNION ALL SELECT source, target, kind, 'target' FROM l WHERE target NOT IN (SELECT id FROM n)""",
    "implements_edges": f"WITH {_N}, {_L} SELECT source, target FROM l WHERE kind = 'IMPLEMENTS' AND target IN (SELECT id FROM n)",
    "owner_edges": f"""WITH {_N}, x AS (SELECT * FROM n WHERE type NOT IN ('FILE','MODULE','EXTERNAL')), o AS (SELECT id, file_path, {_OWNER} owner FROM x)
      SELECT * FROM (SELECT CASE WHEN x.id IS NOT NULL AND o.owner <> o.id THEN o.owner ELSE 'file:' || o.file_path END source, o.id target,
      CASE WHEN x.id IS NOT NULL AND o.owner <> o.id THEN 'CONTAINS' ELSE 'DEFINES' END kind FROM o LEFT JOIN x ON x.id = o.owner) WHERE source IS NOT NULL""",
    "duplicate_numbering": f"""WITH {_N}, x AS (SELECT id, regexp_replace(id, '~\\d+$', '') base, file_path, start_line FROM n WHERE type NOT IN ('FILE','MODULE','EXTERNAL')),
      y AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY file_path NULLS FIRST, start_line NULLS FIRST, id) n FROM x)
      SELECT id, CAST(n AS INT) n, CASE WHEN n = 1 THEN base ELSE base || '~' || n END node_id FROM y""",
    "first_document_wins": """WITH x AS (SELECT file_path, "language", sha256(text) digest FROM source_files WHERE file_path IS NOT NULL),
      y AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY digest IS NULL, digest NULLS FIRST, "language" NULLS FIRST) rn, count(*) OVER (PARTITION BY file_path) "rows" FROM x)
      SELECT file_path, "language", digest, "rows" FROM y WHERE rn = 1""",
    "find_symbols_ranked": _find("merge", "", "LIMIT 300"),
    "find_symbols_page": _find("route", "AND type = 'METHOD' AND starts_with(file_path, 'packages/')", "LIMIT 20 OFFSET 10"),
    "file_outlines": f"WITH {_N} " + _OUTLINE.format(_clip(_squash("j->>'$.signature'"), 300) + " signature"),
    "relations_in": f"""WITH {_N}, {_L} SELECT *, CAST(("at" + 299) // 300 AS INT) page FROM ({_relations("target", "source")})""",
    "relations_out": f"""WITH {_N}, {_L} SELECT *, CAST(("at" + 299) // 300 AS INT) page FROM ({_relations("source", "target")})""",
    "members": f"WITH {_N}, {_L} {_MEMBERS}",
    "symbol_details": f"""WITH {_N}, {_L}, {_FAN}, c AS (SELECT target id, min(source) container FROM l WHERE kind IN ('CONTAINS','DEFINES') GROUP BY 1)
      SELECT id, type kind, name, j->>'$.qualified' qualified, file_path, start_line, end_line, "language", j->>'$.signature' signature, j->>'$.doc' doc, container,
      j->>'$.duplicateOf' IS NOT NULL duplicate, j->>'$.duplicateOf' duplicate_of, fan_in, fan_out
      FROM s LEFT JOIN c USING (id) WHERE type NOT IN ('FILE','MODULE','EXTERNAL')""",
    "trace_dependents": _trace("target", "source", "IMPLEMENTS", "target", 3, _ALL) + _T,
    "trace_calls": _trace("source", "target", "CALLS", "source", 4, "'CALLS'") + _T,
    "trace_levels": _trace("target", "source", "IMPLEMENTS", "target", 3, _ALL) + "SELECT CAST(depth AS INT) depth, count(*) nodes, bool_and(complete) complete FROM h GROUP BY 1",
    "trace_capped": _trace("target", "source", "CALLS", "target", 4, _ALL, FEW_VISITS) + _T,
    "manifest_drift": f"""WITH {_m("a", 1)}, {_m("b")} SELECT * FROM (SELECT coalesce(a.file_path, b.file_path) file_path, CASE WHEN b.file_path IS NULL THEN 'missing'
      WHEN a.file_path IS NULL THEN 'new' WHEN a.content_hash IS DISTINCT FROM b.content_hash THEN 'changed' END state FROM a FULL JOIN b ON a.file_path = b.file_path) WHERE state IS NOT NULL""",
    "topmost_roots": f"""WITH {_m()}, y AS (SELECT DISTINCT {_DIR} dir FROM m WHERE file_path = '__init__.py' OR ends_with(file_path, '/__init__.py'))
      SELECT dir FROM y WHERE NOT EXISTS (SELECT 1 FROM y z WHERE starts_with(y.dir, z.dir || '/'))""",
    "source_lines": r"""WITH s AS (SELECT DISTINCT file_path, text FROM source_files WHERE text IS NOT NULL AND file_path IS NOT NULL),
      x AS (SELECT file_path, string_split(text, chr(10)) a, CAST(ends_with(text, chr(10)) AS INT) e FROM s),
      y AS (SELECT file_path, len(a) - e "of", unnest(a) t, generate_subscripts(a, 1) line FROM x)
      SELECT file_path, CAST(line AS INT) line, regexp_replace(regexp_replace(t, '\r$', ''), '[\x00-\x08\x0A-\x1F\x7F-\x{9F}]', '�', 'g') text FROM y WHERE line <= "of" """,
    "outline_pages": f"""WITH {_N}, o AS ({_OUTLINE.format("1 one")}), u AS (SELECT file_path, "at" nth, id, strlen(id) + strlen(name) + 10 z FROM o),
      g AS (SELECT file_path, list({{'page': 1, 'used': z, 'z': z}} ORDER BY nth) a FROM u GROUP BY 1)
      SELECT file_path, nth, id, list_reduce(list_slice(a, 1, nth), lambda p, x: CASE WHEN p.used + x.z > {OUTLINE_BYTES} THEN {{'page': p.page + 1, 'used': x.z, 'z': x.z}}
      ELSE {{'page': p.page, 'used': p.used + x.z, 'z': x.z}} END).page page FROM u JOIN g USING (file_path)""",
    "detail_pages": f"""WITH {_N}, {_L}, x AS (SELECT container id, 'members' "table", "at", "of", strlen(id) + strlen(name) + 10 size FROM ({_MEMBERS})
      UNION ALL SELECT id, 'dependents', "at", "of", strlen(other_id) + strlen(name) + 10 FROM ({_relations("target", "source")})
      UNION ALL SELECT id, 'dependencies', "at", "of", strlen(other_id) + strlen(name) + 10 FROM ({_relations("source", "target")})), {_fitted(["members", "dependents", "dependencies"], DETAIL_BYTES)}""",
    "unknown_node_hints": f"""WITH {_N}, {_L}, lost AS (SELECT DISTINCT target id, regexp_extract(target, '([\\p{{L}}\\p{{N}}_]+)[^\\p{{L}}\\p{{N}}_]*$', 1) name FROM l WHERE target NOT IN (SELECT id FROM n)),
      k AS (SELECT name, id hint, row_number() OVER (PARTITION BY name ORDER BY id) rn FROM n) SELECT lost.id, hint FROM lost JOIN k USING (name) WHERE rn <= 5 AND lost.name <> ''""",
    "unknown_path_hints": f"WITH {_m()} SELECT file_path FROM m WHERE contains(file_path, 'merge.ts') ORDER BY 1 LIMIT 5",
    "answer_freshness": f"""WITH {_m("a", 1)}, {_m("b")}, f AS ({_find("merge", "", "LIMIT 300")}) SELECT * FROM (SELECT a.file_path, CASE WHEN b.file_path IS NULL THEN 'missing'
      WHEN a.content_hash IS DISTINCT FROM b.content_hash THEN 'changed' END state FROM a LEFT JOIN b ON a.file_path = b.file_path WHERE a.file_path IN (SELECT file_path FROM f)) WHERE state IS NOT NULL""",
    "document_ownership": f"""WITH {_N}, {_m()}, p AS (SELECT DISTINCT regexp_replace(regexp_replace(replace(file_path, '\\', '/'), '/+', '/', 'g'), '^(\\./)+', '') path FROM n WHERE file_path IS NOT NULL)
      SELECT path, CASE WHEN path IN (SELECT file_path FROM m) THEN 'listed' WHEN regexp_matches(lower(path), '\\.(rs|tsx?|[mc]ts|jsx?|[mc]js|pyi?)$') THEN 'skipped'
      WHEN {" OR ".join(f"regexp_matches(path, '{ignore_pattern(r)[0]}')" for r in IGNORED)} OR regexp_matches(path, '(?:^|/)\\.[^/]') THEN 'ignored' ELSE 'other' END state FROM p""",
    "clipped_cells": f"""WITH {_N}, x AS (SELECT id, type kind, file_path file, j->>'$.doc' doc FROM n WHERE j->>'$.doc' IS NOT NULL)
      SELECT {", ".join(f"{_clip_json(c, T.CELL_LIMITS.get(c, T.CELL_LIMITS['']))} {c}" for c in ("id", "kind", "file", "doc"))}, {_json("doc")} bytes FROM x""",
    "failure_summaries": rf"""WITH x AS (SELECT DISTINCT id, output FROM index_runs WHERE output IS NOT NULL), y AS (SELECT id, list_filter(list_transform(regexp_split_to_array(output, '\r?\n'),
      lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: t <> '' AND NOT (starts_with(t, 'at ') OR starts_with(t, 'Stack backtrace') OR regexp_matches(t, '^[0-9]+: +[^0-9 ]|^[0-9]+: +$'))) a FROM x),
      z AS (SELECT id, a, list_filter(a, lambda t: regexp_matches(lower(t), '{"|".join(w.replace("'", "''") for w in T.ERROR_WORDS)}')) e FROM y),
      w AS (SELECT id, array_to_string(CASE WHEN len(e) > 0 THEN list_slice(e, greatest(len(e) - 1, 1), len(e)) ELSE list_slice(a, greatest(len(a) - 2, 1), len(a)) END, ' | ') t FROM z)
      SELECT DISTINCT id, {_clip("t", 400)} summary FROM w""",
    "run_report": r"""WITH r AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM index_runs)
      SELECT status, CASE WHEN coalesce(regexp_extract(tool, '^(\S+)', 1), '') = '' THEN 'scip' ELSE regexp_extract(tool, '^(\S+)', 1) END ||
      CASE WHEN coalesce(regexp_extract(tool, '\s(\S+)$', 1), '') = '' THEN '' ELSE ' ' || regexp_extract(tool, '\s(\S+)$', 1) END label, count(*) runs,
      CAST(sum(documents) AS BIGINT) documents, CAST(sum(occurrences) AS BIGINT) occurrences, max(duration_ms) slowest_ms FROM r GROUP BY 1, 2""",
    "run_outputs": """WITH r AS (SELECT DISTINCT indexer, root FROM index_runs WHERE root IS NOT NULL AND indexer IS NOT NULL)
      SELECT indexer, root, CASE WHEN n = 1 THEN indexer ELSE indexer || '-' || n END output FROM (SELECT *, row_number() OVER (PARTITION BY indexer ORDER BY root) n FROM r)""",
    "union_nodes": f"""WITH {_N}, {_m()} SELECT id, type FROM n UNION ALL SELECT 'file:' || file_path, 'FILE' FROM m WHERE 'file:' || file_path NOT IN (SELECT id FROM n)
      UNION ALL SELECT DISTINCT 'module:' || {_DIR}, 'MODULE' FROM m WHERE 'module:' || {_DIR} NOT IN (SELECT id FROM n)""",
    "files_per_dir": f"WITH {_m()} SELECT {_DIR} dir, count(*) files FROM m GROUP BY 1",
    "doc_texts": f"""WITH {_N}, x AS (SELECT id, j->>'$.doc' doc, j->>'$.signature' signature FROM n) SELECT id, {_clip("doc", 500)} doc, {_clip(_squash("signature"), 300)} signature
      FROM x WHERE doc IS NOT NULL OR signature IS NOT NULL""",
}
