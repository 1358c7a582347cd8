"""From decoded semantic indexes and a file list to nodes, edges, manifest and statistics.

Inputs, one row each: documents (input_ord, doc_ord, path, language, tool), occurrences (input_ord,
doc_ord, occ_ord, symbol, symbol_roles, range, enclosing_range), symbols (input_ord, doc_ord, sym_ord,
symbol, kind, display_name, documentation, signature_text, relationships), files (path, language,
size, hash, lines).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.symbols import entity_with_kind, with_symbol
from linkloom.functions.text import clip, dir_of, file_name_of, first_fenced_block, language_of, squash
from linkloom.operators import graph
from linkloom.session import cut
from linkloom.sources.files import is_ignored

_DOC = ["input_ord", "doc_ord"]


@dataclass
class Built:
    nodes: DataFrame
    edges: DataFrame
    manifest: DataFrame
    stats: DataFrame


def span(r: Column) -> Column:
    """(line, column) pairs of a range of three or four numbers; null for any other."""
    pos = lambda a, b: F.struct(r[a].cast("int").alias("line"), r[b].cast("int").alias("col"))
    return F.when(F.size(r) == 3, F.struct(pos(0, 1).alias("start"), pos(0, 2).alias("end"))).when(F.size(r) == 4, F.struct(pos(0, 1).alias("start"), pos(2, 3).alias("end")))


def last_line(s: Column) -> Column:
    """1-based last line; an end at column 0 of a later line belongs to the line before."""
    early = (s["end"]["col"] == 0) & (s["end"]["line"] > s["start"]["line"])
    return (s["end"]["line"] + F.when(early, 0).otherwise(1)).cast("long")


def owned_documents(documents: DataFrame, listed: DataFrame, rules: list[str]) -> DataFrame:
    """documents (path, ...) with state: listed by the scan; skipped, as the scan knows its language but left
    it out; ignored by the rules; or other, a file of a language that no scan knows, still to be read."""
    known = documents.join(listed.select("path", F.lit(True).alias("known")).distinct(), "path", "left")
    state = F.when(F.col("known"), "listed").when(language_of(F.col("path")).isNotNull(), "skipped").when(is_ignored(F.col("path"), rules), "ignored").otherwise("other")
    return known.withColumn("state", state).drop("known")


def accepted_documents(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents of listed files with state: used, ignored (no such file), duplicate (a second one of a path).

    Files of languages that no scan knows are listed by `owned_documents` and `sources.files.stat_of`."""
    listed = documents.join(files.select("path", F.lit(True).alias("listed")).distinct(), "path", "left")
    rank = F.row_number().over(Window.partitionBy("path").orderBy("input_ord", "doc_ord"))
    return listed.withColumn("state", F.when(F.col("listed").isNull(), "ignored").when(rank == 1, "used").otherwise("duplicate")).drop("listed")


def _signature(d: Column, given: Column) -> Column:
    block = first_fenced_block(F.get(F.filter(d, lambda x: x.contains("```")), 0))
    return clip(F.nullif(squash(F.coalesce(F.nullif(given, F.lit("")), block)), F.lit("")), 300)


def _doc(d: Column) -> Column:
    plain = F.filter(F.transform(d, lambda x: F.trim(F.regexp_replace(x, r"(?s)```.*?```", ""))), lambda x: x != "")
    return clip(F.nullif(F.array_join(plain, "\n"), F.lit("")), 500)


def parsed_symbols(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every distinct symbol parsed once. It is cut, as filters on its columns would else parse it again."""
    related = symbols.select(F.explode("relationships").alias("r")).select("r.symbol")
    return cut(with_symbol(occurrences.select("symbol").unionByName(related).filter("symbol is not null").distinct()))


def definitions(used: DataFrame, occurrences: DataFrame, symbols: DataFrame, parsed: DataFrame) -> DataFrame:
    """Definitions that become nodes, numbered per id; the last information of a symbol counts."""
    latest = symbols.groupBy(*_DOC, "symbol").agg(F.max(F.struct("sym_ord", "kind", "display_name", "documentation", "signature_text", "relationships")).alias("info"))
    own = occurrences.filter(F.col("symbol_roles").bitwiseAND(1) != 0).join(used, _DOC).join(latest, [*_DOC, "symbol"], "left")
    shown = F.coalesce(F.nullif(F.col("info.display_name"), F.lit("")), F.col("name"))
    known = own.join(parsed, "symbol").withColumns({"own": span(F.col("range")), "whole": span(F.col("enclosing_range")), "entity": entity_with_kind(F.col("scoped"), F.col("info.kind"), F.col("entity")), "name": shown})
    known = known.filter("own is not null and entity != 'Skip'")
    at_top = (F.col("own.start.line") == 0) & (F.col("own.start.col") == 0)
    kept = known.filter((F.col("entity") != "Module") | ~at_top).withColumn("type", F.when(F.col("entity") == "Module", "NAMESPACE").otherwise(F.col("entity")))
    numbered = graph.numbered_definitions(kept, "symbol_id", [F.col("path"), F.col("input_ord"), F.col("doc_ord"), F.col("occ_ord")])
    s = F.coalesce("whole", "own")
    return numbered.withColumns({"start_line": (s["start"]["line"] + 1).cast("long"), "end_line": last_line(s), "signature": _signature(F.col("info.documentation"), F.col("info.signature_text")), "doc": _doc(F.col("info.documentation"))})


def references(used: DataFrame, occurrences: DataFrame, parsed: DataFrame) -> DataFrame:
    """References whose symbol is an entity by its descriptors alone."""
    refs = occurrences.filter((F.col("symbol_roles").bitwiseAND(1) == 0) & (F.col("symbol") != "")).join(used, _DOC).withColumn("own", span(F.col("range"))).filter("own is not null")
    targets = parsed.filter("entity not in ('Skip', 'Module')").select("symbol", F.col("symbol_id").alias("target"), "package")
    return refs.join(targets, "symbol").select("path", *_DOC, "occ_ord", F.col("own.start").alias("pos"), (F.col("own.start.line") + 1).cast("long").alias("line"), "target", "package")


def _innermost(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """Adds source: the innermost definition with a whole range around the place, else the file.

    Ranges are half open. Buckets of lines keep large files in small groups.
    """
    line = lambda c: F.col(c).cast("long")
    ranges = defs.filter("whole is not null and whole.start.line <= whole.end.line").select("path", F.col("whole.start").alias("b"), F.col("whole.end").alias("e"), F.col("occ_ord").alias("k"), F.col("node_id").alias("around"), graph.span_buckets(line("whole.start.line"), line("whole.end.line")).alias("at")).select("*", "at.*").drop("at")
    near = refs.select("*", graph.point_buckets(line("pos.line")).alias("at")).select("*", "at.*").drop("at").join(ranges, ["path", "level", "bucket"], "left")
    inside = (F.col("b") <= F.col("pos")) & (F.col("pos") < F.col("e"))
    key = F.struct(F.col("b"), F.struct((-F.col("e.line")).alias("l"), (-F.col("e.col")).alias("c")).alias("e"), "k", "around")
    keys = ["path", *_DOC, "occ_ord"]
    best = near.groupBy(*keys).agg(F.max(F.when(inside, key)).getField("around").alias("around"), *[F.first(c).alias(c) for c in ("line", "target", "package")])
    return best.withColumn("source", F.coalesce("around", F.concat(F.lit("file:"), "path")))


def build(documents: DataFrame, occurrences: DataFrame, symbols: DataFrame, files: DataFrame) -> Built:
    """All relations of one build. Null or empty inputs give empty relations, never an error."""
    states = cut(accepted_documents(documents, files))
    used = states.filter("state = 'used'").drop("state")
    parsed = parsed_symbols(occurrences, symbols)
    defs = cut(definitions(used, occurrences, symbols, parsed))
    refs = _innermost(references(used, occurrences, parsed), defs)

    # nodes: files, definitions, folders, external packages
    tool = used.select(F.col("path").alias("p"), F.col("tool").alias("indexed_by"))
    manifest = files.join(tool, files["path"] == tool["p"], "left").select(F.col("path").alias("file_path"), "language", "size", F.col("hash").alias("content_hash"), "lines", "indexed_by")
    empty = lambda kind: F.lit(None).cast(kind)
    columns = ["id", "type", "name", "file_path", "start_line", "end_line", "language", "qualified", "signature", "doc", "duplicate_of"]
    file_nodes = manifest.select(F.concat(F.lit("file:"), "file_path").alias("id"), F.lit("FILE").alias("type"), file_name_of(F.col("file_path")).alias("name"), "file_path", F.lit(1).cast("long").alias("start_line"), F.greatest(F.col("lines"), F.lit(1)).alias("end_line"), "language", *[empty("string").alias(c) for c in columns[7:]])
    symbol_nodes = defs.select(F.col("node_id").alias("id"), "type", "name", F.col("path").alias("file_path"), "start_line", "end_line", "language", "qualified", "signature", "doc", F.when(F.col("n") > 1, F.col("symbol_id")).alias("duplicate_of"))
    dirs = manifest.select(dir_of(F.col("file_path")).alias("dir")).distinct()
    dir_nodes = dirs.select(F.concat(F.lit("module:"), "dir").alias("id"), F.lit("MODULE").alias("type"), F.col("dir").alias("name"), *[empty("string" if c not in ("start_line", "end_line") else "long").alias(c) for c in columns[3:]])

    canonical = defs.filter("n = 1").select(F.col("node_id").alias("target"), F.col("type").alias("target_type"))
    own_packages = defs.select("package").distinct()
    tagged = graph.resolve(refs, canonical.withColumnRenamed("target", "id"), own_packages).join(canonical, "target", "left")
    calls = F.col("around").isNotNull() & F.col("target_type").isin(graph.CALLABLE)
    outside = F.concat(F.lit("external:"), F.replace("package", F.lit("/"), F.lit(":")))
    kind = F.when(F.col("outcome") == "external", "USES").when(F.col("outcome") == "unresolved", "unresolved").when(calls, "CALLS").otherwise("REFERENCES")
    used_refs = tagged.filter("outcome != 'dropped'").select("source", F.when(F.col("outcome") == "external", outside).otherwise(F.col("target")).alias("target"), kind.alias("kind"), F.lit(1).cast("bigint").alias("n"), F.array("line").alias("lines"))
    # all that nodes, edges and statistics need of the references, summed
    every = cut(graph.aggregate_links(used_refs))
    counted = every.filter("kind != 'unresolved'")
    packages = counted.filter("kind = 'USES'").select(F.col("target").alias("id")).distinct()
    external_nodes = packages.select("id", F.lit("EXTERNAL").alias("type"), F.element_at(F.split("id", "[:/]"), -1).alias("name"), *[empty("string" if c not in ("start_line", "end_line") else "long").alias(c) for c in columns[3:]])
    nodes = file_nodes.unionByName(symbol_nodes).unionByName(dir_nodes).unionByName(external_nodes)

    # structure: folders hold files, types hold members, files define the rest
    plain = lambda df: df.select("source", "target", "kind", empty("bigint").alias("n"), empty("array<bigint>").alias("lines"))
    dir_edges = manifest.select(F.concat(F.lit("module:"), dir_of(F.col("file_path"))).alias("source"), F.concat(F.lit("file:"), "file_path").alias("target"), F.lit("CONTAINS").alias("kind"))
    owners = canonical.select(F.col("target").alias("parent_id"), F.lit(True).alias("known"))
    placed = defs.join(owners, "parent_id", "left")
    held = F.coalesce("known", F.lit(False)) & (F.col("parent_id") != F.col("node_id"))
    owned = placed.select(F.when(held, F.col("parent_id")).otherwise(F.concat(F.lit("file:"), "path")).alias("source"), F.col("node_id").alias("target"), F.when(held, "CONTAINS").otherwise("DEFINES").alias("kind"))
    relations = defs.select(F.col("node_id").alias("source"), F.explode("info.relationships").alias("r")).filter("r.is_implementation").select("source", F.col("r.symbol").alias("symbol"))
    implemented = relations.join(parsed, "symbol").select("source", F.col("symbol_id").alias("target"), F.lit("IMPLEMENTS").alias("kind")).join(canonical.select("target"), "target", "left_semi")

    # roll-ups between files and between folders
    at = defs.select(F.col("node_id").alias("id"), F.col("path").alias("file_path")).unionByName(manifest.select(F.concat(F.lit("file:"), "file_path").alias("id"), "file_path"))
    roll = lambda df, prefix: df.select(F.concat(F.lit(prefix), "from_place").alias("source"), F.concat(F.lit(prefix), "to_place").alias("target"), F.lit("DEPENDS_ON").alias("kind"), "n", empty("array<bigint>").alias("lines"))
    edges = plain(dir_edges).unionByName(plain(owned)).unionByName(plain(implemented)).unionByName(counted)
    edges = edges.unionByName(roll(graph.file_dependencies(counted, at), "file:")).unionByName(roll(graph.dir_dependencies(counted, at), "module:"))

    rows = lambda df, columns: df.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(name) for name, c in columns.items()]).select(F.explode(F.create_map(*[x for name in columns for x in (F.lit(name), F.col(name))])).alias("name", "value"))
    state, own = (lambda x: F.count_if(F.col("state") == x)), (lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))))
    stats = (
        rows(states, {"documents": state("used"), "ignored_documents": state("ignored"), "duplicate_documents": state("duplicate")})
        .unionByName(rows(defs, {"definitions": F.count("*"), "duplicate_definitions": F.count_if(F.col("n") > 1)}))
        .unionByName(rows(every, {"resolved": own("CALLS", "REFERENCES"), "external": own("USES"), "unresolved": own("unresolved")}))
    )
    return Built(graph.with_fan(nodes, edges), edges, manifest, stats)
