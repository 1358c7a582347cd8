"""Ranked search, outlines, relations, drift, slices and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.text import ascii_lower, last_identifier, printable_line
from linkloom.operators.graph import priority
from linkloom.operators.ranks import numbered_within

#: Rows of one page of an answer.
PAGE = 300
SYMBOLS = ["CLASS", "INTERFACE", "STRUCT", "ENUM", "TRAIT", "TYPE", "TYPE_ALIAS", "FUNCTION", "METHOD", "MACRO", "FIELD", "VARIABLE", "CONSTANT", "ENUM_MEMBER", "NAMESPACE"]


def find_symbols(nodes: DataFrame, query: str, kind: str | None = None, prefix: str | None = None, offset: int = 0, window: int = 300) -> DataFrame:
    """Symbols whose name or qualified name holds the query, A-Z folded and nothing a wildcard:
    exact names first, then names that begin with it, then by fan-in, name and id; one page of them."""
    q = ascii_lower(F.lit(query))
    name = ascii_lower(F.col("name"))
    hit = name.contains(q) | F.coalesce(ascii_lower(F.col("qualified")).contains(q), F.lit(False))
    found = nodes.filter(F.col("type").isin(SYMBOLS) & hit)
    if kind:
        found = found.filter(F.col("type") == kind)
    if prefix:
        found = found.filter(F.col("file_path").startswith(prefix))
    ranked = found.orderBy(F.desc(name == q), F.desc(name.startswith(q)), F.desc("fan_in"), "name", "id").offset(offset).limit(window)
    return ranked.select("id", F.col("type").alias("kind"), "name", "file_path", "start_line", "end_line", "fan_in")


def outlines(nodes: DataFrame) -> DataFrame:
    """What each file holds, in the order of its lines: file_path, at, kind, name, start_line, end_line, id, signature."""
    own = nodes.filter((F.col("type") != "FILE") & F.col("file_path").isNotNull())
    at = F.row_number().over(Window.partitionBy("file_path").orderBy(F.asc_nulls_first("start_line"), F.desc_nulls_last("end_line"), "id"))
    return own.select("file_path", at.alias("at"), F.col("type").alias("kind"), "name", "start_line", "end_line", "id", "signature")


def outline(nodes: DataFrame, path: str) -> DataFrame:
    return outlines(nodes.filter(F.col("file_path") == path)).drop("file_path")


def relations(links: DataFrame, nodes: DataFrame, towards: str) -> DataFrame:
    """All relations of every node, numbered by rank of kind, count, name and id of the other end, with
    their number and the page each is on. A node with a tenth of all links is numbered in many tasks."""
    own, other = ("target", "source") if towards == "dependents" else ("source", "target")
    ends = nodes.select(F.col("id").alias(other), "name", F.col("type").alias("other_type"), "file_path", "start_line")
    joined = links.filter(F.col("kind").isin("CALLS", "IMPLEMENTS", "REFERENCES", "USES", "DEPENDS_ON")).join(ends, other)
    ranked = numbered_within(joined, [own], [priority(F.col("kind")), F.desc("n"), F.asc("name"), F.asc(other)])
    page = F.ceil(F.col("at") / PAGE).cast("int")
    return ranked.select(F.col(own).alias("id"), "at", "of", page.alias("page"), "kind", F.col(other).alias("other_id"), "name", "other_type", "file_path", "start_line", F.col("n").alias("count"), F.array_join(F.slice("lines", 1, 5), ",").alias("sites"))


def members(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of each container in the order of the source, with their number."""
    below = links.filter(F.col("kind").isin("CONTAINS", "DEFINES")).select(F.col("source").alias("container"), F.col("target").alias("id")).distinct()
    rows = below.join(nodes, "id").select("container", "id", F.col("type").alias("kind"), "name", "start_line", "end_line")
    return numbered_within(rows, ["container"], [F.asc_nulls_first("start_line"), F.desc_nulls_last("end_line"), F.asc("id")])


def node_hints(unknown: DataFrame, nodes: DataFrame, limit: int = 5) -> DataFrame:
    """(id, hint): for each id that is no node the first nodes that have its last identifier as their name."""
    named = unknown.select("id", last_identifier(F.col("id")).alias("name")).filter("name != ''")
    known = Window.partitionBy("name").orderBy("hint")
    first = nodes.select("name", F.col("id").alias("hint")).withColumn("nth", F.row_number().over(known)).filter(F.col("nth") <= limit)
    return named.join(first, "name").select("id", "hint")


def path_hints(files: DataFrame, path: str, limit: int = 5) -> DataFrame:
    """The first indexed files whose path holds the last part of an unknown one."""
    return files.filter(F.col("file_path").contains(path.rsplit("/", 1)[-1])).select("file_path").orderBy("file_path").limit(limit)


def freshness(answer: DataFrame, indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(file_path, state) of the files that an answer names and the index has: changed or missing since."""
    named = answer.select("file_path").filter("file_path is not null").distinct()
    drifted = drift(indexed.join(named, "file_path", "left_semi"), current, "file_path", "content_hash")
    return drifted.filter("state in ('changed', 'missing')")


def drift(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): changed, missing or new in ``after``; a null digest on one side is a change."""
    a = before.select(key, F.col(digest).alias("a"), F.lit(True).alias("in_a"))
    b = after.select(key, F.col(digest).alias("b"), F.lit(True).alias("in_b"))
    state = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "new").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).filter("state is not null")


def numbered_lines(files: DataFrame, key: str, text: str, start: int = 1, end: int | None = None) -> DataFrame:
    """Lines start to end of every text, 1-based, for display; all of them by default."""
    parts = F.split(text, "\n")
    shown = parts if start == 1 and end is None else F.slice(parts, start, (end or 2**31 - 2) - start + 1)
    lines = files.select(key, F.posexplode(shown).alias("at", "raw"), (F.size(parts) - F.col(text).endswith("\n").cast("int")).alias("of"))
    n = F.col("at") + start
    return lines.select(key, n.alias("line"), "of", printable_line(F.col("raw")).alias("text")).filter(F.col("line") <= F.col("of")).drop("of")


def pages(rows: DataFrame, group: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """Adds the page each row is on, from 1 on: as many rows as fit in the budget, but at least one.

    Where pages end depends on all rows before, so each group is folded once, in order; a group is one
    answer (an outline of one file), which is rendered as a whole anyway.
    """
    w = Window.partitionBy(group).orderBy(*order)
    sized = rows.withColumn("at", F.row_number().over(w)).withColumn("size", size.cast("bigint"))
    start = F.struct(F.lit(1).alias("page"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<at:int,page:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["used"] > 0) & (acc["used"] + x["size"] > budget)
        page = acc["page"] + full.cast("int")
        used = F.when(full, x["size"]).otherwise(acc["used"] + x["size"])
        return F.struct(page.alias("page"), used.alias("used"), F.concat(acc["out"], F.array(F.struct(x["at"].alias("at"), page.alias("page")))).alias("out"))

    folded = sized.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("at", "size"))).alias("all")).select(group, F.explode(F.aggregate("all", start, step)["out"]).alias("o"))
    return sized.join(folded.select(group, F.col("o.at").alias("at"), F.col("o.page").alias("page")), [group, "at"])


def fitted_tables(rows: DataFrame, group: str, tables: list[str], budget: int) -> DataFrame:
    """(group, table, shown, total): how many rows of each table of an answer fit in the budget.

    rows: (group, table, at, of, size), at and of from `numbered_within`. First each table in turn gets an
    equal share of what is left, then the rest of the budget goes to the tables in the same order. Rows
    behind the budget are dropped before rows are collected, so a group collects no more than fits.
    """
    near = rows.filter(F.col("at") <= budget).select(group, "table", "at", "of", "size")  # every row takes a byte at least
    w = Window.partitionBy(group, "table").orderBy("at")
    ends = near.withColumn("end", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("end") <= budget) | (F.col("at") == 1))
    lists = ends.groupBy(group).agg(*[F.array_sort(F.filter(F.collect_list(F.when(F.col("table") == t, F.col("end"))), lambda x: x <= budget)).alias(f"e{i}") for i, t in enumerate(tables)], *[F.coalesce(F.max(F.when(F.col("table") == t, F.col("of"))), F.lit(0)).alias(f"of{i}") for i, t in enumerate(tables)])
    used = lambda e, n: F.when(n > 0, F.element_at(e, n)).otherwise(0)
    many = lambda e, most: F.size(F.filter(e, lambda x: x <= most))
    out = lists.withColumn("pool", F.lit(budget).cast("bigint"))
    for i in range(len(tables)):
        e = F.col(f"e{i}")
        out = out.withColumn(f"n{i}", many(e, F.floor(F.col("pool") / (len(tables) - i))))
        out = out.withColumn("pool", F.col("pool") - used(e, F.col(f"n{i}")))
    for i in range(len(tables)):
        e = F.col(f"e{i}")
        out = out.withColumn(f"m{i}", many(e, F.col("pool") + used(e, F.col(f"n{i}"))))
        out = out.withColumn("pool", F.col("pool") - used(e, F.col(f"m{i}")) + used(e, F.col(f"n{i}")))
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("table"), F.col(f"m{i}").alias("shown"), F.col(f"of{i}").alias("total")) for i, t in enumerate(tables)]))
    return out.select(group, each.alias("t")).select(group, "t.*")


def page_that_fits(rows: DataFrame, group: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """Of each group the longest prefix, in order, whose sizes add up to the budget at most, but always
    its first row; ``next`` is the offset of the rest, null if nothing is left."""
    w = Window.partitionBy(group).orderBy(*order)
    sized = rows.withColumn("at", F.row_number().over(w)).withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.count("*").over(Window.partitionBy(group))
    shown = sized.withColumn("total", total).filter((F.col("used") <= budget) | (F.col("at") == 1))
    last = F.max("at").over(Window.partitionBy(group))
    return shown.withColumn("next", F.when(last < F.col("total"), last))
