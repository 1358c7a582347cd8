"""A source tree as DataFrames: every file with its size, digest and lines, read by Spark."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import extension_of, file_name_of, language_of

# What a scan leaves out unless told otherwise.
IGNORED = [
    ".git/", "node_modules/", "vendor/", "venv/", ".venv/", "site-packages/", "__pycache__/", "target/", "dist/", "build/",
    ".pytest_cache/", ".ruff_cache/", ".mypy_cache/", "*.min.js", "*.map",
]


def ignore_pattern(rule: str) -> tuple[str, bool]:
    """A rule of gitignore syntax as (pattern over relative paths, whether it keeps what it matches)."""
    keep, rule = rule.startswith("!"), rule.removeprefix("!")
    folder, rule = rule.endswith("/"), rule.rstrip("/")
    rooted, rule = "/" in rule, rule.removeprefix("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and "]" in rule[i + 1 :]:
            end = rule.index("]", i + 1)
            out, i = out + "[" + rule[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return ("^" if rooted else "(?:^|/)") + out + ("/" if folder else "(?:/|$)"), keep


def is_ignored(path: Column, rules: list[str]) -> Column:
    """The last rule that matches decides; hidden files and folders are always ignored."""
    state = F.lit(False)
    for rule in rules:
        if rule.strip() and not rule.startswith("#"):
            pattern, keep = ignore_pattern(rule.strip())
            state = F.when(path.rlike(pattern), F.lit(not keep)).otherwise(state)
    return state | path.rlike(r"(?:^|/)\.[^/]")


def with_stat(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds size, hash and lines of a binary column: lines are line feeds, and one more for a last line
    without one. Files that hold a zero byte are no text and are left out."""
    c = F.col(content)
    signs = F.decode(c, "ISO-8859-1")  # a sign for each byte
    feeds = F.char_length(signs) - F.char_length(F.translate(signs, "\n", ""))
    lines = feeds + F.when((signs == "") | signs.endswith("\n"), 0).otherwise(1)
    return df.filter(~signs.contains("\x00")).withColumns({"size": F.octet_length(c).cast("bigint"), "hash": F.sha2(c, 256), "lines": lines.cast("bigint")})


def _listed(spark: SparkSession, root: str, rules: list[str]) -> tuple[DataFrame, DataFrame]:
    """(path) of all files that aren't ignored, and (path, content) of those with content.

    A read leaves out files of no bytes; the listing, which Spark's file index holds anyway, has them.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    path = F.regexp_replace(F.col("path"), "^.*?" + re.escape(base) + "/", "")
    names = spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string").select(path.alias("path"))
    kept = ~is_ignored(F.col("path"), rules)
    return names.filter(kept), files.select(path.alias("path"), "content").filter(kept)


def scan(spark: SparkSession, root: str, rules: list[str] = IGNORED) -> DataFrame:
    """(path, language, size, hash, lines, content) of the files of known languages below root."""
    names, files = _listed(spark, root, rules)
    known = names.withColumn("language", language_of(F.col("path"))).filter("language is not null")
    whole = known.join(files, "path", "left").withColumn("content", F.coalesce("content", F.lit(b"")))
    return with_stat(whole).select("path", "language", "size", "hash", "lines", "content")


def markers(spark: SparkSession, root: str, names: list[str], rules: list[str] = IGNORED) -> DataFrame:
    """Paths of project files (of any kind) with one of the names; their content is not read."""
    return _listed(spark, root, rules)[0].filter(file_name_of(F.col("path")).isin(names))


def stat_of(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """(path, language, size, hash, lines) of files of other languages that an index names, below root;
    the language is the extension. Paths that are not there give no row."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    named = files.select(F.regexp_replace("path", "^.*?" + re.escape(base) + "/", "").alias("path"), "content").join(paths.select("path").distinct(), "path", "left_semi")
    language = F.coalesce(F.nullif(extension_of(F.col("path")), F.lit("")), F.lit("unknown"))
    return with_stat(named).select("path", language.alias("language"), "size", "hash", "lines")
