"""Column functions over names, paths and texts. All of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# File extensions of the built-in languages.
LANGUAGE_BY_EXTENSION = {
    "rs": "rust",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python",
}


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z only; other letters keep their case."""
    return F.translate(c, _UPPER, _UPPER.lower())


def squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clip(c: Column, n: int) -> Column:
    """At most n characters, followed by an ellipsis if something was cut."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def dir_of(path: Column) -> Column:
    """The folder of a path; "." for a file at the top."""
    d = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path.isNull(), None).when(d == "", F.lit(".")).otherwise(d)


def file_name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of(path: Column) -> Column:
    """Language by extension, null where the extension is unknown."""
    pairs = [F.lit(x) for kv in LANGUAGE_BY_EXTENSION.items() for x in kv]
    return F.element_at(F.create_map(*pairs), extension_of(path))


def clean_path(path: Column) -> Column:
    r"""One spelling of a path: ``\`` read as ``/``, repeated ``/`` made one, leading ``./`` dropped."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/")
    return F.regexp_replace(p, r"^(\./)+", "")


def refused_path(path: Column) -> Column:
    """True for a path that must not be followed: absolute, with a drive, with ``..`` or empty."""
    p = clean_path(path)
    return p.isNull() | (p == "") | p.startswith("/") | p.rlike("^[A-Za-z]:") | p.rlike(r"(^|/)\.\.(/|$)")


def first_fenced_block(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)```[^\n]*\n(.*?)```", 1)


def printable_line(c: Column) -> Column:
    """A source line for display: one trailing carriage return dropped, control characters replaced."""
    return F.regexp_replace(F.regexp_replace(c, r"\r$", ""), r"[\p{Cc}&&[^\t]]", "�")


def run_label(tool: Column, version: Column) -> Column:
    name = F.when(F.coalesce(tool, F.lit("")) == "", F.lit("scip")).otherwise(tool)
    return F.when(F.coalesce(version, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(" "), version))


def percent_decoded(c: Column) -> Column:
    """``%41`` becomes ``A``; a ``%`` without two hexadecimal digits stays, as does ``+``."""
    whole = F.regexp_replace(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.url_decode(whole)


def json_bytes(c: Column) -> Column:
    """Bytes of a text as a JSON string, quotes included."""
    twice = F.char_length(c) - F.char_length(F.translate(c, '"\\\n\r\t\b\f', ""))
    six = F.char_length(c) - F.char_length(F.regexp_replace(c, r"[\x00-\x07\x0b\x0e-\x1f]", ""))
    return F.octet_length(c) + twice + 5 * six + 2


def clip_json(c: Column, limit: int) -> Column:
    """A text whose JSON form has at most ``limit`` bytes; else its longest prefix that has with an ellipsis.

    A prefix longer than the limit can't fit, so no more than that is looked at.
    """
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.char_length(c), F.lit(limit))), lambda i: F.substring(c, F.lit(1), i))
    longest = F.array_max(F.transform(F.filter(prefixes, lambda x: json_bytes(x) + 3 <= limit), lambda x: F.struct(F.char_length(x).alias("n"), x.alias("x"))))["x"]
    return F.when(json_bytes(c) <= limit, c).when(c.isNotNull(), F.concat(F.coalesce(longest, F.lit("")), F.lit("…")))


# Bytes of the JSON form of a cell, by the name of its column; all others have the last one.
CELL_LIMITS = {
    "id": 640, "container": 640, "file": 480, "path": 480, "line": 520, "kind": 64, "rel": 64, "direction": 64,
    "edges": 64, "language": 64, "status": 64, "state": 64, "indexed_by": 64, "type": 64, "": 200,
}


def clip_cells(df: DataFrame) -> DataFrame:
    """All text columns of an answer clipped to the limits of their names."""
    texts = [name for name, kind in df.dtypes if kind == "string"]
    return df.withColumns({name: clip_json(F.col(name), CELL_LIMITS.get(name, CELL_LIMITS[""])) for name in texts})


def last_identifier(c: Column) -> Column:
    """The last run of letters, digits and underscores, as in an id; empty without any."""
    return F.regexp_extract(c, r"([\p{L}\p{N}_]+)[^\p{L}\p{N}_]*$", 1)


# Words by which a line of a log looks like an error.
ERROR_WORDS = ["error", "fatal", "failed", "cannot", "can't", "no projects", "not found", "panicked", "exception", "invalid"]


def failure_summary(log: Column, limit: int = 400) -> Column:
    """The last two lines of a log that look like errors, else its last three; frames of a backtrace
    and blank lines don't count."""
    frame = lambda x: x.startswith("at ") | x.startswith("Stack backtrace") | x.rlike(r"^[0-9]+: +[^0-9 ]|^[0-9]+: +$")
    lines = F.filter(F.transform(F.split(log, "\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: (x != "") & ~frame(x))
    bad = lambda x: F.exists(F.array(*map(F.lit, ERROR_WORDS)), lambda w: ascii_lower(x).contains(w))
    errors = F.filter(lines, bad)
    last = lambda a, n: F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)
    return clip(F.array_join(F.when(F.size(errors) > 0, last(errors, 2)).otherwise(last(lines, 3)), " | "), limit)
