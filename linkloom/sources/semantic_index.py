"""Semantic indexes as the relations of a build: binary ones, or decoded documents as JSON lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import percent_decoded

_DOCUMENT = """tool string, tool_version string, relative_path string, language string,
occurrences array<struct<range: array<int>, symbol: string, symbol_roles: int, enclosing_range: array<int>>>,
symbols array<struct<symbol: string, kind: string, display_name: string, documentation: array<string>, signature_text: string,
relationships: array<struct<symbol: string, is_implementation: boolean>>>>"""

# Numbers of the public index format. Fields of its messages, then kinds of symbols.
INDEX = {"metadata": 1, "documents": 2}
METADATA = {"tool_info": 2, "project_root": 3}
TOOL = {"name": 1, "version": 2}
DOCUMENT = {"relative_path": 1, "occurrences": 2, "symbols": 3, "language": 4, "text": 5}
OCCURRENCE = {"range": 1, "symbol": 2, "symbol_roles": 3, "enclosing_range": 7, "single_line_range": 8, "multi_line_range": 9, "single_line_enclosing_range": 10, "multi_line_enclosing_range": 11}
SYMBOL = {"symbol": 1, "documentation": 3, "relationships": 4, "kind": 5, "display_name": 6, "signature_documentation": 7}
RELATIONSHIP = {"symbol": 1, "is_implementation": 3}
KINDS = {
    "AssociatedType": 3, "Attribute": 4, "Class": 7, "Constant": 8, "Constructor": 9, "DataFamily": 10, "Enum": 11, "EnumMember": 12, "Field": 15, "File": 16, "Function": 17, "Getter": 18,
    "Interface": 21, "Macro": 25, "Method": 26, "MethodReceiver": 27, "Module": 29, "Namespace": 30, "Object": 33, "Package": 35, "PackageObject": 36, "Parameter": 37, "ParameterLabel": 38,
    "Property": 41, "Protocol": 42, "SelfParameter": 44, "Setter": 45, "Struct": 49, "ThisParameter": 52, "Trait": 53, "Type": 54, "TypeAlias": 55, "TypeClass": 56, "TypeFamily": 57,
    "TypeParameter": 58, "Union": 59, "Value": 60, "Variable": 61, "Library": 64, "AbstractMethod": 66, "MethodSpecification": 67, "ProtocolMethod": 68, "PureVirtualMethod": 69,
    "TraitMethod": 70, "TypeClassMethod": 71, "Accessor": 72, "MethodAlias": 74, "SingletonClass": 75, "SingletonMethod": 76, "StaticDataMember": 77, "StaticField": 79, "StaticMethod": 80,
    "StaticProperty": 81, "StaticVariable": 82, "Extension": 84, "Mixin": 85,
}
_KIND = {n: name for name, n in KINDS.items()}


def _varint(buf: memoryview, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = buf[i]
        value |= (byte & 0x7F) << shift
        i, shift = i + 1, shift + 7
        if byte < 0x80:
            return value, i


def _fields(buf: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message; values of a length stay views of its bytes."""
    i = 0
    while i < len(buf):
        tag, i = _varint(buf, i)
        wire = tag & 7
        if wire == 0:
            value, i = _varint(buf, i)
        elif wire in (1, 2, 5):
            size, i = _varint(buf, i) if wire == 2 else ({1: 8, 5: 4}[wire], i)
            value, i = buf[i : i + size], i + size
        else:
            raise ValueError(f"no field of kind {wire}")
        if i > len(buf):
            raise ValueError("a field ends behind its message")
        yield tag >> 3, value


def _view(value: pa.BinaryScalar) -> memoryview:
    return memoryview(value.as_buffer() if value.is_valid else b"").cast("B")


def _message(buf: memoryview) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in _fields(buf):
        out.setdefault(number, []).append(value)
    return out


def _text(message: dict[int, list], number: int) -> str:
    return bytes(message.get(number, [b""])[-1]).decode("utf-8", "replace")


def _numbers(values: list) -> list[int]:
    """A repeated number, packed or not."""
    out = []
    for v in values:
        i = 0
        while isinstance(v, memoryview) and i < len(v):
            n, i = _varint(v, i)
            out.append(n)
        out += [v] if isinstance(v, int) else []
    return out


def _range(o: dict[int, list], plain: str, one_line: str, more_lines: str) -> list[int]:
    """Three or four numbers; a typed range counts where the plain one is missing."""
    if own := _numbers(o.get(OCCURRENCE[plain], [])):
        return own
    for name, size in ((one_line, 3), (more_lines, 4)):
        if OCCURRENCE[name] in o:
            typed = _message(o[OCCURRENCE[name]][-1])
            return [typed.get(n, [0])[-1] for n in range(1, size + 1)]
    return []


def _occurrence(buf: memoryview) -> dict:
    o = _message(buf)
    return {
        "range": _range(o, "range", "single_line_range", "multi_line_range"), "symbol": _text(o, OCCURRENCE["symbol"]), "symbol_roles": o.get(OCCURRENCE["symbol_roles"], [0])[-1],
        "enclosing_range": _range(o, "enclosing_range", "single_line_enclosing_range", "multi_line_enclosing_range"),
    }


def _symbol(buf: memoryview) -> dict:
    s = _message(buf)
    signature = s.get(SYMBOL["signature_documentation"])
    related = [_message(r) for r in s.get(SYMBOL["relationships"], [])]
    return {
        "symbol": _text(s, SYMBOL["symbol"]), "kind": _KIND.get(s.get(SYMBOL["kind"], [0])[-1]), "display_name": _text(s, SYMBOL["display_name"]),
        "documentation": [bytes(d).decode("utf-8", "replace") for d in s.get(SYMBOL["documentation"], [])], "signature_text": _text(_message(signature[-1]), DOCUMENT["text"]) if signature else None,
        "relationships": [{"symbol": _text(r, RELATIONSHIP["symbol"]), "is_implementation": bool(r.get(RELATIONSHIP["is_implementation"], [0])[-1])} for r in related],
    }


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index files (input_ord, content) to a row for each document, still encoded."""
    for b in batches:
        for ord_, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            index = _message(_view(content))
            meta = _message(index[INDEX["metadata"]][-1]) if INDEX["metadata"] in index else {}
            tool = _message(meta[METADATA["tool_info"]][-1]) if METADATA["tool_info"] in meta else {}
            rows = [{
                "input_ord": ord_, "doc_ord": i, "tool": _text(tool, TOOL["name"]), "tool_version": _text(tool, TOOL["version"]), "project_root": _text(meta, METADATA["project_root"]), "document": bytes(d),
            } for i, d in enumerate(index.get(INDEX["documents"], []))]
            for i in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist(rows[i : i + 1000], _SPLIT)


_SPLIT = pa.schema([("input_ord", pa.int32()), ("doc_ord", pa.int64()), ("tool", pa.string()), ("tool_version", pa.string()), ("project_root", pa.string()), ("document", pa.binary())])
_ENCODED = "input_ord int, doc_ord bigint, tool string, tool_version string, project_root string, document binary"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    related = pa.struct([("symbol", pa.string()), ("is_implementation", pa.bool_())])
    occurrence = pa.struct([("range", pa.list_(pa.int32())), ("symbol", pa.string()), ("symbol_roles", pa.int32()), ("enclosing_range", pa.list_(pa.int32()))])
    symbol = pa.struct([("symbol", pa.string()), ("kind", pa.string()), ("display_name", pa.string()), ("documentation", pa.list_(pa.string())), ("signature_text", pa.string()), ("relationships", pa.list_(related))])
    for b in batches:
        documents = [_message(_view(d)) for d in b.column("document")]
        columns = {
            "relative_path": pa.array([_text(d, DOCUMENT["relative_path"]) for d in documents], pa.string()), "language": pa.array([_text(d, DOCUMENT["language"]) for d in documents], pa.string()),
            "occurrences": pa.array([[_occurrence(o) for o in d.get(DOCUMENT["occurrences"], [])] for d in documents], pa.list_(occurrence)),
            "symbols": pa.array([[_symbol(s) for s in d.get(DOCUMENT["symbols"], [])] for d in documents], pa.list_(symbol)),
        }
        kept = ["input_ord", "doc_ord", "project_root", "tool", "tool_version"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *columns.values()], [*kept, *columns])


def prefix_of(project_root: Column, root: str) -> Column:
    """Where an index lies below the root of the project, by the address in its metadata; "" if it doesn't."""
    at = F.regexp_replace(percent_decoded(F.regexp_extract(project_root, "^file://(.*)$", 1)), "/+$", "")
    base = root.rstrip("/") + "/"
    return F.when(at.startswith(base), F.substring(at, F.lit(len(base) + 1), F.char_length(at))).otherwise("")


def _relations(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    label = F.concat_ws(" ", F.coalesce(F.nullif("tool", F.lit("")), F.lit("scip")), F.nullif("tool_version", F.lit("")))
    documents = docs.select("input_ord", "doc_ord", "path", "language", label.alias("tool"))
    occurrences = docs.select("input_ord", "doc_ord", F.posexplode("occurrences").alias("occ_ord", "o")).select("input_ord", "doc_ord", "occ_ord", "o.symbol", F.coalesce("o.symbol_roles", F.lit(0)).alias("symbol_roles"), F.coalesce("o.range", F.array().cast("array<int>")).alias("range"), F.coalesce("o.enclosing_range", F.array().cast("array<int>")).alias("enclosing_range"))
    symbols = docs.select("input_ord", "doc_ord", F.posexplode("symbols").alias("sym_ord", "s")).select("input_ord", "doc_ord", "sym_ord", "s.*")
    return documents, occurrences, symbols


def _path(prefix: Column) -> Column:
    return F.concat(F.when(prefix != "", F.concat(prefix, F.lit("/"))).otherwise(""), F.regexp_replace("relative_path", r"^(\./)+", ""))


def read_binary_indexes(spark: SparkSession, paths: list[str], root: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, occurrences, symbols) of binary indexes, in order of precedence.

    One task cuts a file into its documents, which are then dealt out and decoded in batches. Paths are
    put below the place that the metadata of an index names inside ``root``. An empty file gives no rows,
    a file that is no index an error.
    """
    whole = None
    for ord_, path in enumerate(paths):
        own = spark.read.format("binaryFile").load(path).select(F.lit(ord_).alias("input_ord"), "content")
        whole = own if whole is None else whole.unionByName(own)
    encoded = whole.mapInArrow(_split, _ENCODED).repartition("input_ord", "doc_ord")
    decoded = encoded.mapInArrow(_decode, f"input_ord int, doc_ord bigint, project_root string, {_DOCUMENT}")
    return _relations(decoded.withColumn("path", _path(prefix_of(F.col("project_root"), root))))


def read_indexes(spark: SparkSession, paths: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, occurrences, symbols) of indexes given as (path, root prefix), in order of precedence.

    Lines are documents as JSON; their order within an index follows their path, as a distributed read has
    none of its own. An unreadable line gives no document, an empty file no rows.
    """
    whole = None
    for ord_, (path, prefix) in enumerate(paths):
        raw = spark.read.schema(_DOCUMENT).json(path).filter("relative_path is not null")
        own = raw.withColumns({"input_ord": F.lit(ord_), "path": _path(F.lit(prefix.strip("/")))})
        whole = own if whole is None else whole.unionByName(own)
    # the number of a document: its digest, stable whatever the partitioning
    return _relations(whole.withColumn("doc_ord", F.xxhash64("input_ord", "path", F.to_json(F.struct("occurrences", "symbols")))))
