"""Symbols of a semantic index as column expressions.

A symbol is "scheme manager package version descriptors", fields ending at a single space (a doubled
space is a space inside a field, "." an empty field). Descriptors are names with a suffix: / namespace,
# type, . term, (). method, : meta, ! macro, [x] type parameter, (x) parameter; names that are no plain
identifiers stand in backticks, with a backtick doubled inside.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"(?:`(?:[^`]|``)*`|[\p{L}\p{N}_+$-]+)"
_DESCRIPTOR = rf"{_NAME}(?:/|#|:|!|\((?:{_NAME})?\)\.|\.)|\[{_NAME}\]|\({_NAME}\)"
_FIELDS = r"^((?:[^ ]|  )*) ((?:[^ ]|  )*) ((?:[^ ]|  )*) ((?:[^ ]|  )*) (.+)$"

# What the kinds of a semantic index become.
KIND_TO_TYPE = {
    "CLASS": ["Class", "SingletonClass", "Object", "Mixin", "Extension"],
    "INTERFACE": ["Interface", "Protocol"],
    "STRUCT": ["Struct", "Union"],
    "ENUM": ["Enum"],
    "TRAIT": ["Trait", "TypeClass"],
    "TYPE_ALIAS": ["TypeAlias", "TypeFamily", "AssociatedType", "DataFamily"],
    "TYPE": ["Type"],
    "FUNCTION": ["Function"],
    "METHOD": ["Method", "Constructor", "MethodAlias", "MethodSpecification", "AbstractMethod", "StaticMethod", "ProtocolMethod", "PureVirtualMethod",
               "TraitMethod", "TypeClassMethod", "SingletonMethod", "Getter", "Setter", "Accessor"],
    "MACRO": ["Macro"],
    "FIELD": ["Field", "Property", "StaticField", "StaticProperty", "StaticDataMember", "Attribute"],
    "VARIABLE": ["Variable", "StaticVariable", "Value"],
    "CONSTANT": ["Constant"],
    "ENUM_MEMBER": ["EnumMember"],
    "Module": ["Module", "Namespace", "Package", "PackageObject", "File", "Library"],
    "Skip": ["Parameter", "ParameterLabel", "SelfParameter", "ThisParameter", "TypeParameter", "MethodReceiver"],
}


def entity_of_kind(kind: Column) -> Column:
    """A node type, Module or Skip; null for a kind that says nothing."""
    pairs = [F.lit(x) for entity, kinds in KIND_TO_TYPE.items() for k in kinds for x in (k, entity)]
    return F.element_at(F.create_map(*pairs), kind)


def entity_with_kind(scoped: Column, kind: Column, by_descriptor: Column) -> Column:
    return F.when(scoped, "Skip").otherwise(F.coalesce(entity_of_kind(kind), by_descriptor))


def _field(symbol: Column, i: int) -> Column:
    raw = F.replace(F.regexp_extract(symbol, _FIELDS, i), F.lit("  "), F.lit(" "))
    return F.when(raw == ".", "").otherwise(raw)


def _struct(d: Column) -> Column:
    """One descriptor: its name without escapes, its kind of suffix, its text."""
    core = F.regexp_extract(d, rf"({_NAME})", 1)
    name = F.when(core.startswith("`"), F.replace(F.substring(core, F.lit(2), F.char_length(core) - 2), F.lit("``"), F.lit("`"))).otherwise(core)
    last = F.substring(d, -1, 1)
    suffix = (
        F.when(d.startswith("["), "type parameter").when(d.startswith("("), "parameter").when(last == "/", "namespace").when(last == "#", "type")
        .when(last == ":", "meta").when(last == "!", "macro").when(d.endswith(")."), "method").otherwise("term")
    )
    return F.struct(name.alias("name"), suffix.alias("suffix"), d.alias("text"))


def _id(manager: Column, package: Column, text: Column) -> Column:
    return F.concat(F.when(manager == "", "scip").otherwise(manager), F.lit(":"), F.when(package == "", "_").otherwise(package), F.lit(":"), text)


def with_symbol(df, column: str = "symbol", kind: Column | None = None, display: Column | None = None):
    """Adds entity, scoped, symbol_id, parent_id, package, name, qualified for a column of symbols.

    entity is a node type, Module or Skip; ``kind`` of the index goes before what the descriptors
    imply, except inside a parameter or an indexer's own scope, which is always Skip (``scoped``). Local, empty,
    null and malformed symbols are Skip with null for the rest.
    """
    s = F.col(column)
    text = F.regexp_extract(s, _FIELDS, 5)
    df = df.withColumns({"_m": _field(s, 2), "_p": _field(s, 3), "_t": text, "_d": F.transform(F.regexp_extract_all(text, F.lit(_DESCRIPTOR), F.lit(0)), _struct)})
    d, n = F.col("_d"), F.size("_d")
    ok = ~s.startswith("local ") & (n > 0) & (F.array_join(F.transform(d, lambda x: x["text"]), "") == F.col("_t"))
    # impl#[Owner][Trait]member: the member belongs to the type Owner next to the block
    blocks = F.transform(d, lambda x, i: (x["name"] == "impl") & (x["suffix"] == "type") & (F.get(d, i + 1)["suffix"] == "type parameter"))
    df = df.withColumns({"_ok": F.coalesce(ok, F.lit(False)), "_impl": F.array_position(F.transform(blocks, lambda b: F.coalesce(b, F.lit(False))), True)})
    impl, has = F.col("_impl"), F.col("_impl") > 0
    last, before = F.try_element_at(d, F.lit(-1)), F.get(d, n - 2)
    member = has | F.coalesce((n >= 2) & (before["suffix"] == "type"), F.lit(False))
    by_descriptor = (
        F.when((last["suffix"] == "namespace") | ((last["suffix"] == "meta") & (last["name"] == "__init__")), "Module").when(last["suffix"] == "macro", "MACRO")
        .when(last["suffix"] == "method", F.when(member, "METHOD").otherwise("FUNCTION")).when(last["suffix"] == "type", "TYPE")
        .when(last["suffix"] == "term", F.when(member, "FIELD").otherwise("VARIABLE")).otherwise("Skip")
    )
    inner = lambda x: (x["suffix"] == "parameter") | ((x["suffix"] == "meta") & (x["name"] != "__init__")) | ((x["suffix"] == "type parameter") & ~has)
    inside = F.exists(F.slice(d, 1, F.greatest(n - 1, F.lit(0))), inner)
    by_descriptor = F.when(~F.col("_ok") | inside, "Skip").otherwise(by_descriptor)
    scoped = ~F.col("_ok") | inside
    entity = by_descriptor if kind is None else entity_with_kind(scoped, kind, by_descriptor)
    join = lambda a: F.array_join(F.transform(a, lambda x: x["text"]), "")
    owner = F.get(d, impl.cast("int"))["text"]
    parent = F.when(has, F.concat(join(F.slice(d, F.lit(1), F.greatest(impl.cast("int") - 1, F.lit(0)))), F.substring(owner, F.lit(2), F.char_length(owner) - 2), F.lit("#"))).when(n >= 2, join(F.slice(d, F.lit(1), F.greatest(n - 1, F.lit(0)))))
    # type parameters right after the owner of an impl block are part of it
    gone = lambda i: has & (i + 1 > impl) & F.forall(F.slice(d, impl.cast("int") + 1, F.greatest(i + 1 - impl.cast("int"), F.lit(0))), lambda x: x["suffix"] == "type parameter")
    named = F.transform(d, lambda x, i: F.when(has & (i + 1 == impl), F.get(d, impl.cast("int"))["name"]).when(has & (i + 1 > impl) & gone(i), None).when(x["suffix"].isin("type", "term", "method", "macro"), x["name"]))
    name = last["name"] if display is None else F.when(F.coalesce(display, F.lit("")) != "", display).otherwise(last["name"])
    good = lambda c: F.when(F.col("_ok"), c)
    out = df.withColumns({
        "entity": entity, "scoped": scoped, "symbol_id": good(_id(F.col("_m"), F.col("_p"), F.col("_t"))), "parent_id": good(_id(F.col("_m"), F.col("_p"), parent)),
        "package": good(F.concat_ws("/", "_m", "_p")), "name": good(name), "qualified": good(F.array_join(F.array_compact(named), ".")),
    })
    return out.drop("_m", "_p", "_t", "_d", "_ok", "_impl")
