import json

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from linkloom.plans.build import build
from linkloom.session import table
from linkloom.sources import snapshot
from linkloom.sources.files import is_ignored, markers, scan
from linkloom.sources import semantic_index as I
from linkloom.sources.semantic_index import read_binary_indexes, read_indexes
from linkloom.streaming.links import keep_counts, latest_counts


def test_scan_of_a_tree(spark, tmp_path):
    files = {"src/a.rs": b"fn a() {}\nfn b() {}", "src/empty.py": b"", "src/crlf.TS": b"x\r\ny\r\n", "src/bin.js": b"a\x00b", "target/x.rs": b"x", "notes.txt": b"x", ".hidden/y.py": b"y", "Cargo.toml": b"", "web/dist/z.js": b"z\n", "ä/ü.py": b"1\n"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.path: (r.language, r.size, r.lines) for r in scan(spark, str(tmp_path)).collect()}
    assert got == {"src/a.rs": ("rust", 19, 2), "src/empty.py": ("python", 0, 0), "src/crlf.TS": ("typescript", 6, 2), "ä/ü.py": ("python", 2, 1)}
    assert [r.path for r in markers(spark, str(tmp_path), ["Cargo.toml", "package.json"]).collect()] == ["Cargo.toml"]


@pytest.mark.parametrize(("rules", "ignored"), [
    (["*.min.js"], {"a/b.min.js"}), (["/docs"], {"docs/x.py"}), (["docs/"], {"docs/x.py", "a/docs/y.py"}), (["docs/", "!docs/x.py"], {"a/docs/y.py"}), (["a/**/z.py"], {"a/z.py", "a/b/c/z.py"}), (["?.py", "[a-c].rs"], {"docs/x.py", "a/docs/y.py", "a/z.py", "a/b/c/z.py", "x.py"}), (["# note", ""], set()),
])
def test_ignore_rules(spark, rules, ignored):
    paths = ["a/b.min.js", "docs/x.py", "a/docs/y.py", "a/z.py", "a/b/c/z.py", "x.py", "src/long.py"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").filter(is_ignored(F.col("p"), rules)).collect()
    assert {r.p for r in got} == ignored


def test_index_to_snapshot_and_back(spark, tmp_path):
    doc = {"tool": "t", "tool_version": "1", "relative_path": "./a.rs", "language": "rust", "symbols": [], "occurrences": [{"range": [0, 3, 7], "symbol": "r cargo c 1 main().", "symbol_roles": 1, "enclosing_range": [0, 0, 2, 1]}, {"range": [1, 4, 8], "symbol": "r cargo c 1 main().", "symbol_roles": 0}]}
    (tmp_path / "one.json").write_text(json.dumps(doc) + "\nnot json\n")
    (tmp_path / "two.json").write_text("")
    docs, occ, sym = read_indexes(spark, [(str(tmp_path / "one.json"), "lib"), (str(tmp_path / "two.json"), "")])
    files = spark.createDataFrame([("lib/a.rs", "rust", 9, "h", 3)], "path string, language string, size long, hash string, lines long")
    out = build(docs, occ, sym, files)
    relations = {"nodes": out.nodes, "edges": out.edges, "manifest": out.manifest, "stats": out.stats}
    root = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        snapshot.open_snapshot(spark, root)
    snapshot.write_snapshot(spark, root, relations, "1")
    current = snapshot.open_snapshot(spark, root)
    assert tuple(snapshot.counts(current).first()) == (3, 3, 1, 1)
    assert {(r.source, r.kind) for r in current["edges"].collect()} == {("module:lib", "CONTAINS"), ("file:lib/a.rs", "DEFINES"), ("cargo:c:main().", "CALLS")}
    bad = relations | {"nodes": out.nodes.filter("type != 'MODULE'")}
    with pytest.raises(snapshot.BrokenSnapshot):
        snapshot.write_snapshot(spark, root, bad, "2")
    assert snapshot.open_snapshot(spark, root)["nodes"].count() == 3
    runs = spark.createDataFrame([(1, "rust", "ok")], "id long, indexer string, status string")
    snapshot.write_snapshot(spark, root, relations | {"index_runs": runs}, "3", {"generated_at": "2026-01-01"})
    assert snapshot.meta_of(spark, root) == {"generated_at": "2026-01-01"} and snapshot.open_snapshot(spark, root)["index_runs"].count() == 1
    assert "v=3" in snapshot.open_snapshot(spark, root)["nodes"].inputFiles()[0]
    snapshot.export_json(snapshot.open_snapshot(spark, root), str(tmp_path / "json"), snapshot.meta_of(spark, root))
    summary = spark.read.json(str(tmp_path / "json/summary")).first()
    assert (summary.version, summary.generated_at) == ("2", "2026-01-01") and [tuple(r) for r in summary.coverage] == [(1, 1, "rust")]
    assert {r.name: r.value for r in summary.stats}["definitions"] == 1
    assert spark.read.json(str(tmp_path / "json/nodes")).count() == 3


def test_streamed_counts_equal_the_batch(spark, sf, tmp_path):
    edges = table(spark, sf, "edges")
    edges.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(edges.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = keep_counts(stream, str(tmp_path / "out"), str(tmp_path / "cp"), late="3650 days")
    query.awaitTermination(120)
    got = {tuple(r) for r in latest_counts(spark.read.parquet(str(tmp_path / "out"))).collect()}
    once = edges.dropDuplicates(["id"]).filter("source_id is not null and target_id is not null and type is not null")
    n = F.coalesce(F.get_json_object("metadata", "$.count").cast("bigint"), F.lit(1))
    want = {tuple(r) for r in once.groupBy("source_id", "target_id", "type").agg(F.sum(n), F.count("*")).collect()}
    assert got == want


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def encoded(fields, **values):
    return b"".join(field(fields[k], x) for k, v in values.items() for x in (v if isinstance(v, list) else [v]))


def test_binary_index_equals_its_decoded_form(spark, tmp_path):
    name, other = "r cargo c 1 m/keep().", "r cargo c 1 m/Draw#"
    packed = lambda *ns: b"".join(map(varint, ns))
    definition = encoded(I.OCCURRENCE, range=packed(3, 4, 200), symbol=name, symbol_roles=1, enclosing_range=packed(3, 0, 300, 1))
    typed = encoded(I.OCCURRENCE, symbol=name) + field(I.OCCURRENCE["multi_line_range"], b"".join(field(n, v) for n, v in ((1, 7), (3, 8), (4, 5))))
    loose = b"".join(field(I.OCCURRENCE["range"], n) for n in (9, 1, 2)) + encoded(I.OCCURRENCE, symbol="local 1") + varint(99 << 3 | 5) + b"abcd" + varint(98 << 3 | 1) + b"abcdefgh"
    info = encoded(I.SYMBOL, symbol=name, documentation=["Keeps it.", "ä"], relationships=[encoded(I.RELATIONSHIP, symbol=other, is_implementation=1)], kind=I.KINDS["Method"], display_name="keep", signature_documentation=encoded(I.DOCUMENT, text="fn keep()"))
    bare = encoded(I.SYMBOL, symbol=other, kind=9999)
    document = encoded(I.DOCUMENT, relative_path="./a b.rs", language="rust", occurrences=[definition, typed, loose], symbols=[info, bare])
    meta = encoded(I.METADATA, tool_info=encoded(I.TOOL, name="t", version="2"), project_root="file:///work/my%20app/lib/")
    (tmp_path / "one.bin").write_bytes(field(I.INDEX["metadata"], meta) + field(I.INDEX["documents"], document) * 2)
    (tmp_path / "two.bin").write_bytes(field(I.INDEX["documents"], encoded(I.DOCUMENT, relative_path="b.rs")))
    (tmp_path / "none.bin").write_bytes(b"")
    docs, occ, sym = read_binary_indexes(spark, [str(tmp_path / f) for f in ("one.bin", "two.bin", "none.bin")], "/work/my app")
    assert sorted(tuple(r) for r in docs.collect()) == [(0, 0, "lib/a b.rs", "rust", "t 2"), (0, 1, "lib/a b.rs", "rust", "t 2"), (1, 0, "b.rs", "", "scip")]
    assert sorted(tuple(r) for r in occ.filter("doc_ord = 0").collect()) == [(0, 0, 0, name, 1, [3, 4, 200], [3, 0, 300, 1]), (0, 0, 1, name, 0, [7, 0, 8, 5], []), (0, 0, 2, "local 1", 0, [9, 1, 2], [])]
    got = {r.symbol: r for r in sym.filter("doc_ord = 0").collect()}
    assert (got[name].kind, got[name].display_name, got[name].documentation, got[name].signature_text) == ("Method", "keep", ["Keeps it.", "ä"], "fn keep()")
    assert [tuple(r) for r in got[name].relationships] == [(other, True)] and got[other].kind is None
    files = spark.createDataFrame([("lib/a b.rs", "rust", 9, "h", 301), ("b.rs", "rust", 1, "h", 1)], "path string, language string, size long, hash string, lines long")
    built = build(docs, occ, sym, files)
    assert {(r.source, r.target, r.kind) for r in built.edges.filter("kind = 'CALLS'").collect()} == {("cargo:c:m/keep().", "cargo:c:m/keep().", "CALLS")}
    (tmp_path / "bad.bin").write_bytes(b"\xff\xff not an index")
    with pytest.raises(PythonException):
        read_binary_indexes(spark, [str(tmp_path / "bad.bin")])[0].collect()
