import json

import pytest
from pyspark.sql import functions as F

from linkloom.functions.symbols import with_symbol
from linkloom.plans.build import build
from linkloom.queries import rebuild

PY = "scip-python python shop-kit 2.1 "
RS = "rust-analyzer cargo ledger 0.3.0 "
TS = "scip-typescript npm web-kit 4.0.1 "


@pytest.mark.parametrize(("symbol", "entity", "more"), [
    (PY + "`shop.store`/Store#put().", "METHOD", ("python:shop-kit:`shop.store`/Store#put().", "python:shop-kit:`shop.store`/Store#", "put", "Store.put")),
    (PY + "`shop.store`/open_store().", "FUNCTION", None), (TS + "lib/`cart.ts`/total.", "VARIABLE", None), (TS + "lib/`cart.ts`/Cart#rows.", "FIELD", None), (TS + "lib/`cart.ts`/Cart#", "TYPE", None),
    (PY + "`shop.store`/open_store().(path)", "Skip", None), ("local 3", "Skip", None), ("", "Skip", None), ("two words", "Skip", None), (None, "Skip", None), (RS + "a/b", "Skip", None),
    (TS + "lib/`cart.ts`/", "Module", None), (PY + "`shop.store`/__init__:", "Module", None), (RS + "book/", "Module", None), (RS + "say!", "MACRO", None),
    (TS + "lib/`cart.ts`/show().(opts)shape1:wide.", "Skip", None), (TS + "lib/`cart.ts`/total7:", "Skip", None),
    (RS + "impl#[Book]turn().", "METHOD", ("cargo:ledger:impl#[Book]turn().", "cargo:ledger:Book#", "turn", "Book.turn")),
    (RS + "io/impl#[Book][Read]fill().", "METHOD", ("cargo:ledger:io/impl#[Book][Read]fill().", "cargo:ledger:io/Book#", "fill", "Book.fill")),
    (RS + "go(+2).", "FUNCTION", ("cargo:ledger:go(+2).", None, "go", "go")), ("other . . . `a b``c`#", "TYPE", ("scip:_:`a b``c`#", None, "a b`c", "a b`c")),
    ("x y  z p . T#", "TYPE", ("y z:p:T#", None, "T", "T")),
])
def test_symbols(spark, symbol, entity, more):
    row = with_symbol(spark.createDataFrame([(symbol,)], "symbol string")).first()
    assert row.entity == entity
    if more:
        assert (row.symbol_id, row.parent_id, row.name, row.qualified) == more


def test_kind_of_the_index_goes_first(spark):
    df = spark.createDataFrame([(RS + "config/Config#", "Struct", "Shown"), (RS + "impl#[C]new().", "StaticMethod", ""), (RS + "f().(x)", "Class", None), (RS + "f().", "Parameter", None), (RS + "f().", "NoSuch", None)], "symbol string, kind string, d string")
    got = [(r.entity, r.name) for r in with_symbol(df, "symbol", F.col("kind"), F.col("d")).collect()]
    assert got == [("STRUCT", "Shown"), ("METHOD", "new"), ("CLASS", "x"), ("Skip", "f"), ("FUNCTION", "f")]


def inputs(spark, docs, listed=None, relationships=()):
    """docs: (path, [(range, symbol, enclosing or None for a reference)])."""
    d = [(0, i, p, "typescript", "test-indexer 1.0") for i, (p, _) in enumerate(docs)]
    o = [(0, i, k, s, 0 if e is None else 1, r, e or []) for i, (_, occ) in enumerate(docs) for k, (r, s, e) in enumerate(occ)]
    s = [(0, i, 0, symbol, None, "", [], None, [{"symbol": to, "is_implementation": True}]) for i, symbol, to in relationships]
    f = [(p, "typescript", 10, "h", 20) for p in (listed or [p for p, _ in docs])]
    return build(
        spark.createDataFrame(d, "input_ord int, doc_ord int, path string, language string, tool string"),
        spark.createDataFrame(o, "input_ord int, doc_ord int, occ_ord int, symbol string, symbol_roles int, range array<int>, enclosing_range array<int>"),
        spark.createDataFrame(s, "input_ord int, doc_ord int, sym_ord int, symbol string, kind string, display_name string, documentation array<string>, signature_text string, relationships array<struct<symbol:string,is_implementation:boolean>>"),
        spark.createDataFrame(f, "path string, language string, size long, hash string, lines long"),
    )


def shop(main="cli/main.py"):
    """A class with two methods, a function that opens it, and a program that uses them."""
    st, mn = (lambda x: PY + "`shop.store`/" + x), (lambda x: PY + "`cli.main`/" + x)
    store = ("lib/store.py", [
        ([0, 0, 0], st("__init__:"), [0, 0, 16, 0]), ([1, 6, 10], st("Base#"), [1, 0, 3, 0]), ([4, 6, 11], st("Store#"), [4, 0, 11, 0]), ([5, 8, 11], st("Store#put()."), [5, 4, 7, 0]), ([8, 8, 11], st("Store#get()."), [8, 4, 10, 20]),
        ([8, 12, 15], st("Store#get().(key)"), [0]), ([12, 4, 14], st("open_store()."), [12, 0, 15, 12]), ([13, 11, 16], st("Store#"), None), ([9, 15, 18], st("Store#get().(key)"), None), ([9, 20, 22], "local 4", [0]),
    ])
    program = (main, [
        ([0, 0, 0], mn("__init__:"), [0, 0, 12, 0]), ([2, 4, 7], mn("run()."), [2, 0, 8, 9]), ([9, 4, 8], mn("idle()."), [9, 0, 11, 0]), ([0, 18, 23], st("Store#"), None), ([0, 25, 35], st("open_store()."), None), ([0, 5, 15], st("__init__:"), None),
        ([3, 8, 18], st("open_store()."), None), ([4, 4, 7], st("Store#put()."), None), ([4, 30, 33], st("Store#put()."), None), ([5, 4, 9], st("Store#"), None), ([6, 4, 7], "scip-python python requests 2.3 api/get().", None),
        ([7, 4, 8], st("gone()."), None), ([8, 4, 7], mn("run()."), None), ([10, 4, 14], st("open_store()."), None), ([10, 20, 23], st("Store#get()."), None), ([11, 0], st("Store#get()."), None),
    ])
    return [store, program], [(0, st("Store#"), st("Base#"))]


def test_two_files_to_a_graph(spark):
    docs, rel = shop()
    out = inputs(spark, docs, ["lib/store.py", "cli/main.py", "lib/unseen.py"], rel)
    S, M = "python:shop-kit:`shop.store`/", "python:shop-kit:`cli.main`/"
    edges = {(r.source, r.target, r.kind): r for r in out.edges.collect()}
    nodes = {r.id: r for r in out.nodes.collect()}
    stats = {r.name: r.value for r in out.stats.collect()}
    assert stats == {"documents": 2, "ignored_documents": 0, "duplicate_documents": 0, "definitions": 7, "duplicate_definitions": 0, "resolved": 10, "external": 1, "unresolved": 1}
    lines = {i: (nodes[S + i].type, nodes[S + i].start_line, nodes[S + i].end_line) for i in ("Store#", "Store#put().", "Store#get().", "open_store().")}
    assert lines == {"Store#": ("TYPE", 5, 11), "Store#put().": ("METHOD", 6, 7), "Store#get().": ("METHOD", 9, 11), "open_store().": ("FUNCTION", 13, 16)}
    by_kind = lambda kind: {(a, b): (r.n, r.lines) for (a, b, k), r in edges.items() if k == kind}
    assert by_kind("CALLS") == {(M + "run().", S + "open_store()."): (1, [4]), (M + "run().", S + "Store#put()."): (2, [5]), (M + "run().", M + "run()."): (1, [9]), (M + "idle().", S + "open_store()."): (1, [11]), (M + "idle().", S + "Store#get()."): (1, [11])}
    assert by_kind("REFERENCES") == {(S + "open_store().", S + "Store#"): (1, [14]), ("file:cli/main.py", S + "Store#"): (1, [1]), ("file:cli/main.py", S + "open_store()."): (1, [1]), (M + "run().", S + "Store#"): (1, [6])}
    assert by_kind("USES") == {(M + "run().", "external:python:requests"): (1, [7])}
    assert set(by_kind("IMPLEMENTS")) == {(S + "Store#", S + "Base#")}
    assert set(by_kind("CONTAINS")) == {("module:lib", "file:lib/store.py"), ("module:lib", "file:lib/unseen.py"), ("module:cli", "file:cli/main.py"), (S + "Store#", S + "Store#put()."), (S + "Store#", S + "Store#get().")}
    assert set(by_kind("DEFINES")) == {("file:lib/store.py", S + "Base#"), ("file:lib/store.py", S + "Store#"), ("file:lib/store.py", S + "open_store()."), ("file:cli/main.py", M + "run()."), ("file:cli/main.py", M + "idle().")}
    assert by_kind("DEPENDS_ON") == {("file:cli/main.py", "file:lib/store.py"): (8, None), ("module:cli", "module:lib"): (8, None)}
    assert (nodes[S + "open_store()."].fan_in, nodes[S + "Store#"].fan_in, nodes[M + "run()."].fan_in, nodes[M + "run()."].fan_out) == (3, 3, 0, 4)
    assert nodes["external:python:requests"].type == "EXTERNAL" and nodes["module:cli"].type == "MODULE" and "NAMESPACE" not in {n.type for n in nodes.values()}
    assert {r.file_path: r.indexed_by for r in out.manifest.collect()} == {"lib/store.py": "test-indexer 1.0", "cli/main.py": "test-indexer 1.0", "lib/unseen.py": None}
    assert len(nodes) == out.nodes.count()


def test_duplicates_ignored_and_repeated_documents(spark):
    main, run = RS + "main().", RS + "run()."
    docs = [("b.rs", [([4, 3, 7], main, [4, 0, 6, 1]), ([5, 4, 7], run, None)]), ("c.rs", [([0, 3, 4], run, [0, 0, 3, 1]), ([1, 4, 8], main, None)]), ("a.rs", [([0, 3, 7], main, [0, 0, 2, 1])]), ("a.rs", [([0, 3, 7], RS + "late().", [0, 0, 2, 1])]), ("gone.rs", [([0, 3, 7], RS + "gone().", [0, 0, 2, 1])])]
    out = inputs(spark, docs, ["a.rs", "b.rs", "c.rs"])
    nodes = {r.id: r for r in out.nodes.filter("type = 'FUNCTION'").collect()}
    assert {k: n.file_path for k, n in nodes.items()} == {"cargo:ledger:main().": "a.rs", "cargo:ledger:main().~2": "b.rs", "cargo:ledger:run().": "c.rs"}
    assert nodes["cargo:ledger:main().~2"].duplicate_of == "cargo:ledger:main()."
    calls = {(r.source, r.target) for r in out.edges.filter("kind = 'CALLS'").collect()}
    assert calls == {("cargo:ledger:run().", "cargo:ledger:main()."), ("cargo:ledger:main().~2", "cargo:ledger:run().")}
    stats = {r.name: r.value for r in out.stats.collect()}
    assert (stats["ignored_documents"], stats["duplicate_documents"], stats["duplicate_definitions"]) == (1, 1, 1)


def test_empty_inputs(spark):
    out = inputs(spark, [], ["only.py"])
    assert {r.id for r in out.nodes.collect()} == {"file:only.py", "module:."} and out.edges.count() == 1


def test_every_line_of_a_link_is_rebuilt(spark, tmp_path):
    """Seven lines under one id and five more under two others, of which two are the same."""
    run, put = PY + "`cli.main`/run().", PY + "`shop.store`/put()."
    node = lambda i, path, symbol: (i, "FUNCTION", i, path, 1, 40, "python", json.dumps({"symbol": symbol}))
    tables = {
        "nodes": ([node("a", "cli/main.py", run), node("b", "lib/store.py", put)], "id string, type string, name string, file_path string, start_line long, end_line long, language string, metadata string"),
        "edges": ([(i, "a", "b", "CALLS", json.dumps({"count": len(at), "lines": at})) for i, at in enumerate(([2, 3, 4, 5, 6, 7, 8], [9, 10, 3], [11, 10]))] + [(3, "a", "b", "CALLS", None), (4, "a", None, "CALLS", '{"lines": [30]}')], "id long, source_id string, target_id string, type string, metadata string"),
        "file_manifest": ([(5, p, "h", "python", 10, 40, None) for p in ("cli/main.py", "lib/store.py")], "snapshot_no int, file_path string, content_hash string, language string, size long, lines long, indexed_by string"),
    }
    for name, (rows, columns) in tables.items():
        df = spark.createDataFrame(rows, columns)
        if name == "file_manifest":
            df = df.withColumn("loaded_at", F.current_timestamp())
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.kind: (r.edges, r.references) for r in rebuild.rebuilt_graph(spark, str(tmp_path)).collect()}
    assert got["CALLS"] == (1, 10)
    assert {r.name: r.value for r in rebuild.rebuilt_stats(spark, str(tmp_path)).collect()}["resolved"] == 10
